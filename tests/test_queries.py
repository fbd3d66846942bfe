"""Every registered query with SQL gives the same rows as that SQL, over small tables made here."""

import datetime
import random

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")

from folioframe.plans import all_queries  # noqa: E402

QUERIES, SQL = all_queries()
SLOW = {"d4_identity_match", "d7_duplicate_pairs", "r12_evidence"}


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    out, rng = tmp_path_factory.mktemp("sf"), random.Random(1)
    words = ["the", "that", "from", "soil", "License", "water", "then", "study", "tion", "field", "crop", "result", "Apache"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ".", ",", ".\n", "!"]) for _ in range(n))
    day = lambda k: datetime.datetime(1992, 1, 1) + datetime.timedelta(days=k)
    tables = {
        "region": [(i, n) for i, n in enumerate(["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])],
        "nation": [(i, f"NATION{'A' if i % 2 else 'B'}{i}", i % 5) for i in range(25)],
        "customer": [(i, f"Customer#{i:09d}", i % 25, float(i * 7 % 100 - 20), ["BUILDING", "AUTO"][i % 2]) for i in range(1, 151)],
        "supplier": [(i, f"Supplier#{i:09d}", i % 25, float(i % 7 - 3)) for i in range(1, 51)],
        "part": [(i, f"part {i % 40}", f"Brand#{i % 5}{i % 3}", ["TIN", "Tin", "BRASS"][i % 3], i % 50 + 1, float(i)) for i in range(1, 201)],
        "orders": [(i, rng.randint(1, 140), "OFP"[i % 3], round(rng.random() * 400000, 2), day(rng.randint(0, 2500)), ["1-URGENT", "2-HIGH", "5-LOW"][i % 3]) for i in range(1, 1501)],
        "lineitem": [(o, rng.randint(1, 200), rng.randint(1, 50), k, 1.0, 2.0, 0.1, 0.2, "A", "O", day(k)) for o in range(1, 1501) for k in range(1, rng.randint(2, 5))],
        "events": [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i * 17), rng.randint(0, 60), rng.choice(["signup", "purchase", "error", "click", "view"]), 1.0, f'{{"k": {rng.randint(0, 99)}}}') for i in range(2000)],
        "documents": [(i, text(rng.randint(1, 90)) if i % 40 else "", ["en", "fr", "de"][i % 3], f"src{i % 6}", 1) for i in range(120)],
        "embeddings": [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(150)],
        "pages": [(i, f"HTTPS://Host{i % 9}.example.org/en/{i % 70}{['', '?a=1', '#top', '.html'][i % 4]}", f'<html><a href="/x{i}">t</a> <img src=\'i.png\'> {text(5)}</html>') for i in range(90)],
        "benchmark": [(i, text(20)) for i in range(12)],
        "labels": [(i, 1, i % 2) for i in range(60)],
        "conversations": [(c, t, ["user", "assistant"][t % 2], text(rng.randint(1, 300))) for c in range(20) for t in range(rng.randint(1, 9))],
    }
    columns = {
        "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
        "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
        "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "events": "event_id ts user_id event_type value props",
        "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding label", "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
    }
    small = {"r_regionkey", "n_nationkey", "n_regionkey", "c_nationkey", "s_nationkey", "p_size", "l_linenumber"}
    for name, rows in tables.items():
        frame = pd.DataFrame(rows, columns=columns[name].split())
        frame = frame.astype({c: "int32" for c in frame if c in small}).astype({c: "datetime64[us]" for c in ("ts", "o_orderdate", "l_shipdate") if c in frame})
        frame.to_parquet(out / f"{name}.parquet")
    return str(out)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for name in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return c


def rows(frame):
    def plain(x):
        if pd.isna(x):
            return None
        return str(x) if isinstance(x, (str, bool, datetime.date)) else round(float(x), 5)

    return sorted((repr([plain(x) for x in r]) for r in frame[sorted(frame.columns)].itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(name, spark, sf, duck):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(SLOW))
def test_slow_query_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() >= 0
