"""Chains of pages and answers of repositories against plain loops."""

import random

from pyspark.sql import functions as F

from folioframe.operators import chains
from folioframe.sources import records as R


def states(pages):
    """Follow each page back by hand."""
    lead, giver = {}, {}
    for s, p, asked, _ in pages:
        lead[s, asked] = min(p, lead.get((s, asked), p))
    for s, p, asked, token in pages:
        if token and lead[s, asked] == p:
            giver[s, token] = min(p, giver.get((s, token), p))
    asked_of = {(s, p): a for s, p, a, _ in pages}
    out = {}
    for s, p, asked, _ in pages:
        if lead[s, asked] != p:
            out[s, p] = "again"
            continue
        at, seen = p, set()
        while at not in seen and (s, asked_of[s, at]) in giver:
            seen.add(at)
            at = giver[s, asked_of[s, at]]
        out[s, p] = "cycle" if at in seen else "orphan" if asked_of[s, at] else "followed"
    return out


def test_chains_with_faults(spark, tmp_path):
    rng = random.Random(9)
    pages = [("long", k, f"t{k}" if k else None, f"t{k + 1}") for k in range(130)] + [("ring", k, f"r{k}", f"r{(k + 1) % 7}") for k in range(7)] + [("self", 0, "a", "a")]
    for s in range(25):  # pages that ask and answer at random: forks, rings, gaps, repeats
        pages += [(f"s{s}", k, None if rng.random() < 0.2 else f"t{rng.randint(0, 9)}", None if rng.random() < 0.1 else f"t{rng.randint(0, 9)}") for k in range(rng.randint(1, 14))]
    got = {(r.source, r.page): r.state for r in chains.followed(spark.createDataFrame(pages, "source string, page int, asked string, token string"), f"{tmp_path}/c").collect()}
    want = states(pages)
    assert got == want and set(want.values()) == {"followed", "orphan", "cycle", "again"}


def test_chain_ends(spark, tmp_path):
    rows = []
    for source, last, expires, size in (("whole", "", None, 6), ("short", "", None, 7), ("gap", "T9", "2030-01-01", 6), ("expired", "T9", "2020-01-01", 6), ("repeated", "T1", None, 6)):
        rows += [(source, k, f"T{k}" if k else None, f"T{k + 1}" if k < 2 else last, expires, 2, size) for k in range(3)]
    rows += [("headless", 1, "T1", "", None, 2, 2)]
    frame = spark.createDataFrame(rows, "source string, page int, asked string, token string, expires string, records int, complete_size long").withColumn("expires", F.col("expires").cast("timestamp"))
    got = {r.source: (r.pages, r.followed, r.records, r.ended) for r in chains.chain_report(frame, "2024-01-01", f"{tmp_path}/r").collect()}
    assert got == {"whole": (3, 3, 6, "complete"), "short": (3, 3, 6, "short"), "gap": (3, 3, 6, "gap"), "expired": (3, 3, 6, "expired"), "repeated": (3, 3, 6, "repeated"), "headless": (1, 0, 0, "none")}
    assert chains.chain_report(frame.limit(0), "2024-01-01", f"{tmp_path}/none").count() == 0


def test_descriptions_and_downloads(spark):
    xml = """<o:OAI-PMH><o:Identify><o:repositoryName>A &amp; B</o:repositoryName><o:adminEmail> a@x </o:adminEmail><o:adminEmail/><o:adminEmail>b@x</o:adminEmail></o:Identify></o:OAI-PMH>"""
    d = R.repository_descriptions(spark.createDataFrame([(1, xml), (2, "<x/>"), (3, None)], "id int, xml string")).collect()
    assert [(r.id, r.name, r.admin_emails, r.granularity) for r in d] == [(1, "A & B", ["a@x", "b@x"], None)]
    sets = "<ListSets><set><setSpec>a</setSpec></set><set><setName>n</setName></set><set><setSpec>b:c</setSpec><setName>B</setName></set></ListSets>"
    assert [(r.position, r.spec, r.name) for r in R.set_descriptions(spark.createDataFrame([(sets,)], "xml string")).collect()] == [(0, "a", "a"), (2, "b:c", "B")]
    record = lambda status, body: f'<record><header status="{status}"><identifier>i</identifier></header>{body}</record>'
    page = record("deleted", "<metadata><dc:title>t</dc:title></metadata>") + record("", "") + record("", "<metadata><dc:title>T</dc:title><dc:identifier>https://a/x?a=1&amp;b</dc:identifier><dc:source>HTTPS://a/y</dc:source><dc:relation>https://a/x?a=1&amp;b</dc:relation><dc:identifier>10.1/x</dc:identifier></metadata>")
    assert [(r.position, r.title, r.links) for r in R.downloads(spark.createDataFrame([(page,)], "xml string")).collect()] == [(2, "T", ["https://a/x?a=1&b", "HTTPS://a/y"])]
