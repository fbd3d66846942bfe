"""The registry imports, with and without its optional part."""

import importlib
import sys

import pytest


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline",), ("folioframe.llm", "corpus_pipeline")])
def test_registry(gone, monkeypatch):
    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name in gone:
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n == "__spark_entry__" or gone and n.startswith("folioframe.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
    if gone:
        assert not any(q.startswith("op") or q == "pipeline" for q in queries)
    monkeypatch.undo()
    for name in [n for n in sys.modules if n == "__spark_entry__"]:
        del sys.modules[name]


def test_entry_runs(spark, tmp_path):
    entry = importlib.import_module("__spark_entry__")
    spark.createDataFrame([(1, 1), (2, 1)], "l_orderkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "soil", "t")], "p_partkey bigint, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in entry.queries()["a4_keyword_trends"](spark, str(tmp_path)).collect()] == [("soil", 2)]
