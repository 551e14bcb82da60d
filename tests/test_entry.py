"""The driver contract: names, columns and SQL."""

import importlib
import sys

import pytest

duckdb = pytest.importorskip("duckdb")


def test_entry_module():
    entry = importlib.import_module("__spark_entry__")
    q, o = entry.queries(), entry.oracle_sql()
    assert o.keys() <= q.keys() and {"p5_found", "p9_pack"} <= q.keys()


def test_import_without_llm(monkeypatch):
    monkeypatch.setitem(sys.modules, "weirgate.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "p5_found" in entry.queries() and "p8_ids" not in entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)


def test_other_missing_modules_are_no_silent_loss(monkeypatch):
    pytest.importorskip("weirgate.llm")
    monkeypatch.setitem(sys.modules, "weirgate.llm.catalog", None)
    monkeypatch.delattr("weirgate.llm.catalog", raising=False)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    with pytest.raises(ImportError):
        importlib.import_module("__spark_entry__")
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)


def _fixture(folder, spark):
    spark.range(40).selectExpr("id o_orderkey", "id % 7 o_custkey", "'F' o_orderstatus").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    spark.range(7).selectExpr("id c_custkey", "cast(id as int) c_nationkey", "'S' || id c_mktsegment").coalesce(1).write.parquet(f"{folder}/customer.parquet")
    spark.range(25).selectExpr("cast(id as int) n_nationkey").coalesce(1).write.parquet(f"{folder}/nation.parquet")
    spark.range(60).selectExpr("id l_orderkey", "cast(id % 3 as int) l_linenumber", "cast(id as double) l_quantity").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(30).selectExpr("id p_partkey", "cast(id as int) p_size").coalesce(1).write.parquet(f"{folder}/part.parquet")


NAMES = ["number_arabic", "clinic_pairs_explode", "deid_anchored", "deid_names", "deid_legal", "deid_brackets", "qc_legal_types", "term_expand", "unit_canonical", "lab_check", "section_split", "qc_sections", "qc_patterns", "marks_normalize", "doc_type_detect", "citation_extract", "clause_hierarchy", "legal_parts", "gen_medical", "gen_legal", "expected_vs_actual", "lookup_left_join"]


def test_queries_against_sql(spark, tmp_path):
    entry = importlib.import_module("__spark_entry__")
    _fixture(str(tmp_path), spark)
    con = duckdb.connect()
    for t in ("orders", "customer", "nation", "lineitem", "part"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in NAMES:
        mine = entry.queries()[name](spark, str(tmp_path)).toPandas()
        theirs = con.execute(entry.oracle_sql()[name]).df()[list(mine.columns)]
        key = lambda df: sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
        assert key(mine) == key(theirs), name
