"""The pipeline on the smallest tables, stage by stage, and the queries' SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tallyloom.llm import decontaminate

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontamination", "mixing_sources"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == first.columns and dict(out.dtypes) == dict(first.dtypes)
        assert 0 < out.count() <= docs.count(), name
        assert out.select("doc_id").distinct().count() == out.count()
        docs = out
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.contaminated(docs, bench).isEmpty()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    last = corpus_pipeline.mixing_sources(spark, docs, SF).collect()
    assert {r.doc_id for r in last} <= ids and all(1 <= r.mix_times <= 3 for r in last)
    run = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in run.collect()) == sorted(r.doc_id for r in last)


def test_empty_documents(spark, tmp_path):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


@pytest.mark.parametrize("name", ["op4_licences", "op8_quality", "op10_linededup"])
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    cols = want.columns
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_all_ten_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
