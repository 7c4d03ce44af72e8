"""The pipeline's stages on a small corpus, and the registered SQL against DuckDB."""

import duckdb
import pytest

import corpus_pipeline
from marketglass.llm import common, pii, queries, simhash

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.read(spark, FOLDER, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialize(stage(spark, before, FOLDER))
        assert after.columns == docs.columns, name
        a, b = {r.doc_id: r.text for r in before.collect()}, after.collect()
        assert 0 < len(b) and {r.doc_id for r in b} <= set(a)
        if name == "quality classifier":
            assert len(b) > 0.75 * len(a)
        elif name == "SimHash near-dedup":
            groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(before).collect()}
            assert sorted(r.doc_id for r in b) == sorted(set(groups.values()))
        elif name == "PII":
            assert not any(pii.base_spans(r.text or "") for r in b) and len(b) == len(a)
        before = after
    assert corpus_pipeline.STAGES[-1][1](spark, before, FOLDER).count() >= before.count()


def test_run_on_an_empty_corpus(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = common.read(spark, FOLDER, "documents").withColumn("quality_score", F.lit(1)).withColumn("text_hash", F.lit("a"))
    clashing = ["_size", "_t", "_at", "_pass", "taken", "size", "at", "pass", "before", "position", "h1", "h2", "row", "fp", "component_id", "_a", "_k", "_n", "shard", "a.b"]
    for k, c in enumerate(clashing):
        docs = docs.withColumn(c, F.lit(k))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        rows = [tuple(r[len(docs.columns) - len(clashing) :]) for r in out.collect()]
        assert rows and set(rows) == {tuple(range(len(clashing)))}, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() >= docs.count()


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    want = c.execute(queries.SQL[name]).fetchall()
    names = [x[0] for x in c.description]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, FOLDER).select(*names).collect())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_every_query_gives_every_row(spark, name):
    rows = queries.QUERIES[name](spark, FOLDER).count()
    n = common.read(spark, FOLDER, "documents").count()
    assert rows >= n if name.startswith("op4") else rows > 0 if name.startswith("op7") else rows == n
