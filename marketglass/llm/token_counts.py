"""Token counts of a byte-level BPE vocabulary, by the whole-token shortcut (see tokenizer.ByteBpe)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokenizer


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row.

    A map over the rows: no shuffle, and rows that repeat are counted each. Null or empty texts have 0 bytes and
    0 tokens; a null doc_id stays null; further columns are left out. path: the tokenizer file, which must lie at
    the same place on every machine. The table of whole tokens, at most one entry a vocabulary string, is made once on
    the driver and broadcast.
    """
    path = path or tokenizer.default_path()
    whole = docs.sparkSession.sparkContext.broadcast(tokenizer.whole_tokens(path))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = tokenizer.load(path, whole.value).count_all(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_slices(rows, count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents (see token_counts): null and empty texts have none, repeated rows are counted each."""
    return token_counts(common.read(spark, sf_dir, "documents"))
