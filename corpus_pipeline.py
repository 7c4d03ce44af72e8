"""A corpus pipeline of five training-data operators over `documents`.

Each stage takes what the stage before it kept, written as Parquet and read again. All but the last return the
columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketglass.llm import common, mixing, packing, pii, quality, simhash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects.

    Null and empty texts score as the sample's share of label 1, so they stay with a mostly good sample; rows that
    repeat share their fate; an empty table, or one without labels, gives all it had. Columns of any name stay.
    """
    model = quality.fit(docs, common.read(spark, sf_dir, "labels"))
    rest = [c for c in docs.columns if c != "doc_id"]
    score = common.fresh("quality_score", docs.columns)
    return quality.classify(docs, model, *rest, score=score).filter(F.col(score) >= quality.THRESHOLD).select(*map(common.quoted, docs.columns))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates (see simhash.representatives).

    Null and empty texts are one group; a null doc_id stays only where its group has no other; of equal rows one stays.
    An empty table stays empty. Columns of any name stay.
    """
    return simhash.representatives(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; n_chars follows.

    Null texts stay null, empty ones empty; every row stays, repeated ones too. Columns of any name stay.
    """
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until sources meet their targets, in training order (see mixing.curriculum).

    Texts without words (null, empty, white space) take no part and go. Rows that repeat are taken each; a null source
    is a source. An empty table stays empty. Columns of any name stay.
    """
    return mixing.curriculum(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences (see packing.pack).

    A null or empty text is one piece of length 1; rows that repeat are packed each. An empty table gives no pieces.
    The pieces' columns replace those of the documents.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL cannot express the classifiers, fingerprints and tokens; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
