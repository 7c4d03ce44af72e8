"""Mixing sources to target weights as a time-varying curriculum. DataFrame functions only: no Python on the rows.

Each source has a weight schedule over training time t from 0 to 1, w(t) = 1 + a (2t - 1), of integral 1. The
integral of the schedule from 0 to t, t + a (t^2 - t), is the share of the source's target that training has
used at t. Inverting it at a document's cumulative words gives the document's training position. Documents of a
source follow each other in the order of a hash of their id, pass after pass.

Cumulative words are found in three small steps, so that no task gets a whole source: sums by 256 x 256 hash
cells of a source (more where rows have ties to tell them apart), running sums over cells, and running sums within a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Weights of sources in code point order, repeating; the schedule's slope goes with the weight.
WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)
#: Passes over a source, at most.
MAX_PASSES = 3
WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]*"


def word_count(text: str | Column) -> Column:
    """Number of WORD matches; 0 for null."""
    col = F.col(text) if isinstance(text, str) else text
    trimmed = F.regexp_replace(col, r"^[\x20\x09-\x0D]+", "")
    return F.coalesce(F.length(F.regexp_replace(trimmed, WORD + SPACE, "x")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target, slope of every source, from columns source and size.

    Targets are in proportion to the weights and sum to all sizes, but none exceeds MAX_PASSES times its source's
    size; the excess is shared among the rest by weight until none is above. With the sources in the order of
    cap / weight, the capped ones are a prefix, so running sums find the level without iterating. One row a source
    meets in these windows, never documents. Null is a source, last in order; a source without words gets 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(WEIGHTS)
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (rank + 1).cast("int"))
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.select("source", "source_size", pick(WEIGHTS).cast("long").alias("w"), pick(SLOPES).alias("slope"), (F.col("source_size") * MAX_PASSES).alias("cap"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("rest", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("weights", F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("capped", F.col("cap") * F.col("weights") <= F.col("rest") * F.col("w"))
    s = s.withColumn("done", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source", "rest", "weights"))).over(Window.partitionBy()))
    share = (F.col("w") * F.col("done.rest")).cast("double") / F.col("done.weights")
    return s.select("source", "source_size", F.when(F.col("capped") | F.col("done").isNull(), F.col("cap").cast("double")).otherwise(share).alias("target"), "slope")


def position(words: Column, target: Column, slope: Column) -> Column:
    """Training time at which a source has used `words` of its target: the inverse of t + a (t^2 - t)."""
    u = words / target
    return 2.0 * u / ((1.0 - slope) + F.sqrt((1.0 - slope) * (1.0 - slope) + 4.0 * slope * u))


def mix(docs: DataFrame, *ties: str) -> DataFrame:
    """doc_id, source, size and the columns `ties` of every row of docs, with source_size, target, slope, taken, before
    (the source's words before this document) and position.

    taken: words that the mix takes of this document, repeats counted: whole passes, and in the last pass those
    words that still fit the target (so one document a source may be cut). position: of its first word in training
    time, null if nothing is taken. Sizes sum per source to source_size; taken sums to the target rounded to the
    nearest word. Null or empty texts have size 0 and take nothing. Documents of equal id are ordered by size and
    the columns `ties`; rows equal in these follow each other, and are numbered instead of sorted, so that no task
    gets more of them than of others. An empty table gives no rows. Further columns of docs are left out.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    # A cell of the id's hash is divided by the ties', so that rows of one or no id don't all meet in one window.
    cell = F.concat(F.substring("_k", 3, 2), F.substring(F.md5(F.concat_ws(" ", *(F.col(t).cast("string") for t in ties)).cast("binary")), 1, 2)) if ties else F.substring("_k", 3, 2)
    names = ["doc_id", "source", "size", *ties]
    rows = docs.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("_k", key).withColumn("_b", F.substring("_k", 1, 2)).withColumn("_c", cell).withColumn("_all", F.col("size") * F.col("_n"))
    cells = rows.groupBy("source", "_b", "_c").agg(F.sum("_all").alias("n"))
    w = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    outer = cells.groupBy("source", "_b").agg(F.sum("n").alias("n")).select("source", "_b", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("low_b"))
    w = Window.partitionBy("source", "_b").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    inner = cells.select("source", "_b", "_c", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("low_c"))
    same = lambda a, b, *on: [a[n].eqNullSafe(b[n]) for n in on]
    low = inner.join(outer, same(inner, outer, "source", "_b")).select(inner["source"], inner["_b"], inner["_c"], (F.col("low_b") + F.col("low_c")).alias("low"))
    targets = source_targets(rows.groupBy("source").agg(F.sum("_all").alias("size")))
    low = low.join(targets, same(low, targets, "source")).select(low["source"].alias("_s"), low["_b"].alias("_b2"), low["_c"].alias("_c2"), "low", "source_size", "target", "slope")
    within = Window.partitionBy("source", "_b", "_c").orderBy("_k", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_all").over(within), F.lit(0)))
    rows = rows.join(low, rows["source"].eqNullSafe(low["_s"]) & (rows["_b"] == low["_b2"]) & (rows["_c"] == low["_c2"]))
    rows = common.spread_copies(rows, "_n", "_copy").withColumn("before", F.col("low") + F.col("_in") + F.col("_copy") * F.col("size"))
    whole = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = whole - passes * F.col("source_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - F.col("before")))
    rows = rows.withColumn("taken", taken)
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, position(F.col("before"), F.col("target"), F.col("slope"))))
    return rows.select(*names, "source_size", "target", "slope", "taken", "before", "position")


def curriculum(docs: DataFrame) -> DataFrame:
    """The mixed corpus in training order: docs' columns, a row for each pass in which a document is taken.

    A document's text is cut behind the last word taken where the target ends within it. Range-sorted by position
    across partitions. Documents of which nothing is taken, and so those without words, are left out: null, empty and
    white-space texts. Rows that repeat are taken each; columns of any name stay as they are. An empty table gives no
    rows.

    The mix is made of ids, sizes and hashes of whole rows; texts join it once, by the hashes, one text for all equal
    rows, and go from there to the range sort.
    """
    names = docs.columns
    every = F.struct(*(docs[common.quoted(n)] for n in names))
    hashes = [F.xxhash64(every), F.xxhash64(F.lit(1), every)]
    rows = docs.select(docs["doc_id"], docs["source"], word_count(docs["text"]).alias("size"), *(h.alias(n) for h, n in zip(hashes, ("h1", "h2"))))
    mixed = mix(common.materialize(rows), "h1", "h2").filter("taken > 0")
    mixed = mixed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    words = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))
    at = position(F.col("before") + F.col("pass") * F.col("source_size"), F.col("target"), F.col("slope"))
    mixed = mixed.select("h1", "h2", F.when(words < F.col("size"), words.cast("int")).alias("cut"), at.alias("at"), "pass")
    whole = docs.select(every.alias("row"), *(h.alias(n) for h, n in zip(hashes, ("h1", "h2")))).dropDuplicates(["h1", "h2"])
    text = F.col("row.text")
    short = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(SPACE + WORD), 0), 1, F.greatest(F.col("cut"), F.lit(1))), "")
    text = F.when(F.col("cut").isNotNull(), short).otherwise(text)
    out = [text.alias(n) if n == "text" else F.length(text).cast(docs.schema[n].dataType).alias(n) if n == "n_chars" else F.col(f"row.{common.quoted(n)}").alias(n) for n in names]
    placed = mixed.join(whole, ["h1", "h2"]).repartitionByRange("at", "h1", "h2", "pass").sortWithinPartitions("at", "h1", "h2", "pass")
    return placed.select(*out)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, in training order (see mix): null and empty texts have size 0 and take nothing, rows that
    repeat are taken each, a null source is a source."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    mixed = mix(common.materialize(docs)).select("doc_id", "size", "source_size", "target", "taken", "position")
    return mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


SQL = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), '')) as k
  from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size from d group by source),
s1 as (select *, (row_number() over (order by source asc nulls last) - 1) % 3 as r from s0),
s2 as (select *, case r when 0 then 5 when 1 then 2 else 1 end as w, case r when 0 then -0.5e0 when 1 then 0e0 else 0.5e0 end as slope, 3 * source_size as cap from s1),
s3 as (select *,
         sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
         sum(w) over () - coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as weights
       from s2),
s4 as (select *, cap * weights <= rest * w as capped from s3),
f as (select rest as f_rest, weights as f_weights from s4 where not capped order by cap / w, source nulls last limit 1),
s5 as (select source, source_size, slope,
         case when capped or f_rest is null then cast(cap as double) else cast(w * f_rest as double) / cast(f_weights as double) end as target
       from s4 left join f on true),
e as (select d.doc_id, d.size, s5.source_size, s5.target, s5.slope, cast(round(s5.target) as bigint) as whole,
         cast(coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as bigint) as before
      from d join s5 on d.source is not distinct from s5.source),
g as (select *, case when source_size > 0 then whole // source_size else 0 end as passes from e),
h as (select *, cast(passes * size + greatest(0, least(size, whole - passes * source_size - before)) as bigint) as taken from g)
select doc_id, size, source_size, target, taken,
       case when taken > 0 then 2.0e0 * (before / target) / ((1.0e0 - slope) + sqrt((1.0e0 - slope) * (1.0e0 - slope) + 4.0e0 * slope * (before / target))) end as position
from h
"""
