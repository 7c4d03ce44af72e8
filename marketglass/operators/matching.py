"""Matching listing titles to catalog variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import compact, memory, name_similarity, normalize, ratio_bound, similarity, token_share
from ..sources.shared import materialize

#: Weights of the attributes, and the rules' limits.
NAME, BRAND, MODEL, RAM, STORAGE, COLOR = 35, 20, 20, 10, 10, 5
THRESHOLD, MARGIN, LEAST_NAME, LEAST_MODEL = 75, 8, 0.65, 0.90


def reachable(titles: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of titles (t) and names (n) that can identify a product, each once, by equi joins: those that share a
    word, names whose letters the title may hold (by their first three), and, for what only the sequence ratio
    reaches, lengths in which LEAST_NAME is possible: 2 * shorter / (shorter + longer) is the most."""
    n, t = names.filter("n != ''"), titles.filter("t != ''")
    grams = _grams(compact(F.col("t")))
    by_word = t.withColumn("k", F.explode(F.array_distinct(F.split("t", " ")))).join(n.withColumn("k", F.explode(F.array_distinct(F.split("n", " ")))).hint("merge"), "k")
    by_start = t.withColumn("k", F.explode(F.array_distinct(grams))).join(n.withColumn("k", F.substring(compact(F.col("n")), 1, 3)).hint("merge"), "k")
    least = LEAST_NAME / (2 - LEAST_NAME)
    lengths = F.sequence(F.ceil(F.length("t") * least - 1e-6), F.floor(F.length("t") / least + 1e-6))
    by_length = t.withColumn("k", F.explode(lengths)).join(n.withColumn("k", F.length("n").cast("long")).hint("merge"), "k").filter(ratio_bound(F.col("t"), F.col("n")) >= LEAST_NAME)
    return by_word.drop("k").unionByName(by_start.drop("k")).unionByName(by_length.drop("k")).distinct()


def _grams(c) -> object:
    """A text's substrings of one to three characters."""
    return F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.array(*(F.substring(c, i, F.lit(k)) for k in (1, 2, 3)))))


def named_in(titles: DataFrame, values: DataFrame) -> DataFrame:
    """t, scope, kind, value: the only value of a kind that a title holds, spaces apart; titles that hold several have none.

    titles: t, scope. values: kind, scope, value (normalised). A value meets the titles of its scope that hold its rarest
    three characters (all it has, if fewer), so frequent beginnings don't bring all together.
    """
    v = values.filter("value != ''").distinct().withColumn("c", compact(F.col("value")))
    own = F.when(F.length("c") < 3, F.array("c")).otherwise(F.transform(F.sequence(F.lit(1), F.length("c") - 2), lambda i: F.substring("c", i, F.lit(3))))
    parts = v.select("c").distinct().select("c", F.explode(F.array_distinct(own)).alias("k"))
    common = parts.groupBy("k").agg(F.count(F.lit(1)).alias("often"))
    rare = _met(parts, common, "k").groupBy("c").agg(F.min_by("k", F.struct("often", "k")).alias("k"))
    x = titles.filter("t != ''").distinct().withColumn("x", compact(F.col("t")))
    x = x.withColumn("k", F.explode(F.array_distinct(_grams(F.col("x")))))
    held = _met(x, _met(v, rare, "c"), ["k", "scope"]).filter(F.contains("x", F.col("c")))
    return held.groupBy("t", "scope", "kind").agg(F.min("value").alias("value"), F.max("value").alias("_last")).filter("value = _last").drop("_last")


def alike(wanted: DataFrame, have: DataFrame, least: float) -> DataFrame:
    """m, vm, score: pairs of texts (m of wanted, vm of have) whose sequence ratio is at least `least`, each once: equal ones,
    and those whose lengths and letters allow it."""
    m, vm = wanted.select("m").filter("m != ''").distinct(), have.select("vm").filter("vm != ''").distinct()
    same = m.join(vm.hint("merge"), F.col("m") == F.col("vm")).select("m", "vm", F.lit(1.0).alias("score"))
    share = least / (2 - least)
    lengths = F.sequence(F.ceil(F.length("m") * share - 1e-6), F.floor(F.length("m") / share + 1e-6))
    near = m.withColumn("k", F.explode(lengths)).join(vm.withColumn("k", F.length("vm").cast("long")).hint("merge"), "k").filter("m != vm").drop("k")
    near = near.filter(ratio_bound(F.col("m"), F.col("vm")) >= least)
    return same.unionByName(near.withColumn("score", similarity(F.col("m"), F.col("vm"))).filter(F.col("score") >= least))


def _met(a: DataFrame, b: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """An equi join in which neither side goes through the driver: texts that repeat make small files of many rows, so sizes
    of files don't tell what a broadcast would hold."""
    return a.join(b.hint("merge"), on, how)


#: What an item may tell, and the variants' column that it is compared with.
_COMPARED = {"rb": "vb", "m": "vm", "ram": "ram_gb", "rom": "storage_gb", "shade": "vc"}


def _differs(x: str, y: str) -> Column:
    """True where both are known and differ."""
    return F.coalesce(F.col(x) != F.col(y), F.lit(False))


def match(items: DataFrame, variants: DataFrame) -> DataFrame:
    """The best variant of each item: item_id, product_id, confidence, status (matched, ambiguous, unmatched).

    items: item_id, title, and brand, model, ram_gb, storage_gb and color where they are sent. variants: product_id, name,
    brand, storage_gb, and model, ram_gb and color where the catalog has them (a column that it lacks doesn't count).
    A brand that the catalog has leaves only its variants; any other leaves all. What isn't sent is taken from the title:
    memory sizes, and the brand, model and color that are the only ones of the candidates' own that it holds. Name, brand,
    model, RAM, storage and color give points, as far as they are sent or found; a known RAM or storage that differs
    rejects, and so does a variant whose name is less than LEAST_NAME and model less than LEAST_MODEL alike. Items without
    a variant left are unmatched, with nulls.

    Items that are asked alike are matched once (by their least id), against variants that differ in what these tell: of
    variants that don't, the least id and whether there are more are kept, as the next best of such a variant is its equal.
    """
    sent = lambda c: normalize(F.col(c)) if c in items.columns else F.lit("")
    number = lambda c: F.col(c).cast("int") if c in items.columns else F.lit(None).cast("int")
    kept = lambda c: normalize(F.col(c)) if c in variants.columns else F.lit("")
    size = lambda c: F.col(c).cast("int") if c in variants.columns else F.lit(None).cast("int")
    ram, rom = memory(F.col("title"))
    has = {c: c in variants.columns for c in ("ram_gb", "color", "model")}
    i = items.select("item_id", normalize(F.col("title")).alias("t"), sent("brand").alias("b"), sent("model").alias("sent_model"), sent("color").alias("sent_color"), (F.coalesce(number("ram_gb"), ram) if has["ram_gb"] else F.lit(None).cast("int")).alias("ram"), F.coalesce(number("storage_gb"), rom).alias("rom"))
    v = variants.select("product_id", kept("name").alias("n"), kept("brand").alias("vb"), kept("model").alias("vm"), size("ram_gb").alias("ram_gb"), size("storage_gb").alias("storage_gb"), kept("color").alias("vc")).distinct()
    v = materialize(v)
    known = v.filter("vb != ''").select(F.col("vb").alias("b")).distinct().withColumn("known", F.lit(True))
    i = _met(i, known, "b", "left").withColumn("scope", F.when(F.col("known"), F.col("b")).otherwise("*"))

    every = lambda kind, c, *scopes: [v.select(F.lit(kind).alias("kind"), s.alias("scope"), F.col(c).alias("value")) for s in scopes]
    values = every("brand", "vb", F.lit("*")) + [x for kind, c in (("model", "vm"), ("color", "vc")) if has[kind] for x in every(kind, c, F.lit("*"), F.col("vb"))]
    found = named_in(i.select("t", "scope").distinct(), reduce(DataFrame.unionByName, values)).groupBy("t", "scope")
    found = found.agg(*(F.max(F.when(F.col("kind") == kind, F.col("value"))).alias(f"found_{kind}") for kind in ("brand", "model", "color")))
    asked = lambda c, kind: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"found_{kind}"))
    i = _met(i, found, ["t", "scope"], "left").select("item_id", "t", "scope", "ram", "rom", asked("b", "brand").alias("rb"), *((asked(f"sent_{k}", k) if has[k] else F.lit(None).cast("string")).alias(c) for k, c in (("model", "m"), ("color", "shade"))))
    every_item = materialize(i.withColumn("told", F.concat(*(F.col(c).isNotNull().cast("int").cast("string") for c in _COMPARED))))
    asked = [c for c in every_item.columns if c != "item_id"]
    i = materialize(every_item.groupBy(*asked).agg(F.min("item_id").alias("asked")))
    which = _met(every_item.select("item_id", F.to_json(F.struct(*asked)).alias("_k")), i.select("asked", F.to_json(F.struct(*asked)).alias("_k")), "_k").drop("_k")

    # Variants by name: of the brand where it is known, else those that the title can reach.
    titles = i.select("t", "scope").distinct()
    near = _met(titles.filter("scope != '*'"), v.select(F.col("vb").alias("scope"), "n").distinct(), "scope").select("t", "scope", "n")
    far = reachable(titles.filter("scope = '*'"), v.select("n").distinct()).select("t", "scope", "n")
    # Few bytes but much work a row: a fixed number of partitions keeps adaptive execution from merging them.
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = (F.col("n") != "") & F.contains("t", F.col("n"))
    # Sequences are compared only where the pair can pass, and where containment doesn't settle the score. The optimizer may
    # merge the filters, so the texts of other pairs are hidden from the functions that compare.
    sure = inside | (token_share(F.col("t"), F.col("n")) >= LEAST_NAME)
    able = sure | (ratio_bound(F.when(~sure, F.col("t")), F.col("n")) >= LEAST_NAME)
    pairs = materialize(near.unionByName(far).repartition(parts, "t", "n").filter(able).withColumn("s", name_similarity(F.when(able, F.col("t")), F.col("n"))).filter(F.col("s") >= LEAST_NAME).withColumnRenamed("s", "n_score"))
    # For each set of attributes that items tell (32 at most), the variants that differ in these.
    differing = v.crossJoin(F.broadcast(i.select("told").distinct())).select("told", "n", "product_id", *(F.when(F.substring("told", k + 1, 1) == "1", F.col(c)).alias(c) for k, c in enumerate(_COMPARED.values())))
    differing = differing.groupBy("told", "n", *_COMPARED.values()).agg(F.min("product_id").alias("product_id"), (F.count(F.lit(1)) > 1).alias("again"))
    in_scope = materialize(differing.withColumn("scope", F.explode(F.array_compact(F.array(F.lit("*"), F.col("vb"))))))
    fits = ~(_differs("rom", "storage_gb") | _differs("ram", "ram_gb"))
    both = _met(_met(i, pairs, ["t", "scope"]), in_scope, ["n", "scope", "told"]).filter(fits)
    # Variants by model.
    models = alike(i, v, LEAST_MODEL)
    others = _met(_met(_met(i, models.drop("score"), "m"), in_scope, ["vm", "scope", "told"]).filter(fits), pairs.select("t", "scope", "n"), ["t", "scope", "n"], "left_anti")

    # Each pair of texts is scored once, however many items and variants have it.
    def scored(c: DataFrame, a: str, b: str, how) -> DataFrame:
        distinct = c.select(a, b).filter(f"{a} is not null and {b} is not null").distinct().repartition(parts, a, b).withColumn(f"{b}_score", how(F.col(a), F.col(b)))
        return _met(c, distinct, [a, b], "left")

    c = materialize(both.unionByName(scored(materialize(others), "t", "n", name_similarity)))
    for a, b in (("rb", "vb"), ("m", "vm"), ("shade", "vc")):
        c = scored(c, a, b, similarity)
    score = lambda name: F.coalesce(F.col(f"{name}_score"), F.lit(0.0))
    same = lambda x, y: F.coalesce(F.col(x) == F.col(y), F.lit(False)).cast("double")
    points, most = NAME * score("n"), F.lit(NAME)
    for told, weight, part in (("rb", BRAND, score("vb")), ("m", MODEL, score("vm")), ("ram", RAM, same("ram", "ram_gb")), ("rom", STORAGE, same("rom", "storage_gb")), ("shade", COLOR, score("vc"))):
        points += F.when(F.col(told).isNotNull(), weight * part).otherwise(0.0)
        most += F.when(F.col(told).isNotNull(), weight).otherwise(0)
    c = c.withColumn("confidence", F.least(F.lit(100), F.greatest(F.lit(0), F.rint(100 * points / most))).cast("int"))
    w = Window.partitionBy("asked").orderBy(F.col("confidence").desc(), F.col("n_score").desc(), "product_id")
    best = c.withColumn("r", F.row_number().over(w)).withColumn("second", F.when(F.col("again"), F.col("confidence")).otherwise(F.lead("confidence").over(w))).filter("r = 1")
    status = F.when(F.col("confidence") < THRESHOLD, "unmatched").when(F.col("confidence") - F.coalesce("second", F.lit(-100)) < MARGIN, "ambiguous").otherwise("matched")
    j = _met(which, best.select("asked", "product_id", "confidence", status.alias("status")), "asked", "left").drop("asked")
    return j.withColumn("status", F.coalesce("status", F.lit("unmatched")))
