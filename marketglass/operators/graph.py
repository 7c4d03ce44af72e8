"""Scores and dense blocks of the graph of buyers and sellers, or of reviewers and products.

Both go in rounds of joins and groupings over the distinct pairs; each round's rows are written, so lineage stays short, and
one small row of sums a round tells the driver when to end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize


def trust(pairs: DataFrame, sellers: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, rounds: int = 100) -> DataFrame:
    """seller_id, trust (sums to 1): where a walk from seller to one of its buyers to one of that buyer's sellers ends up.

    pairs: buyer_id, seller_id, weight (above 0; pairs that repeat are summed, others left out). A step goes by share of
    weight; with 1 - damping it starts anew at any seller. Sellers without buyers pass their trust to all sellers alike.
    Ends once scores change by `tolerance` or less in all, or after `rounds`. Pairs of unknown sellers take no part.
    """
    nodes = materialize(sellers.select("seller_id").filter("seller_id is not null").distinct())
    edges = pairs.filter("buyer_id is not null and weight > 0").groupBy("buyer_id", "seller_id").agg(F.sum(F.col("weight").cast("double")).alias("w")).join(nodes, "seller_id", "left_semi")
    edges = materialize(edges)
    of = lambda key: edges.groupBy(key).agg(F.sum("w").alias("all"))
    out = materialize(edges.join(of("seller_id"), "seller_id").select("buyer_id", "seller_id", (F.col("w") / F.col("all")).alias("share")))
    back = materialize(edges.join(of("buyer_id"), "buyer_id").select("buyer_id", "seller_id", (F.col("w") / F.col("all")).alias("share")))
    linked = edges.select("seller_id").distinct().withColumn("linked", F.lit(True))
    n = nodes.count()
    scores = materialize(nodes.join(linked, "seller_id", "left").select("seller_id", F.lit(1.0 / max(1, n)).alias("trust"), F.coalesce("linked", F.lit(False)).alias("linked")))
    for _ in range(rounds if n else 0):
        lost = scores.filter(~F.col("linked")).agg(F.coalesce(F.sum("trust"), F.lit(0.0))).first()[0]
        buyers = out.join(scores.select("seller_id", "trust"), "seller_id").groupBy("buyer_id").agg(F.sum(F.col("trust") * F.col("share")).alias("held"))
        given = back.join(buyers, "buyer_id").groupBy("seller_id").agg(F.sum(F.col("held") * F.col("share")).alias("got"))
        new = F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))
        step = materialize(scores.join(given, "seller_id", "left").select("seller_id", new.alias("trust"), "linked", F.abs(new - F.col("trust")).alias("moved")))
        moved = step.agg(F.sum("moved")).first()[0]
        scores = step.drop("moved")
        if moved <= tolerance:
            break
    return scores.select("seller_id", "trust")


def dense_block(pairs: DataFrame, slack: float = 0.1) -> tuple[DataFrame, list[tuple[int, float]]]:
    """side (user or product), id and round of the users and products whose pairs are densest, and of each round how many
    were left and how dense.

    pairs: user_id, product_id; repeats count once and nulls take no part. A pair weighs 1 / log2(5 + the product's users),
    so much-bought products don't count as blocks. Density is weight by node. Each round drops all nodes whose own weight
    is at most 2 * (1 + slack) times the density, and the densest round counts: at least 1 / (2 + 2 * slack) of the best
    there is, after rounds that grow with the logarithm of the nodes only.
    """
    one = pairs.select("user_id", "product_id").filter("user_id is not null and product_id is not null").distinct()
    popular = one.groupBy("product_id").agg((1 / F.log2(5 + F.count(F.lit(1)))).alias("w"))
    edges = materialize(one.join(popular, "product_id"))
    told: list[tuple[int, float]] = []
    gone: DataFrame | None = None
    while True:
        side = lambda name, key: edges.groupBy(F.col(key).alias("id")).agg(F.sum("w").alias("w")).withColumn("side", F.lit(name))
        nodes = materialize(side("user", "user_id").unionByName(side("product", "product_id")))
        n, weight = nodes.agg(F.count(F.lit(1)), F.sum(F.when(F.col("side") == "user", F.col("w")))).first()
        if not n:
            break
        density = weight / n
        low = nodes.filter(F.col("w") <= 2 * (1 + slack) * density).select("side", "id", F.lit(len(told)).alias("round"))
        gone = low if gone is None else gone.unionByName(low)
        told.append((n, density))
        kept = edges
        for name, key in (("user", "user_id"), ("product", "product_id")):
            kept = kept.join(low.filter(F.col("side") == name).select(F.col("id").alias(key)), key, "left_anti")
        edges = materialize(kept)
    if gone is None:
        return one.select(F.lit("user").alias("side"), F.col("user_id").alias("id"), F.lit(0).alias("round")).limit(0), told
    best = max(range(len(told)), key=lambda k: (told[k][1], -k))
    return gone.filter(F.col("round") >= best), told
