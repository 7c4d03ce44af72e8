"""State changes as plans: alerts, memberships, status, deletions, read marks. The caller writes the results.

Each function takes the table as it is and a table of changes, and gives outcomes, or the table as it becomes. A batch
holds at most one change of a row; what a batch asks for twice goes to the first of it, by change_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import sku

TARGET = ["user_id", "product_id", "seller_id"]


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> list:
    return [a[n].eqNullSafe(b[n]) for n in names]


def alert_outcomes(alerts: DataFrame, changes: DataFrame, products: DataFrame, listings: DataFrame) -> DataFrame:
    """change_id, kind, outcome of changes (change_id, kind, alert_id, TARGET, target_price, is_active).

    create: no_target unless the active product, or the listing, exists; duplicate if the user has an active alert for
    the same target, or an earlier row of the batch creates it; else created. update and delete: not_found unless
    the alert is the user's own; an update that makes an inactive alert active is a duplicate if another one for its
    target is active; else updated and deleted (which keeps the row, inactive).
    """
    active = alerts.filter("is_active").select(*TARGET).distinct().withColumn("taken", F.lit(True))
    new = changes.filter("kind = 'create'")
    order = Window.partitionBy(*TARGET).orderBy("change_id")
    new = new.withColumn("n", F.row_number().over(order))
    there = products.filter("is_active").select(F.col("product_id").alias("p"), F.lit(True).alias("has_product"))
    offer = listings.select(F.col("product_id").alias("lp"), F.col("seller_id").alias("ls"), F.lit(True).alias("has_listing"))
    n = new.join(active, _same(new, active, TARGET), "left").select(new["*"], "taken")
    n = n.join(there, n.product_id == there.p, "left").join(offer, (n.product_id == offer.lp) & (n.seller_id == offer.ls), "left")
    exists = F.when(F.col("seller_id").isNull(), F.col("has_product")).otherwise(F.col("has_listing"))
    created = F.when(exists.isNull(), "no_target").when(F.col("taken") | (F.col("n") > 1), "duplicate").otherwise("created")
    one = n.select("change_id", "kind", created.alias("outcome"))
    own = alerts.select("alert_id", "user_id", F.col("product_id").alias("op"), F.col("seller_id").alias("os"), F.col("is_active").alias("was"))
    old = changes.filter("kind <> 'create'").select("change_id", "kind", "alert_id", "user_id", "is_active").join(own, ["alert_id", "user_id"], "left")
    o = old.join(active.select(F.col("user_id").alias("au"), F.col("product_id").alias("ap"), F.col("seller_id").alias("asl"), "taken"), (F.col("user_id") == F.col("au")) & F.col("op").eqNullSafe(F.col("ap")) & F.col("os").eqNullSafe(F.col("asl")), "left")
    wakes = (F.col("kind") == "update") & F.col("is_active") & ~F.col("was") & F.col("taken")
    said = F.when(F.col("was").isNull(), "not_found").when(F.coalesce(wakes, F.lit(False)), "duplicate").when(F.col("kind") == "delete", "deleted").otherwise("updated")
    return one.unionByName(o.select("change_id", "kind", said.alias("outcome")))


def alerts_after(alerts: DataFrame, changes: DataFrame, outcomes: DataFrame, first_id: int) -> DataFrame:
    """alerts after the changes that were accepted. New ones get first_id + change_id; making an alert active arms it
    again (triggered_at becomes null)."""
    done = changes.join(outcomes.filter("outcome in ('created', 'updated', 'deleted')").select("change_id", "outcome"), "change_id")
    cols = alerts.columns
    new = done.filter("outcome = 'created'").select((F.col("change_id") + first_id).alias("alert_id"), *TARGET, "target_price", F.lit(True).alias("is_active"), F.lit(None).cast(alerts.schema["triggered_at"].dataType).alias("triggered_at"))
    c = done.filter("outcome <> 'created'").select("alert_id", "outcome", F.col("target_price").alias("t"), F.col("is_active").alias("a"))
    j = alerts.join(c, "alert_id", "left")
    deleted = F.col("outcome") == "deleted"
    j = j.withColumns({
        "target_price": F.when(~deleted, F.coalesce("t", "target_price")).otherwise(F.col("target_price")), "triggered_at": F.when(~F.coalesce(~deleted & F.col("a"), F.lit(False)), F.col("triggered_at")),
        "is_active": F.when(deleted, False).otherwise(F.coalesce("a", "is_active")),
    }).withColumn("target_price", F.coalesce("target_price", "t"))
    return j.select(*cols).unionByName(new.select(*cols))


def joined(members: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """key and outcome of rows to be added to members (key, is_active): created, reactivated if it is there but inactive,
    duplicate if it is there and active, or asked for before in the batch (by change_id)."""
    w = wanted.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("change_id")))
    j = w.join(members.select(*key, "is_active"), key, "left")
    said = F.when(F.col("is_active") | (F.col("n") > 1), "duplicate").when(F.col("is_active").isNull(), "created").otherwise("reactivated")
    return j.select(*key, "change_id", said.alias("outcome"))


def saved_products(products: DataFrame, wanted: DataFrame, catalog: DataFrame, currency: str = "PKR") -> DataFrame:
    """change_id, outcome, sku (normalised) of an organisation's products to be made (no product_id) or changed, held against
    products (org_id, product_id, sku) as they were before the batch.

    wanted: change_id, org_id, product_id, sku, canonical_id, currency; in a change nulls leave things as they are. In order: a
    product to be changed must be the organisation's own (not_found), the currency the one served (currency), a catalog
    product named must be active (unknown_catalog_product), and the SKU no other product's of the organisation (sku_taken),
    before the batch or by an earlier change in it that passed. Blank SKUs are none and never clash.
    """
    own = products.select("org_id", "product_id").distinct().withColumn("_own", F.lit(True))
    active = catalog.filter("is_active").select(F.col("product_id").alias("canonical_id")).distinct().withColumn("_active", F.lit(True))
    held = products.withColumn("sku", sku(F.col("sku"))).filter("sku is not null").groupBy("org_id", "sku").agg(F.min("product_id").alias("_holder"))
    w = wanted.withColumn("sku", sku(F.col("sku"))).join(own, ["org_id", "product_id"], "left").join(active, "canonical_id", "left").join(held, ["org_id", "sku"], "left")
    change = F.col("product_id").isNotNull()
    served = F.when(change & F.col("currency").isNull(), True).otherwise(F.coalesce(F.col("currency") == currency, F.lit(False)))
    early = F.when(change & F.col("_own").isNull(), "not_found").when(~served, "currency").when(F.col("canonical_id").isNotNull() & F.col("_active").isNull(), "unknown_catalog_product")
    early = F.coalesce(early, F.when(F.col("_holder").isNotNull() & ~F.coalesce(F.col("_holder") == F.col("product_id"), F.lit(False)), "sku_taken"))
    w = w.withColumn("_early", early).withColumn("_who", F.coalesce("product_id", -F.col("change_id")))
    # Who asks first for a SKU that is free, among what passed; without a SKU each is alone.
    first = F.first("_who").over(Window.partitionBy("org_id", F.coalesce("sku", F.concat(F.lit(" "), F.col("change_id").cast("string"))), F.col("_early").isNull()).orderBy("change_id"))
    said = F.coalesce("_early", F.when(F.col("sku").isNotNull() & (F.col("_first") != F.col("_who")), "sku_taken").otherwise(F.when(change, "updated").otherwise("created")))
    return w.withColumn("_first", first).select("change_id", said.alias("outcome"), "sku")


def set_status(rows: DataFrame, wanted: DataFrame, key: str, self_id: int | None = None) -> DataFrame:
    """key, outcome of changes (key, is_active): not_found, refused (one can't deactivate oneself), unchanged or changed."""
    j = wanted.select(key, F.col("is_active").alias("to")).join(rows.select(key, "is_active"), key, "left")
    own = (F.col(key) == self_id) & ~F.col("to") if self_id is not None else F.lit(False)
    said = F.when(F.col("is_active").isNull(), "not_found").when(own, "refused").when(F.col("to") == F.col("is_active"), "unchanged").otherwise("changed")
    return j.select(key, said.alias("outcome"))


def cascade(rows: DataFrame, gone: DataFrame, key: str | list[str]) -> DataFrame:
    """rows without those that refer to what is gone."""
    return rows.join(gone.select(key), key, "left_anti")


def set_null(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows whose reference to what is gone is null."""
    j = rows.join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    return j.select(*(F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == key else F.col(c) for c in rows.columns))


def restricted(gone: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Those of gone that no row refers to: only they may be deleted."""
    return gone.join(rows.select(key), key, "left_anti")


def read_marks(notifications: DataFrame, marks: DataFrame) -> DataFrame:
    """notifications (notification_id, user_id, is_read) after marks (user_id, notification_id; null id: all of the user's).

    marked tells which a mark has changed; marks of others' notifications change nothing.
    """
    every = marks.filter("notification_id is null").select("user_id").distinct().withColumn("all_", F.lit(True))
    one = marks.filter("notification_id is not null").select("user_id", "notification_id").distinct().withColumn("one_", F.lit(True))
    j = notifications.join(every, "user_id", "left").join(one, ["user_id", "notification_id"], "left")
    hit = F.coalesce("all_", "one_", F.lit(False))
    return j.withColumn("marked", hit & ~F.col("is_read")).withColumn("is_read", F.col("is_read") | hit).select(*notifications.columns, "marked")


def resolve_sellers(items: DataFrame, sellers: DataFrame) -> DataFrame:
    """items (item_id, platform, external_id, seller_name) with seller_id and matched_by: external_id, name or new.

    The external id counts first; items without one, or with an unknown one, are matched by the name, trimmed and in
    any case, within the platform. Of several sellers the one with the smallest id.
    """
    by_id = sellers.filter("external_id <> ''").groupBy("platform", "external_id").agg(F.min("seller_id").alias("s1"))
    by_name = sellers.groupBy("platform", F.lower("seller_name").alias("_n")).agg(F.min("seller_id").alias("s2"))
    j = items.withColumn("_n", F.lower(F.trim("seller_name"))).join(by_id, ["platform", "external_id"], "left").join(by_name, ["platform", "_n"], "left")
    how = F.when(F.col("s1").isNotNull(), "external_id").when(F.col("s2").isNotNull(), "name").otherwise("new")
    return j.select("item_id", F.coalesce("s1", "s2").alias("seller_id"), how.alias("matched_by"))


def seller_after(sellers: DataFrame, items: DataFrame, resolved: DataFrame) -> DataFrame:
    """sellers refreshed by the last item (by item_id) of each: the name is taken over; an external id never becomes blank."""
    last = items.join(resolved.filter("seller_id is not null"), "item_id").groupBy("seller_id").agg(F.max(F.struct("item_id", F.trim("seller_name").alias("name"))).alias("x"), F.max(F.when(F.col("external_id") != "", F.struct("item_id", "external_id"))).alias("e"))
    j = sellers.join(last, "seller_id", "left")
    return j.select("seller_id", "platform", F.coalesce("e.external_id", "external_id").alias("external_id"), F.coalesce("x.name", "seller_name").alias("seller_name"))


def legacy_ingest(items: DataFrame, listings: DataFrame, platforms: DataFrame, models: DataFrame, variants: DataFrame, categories: DataFrame, category: str = "smartphones") -> DataFrame:
    """What each item (item_id, platform, external_id, model, color) makes on its way in, in the order of item_id.

    A listing is known by its external id alone, whatever the platform: then it is updated and nothing else happens.
    Otherwise missing levels are made: platform, the one category (slug), product (by the model's first 120 characters),
    variant (by product and color, where N/A and blank are none) and the listing. The first item of a batch that needs a
    level makes it.
    """
    known = listings.select("external_id").distinct().withColumn("listed", F.lit(True))
    i = items.withColumn("model", F.left("model", F.lit(120))).withColumn("color", F.when(~F.col("color").isin("", "N/A"), F.col("color")))
    i = i.join(known, "external_id", "left").withColumn("again", F.row_number().over(Window.partitionBy("external_id").orderBy("item_id")) > 1)
    updated = i.filter("listed or again").select("item_id", F.lit("updated").alias("action"), *(F.lit(False).alias(c) for c in ("new_platform", "new_category", "new_product", "new_variant")))
    new = i.filter("listed is null and not again")

    def makes(key: list[str], have: DataFrame, name: str, df: DataFrame) -> DataFrame:
        had = have.select(*(F.col(k).alias(f"_{k}") for k in key)).distinct().withColumn("_had", F.lit(True))
        first = F.row_number().over(Window.partitionBy(*key).orderBy("item_id")) == 1
        on = [df[k].eqNullSafe(had[f"_{k}"]) for k in key]
        return df.withColumn("_first", first).join(had, on, "left").withColumn(name, F.col("_had").isNull() & F.col("_first")).drop("_had", "_first", *(f"_{k}" for k in key))

    new = makes(["platform"], platforms, "new_platform", new)
    # All items need the same category: the least id alone makes it, found by a partial minimum and not by a window over all.
    first = new.agg(F.min("item_id").alias("item_id")).withColumn("_slug", F.lit(category)).join(categories.select(F.col("slug").alias("_slug")).distinct(), "_slug", "left_anti")
    new = new.join(first, "item_id", "left").withColumn("new_category", F.col("_slug").isNotNull()).drop("_slug")
    new = makes(["model"], models, "new_product", new)
    new = makes(["model", "color"], variants, "new_variant", new)
    return updated.unionByName(new.select("item_id", F.lit("created").alias("action"), "new_platform", "new_category", "new_product", "new_variant"))


def capture_outcomes(captures: DataFrame, platforms: DataFrame, products: DataFrame, history: DataFrame, currency: str = "PKR") -> DataFrame:
    """capture_id, outcome of captures (capture_id, platform, product_id, seller_id, captured_at, currency): the first check
    that it fails, in order, or accepted.

    The platform is active, the product exists, it is active, the currency is the one served, and the listing has no
    capture of that time, in history or earlier in the batch.
    """
    p = platforms.select("platform", F.col("is_active").alias("_platform"))
    q = products.select("product_id", F.col("is_active").alias("_product"))
    h = history.select("product_id", "seller_id", "captured_at").distinct().withColumn("_had", F.lit(True))
    sound = F.coalesce("_platform", F.lit(False)) & F.coalesce("_product", F.lit(False)) & F.coalesce(F.col("currency") == currency, F.lit(False))
    j = captures.join(p, "platform", "left").join(q, "product_id", "left").join(h, ["product_id", "seller_id", "captured_at"], "left").withColumn("_sound", sound)
    n = F.row_number().over(Window.partitionBy("product_id", "seller_id", "captured_at", "_sound").orderBy("capture_id"))
    said = (
        F.when(~F.coalesce("_platform", F.lit(False)), "inactive_platform").when(F.col("_product").isNull(), "unknown_product").when(~F.col("_product"), "inactive_product")
        .when(~F.coalesce(F.col("currency") == currency, F.lit(False)), "currency").when(F.col("_had") | (F.col("_n") > 1), "duplicate").otherwise("accepted")
    )
    return j.withColumn("_n", n).select("capture_id", said.alias("outcome"))
