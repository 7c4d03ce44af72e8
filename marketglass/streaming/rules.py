"""Price alerts and competitor watches whose rules change while captures come in.

Captures and changes of rules are one stream of events by product, in time order: at one time changes come first. An
alert fires at the first capture at or below its target; it is armed again by every change that sets it active. A watch
fires when the level of its listing's price becomes high under its own threshold; a change that sets it active forgets the
level before. `replayed` gives the same from tables, with windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: Events: a capture has cents, a change has rule_id. level: an alert's target in cents, or a watch's threshold in basis points.
EVENT = "product_id long, seller_id long, at timestamp, ord long, line int, cents long, kind string, rule_id string, is_active boolean, level long, own long"
FIRED = "kind string, rule_id string, product_id long, seller_id long, at timestamp, ord long, line int, cents long, gap_bp long"
_NAMES = [c.split(" ")[0] for c in EVENT.split(", ")]


def events(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """captures (product_id, seller_id, at, ord, line, cents) and changes (kind, rule_id, product_id, seller_id, at, ord,
    is_active, level, own; null: unchanged) as one table or stream. kind is alert or watch; an alert without a seller is about
    all listings of its product."""
    kinds = dict(c.split(" ") for c in EVENT.split(", "))
    whole = lambda df: df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in _NAMES))
    return whole(captures.drop("rule_id", "kind")).unionByName(whole(changes.drop("cents")))


def gap_bp(own: np.ndarray, cents: np.ndarray) -> np.ndarray:
    """(own - price) / price in basis points, rounded half away from zero."""
    gap = own - cents
    return np.sign(gap) * ((2 * np.abs(gap) * 10_000 + cents) // (2 * cents))


#: Products of one group, and the most pairs of a capture and a rule that are held at once.
TOGETHER, PAIRS = 64, 2_000_000


class _Rules(StatefulProcessor):
    """State of a group of products: their alerts, their watches, and the last level of each watch (which may expire)."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rules = handle.getMapState("rules", "product_id long, rule_id string", "kind string, seller_id long, level long, own long, active boolean, fired boolean")
        self.levels = handle.getMapState("levels", "product_id long, rule_id string", "high boolean", ttlDurationMs=self.forget_ms) if self.forget_ms else handle.getMapState("levels", "product_id long, rule_id string", "high boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows), ignore_index=True)
        got["capture"] = got["rule_id"].isna()
        got = got.sort_values(["at", "capture", "ord", "line"], kind="stable", na_position="first", ignore_index=True)
        shown, changed = got[got["capture"]], got[~got["capture"]]
        touched = set(got["product_id"])
        old = {tuple(k): tuple(v) for k, v in self.rules.iterator() if k[0] in touched} if self.rules.exists() else {}
        levels = {tuple(k): v[0] for k, v in self.levels.iterator() if k[0] in touched} if self.levels.exists() else {}

        # Versions of each rule: as it was (at place -1), then after each change; a rule is constant between them.
        number = {k: n for n, k in enumerate(dict.fromkeys([*old, *zip(changed["product_id"], changed["rule_id"])]))}
        if not number:
            return
        was = [old.get(k) for k in number]
        had = [n for n, w in enumerate(was) if w is not None]
        start = pd.DataFrame([was[n] for n in had], columns=["kind", "seller_id", "level", "own", "active", "fired"])
        v = pd.DataFrame({
            "rule": np.array(had + [number[k] for k in zip(changed["product_id"], changed["rule_id"])], np.int64), "place": np.r_[np.full(len(had), -1), changed.index.to_numpy()].astype(np.int64), "kind": [*start["kind"], *changed["kind"]],
            **{c: np.r_[start[c].to_numpy(float), changed[c].to_numpy(float)] for c in ("seller_id", "level", "own")},
            "active": np.r_[start["active"].to_numpy(float), pd.to_numeric(changed["is_active"]).to_numpy(float)],
        }).sort_values(["rule", "place"], kind="stable", ignore_index=True)
        v["stretch"] = ((v["active"] == 1) & (v["place"] >= 0)).groupby(v["rule"]).cumsum()
        for c in ("level", "own", "active"):
            v[c] = v.groupby("rule")[c].ffill()
        # The first seller that is named stays.
        v["seller_id"] = v["seller_id"].where(v["seller_id"] != 0).groupby(v["rule"]).ffill().fillna(v["seller_id"])
        first = v["seller_id"].where(v["seller_id"] != 0).groupby(v["rule"]).transform("first")
        v["seller_id"] = first.where(v["seller_id"].notna() & (v["seller_id"] != 0), v["seller_id"])
        last = v.groupby("rule").tail(1)
        span = len(got) + 1
        begins = v["rule"].to_numpy() * span + v["place"].to_numpy() + 1

        keys, hits = list(number), []
        fired_in: dict[int, int] = {}
        level_in: dict[int, tuple[int, bool]] = {}
        of_product = shown.groupby("product_id", sort=False).indices
        place, seller, cents = shown.index.to_numpy(), shown["seller_id"].to_numpy(), shown["cents"].to_numpy()
        rules_of: dict[int, list[int]] = {}
        for n, k in enumerate(keys):
            if k[0] in of_product:
                rules_of.setdefault(k[0], []).append(n)
        for rules, captures in _pieces(rules_of, of_product):
            version = np.searchsorted(begins, rules * span + place[captures] + 1, "right") - 1
            ok = version >= 0
            ok[ok] = v["rule"].to_numpy()[version[ok]] == rules[ok]
            rules, captures, version = rules[ok], captures[ok], version[ok]
            x = pd.DataFrame({"rule": rules, "place": place[captures], "seller": seller[captures], "cents": cents[captures]})
            for c in ("kind", "level", "own", "active", "stretch", "seller_id"):
                x[c] = v[c].to_numpy()[version]
            x = x[(x["active"] == 1) & x["level"].notna() & (x["seller_id"].isna() | (x["seller_id"] == x["seller"]))].sort_values(["rule", "place"])
            a = x[(x["kind"] == "alert") & (x["cents"] <= x["level"])].drop_duplicates(["rule", "stretch"])
            a = a[~((a["stretch"] == 0) & a["rule"].map(lambda n: was[n] is not None and bool(was[n][5])).astype(bool))]
            hits += [("alert", n, p, None) for n, p in zip(a["rule"], a["place"])]
            fired_in.update(zip(a["rule"], a["stretch"]))
            w = x[(x["kind"] == "watch") & x["own"].notna() & (x["cents"] > 0)]
            if len(w):
                gap = gap_bp(w["own"].to_numpy(np.int64), w["cents"].to_numpy(np.int64))
                now = pd.Series(gap >= w["level"].to_numpy(), index=w.index)
                before = now.groupby([w["rule"], w["stretch"]]).shift(1)
                begun = (w["stretch"] == 0) & w["rule"].map(lambda n: bool(levels.get(keys[n]))).astype(bool)
                rises = now.to_numpy() & ~np.where(before.isna(), begun, before.eq(True))
                hits += [("watch", n, p, int(g)) for n, p, g in zip(w["rule"][rises], w["place"][rises], gap[rises])]
                level_in.update(zip(w["rule"], zip(w["stretch"], now)))

        number_of = lambda c: None if np.isnan(c) else int(c)
        for n, kind, only, level, own, active, stretch in last[["rule", "kind", "seller_id", "level", "own", "active", "stretch"]].itertuples(index=False):
            k = keys[n]
            fired = fired_in.get(n) == stretch or stretch == 0 and was[n] is not None and bool(was[n][5])
            rule = (kind, number_of(only), number_of(level), number_of(own), active == 1, bool(fired))
            if rule != was[n]:
                self.rules.updateValue(k, rule)
            high = bool(level_in[n][1]) if n in level_in and level_in[n][0] == stretch else levels.get(k) if stretch == 0 else None
            if high is None:
                if k in levels:
                    self.levels.removeKey(k)
            elif high != levels.get(k) or self.forget_ms:
                self.levels.updateValue(k, (high,))
        if hits:
            found = got.loc[[h[2] for h in hits], ["product_id", "seller_id", "at", "ord", "line", "cents"]].reset_index(drop=True)
            found.insert(0, "kind", [h[0] for h in hits])
            found.insert(1, "rule_id", [keys[h[1]][1] for h in hits])
            found["gap_bp"] = pd.array([h[3] for h in hits], "Int64")
            yield found.astype({c: "Int64" for c in ("product_id", "seller_id", "ord", "cents")} | {"line": "Int32"})

    def close(self) -> None:
        pass


def _pieces(rules_of: dict[int, list[int]], captures_of: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a rule and a capture of its product, about PAIRS at a time; a rule's captures come together."""
    rules, captures, n = [], [], 0
    for product, mine in rules_of.items():
        shown = np.sort(captures_of[product])
        step = max(1, PAIRS // len(shown))
        for k in range(0, len(mine), step):
            part = np.array(mine[k : k + step], np.int64)
            rules.append(np.repeat(part, len(shown)))
            captures.append(np.tile(shown, len(part)))
            n += len(part) * len(shown)
            if n >= PAIRS:
                yield np.concatenate(rules), np.concatenate(captures)
                rules, captures, n = [], [], 0
    if n:
        yield np.concatenate(rules), np.concatenate(captures)


def fired(merged: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """What alerts and watches of a stream of events fire (columns FIRED).

    Events of a micro-batch are taken by time; those that come in a later batch follow, whatever their time. forget_ms:
    after so long without a capture a watch's level is forgotten. The state is a row a rule and only rows that change are
    written; a micro-batch's captures of TOGETHER products meet in one task, so the source's files per batch bound it. Calls
    into Python cost far more than rows, hence products in groups, each taken with whole columns. The session
    needs a state store that holds maps (`captures.start` sets it).
    """
    return merged.withColumn("together", F.floor(F.col("product_id") / TOGETHER)).groupBy("together").transformWithStateInPandas(_Rules(forget_ms), FIRED, "append", "processingTime" if forget_ms else "none")


def replayed(merged: DataFrame) -> DataFrame:
    """The same from a table: captures are joined to the rules of their product or listing, and each rule's events are
    filled forward by windows."""
    order = ["at", "step", "ord", "line"]
    by = lambda *more: Window.partitionBy("rule_id", *more).orderBy(*order)
    changes = merged.filter("rule_id is not null").withColumn("step", F.lit(0))
    rules = changes.groupBy("rule_id", "kind", "product_id").agg(F.max("seller_id").alias("only"))
    captures = merged.filter("rule_id is null").select("product_id", "seller_id", "at", "ord", "line", "cents", F.lit(1).alias("step"))
    whole = captures.join(rules.filter("only is null").drop("only"), "product_id")
    one = captures.join(rules.withColumnRenamed("only", "seller_id"), ["product_id", "seller_id"])
    every = whole.unionByName(one).unionByName(changes, allowMissingColumns=True)
    last: dict[str, Column] = {c: F.last(c, ignorenulls=True).over(by()) for c in ("is_active", "level", "own")}
    filled = every.withColumns({**last, "armed": F.sum(F.when((F.col("step") == 0) & F.col("is_active"), 1).otherwise(0)).over(by())}).filter("step = 1 and is_active")
    cols = ["product_id", "seller_id", "at", "ord", "line", "cents"]
    hits = filled.filter("kind = 'alert' and cents <= level").groupBy("rule_id", "armed").agg(F.min_by(F.struct(*cols), F.struct("at", "ord", "line")).alias("x"))
    alerts = hits.select(F.lit("alert").alias("kind"), "rule_id", "x.*", F.lit(None).cast("long").alias("gap_bp"))
    gap = F.round(F.try_divide(((F.col("own") - F.col("cents")) * 10_000).cast("decimal(38,6)"), F.col("cents"))).cast("long")
    seen = filled.filter("kind = 'watch' and own is not null and cents > 0").withColumn("gap_bp", gap).withColumn("high", gap >= F.col("level"))
    rises = seen.withColumn("was", F.lag("high").over(by("armed"))).filter("high and not coalesce(was, false)")
    return alerts.unionByName(rises.select("kind", "rule_id", *cols, "gap_bp"))
