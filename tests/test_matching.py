"""Product matching: every product is an item, and blocking loses no pair."""

import random
from difflib import SequenceMatcher

from marketglass import plans
from marketglass.operators import matching


def test_every_product_is_an_item(spark, folder):
    ids = [r.item_id for r in plans.QUERIES["match_products"](spark, folder).select("item_id").collect()]
    assert sorted(ids) == sorted(r[0] for r in spark.read.parquet(f"{folder}/part.parquet").select("p_partkey").collect())


def test_items_of_unknown_brand_reach_every_name_that_identifies(spark):
    rng = random.Random(2)
    names = ["galaxy s24 ultra", "iphone 15", "pixel 8 pro", "x", "ab", "abcdefghij", "redmi note 13"]
    titles = ["galaxys24ultra phone", "new iphone15 128gb boxed", "pixal 8 pra", "axbxcdefghij", "fax machine", "garden hose", "cab"]
    titles += ["".join(rng.choice("abcd ") for _ in range(10)).strip() for _ in range(60)]
    names += ["".join(rng.choice("abcd ") for _ in range(8)).strip() for _ in range(60)]
    titles, names = (sorted({" ".join(x.split()) for x in part} - {""}) for part in (titles, names))

    def identifies(t, n):
        share = len(set(t.split()) & set(n.split())) / len(set(n.split()))
        return max(share, SequenceMatcher(None, t, n).ratio()) >= 0.65 or n.replace(" ", "") in t.replace(" ", "")

    found = matching.reachable(spark.createDataFrame([(t,) for t in titles], "t string"), spark.createDataFrame([(n,) for n in names], "n string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in found.select("t", "n").collect()]
    assert len(got) == len(set(got))
    assert {(t, n) for t in titles for n in names if identifies(t, n)} <= set(got)
    assert plan.count("Join Inner, (k") == plan.count("Join Inner") == 3


def test_variants_that_differ_in_ram_or_color_only(spark):
    rows = [(1, "galaxy s24 ultra", "Samsung", 256, 8, "Titan Black"), (2, "galaxy s24 ultra", "Samsung", 256, 12, "Titan Black"), (3, "pixel nine", "Google", 128, None, "Blue"), (4, "pixel nine", "Google", 128, None, "Rose")]
    variants = spark.createDataFrame(rows, "product_id long, name string, brand string, storage_gb int, ram_gb int, color string")
    titles = [(1, "Samsung Galaxy S24 Ultra 12gb ram 256gb", "samsung"), (2, "Galaxy S24 Ultra 8gb ram 256gb", None), (3, "Pixel Nine 128gb rose", "google"), (4, "Pixel Nine 128gb", "google"), (5, "Galaxy S24 Ultra 16gb ram 256gb", "samsung"), (6, "pixel nine 128gb blue rose", "google")]
    items = spark.createDataFrame(titles, "item_id long, title string, brand string")
    got = {r.item_id: (r.product_id, r.confidence, r.status) for r in matching.match(items, variants).collect()}
    assert got[1] == (2, 100, "matched") and got[2] == (1, 100, "matched") and got[5] == (None, None, "unmatched")
    # Colors weigh 5 in 90: they settle which variant is best, within the margin.
    assert got[3][:2] == (4, 100) and got[4][2] == got[6][2] == "ambiguous" and got[4][0] == got[6][0] == 3


def plain(item, variants):
    """One item against all variants, one after the other."""
    import re
    import unicodedata

    def norm(x):
        x = unicodedata.normalize("NFKD", x or "").encode("ascii", "ignore").decode().lower()
        return " ".join(re.sub("[^a-z0-9]+", " ", x).split())

    def ratio(a, b):
        a, b = norm(a), norm(b)
        return 0.0 if not a or not b else 1.0 if a == b else SequenceMatcher(None, a, b).ratio()

    title, t = item["title"], norm(item["title"])
    near = [v for v in variants if item["brand"] and norm(v["brand"]) == norm(item["brand"])] or variants

    def only(key):
        held = {norm(v[key]) for v in near if norm(v[key]) and norm(v[key]).replace(" ", "") in t.replace(" ", "")}
        return held.pop() if len(held) == 1 else None

    asked = {k: item[k] or only(k) for k in ("brand", "model", "color")}
    gb = [int(x) for x in re.findall(r"\b(\d{1,4})\s*gb\b", t)]
    ram = item["ram_gb"] or next((int(x) for x in re.findall(r"\b(\d{1,3})\s*gb\s*ram\b", t)), next((x for x in gb if x <= 32), None))
    rom = next((x for x in gb if x >= 32 and x != ram), None)
    scored = []
    for v in near:
        n = norm(v["name"])
        name = max(ratio(title, v["name"]), len(set(t.split()) & set(n.split())) / len(set(n.split())), float(n in t))
        points, most, model = 35 * name, 35, 0.0
        for key, weight in (("brand", 20), ("model", 20), ("color", 5)):
            if asked[key]:
                part = ratio(asked[key], v[key])
                model = part if key == "model" else model
                points, most = points + weight * part, most + weight
        rejected = name < 0.65 and model < 0.9
        for want, key in ((ram, "ram_gb"), (rom, "storage_gb")):
            if want is not None:
                points, most = points + 10 * (v[key] == want), most + 10
                rejected |= v[key] is not None and v[key] != want
        if not rejected:
            scored.append((round(100 * points / most), name, -v["product_id"]))
    if not scored:
        return None, None, "unmatched"
    scored.sort(reverse=True)
    best = scored[0][0]
    second = scored[1][0] if len(scored) > 1 else -100
    return -scored[0][2], best, "unmatched" if best < 75 else "ambiguous" if best - second < 8 else "matched"


def test_items_equal_the_rules_applied_to_all_variants(spark):
    rng = random.Random(12)
    brands, names, models, colors = ["Samsung", "Apple", "Xiaomi Co"], ["Galaxy S24", "iPhone 15 Pro", "Redmi Note", "Tab"], ["SM-921B", "SM-921U", "A3102", "23117RA"], ["Black", "Titan Black", "Blue", None]
    variants = [{"product_id": k, "name": rng.choice(names), "brand": rng.choice(brands), "model": rng.choice([*models, None]), "ram_gb": rng.choice([8, 12, None]), "storage_gb": rng.choice([128, 256, None]), "color": rng.choice(colors)} for k in range(25)]
    items = []
    for k in range(120):
        v = rng.choice(variants)
        said = [rng.choice([v["name"], v["name"][:6], "phone"]), *(x for x in (v["brand"], v["model"], v["color"]) if x and rng.random() < 0.5)]
        said += [f"{rng.choice([8, 12])}gb ram"] * (rng.random() < 0.3) + [f"{rng.choice([128, 256])} GB"] * (rng.random() < 0.5)
        rng.shuffle(said)
        items.append({"item_id": k, "title": " ".join(said), "brand": rng.choice([None, None, v["brand"], "Nobody"]), "model": rng.choice([None, None, v["model"], "sm 921"]), "ram_gb": rng.choice([None, None, 8]), "color": rng.choice([None, None, "black"])})
    df = spark.createDataFrame([tuple(x.values()) for x in items], "item_id long, title string, brand string, model string, ram_gb int, color string")
    table = spark.createDataFrame([tuple(x.values()) for x in variants], "product_id long, name string, brand string, model string, ram_gb int, storage_gb int, color string")
    got = {r.item_id: (r.product_id, r.confidence, r.status) for r in matching.match(df, table).collect()}
    want = {x["item_id"]: plain(x, variants) for x in items}
    assert {k: (got[k], want[k], items[k]) for k in want if got[k] != want[k]} == {}
    assert {w[2] for w in want.values()} == {"matched", "ambiguous", "unmatched"}


def test_copies_of_items_and_variants(spark):
    """Equal variants are one candidate with an equal behind it, equal items are matched once, and no join of either goes through the driver."""
    variants = spark.createDataFrame([(k * 10 + j, f"{name} phone", "Acme", f"mx{j}", 64) for k in range(30) for j, name in enumerate(("blue", "large", "old"))], "product_id long, name string, brand string, model string, storage_gb int").unionByName(
        spark.createDataFrame([(999, "single phone", "Acme", "q7", 64)], "product_id long, name string, brand string, model string, storage_gb int"))
    items = spark.createDataFrame([(k, ("blue phone acme mx0 64gb", "single phone acme q7 64gb")[k % 2], "acme") for k in range(40)], "item_id long, title string, brand string")
    found = matching.match(items, variants)
    got = {r.item_id: (r.product_id, r.confidence, r.status) for r in found.collect()}
    assert got == {k: ((0, 100, "ambiguous"), (999, 100, "matched"))[k % 2] for k in range(40)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
