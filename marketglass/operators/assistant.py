"""Conversations: intents, search terms, context carried from turn to turn."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import target_price, whole_ids
from ..sources.shared import materialize

# Phrases of each intent, in order of precedence, and the words that aren't search terms.
INTENTS = (
    ("set_price_alert", ("alert", "notify", "notification")),
    ("comparison", ("compare", " versus ", " vs ", "difference")),
    ("price_history", ("history", "historical", "trend", "ever")),
    ("buy_or_wait", ("buy now", "should i buy", "wait", "best time")),
    ("recommendation", ("recommend", "suggest", "similar", "alternative")),
    ("lowest_price", ("lowest", "cheapest", "current price", "price")),
)


# Words of a message that name no product.
STOP_WORDS = ("a", "an", "and", "buy", "compare", "for", "history", "is", "me", "of", "price", "product", "show", "the", "to", "vs", "what", "with")
# How a signal is said.
SIGNALS = {"buy_now": "Buy now", "wait": "Wait", "price_stable": "Price is stable", "insufficient_data": "Insufficient data"}


def intent(message: Column) -> Column:
    """The first intent with a phrase in the message, else product_search."""
    text = F.concat(F.lit(" "), F.lower(F.trim(message)), F.lit(" "))
    out = None
    for name, phrases in INTENTS:
        test = reduce(Column.__or__, (F.contains(text, F.lit(p)) for p in phrases))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("product_search")


def search_terms(message: Column, stop: tuple[str, ...], most: int = 8) -> Column:
    """The first terms of two or more letters or digits that aren't stop words."""
    words = F.regexp_extract_all(F.lower(message), F.lit("([a-z0-9]+)"), 1)
    return F.slice(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stop)), 1, most)


def carry_context(turns: DataFrame, value: str) -> DataFrame:
    """turns with value filled from the conversation's last turn that has one."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("context", F.last(value, ignorenulls=True).over(w))


def entities(messages: DataFrame, products: DataFrame, most: int = 5) -> DataFrame:
    """message_id, rank, product_id, name: active products whose name or model holds a term of the message, by name and id.

    The first eight terms count (see search_terms). Each distinct term meets the distinct names that hold its rarest three
    characters (a term of two: these), so common beginnings don't bring all terms and names together. Only `most` of a
    name's products, and of a term's, are kept: those of a message are among its terms' first ones, and come as one row a term.
    """
    said = messages.select("message_id", F.explode(F.array_distinct(search_terms(F.col("text"), STOP_WORDS))).alias("term"))
    p = products.filter("is_active")
    names = p.select("product_id", "name", F.concat_ws("\n", F.lower("name"), F.lower("model") if "model" in p.columns else F.lit(None).cast("string")).alias("m"))
    cut = lambda c, n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array())
    held = names.select("m").distinct().select("m", F.explode(F.array_distinct(F.concat(cut(F.col("m"), 2), cut(F.col("m"), 3)))).alias("k"))
    term = F.col("term")
    keys = said.select("term").distinct().select("term", F.explode(F.array_distinct(F.when(F.length(term) == 2, F.array(term)).otherwise(cut(term, 3)))).alias("k"))
    often = held.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    rare = keys.join(often, "k").groupBy("term").agg(F.min_by("k", F.struct("n", "k")).alias("k"))
    hits = rare.join(held, "k").filter(F.contains("m", "term")).select("term", "m")
    first = lambda df, key: df.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("name", "product_id"))).filter(F.col("r") <= most).drop("r")
    short = first(hits.join(first(names, "m"), "m").select("term", "product_id", "name"), "term")
    # Written, so that its size is known: terms then aren't taken for larger than messages, which grow with the input.
    short = materialize(short.groupBy("term").agg(F.collect_list(F.struct("name", "product_id")).alias("p")))
    # Dealt out by number: rows alike are sent small, and partitions put together by what is sent would hold very many.
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = said.join(short, "term").select("message_id", "p").repartition(parts, "message_id")
    best = met.groupBy("message_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))), 1, most).alias("p"))
    return best.select("message_id", F.posexplode("p").alias("at", "x")).select("message_id", (F.col("at") + 1).alias("rank"), "x.product_id", "x.name")


def resolved(messages: DataFrame, found: DataFrame, products: DataFrame) -> DataFrame:
    """found (see entities), and for messages without any the active products of their context (array context_ids of texts)."""
    ids = messages.join(found.select("message_id").distinct(), "message_id", "left_anti").select("message_id", F.explode(F.array_distinct(whole_ids(F.col("context_ids")))).alias("product_id"))
    known = ids.join(products.filter("is_active").select("product_id", "name"), "product_id")
    w = Window.partitionBy("message_id").orderBy("name", "product_id")
    return found.unionByName(known.withColumn("rank", F.row_number().over(w)).select("message_id", "rank", "product_id", "name"))


def answers(messages: DataFrame, found: DataFrame, facts: DataFrame, similar: DataFrame, with_alert: DataFrame) -> DataFrame:
    """message_id, intent, answer: a sentence from stored figures only, for each message (message_id, text).

    found: products of the messages (see resolved). facts, one row a product: lowest (of available offers), low (of
    history), points, listings, suggestion, confidence, and personal: whether the user's own target was applied. similar: product_id, rank, other (names of alternatives).
    with_alert: product_id of the user's active alerts. All questions but comparisons are about the first product.
    """
    m = messages.select("message_id", intent(F.col("text")).alias("intent"), target_price(F.col("text")).alias("wanted"))
    f = found.join(facts.select("product_id", "lowest"), "product_id", "left")
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c])
    three = F.filter(F.collect_list(F.when(F.col("rank") <= 3, F.struct("lowest", "rank", "name"))), lambda x: x["lowest"].isNotNull())
    per = f.groupBy("message_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rank", "product_id", "name")).alias("first"), F.array_join(order("name"), ", ").alias("names"), F.array_sort(three).alias("priced"))
    j = m.join(per, "message_id", "left").withColumns({"product_id": F.col("first.product_id"), "name": F.col("first.name")})
    others = similar.groupBy("product_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]), ", ").alias("others"))
    j = j.join(facts, "product_id", "left").join(others, "product_id", "left").join(with_alert.select("product_id", F.lit(True).alias("watched")).distinct(), "product_id", "left")
    pkr = lambda c: F.concat(F.lit("PKR "), c.cast("decimal(18,2)").cast("string"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    best, dearest = F.try_element_at("priced", F.lit(1)), F.try_element_at("priced", F.lit(-1))
    compared = F.when(F.col("n") < 2, "Only one product was found. Name a second one to compare.").when(F.size("priced") == 0, "None of these products has an available offer.")
    compared = compared.otherwise(say(best["name"], " has the lowest offer, ", pkr(best["lowest"]), "; the gap is ", pkr(dearest["lowest"] - best["lowest"]), "."))
    signal = F.element_at(F.create_map(*(F.lit(x) for pair in SIGNALS.items() for x in pair)), F.coalesce("suggestion", F.lit("insufficient_data")))
    said = {
        "comparison": compared,
        "price_history": say(F.col("name"), " has ", F.coalesce("points", F.lit(0)).cast("string"), " stored prices of ", F.coalesce("listings", F.lit(0)).cast("string"), " listings; the low is ", F.coalesce(pkr(F.col("low")), F.lit("not available")), "."),
        "buy_or_wait": say(signal, " for ", F.col("name"), F.when(F.col("personal"), ". Your saved price target is applied").otherwise(". Create a price alert to personalize this signal"), ". Confidence is ", F.coalesce("confidence", F.lit("low")), "."),
        "recommendation": F.when(F.col("others").isNull(), say("No alternatives to ", F.col("name"), " are stored.")).otherwise(say("Alternatives to ", F.col("name"), ": ", F.col("others"), ".")),
        "set_price_alert": F.when(F.col("wanted").isNull(), say("Name a target price for ", F.col("name"), ".")).when(F.col("watched"), say("An active alert for ", F.col("name"), " exists.")).otherwise(say("Alert for ", F.col("name"), " at ", pkr(F.col("wanted")), ".")),
        "lowest_price": F.when(F.col("lowest").isNull(), say("No available offer of ", F.col("name"), " is stored.")).otherwise(say("The lowest offer of ", F.col("name"), " is ", pkr(F.col("lowest")), ".")),
    }
    answer = F.when(F.col("product_id").isNull(), "No active product matches.")
    for name, text in said.items():
        answer = answer.when(F.col("intent") == name, text)
    return j.select("message_id", "intent", answer.otherwise(say("Found ", F.col("names"), ".")).alias("answer"))


def turns(conversations: DataFrame, messages: DataFrame, found: DataFrame, default: str = "New shopping conversation") -> DataFrame:
    """conversations (conv_id, title, context map) after their users' messages (conv_id, message_id, text, in id order).

    The context keeps its other keys; product_ids and last_intent are those of the last message. A default title
    becomes the name of the first message's first product, or that message's first 80 characters.
    """
    first_name = found.filter("rank = 1").select("message_id", "name")
    ids = found.groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "product_id"))), lambda x: x["product_id"].cast("string")), ",").alias("ids"))
    m = messages.join(first_name, "message_id", "left").join(ids, "message_id", "left").withColumn("intent", intent(F.col("text")))
    g = m.groupBy("conv_id").agg(F.min(F.struct("message_id", F.coalesce("name", F.left("text", F.lit(80))).alias("title"))).alias("f"), F.max(F.struct("message_id", "ids", "intent")).alias("l"))
    j = conversations.join(g, "conv_id", "left")
    new = F.create_map(F.lit("product_ids"), F.coalesce("l.ids", F.lit("")), F.lit("last_intent"), F.col("l.intent"))
    kept = F.map_filter(F.coalesce("context", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~k.isin("product_ids", "last_intent"))
    context = F.when(F.col("l").isNull(), F.col("context")).otherwise(F.map_concat(kept, new))
    return j.select("conv_id", F.when((F.col("title") == default) & F.col("f").isNotNull(), F.col("f.title")).otherwise(F.col("title")).alias("title"), context.alias("context"))
