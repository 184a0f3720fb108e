"""Benchmark decontamination by template windows, in DataFrame operations only.

Tokens are canonicalised: numbers (with a unit attached or not), units after numbers and
capitalised names inside sentences become typed placeholders; all else is lower-cased and loses
punctuation at its end. Windows of WINDOW canonical tokens with at least LITERALS tokens that
aren't placeholders are hashed; all windows of all documents meet the benchmark's in a hash join.
Windows of one document and item at one distance form an alignment. It counts when it covers at
least COVERAGE of the item's windows and its slots agree: one value of the item always stands for
one value of the document. So verbatim copies and re-parameterised questions are found, and texts
that only share a template with clashing values aren't.

An item shorter than WINDOW tokens is one window of its own length. Items without a window that
has enough literals, or of fewer than LEAST_TOKENS tokens, are too poor for templates (any sum
looks like 12 + 30 = 42): they are matched word by word, with their own numbers and names, by windows of
plain tokens. Null texts and ids and items without tokens match nothing. Texts of any length are whole. Repeated
rows of a doc_id are one document, and of an item_id one item. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_dimension, materialize, without

WINDOW = 8
LITERALS = 5
COVERAGE = 0.5
LEAST_TOKENS = 4
_UNITS = "km|kg|cm|mm|mg|ml|g|m|l|s|h|min|hours?|minutes?|seconds?|days?|weeks?|months?|years?|meters?|metres?|miles?|dollars?|euros?|cents?|percent|pounds?|grams?|liters?|litres?"
NUMBER = rf"(?<![^\x20\x09-\x0D])[$€£+-]?[0-9][0-9.,:/]*(?:%|{_UNITS})?(?=[.,;:!?)]*(?:[\x20\x09-\x0D]|$))"
UNIT = rf"(?<=<num>[\x20\x09])(?i:{_UNITS})(?=[.,;:!?)]*(?:[\x20\x09-\x0D]|$))"
NAME = r"(?<=[\p{Ll}0-9>,;][\x20])\p{Lu}\p{Ll}+(?=(?:'s)?[.,;:!?)]*(?:[\x20\x09-\x0D]|$))"
EDGE = r"(?<=[^\x20\x09-\x0D])[.,;:!?)\"']+(?=[\x20\x09-\x0D]|$)"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def canonical(text: Column) -> Column:
    """The canonical tokens, as many as there are tokens."""
    t = F.regexp_replace(text, NUMBER, "<num>")
    t = F.regexp_replace(t, UNIT, "<unit>")
    t = F.regexp_replace(t, NAME, "<name>")
    return _tokens(F.lower(F.regexp_replace(t, EDGE, "")))


def _literal(token: Column) -> Column:
    return ~token.isin("<num>", "<unit>", "<name>")


def _windows(tokens: Column, size: int) -> Column:
    """A hash for each run of tokens."""
    return F.when(F.size(tokens) >= size, F.transform(F.sequence(F.lit(1), F.size(tokens) - (size - 1)), lambda i: F.xxhash64(*[F.element_at(tokens, i + j) for j in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def plain(text: Column) -> Column:
    """The tokens as they are, lower-cased and without punctuation at their ends."""
    return _tokens(F.lower(F.regexp_replace(text, EDGE, "")))


def _hashed_runs(items: DataFrame) -> DataFrame:
    """item_id, size, item_pos, run of every window. items: item_id, tokens."""
    size = F.least(F.lit(WINDOW), F.size("tokens"))
    runs = items.filter(F.size("tokens") > 0).withColumn("size", size).select("item_id", "size", "tokens", F.posexplode(F.sequence(F.lit(1), F.size("tokens") - size + 1)).alias("item_pos", "i"))
    hashed = F.lit(None).cast("long")
    for n in range(1, WINDOW + 1):
        hashed = F.when(F.col("size") == n, F.xxhash64(*[F.element_at("run", j + 1) for j in range(n)])).otherwise(hashed)
    return runs.withColumn("run", F.slice("tokens", F.col("i"), F.col("size"))).select("item_id", "size", "item_pos", "run", hashed.alias("window"))


def _items(benchmark: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).dropDuplicates(["item_id", "text"])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, plain, size, item_pos, window, n_windows: the template windows with enough literals, and the plain windows of
    items that have none."""
    items = _items(benchmark)
    runs = _hashed_runs(items.select("item_id", canonical(F.col("text")).alias("tokens")).filter(F.size("tokens") >= LEAST_TOKENS))
    runs = runs.filter(F.size(F.filter("run", _literal)) >= F.least(F.lit(LITERALS), F.col("size"))).withColumn("plain", F.lit(False))
    poor = items.join(runs.select("item_id").distinct(), "item_id", "left_anti").select("item_id", plain(F.col("text")).alias("tokens"))
    runs = runs.unionByName(_hashed_runs(poor).withColumn("plain", F.lit(True))).drop("run")
    return runs.join(runs.groupBy("item_id").agg(F.count_distinct("item_pos").alias("n_windows")), "item_id")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_windows (matched), item_windows, coverage, kind (verbatim or reparameterised) of each leak."""
    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # columns of their own: lambdas below read them often
    tokens = {is_plain: rows.select("doc_id", make(F.col("text")).alias("tokens")) for is_plain, make in ((False, canonical), (True, plain))}
    known = materialize(item_windows(benchmark), "windows")
    n_known = known.count()
    kinds = [tuple(r) for r in known.select("plain", "size").distinct().collect()]  # at most 2 * WINDOW values
    hits = None
    for is_plain, size in kinds:
        found = tokens[is_plain].select("doc_id", F.posexplode(_windows(F.col("tokens"), size)).alias("doc_pos", "window"))
        side = known.filter((F.col("size") == size) & (F.col("plain") == is_plain)).drop("size")
        # a window may stand in a third of all documents: the items' side is broadcast if small, else salted
        found = join_dimension(found, side, "window", "inner", rows=n_known, spread=F.xxhash64("doc_id", "doc_pos"))
        found = found.select("doc_id", "item_id", "plain", "item_pos", "n_windows", (F.col("doc_pos") - F.col("item_pos")).alias("shift"))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_windows long, item_windows long, coverage double, kind string")
    aligned = hits.groupBy("doc_id", "item_id", "plain", "shift", "n_windows").agg(F.count_distinct("item_pos").alias("met"), F.min("item_pos").alias("from"), F.max("item_pos").alias("to"))
    aligned = materialize(aligned.filter(F.col("met") >= F.lit(coverage) * F.col("n_windows")), "aligned")

    # slots of the items whose templates matched, with their values; documents are read again only for those
    matched = aligned.filter("NOT plain").select("item_id").distinct()
    items = _items(benchmark).join(matched, "item_id", "left_semi").select("item_id", canonical(F.col("text")).alias("tokens"), _tokens(F.col("text")).alias("raw"))
    slot = F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("at"), F.lower(F.regexp_replace(F.get("raw", i), EDGE, "")).alias("value"), (~_literal(t)).alias("is"))), lambda x: x["is"])
    slots = materialize(items.select("item_id", slot.alias("slots")).filter(F.size("slots") > 0), "slots")
    if slots.isEmpty():
        judged = aligned.withColumn("kind", F.lit("verbatim"))
    else:
        asked = join_dimension(aligned.filter("NOT plain"), slots, "item_id", "inner", spread=F.xxhash64("doc_id", "shift"))
        inside = F.filter("slots", lambda x: x["at"].between(F.col("from"), F.col("to") + WINDOW - 1))
        asked = asked.select("doc_id", "item_id", "shift", F.transform(inside, lambda x: F.struct(x["at"], x["value"])).alias("slots")).filter(F.size("slots") > 0)
        there = rows.join(asked, "doc_id").select("doc_id", "item_id", "shift", _tokens(F.col("text")).alias("raw"), "slots")
        pairs = F.array_distinct(F.transform("slots", lambda x: F.struct(x["value"].alias("a"), F.lower(F.regexp_replace(F.get("raw", x["at"] + F.col("shift")), EDGE, "")).alias("b"))))
        there = there.withColumn("pairs", pairs).withColumn("agree", F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))) == F.size("pairs"))
        there = there.withColumn("same", F.forall("pairs", lambda p: p["a"] == p["b"]))
        verdict = there.groupBy("doc_id", "item_id", "shift").agg(F.max("agree").alias("agree"), F.max("same").alias("same"))
        judged = aligned.join(verdict, ["doc_id", "item_id", "shift"], "left").filter("plain OR agree IS NULL OR agree").withColumn("kind", F.when(F.col("plain") | F.coalesce("same", F.lit(True)), "verbatim").otherwise("reparameterised"))
    best = judged.groupBy("doc_id", "item_id", F.col("n_windows").alias("item_windows")).agg(F.max(F.struct("met", "kind")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.met").alias("n_windows"), "item_windows", (F.col("best.met") / F.col("item_windows")).alias("coverage"), F.col("best.kind").alias("kind"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """docs without the documents that hold a benchmark item."""
    return without(docs, materialize(leaks(docs, benchmark, coverage).select("doc_id").distinct(), "leaking")).select(*docs.columns)
