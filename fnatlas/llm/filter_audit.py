"""What filters take from each other: every order of five filters, from one cube.

Each document is measured whole against five failure conditions, once. Rows of a part with the same
flags are counted together, and GROUP BY CUBE over the five flags and the part counts them for every subset
of the filters: the grouping set of a subset has one row in which all of its flags are false, and that row
holds the subset's survivors in the part. A step of an order lies between two subsets, before and after its
filter, so all steps come from joins of pairs of subsets. Nothing is read again for an order.

Conditions, on the whole text (null: empty; words: runs of anything but space, tab, \\n, \\v, \\f, \\r):
A under 200 words; B 100 * distinct words < 50 * words; C 100 * capitals A-Z > 2 * code points; D a
character of #$%&*|; E the text of any row with a smaller doc_id, whether a filter removes that row or not.

A null source is the part ''. A row with a null doc_id has no smaller one, is smaller than none and has no label,
so it never fails E; rows that share a doc_id and a text are no copies of each other. Of repeated labels, any 1 counts.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
SYMBOLS = r"[#$%&*|]"
FULL = (1 << len(FILTERS)) - 1
COUNTS = ("kept", "good", "toxic")


def flags(text: Column) -> dict[str, Column]:
    """The four conditions that a text meets or not by itself."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": F.lit(100) * distinct < F.lit(LEAST_DISTINCT_PERCENT) * n,
        "C": F.lit(100) * capitals > F.lit(MOST_CAPITALS_PERCENT) * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def measure(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, text_sha, A, B, C, D of every row, written once; texts are not needed again."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialize(rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_sha"), *[c.alias(k) for k, c in flags(F.col("text")).items()]), "audit-flags")


def flag_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, A to E, kept (rows), good, toxic: rows of a part with the same flags together, 32 rows a part at most.

    The first row of each text is found by an aggregation that combines before its shuffle, and meets its
    document by (doc_id, text), so that a text of which there are very many copies is no hot key.
    """
    rows = measure(docs, part)
    known = rows.filter("doc_id IS NOT NULL")
    first = known.groupBy("text_sha").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text_sha", F.lit(False).alias("E"))
    one = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
    whole = known.join(first, ["doc_id", "text_sha"], "left").withColumn("E", F.coalesce("E", F.lit(True))).join(marks, "doc_id", "left")
    none = rows.filter("doc_id IS NULL").withColumn("E", F.lit(False)).withColumn("quality", F.lit(0)).withColumn("toxic", F.lit(0))
    every = whole.select(*(c := ["part", *FILTERS, "quality", "toxic"])).unionByName(none.select(*c))
    return every.groupBy("part", *FILTERS).agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """part, mask, kept, good, toxic: rows of each part that fail no filter of the subset `mask` (bit i: the i-th filter), for
    all 32 subsets of each part. A subset without survivors has no such row in the cube and counts 0."""
    cube = counts.cube(*FILTERS, "part").agg(*[F.sum(c).alias(c) for c in COUNTS], *[F.grouping(c).alias(f"g_{c}") for c in (*FILTERS, "part")])
    clean = [(F.col(f"g_{c}") == 1) | ~F.col(c) for c in FILTERS]  # not in the subset, or false
    mask = sum((1 - F.col(f"g_{c}")).cast("int") * F.lit(1 << i) for i, c in enumerate(FILTERS))
    found = cube.filter(F.col("g_part") == 0)
    for c in clean:
        found = found.filter(c)
    grid = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(FULL))).alias("mask"))
    return grid.join(found.select("part", mask.alias("mask"), *COUNTS), ["part", "mask"], "left").select("part", "mask", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS])


def steps(spark) -> DataFrame:
    """filter_order, step, filter (its bit), before, after: the 600 steps of all orders, as pairs of subsets."""
    rows = []
    for order in permutations(FILTERS):
        mask = 0
        for k, c in enumerate(order, 1):
            bit = 1 << FILTERS.index(c)
            rows.append(("".join(order), k, bit, mask, mask | bit))
            mask |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int, after int")


def filter_figures(alive: DataFrame) -> DataFrame:
    """part, filter, failed, unique_fails, shapley: what holds for a filter in every order. A pair of subsets that
    differ by the filter stands between the same documents in |S|! (4 - |S|)! orders."""
    last = len(FILTERS) - 1
    weights = [(bit, s, s | bit, factorial(bin(s).count("1")) * factorial(last - bin(s).count("1"))) for bit in (1 << i for i in range(len(FILTERS))) for s in range(FULL + 1) if not s & bit]
    pairs = F.broadcast(alive.sparkSession.createDataFrame(weights, "filter int, before int, after int, orders long"))  # 80 rows
    both = alive.select("part", F.col("mask").alias("before"), F.col("kept").alias("n")).join(pairs, "before").join(alive.select("part", F.col("mask").alias("after"), F.col("kept").alias("m")), ["part", "after"])
    gone = F.col("n") - F.col("m")
    alone = F.col("before") == F.lit(FULL) - F.col("filter")
    return both.groupBy("part", "filter").agg(F.sum(F.when(F.col("before") == 0, gone)).alias("failed"), F.sum(F.when(alone, gone)).alias("unique_fails"), F.sum(gone * F.col("orders")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """A row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = materialize(flag_counts(docs, labels, part), "audit-counts")
    alive = materialize(survivors(counts), "audit-survivors")
    before = alive.select("part", F.col("mask").alias("before"), *[F.col(c).alias(f"{c}_before") for c in COUNTS])
    after = alive.select("part", F.col("mask").alias("after"), *COUNTS)
    out = before.join(F.broadcast(steps(docs.sparkSession)), "before").join(after, ["part", "after"]).join(filter_figures(alive), ["part", "filter"])  # 600 steps
    removed = F.col("kept_before") - F.col("kept")
    return out.select(
        "part", "filter_order", "step", "kept", removed.alias("removed"), (F.col("failed") - removed).alias("redundant"), "unique_fails",
        (F.col("good_before") - F.col("good")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic")).alias("toxic_lost"), "shapley",
    )


# the same from the definition: each order is applied to the counted flags, filter by filter
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS caps, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * caps > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(first < doc_id, false)] AS f,
  coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, k::INT AS step, [ascii(o[j]) - 64 for j in range(1, 6)] AS p FROM o, range(1, 6) r(k)),
g AS (SELECT part, o, step, f[p[step]] AS fails, n, good, toxic, nullif(list_position([f[i] for i in p], true), 0) AS hit, len([1 for b in f if b]) AS failed FROM s, c),
r AS (SELECT part, o, step, coalesce(sum(n) FILTER (hit IS NULL OR hit > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit = step), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND hit < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND failed = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (hit = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit = step), 0)::BIGINT AS toxic_lost FROM g GROUP BY ALL)
SELECT part, o AS filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, o[step])::BIGINT AS shapley FROM r
"""
