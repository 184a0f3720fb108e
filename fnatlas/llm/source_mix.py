"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Targets: sources in code-point order (null last) get the weights 3, 1, 2, repeating, and share
a budget of tokens; a target stops at `most` times its source's size, and what is over is
shared again by weight until no target is above.

Rates: of all rates r of a source's documents with 0 <= r <= most whose expected tokens
equal the target, entropy balancing takes those nearest to 1 in relative entropy:
r = min(most, exp(lambda * x)), x being the document's size over its source's mean size.
The dual is convex with one lambda a source; Newton steps for all sources at once, held
inside brackets, solve it. Each step is one aggregation of the table of distinct (source,
size) pairs, which is made once, with partial sums before its shuffle.

Copies: each document's rate and a hash of its doc_id give the level at which it gains its
next copy. Per source one level is chosen so that the copies' tokens come nearest to
the target from below, by two rounds of histograms of levels. Nothing is random: reruns agree.

Null and empty texts have size 0 and copies 0; texts of any length are counted whole. Rows with a null doc_id and
repeated rows are documents of their own: equal rows have one rate, and of those that differ in their last copy it isn't
told which is which. Empty tables give empty results. Of other columns only source is read; take() keeps them, whatever
their names, but for its own two, copies and taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, join_dimension, materialize

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MOST = 2
#: Newton stops when all sources are this near their targets, relatively, or after STEPS.
NEAR = 1e-6
STEPS = 40
BINS = 1024
#: Rounds in which each source may gain or lose one copy to come nearer to its target.
FITTED = 2


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """source, source_size, docs, target. sizes: source, size, docs (documents of that size)."""
    by_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).cast("long").alias("source_size"), F.sum("docs").alias("docs"))
    # a rank without one task for all: ranges, then offsets of ranges
    ranged = materialize(by_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    per_part = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("source").alias("top"), F.max(F.col("source").isNull()).alias("last"))
    offsets = per_part.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("last", "top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    rank = ranged.withColumn("inside", inside).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("inside") - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    placed = materialize(rank.select("source", "source_size", "docs", weight.alias("weight")), "ranked")

    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # at most as many rounds as there are sources; each caps at least one more
        above = F.col("weight") * F.lit(level) >= F.lit(float(most)) * F.col("source_size")
        n, fixed, open_weight = placed.agg(F.count_if(above), F.sum(F.when(above, most * F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (budget * total - (fixed or 0)) / open_weight
    target = F.least(F.col("weight") * F.lit(level), F.lit(float(most)) * F.col("source_size")) if open_weight else F.lit(float(most)) * F.col("source_size")
    return placed.withColumn("target", target).drop("weight")


def _tilted(x: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.col("lam") * x))


def balance(sizes: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, target, mean, lam: the duals. Sources at their cap have lam null: all rates are most."""
    mean = F.col("source_size") / F.greatest(F.lit(1), F.col("docs"))
    state = targets.withColumn("mean", F.when(mean > 0, mean).otherwise(1.0))
    full = F.col("target") >= F.lit(float(most) * (1 - 1e-12)) * F.col("source_size")
    state = state.withColumn("lam", F.when(~full, F.lit(0.0))).withColumn("low", F.lit(-745.0)).withColumn("high", F.lit(745.0)).withColumn("off", F.lit(1.0))
    n = targets.count()
    for _ in range(STEPS):
        state = materialize(state, "duals")
        if not state.filter(F.col("lam").isNotNull() & (F.abs("off") > NEAR)).count():
            break
        x = F.col("size") / F.col("mean")
        joined = join_dimension(sizes.filter("size > 0"), state.filter("lam IS NOT NULL").select("source", "mean", "lam"), "source", "inner", rows=n, spread=F.xxhash64("size"))
        tokens, r = F.col("size") * F.col("docs"), _tilted(x, most)
        sums = joined.groupBy(F.col("source").alias("of")).agg(F.sum(tokens * r).alias("made"), F.sum(F.when(r < most, tokens * r * x).otherwise(0.0)).alias("slope"))
        state = state.join(sums, F.col("source").eqNullSafe(F.col("of")) & F.col("made").isNotNull(), "left")
        gap = F.col("made") - F.col("target")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        step = F.when(F.col("lam").isNull() | gap.isNull(), F.col("lam")).when(inside, newton).otherwise((low + high) / 2)
        # a zero bracket end means a step went nowhere: halve towards it geometrically from both sides
        state = state.select("source", "source_size", "docs", "target", "mean", step.alias("lam"), F.coalesce(low, "low").alias("low"), F.coalesce(high, "high").alias("high"), F.coalesce(gap / F.greatest(F.lit(1.0), F.col("target")), F.lit(0.0)).alias("off"))
    return state.select("source", "source_size", "target", "mean", "lam")


def _chosen_level(steps: DataFrame, duals: DataFrame, n: int) -> DataFrame:
    """source, level: the copies whose step is at most level take the tokens nearest to the
    target. steps: source, step (0 to 1), size, with size > 0. Three histograms, each inside one bin of the last."""
    state = duals.select("source", F.lit(0.0).alias("from"), F.lit(1.0).alias("width"), F.col("target").alias("left"))
    for last in (False, False, True):
        state = materialize(state.withColumn("width", F.col("width") / BINS), "levels")
        joined = join_dimension(steps, state, "source", "inner", rows=n, spread=F.xxhash64("step"))
        at = F.floor((F.col("step") - F.col("from")) / F.col("width"))
        bins = joined.withColumn("bin", at).filter(f"bin >= 0 AND bin < {BINS}").groupBy("source", "bin").agg(F.sum("size").alias("tokens"), F.first("left").alias("left"))
        running = F.sum("tokens").over(Window.partitionBy("source").orderBy("bin"))  # at most BINS rows a source
        over = bins.withColumn("running", running).withColumn("before", F.col("running") - F.col("tokens"))
        # the bin that passes the target: the next round looks inside it; after the last it is taken whole if that is nearer
        past = (F.col("running") - F.col("left") < F.col("left") - F.col("before")).cast("int") if last else F.lit(0)
        stop = over.filter(F.col("running") > F.col("left")).groupBy(F.col("source").alias("of")).agg(F.min(F.struct("bin", "before", past.alias("past"))).alias("stop"))
        state = state.join(stop, F.col("source").eqNullSafe(F.col("of")), "left")
        state = state.select("source", (F.col("from") + F.coalesce(F.col("stop.bin") + F.col("stop.past"), F.lit(BINS)) * F.col("width")).alias("from"), F.when(F.col("stop").isNull(), 0.0).otherwise(F.col("width")).alias("width"), (F.col("left") - F.coalesce(F.col("stop.before"), F.lit(0))).alias("left"))
        state = state.withColumn("width", F.greatest("width", F.lit(1e-300)))
    return materialize(state.select("source", F.col("from").alias("level")), "levels")


def _fitted(placed: DataFrame, n: int, most: int) -> DataFrame:
    """placed with one copy more or less of one document of each source, where that brings it nearer to its target."""
    made = placed.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("made"), F.first("target").alias("target"))
    gap = made.select("source", (F.col("target") - F.col("made")).alias("gap"))
    tried = join_dimension(placed.filter("size > 0 AND lam IS NOT NULL").select("source", "uid", "size", "copies", "chance"), gap, "source", "inner", rows=n, spread=F.col("uid"))
    room = F.when(F.col("gap") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    missed = F.abs(F.abs("gap") - F.col("size"))
    best = tried.filter(room & (missed < F.abs("gap"))).groupBy("source").agg(F.min(F.struct(missed.alias("missed"), "chance", "uid", F.signum("gap").cast("int").alias("step"))).alias("best"))
    best = materialize(best.select(F.col("best.uid").alias("uid"), F.col("best.step").alias("step")), "fitted")
    small = F.broadcast(best) if n <= BROADCAST_ROWS else best
    return placed.join(small, "uid", "left").withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0))).drop("step")


def _placed(rows: DataFrame, weights: tuple[float, ...], budget: float, most: int) -> DataFrame:
    """uid, doc_id, source, size, source_size, target, rate, copies, taken of every row. rows (a written table): uid, doc_id, source, size."""
    sizes = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "counts")
    duals = materialize(balance(sizes, source_targets(sizes, weights, budget, most), most), "balanced")
    n = duals.count()
    rated = join_dimension(rows, duals, "source", spread=F.xxhash64("uid"), rows=n)
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("lam").isNull(), float(most)).otherwise(_tilted(F.col("size") / F.col("mean"), most))
    rated = rated.withColumn("rate", rate).withColumn("chance", F.pmod(F.xxhash64("doc_id", "size"), F.lit(1 << 52)) / F.lit(float(1 << 52)))
    # copy c (1 .. most) comes at the level c - 1 + chance - rate, scaled from (-most, most] to (0, 1]
    step = lambda c: (c - F.lit(1.0) + F.col("chance") - F.col("rate") + most) / (2.0 * most)
    steps = rated.filter("size > 0 AND lam IS NOT NULL").select("source", "size", F.explode(F.array(*[step(F.lit(float(c))) for c in range(1, most + 1)])).alias("step"))
    levels = _chosen_level(steps, duals, n)
    placed = join_dimension(rated, levels, "source", spread=F.xxhash64("uid"), rows=n)
    copies = sum(((step(F.lit(float(c))) < F.col("level")).cast("int") for c in range(1, most + 1)), F.lit(0))
    copies = F.when(F.col("size") == 0, 0).when(F.col("lam").isNull(), most).otherwise(copies)
    out = placed.withColumn("copies", F.coalesce(copies, F.lit(0)).cast("int")).drop("level")
    for _ in range(FITTED):
        out = _fitted(materialize(out, "copies"), n, most)
    return out.select("uid", "doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def _rows(docs: DataFrame) -> list[Column]:
    return [F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_size(F.col("text").cast("string")).alias("size")]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken of every row."""
    return _placed(materialize(docs.select(*_rows(docs)), "sizes"), weights, budget, most).drop("uid")


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """docs that the mix takes, with copies and taken. Rows are written once with a number each, by which their copies come back."""
    rows = materialize(docs.select(F.struct(*[c for c in docs.columns if c not in ("copies", "taken")]).alias("row"), *_rows(docs)), "numbered")
    found = _placed(rows.select("uid", "doc_id", "source", "size"), weights, budget, most).filter("copies > 0")
    return rows.select("uid", "row").join(found.select("uid", "copies", "taken"), "uid").select("row.*", "copies", "taken")
