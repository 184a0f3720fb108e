"""How functions change from release to release, and patch-state statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import version_key
from ..sources.scratch import written
from . import ranges

CHANGED_SHARE, CHANGED_BYTES, LEAST_NAMES = 0.05, 16, 20


def size_map(rows: DataFrame) -> DataFrame:
    """The greatest size of each name in a binary."""
    return rows.groupBy("version", "arch", "norm_name").agg(F.max("size").alias("size"))


def consecutive_versions(rows: DataFrame) -> DataFrame:
    """(old, new) of an architecture's versions in numeric order; a row a release."""
    found = rows.select("arch", "version").distinct()
    return found.select("arch", F.col("version").alias("old"), F.lead("version").over(Window.partitionBy("arch").orderBy(version_key(F.col("version")), "version")).alias("new")).filter("new IS NOT NULL")


def version_change(sizes: DataFrame) -> DataFrame:
    """arch, old, new, norm_name, sizes and the relative change of names in both."""
    steps = F.broadcast(consecutive_versions(sizes))
    a = sizes.select("arch", F.col("version").alias("old"), "norm_name", F.col("size").alias("old_size")).join(steps, ["arch", "old"])
    b = sizes.select("arch", F.col("version").alias("new"), "norm_name", F.col("size").alias("new_size"))
    out = a.join(b, ["arch", "new", "norm_name"]).withColumn("abs_change", F.abs(F.col("new_size") - F.col("old_size")))
    return out.withColumn("rel_change", F.col("abs_change") / F.greatest("new_size", "old_size", F.lit(1)))


def change_transfer_pairs(changes: DataFrame) -> DataFrame:
    """A name's change on one architecture beside its change on another, in the same step."""
    c = ["old", "new", "norm_name"]
    a = changes.select(*c, F.col("arch").alias("src_arch"), F.col("rel_change").alias("score"))
    b = changes.select(*c, F.col("arch").alias("dst_arch"), ((F.col("rel_change") >= CHANGED_SHARE) & (F.col("abs_change") >= CHANGED_BYTES)).cast("int").alias("label"))
    return a.join(b, c).filter("src_arch != dst_arch")


def ranked_quality(rows: DataFrame, by: list[str], name: str, task_rows: int | None = None) -> DataFrame:
    """AUC by average ranks and average precision (score down, name up) per group. rows: by, score, label, name, the last one total within
    a score. Equal scores are counted together first. A group with more than task_rows rows (ranges.MOST_ROWS) is cut into ranges of the
    order, so that no task holds it."""
    held = written(rows.select(*by, "score", "label", name), "ranked")
    cut = ranges.parts(ranges.sizes(held, *by), task_rows)
    scores = held.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("same"), F.sum("label").alias("hits"))
    scores = ranges.running(scores, by, ["score"], F.col("same"), "upto", cut)
    low = scores.groupBy(*by).agg(F.sum("same").alias("n"), F.sum("hits").alias("positives"), F.sum(F.col("hits") * (F.col("upto") - (F.col("same") - 1) / 2.0)).alias("ranks"))
    down = held.withColumn("_down", -F.col("score"))
    placed = ranges.running(down, by, ["_down", name], F.lit(1), "place", cut).filter("label = 1")
    found = ranges.running(placed, by, ["place"], F.lit(1), "found", cut)
    precisions = found.groupBy(*by).agg(F.sum(F.col("found") / F.col("place")).alias("precisions"))
    out = low.join(precisions, by, "left") if by else low.join(precisions)  # a row a group
    p, q = F.col("positives").cast("double"), (F.col("n") - F.col("positives")).cast("double")
    return out.withColumn("auc", F.when((p > 0) & (q > 0), (F.col("ranks") - p * (p + 1) / 2) / (p * q)).otherwise(0.0)).withColumn("average_precision", F.when(p > 0, F.col("precisions") / p).otherwise(0.0)).drop("ranks", "precisions")


def change_transfer(pairs: DataFrame, least: int = LEAST_NAMES) -> DataFrame:
    """Quality of one architecture's change as a score for another's, per step, with enough names and both labels."""
    return ranked_quality(pairs, ["old", "new", "src_arch", "dst_arch"], "norm_name").filter(f"n >= {least} AND positives > 0 AND positives < n")


def patch_probe(sizes: DataFrame, old: str, new: str, keyword: str) -> DataFrame:
    """Names with a keyword in two releases: appeared, removed, changed or unchanged."""
    s = sizes.filter(F.col("norm_name").contains(keyword))
    a = s.filter(F.col("version") == old).select("arch", "norm_name", F.col("size").alias("old_size"))
    b = s.filter(F.col("version") == new).select("arch", "norm_name", F.col("size").alias("new_size"))
    out = a.join(b, ["arch", "norm_name"], "full_outer")
    state = F.when(F.col("old_size").isNull(), "appeared").when(F.col("new_size").isNull(), "removed").when(F.col("old_size") != F.col("new_size"), "changed").otherwise("unchanged")
    delta = F.coalesce("new_size", F.lit(0)) - F.coalesce("old_size", F.lit(0))
    rel = F.when(state.isin("appeared", "removed"), 1.0).otherwise(F.abs(delta) / F.greatest("old_size", "new_size", F.lit(1)))
    return out.select("arch", "norm_name", "old_size", "new_size", state.alias("state"), delta.alias("delta"), rel.alias("rel_change"))


def nearest_centroid(rows: DataFrame, features: list[str]) -> DataFrame:
    """Leave one architecture out: standardise on the others, predict the label of the nearest centroid
    (ties: the smaller label). An architecture whose others have fewer than two labels gets no prediction. rows: version,
    arch, label, features; a row a binary, which is read once for each architecture."""
    held = rows.select(F.col("arch").alias("held")).distinct()
    folds = rows.filter("label IS NOT NULL").crossJoin(F.broadcast(held))  # a row an architecture
    train = folds.filter("arch != held")
    able = train.groupBy("held").agg(F.count_distinct("label").alias("labels")).filter("labels > 1")
    test = folds.filter("arch = held").join(F.broadcast(able), "held", "left_semi")
    long = lambda d: d.select("held", "version", "arch", "label", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("x")) for f in features])).alias("e")).select("held", "version", "arch", "label", "e.f", "e.x")
    t = long(train)
    scale = t.groupBy("held", "f").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).withColumn("s", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0))
    z = lambda d: d.join(F.broadcast(scale), ["held", "f"]).withColumn("z", (F.col("x") - F.col("m")) / F.col("s"))
    centre = z(t).groupBy("held", "f", F.col("label").alias("guess")).agg(F.avg("z").alias("c"))
    d = z(long(test)).join(F.broadcast(centre), ["held", "f"]).groupBy("held", "version", "arch", "label", "guess").agg(F.sum((F.col("z") - F.col("c")) * (F.col("z") - F.col("c"))).alias("d"))
    best = d.groupBy("held", "version", "arch", "label").agg(F.min(F.struct(F.round("d", 9).alias("d"), "guess")).alias("b"))
    return best.select("version", "arch", "label", F.col("b.guess").alias("predicted"))


def _over(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def classification_metrics(predicted: DataFrame, *by: str) -> DataFrame:
    """Counts, accuracy, precision, recall and F1; 0 where a denominator is 0."""
    n = lambda y, p: F.count_if((F.col("label") == y) & (F.col("predicted") == p))
    out = predicted.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    precision, recall = _over(tp, tp + fp), _over(tp, tp + fn)
    return out.withColumn("accuracy", _over(tp + tn, tp + tn + fp + fn)).withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", _over(2 * precision * recall, precision + recall))
