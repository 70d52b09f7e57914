"""Evaluation metrics as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def percentile_ranks(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """``rows`` (id, v) with percentile, the share of ``reference`` (v) at or below each value.

    The reference becomes cumulative counts of its distinct values, cut into ranges of values by quantiles; rows and
    counts meet by range, so no task sees the whole of either side.
    """
    n = reference.count()
    cuts = sorted(set(reference.approxQuantile("v", [i / 64 for i in range(1, 64)], 0.005))) if n else []
    of = lambda c: F.aggregate(F.array(*[F.lit(float(x)) for x in cuts]), F.lit(0), lambda a, x: a + (x < c).cast("int")) if cuts else F.lit(0)
    counts = reference.groupBy("v").agg(F.count(F.lit(1)).alias("k")).withColumn("part", of(F.col("v")))
    sums = {r[0]: r[1] for r in counts.groupBy("part").agg(F.sum("k")).collect()}
    below, so_far = [], 0
    for part in range(len(cuts) + 1):
        below.append(so_far)
        so_far += sums.get(part, 0)
    both = counts.select("part", "v", F.col("k"), F.lit(None).cast("long").alias("id"), F.lit(0).alias("row")).unionByName(rows.select(of(F.col("v")).alias("part"), F.col("v"), F.lit(0).cast("long").alias("k"), F.col("id").cast("long").alias("id"), F.lit(1).alias("row")))
    running = F.sum("k").over(Window.partitionBy("part").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    base = F.element_at(F.array(*[F.lit(b).cast("long") for b in below]), F.col("part") + 1)
    return both.withColumn("upto", running + base).filter("row = 1").select("id", "v", (F.col("upto") / max(n, 1)).alias("percentile"))


def counts_from(rows: DataFrame) -> DataFrame:
    """(v, n): for each distinct value of ``rows`` (v double, w long), the sum of w over all rows of at least that value.

    Values are cut into ranges by quantiles; a range's running sum starts with the sums of the ranges above it.
    """
    per = rows.groupBy("v").agg(F.sum("w").alias("w"))
    cuts = sorted(set(per.approxQuantile("v", [i / 64 for i in range(1, 64)], 0.005)))
    part = F.aggregate(F.array(*[F.lit(float(x)) for x in cuts]), F.lit(0), lambda a, x: a + (x < F.col("v")).cast("int")) if cuts else F.lit(0)
    placed = per.withColumn("part", part)
    sums = dict(placed.groupBy("part").agg(F.sum("w")).collect())  # 64 rows at most
    above, so_far = {}, 0
    for p in sorted(sums, reverse=True):
        above[p] = so_far
        so_far += sums[p]
    base = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in above.items() for x in pair]), F.col("part").cast("long")) if above else F.lit(0)
    down = Window.partitionBy("part").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select("v", (F.sum("w").over(down) + base).alias("n"))


def detection(scored: DataFrame, threshold: float, k: int = 20) -> DataFrame:
    """One row of metrics of ``scored`` (id, score, label): precision at k, at a threshold, and average precision.

    Equal scores are one step of the curve; the curve is a table of distinct scores.
    """
    over = F.col("score") > threshold
    top = scored.orderBy(F.desc("score"), "id").limit(k).agg(F.sum("label").alias("top"))
    flat = scored.agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("positives"), F.count_if(over).alias("over"), F.sum(F.when(over, F.col("label"))).alias("hit"),
        F.count_if(over & (F.col("label") == 0)).alias("wrong"), F.count_if(F.col("label") == 0).alias("negatives"))
    values = scored.select(F.col("score").cast("double").alias("v"), F.col("label").cast("long").alias("label"))
    upto = counts_from(values.select("v", F.lit(1).cast("long").alias("w"))).join(counts_from(values.select("v", F.col("label").alias("w"))).withColumnRenamed("n", "hits"), "v")
    steps = values.groupBy("v").agg(F.sum("label").alias("tp")).join(upto, "v")
    curve = steps.select("tp", (F.col("tp") * F.col("hits") / F.col("n")).alias("part")).agg((F.sum("part") / F.greatest(F.lit(1), F.sum("tp"))).alias("ap"))
    one = F.lit(1).alias("one")
    row = flat.select("*", one).join(top.select("*", one), "one").join(curve.select("*", one), "one")
    r = lambda c: F.round(c, 9)
    return row.select(
        "n", "positives", r(F.col("top") / k).alias("p_at_20"), r(F.col("hit") / F.greatest(F.lit(1), "over")).alias("precision"), r(F.col("hit") / F.greatest(F.lit(1), "positives")).alias("recall"),
        r(F.col("wrong") / F.greatest(F.lit(1), "negatives")).alias("fpr"), r("ap").alias("average_precision"))


def reliability(rows: DataFrame, bins: int = 5) -> DataFrame:
    """Per bin of p: n, mean_predicted, observed and brier of ``rows`` (p, y); the last bin is closed."""
    bin_of = F.least(F.floor(F.col("p") * bins / 1.0 if bins == 1 else F.col("p") / F.lit(1.0 / bins)), F.lit(bins - 1)).cast("int")
    return rows.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_predicted"), F.round(F.avg("y"), 6).alias("observed"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 6).alias("brier"))


def by_scenario(scored: DataFrame, threshold: float) -> DataFrame:
    """Metrics for each scenario of ``scored`` (id, score, label, scenario): its positives with all benign rows, or a benign scenario alone."""
    over = F.col("score") > threshold
    benign = scored.filter("label = 0")
    wrong = benign.agg(F.count_if(over).alias("benign_over"), F.count(F.lit(1)).alias("benign")).withColumn("one", F.lit(1))
    own = scored.groupBy("scenario", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(over).alias("over")).withColumn("one", F.lit(1))
    positive = F.col("label") == 1
    return own.join(wrong, "one").select(
        "scenario", "label", "n", F.when(positive, F.col("over") / F.col("n")).alias("recall"), F.when(positive, F.col("over") / F.greatest(F.lit(1), F.col("over") + F.col("benign_over"))).alias("precision"),
        F.when(~positive, F.col("over") / F.col("n")).alias("fpr"))
