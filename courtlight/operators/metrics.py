"""Statistics over groups: fits, robust thresholds, percentiles, classification quality, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clock_fit(pairs: DataFrame, by: str) -> DataFrame:
    """Least squares of b over a in each group: rate, offset, drift in parts per million; rate 1 where a does not vary."""
    n, sa, sb = F.count("*"), F.sum("a"), F.sum("b")
    sums = pairs.groupBy(by).agg(n.alias("n"), sa.alias("sa"), sb.alias("sb"), F.sum(F.col("a") * F.col("a")).alias("saa"), F.sum(F.col("a") * F.col("b")).alias("sab"))
    d = F.col("n") * F.col("saa") - F.col("sa") * F.col("sa")
    rate = F.when(d == 0, F.lit(1.0)).otherwise((F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")) / d)
    return sums.withColumn("rate", rate).select(by, "n", "rate", ((F.col("sb") - F.col("rate") * F.col("sa")) / F.col("n")).alias("offset"), ((F.col("rate") - 1) * 1e6).alias("drift_ppm"))


def nearest_rank(df: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """The value at rank ceil(n * p) of each group, from counts by value: rows of a group are counted before they move."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy(by).orderBy(value))
    own = counts.withColumns({"upto": upto, "all": F.sum("n").over(W.partitionBy(by))})
    return own.filter(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("all") * p))).groupBy(by).agg(F.min(value).alias("percentile"))


def robust_threshold(df: DataFrame, by: str, value: str, floor: float) -> DataFrame:
    """max(floor, median + 6 * max(median absolute deviation, 1))."""
    middle = df.groupBy(by).agg(F.median(value).alias("m")).withColumnRenamed(by, "__by")
    far = df.join(middle, F.col(by) == F.col("__by")).withColumn("far", F.abs(F.col(value) - F.col("m")))
    out = far.groupBy(by).agg(F.first("m").alias("median"), F.median("far").alias("mad"))
    return out.withColumn("threshold", F.greatest(F.lit(floor), F.col("median") + 6 * F.greatest(F.col("mad"), F.lit(1.0))))


def macro_f1(df: DataFrame, truth: str, predicted: str, classes: list[str]) -> DataFrame:
    """Counts and F1 of each fixed class, zero rows included, and their mean."""
    fixed = df.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    # as many rows as classes
    counts = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    joined = fixed.join(counts, (F.col("class") == F.col(truth)) | (F.col("class") == F.col(predicted)), "left")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    is_t, is_p = F.col("class") == F.col(truth), F.col("class") == F.col(predicted)
    out = joined.groupBy("class").agg(part(is_t & is_p).alias("tp"), part(~is_t & is_p).alias("fp"), part(is_t & ~is_p).alias("fn"))
    f1 = 2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1e-9))
    return out.withColumn("f1", f1).withColumn("macro_f1", F.avg("f1").over(W.partitionBy(F.lit(1))))


def mid_rank(df: DataFrame, by: str, value: str) -> DataFrame:
    """Empirical percentile with ties in the middle: (below + equal / 2) / n."""
    ties = df.groupBy(by, value).agg(F.count("*").alias("equal"))
    order = W.partitionBy(by).orderBy(value)
    below = F.coalesce(F.sum("equal").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ties.select(by, value, "equal", ((below + F.col("equal") / 2) / F.sum("equal").over(W.partitionBy(by))).alias("utility"))
