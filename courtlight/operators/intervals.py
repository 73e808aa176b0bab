"""Intervals: pairing, merging, membership and time-aligned joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def paired(events: DataFrame) -> DataFrame:
    """Strict pairing in each take: a rally_end closes the first rally_start after the end before it."""
    order = W.partitionBy("take").orderBy("t_ms", "id")
    numbered = events.withColumn("turn", F.coalesce(F.sum(F.when(F.col("kind") == "rally_end", 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    start = F.min(F.when(F.col("kind") == "rally_start", F.col("t_ms")))
    end = F.max(F.when(F.col("kind") == "rally_end", F.col("t_ms")))
    return numbered.groupBy("take", "turn").agg(start.alias("start_ms"), end.alias("end_ms")).filter("start_ms IS NOT NULL AND end_ms IS NOT NULL").select("take", "start_ms", "end_ms")


def merged(intervals: DataFrame, by: str) -> DataFrame:
    """Overlapping or touching intervals of a key become one; empty and negative ones are ignored."""
    order = W.partitionBy(by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    own = intervals.filter(F.col("end") > F.col("start")).withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    numbered = own.withColumn("island", F.sum("new").over(order))
    return numbered.groupBy(by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def union_length(intervals: DataFrame, by: str) -> DataFrame:
    return merged(intervals, by).groupBy(by).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.count("*").alias("islands"))


def containing(points: DataFrame, intervals: DataFrame, by: str, bucket: int) -> DataFrame:
    """Points with the half-open intervals (start, end) of their key that hold them: an equi-join on buckets of time.

    An interval takes one row for each bucket it touches, a point one row, so no pair of a whole key is made.
    """
    spread = intervals.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket)))).filter("end > start")
    own = spread.select(F.col(by).alias("by2"), "start", "end", F.col("bucket").alias("bucket2"))
    keyed = points.withColumn("bucket", F.floor(F.col("t_ms") / bucket))
    return keyed.join(own, (F.col(by) == F.col("by2")) & (F.col("bucket") == F.col("bucket2")) & (F.col("t_ms") >= F.col("start")) & (F.col("t_ms") < F.col("end"))).drop("by2", "bucket", "bucket2")


def asof(left: DataFrame, right: DataFrame, by: str, time: str, value: str, forward: bool = False) -> DataFrame:
    """left with the time and value of the last row of right at or before it (forward: the first at or after it)."""
    both = left.withColumns({"__side": F.lit(1), "__at": F.lit(None).cast("struct<t:bigint,v:bigint>")}).unionByName(
        right.select(by, time, F.lit(0).alias("__side"), F.struct(F.col(time).cast("long").alias("t"), F.col(value).cast("long").alias("v")).alias("__at")), allowMissingColumns=True
    )
    order = [F.col(time).desc() if forward else F.col(time).asc(), "__side", F.col("__at.v").desc() if forward else F.col("__at.v").asc()]
    seen = F.last("__at", ignorenulls=True).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("__seen", seen).filter("__side = 1").select(*left.columns, F.col("__seen.t").alias("right_t"), F.col("__seen.v").alias("right_v"))


def nearest(left: DataFrame, right: DataFrame, by: str, time: str, value: str, tolerance: int) -> DataFrame:
    """left with the nearest row of right (the earlier one of a tie) and a status; null beyond the tolerance.

    Of rows of right at one time, the largest value counts at or before a row of left and the smallest behind it. Both
    sides are one table, sorted once. A key is one task's work; grid.aligned has the form in ranges of time.
    """
    at = F.struct(F.col(time).cast("long").alias("t"), F.col(value).cast("long").alias("v"))
    own = left.withColumns({"__side": F.lit(1), "__at": F.lit(None).cast("struct<t:bigint,v:bigint>")})
    both = own.unionByName(right.select(by, time, F.lit(0).alias("__side"), at.alias("__at")), allowMissingColumns=True)
    order = W.partitionBy(by).orderBy(time, "__side", "__at.v")
    past = F.last("__at", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    later = F.first("__at", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    seen = both.withColumns({"__past": past, "__later": later}).filter("__side = 1")
    first = F.col("__past").isNotNull() & (F.col("__later").isNull() | (F.col(time) - F.col("__past.t") <= F.col("__later.t") - F.col(time)))
    near = F.when(first, F.col("__past")).otherwise(F.col("__later"))
    apart = F.abs(near["t"] - F.col(time))
    ok = F.coalesce(apart <= tolerance, F.lit(False))
    return seen.select(*left.columns, F.when(ok, near["v"]).alias("match"), F.when(ok, apart).alias("delta_ms"), F.when(ok, "ok").otherwise("unavailable").alias("status"))
