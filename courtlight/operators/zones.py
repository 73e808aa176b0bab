"""Time of players in the zones of the court, as shares of the time played."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtlight.functions import court

# fixed values: zones, the share of the time played that must be tracked, and metres of a good place at the line
ZONES = ("kitchen", "transition", "backcourt")
SUFFICIENT, REFERENCE_M = 0.3, 0.9
NEAR_LINE, FAR_LINE = court.NET - court.KITCHEN, court.NET + court.KITCHEN


def in_play(points: DataFrame, windows: DataFrame, width: float = 60.0) -> DataFrame:
    """points with a flag `played`: whether a half-open window (take, start, end) of their take holds their time.

    Windows may overlap and repeat. They meet points by bucket of time; a point is found once, by aggregation before
    the join brings it back, so no point is repeated.
    """
    cut = lambda t: F.floor(t / width)
    spread = windows.filter("end > start").select(F.col("take").alias("__take"), "start", "end", F.explode(F.sequence(cut(F.col("start")), cut(F.col("end")))).alias("__bucket"))
    at = points.filter("t IS NOT NULL").select("take", "t").distinct()
    held = at.join(spread, (F.col("take") == F.col("__take")) & (cut(F.col("t")) == F.col("__bucket")) & (F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")), "left_semi")
    held = held.select(F.col("take").alias("__take"), F.col("t").alias("__t"), F.lit(True).alias("__held"))
    return points.join(held, (F.col("take") == F.col("__take")) & (F.col("t") == F.col("__t")), "left").withColumn("played", F.coalesce("__held", F.lit(False))).drop("__take", "__t", "__held")


def _window_seconds(windows: DataFrame) -> DataFrame:
    return windows.groupBy(F.col("take").alias("__wtake")).agg(F.sum(F.greatest(F.lit(0.0), F.col("end") - F.col("start"))).alias("seconds"), F.count("*").alias("windows"))


def zone_stats(points: DataFrame, windows: DataFrame, reference_m: float = REFERENCE_M) -> DataFrame:
    """A row for each take and player: seconds and shares of each zone, time tracked, place at the line, feedback.

    points: take, player, t (seconds), seq (order of points of one time), x, y (feet). windows: take, start, end. Points
    without a time or place, and beyond the margin of the court, are none. A step's time belongs to the zone of its first
    point, if that was played; steps that begin off the court count as tracked alone. The time played is the sum of the
    take's windows; a take without windows was all played, from a player's first point to the last. own side is that of
    the upper median of y of played points, none on the net. Distances are to the kitchen line of that side, or to the
    nearer one. Null takes and players are ones of their own. A player's points of a take are one sort.
    """
    x, y, t = F.col("x"), F.col("y"), F.col("t")
    good = points.select("take", "player", F.col("t").cast("double").alias("t"), "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(court.visibility(x, y) != "dropped").filter("t IS NOT NULL")
    lasts = _window_seconds(windows)
    own = in_play(good, windows).join(lasts, F.col("take").eqNullSafe(F.col("__wtake")), "left").drop("__wtake")
    own = own.withColumn("played", F.col("played") | F.col("windows").isNull())
    order = W.partitionBy("take", "player").orderBy("t", "seq")
    steps = own.withColumn("step", F.greatest(F.lit(0.0), F.lead("t").over(order) - t))
    # the upper median: half of the played points lie before it
    ranked = W.partitionBy("take", "player", "played").orderBy("y")
    steps = steps.withColumns({"nth": F.row_number().over(ranked), "of": F.count("*").over(W.partitionBy("take", "player", "played"))})
    median = F.max(F.when(F.col("played") & (F.col("nth") == F.floor(F.col("of") / 2) + 1), y))
    counts = F.when(F.col("played"), F.coalesce("step", F.lit(0.0))).otherwise(0.0)
    on_court = F.when(court.in_bounds(x, y), counts).otherwise(0.0)
    far = lambda line: F.abs(y - line)
    total = lambda c, name: F.sum(c).alias(name)
    sums = steps.groupBy("take", "player").agg(
        F.first("seconds").alias("windows_s"),
        F.count("windows").alias("windowed"),
        (F.max("t") - F.min("t")).alias("span"),
        median.alias("median"),
        total(counts, "tracked"),
        total(on_court, "weight"),
        total(on_court * far(NEAR_LINE), "to_near"),
        total(on_court * far(FAR_LINE), "to_far"),
        total(on_court * F.least(far(NEAR_LINE), far(FAR_LINE)), "to_nearer"),
        *[total(F.when(court.band(y) == z, on_court).otherwise(0.0), z) for z in ZONES],
    )
    denominator = F.when(F.col("windowed") > 0, F.col("windows_s")).otherwise(F.col("span"))
    side = F.when(F.col("median") < court.NET, "near").when(F.col("median") > court.NET, "far")
    away = F.when(side == "near", F.col("to_near")).when(side == "far", F.col("to_far")).otherwise(F.col("to_nearer"))
    table = sums.withColumns({"denominator": denominator, "side": side, "metres": F.when(F.col("weight") > 0, away / F.col("weight") * court.METRES).otherwise(0.0)})
    share = lambda c: F.when(F.col("denominator") > 0, F.col(c) / F.col("denominator")).otherwise(0.0)
    control: Column = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share("kitchen")))
    enough = (F.col("denominator") > 0) & (F.col("tracked") / F.nullif(F.col("denominator"), F.lit(0.0)) >= SUFFICIENT)
    return table.select(
        "take",
        "player",
        F.round("denominator", 2).alias("played_s"),
        F.round("tracked", 2).alias("tracked_s"),
        F.when(enough, "sufficient").otherwise("insufficient").alias("data"),
        F.round(control, 4).alias("kitchen_share"),
        F.round("metres", 1).alias("to_line_m"),
        F.when(F.col("metres") <= reference_m, "near_line").when(F.col("metres") <= 1.5 * reference_m, "moderate").otherwise("deep").alias("feedback"),
        "side",
        *[F.round(z, 2).alias(f"{z}_s") for z in ZONES],
        *[F.round(share(z), 4).alias(f"{z}_occupancy") for z in ZONES],
    )
