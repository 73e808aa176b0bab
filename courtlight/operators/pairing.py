"""Two cameras on one time line: a plan that pairs frames once, and the timeline of both under one orientation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtlight.functions import court

from . import grid

#: Seconds of a range of time that one task searches.
WIDTH_S = 600.0


def frame_times(observations: DataFrame) -> DataFrame:
    """take, frame, t of each frame: the smallest time that one of its observations has. Null takes, frames and times give none."""
    return observations.filter("take IS NOT NULL AND frame IS NOT NULL AND t IS NOT NULL").groupBy("take", "frame").agg(F.min(F.col("t").cast("double")).alias("t"))


def plan(reference: DataFrame, secondary: DataFrame, clocks: DataFrame, tolerance_s: float = 1 / 30, width: float = WIDTH_S) -> DataFrame:
    """take, frame, t, secondary_frame, secondary_t, mapped_t, error_ms, status of each reference frame.

    reference, secondary: take, frame, t (seconds). clocks: take, offset, rate, valid_from, valid_to (null: unbounded), one
    row a take. A frame's time on the other clock is offset + rate * t; the nearest secondary frame counts, the earlier
    of two. status is the first that holds: unavailable (no clock, or no secondary frame), outside the valid interval,
    outside the recording, too far from any frame (the error stays), non_monotonic (the frame is below one that an
    earlier reference frame got: nothing stays), ok. Each take's plan is one order of its frames; the search for the
    nearest goes by ranges of time.
    """
    frames = frame_times(secondary)
    media = frames.groupBy(F.col("take").alias("__take")).agg(F.min("t").alias("from_t"), F.max("t").alias("to_t"))
    own = frame_times(reference).join(clocks.withColumnRenamed("take", "__clock"), F.col("take") == F.col("__clock"), "left").join(media, F.col("take") == F.col("__take"), "left").drop("__take")
    own = own.withColumn("mapped", F.col("offset") + F.col("rate") * F.col("t"))
    # a frame without a place on the other clock is unavailable whatever is near: its own time spreads those over ranges
    found = own.select(F.col("take").alias("key"), F.coalesce("mapped", "t").alias("t_ms"), "frame", "t", "mapped", "valid_from", "valid_to", "from_t", "to_t")
    candidates = frames.select(F.col("take").alias("key"), F.col("t").alias("t_ms"), F.col("frame").alias("seq"), F.struct("frame", "t").alias("value"))
    found = grid.aligned(found, {"near": (candidates, float("inf"))}, width)
    error = F.col("near.t") - F.col("mapped")
    status = (
        F.when(F.col("mapped").isNull() | F.col("from_t").isNull(), "unavailable")
        .when((F.col("t") < F.col("valid_from")) | (F.col("t") > F.col("valid_to")), "unavailable_outside_valid_interval")
        .when((F.col("mapped") < F.col("from_t")) | (F.col("mapped") > F.col("to_t")), "unavailable_out_of_media_range")
        .when(F.abs(error) > tolerance_s, "unavailable_selection_error")
        .otherwise("ok")
    )
    told = found.withColumns({"status": status, "error": error})
    ok = F.col("status") == "ok"
    reached = F.max(F.when(ok, F.col("near.frame"))).over(W.partitionBy("key").orderBy("t", "frame").rowsBetween(W.unboundedPreceding, -1))
    told = told.withColumn("back", ok & F.coalesce(F.col("near.frame") < reached, F.lit(False)))
    paired = ok & ~F.col("back")
    tried = F.col("status").isin("ok", "unavailable_selection_error") & ~F.col("back")
    return told.select(
        F.col("key").alias("take"),
        "frame",
        "t",
        F.when(paired, F.col("near.frame")).alias("secondary_frame"),
        F.when(paired, F.col("near.t")).alias("secondary_t"),
        F.col("mapped").alias("mapped_t"),
        F.when(tried, F.col("error") * 1000).alias("error_ms"),
        F.when(F.col("back"), "non_monotonic").otherwise(F.col("status")).alias("status"),
    )


def timeline(reference: DataFrame, secondary: DataFrame, planned: DataFrame, orientation: dict[str, str]) -> DataFrame:
    """Every reference observation in canonical feet, with what the other camera saw in the frame that the plan pairs.

    Observations: take, frame, t, player, x, y (feet as the camera sees the court). orientation names how each of
    reference and secondary lies; an unknown one is an error. Of several players of a paired frame the first by name
    counts. Reference rows stay, whatever is missing: view_status is then unavailable and all of the other side is null.
    """
    missing = {k for k in ("reference", "secondary") if orientation.get(k) not in ("identity", "rotate_180", "mirror_x", "mirror_y")}
    if missing:
        raise ValueError(f"no orientation of {sorted(missing)}")
    placed = lambda df, how: df.withColumn("p", court.oriented(F.col("x").cast("double"), F.col("y").cast("double"), F.lit(how)))
    own = placed(reference, orientation["reference"]).select("take", "frame", "t", "player", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    other = placed(secondary, orientation["secondary"]).groupBy(F.col("take").alias("__t"), F.col("frame").alias("__f")).agg(F.min(F.struct(F.col("player").isNull(), "player", "t", "p.x", "p.y")).alias("seen"))
    pairs = planned.filter("status = 'ok'").select(F.col("take").alias("__pt"), F.col("frame").alias("__pf"), "secondary_frame", "error_ms")
    both = own.join(pairs, (F.col("take") == F.col("__pt")) & (F.col("frame") == F.col("__pf")), "left").join(other, (F.col("take") == F.col("__t")) & (F.col("secondary_frame") == F.col("__f")), "left")
    there = F.col("seen").isNotNull()
    told = lambda c: F.when(there, F.col(c))
    return both.select("take", "frame", "t", "player", "x", "y", F.when(there, "available").otherwise("unavailable").alias("view_status"), told("secondary_frame").alias("other_frame"), told("seen.player").alias("other_player"), told("seen.x").alias("other_x"), told("seen.y").alias("other_y"), told("error_ms").alias("error_ms"))
