"""Trajectories: consecutive differences, lengths, speeds, dwell, smoothing, splitting."""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtlight.functions import court

from . import folds

ORDER = ["t_ms", "frame_index"]


def by_track():
    return W.partitionBy("track_id").orderBy(*ORDER)


def steps(points: DataFrame) -> DataFrame:
    """Each point with the distance and time from the one before in its track (null for the first)."""
    dx, dy = F.col("x_ft") - F.lag("x_ft").over(by_track()), F.col("y_ft") - F.lag("y_ft").over(by_track())
    return points.withColumns({"step_ft": F.sqrt(dx * dx + dy * dy), "step_ms": F.col("t_ms") - F.lag("t_ms").over(by_track())})


def path_length(points: DataFrame) -> DataFrame:
    return steps(points).groupBy("track_id").agg(F.count("*").alias("n_points"), F.coalesce(F.sum("step_ft"), F.lit(0.0)).alias("distance_ft"))


def speeds(points: DataFrame) -> DataFrame:
    """Unweighted mean and largest segment speed; segments without time are dropped, 0 where none is left."""
    speed = F.when(F.col("step_ms") > 0, F.col("step_ft") / (F.col("step_ms") / 1000))
    moved = steps(points).withColumn("speed", speed)
    return moved.groupBy("track_id").agg(F.count("speed").alias("segments"), F.coalesce(F.avg("speed"), F.lit(0.0)).alias("avg_fps"), F.coalesce(F.max("speed"), F.lit(0.0)).alias("max_fps"))


def kitchen_dwell(points: DataFrame) -> DataFrame:
    inside = court.in_kitchen(F.col("x_ft"), F.col("y_ft"))
    stay = F.greatest(F.lit(0), F.coalesce(F.lead("t_ms").over(by_track()) - F.col("t_ms"), F.lit(0)))
    marked = points.withColumns({"inside": inside, "stay": stay})
    return marked.groupBy("track_id").agg(F.count_if("inside").alias("frames"), F.coalesce(F.sum(F.when(F.col("inside"), F.col("stay"))), F.lit(0)).alias("dwell_ms"))


def own_side(points: DataFrame) -> DataFrame:
    """Near or far of the net by the upper median of y; null on the net."""
    ranked = points.withColumns({"rank": F.row_number().over(W.partitionBy("track_id").orderBy("y_ft", "frame_index")), "n": F.count("*").over(W.partitionBy("track_id"))})
    side = F.when(F.col("y_ft") < court.NET, "near").when(F.col("y_ft") > court.NET, "far")
    return ranked.filter(F.col("rank") == F.floor(F.col("n") / 2) + 1).select("track_id", F.col("y_ft").alias("median_y"), side.alias("side"))


def heatmap(points: DataFrame, rows: int = 11, columns: int = 5) -> DataFrame:
    """Counts by cell; points off the court are dropped."""
    cell = lambda v, size, n: F.least(F.lit(n - 1), F.floor(v / size * n)).cast("int")
    inside = points.filter(court.in_bounds(F.col("x_ft"), F.col("y_ft")))
    return inside.groupBy(cell(F.col("y_ft"), court.LENGTH, rows).alias("row"), cell(F.col("x_ft"), court.WIDTH, columns).alias("column")).agg(F.count("*").alias("n"))


def segments(points: DataFrame, max_gap_ms: int, max_jump_ft: float) -> DataFrame:
    """Gaps and islands: a new segment of a track where time or place jumps."""
    cut = (F.col("step_ms") > max_gap_ms) | (F.col("step_ft") > max_jump_ft)
    numbered = steps(points).withColumn("segment", F.sum(F.when(cut, 1).otherwise(0)).over(by_track()))
    return numbered.groupBy("track_id", "segment").agg(F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.count("*").alias("n_points"))


def spikes(points: DataFrame, threshold: float) -> DataFrame:
    """Points far from both neighbours while these are near each other."""
    near = lambda a, b: F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))
    here, back, ahead = [(f(F.col("x_ft")), f(F.col("y_ft"))) for f in (lambda c: c, lambda c: F.lag(c).over(by_track()), lambda c: F.lead(c).over(by_track()))]
    found = points.withColumn("spike", (near(here, back) > threshold) & (near(here, ahead) > threshold) & (near(back, ahead) < threshold))
    return found.filter("spike").select("track_id", "frame_index")


def _folded(points: DataFrame, start: Column, step, columns: list[str]) -> DataFrame:
    """A fold over each track's points in order; one track's points are the unit of work."""
    own = points.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct(*ORDER, *columns))).alias("points"))
    return own.select("track_id", F.aggregate("points", start, step).alias("state"))


def ewma(points: DataFrame, alpha: float = 0.45, max_fps: float = 30.0) -> DataFrame:
    """The last smoothed place of each track; a raw step faster than max_fps holds the value before it."""
    state = "struct<n:int,t:bigint,x:double,y:double,sx:double,sy:double,held:int>"
    start = F.lit(None).cast(state)

    def step(s: Column, p: Column) -> Column:
        dx, dy = p["x_ft"] - s["x"], p["y_ft"] - s["y"]
        held = F.sqrt(dx * dx + dy * dy) > F.greatest(p["t_ms"] - s["t"], F.lit(0)) / 1000 * max_fps
        mixed = lambda new, old: F.when(held, old).otherwise(alpha * new + (1 - alpha) * old)
        next_ = F.struct((s["n"] + 1).alias("n"), p["t_ms"].alias("t"), p["x_ft"].alias("x"), p["y_ft"].alias("y"), mixed(p["x_ft"], s["sx"]).alias("sx"), mixed(p["y_ft"], s["sy"]).alias("sy"), (s["held"] + held.cast("int")).alias("held"))
        first = F.struct(F.lit(1).alias("n"), p["t_ms"].alias("t"), p["x_ft"].alias("x"), p["y_ft"].alias("y"), p["x_ft"].alias("sx"), p["y_ft"].alias("sy"), F.lit(0).alias("held"))
        return F.when(s.isNull(), first).otherwise(next_).cast(state)

    return _folded(points, start, step, ["x_ft", "y_ft"]).select("track_id", F.col("state.n").alias("n"), F.col("state.sx").alias("x_smooth"), F.col("state.sy").alias("y_smooth"), F.col("state.held").alias("held"))


def suppressed(points: DataFrame, min_gap_ms: float) -> DataFrame:
    """Greedy suppression in time: the most confident first, each kept if no kept one of its track is within the gap.

    Ties go to the earlier point; a value that is no number comes first, a null one last. Points without a time stay and
    suppress nothing. A track is cut wherever its points are at least the gap apart, as what stands on either side can't
    suppress the other; a task reads the parts of its tracks one behind the other and holds one at a time.
    """
    part = F.sum(F.when(F.col("step") >= min_gap_ms, 1).otherwise(0)).over(by_track())
    own = points.select("track_id", *ORDER, F.col("value").cast("double").alias("value")).repartition("track_id")
    cut = own.withColumn("step", F.col("t_ms") - F.lag("t_ms").over(by_track())).withColumn("part", part)

    def kept(t: list, value: list) -> list[bool]:
        """Which points of a part stay; they come in order of time, so equal values keep that order."""
        rank = lambda i: (2,) if value[i] is None else (0,) if value[i] != value[i] else (1, -value[i])
        held: list = []
        stays = [True] * len(t)
        for i in sorted((i for i in range(len(t)) if t[i] is not None), key=rank):
            at = bisect.bisect_left(held, t[i])
            if (at and t[i] - held[at - 1] < min_gap_ms) or (at < len(held) and held[at] - t[i] < min_gap_ms):
                stays[i] = False
            else:
                held.insert(at, t[i])
        return stays

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in folds.whole_groups(batches, ["track_id", "part"]):
            t, value = batch["t_ms"].to_pylist(), batch["value"].to_pylist()
            stays: list[bool] = []
            for a, b in folds.bounds(batch, ["track_id", "part"]):
                stays += [True] if b == a + 1 else kept(t[a:b], value[a:b])
            yield batch.select(["track_id", "frame_index", "t_ms"]).filter(pa.array(stays, pa.bool_()))

    kinds = dict(points.select("track_id", "frame_index", "t_ms").dtypes)
    in_order = cut.select("track_id", "part", *ORDER, "value").sortWithinPartitions("track_id", *ORDER)
    return in_order.mapInArrow(keep, ", ".join(f"{k} {v}" for k, v in kinds.items()))
