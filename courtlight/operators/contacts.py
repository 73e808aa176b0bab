"""Contacts of a ball's track: where its direction or speed breaks between two smooth arms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtlight.operators.evidence import finite

from . import tracks


@dataclass(frozen=True)
class Limits:
    """Points of an arm, what breaks a path, how smooth arms must be, and how close points and events may be in time."""

    arm: int = 4
    turn_deg: float = 35.0
    ratio: float = 1.8
    residual_px: float = 18.0
    fps: float = 30.0
    stride: int = 1
    gap_s: float = 0.12
    apart_s: float = 10.0 / 30.0

    @property
    def most_gap(self) -> float:
        return max(self.gap_s, 1.75 * max(1, self.stride) / self.fps)


# fixed values: full marks of the two parts of a score, their weights, and its least value
FULL_TURN, FULL_RATIO, WEIGHTS, LEAST_SCORE, TINY = 90.0, 1.5, (0.6, 0.4), 0.05, 1e-6


def _residual(prefix: str, n: int) -> Column:
    """Mean distance in y of an arm's points from the line nearest to them; from their mean where all lie above each other."""
    mx, my = F.col(f"{prefix}_x"), F.col(f"{prefix}_y")
    slope = F.when(F.col(f"{prefix}_xx") > 0, F.col(f"{prefix}_xy") / F.col(f"{prefix}_xx")).otherwise(0.0)
    return F.aggregate(f"{prefix}_points", F.lit(0.0), lambda s, p: s + F.abs((p["y"] - my) - slope * (p["x"] - mx))) / n


def scored(points: DataFrame, limits: Limits | None = None) -> DataFrame:
    """track, frame, t, confidence, status (hit_candidate or rejected_hit), turn, ratio, residuals of each break of a track.

    points: track, frame, t (seconds), x, y. Points without a finite place are none; a break has `arm` points on either
    side, all nine steps in time positive and at most the gap. It is one if the mean velocities before and behind turn by
    turn_deg or differ by ratio; rejected if an arm is not smooth. A track of fewer than two arms and two points has
    none. A null track is one of its own; of points of one time none is a break.
    """
    r = limits or Limits()
    good = points.select("track", "frame", F.col("t").cast("double").alias("t"), finite(F.col("x")).alias("x"), finite(F.col("y")).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND t IS NOT NULL")
    order = W.partitionBy("track").orderBy("frame")
    before, behind = order.rowsBetween(-r.arm, -1), order.rowsBetween(1, r.arm)
    gap = F.col("t") - F.lag("t").over(order)
    own = good.withColumns({"gap": gap, **{f"v{c}": (F.col(c) - F.lag(c).over(order)) / F.nullif(gap, F.lit(0.0)) for c in "xy"}, "n": F.count("*").over(W.partitionBy("track"))})
    context = order.rowsBetween(1 - r.arm, r.arm)
    arms = {"in": (before, order.rowsBetween(1 - r.arm, -1)), "out": (behind, order.rowsBetween(2, r.arm))}
    columns = {"least_gap": F.min("gap").over(context), "longest_gap": F.max("gap").over(context), "n_in": F.count("*").over(before), "n_out": F.count("*").over(behind)}
    for name, (arm, steps) in arms.items():
        columns |= {f"{name}_vx": F.avg("vx").over(steps), f"{name}_vy": F.avg("vy").over(steps), f"{name}_x": F.avg("x").over(arm), f"{name}_y": F.avg("y").over(arm), f"{name}_xx": F.var_pop("x").over(arm), f"{name}_xy": F.covar_pop("x", "y").over(arm), f"{name}_points": F.collect_list(F.struct("x", "y")).over(arm)}
    own = own.withColumns(columns).filter((F.col("n") >= 2 * r.arm + 2) & (F.col("n_in") == r.arm) & (F.col("n_out") == r.arm) & (F.col("least_gap") > 0) & (F.col("longest_gap") <= r.most_gap))
    speed = lambda a: F.hypot(F.col(f"{a}_vx"), F.col(f"{a}_vy"))
    size = speed("in") * speed("out")
    cosine = (F.col("in_vx") * F.col("out_vx") + F.col("in_vy") * F.col("out_vy")) / size
    turn = F.when(size > TINY, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))).otherwise(0.0)
    ratio = F.greatest(speed("in"), speed("out")) / F.greatest(F.least(speed("in"), speed("out")), F.lit(TINY))
    own = own.withColumns({"turn": turn, "ratio": ratio, "residual_in": _residual("in", r.arm), "residual_out": _residual("out", r.arm)})
    own = own.filter((F.col("turn") >= r.turn_deg) | (F.col("ratio") >= r.ratio))
    rough = F.greatest("residual_in", "residual_out") > r.residual_px
    score = WEIGHTS[0] * F.least(F.lit(1.0), F.col("turn") / FULL_TURN) + WEIGHTS[1] * F.least(F.lit(1.0), (F.col("ratio") - 1) / FULL_RATIO)
    return own.select("track", "frame", "t", F.when(rough, 0.0).otherwise(F.round(F.greatest(F.lit(LEAST_SCORE), score), 3)).alias("confidence"), F.when(rough, "rejected_hit").otherwise("hit_candidate").alias("status"), "turn", "ratio", "residual_in", "residual_out")


def contacts(points: DataFrame, limits: Limits | None = None) -> DataFrame:
    """scored, with confirmed_hit for the candidates that no better one of the track stands within apart_s of (ties: the earlier)."""
    r = limits or Limits()
    found = scored(points, r)
    named = found.filter("status = 'hit_candidate'").select(F.col("track").alias("track_id"), F.col("frame").alias("frame_index"), F.col("t").alias("t_ms"), F.col("confidence").alias("value"))
    kept = tracks.suppressed(named, r.apart_s).select(F.col("track_id").alias("__t"), F.col("frame_index").alias("__f"))
    both = found.join(kept, F.col("track").eqNullSafe(F.col("__t")) & (F.col("frame") == F.col("__f")), "left")
    return both.withColumn("status", F.when(F.col("__f").isNotNull(), "confirmed_hit").otherwise(F.col("status"))).drop("__t", "__f")
