"""Bounces of a ball's track: six features of a window around each point, weighted to a score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtlight.functions import court


@dataclass(frozen=True)
class Limits:
    """Frames a second, the window's points before and behind its centre, and what a bounce must reach or not exceed."""

    fps: float = 30.0
    before: int = 9
    behind: int = 10
    gap_s: float = 0.45
    least: float = 0.34
    fastest: float = 2500.0
    unsteady: float = 12.0
    margin_ft: float = 3.0

    @property
    def gap_frames(self) -> int:
        return max(1, int(self.gap_s * self.fps))


# fixed values: points of an arm and of the speed's neighbourhood on either side, pixels of an extreme, slopes of a
# reversal, what counts as a full angle, deviation, angle and deviation on the court, and the weights of the six features
ARM, NEAR, EXTREME_PX, SLOPE = 5, 4, 4.0, 0.05
FULL_ANGLE, FULL_DEVIATION, FULL_COURT_ANGLE, FULL_COURT_DEVIATION = 95.0, 18.0, 75.0, 1.8
WEIGHTS = {"angle": 0.28, "deviation": 0.24, "speed": 0.12, "reversal": 0.16, "extreme": 0.10, "court": 0.10}
TINY = 1e-6


def _angle(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Degrees between two vectors; zero if one of them is next to nothing."""
    size = F.sqrt(a[0] * a[0] + a[1] * a[1]) * F.sqrt(b[0] * b[0] + b[1] * b[1])
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (a[0] * b[0] + a[1] * b[1]) / size))
    return F.when(size > TINY, F.degrees(F.acos(cosine))).otherwise(0.0)


def _distance(p: tuple[Column, Column], a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """From a point to the line through two others; to the first of them if they are one."""
    line, to = (b[0] - a[0], b[1] - a[1]), (p[0] - a[0], p[1] - a[1])
    length = F.sqrt(line[0] * line[0] + line[1] * line[1])
    return F.when(length > TINY, F.abs(line[0] * to[1] - line[1] * to[0]) / length).otherwise(F.sqrt(to[0] * to[0] + to[1] * to[1]))


def _slope(values: Column, first: int, count: int) -> Column:
    """The slope of the line nearest to `count` values of an array from `first` on, one step apart."""
    mean = (count - 1) / 2
    weights = F.array(*[F.lit((i - mean) / sum((j - mean) ** 2 for j in range(count))) for i in range(count)])
    return F.aggregate(F.zip_with(F.slice(values, first + 1, count), weights, lambda v, w: v * w), F.lit(0.0), lambda s, x: s + x)


def scored(points: DataFrame, limits: Limits | None = None) -> DataFrame:
    """track, frame and the score of each point that may be a bounce, with what it comes from.

    points: track, frame, x, y (pixels), court_x, court_y (feet; null where unknown). A point is scored if its whole
    window is there, with places and speeds of all its points: one null in it and there is no row. A first point's speed
    is the second one's. Too fast or unsteady points, and those where y neither turns nor is extreme, score zero. The
    court counts only where the whole window has court places. Frames of a track differ; windows are counted in rows.
    """
    r = limits or Limits()
    order = W.partitionBy("track").orderBy("frame")
    rows = lambda a, b: order.rowsBetween(a, b)
    whole, arm_in, arm_out = rows(-r.before, r.behind), rows(-ARM, -1), rows(1, ARM)
    fields = ("x", "y", "court_x", "court_y")
    own = points.select("track", "frame", *[F.col(c).cast("double").alias(c) for c in fields])
    at = lambda c, n: F.lag(c, n).over(order) if n > 0 else F.lead(c, -n).over(order)
    own = own.withColumns({f"{c}_s": (at(c, 1) + 2 * F.col(c) + at(c, -1)) / 4 for c in fields})
    step = F.sqrt(F.pow(F.col("x") - at("x", 1), 2) + F.pow(F.col("y") - at("y", 1), 2)) * r.fps
    own = own.withColumns({"place": F.row_number().over(order), "step": step}).withColumn("v", F.when(F.col("place") == 1, at("step", -1)).otherwise(F.col("step")))
    own = own.withColumns({
        **{f"{c}_in": F.avg(f"{c}_s").over(arm_in) for c in fields},
        **{f"{c}_out": F.avg(f"{c}_s").over(arm_out) for c in fields},
        "n": F.count(F.struct("x").isNotNull()).over(whole),
        "places": F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).over(whole),
        "speeds": F.count("v").over(whole),
        "on_court": F.count(F.when(F.col("court_x").isNotNull() & F.col("court_y").isNotNull(), 1)).over(whole),
        "ys": F.collect_list("y").over(whole),
        "spread": F.sqrt((F.var_pop("x").over(whole) + F.var_pop("y").over(whole)) / 2),
        "v_peak": F.max("v").over(rows(-NEAR, NEAR)),
        "vs": F.array_sort(F.collect_list("v").over(rows(-NEAR, NEAR))),
        "y_top": F.max("y").over(rows(-ARM, ARM)),
        "y_low": F.min("y").over(rows(-ARM, ARM)),
    })
    size = r.before + 1 + r.behind
    own = own.filter((F.col("n") == size) & (F.col("places") == size) & (F.col("speeds") == size))
    pair = lambda a, b, end: (F.col(a + end), F.col(b + end))
    minus = lambda p, q: (p[0] - q[0], p[1] - q[1])

    def turns(a: str, b: str) -> tuple[Column, Column]:
        centre, come, go = (pair(a, b, e) for e in ("_s", "_in", "_out"))
        return _angle(minus(centre, come), minus(go, centre)), _distance(centre, come, go)

    turn, deviation = turns("x", "y")
    court_turn, court_deviation = turns("court_x", "court_y")
    scale = F.greatest("spread", F.lit(1.0))
    own = own.withColumns({
        "turn": turn,
        "deviation": deviation,
        "ratio": F.col("v_peak") / F.greatest(F.element_at("vs", NEAR + 1), F.lit(1.0)),
        "slope_in": _slope(F.col("ys"), 0, r.before + 1) / scale,
        "slope_out": _slope(F.col("ys"), r.before, r.behind + 1) / scale,
        "court_score": F.when(F.col("on_court") == size, F.greatest(F.least(F.lit(1.0), court_turn / FULL_COURT_ANGLE), F.least(F.lit(1.0), court_deviation / FULL_COURT_DEVIATION))).otherwise(0.0),
    })
    reversal = (F.col("slope_in") > SLOPE) & (F.col("slope_out") < -SLOPE)
    extreme = (F.col("y") >= F.col("y_top") - EXTREME_PX) | (F.col("y") <= F.col("y_low") + EXTREME_PX)
    features = {
        "angle": F.least(F.lit(1.0), F.col("turn") / FULL_ANGLE),
        "deviation": F.least(F.lit(1.0), F.col("deviation") / FULL_DEVIATION),
        "speed": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("ratio") - 1) / 2),
        "reversal": reversal.cast("double"),
        "extreme": extreme.cast("double"),
        "court": F.col("court_score"),
    }
    total = sum((F.lit(WEIGHTS[k]) * features[k] for k in list(WEIGHTS)[1:]), F.lit(WEIGHTS["angle"]) * features["angle"])
    unsteady = (F.col("v") > r.fastest) | (F.col("ratio") > r.unsteady)
    reason = F.when(unsteady, "unstable_velocity").when(~(reversal | extreme), "no_local_y_extreme")
    return own.select("track", "frame", "x", "y", "court_x", "court_y", F.when(reason.isNull(), total).otherwise(0.0).alias("score"), reason.alias("reason"), "turn", "deviation", "ratio", "slope_in", "slope_out")


def candidates(points: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Scored points that reach the least score and lie on the court or its margin, or nowhere on it that is known."""
    r = limits or Limits()
    x, y = F.col("court_x"), F.col("court_y")
    near = x.between(-r.margin_ft, court.WIDTH + r.margin_ft) & y.between(-r.margin_ft, court.LENGTH + r.margin_ft)
    return scored(points, r).filter((F.col("score") >= r.least) & (x.isNull() | y.isNull() | near))
