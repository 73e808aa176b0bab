"""Column functions of camera evidence: projection, boxes, quality gates, view quality, fusion weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: limits of a ball candidate
LEAST_CONFIDENCE, LEAST_BOX, MOST_AREA, MOST_ASPECT, COURT_MARGIN = 0.22, 2.0, 0.004, 4.0, 2.0
# fixed values: weights of a view's features (detector, box, projection, foot point, tracking)
FEATURE_WEIGHTS = (0.3, 0.3, 0.2, 0.1, 0.1)
CONFLICT_FT, PREDICTION_FLOOR = 3.0, 0.2


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def projected(h: list[float], x: Column, y: Column) -> Column:
    """x, y through a 3 x 3 homography (nine numbers by rows); null where the third coordinate vanishes."""
    w = h[6] * x + h[7] * y + h[8]
    point = F.struct(((h[0] * x + h[1] * y + h[2]) / w).alias("x"), ((h[3] * x + h[4] * y + h[5]) / w).alias("y"))
    return F.when(F.abs(w) > 1e-12, point)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (left, top, right, bottom); 0 where the union is empty."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: F.greatest(F.lit(0.0), r[2] - r[0]) * F.greatest(F.lit(0.0), r[3] - r[1])
    union = area(a) + area(b) - wide * high
    return F.when(union > 0, wide * high / union).otherwise(0.0)


def candidate_verdict(confidence: Column, width: Column, height: Column, frame_area: float, in_roi: Column, x: Column, y: Column, projects: Column) -> Column:
    """status and reason of a ball candidate: the first rule that it breaks. Null sizes and places break none."""
    aspect = F.greatest(width / height, height / width)
    off = ~(x.between(-COURT_MARGIN, 20 + COURT_MARGIN) & y.between(-COURT_MARGIN, 44 + COURT_MARGIN))
    rules = [
        (confidence.isNull() | F.isnan(confidence) | (confidence < LEAST_CONFIDENCE), "rejected", "low_confidence"),
        ((width < LEAST_BOX) | (height < LEAST_BOX), "rejected", "box_too_small"),
        (width * height / frame_area > MOST_AREA, "rejected", "box_too_large"),
        (aspect > MOST_ASPECT, "rejected", "aspect_ratio"),
        (~in_roi, "rejected", "outside_roi"),
        (~projects, "diagnostic_only", "invalid_court_projection"),
        (off, "rejected", "outside_court_projection"),
    ]
    out = F.struct(F.lit("accepted").alias("status"), F.lit("accepted").alias("reason"))
    for broken, status, reason in rules[::-1]:
        out = F.when(broken, F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def view_quality(scores: list[Column], interpolated: Column, warned: Column, sync_error_s: Column) -> Column:
    """Weighted mean of a view's scores (null: not there, its weight is not counted), less for weak evidence."""
    held = [F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in zip(scores, FEATURE_WEIGHTS, strict=True)]
    parts = [F.when(s.isNotNull(), clamp01(s) * w).otherwise(0.0) for s, w in zip(scores, FEATURE_WEIGHTS, strict=True)]
    mean = sum(parts[1:], parts[0]) / sum(held[1:], held[0])
    late = F.coalesce(sync_error_s > 1 / 30, F.lit(False))
    return clamp01(mean * F.when(interpolated, 0.2).otherwise(1.0) * F.when(warned, 0.85).otherwise(1.0) * F.when(late, 0.6).otherwise(1.0))


def fusion_weights(a: Column, b: Column, consistency: Column, degraded: Column) -> Column:
    """Weights of two views, summing to one: the better one gains where they disagree or their clocks are uncertain."""
    tilt = F.when(consistency < 0.5, 0.5 - consistency).otherwise(0.0)
    first = a > b
    x, y = a * F.when(first, 1 + tilt).otherwise(1 - tilt), b * F.when(first, 1 - tilt).otherwise(1 + tilt)
    ahead = x > y
    u = F.when(degraded & ahead, F.greatest(x, F.lit(0.55))).when(degraded, F.least(x, F.lit(0.45))).otherwise(x)
    v = F.when(degraded & ahead, F.least(y, F.lit(0.45))).when(degraded, F.greatest(y, F.lit(0.55))).otherwise(y)
    even = ((a <= 0) & (b <= 0)) | (u + v <= 0)
    return F.when(even, 0.5).otherwise(u / (u + v))


def fused(ax: Column, ay: Column, bx: Column, by: Column, qa: Column, qb: Column, px: Column, py: Column) -> Column:
    """One player's place from two views (null: not seen), their qualities, and a prediction (may be null).

    Seen by both within CONFLICT_FT: the weighted mean. Farther apart: the better view, the first of equal ones, or the
    prediction if neither is above PREDICTION_FLOOR. Seen by one: that one. Seen by none: null.
    """
    both, a_only, b_only = ax.isNotNull() & bx.isNotNull(), ax.isNotNull(), bx.isNotNull()
    far = F.hypot(ax - bx, ay - by)
    consistency = clamp01(1 - far / CONFLICT_FT)
    wa = fusion_weights(qa, qb, consistency, F.lit(False))
    top = F.greatest(qa, qb)
    place = lambda x, y, status, confidence, view, eligible: F.struct(x.alias("x"), y.alias("y"), F.lit(status).alias("status"), confidence.alias("confidence"), F.lit(view).cast("string").alias("view"), F.lit(eligible).alias("eligible"))
    unsure = px.isNotNull() & (qa < PREDICTION_FLOOR) & (qb < PREDICTION_FLOOR)
    return (
        F.when(both & (far <= CONFLICT_FT), place(wa * ax + (1 - wa) * bx, wa * ay + (1 - wa) * by, "dual_observed", F.least(consistency, top), None, True))
        .when(both & unsure, place(px, py, "conflict", top * 0.3, "prediction", False))
        .when(both & (qa >= qb), place(ax, ay, "conflict", top * 0.3, "reference", True))
        .when(both, place(bx, by, "conflict", top * 0.3, "secondary", True))
        .when(a_only, place(ax, ay, "single_view_fallback", qa, "reference", True))
        .when(b_only, place(bx, by, "single_view_fallback", qb, "secondary", True))
    )


def chi_square(a: Column, b: Column) -> Column:
    """Half chi-square of two histograms over their size, times 8, at most 1; null where sizes differ."""
    terms = F.zip_with(a, b, lambda x, y: (x - y) * (x - y) / (x + y + 1e-6))
    return F.when(F.size(a) == F.size(b), F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2 / F.size(a) * 8))
