"""Matches: scoring, states of play, shots and their owners, effective times, pairing plans, editing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import merged


def play_states(windows: DataFrame, enter: float = 0.75, stay: float = 0.55, sure: float = 0.65, coverage: float = 0.75, least_ms: int = 500) -> DataFrame:
    """State of each window (key, center_ms, p, q, coverage): rally_active, non_play or unknown.

    p and q are the probabilities of play and of none. Play begins at `enter` and lasts while p is at least `stay`; thin
    coverage ends it. Outside play a window is unknown where neither probability is `sure`. Runs of play shorter than
    `least_ms`, with the key's smallest step added, become non_play. No window of a key is gathered: what a window leaves
    behind is decided by itself or is what the last decided one left.
    """
    order = W.partitionBy("key").orderBy("center_ms")
    covered = F.coalesce(F.col("coverage") >= coverage, F.lit(False))
    decided = F.when(~covered | (F.col("p") < stay), False).when(F.col("p") >= enter, True)
    latched = F.coalesce(F.last(decided, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(False))
    step = F.col("center_ms") - F.lag("center_ms").over(order)
    own = windows.withColumns({"on": latched, "step": step})
    before = F.coalesce(F.lag("on").over(order), F.lit(False))
    state = F.when(~covered, "unknown").when(F.col("on"), "rally_active").when(before | (F.greatest("p", "q") >= sure), "non_play").otherwise("unknown")
    own = own.withColumns({"state": state, "before": before, "least": F.coalesce(F.min(F.when(F.col("step") > 0, F.col("step"))).over(W.partitionBy("key")), F.lit(500))})
    active = F.col("state") == "rally_active"
    own = own.withColumn("run", F.sum(F.when(active, 0).otherwise(1)).over(order))
    spans = own.filter(active).groupBy(F.col("key").alias("k"), F.col("run").alias("r")).agg((F.max("center_ms") - F.min("center_ms")).alias("span"))
    joined = own.join(spans, (F.col("key") == F.col("k")) & (F.col("run") == F.col("r")), "left")
    short = active & (F.col("span") + F.col("least") < least_ms)
    return joined.select("key", "center_ms", F.when(short, "non_play").otherwise(F.col("state")).alias("state"))


def effective_windows(events: DataFrame, duration_ms: int) -> DataFrame:
    """Windows of play of each take: from the first start after a closing event to the next end or event of no play.

    A window still open at the end is closed at `duration_ms`; empty windows go, touching ones merge.
    """
    order = W.partitionBy("take").orderBy("t_ms", "id")
    closes = F.col("kind") != "rally_start"
    turn = F.coalesce(F.sum(F.when(closes, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = events.withColumn("turn", turn).groupBy("take", "turn").agg(F.min(F.when(~closes, F.col("t_ms"))).alias("start"), F.coalesce(F.max(F.when(closes, F.col("t_ms"))), F.lit(duration_ms)).alias("end"))
    return merged(spans.filter("start IS NOT NULL").select("take", "start", "end"), "take")


def pairing_plan(nearest: DataFrame, by: str, order: list[str], frame: str, strict: bool = False) -> DataFrame:
    """Rows of an as-of join (status, frame) that go back in frames become non_monotonic, without a frame.

    strict: a frame that was used before counts too, as no_new_frame.
    """
    before = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ok = F.col("status") == "ok"
    reached = F.max(F.when(ok, F.col(frame))).over(before)
    back = ok & F.coalesce(F.col(frame) <= reached if strict else F.col(frame) < reached, F.lit(False))
    return nearest.withColumn("__back", back).withColumns({"status": F.when(F.col("__back"), "no_new_frame" if strict else "non_monotonic").otherwise(F.col("status")), frame: F.when(~F.col("__back"), F.col(frame))}).drop("__back")


def interpolated(points: DataFrame, by: str, time: str, most_ms: int) -> DataFrame:
    """Missing values (null `value`) between two known ones at most `most_ms` apart, by the share of time."""
    back = W.partitionBy(by).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(by).orderBy(time).rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col("value").isNotNull(), F.struct(F.col(time).alias("t"), F.col("value").alias("v")))
    own = points.withColumns({"p": F.last(known, ignorenulls=True).over(back), "n": F.first(known, ignorenulls=True).over(ahead)})
    gap = F.col("n.t") - F.col("p.t")
    between = F.col("p.v") + (F.col("n.v") - F.col("p.v")) * (F.col(time) - F.col("p.t")) / gap
    filled = F.when(F.col("value").isNotNull(), F.col("value")).when((gap > 0) & (gap <= most_ms), between)
    return own.select(*points.columns, filled.alias("filled"), (F.col("value").isNull() & filled.isNotNull()).alias("interpolated"))


def shot_owners(segments: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Each segment with the shot it belongs to: opened by a hit or serve, closed behind a segment ending in a loss."""
    w = W.partitionBy(by).orderBy(*order)
    opens = F.col("start_event").isin("hit", "serve_reset")
    closed = F.coalesce(F.lag("end_event").over(w).isin("loss", "end_of_stream"), F.lit(False))
    own = segments.withColumn("__mark", F.when(opens, F.col("segment_id")).when(closed, F.lit(-1)))
    shot = F.last("__mark", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return own.withColumn("shot_id", F.when(shot >= 0, shot)).drop("__mark")


def suppressed_hits(hits: DataFrame, bounces: DataFrame, by: str, before_ms: int, after_ms: int, confidence: float) -> DataFrame:
    """Hits with the first confident bounce near them (null: they survive): a join on buckets of time as wide as the window."""
    width = before_ms + after_ms
    at = lambda c: F.floor(c / width).cast("long")
    firm = bounces.filter(F.col("confidence") >= confidence).select(F.col(by).alias("by2"), F.col("t_ms").alias("bounce_ms"), F.col("id").alias("bounce_id"))
    spread = firm.withColumn("bucket", F.explode(F.sequence(at(F.col("bounce_ms") - before_ms), at(F.col("bounce_ms") + after_ms))))
    near = hits.withColumn("bucket2", at(F.col("t_ms"))).join(spread, (F.col(by) == F.col("by2")) & (F.col("bucket") == F.col("bucket2")) & (F.col("t_ms") - F.col("bounce_ms")).between(-before_ms, after_ms))
    first = near.groupBy(F.col("id").alias("hit_id")).agg(F.min_by("bounce_id", F.struct("bounce_ms", "bounce_id")).alias("bounce_id"))
    return hits.join(first, F.col("id") == F.col("hit_id"), "left").select(*hits.columns, "bounce_id")
