"""Stable runs: whether a player came to the kitchen line in a rally and stayed, and the rates of players."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: metres
FOOT, COURT_LENGTH = 0.3048, 13.4112
LINE_FROM_END = 15.0 * FOOT


@dataclass(frozen=True)
class Reference:
    """The versioned limits of an arrival."""

    band_m: float = 0.75
    stable_ms: int = 500
    support_ms: int = 250
    coverage: float = 0.80
    gap_ms: int = 500
    samples: int = 3


# fixed values: reasons
NO_CONTEXT, NO_BINDING, NO_AUDIT, NO_TRACK = "missing_or_unconfirmed_rally_context", "formal_window_binding_unavailable", "identity_audit_unavailable", "missing_player_trajectory"
INSUFFICIENT, CROSSING = "insufficient_track_coverage", "uncertain_crossing_interval"


def line_of(end: Column) -> Column:
    """The kitchen line of a court end, in metres from end a."""
    return F.when(end == "end_a", LINE_FROM_END).when(end == "end_b", COURT_LENGTH - LINE_FROM_END)


def in_windows(windows: DataFrame, points: DataFrame, bucket: int = 10_000) -> DataFrame:
    """Points (player, t_ms, ...) in the closed windows (window, player, start_ms, end_ms, line) of their player, by bucket of time."""
    cut = lambda t: F.floor(t / bucket)
    spread = windows.filter("end_ms >= start_ms").select("window", F.col("player").alias("__player"), "start_ms", "end_ms", "line", F.explode(F.sequence(cut(F.col("start_ms")), cut(F.col("end_ms")))).alias("__bucket"))
    inside = F.col("t_ms").between(F.col("start_ms"), F.col("end_ms"))
    return points.join(spread, (F.col("player") == F.col("__player")) & (cut(F.col("t_ms")) == F.col("__bucket")) & inside).drop("__player", "__bucket")


def classified(points: DataFrame, reference: Reference | None = None) -> DataFrame:
    """window, player, state, reason, arrival_ms, coverage, max_gap_ms, support_ms of points in windows.

    points: window, player, start_ms, end_ms, line, t_ms, seq (order of points of one time), y (metres), detected. A run is
    points in the band around the line, one behind the other. The first run that lasts stable_ms with support_ms between
    neighbours that were both detected is the arrival, at the run's begin; one that begins with the window was already
    present. Without one, thin coverage or a long gap, a step that touches or crosses the band, and any point in the band
    exclude the window, in this order; else the player did not arrive. Fewer points than the reference asks for exclude it.
    Rows without a time or a y are no points. A null detected is false. support_ms is that of the last run long enough.
    A window's points of one player are one task's work: they are as many as a rally has frames.
    """
    r = reference or Reference()
    order = W.partitionBy("window", "player").orderBy("t_ms", "seq")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    t, seen = F.col("t_ms"), F.col("seen")
    from_line = F.col("y") - F.col("line")
    own = points.filter("t_ms IS NOT NULL AND y IS NOT NULL").withColumns({"seen": F.coalesce("detected", F.lit(False)), "off": from_line, "in_band": F.abs(from_line) <= r.band_m})
    own = own.withColumns({"before": F.lag(F.struct("t_ms", "seen", "off", "in_band")).over(order), "seen_t": F.last(F.when(seen, t), ignorenulls=True).over(earlier)})
    step = F.when(seen & F.col("before.seen"), t - F.col("before.t_ms")).otherwise(0)
    begins = F.col("in_band") & ~F.coalesce("before.in_band", F.lit(False))
    own = own.withColumn("supported", F.sum(step).over(so_far))
    own = own.withColumns({"run_t": F.last(F.when(begins, t), ignorenulls=True).over(so_far), "run_s": F.last(F.when(begins, F.col("supported")), ignorenulls=True).over(so_far)})
    support = F.col("supported") - F.col("run_s")
    long_enough = F.col("in_band") & (t - F.col("run_t") >= r.stable_ms)
    place = F.struct("t_ms", "seq")
    across = F.col("in_band") | F.col("before.in_band") | ((F.col("before.off") < -r.band_m) & (F.col("off") > r.band_m)) | ((F.col("before.off") > r.band_m) & (F.col("off") < -r.band_m))
    arrives = long_enough & (support >= r.support_ms)
    found = own.groupBy("window", "player", "start_ms", "end_ms").agg(
        F.count("*").alias("n"),
        F.min("t_ms").alias("first_t"),
        F.count_if(seen).alias("n_seen"),
        F.min(F.when(seen, t)).alias("seen_from"),
        F.max(F.when(seen, t)).alias("seen_to"),
        F.max(F.when(seen, t - F.col("seen_t"))).alias("gap"),
        F.min_by(F.when(arrives, F.struct(F.col("run_t").alias("t"), support.alias("support"))), F.when(arrives, place)).alias("arrival"),
        F.max_by(F.when(long_enough, support), F.when(long_enough, place)).alias("last_support"),
        F.bool_or("in_band").alias("any_in_band"),
        F.coalesce(F.bool_or(F.col("before").isNotNull() & across), F.lit(False)).alias("crossing"),
    )
    lasts = F.col("end_ms") - F.col("start_ms")
    coverage = F.when(F.col("n_seen") < 2, 0.0).otherwise(F.least(F.lit(1.0), (F.col("seen_to") - F.col("seen_from")) / F.greatest(F.lit(1), lasts)))
    gap = F.when(F.col("n_seen") == 0, F.greatest(F.lit(0), lasts)).otherwise(F.greatest(F.col("seen_from") - F.col("start_ms"), F.col("end_ms") - F.col("seen_to"), "gap"))
    found = found.withColumns({"coverage": coverage, "max_gap_ms": gap})
    at = F.col("arrival.t")
    few = F.col("n") < r.samples
    present = (at <= F.col("first_t") + 1) & (F.col("first_t") - F.col("start_ms") <= max(1, r.stable_ms // 5))
    thin = (F.col("coverage") < r.coverage) | (F.col("max_gap_ms") > r.gap_ms)
    arrived = ~few & at.isNotNull()
    state = F.when(few, "excluded").when(arrived & present, "already_present").when(arrived, "arrived").when(thin | F.col("crossing") | F.col("any_in_band"), "excluded").otherwise("not_arrived")
    reason = F.when(few, INSUFFICIENT).when(arrived, None).when(thin, INSUFFICIENT).when(F.col("crossing"), CROSSING).when(F.col("any_in_band"), INSUFFICIENT)
    arrival = F.when(arrived, F.when(present, 0).otherwise(F.greatest(F.lit(0), at - F.col("start_ms"))))
    support = F.when(few, 0).when(arrived, F.col("arrival.support")).otherwise(F.coalesce("last_support", F.lit(0)))
    return found.select("window", "player", state.alias("state"), reason.alias("reason"), arrival.cast("long").alias("arrival_ms"), "coverage", "max_gap_ms", support.cast("long").alias("support_ms"))


def serving_arrivals(rallies: DataFrame, roster: DataFrame, audit: DataFrame, points: DataFrame, reference: Reference | None = None) -> DataFrame:
    """One row for each rally and player of its serving team: is_sample, state, reason and the measures of classified.

    rallies: window, status, method, server_team, end_a, end_b (the ends of teams A and B), start_ms, end_ms (null: none).
    roster: player, team. audit: player, formal_player, confirmed. points: player, t_ms, seq, y, detected. A rally
    without context, binding, serving team or end, and players whose identity is not confirmed, are no samples and only
    have a reason (the player is null where no roster row fits); a player without points is an excluded sample.
    """
    team = F.col("server_team")
    blocked = F.when(F.coalesce(F.col("status"), F.lit("")) != "available", NO_CONTEXT).when(F.coalesce("method", F.lit("unavailable")) == "unavailable", NO_BINDING).when(~F.coalesce(team.isin("A", "B"), F.lit(False)), NO_CONTEXT)
    own = rallies.select("window", "start_ms", F.coalesce("end_ms", "start_ms").alias("end_ms"), team.alias("__team"), line_of(F.when(team == "A", F.col("end_a")).otherwise(F.col("end_b"))).alias("line"), blocked.alias("blocked"))
    players = roster.filter(F.col("team").isin("A", "B")).select("player", F.col("team").alias("__side"))
    served = own.filter("blocked IS NULL").join(players, F.col("__team") == F.col("__side"), "left").drop("__side")
    sure = audit.groupBy(F.col("player").alias("__player")).agg(F.bool_or(F.coalesce("confirmed", F.lit(False)) & F.coalesce(F.col("formal_player") == F.col("player"), F.lit(False))).alias("sure"))
    served = served.join(sure, F.col("player") == F.col("__player"), "left").drop("__player")
    no_line, unsure = F.col("line").isNull(), ~F.coalesce("sure", F.lit(False))
    served = served.filter("player IS NOT NULL OR line IS NULL").withColumn("blocked", F.when(no_line, NO_CONTEXT).when(unsure, NO_AUDIT))
    judged = classified(in_windows(served.filter("blocked IS NULL"), points), reference).withColumnsRenamed({"window": "__window", "player": "__player"})
    full = served.unionByName(own.filter("blocked IS NOT NULL").select("*", F.lit(None).cast(roster.schema["player"].dataType).alias("player"), F.lit(None).cast("boolean").alias("sure")))
    full = full.join(judged, (F.col("window") == F.col("__window")) & (F.col("player") == F.col("__player")), "left")
    sample = F.col("blocked").isNull()
    missing = sample & F.col("state").isNull()
    return full.select(
        "window",
        "player",
        sample.alias("is_sample"),
        F.when(missing, "excluded").otherwise(F.col("state")).alias("state"),
        F.coalesce("blocked", F.when(missing, NO_TRACK).otherwise(F.col("reason"))).alias("reason"),
        "arrival_ms",
        F.when(missing, 0.0).otherwise(F.col("coverage")).alias("coverage"),
        F.when(missing, F.col("end_ms") - F.col("start_ms")).otherwise(F.col("max_gap_ms")).alias("max_gap_ms"),
        F.when(missing, 0).otherwise(F.col("support_ms")).cast("long").alias("support_ms"),
    )


def arrival_rates(arrivals: DataFrame, roster: DataFrame, reference: Reference | None = None) -> DataFrame:
    """Each player of the roster: samples, eligible and arrived rallies, and a rate where enough are eligible."""
    least = (reference or Reference()).samples
    good = F.col("state").isin("arrived", "already_present")
    counts = arrivals.filter("is_sample").groupBy(F.col("player").alias("__player")).agg(F.count("*").alias("samples"), F.count_if(good | (F.col("state") == "not_arrived")).alias("eligible"), F.count_if(good).alias("arrived"))
    own = roster.filter(F.col("team").isin("A", "B")).select("player", "team").join(counts, F.col("player") == F.col("__player"), "left").drop("__player").fillna(0, ["samples", "eligible", "arrived"])
    enough = F.col("eligible") >= least
    return own.withColumns({"rate": F.when(enough, F.col("arrived") / F.col("eligible")), "status": F.when(enough, "available").otherwise("insufficient_evidence")})
