"""Evidence cascades: facts that other tables hold are looked up in order of strength, and what is missing gets a status.

No rule here picks among equals: where evidence is ambiguous the result says so and stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtlight.functions import court

#: Milliseconds around a contact in which the hitter's place counts, feet that a direction needs, feet of
#: uncertainty of a point that states none, and the tolerance of a binding by time.
CONTACT_MS, DIRECTION_FT, UNCERTAIN_FT, BINDING_MS = 250, 2.0, 0.1, 3000


def finite(value: Column) -> Column:
    """A double, null where it is null, no number or infinite."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def first_of(row: Column, order: Column, where: Column) -> Column:
    """The aggregate that gives the row first in order among those where the condition holds."""
    return F.min_by(F.when(where, row), F.when(where, order))


def hitter_sides(contacts: DataFrame, samples: DataFrame) -> DataFrame:
    """id and side (near, far) of contacts (id, player, t_ms) whose player has a sample within CONTACT_MS of the contact.

    The nearest sample counts; of equally near ones that of the smaller y. Samples (player, t_ms, y, projection_status)
    that failed to project, on the net or without a finite y say nothing. Null players and times give no row. A sample
    meets a contact by player and a bucket of time, so one player's samples are spread over many tasks.
    """
    bucket = lambda t: F.floor(t / (2 * CONTACT_MS))
    good = samples.withColumn("y", finite(F.col("y"))).filter((F.abs(F.col("y") - court.NET) > 1e-9) & ~F.coalesce(F.col("projection_status").isin("projection_failed", "invalid"), F.lit(False)))
    good = good.select(F.col("player").alias("__player"), F.col("t_ms").alias("__t"), "y", bucket(F.col("t_ms")).alias("__bucket"))
    near = contacts.select("id", "player", "t_ms", F.explode(F.sequence(bucket(F.col("t_ms") - CONTACT_MS), bucket(F.col("t_ms") + CONTACT_MS))).alias("bucket"))
    apart = F.abs(F.col("__t") - F.col("t_ms"))
    both = near.join(good, (F.col("player") == F.col("__player")) & (F.col("bucket") == F.col("__bucket"))).filter(apart <= CONTACT_MS)
    return both.groupBy("id").agg(F.min(F.struct(apart.alias("apart"), "y")).alias("best")).select("id", F.when(F.col("best.y") < court.NET, "near").otherwise("far").alias("side"))


def project_zone(u: Column, distance: Column) -> Column:
    """Zone name and number (1 to 12) of a point of the target half: thirds of the width, four depths from the net."""
    column = F.when(u < 1 / 3, 0).when(u < 2 / 3, 1).otherwise(2)
    row = F.when(distance < 7, 0).when(distance < 12, 1).when(distance < 17, 2).otherwise(3)
    name = F.concat_ws("-", F.element_at(F.array(*map(F.lit, ("K", "T", "D", "VD"))), row + 1), F.element_at(F.array(*map(F.lit, ("L", "C", "R"))), column + 1))
    return F.when(u.between(0.0, 1.0) & distance.between(0.0, court.NET), F.struct(name.alias("name"), (row * 3 + column + 1).alias("id")))


def landings(shots: DataFrame, segments: DataFrame, events: DataFrame, samples: DataFrame) -> DataFrame:
    """Where each shot landed: shot to its segments, to the first that a bounce ends, to that event, to the court.

    shots: shot_id, hitter, contact_ms, segment_ids. segments: segment_id, end_event_id, end_event_type, path (array of
    t_sec, frame, x, y). events: event_id, event_status, t_sec, frame, x, y, uncertainty. samples: as hitter_sides has them.

    status is the first that holds: unavailable (a segment is missing, none ends in a bounce or a hit, or the bounce's
    event is missing), no_bounce_before_next_contact, ambiguous_bounce (an event that is not confirmed; a null status is
    confirmed), bounce_without_court_coordinate, available. Segments come in order of their end event's time, those
    without one last, then by id. The target half is the one across from the hitter's side, or else where the path leads
    by DIRECTION_FT at least. A point within its uncertainty of a line is unknown. Shots without segments, null ids and
    empty tables are unavailable or give no row. Ids of segments and events are unique.
    """
    asked = shots.select("shot_id", F.explode_outer("segment_ids").alias("__asked"))
    ends = events.select(F.col("event_id").alias("__event"), F.struct("event_id", "event_status", finite(F.col("t_sec")).alias("t_sec"), "frame", finite(F.col("x")).alias("x"), finite(F.col("y")).alias("y"), finite(F.col("uncertainty")).alias("uncertainty")).alias("event"))
    # a path's first point on the court: samples without a time, and those at time zero, come last
    late = F.lit(float("inf"))
    points = F.transform("path", lambda p: F.struct(F.coalesce(F.nullif(finite(p["t_sec"]), F.lit(0.0)), late).alias("t"), F.coalesce(p["frame"], F.lit(0)).alias("frame"), finite(p["x"]).alias("x"), finite(p["y"]).alias("y")))
    begin = F.array_min(F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    own = segments.select("segment_id", "end_event_id", F.lower("end_event_type").alias("ends_in"), begin.alias("begin"))
    chain = asked.join(own, F.col("__asked") == F.col("segment_id"), "left").join(ends, F.col("end_event_id") == F.col("__event"), "left")
    order = F.struct(F.coalesce("event.t_sec", late).alias("t"), F.col("segment_id").alias("id"))
    bounced = F.col("ends_in") == "bounce"
    found = chain.groupBy("shot_id").agg(
        F.count("__asked").alias("n_asked"),
        F.count("segment_id").alias("n_found"),
        F.coalesce(F.bool_or(F.col("ends_in") == "hit"), F.lit(False)).alias("hit"),
        F.coalesce(F.bool_or(bounced), F.lit(False)).alias("bounced"),
        first_of(F.struct("segment_id", "event"), order, bounced).alias("bounce"),
        F.min("begin").alias("begin"),
    )
    sides = hitter_sides(shots.select(F.col("shot_id").alias("id"), F.col("hitter").alias("player"), F.col("contact_ms").alias("t_ms")).filter("player IS NOT NULL AND t_ms IS NOT NULL"), samples)
    all_of = shots.select("shot_id", "hitter").join(found, "shot_id", "left").join(sides.withColumnRenamed("id", "__shot"), F.col("shot_id") == F.col("__shot"), "left")
    e = F.col("bounce.event")
    status = (
        F.when((F.col("n_found") < F.col("n_asked")) | F.col("n_asked").isNull(), "unavailable")
        .when(~F.col("bounced") & F.col("hit"), "no_bounce_before_next_contact")
        .when(~F.col("bounced") | e.isNull(), "unavailable")
        .when(F.lower(F.coalesce(e["event_status"], F.lit("confirmed"))) != "confirmed", "ambiguous_bounce")
        .when(e["x"].isNull() | e["y"].isNull(), "bounce_without_court_coordinate")
        .otherwise("available")
    )
    told = all_of.withColumn("status", status)
    is_known = F.col("status") == "available"
    is_formal = F.col("status").isin("available", "bounce_without_court_coordinate")
    told = told.select("shot_id", "hitter", "status", "side", "begin.y", F.when(is_formal, F.struct("bounce.segment_id", e["event_id"].alias("event_id"), e["t_sec"].alias("t_sec"), e["uncertainty"].alias("given"))).alias("at"), *[F.when(is_known, e[c]).alias(f"land_{c}") for c in ("x", "y")])
    x, y = F.col("land_x"), F.col("land_y")
    uncertain = F.when(F.col("at.given") >= 0, F.col("at.given"))
    band = F.coalesce(uncertain, F.lit(UNCERTAIN_FT))
    ahead = y - F.col("y")
    by_path = F.when(F.abs(ahead) < DIRECTION_FT, None).when(ahead > 0, "far").when(ahead <= 0, "near")
    across = F.when(F.col("side") == "near", "far").when(F.col("side") == "far", "near")
    told = told.withColumns({"half": F.when(is_known, F.coalesce(across, by_path)), "basis": F.when(is_known, F.when(across.isNotNull(), "hitter_position_at_contact").when(by_path.isNotNull(), "trajectory_direction").otherwise("unavailable"))})
    half = F.col("half")
    hits_target = ((half == "far") & (y > court.NET)) | ((half == "near") & (y < court.NET))
    call = court.landing_call(x, y, band)
    told = told.select(
        "shot_id",
        "hitter",
        "status",
        F.col("at.segment_id").alias("segment_id"),
        F.col("at.event_id").alias("event_id"),
        F.bround(F.col("at.t_sec") * 1000).cast("long").alias("t_ms"),
        x.alias("x_ft"),
        y.alias("y_ft"),
        F.when(is_known, F.when(call == "in", "inside_court").when(call == "out", "outside_court").otherwise("unknown")).alias("location"),
        F.when(is_known, F.when(half.isNull() | (F.abs(y - court.NET) <= band), "unknown").when(hits_target, "target_half").otherwise("own_half")).alias("relation"),
        half.alias("target_half"),
        "basis",
        F.when(half == "far", x).when(half == "near", court.WIDTH - x).alias("target_x"),
        F.when(half == "far", y).when(half == "near", court.LENGTH - y).alias("target_y"),
        F.when(is_known, uncertain).alias("uncertainty_ft"),
    )
    zone = project_zone(F.col("target_x") / court.WIDTH, F.col("target_y") - court.NET)
    eligible = (F.col("location") == "inside_court") & (F.col("relation") == "target_half")
    return told.withColumn("zone", F.when(eligible, zone)).select("*", F.col("zone.name").alias("zone_12"), F.col("zone.id").alias("zone_12_id")).drop("zone")


def landing_summary(landed: DataFrame) -> DataFrame:
    """One row: how many shots landed measurably, and in each zone (a map); no shots give zeros, a null rate, no zones."""
    status = F.col("status")
    formal = F.count_if(status.isin("available", "bounce_without_court_coordinate"))
    # a dozen rows, one a zone and one for none, then one
    by_zone = landed.groupBy("zone_12").agg(F.count("*").alias("shots"), F.count_if(status == "available").alias("measurable"), formal.alias("formal_bounces"), F.count_if(status == "no_bounce_before_next_contact").alias("no_bounce"), F.count("zone_12").alias("zoned"))
    counts = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("shots", "measurable", "formal_bounces", "no_bounce", "zoned")]
    zone = F.when(F.col("zone_12").isNotNull(), F.struct("zone_12", "shots"))
    whole = by_zone.agg(*counts, F.map_from_entries(F.array_sort(F.collect_list(zone))).alias("zones"))
    return whole.withColumn("rate", F.when(F.col("formal_bounces") > 0, F.round(F.col("measurable") / F.col("formal_bounces"), 4)))


def bindings(windows: DataFrame, segments: DataFrame, snapshots: DataFrame, tolerance: int = BINDING_MS) -> DataFrame:
    """Windows with the score snapshot that belongs to them, by the strongest evidence, and how it was found.

    windows: window_id, take, start_ms, source_segment_id, source_event_id. segments: segment_id, start_event_id.
    snapshots: snapshot_id, take, event_id, start_ms, revision. Of the snapshots of one take and event the latest
    revision counts, of equal ones the smallest id. A window is bound by its segment's start event, else by its own
    start event, else by the one snapshot that begins at most `tolerance` before it, else not at all: two such
    snapshots are ambiguous. candidates is 1 for a link, else the number of snapshots in the tolerance. Null keys link
    nothing; windows of a take without snapshots are unavailable; an empty table gives no row.

    The third step counts and needs no pairs: with snapshots and windows in one order of time, a window's candidates are
    the running count at its begin less that before the tolerance.
    """
    effective = snapshots.filter("event_id IS NOT NULL").groupBy(F.col("take").alias("__take"), F.col("event_id").alias("__event")).agg(F.max_by("snapshot_id", F.struct("revision", -F.col("snapshot_id"))).alias("linked"))
    starts = segments.filter("start_event_id IS NOT NULL").select(F.col("segment_id").alias("__segment"), "start_event_id")
    own = windows.join(starts, F.col("source_segment_id") == F.col("__segment"), "left")
    for name, event in (("by_segment", "start_event_id"), ("by_event", "source_event_id")):
        own = own.join(effective.withColumnRenamed("linked", name), (F.col("take") == F.col("__take")) & (F.col(event) == F.col("__event")), "left").drop("__take", "__event")
    empty = F.lit(None)
    shown = snapshots.filter("take IS NOT NULL AND start_ms IS NOT NULL").select("take", F.col("start_ms").alias("t"), F.lit(1).alias("kind"), F.col("snapshot_id").alias("snap"), empty.cast("long").alias("win"))
    at = own.select("take", F.col("start_ms").alias("t"), F.lit(2).alias("kind"), empty.cast("long").alias("snap"), F.col("window_id").alias("win"))
    # just before the tolerance begins: whatever comes up to here is too early
    before = own.select("take", (F.col("start_ms") - tolerance - 1).alias("t"), F.lit(3).alias("kind"), empty.cast("long").alias("snap"), F.col("window_id").alias("win"))
    order = W.partitionBy("take").orderBy("t", "kind", "snap").rowsBetween(W.unboundedPreceding, 0)
    line = shown.unionByName(at).unionByName(before).withColumns({"n": F.count("snap").over(order), "last": F.last("snap", ignorenulls=True).over(order)})
    counted = line.filter("win IS NOT NULL").groupBy(F.col("win").alias("__win")).agg((F.max(F.when(F.col("kind") == 2, F.col("n"))) - F.max(F.when(F.col("kind") == 3, F.col("n")))).alias("near"), F.max(F.when(F.col("kind") == 2, F.col("last"))).alias("by_time"))
    own = own.join(counted, F.col("window_id") == F.col("__win"), "left")
    by_segment, by_event = F.col("by_segment").isNotNull(), F.col("by_event").isNotNull()
    unique = F.col("near") == 1
    method = F.when(by_segment, "direct_segment_link").when(by_event, "direct_start_event_link").when(unique, "unique_temporal_match").otherwise("unavailable")
    return own.select(
        "window_id",
        method.alias("method"),
        F.coalesce("by_segment", "by_event", F.when(unique, F.col("by_time"))).alias("snapshot_id"),
        F.when(by_segment | by_event, 1).otherwise(F.coalesce("near", F.lit(0))).cast("long").alias("candidates"),
    )
