"""Registered queries of evidence cascades and stable runs: landings, bindings, arrivals at the kitchen line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlight.operators import arrival, evidence
from courtlight.plans.registry import _r, query
from courtlight.sources.adapters import plain, read, view

#: Orders are shots, their lines name segments (parts), a segment ends in an event. Some of each are missing.
SHOTS = """SELECT o_orderkey AS shot_id, CASE WHEN o_orderkey % 17 <> 0 THEN 'Player_' || (o_custkey % 5) END AS hitter,
  CASE WHEN o_orderkey % 23 <> 0 THEN o_orderkey * 100 END AS contact_ms FROM {orders}"""
LINKS = "SELECT l_orderkey AS shot_id, 'g' || l_partkey AS segment_id FROM {lineitem}"
SEGMENTS = """SELECT 'g' || p_partkey AS segment_id, CASE WHEN p_partkey % 29 <> 0 THEN 'e' || (p_partkey * 5 + p_size % 3) END AS end_event_id,
  CASE p_size % 5 WHEN 0 THEN 'bounce' WHEN 1 THEN 'Hit' WHEN 2 THEN 'loss' WHEN 3 THEN 'Bounce' END AS end_event_type,
  p_partkey % 7 / 10.0 AS t1, p_size AS f1, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey * 37 % 2800) / 100.0 - 4 END AS x1, (p_partkey * 53 % 6000) / 100.0 - 8 AS y1,
  CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 11 / 10.0 END AS t2, p_size + 1 AS f2, (p_partkey * 41 % 2800) / 100.0 - 4 AS x2, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey * 59 % 6000) / 100.0 - 8 END AS y2
  FROM {part} WHERE p_partkey % 13 <> 0"""
ENDS = """SELECT 'e' || event_id AS event_id, CASE event_type WHEN 'error' THEN 'ambiguous' WHEN 'view' THEN NULL ELSE 'Confirmed' END AS event_status,
  CASE WHEN event_id % 41 <> 0 THEN (event_id * 7919 % 60000) / 100.0 END AS t_sec, event_id AS frame,
  CASE WHEN event_id % 9 <> 0 THEN (event_id * 37 % 2800) / 100.0 - 4 END AS x,
  CASE WHEN event_id % 31 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST((event_id * 53 % 6000) / 100.0 - 8 AS DOUBLE) END AS y,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN -1.0 ELSE (event_id % 40) / 20.0 END AS uncertainty FROM {events}"""
SAMPLES = """SELECT 'Player_' || (user_id % 5) AS player, event_id * 150 + event_id % 7 * 10 AS t_ms,
  CASE WHEN event_id % 6 = 0 THEN 22.0 WHEN event_id % 10 <> 0 THEN (event_id * 53 % 6000) / 100.0 - 8 END AS y,
  CASE event_id % 8 WHEN 0 THEN 'projection_failed' WHEN 1 THEN NULL ELSE 'inside_court' END AS projection_status FROM {events}"""

LANDINGS_SQL = f"""
WITH shots AS ({plain(SHOTS)}), links AS ({plain(LINKS)}), segments AS ({plain(SEGMENTS)}), ends AS ({plain(ENDS)}), samples AS ({plain(SAMPLES)}),
chain AS (
  SELECT l.shot_id, g.segment_id, lower(g.end_event_type) AS kind, e.event_id, lower(coalesce(e.event_status, 'confirmed')) AS event_status,
    e.t_sec, e.x, CASE WHEN isfinite(e.y) THEN e.y END AS y, e.uncertainty
  FROM links l LEFT JOIN segments g USING (segment_id) LEFT JOIN ends e ON e.event_id = g.end_event_id),
per_shot AS (
  SELECT shot_id, count(*) > count(segment_id) AS missing, coalesce(bool_or(kind = 'bounce'), false) AS bounced, coalesce(bool_or(kind = 'hit'), false) AS hit
  FROM chain GROUP BY shot_id),
bounce AS (
  SELECT * FROM chain WHERE kind = 'bounce'
  QUALIFY row_number() OVER (PARTITION BY shot_id ORDER BY t_sec NULLS LAST, segment_id) = 1),
path AS (
  SELECT segment_id, t1 AS t, f1 AS f, x1 AS x, y1 AS y FROM segments UNION ALL SELECT segment_id, t2, f2, x2, y2 FROM segments),
start AS (
  SELECT l.shot_id, p.y FROM links l JOIN path p USING (segment_id) WHERE p.x IS NOT NULL AND p.y IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY l.shot_id ORDER BY nullif(t, 0) NULLS LAST, f, x, y) = 1),
side AS (
  SELECT s.shot_id, p.y FROM shots s JOIN samples p ON p.player = s.hitter AND p.t_ms BETWEEN s.contact_ms - 250 AND s.contact_ms + 250
  WHERE p.y <> 22 AND coalesce(p.projection_status, '') NOT IN ('projection_failed', 'invalid')
  QUALIFY row_number() OVER (PARTITION BY s.shot_id ORDER BY abs(p.t_ms - s.contact_ms), p.y) = 1),
status AS (
  SELECT s.shot_id, s.hitter,
    CASE WHEN q.shot_id IS NULL THEN 'unavailable' WHEN missing THEN 'unavailable'
      WHEN NOT bounced THEN CASE WHEN hit THEN 'no_bounce_before_next_contact' ELSE 'unavailable' END
      WHEN b.event_id IS NULL THEN 'unavailable' WHEN b.event_status <> 'confirmed' THEN 'ambiguous_bounce'
      WHEN b.x IS NULL OR b.y IS NULL THEN 'bounce_without_court_coordinate' ELSE 'available' END AS status,
    b.segment_id, b.event_id, b.t_sec, b.x, b.y, CASE WHEN b.uncertainty >= 0 THEN b.uncertainty END AS u,
    CASE WHEN c.y IS NOT NULL THEN CASE WHEN c.y < 22 THEN 'far' ELSE 'near' END END AS across,
    CASE WHEN abs(b.y - a.y) >= 2 THEN CASE WHEN b.y > a.y THEN 'far' ELSE 'near' END END AS by_path
  FROM shots s LEFT JOIN per_shot q USING (shot_id) LEFT JOIN bounce b USING (shot_id) LEFT JOIN start a USING (shot_id) LEFT JOIN side c USING (shot_id)),
known AS (
  SELECT *, coalesce(u, 0.1) AS band, coalesce(across, by_path) AS half,
    sqrt(power(greatest(-x, 0, x - 20), 2) + power(greatest(-y, 0, y - 44), 2)) AS outside, least(x, 20 - x, y, 44 - y) AS inside
  FROM status WHERE status = 'available'),
told AS (
  SELECT *, CASE WHEN (CASE WHEN outside > 0 THEN outside ELSE inside END) <= band THEN 'unknown' WHEN inside > 0 THEN 'inside_court' ELSE 'outside_court' END AS location,
    CASE WHEN half IS NULL OR abs(y - 22) <= band THEN 'unknown' WHEN (half = 'far') = (y > 22) THEN 'target_half' ELSE 'own_half' END AS relation,
    CASE half WHEN 'far' THEN x WHEN 'near' THEN 20 - x END AS target_x, CASE half WHEN 'far' THEN y WHEN 'near' THEN 44 - y END AS target_y
  FROM known),
zoned AS (
  SELECT *, CASE WHEN target_x / 20 < 1 / 3 THEN 0 WHEN target_x / 20 < 2 / 3 THEN 1 ELSE 2 END AS c,
    CASE WHEN target_y - 22 < 7 THEN 0 WHEN target_y - 22 < 12 THEN 1 WHEN target_y - 22 < 17 THEN 2 ELSE 3 END AS r,
    location = 'inside_court' AND relation = 'target_half' AS eligible
  FROM told),
landed AS (
  SELECT s.shot_id, s.hitter, s.status, CASE WHEN s.status IN ('available', 'bounce_without_court_coordinate') THEN s.segment_id END AS segment_id,
    CASE WHEN s.status IN ('available', 'bounce_without_court_coordinate') THEN s.event_id END AS event_id,
    CASE WHEN s.status IN ('available', 'bounce_without_court_coordinate') THEN CAST(round_even(s.t_sec * 1000, 0) AS BIGINT) END AS t_ms,
    z.x AS x_ft, z.y AS y_ft, z.location, z.relation, z.half AS target_half,
    CASE WHEN z.shot_id IS NULL THEN NULL WHEN z.across IS NOT NULL THEN 'hitter_position_at_contact' WHEN z.by_path IS NOT NULL THEN 'trajectory_direction' ELSE 'unavailable' END AS basis,
    round(z.target_x, 6) AS target_x, round(z.target_y, 6) AS target_y, z.u AS uncertainty_ft,
    CASE WHEN eligible THEN ['K', 'T', 'D', 'VD'][r + 1] || '-' || ['L', 'C', 'R'][c + 1] END AS zone_12, CASE WHEN eligible THEN r * 3 + c + 1 END AS zone_12_id
  FROM status s LEFT JOIN zoned z USING (shot_id))
"""


def _landings(spark: SparkSession, sf: str) -> DataFrame:
    links = view(spark, sf, LINKS).groupBy("shot_id").agg(F.collect_list("segment_id").alias("segment_ids"))
    shots = view(spark, sf, SHOTS).join(links.withColumnRenamed("shot_id", "s"), F.col("shot_id") == F.col("s"), "left").drop("s")
    point = lambda i: F.struct(F.col(f"t{i}").cast("double").alias("t_sec"), F.col(f"f{i}").alias("frame"), F.col(f"x{i}").cast("double").alias("x"), F.col(f"y{i}").cast("double").alias("y"))
    segments = view(spark, sf, SEGMENTS).select("segment_id", "end_event_id", "end_event_type", F.array(point(1), point(2)).alias("path"))
    return evidence.landings(shots, segments, view(spark, sf, ENDS), view(spark, sf, SAMPLES))


@query("jon_17_landings", LANDINGS_SQL + "SELECT * FROM landed")
def landings(spark: SparkSession, sf: str) -> DataFrame:
    return _landings(spark, sf).withColumns({c: _r(c) for c in ("target_x", "target_y")})


@query(
    "agg_10_landing_rates",
    LANDINGS_SQL
    + """, c AS (SELECT zone_12, count(*) AS n FROM landed WHERE zone_12 IS NOT NULL GROUP BY 1)
SELECT count(*) AS shots, count(*) FILTER (WHERE status = 'available') AS measurable,
  count(*) FILTER (WHERE status IN ('available', 'bounce_without_court_coordinate')) AS formal_bounces,
  count(*) FILTER (WHERE status = 'no_bounce_before_next_contact') AS no_bounce, count(zone_12) AS zoned,
  round(count(*) FILTER (WHERE status = 'available') / nullif(count(*) FILTER (WHERE status IN ('available', 'bounce_without_court_coordinate')), 0), 4) AS rate,
  (SELECT coalesce(string_agg(zone_12 || '=' || n, ',' ORDER BY zone_12), '') FROM c) AS zones FROM landed""",
)
def landing_rates(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of all landings; zones as text."""
    zones = F.transform(F.map_entries("zones"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return evidence.landing_summary(_landings(spark, sf)).withColumn("zones", F.array_join(zones, ","))


#: Windows, segments and snapshots of a take are its events; keys repeat, are missing or lead nowhere.
WINDOWS = """SELECT event_id AS window_id, user_id AS take, event_id * 20 + 7 AS start_ms, CASE WHEN event_id % 3 = 0 THEN 's' || (event_id % 300) END AS source_segment_id,
  CASE WHEN event_id % 4 = 0 THEN 'v' || (event_id % 37) END AS source_event_id FROM {events} WHERE event_type IN ('signup', 'view')"""
STARTS = "SELECT 's' || p_partkey AS segment_id, CASE WHEN p_partkey % 9 <> 0 THEN 'v' || (p_partkey % 41) END AS start_event_id FROM {part}"
SNAPSHOTS = """SELECT event_id AS snapshot_id, user_id AS take, CASE WHEN event_id % 6 <> 0 THEN 'v' || (event_id % 37) END AS event_id, event_id * 20 - event_id % 5 * 20 AS start_ms,
  event_id % 3 AS revision FROM {events} WHERE event_type IN ('click', 'purchase')"""


@query(
    "jon_08_bindings",
    f"""WITH w AS ({plain(WINDOWS)}), g AS ({plain(STARTS)}), s AS ({plain(SNAPSHOTS)}),
latest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY take, event_id ORDER BY revision DESC, snapshot_id) = 1),
near AS (SELECT w.window_id, count(*) AS n, max(s.snapshot_id) AS one FROM w JOIN s ON s.take = w.take AND w.start_ms - s.start_ms BETWEEN 0 AND 3000 GROUP BY 1)
SELECT w.window_id, CASE WHEN a.snapshot_id IS NOT NULL THEN 'direct_segment_link' WHEN b.snapshot_id IS NOT NULL THEN 'direct_start_event_link'
    WHEN n = 1 THEN 'unique_temporal_match' ELSE 'unavailable' END AS method,
  coalesce(a.snapshot_id, b.snapshot_id, CASE WHEN n = 1 THEN one END) AS snapshot_id,
  CASE WHEN coalesce(a.snapshot_id, b.snapshot_id) IS NOT NULL THEN 1 ELSE coalesce(n, 0) END AS candidates
FROM w LEFT JOIN g ON g.segment_id = w.source_segment_id LEFT JOIN latest a ON a.take = w.take AND a.event_id = g.start_event_id
  LEFT JOIN latest b ON b.take = w.take AND b.event_id = w.source_event_id LEFT JOIN near USING (window_id)""",
)
def bindings(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.bindings(view(spark, sf, WINDOWS), view(spark, sf, STARTS), view(spark, sf, SNAPSHOTS))


#: Customers are rallies, order lines are points: a player stands at one depth for a dozen orders, then at another.
RALLIES = """SELECT c_custkey AS "window", CASE WHEN c_custkey % 19 = 0 THEN 'partial' WHEN c_custkey % 23 <> 0 THEN 'available' END AS status,
  CASE WHEN c_custkey % 29 = 0 THEN 'unavailable' WHEN c_custkey % 31 <> 0 THEN 'direct_segment_link' END AS method,
  CASE c_nationkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'A' WHEN 2 THEN 'A' WHEN 3 THEN 'A' ELSE 'B' END AS server_team,
  CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'end_a' ELSE 'end_b' END AS end_a, CASE WHEN c_custkey % 2 = 0 THEN 'end_b' ELSE 'end_a' END AS end_b,
  c_custkey * 1000 AS start_ms, CASE WHEN c_custkey % 43 <> 0 THEN c_custkey * 1000 + 1200 + c_custkey % 5 * 400 END AS end_ms FROM {customer}"""
ROSTER = """SELECT 'P' || r_regionkey AS player, CASE r_regionkey WHEN 0 THEN 'A' WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'B' END AS team FROM {region}"""
AUDIT = """SELECT 'P' || r_regionkey AS player, CASE WHEN r_regionkey <> 4 THEN 'P' || r_regionkey END AS formal_player, r_regionkey <> 3 AS confirmed FROM {region}"""
TRACK = """SELECT 'P' || (l_linenumber % 4) AS player, CASE WHEN l_partkey % 19 <> 0 THEN l_orderkey * 100 + l_partkey % 60 END AS t_ms, (l_partkey * 100000 + l_suppkey) * 8 + l_linenumber AS seq,
  CASE WHEN l_partkey % 23 <> 0 THEN (CAST(floor(l_orderkey / 12) AS BIGINT) * 7 % 27) / 2.0 + l_suppkey % 10 / 20.0 END AS y, CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey % 4 <> 1 END AS detected FROM {lineitem}"""

ARRIVALS_SQL = f"""
WITH rallies AS ({plain(RALLIES)}), roster AS ({plain(ROSTER)}), audit AS ({plain(AUDIT)}), track AS ({plain(TRACK)}),
served AS (
  SELECT r."window", start_ms, coalesce(end_ms, start_ms) AS end_ms, p.player,
    CASE CASE r.server_team WHEN 'A' THEN r.end_a ELSE r.end_b END WHEN 'end_a' THEN 15 * 0.3048 WHEN 'end_b' THEN 13.4112 - 15 * 0.3048 END AS line,
    CASE WHEN r.status IS DISTINCT FROM 'available' THEN 'missing_or_unconfirmed_rally_context' WHEN r.method IS NULL OR r.method = 'unavailable' THEN 'formal_window_binding_unavailable'
      WHEN r.server_team IS NULL THEN 'missing_or_unconfirmed_rally_context' END AS no_rally, a.formal_player = a.player AND a.confirmed AS sure
  FROM rallies r LEFT JOIN roster p ON p.team = r.server_team AND r.status = 'available' AND r.method IS NOT NULL AND r.method <> 'unavailable'
    LEFT JOIN audit a USING (player)),
judged AS (
  SELECT "window", start_ms, end_ms, player, line, CASE WHEN no_rally IS NOT NULL THEN no_rally WHEN line IS NULL THEN 'missing_or_unconfirmed_rally_context'
      WHEN coalesce(sure, false) = false THEN 'identity_audit_unavailable' END AS blocked FROM served),
p AS (
  SELECT j."window", j.player, j.start_ms, j.end_ms, t.t_ms, t.seq, t.y - j.line AS off, abs(t.y - j.line) <= 0.75 AS hit, coalesce(t.detected, false) AS det
  FROM judged j JOIN track t ON t.player = j.player AND t.t_ms BETWEEN j.start_ms AND j.end_ms WHERE j.blocked IS NULL AND t.y IS NOT NULL),
i AS (
  SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY "window", player, hit ORDER BY t_ms, seq) AS island, lag(off) OVER w AS off0, lag(hit) OVER w AS hit0, row_number() OVER w AS n
  FROM p WINDOW w AS (PARTITION BY "window", player ORDER BY t_ms, seq)),
s AS (
  SELECT *, min(t_ms) OVER run AS run_t, CASE WHEN det AND lag(det) OVER run THEN t_ms - lag(t_ms) OVER run ELSE 0 END AS step
  FROM i WINDOW run AS (PARTITION BY "window", player, hit, island ORDER BY t_ms, seq)),
u AS (SELECT *, sum(step) OVER (PARTITION BY "window", player, hit, island ORDER BY t_ms, seq ROWS UNBOUNDED PRECEDING) AS support FROM s),
d AS (
  SELECT "window", player, max(t_ms - before) AS gap, min(t_ms) AS d0, max(t_ms) AS d1, count(*) AS nd
  FROM (SELECT *, lag(t_ms) OVER (PARTITION BY "window", player ORDER BY t_ms, seq) AS before FROM p WHERE det) GROUP BY ALL),
a AS (
  SELECT "window", player, run_t, support FROM u WHERE hit AND t_ms - run_t >= 500 AND support >= 250
  QUALIFY row_number() OVER (PARTITION BY "window", player ORDER BY n) = 1),
l AS (SELECT "window", player, support AS last_support FROM u WHERE hit AND t_ms - run_t >= 500 QUALIFY row_number() OVER (PARTITION BY "window", player ORDER BY n DESC) = 1),
m AS (
  SELECT "window", player, start_ms, end_ms, count(*) AS n, min(t_ms) AS t0, bool_or(hit) AS any_hit,
    coalesce(bool_or(n > 1 AND (hit OR hit0 OR (off0 < -0.75 AND off > 0.75) OR (off0 > 0.75 AND off < -0.75))), false) AS crossing
  FROM i GROUP BY ALL),
v AS (
  SELECT m.*, run_t, support, coalesce(last_support, 0) AS last_support,
    CASE WHEN coalesce(nd, 0) < 2 THEN 0.0 ELSE least(1.0, (d1 - d0) / greatest(1, end_ms - start_ms)) END AS coverage,
    CASE WHEN nd IS NULL THEN greatest(0, end_ms - start_ms) ELSE greatest(d0 - start_ms, end_ms - d1, coalesce(gap, 0)) END AS max_gap_ms
  FROM m LEFT JOIN a USING ("window", player) LEFT JOIN l USING ("window", player) LEFT JOIN d USING ("window", player)),
x AS (
  SELECT *, CASE WHEN n < 3 THEN 'excluded' WHEN run_t IS NOT NULL THEN CASE WHEN run_t <= t0 + 1 AND t0 - start_ms <= 100 THEN 'already_present' ELSE 'arrived' END
      WHEN coverage < 0.8 OR max_gap_ms > 500 OR crossing OR any_hit THEN 'excluded' ELSE 'not_arrived' END AS state,
    CASE WHEN n < 3 THEN 'insufficient_track_coverage' WHEN run_t IS NOT NULL THEN NULL WHEN coverage < 0.8 OR max_gap_ms > 500 THEN 'insufficient_track_coverage'
      WHEN crossing THEN 'uncertain_crossing_interval' WHEN any_hit THEN 'insufficient_track_coverage' END AS reason
  FROM v),
arrivals AS (
  SELECT j."window", j.player, blocked IS NULL AS is_sample, CASE WHEN blocked IS NULL THEN coalesce(x.state, 'excluded') END AS state,
    CASE WHEN blocked IS NOT NULL THEN blocked WHEN x.state IS NULL THEN 'missing_player_trajectory' ELSE x.reason END AS reason,
    CASE x.state WHEN 'already_present' THEN 0 WHEN 'arrived' THEN greatest(0, run_t - x.start_ms) END AS arrival_ms,
    CASE WHEN blocked IS NULL THEN round(coalesce(x.coverage, 0.0), 6) END AS coverage, CASE WHEN blocked IS NULL THEN coalesce(x.max_gap_ms, j.end_ms - j.start_ms) END AS max_gap_ms,
    CASE WHEN blocked IS NULL THEN CAST(coalesce(CASE WHEN x.n < 3 THEN 0 WHEN run_t IS NOT NULL THEN support ELSE last_support END, 0) AS BIGINT) END AS support_ms
  FROM judged j LEFT JOIN x USING ("window", player))
"""


def _arrivals(spark: SparkSession, sf: str) -> DataFrame:
    rallies = view(spark, sf, RALLIES.replace('"window"', "`window`"))
    return arrival.serving_arrivals(rallies, view(spark, sf, ROSTER), view(spark, sf, AUDIT), view(spark, sf, TRACK))


@query("win_18_arrivals", ARRIVALS_SQL + "SELECT * FROM arrivals")
def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    return _arrivals(spark, sf).withColumn("coverage", _r("coverage"))


@query(
    "agg_11_arrival_rates",
    ARRIVALS_SQL
    + """, c AS (SELECT player, count(*) AS samples, count(*) FILTER (WHERE state <> 'excluded') AS eligible, count(*) FILTER (WHERE state IN ('arrived', 'already_present')) AS arrived
  FROM arrivals WHERE is_sample GROUP BY 1)
SELECT player, team, coalesce(samples, 0) AS samples, coalesce(eligible, 0) AS eligible, coalesce(arrived, 0) AS arrived,
  CASE WHEN eligible >= 3 THEN round(arrived / eligible, 6) END AS rate, CASE WHEN eligible >= 3 THEN 'available' ELSE 'insufficient_evidence' END AS status
FROM roster LEFT JOIN c USING (player) WHERE team IS NOT NULL""",
)
def arrival_rates(spark: SparkSession, sf: str) -> DataFrame:
    return arrival.arrival_rates(_arrivals(spark, sf), view(spark, sf, ROSTER)).withColumn("rate", _r("rate"))


@query("agg_11_excluded_reasons", ARRIVALS_SQL + "SELECT reason, count(*) AS n FROM arrivals WHERE reason IS NOT NULL GROUP BY 1")
def excluded_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _arrivals(spark, sf).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
