"""Registered queries of two cameras' time line and of how runs went."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlight.operators import observability, pairing
from courtlight.plans.registry import _r, query
from courtlight.sources.adapters import plain, view

#: Clicks and views are what two cameras see, a frame an event; the second clock runs faster, some takes have none or a part.
SEEN = """SELECT user_id % 5 AS take, CASE WHEN event_id % 71 <> 0 THEN event_id - event_id % {1} END AS frame, CAST({2} AS DOUBLE) AS t, CASE WHEN event_id % 17 <> 0 THEN 'P' || (event_id % 4) END AS player,
  CAST(event_id * 37 % 200 / 10.0 AS DOUBLE) AS x, CASE WHEN event_id % 19 <> 0 THEN CAST(event_id * 53 % 440 / 10.0 AS DOUBLE) END AS y FROM {{events}} WHERE event_type = '{0}'"""
REFERENCE = SEEN.format("click", 2, "(event_id - event_id % 2) / 50.0")
SECONDARY = SEEN.format("view", 1, "event_id / 49.5 + 0.3 + event_id % 7 / 20.0")
CLOCKS = """SELECT CAST(r_regionkey AS BIGINT) AS take, CAST(0.3 AS DOUBLE) AS "offset", CAST(CASE r_regionkey WHEN 2 THEN 1.2 ELSE 1.0101 END AS DOUBLE) AS rate, CAST(CASE r_regionkey WHEN 1 THEN 3.0 END AS DOUBLE) AS valid_from,
  CAST(CASE r_regionkey WHEN 1 THEN 80.0 WHEN 3 THEN 15.0 END AS DOUBLE) AS valid_to FROM {region} WHERE r_regionkey <> 4"""

PLAN_SQL = f"""
WITH r AS ({plain(REFERENCE)}), s AS ({plain(SECONDARY)}), c AS ({plain(CLOCKS)}),
rf AS (SELECT take, frame, min(t) AS t FROM r WHERE frame IS NOT NULL GROUP BY ALL), sf AS (SELECT take, frame, min(t) AS t FROM s WHERE frame IS NOT NULL GROUP BY ALL),
m AS (SELECT take, min(t) AS from_t, max(t) AS to_t FROM sf GROUP BY 1),
g AS (SELECT rf.take, rf.frame, rf.t, "offset" + rate * rf.t AS mapped, valid_from, valid_to, from_t, to_t FROM rf LEFT JOIN c USING (take) LEFT JOIN m USING (take)),
n AS (SELECT g.take, g.frame, arg_min({{'frame': sf.frame, 't': sf.t}}, {{'e': abs(sf.t - mapped), 't': sf.t, 'f': CASE WHEN sf.t >= mapped THEN sf.frame ELSE -sf.frame END}}) AS near FROM g JOIN sf ON sf.take = g.take WHERE mapped IS NOT NULL GROUP BY ALL),
h AS (SELECT g.*, near, near.t - mapped AS error, CASE WHEN mapped IS NULL OR from_t IS NULL THEN 'unavailable' WHEN t < valid_from OR t > valid_to THEN 'unavailable_outside_valid_interval'
    WHEN mapped < from_t OR mapped > to_t THEN 'unavailable_out_of_media_range' WHEN abs(near.t - mapped) > 1.0 / 10 THEN 'unavailable_selection_error' ELSE 'ok' END AS st FROM g LEFT JOIN n USING (take, frame)),
b AS (SELECT *, st = 'ok' AND coalesce(near.frame < max(CASE WHEN st = 'ok' THEN near.frame END) OVER (PARTITION BY take ORDER BY t, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS back FROM h),
plan AS (SELECT take, frame, t, CASE WHEN st = 'ok' AND NOT back THEN near.frame END AS secondary_frame, CASE WHEN st = 'ok' AND NOT back THEN near.t END AS secondary_t, mapped AS mapped_t,
  CASE WHEN st IN ('ok', 'unavailable_selection_error') AND NOT back THEN error * 1000 END AS error_ms, CASE WHEN back THEN 'non_monotonic' ELSE st END AS status FROM b)
"""


def _planned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    reference, secondary = view(spark, sf, REFERENCE), view(spark, sf, SECONDARY)
    return reference, secondary, pairing.plan(reference, secondary, view(spark, sf, CLOCKS.replace('"offset"', "`offset`")), 0.1)


@query("jon_04_frame_plan", PLAN_SQL + "SELECT take, frame, round(t, 6) AS t, secondary_frame, round(secondary_t, 6) AS secondary_t, round(mapped_t, 6) AS mapped_t, round(error_ms, 3) AS error_ms, status FROM plan")
def frame_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _planned(spark, sf)[2].withColumns({**{c: _r(c) for c in ("t", "secondary_t", "mapped_t")}, "error_ms": _r("error_ms", 3)})


@query(
    "jon_06_timeline",
    PLAN_SQL
    + """, o AS (SELECT take, frame, player, t, 20 - x AS x, 44 - y AS y FROM s WHERE frame IS NOT NULL QUALIFY row_number() OVER (PARTITION BY take, frame ORDER BY player IS NULL, player, t) = 1)
SELECT r.take, r.frame, round(r.t, 6) AS t, r.player, CASE WHEN o.take IS NULL THEN 'unavailable' ELSE 'available' END AS view_status, round(r.x, 6) AS x, round(r.y, 6) AS y,
  CASE WHEN o.take IS NOT NULL THEN p.secondary_frame END AS other_frame, o.player AS other_player, round(o.x, 6) AS other_x, round(o.y, 6) AS other_y, CASE WHEN o.take IS NOT NULL THEN round(p.error_ms, 3) END AS error_ms
FROM r LEFT JOIN plan p ON p.take = r.take AND p.frame = r.frame AND p.status = 'ok' LEFT JOIN o ON o.take = r.take AND o.frame = p.secondary_frame""",
)
def timeline_of_views(spark: SparkSession, sf: str) -> DataFrame:
    reference, secondary, planned = _planned(spark, sf)
    found = pairing.timeline(reference, secondary, planned, {"reference": "identity", "secondary": "rotate_180"})
    return found.withColumns({**{c: _r(c) for c in ("t", "x", "y", "other_x", "other_y")}, "error_ms": _r("error_ms", 3)})


#: Guidance and observations of a run, a dozen events a tick.
GUIDANCE = """SELECT user_id % 3 AS run, CAST(floor(event_id / 12) AS BIGINT) AS tick, event_id AS seq, CAST(floor(event_id / 12) AS BIGINT) * 33 AS t_ms,
  CASE WHEN event_id % 23 <> 0 THEN 'e' || CAST(floor(event_id / 90) AS BIGINT) || '-' || (event_id % 3) END AS episode, CASE WHEN event_id % 41 <> 0 THEN 'g' || (event_id % 4) END AS player, 'cam_' || (event_id % 2) AS donor, 'cam_' || (1 - event_id % 2) AS target,
  CASE WHEN event_id % 5 = 0 THEN event_id % 2 END AS pre_gate, CASE WHEN event_id % 35 = 0 THEN 1 END AS "lock" FROM {events} WHERE event_type IN ('click', 'view')"""
SIGHTINGS = """SELECT user_id % 3 AS run, CAST(floor(event_id / 12) AS BIGINT) AS tick, CAST(floor(event_id / 12) AS BIGINT) * 33 AS t_ms, CASE WHEN event_id % 43 <> 0 THEN 'g' || (event_id * 7 % 4) END AS player, 'cam_' || (event_id % 2) AS "view",
  CASE event_id % 9 WHEN 0 THEN 'base' WHEN 1 THEN 'tracker' ELSE 'guided_roi' END AS origin, CASE WHEN event_id % 4 <> 3 THEN 'g' || (event_id % 3) END AS expected FROM {events} WHERE event_type = 'error'"""


@query(
    "agg_28_recovery_episodes",
    f"""WITH g AS (SELECT * FROM ({plain(GUIDANCE)}) WHERE episode IS NOT NULL), o AS ({plain(SIGHTINGS)}),
f AS (SELECT run, episode, tick, player, donor, target FROM g QUALIFY row_number() OVER (PARTITION BY run, episode ORDER BY tick, seq) = 1),
hits AS (
  SELECT f.run, f.episode, o.tick, o.t_ms, CASE WHEN o.player = f.player AND o.origin = 'base' THEN 0 WHEN o.player = f.player AND o.origin = 'guided_roi' AND o.expected = f.player THEN 1
    WHEN o.origin = 'guided_roi' AND o.expected = f.player AND o.player IS DISTINCT FROM f.player THEN 2 END AS rank
  FROM f JOIN o ON o.run = f.run AND o."view" = f.target AND o.tick >= f.tick),
c AS (SELECT * FROM hits WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run, episode ORDER BY tick, rank) = 1),
k AS (SELECT g.*, c.tick AS close, c.t_ms AS close_ms, rank, row_number() OVER (PARTITION BY g.run, g.episode, g.tick ORDER BY seq) AS nth FROM g LEFT JOIN c ON c.run = g.run AND c.episode = g.episode)
SELECT k.run, k.episode, f.player, f.donor, f.target, min(k.t_ms) AS start_ms, greatest(max(k.t_ms), coalesce(max(close_ms), 0)) AS end_ms, count(*) AS attempts,
  CAST(coalesce(sum(pre_gate), 0) AS BIGINT) AS pre_gate, CAST(coalesce(sum("lock"), 0) AS BIGINT) AS "lock",
  CASE max(rank) WHEN 0 THEN 'base_recovered' WHEN 1 THEN 'guided_recovery_success' WHEN 2 THEN 'global_mismatch' ELSE CASE WHEN sum("lock") > 0 THEN 'lock_rejected' WHEN sum(pre_gate) > 0 THEN 'pre_gate_rejected' ELSE 'guidance_failed' END END AS outcome
FROM k JOIN f USING (run, episode) WHERE close IS NULL OR k.tick < close OR (k.tick = close AND nth = 1) GROUP BY k.run, k.episode, f.player, f.donor, f.target""",
)
def recovery_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return observability.recovery_episodes(view(spark, sf, GUIDANCE.replace('"lock"', "`lock`")), view(spark, sf, SIGHTINGS.replace('"view"', "`view`")))


#: A run is a customer, its domains are orders.
RUNS = "SELECT c_custkey AS run, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal / 8000 END AS ratio, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 11 / 10.0 END AS recovery FROM {customer}"
DOMAINS = """SELECT o_custkey AS run, CASE o_orderkey % 6 WHEN 0 THEN 'fusion' WHEN 1 THEN 'recovery' WHEN 2 THEN 'players' WHEN 3 THEN 'ball' ELSE 'sync' END AS domain,
  CASE o_orderstatus WHEN 'O' THEN 'available' WHEN 'F' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'not_applicable' ELSE 'partial' END ELSE CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'unavailable' END END AS availability FROM {orders}"""


@query(
    "ts_10_health_score",
    f"""WITH r AS ({plain(RUNS)}), d AS (SELECT run, domain, max(availability) AS a FROM ({plain(DOMAINS)}) GROUP BY ALL),
w AS (SELECT run, sum(CASE a WHEN 'available' THEN 10 WHEN 'partial' THEN 6 WHEN 'unavailable' THEN 0 END) / nullif(10 * count(CASE WHEN a IN ('available', 'partial', 'unavailable') THEN 1 END), 0) AS base, count(CASE WHEN a IN ('available', 'partial', 'unavailable') THEN 1 END) AS applicable,
  max(a) FILTER (WHERE domain = 'fusion') AS fusion, max(a) FILTER (WHERE domain = 'recovery') AS recovered FROM d GROUP BY 1),
n AS (SELECT r.run, coalesce(base, 0) AS base, coalesce(applicable, 0) AS applicable,
  coalesce(CASE WHEN ratio IS NOT NULL THEN greatest(0, least(1, ratio)) END, CASE fusion WHEN 'not_applicable' THEN 1 WHEN 'available' THEN 0.5 WHEN 'partial' THEN 0.3 ELSE 0 END) AS f,
  coalesce(CASE WHEN recovery IS NOT NULL THEN greatest(0, least(1, recovery)) END, CASE recovered WHEN 'not_applicable' THEN 1 WHEN 'available' THEN 0.5 WHEN 'partial' THEN 0.3 ELSE 0 END) AS v FROM r LEFT JOIN w USING (run))
SELECT run, CAST(floor(100 * (CAST(0.5 AS DOUBLE) * base + CAST(0.25 AS DOUBLE) * f + CAST(0.25 AS DOUBLE) * v) + 0.5) AS BIGINT) AS score, applicable FROM n""",
)
def health_score(spark: SparkSession, sf: str) -> DataFrame:
    return observability.health_scores(view(spark, sf, RUNS), view(spark, sf, DOMAINS))


#: An order's events of its stages: mostly in order, some early, late, repeated or of no known stage.
_NAMES = list(observability.STAGES)
STAGE_EVENTS = f"""SELECT user_id AS job, event_id AS seq, CASE event_id * 7 % 13 {" ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate([*_NAMES, *_NAMES[:4], "other"]))} ELSE '{_NAMES[0]}' END AS stage,
  CASE event_id % 8 WHEN 0 THEN 'done' WHEN 1 THEN 'skipped' WHEN 2 THEN 'done' WHEN 3 THEN 'failed' WHEN 4 THEN NULL ELSE 'active' END AS status, CASE WHEN event_id % 9 <> 0 THEN CAST(event_id % 120 - 5 AS INT) END AS progress FROM {{events}}"""
_SHARE = "CASE WHEN s.st IN ('done', 'skipped') THEN 1.0 WHEN s.st IN ('active', 'failed', 'canceled') THEN greatest(0, least(1, s.p / 100)) ELSE 0 END"


@query(
    "str_11_progress",
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seq) AS n, list_position([{", ".join(f"'{n}'" for n in _NAMES)}], stage) AS at_ FROM ({plain(STAGE_EVENTS)})),
r AS (
  SELECT job, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, false AS accepted, [{", ".join("{'st': 'pending', 'p': 0}" for _ in _NAMES)}] AS stages, 0 AS progress FROM (SELECT DISTINCT job FROM e)
  UNION ALL
  SELECT job, n, seq, ok, kept, greatest(progress, CAST(round_even(list_sum(list_transform(kept, lambda s, i: [{", ".join(map(str, observability.STAGES.values()))}][i] * ({_SHARE}))), 0) AS INT))
  FROM (SELECT *, CASE WHEN ok THEN after ELSE stages END AS kept
  FROM (SELECT *, after IS NOT NULL AND len(list_filter(after, lambda s: s.st = 'active')) <= 1 AND coalesce(list_position(list_transform(after, lambda s: s.st), 'active') = 0
      OR len(list_filter(after, lambda s, i: (i < list_position(list_transform(after, lambda z: z.st), 'active') AND s.st NOT IN ('done', 'skipped', 'failed', 'canceled'))
        OR (i > list_position(list_transform(after, lambda z: z.st), 'active') AND s.st <> 'pending'))) = 0, true) AS ok
  FROM (SELECT r.job, e.n, e.seq, r.stages, r.progress, CASE WHEN e.at_ IS NOT NULL AND e.at_ > 0 AND e.status IS NOT NULL THEN list_transform(r.stages, lambda s, i:
      CASE WHEN i = e.at_ THEN {{'st': e.status, 'p': CASE WHEN e.status IN ('done', 'skipped') THEN 100 ELSE greatest(0, least(100, coalesce(e.progress, 0))) END}}
        WHEN i < e.at_ AND s.st = 'active' THEN {{'st': 'done', 'p': 100}} WHEN i > e.at_ AND e.status = 'active' AND s.st <> 'pending' THEN {{'st': 'pending', 'p': 0}} ELSE s END) END AS after
    FROM r JOIN e ON e.job = r.job AND e.n = r.n + 1))))
SELECT job, seq, accepted, array_to_string(list_transform(stages, lambda s: s.st || ':' || s.p), ' ') AS stages, progress FROM r WHERE n > 0""",
)
def progress(spark: SparkSession, sf: str) -> DataFrame:
    return observability.progress(view(spark, sf, STAGE_EVENTS))
