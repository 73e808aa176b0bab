"""Registered queries of the metric snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlight.operators import snapshot
from courtlight.plans.registry import query
from courtlight.sources.adapters import plain, view

#: Customers are jobs, their orders rallies, the orders' lines shots.
JOBS = "SELECT c_custkey AS job, CASE WHEN c_custkey % 13 = 0 THEN 'unavailable' WHEN c_custkey % 17 <> 0 THEN 'available' END AS status, CASE c_nationkey % 3 WHEN 0 THEN 'singles' WHEN 1 THEN 'doubles' END AS match_format FROM {customer}"
SHOTS = """SELECT CASE WHEN o_orderkey % 31 <> 0 THEN o_custkey END AS job, l_orderkey * 10 + l_linenumber AS shot_id, CASE WHEN l_partkey % 7 <> 0 THEN 'Player_' || (l_linenumber % 3) END AS player,
  CASE WHEN o_custkey % 5 <> 0 AND l_partkey % 9 <> 0 THEN 'Team_' || (l_linenumber % 2) END AS team, CASE WHEN l_linestatus = 'F' THEN 'confirmed' WHEN l_suppkey % 4 <> 0 THEN 'unassigned' END AS ownership,
  CASE l_partkey % 6 WHEN 0 THEN 'serve' WHEN 1 THEN 'return' WHEN 2 THEN 'third' WHEN 3 THEN 'other' END AS stage, CASE WHEN l_suppkey % 3 <> 0 THEN CAST(CAST(round(l_discount * 100) AS INT) AS DOUBLE) / 97 END AS quality
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""
RALLIES = "SELECT o_custkey AS job, CASE WHEN o_orderkey % 6 <> 0 THEN 'r' || (o_orderkey % 100) END AS rally_id FROM {orders}"

STATUS = "CASE WHEN {0} > 0 THEN 'available' ELSE 'insufficient_evidence' END"
SNAPSHOT_SQL = f"""
WITH j AS (SELECT * FROM ({plain(JOBS)}) WHERE status = 'available'), s AS (SELECT * FROM ({plain(SHOTS)}) WHERE job IN (SELECT job FROM j)),
x AS (
  SELECT job, 'match' AS scope, 'match' AS subject, stage, quality, true AS counts FROM s
  UNION ALL SELECT job, 'player', player, stage, quality, coalesce(ownership = 'confirmed', false) FROM s WHERE player IS NOT NULL
  UNION ALL SELECT job, 'team', team, stage, quality, coalesce(ownership = 'confirmed', false) FROM s WHERE team IS NOT NULL
  UNION ALL SELECT job, 'match', 'match', NULL, NULL, false FROM j),
g AS (SELECT job, scope, subject, count(*) FILTER (WHERE counts) AS n, count(*) FILTER (WHERE counts AND stage = 'serve') AS n1, count(*) FILTER (WHERE counts AND stage = 'return') AS n2,
  count(*) FILTER (WHERE counts AND stage = 'third') AS n3, count(quality) FILTER (WHERE counts) AS nq, avg(quality) FILTER (WHERE counts) AS q FROM x GROUP BY ALL),
r AS (SELECT job, count(DISTINCT rally_id) AS n FROM ({plain(RALLIES)}) GROUP BY 1),
m AS (
  SELECT job, scope, subject, 'shot_count' AS metric, n AS k, 'count' AS unit FROM g UNION ALL SELECT j.job, 'match', 'match', 'rally_count', coalesce(r.n, 0), 'count' FROM j LEFT JOIN r USING (job)
  UNION ALL SELECT job, scope, subject, 'serve_count', n1, 'count' FROM g WHERE scope <> 'team' UNION ALL SELECT job, scope, subject, 'return_count', n2, 'count' FROM g WHERE scope <> 'team'
  UNION ALL SELECT job, scope, subject, 'third_shot_count', n3, 'count' FROM g WHERE scope <> 'team')
SELECT job, scope, subject, metric, CASE WHEN k > 0 THEN CAST(k AS DOUBLE) END AS value, unit, k AS samples, {STATUS.format('k')} AS status FROM m
UNION ALL SELECT job, scope, subject, 'shot_quality_mean', CASE WHEN nq >= 3 THEN round(q, 4) END, 'ratio', nq, CASE WHEN nq >= 3 THEN 'available' ELSE 'insufficient_evidence' END FROM g WHERE scope <> 'team'
UNION ALL SELECT job, 'match', 'match', 'doubles_cooperation', NULL, 'ratio', 0, CASE WHEN match_format = 'singles' THEN 'not_applicable' ELSE 'unavailable' END
  FROM j WHERE coalesce(match_format = 'singles', false) OR job NOT IN (SELECT job FROM g WHERE scope = 'team')"""


@query("agg_08_snapshot", SNAPSHOT_SQL)
def metric_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot.snapshot(view(spark, sf, JOBS), view(spark, sf, SHOTS), view(spark, sf, RALLIES))


@query(
    "agg_08_evidence",
    f"""WITH s AS ({plain(SHOTS)}), x AS (
  SELECT job, 'match' AS scope, 'match' AS subject, stage, quality, shot_id FROM s UNION ALL SELECT job, 'player', player, stage, quality, shot_id FROM s WHERE player IS NOT NULL AND ownership = 'confirmed'
  UNION ALL SELECT job, 'team', team, stage, quality, shot_id FROM s WHERE team IS NOT NULL AND ownership = 'confirmed'),
e AS (SELECT *, 'shot_count' AS metric FROM x UNION ALL SELECT *, CASE stage WHEN 'serve' THEN 'serve_count' WHEN 'return' THEN 'return_count' ELSE 'third_shot_count' END FROM x WHERE scope <> 'team' AND stage IN ('serve', 'return', 'third')
  UNION ALL SELECT *, 'shot_quality_mean' FROM x WHERE scope <> 'team' AND quality IS NOT NULL)
SELECT job, scope, subject, metric, count(*) AS shots, CAST(sum(shot_id) AS BIGINT) AS ids FROM e GROUP BY ALL""",
)
def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The shots behind each metric, counted and summed by id."""
    return snapshot.evidence(view(spark, sf, SHOTS)).groupBy("job", "scope", "subject", "metric").agg(F.count("*").alias("shots"), F.sum("shot_id").alias("ids"))
