"""Registered queries of findings: rules over evidence, advice, the first thing to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from courtlight.operators import insights
from courtlight.plans.registry import _r, query
from courtlight.sources.adapters import plain, view

#: Order lines are evidence of a part's job: players and a team, some of it missing, of low quality or not eligible.
EVIDENCE = """SELECT l_partkey AS job, CASE WHEN l_suppkey % 8 IN (3, 5, 7) THEN 'Team_A' WHEN l_suppkey % 8 = 6 THEN 'match' ELSE 'Player_' || (l_linenumber % 2) END AS subject,
  CASE WHEN l_suppkey % 8 IN (3, 5, 7) THEN 'team' WHEN l_suppkey % 8 = 6 THEN 'match' ELSE 'player' END AS kind,
  CASE l_suppkey % 8 WHEN 0 THEN 'transition_occupancy' WHEN 1 THEN 'avg_distance_to_kitchen_line_m' WHEN 2 THEN 'distance_ft' WHEN 3 THEN 'average_spacing_ft' WHEN 4 THEN 'average_speed_ft_per_s'
    WHEN 5 THEN 'min_spacing_ft' WHEN 6 THEN 'trajectory_coverage_rate' ELSE 'max_spacing_ft' END AS metric,
  CASE WHEN l_orderkey % 13 <> 0 THEN CAST(l_quantity AS DOUBLE) / CASE l_suppkey % 8 WHEN 0 THEN 50 WHEN 1 THEN 12 WHEN 2 THEN 0.1 WHEN 5 THEN 9 WHEN 6 THEN 50 ELSE 2.5 END END AS value,
  CASE l_returnflag WHEN 'R' THEN 'low' WHEN 'A' THEN 'high' ELSE 'medium' END AS quality, CASE WHEN l_linestatus = 'F' OR l_orderkey % 2 = 0 THEN 'eligible' ELSE 'display_only' END AS eligibility,
  l_orderkey * 10 + l_linenumber AS evidence_id FROM {lineitem}"""
JOBS = "SELECT p_partkey AS job, CASE WHEN p_partkey % 5 <> 0 THEN p_size / 50.0 END AS coverage FROM {part}"

FINDINGS_SQL = f"""
WITH e AS (SELECT * FROM ({plain(EVIDENCE)}) WHERE eligibility = 'eligible' QUALIFY row_number() OVER (PARTITION BY job, subject, metric ORDER BY evidence_id, value NULLS FIRST, quality) = 1),
v AS (SELECT *, coalesce(value, 0) AS x, CASE WHEN quality = 'high' THEN 'medium' ELSE 'low' END AS by_quality FROM e),
found AS (
  SELECT job, 'transition_zone_dwell' AS rule, subject, metric, CASE WHEN quality = 'low' THEN 'insufficient_evidence' WHEN x > 0.45 THEN 'needs_improvement' ELSE 'stable' END AS assessment,
    CASE WHEN quality <> 'low' AND x > 0.45 THEN 2 ELSE 3 END AS priority, by_quality AS confidence, value, evidence_id FROM v WHERE metric = 'transition_occupancy'
  UNION ALL SELECT job, 'kitchen_line_proximity', subject, metric, CASE WHEN quality = 'low' THEN 'insufficient_evidence' WHEN x > 2 THEN 'needs_improvement' ELSE 'stable' END,
    CASE WHEN quality <> 'low' AND x > 2 THEN 2 ELSE 3 END, by_quality, value, evidence_id FROM v WHERE metric = 'avg_distance_to_kitchen_line_m'
  UNION ALL SELECT v.job, 'movement_load', v.subject, v.metric, CASE WHEN x < 150 THEN 'insufficient_evidence' ELSE 'stable' END, 3, CASE WHEN x < 150 THEN 'low' ELSE 'medium' END, v.value, v.evidence_id
    FROM v JOIN e o ON o.job = v.job AND o.subject = v.subject AND o.metric = 'average_speed_ft_per_s' WHERE v.metric = 'distance_ft'
  UNION ALL SELECT job, 'doubles_spacing_stability', subject, metric, CASE WHEN x BETWEEN 6 AND 12 THEN 'stable' ELSE 'needs_improvement' END, CASE WHEN x BETWEEN 6 AND 12 THEN 3 ELSE 2 END, 'medium', value, evidence_id
    FROM v WHERE metric = 'average_spacing_ft'
  UNION ALL SELECT v.job, 'doubles_spacing_extremes', v.subject, v.metric, 'needs_improvement', 2, 'medium', v.value, v.evidence_id
    FROM v JOIN e o ON o.job = v.job AND o.subject = v.subject AND o.metric = 'average_spacing_ft' WHERE (v.metric = 'min_spacing_ft' AND x < 3) OR (v.metric = 'max_spacing_ft' AND x > 16)
  UNION ALL SELECT j.job, 'data_coverage_quality', 'match', 'trajectory_coverage_rate', CASE WHEN coverage >= 0.5 THEN 'stable' ELSE 'insufficient_evidence' END, 3, CASE WHEN coverage >= 0.5 THEN 'medium' ELSE 'low' END, v.value, v.evidence_id
    FROM ({plain(JOBS)}) j LEFT JOIN v ON v.job = j.job AND v.subject = 'match')
"""


def _found(spark: SparkSession, sf: str) -> DataFrame:
    evidence = view(spark, sf, EVIDENCE)
    return insights.findings(evidence).unionByName(insights.data_quality(evidence, view(spark, sf, JOBS)))


@query("prj_25_findings", FINDINGS_SQL + "SELECT * EXCLUDE (value), round(value, 6) AS value FROM found")
def findings(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf).withColumn("value", _r("value"))


@query(
    "udf_03_advice",
    FINDINGS_SQL
    + """SELECT job, rule, subject, metric, CASE WHEN rule IN ('transition_zone_dwell', 'kitchen_line_proximity') THEN 'decrease' ELSE 'maintain' END AS direction, round(value, 6) AS baseline,
  CASE rule WHEN 'doubles_spacing_stability' THEN 6.0 END AS target_low,
  round(CASE rule WHEN 'transition_zone_dwell' THEN value * 0.8 WHEN 'kitchen_line_proximity' THEN greatest(0.5, value - 0.5) WHEN 'doubles_spacing_stability' THEN 12 ELSE 16 END, 6) AS target_high
FROM found WHERE assessment = 'needs_improvement' AND value IS NOT NULL""",
)
def advice(spark: SparkSession, sf: str) -> DataFrame:
    return insights.advice(_found(spark, sf)).withColumns({c: _r(c) for c in ("baseline", "target_high")})


@query("udf_03_primary_focus", FINDINGS_SQL + "SELECT job, rule, subject FROM found WHERE assessment = 'needs_improvement' QUALIFY row_number() OVER (PARTITION BY job ORDER BY priority, rule, subject) = 1")
def primary_focus(spark: SparkSession, sf: str) -> DataFrame:
    return insights.primary_focus(_found(spark, sf))
