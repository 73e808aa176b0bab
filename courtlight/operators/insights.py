"""Findings by rule: evidence meets a table of rules, every match is a row, and needs for improvement give advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ANY = float("inf")
#: Fixed values, profile v1. rule, kind of subject, metric, metric that must be there too, least and most of what is stable,
#: whether low quality makes it insufficient, what it is outside, priority and confidence then, and whether it is silent inside.
RULES = [
    ("transition_zone_dwell", "player", "transition_occupancy", None, -_ANY, 0.45, True, "needs_improvement", 2, None, False),
    ("kitchen_line_proximity", "player", "avg_distance_to_kitchen_line_m", None, -_ANY, 2.0, True, "needs_improvement", 2, None, False),
    ("movement_load", "player", "distance_ft", "average_speed_ft_per_s", 150.0, _ANY, False, "insufficient_evidence", 3, "low", False),
    ("doubles_spacing_stability", "team", "average_spacing_ft", None, 6.0, 12.0, False, "needs_improvement", 2, "medium", False),
    ("doubles_spacing_extremes", "team", "min_spacing_ft", "average_spacing_ft", 3.0, _ANY, False, "needs_improvement", 2, "medium", True),
    ("doubles_spacing_extremes", "team", "max_spacing_ft", "average_spacing_ft", -_ANY, 16.0, False, "needs_improvement", 2, "medium", True),
]
SCHEMA = "rule string, kind string, metric string, needs string, least double, most double, by_quality boolean, outside string, priority int, confidence string, silent boolean"
COVERED = 0.5
#: Direction of advice, and its target: a factor of the baseline, or less by an offset, or a range.
ADVICE = [
    ("transition_zone_dwell", "decrease", 0.8, None, None, None),
    ("kitchen_line_proximity", "decrease", None, 0.5, None, None),
    ("doubles_spacing_stability", "maintain", None, None, 6.0, 12.0),
    ("doubles_spacing_extremes", "maintain", None, None, None, 16.0),
]


def rule_table(spark: SparkSession, rules: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rules or RULES, SCHEMA)


def _first(evidence: DataFrame) -> DataFrame:
    """The first eligible evidence (by id, then value and quality) of each job, subject and metric."""
    eligible = evidence.filter("eligibility = 'eligible' AND subject IS NOT NULL AND metric IS NOT NULL")
    best = F.min(F.struct("evidence_id", "value", "quality", "kind"))
    return eligible.groupBy("job", "subject", "metric").agg(best.alias("e")).select("job", "subject", "metric", "e.*")


def findings(evidence: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """job, rule, subject, metric, assessment, priority, confidence, value, evidence_id of every rule that has evidence.

    evidence: job, subject, kind (player or team), metric, value, quality, eligibility, evidence_id. Only eligible evidence
    counts, the first of each subject and metric; a null value is zero. A rule needs its metric, and where it names one
    the other metric too. Low quality makes a rule that looks at it insufficient_evidence; else a value in the rule's
    range is stable (or gives nothing where the rule is silent) and one outside is what the rule says. Jobs, subjects and
    metrics without a rule give no row.
    """
    rules = rules if rules is not None else rule_table(evidence.sparkSession)
    first = _first(evidence)
    table = F.broadcast(rules.withColumnsRenamed({"kind": "__kind", "metric": "__metric"}))
    matched = first.join(table, (F.col("kind") == F.col("__kind")) & (F.col("metric") == F.col("__metric")))
    there = first.select(F.col("job").alias("__job"), F.col("subject").alias("__subject"), F.col("metric").alias("__needed"))
    with_other = matched.join(there, F.col("job").eqNullSafe(F.col("__job")) & (F.col("subject") == F.col("__subject")) & (F.col("needs") == F.col("__needed")), "left").filter("needs IS NULL OR __needed IS NOT NULL")
    value = F.coalesce("value", F.lit(0.0))
    poor = F.col("by_quality") & F.coalesce(F.col("quality") == "low", F.lit(False))
    inside = value.between(F.col("least"), F.col("most"))
    told = with_other.filter(~(F.col("silent") & inside & ~poor))
    by_quality = F.when(F.coalesce(F.col("quality") == "high", F.lit(False)), "medium").otherwise("low")
    return told.select(
        "job",
        "rule",
        "subject",
        "metric",
        F.when(poor, "insufficient_evidence").when(inside, "stable").otherwise(F.col("outside")).alias("assessment"),
        F.when(poor | inside, 3).otherwise(F.col("priority")).alias("priority"),
        F.when(poor, "low").when(F.col("by_quality"), by_quality).when(inside, "medium").otherwise(F.col("confidence")).alias("confidence"),
        "value",
        "evidence_id",
    )


def data_quality(evidence: DataFrame, jobs: DataFrame) -> DataFrame:
    """One finding a job on its data: stable where at least half of the trajectories are covered, else insufficient.

    jobs: job, coverage. The evidence that backs it is the match's own, null where there is none.
    """
    own = _first(evidence).filter("subject = 'match' AND metric = 'trajectory_coverage_rate'").select(F.col("job").alias("__job"), "value", "evidence_id")
    good = F.coalesce(F.col("coverage") >= COVERED, F.lit(False))
    return jobs.join(own, F.col("job").eqNullSafe(F.col("__job")), "left").select("job", F.lit("data_coverage_quality").alias("rule"), F.lit("match").alias("subject"), F.lit("trajectory_coverage_rate").alias("metric"), F.when(good, "stable").otherwise("insufficient_evidence").alias("assessment"), F.lit(3).alias("priority"), F.when(good, "medium").otherwise("low").alias("confidence"), "value", "evidence_id")


def advice(found: DataFrame) -> DataFrame:
    """job, rule, subject, metric, direction, baseline, target_low, target_high of findings that need improvement.

    A baseline is the finding's value, and without one there is no advice. Targets: at most a share of the baseline, or a
    fixed step below it but half a metre at least, or a range.
    """
    table = F.broadcast(found.sparkSession.createDataFrame(ADVICE, "__rule string, direction string, factor double, step double, low double, high double"))
    needed = found.filter("assessment = 'needs_improvement' AND value IS NOT NULL").join(table, F.col("rule") == F.col("__rule"))
    high = F.coalesce(F.col("value") * F.col("factor"), F.when(F.col("step").isNotNull(), F.greatest(F.lit(0.5), F.col("value") - F.col("step"))), F.col("high"))
    return needed.select("job", "rule", "subject", "metric", "direction", F.col("value").alias("baseline"), F.col("low").alias("target_low"), high.alias("target_high"))


def primary_focus(found: DataFrame) -> DataFrame:
    """job, rule, subject of the most urgent need for improvement of each job, by priority, rule and subject."""
    best = F.min(F.struct("priority", "rule", "subject"))
    return found.filter("assessment = 'needs_improvement'").groupBy("job").agg(best.alias("b")).select("job", "b.rule", "b.subject")
