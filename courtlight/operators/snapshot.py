"""The metric snapshot of a match: counts and mean quality by match, player and team, each with its status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: stages with a count of their own, and shots that a mean quality needs
STAGES = {"serve_count": "serve", "return_count": "return", "third_shot_count": "third"}
LEAST_QUALITY = 3


def _scopes(shots: DataFrame) -> DataFrame:
    """Each shot once for its match, its player and its team; what is not confirmed names players and teams but counts for neither."""
    sure = F.coalesce(F.col("ownership") == "confirmed", F.lit(False))
    row = lambda scope, subject, counts: F.struct(F.lit(scope).alias("scope"), subject.alias("subject"), counts.alias("counts"))
    every = F.array(row("match", F.lit("match"), F.lit(True)), row("player", F.col("player"), sure), row("team", F.col("team"), sure))
    return shots.select("job", "shot_id", "stage", "quality", F.explode(F.filter(every, lambda s: s["subject"].isNotNull())).alias("s")).select("job", "shot_id", "stage", "quality", "s.*")


def evidence(shots: DataFrame) -> DataFrame:
    """job, scope, subject, metric, shot_id: the shots behind each metric, as rows."""
    own = _scopes(shots).filter("counts")
    names = [F.when(F.col("scope").isNotNull(), "shot_count"), *[F.when((F.col("scope") != "team") & (F.col("stage") == s), m) for m, s in STAGES.items()], F.when((F.col("scope") != "team") & F.col("quality").isNotNull(), "shot_quality_mean")]
    return own.select("job", "scope", "subject", F.explode(F.array_compact(F.array(*names))).alias("metric"), "shot_id")


def _entry(metric: Column | str, value: Column, unit: str, samples: Column, status: Column) -> Column:
    name = F.lit(metric) if isinstance(metric, str) else metric
    return F.struct(name.alias("metric"), value.cast("double").alias("value"), F.lit(unit).alias("unit"), samples.cast("long").alias("samples"), status.alias("status"))


def _count(metric: str, n: Column) -> Column:
    return _entry(metric, F.when(n > 0, n), "count", n, F.when(n > 0, "available").otherwise("insufficient_evidence"))


def snapshot(jobs: DataFrame, shots: DataFrame, rallies: DataFrame) -> DataFrame:
    """job, scope, subject, metric, value, unit, samples, status of every metric of every available job.

    jobs: job, status, match_format. shots: job, shot_id, player, team, ownership, stage, quality. rallies: job, rally_id.
    The match has a count of shots, rallies and stages and a mean quality; each player that hit has all but the rallies;
    each team a count of shots. A count of nothing has no value, a mean of fewer than LEAST_QUALITY neither: both are
    insufficient_evidence. Cooperation is not_applicable to singles and unavailable without any team. Jobs that are not
    available give no row; shots of unknown or null jobs count nowhere. Sums of a scope are made before the shuffle, so a
    match with very many shots is no single task's work.
    """
    counts = F.col("counts")
    stage = lambda s: F.count_if(counts & (F.col("stage") == s))
    sums = _scopes(shots).groupBy("job", "scope", "subject").agg(F.count_if(counts).alias("n"), *[stage(s).alias(m) for m, s in STAGES.items()], F.count(F.when(counts, F.col("quality"))).alias("rated"), F.sum(F.when(counts, F.col("quality"))).alias("quality"))
    own = jobs.filter("status = 'available'").select(F.col("job").alias("__job"), "match_format")
    played = rallies.filter("rally_id IS NOT NULL").groupBy(F.col("job").alias("__rallied")).agg(F.countDistinct("rally_id").alias("rallies"))
    named = own.select("__job", F.lit("match").alias("scope"), F.lit("match").alias("subject"))
    others = sums.filter("scope <> 'match'").join(own, F.col("job") == F.col("__job"), "left_semi").select(F.col("job").alias("__job"), "scope", "subject")
    table = named.unionByName(others).join(sums.withColumnsRenamed({"scope": "__scope", "subject": "__subject"}), (F.col("__job") == F.col("job")) & (F.col("scope") == F.col("__scope")) & (F.col("subject") == F.col("__subject")), "left").drop("job", "__scope", "__subject")
    table = table.join(played, F.col("__job") == F.col("__rallied"), "left").drop("__rallied").fillna(0, ["n", "rated", "rallies", *STAGES])
    enough = F.col("rated") >= LEAST_QUALITY
    quality = _entry("shot_quality_mean", F.when(enough, F.round(F.col("quality") / F.col("rated"), 4)), "ratio", F.col("rated"), F.when(enough, "available").otherwise("insufficient_evidence"))
    stages = [_count(m, F.col(m)) for m in STAGES]
    shot_count = _count("shot_count", F.col("n"))
    entries = F.when(F.col("scope") == "match", F.array(shot_count, _count("rally_count", F.col("rallies")), *stages, quality)).when(F.col("scope") == "player", F.array(shot_count, *stages, quality)).otherwise(F.array(shot_count))
    rows = table.select(F.col("__job").alias("job"), "scope", "subject", F.explode(entries).alias("e")).select("job", "scope", "subject", "e.*")
    with_team = sums.filter("scope = 'team'").select(F.col("job").alias("__teamed")).distinct()
    pairs = own.join(with_team, F.col("__job") == F.col("__teamed"), "left")
    singles = F.coalesce(F.col("match_format") == "singles", F.lit(False))
    none = F.lit(None).cast("double")
    together = pairs.filter(singles | F.col("__teamed").isNull()).select(F.col("__job").alias("job"), F.lit("match").alias("scope"), F.lit("match").alias("subject"), _entry("doubles_cooperation", none, "ratio", F.lit(0), F.when(singles, "not_applicable").otherwise("unavailable")).alias("e"))
    return rows.unionByName(together.select("job", "scope", "subject", "e.*"))
