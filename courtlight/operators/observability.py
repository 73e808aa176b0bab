"""How a run went: recovery episodes, a health score, the progress of stages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: what may close an episode, the strongest first, and what a failure is called
OUTCOMES = ("base_recovered", "guided_recovery_success", "global_mismatch")


def recovery_episodes(guidance: DataFrame, observations: DataFrame) -> DataFrame:
    """One row an episode: run, episode, player, donor, target, start_ms, end_ms, attempts, pre_gate, lock, outcome.

    guidance: run, tick, seq, t_ms, episode, player, donor, target, pre_gate, lock (rejections counted in the tick).
    observations: run, tick, t_ms, player, view, origin (base or guided_roi), expected. An episode is about the player and
    target view of its first row, by tick and seq. The first tick from there on closes it in which that view has the
    player by itself (base), by guidance that expected that player, or, by guidance, another one instead; this is also the
    order within a tick. Rows count up to the close, in its tick only the first of the episode. An episode that never
    closes ends with its last row: lock_rejected or pre_gate_rejected if there were any, else guidance_failed. Rows
    without an episode or a tick are left out; null players and views close nothing.
    """
    own = guidance.filter("episode IS NOT NULL AND tick IS NOT NULL")
    place = F.struct("tick", "seq")
    first = own.groupBy("run", "episode").agg(F.min_by(F.struct("tick", "player", "donor", "target"), place).alias("first"))
    first = first.select("run", "episode", "first.*")
    base, guided = F.col("origin") == "base", F.col("origin") == "guided_roi"
    hits = observations.filter("tick IS NOT NULL").select(
        "run",
        "tick",
        "t_ms",
        "view",
        F.explode(F.array(F.struct(F.col("player").alias("about"), F.when(base, 0).when(guided & (F.col("expected") == F.col("player")), 1).alias("rank")), F.struct(F.col("expected").alias("about"), F.when(guided & ~F.col("player").eqNullSafe(F.col("expected")), 2).alias("rank")))).alias("hit"),
    )
    closers = hits.select("run", "tick", "view", "hit.about", "hit.rank", "t_ms").filter("rank IS NOT NULL AND about IS NOT NULL AND view IS NOT NULL")
    closers = closers.groupBy("run", "view", "about", "tick").agg(F.min(F.struct("rank", "t_ms")).alias("c")).select("run", "view", "about", "tick", F.struct("tick", "c.rank", "c.t_ms").alias("close"))
    # the first closer at or behind each episode's first tick: both in one order from behind, the last one read so far
    asked = first.select("run", F.col("target").alias("view"), F.col("player").alias("about"), "tick", "episode", F.lit(None).cast(closers.schema["close"].dataType).alias("close"))
    line = closers.withColumn("episode", F.lit(None).cast(asked.schema["episode"].dataType)).unionByName(asked)
    from_behind = W.partitionBy("run", "view", "about").orderBy(F.col("tick").desc(), F.col("episode").isNull().desc())
    ahead = F.last("close", ignorenulls=True).over(from_behind.rowsBetween(W.unboundedPreceding, W.currentRow))
    closed = line.withColumn("closed", F.when(F.col("view").isNotNull() & F.col("about").isNotNull(), ahead)).filter("episode IS NOT NULL").select(F.col("run").alias("__run"), F.col("episode").alias("__episode"), "closed")
    rows = own.join(closed, F.col("run").eqNullSafe(F.col("__run")) & (F.col("episode") == F.col("__episode")))
    nth = F.row_number().over(W.partitionBy("run", "episode", "tick").orderBy("seq"))
    end = F.col("closed.tick")
    counted = rows.withColumn("nth", nth).filter(end.isNull() | (F.col("tick") < end) | ((F.col("tick") == end) & (F.col("nth") == 1)))
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("long").alias(c)
    found = counted.groupBy("run", "episode").agg(F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("last_ms"), F.count("*").alias("attempts"), total("pre_gate"), total("lock"), F.first("closed").alias("closed"))
    failed = F.when(F.col("lock") > 0, "lock_rejected").when(F.col("pre_gate") > 0, "pre_gate_rejected").otherwise("guidance_failed")
    named = F.lit(None).cast("string")
    for rank, name in enumerate(OUTCOMES):
        named = F.when(F.col("closed.rank") == rank, name).otherwise(named)
    about = first.select(F.col("run").alias("__run"), F.col("episode").alias("__episode"), "player", "donor", "target")
    return found.join(about, F.col("run").eqNullSafe(F.col("__run")) & (F.col("episode") == F.col("__episode"))).select("run", "episode", "player", "donor", "target", "start_ms", F.greatest("last_ms", "closed.t_ms").alias("end_ms"), "attempts", "pre_gate", "lock", F.coalesce(named, failed).alias("outcome"))


def _tenths(availability: Column) -> Column:
    """The weight of a domain in tenths, whole so that sums don't depend on the order."""
    return F.when(availability == "available", 10).when(availability == "partial", 6).when(availability == "unavailable", 0)


def health_scores(runs: DataFrame, domains: DataFrame) -> DataFrame:
    """run, score (0 to 100), applicable of each run: half its domains' health, a quarter each for fusion and recovery.

    runs: run, ratio, recovery (shares, null if unknown). domains: run, domain, availability. A domain weighs 1 if
    available, 0.6 if partial, 0 if unavailable; others, not applicable ones too, don't count, and no domain that
    counts gives 0. An unknown share is neutral by its own domain (fusion, recovery): 1 if not applicable, 0.5, 0.3 or 0;
    known ones are cut to 0 to 1. Of a domain stated twice the larger name counts. Halves round up.
    """
    one = domains.groupBy("run", "domain").agg(F.max("availability").alias("availability"))
    at = lambda name: F.max(F.when(F.col("domain") == name, F.col("availability")))
    weights = one.withColumn("w", _tenths(F.col("availability"))).groupBy(F.col("run").alias("__run")).agg((F.sum("w") / F.nullif(10 * F.count("w"), F.lit(0).cast("long"))).alias("base"), F.count("w").alias("applicable"), at("fusion").alias("fusion"), at("recovery").alias("recovered"))
    own = runs.join(weights, F.col("run").eqNullSafe(F.col("__run")), "left")

    def share(value: str, availability: str) -> Column:
        a = F.col(availability)
        neutral = F.when(a == "not_applicable", 1.0).when(a == "available", 0.5).when(a == "partial", 0.3).otherwise(0.0)
        return F.when(F.col(value).isNull(), neutral).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value))))

    score = 100 * (0.5 * F.coalesce("base", F.lit(0.0)) + 0.25 * share("ratio", "fusion") + 0.25 * share("recovery", "recovered"))
    return own.select("run", F.floor(score + 0.5).cast("long").alias("score"), F.coalesce("applicable", F.lit(0)).alias("applicable"))


# fixed values: stages of a joint run and their weights; what ends a stage
STAGES = {"multiview-input-check": 5, "multiview-joint": 50, "multiview-ball-analysis": 12, "multiview-metrics": 15, "multiview-visualization": 10, "multiview-report": 8}
DONE, ENDED = ("done", "skipped"), ("done", "skipped", "failed", "canceled")


def merged_stage(stages: list[tuple[str, int]], at: int, status: str, progress: int) -> list[tuple[str, int]] | None:
    """Stages (status, progress) after an event, or None where it may not come: an active stage needs all before it ended.

    An active stage ends active ones before it and resets whatever stands behind it; an ended one ends those before it.
    """
    share = 100 if status in DONE else max(0, min(100, progress)) if status in ("active", *ENDED) else progress
    out = list(stages)
    out[at] = status, share
    for i, (other, _) in enumerate(stages):
        if i < at and other == "active" and status in ("active", *ENDED):
            out[i] = "done", 100
        elif i > at and status == "active" and other != "pending":
            out[i] = "pending", 0
    active = [i for i, s in enumerate(out) if s[0] == "active"]
    if len(active) > 1 or (active and (any(s[0] not in ENDED for s in out[: active[0]]) or any(s[0] != "pending" for s in out[active[0] + 1 :]))):
        return None
    return out


def overall(stages: list[tuple[str, int]], weights: list[int]) -> int:
    """Weighted share of the stages, rounded half to even.

    Doubles are added one by one in order of the stages, as SQL adds them: sum() makes up for what rounding loses, and so
    falls on another side of a half at times.
    """
    shares = [1.0 if s in DONE else max(0.0, min(1.0, p / 100)) if s in ("active", "failed", "canceled") else 0.0 for s, p in stages]
    total = 0.0
    for w, x in zip(weights, shares, strict=True):
        total += w * x
    return round(total)


def progress(events: DataFrame, graph: dict[str, int] | None = None) -> DataFrame:
    """job, seq, accepted, stages (status:progress of each, in order), progress behind each event of a job.

    events: job, seq, stage, status, progress (null: 0). Events come in order of seq, stage and status; one of an unknown
    stage, or that may not come, changes nothing. Progress never falls. A job's events are read one by one by one task.
    """
    graph = graph or STAGES
    names, weights = list(graph), list(graph.values())
    kind, seq = events.schema["job"].dataType.simpleString(), events.schema["seq"].dataType.simpleString()
    own = events.select("job", "seq", "stage", "status", F.coalesce("progress", F.lit(0)).cast("int").alias("progress")).repartition("job").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("job", "seq", "stage", "status", "progress")])

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, stages, most = None, None, 0
        for batch in batches:
            accepted, shown, total = [], [], []
            for row in batch.to_pylist():
                if stages is None or row["job"] != job:
                    job, stages, most = row["job"], [("pending", 0)] * len(names), 0
                after = merged_stage(stages, names.index(row["stage"]), row["status"], row["progress"]) if row["stage"] in graph and row["status"] is not None else None
                stages = after or stages
                most = max(most, min(100, overall(stages, weights)))
                accepted.append(after is not None)
                shown.append(" ".join(f"{s}:{p}" for s, p in stages))
                total.append(most)
            yield pa.RecordBatch.from_arrays([batch["job"], batch["seq"], pa.array(accepted), pa.array(shown, pa.string()), pa.array(total, pa.int32())], ["job", "seq", "accepted", "stages", "progress"])

    return own.mapInArrow(fold, f"job {kind}, seq {seq}, accepted boolean, stages string, progress int")
