"""The action ledger as a stream: one state a take, idempotent requests, live play, and a timer that closes the take."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from courtlight.operators import ledger


class TakeProcessor(StatefulProcessor):
    """Holds a take's revision, end and play, and the hash of each client id that it has accepted."""

    def __init__(self, grace_ms: int = ledger.GRACE_MS):
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("take", f"revision int, ended_ms long, duration_ms long, {ledger.PLAY}")
        self.hashes = handle.getMapState("requests", "client_id string", "request_hash string")

    def _take(self) -> ledger.Take:
        if not self.state.exists():
            return ledger.Take()
        revision, ended, duration, *play = self.state.get()
        return ledger.Take(revision, ended, duration, ledger.Play(*play))

    def _keep(self, take: ledger.Take) -> None:
        self.state.update((take.revision, take.ended_ms, take.duration_ms, *asdict(take.play).values()))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        take = self._take()
        out = []
        for action in sorted((r.asDict() for r in rows), key=lambda r: (r["arrived_ms"], r["action_id"])):
            client = (action["client_id"],)
            known = self.hashes.getValue(client)[0] if client[0] is not None and self.hashes.containsKey(client) else None
            row = ledger.answered(take, action, known, self.grace_ms)
            if row["verdict"] == "accepted" and client[0] is not None:
                self.hashes.updateValue(client, (action["request_hash"],))
            if row["verdict"] == "completed":
                self.handle.registerTimer(action["arrived_ms"] + self.grace_ms + 1)
            out.append(Row(take=key[0], **row))
        self._keep(take)
        yield from out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        """The grace is over: requests are forgotten, as whatever comes now is closed; the final state leaves once more."""
        self.hashes.clear()
        take = self._take()
        yield Row(take=key[0], action_id=None, verdict="final", revision=take.revision, **asdict(take.play))

    def close(self) -> None:
        pass


def live_ledger(actions: DataFrame, late: str = "10 minutes", grace_ms: int = ledger.GRACE_MS) -> DataFrame:
    """take and ledger.RESULT of each action of a stream (columns ledger.ACTION but request_hash): see ledger.ingested.

    Event time is arrived_ms; rows behind the watermark by more than `late` are dropped by the engine. Actions of one
    micro-batch are taken in order of arrival, so results equal those of the batch form if batches come in order. A take
    that was completed leaves a row with verdict final when its grace is over. State lives in the RocksDB store
    (spark.sql.streaming.stateStore.providerClass); a restart goes on from the checkpoint.
    """
    stamped = ledger.request_hash(actions).withColumn("arrived", F.timestamp_millis("arrived_ms")).withWatermark("arrived", late)
    kind = actions.schema["take"].dataType.simpleString()
    return stamped.groupBy("take").transformWithState(TakeProcessor(grace_ms), f"take {kind}, {ledger.RESULT}", "Append", "EventTime")


def requests(actions: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first request of each take and client id of a stream, by the engine's own de-duplication within the watermark."""
    stamped = actions.withColumn("arrived", F.timestamp_millis("arrived_ms")).withWatermark("arrived", late)
    return stamped.dropDuplicatesWithinWatermark(["take", "client_id"]).drop("arrived")
