"""The action ledger of a take: scoring by two rule sets, ingestion with its checks, replay and what a replay changes.

A ledger is a fold over a take's actions in order. The step is one small function on a few numbers; Spark deals the takes,
sorts their actions and streams them past it, in batches here and under a stream in courtlight.streaming.ledger.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: rule sets, points of a game, games of a match
HYBRID, SIDE_OUT = "hybrid_21_best_of_5_v1", "side_out_singles_v1"
POINTS, GAMES, SERVE_ONLY = 21, 3, 20
GRACE_MS = 5 * 60 * 1000


@dataclass(frozen=True)
class Play:
    """The state of a match; game_over and game_winner tell of the last action alone."""

    server: str | None = None
    a: int = 0
    b: int = 0
    games_a: int = 0
    games_b: int = 0
    phase: str = "rally"
    side: str | None = None
    status: str = "not_started"
    winner: str | None = None
    game_over: bool = False
    game_winner: str | None = None


PLAY = "server string, a int, b int, games_a int, games_b int, phase string, side string, status string, winner string, game_over boolean, game_winner string"


def _scored(play: Play, server: str | None, a: int, b: int) -> Play:
    """A hybrid match with this score: who has won the game, and the match by it, and from where the server serves."""
    won = "A" if a == POINTS else "B" if b == POINTS else None
    games = play.games_a + (won == "A"), play.games_b + (won == "B")
    winner = next((t for t, n in zip("AB", games, strict=True) if n == GAMES), None)
    side = None if server not in ("A", "B") else "left" if (a if server == "A" else b) % 2 else "right"
    phase = "serve_only" if a == b == SERVE_ONLY else "rally"
    return Play(server, a, b, *games, phase, side, "completed" if winner else "in_progress", winner, won is not None, won)


def _hybrid_rally(play: Play, winner: str | None) -> Play:
    """Every rally scores but at 20 all, where only the server does; the winner serves next. No winner: a replay."""
    if winner is None:
        return replace(play, game_over=False, game_winner=None)
    if play.status == "completed":
        return play
    point = play.phase != "serve_only" or winner == play.server
    a, b = (min(POINTS, n + 1) if point and winner == t else n for t, n in (("A", play.a), ("B", play.b)))
    return _scored(play, winner, a, b)


def _side_out_rally(play: Play, winner: str | None) -> Play:
    """Only the server scores; the first winner of a game without a server scores and serves."""
    if winner is None:
        return play
    point = play.server in (None, winner)
    start = (0, 0) if play.server is None else (play.a, play.b)
    return Play(winner, start[0] + (point and winner == "A"), start[1] + (point and winner == "B"))


def step(play: Play, kind: str | None, server: str | None, a: int | None, b: int | None, ruleset: str | None) -> Play:
    """The state behind an action. A null server or score of a correction or of a new game is that of the state."""
    hybrid = ruleset == HYBRID
    server = play.server if server is None else server
    if kind == "start_game":
        if hybrid and server in ("A", "B"):
            return Play(server, 0, 0, play.games_a, play.games_b, side="right", status="in_progress")
        return Play(server)
    if kind in ("end_game", "end_set"):
        return play if hybrid else Play()
    if kind in ("rally_result_a", "rally_result_b", "rally_replay"):
        winner = {"rally_result_a": "A", "rally_result_b": "B"}.get(kind)
        return _hybrid_rally(play, winner) if hybrid else _side_out_rally(play, winner)
    if kind == "correct_score":
        a, b = (play.a if a is None else a), (play.b if b is None else b)
        return _scored(play, server, a, b) if hybrid else Play(server, a, b)
    return play


@dataclass
class Take:
    """What ingestion knows of a take: its revision, the requests that it has taken, whether and when it ended, the play."""

    revision: int = 0
    ended_ms: int | None = None
    duration_ms: int = 0
    play: Play = field(default_factory=Play)

    def verdict(self, action: dict, known_hash: str | None, grace_ms: int = GRACE_MS) -> str:
        """The first check that the action fails, or accepted."""
        if self.ended_ms is not None:
            if action["arrived_ms"] > self.ended_ms + grace_ms:
                return "closed"
            if not 0 <= action["t_ms"] <= self.duration_ms:
                return "out_of_range"
        if known_hash is not None:
            return "duplicate" if known_hash == action["request_hash"] else "mismatched_payload"
        if action["expected_revision"] is not None and action["expected_revision"] != self.revision:
            return "revision_conflict"
        return "negative_time" if action["t_ms"] < 0 else "accepted"

    def take_in(self, action: dict) -> None:
        """An accepted action, or the end of the recording, which is no action and raises no revision."""
        if action["kind"] == "take_completed":
            self.ended_ms, self.duration_ms = action["arrived_ms"], action["t_ms"]
            return
        self.revision += 1
        self.play = step(self.play, action["kind"], action["server"], action["a"], action["b"], action["ruleset"])


ACTION = ["take", "action_id", "client_id", "arrived_ms", "t_ms", "kind", "server", "a", "b", "ruleset", "request_hash", "expected_revision"]
RESULT = f"action_id long, verdict string, revision int, {PLAY}"


def answered(take: Take, action: dict, known_hash: str | None, grace_ms: int = GRACE_MS) -> dict:
    """Take an action in if it passes, and tell the verdict with the state behind it."""
    verdict = "completed" if action["kind"] == "take_completed" else take.verdict(action, known_hash, grace_ms)
    if verdict in ("accepted", "completed"):
        take.take_in(action)
    return {"action_id": action["action_id"], "verdict": verdict, "revision": take.revision, **asdict(take.play)}


def request_hash(actions: DataFrame) -> DataFrame:
    """actions with the hash of what each asks for: equal requests have equal hashes, nulls differ from everything else."""
    asked = F.to_json(F.struct("kind", "server", "a", "b"), {"ignoreNullFields": "false"})
    return actions.withColumn("request_hash", F.sha2(asked.cast("binary"), 256))


def _in_order(actions: DataFrame, order: list[str]) -> DataFrame:
    return actions.repartition("take").sortWithinPartitions(F.col("take").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])


def ingested(actions: DataFrame, grace_ms: int = GRACE_MS) -> DataFrame:
    """take and RESULT of every action (columns ACTION), in order of arrival and id: its verdict and the state behind it.

    A client id that the take has accepted before is a duplicate if it asks for the same, else mismatched_payload; an
    expected revision (null: none) that is not the take's is a revision_conflict; after take_completed actions must lie
    in the recording and arrive within the grace. Only accepted actions count. A null take is one of its own, a null
    client id is never a duplicate. A task holds the client ids of one take.
    """
    kind = actions.schema["take"].dataType.simpleString()
    own = _in_order(request_hash(actions).select(*ACTION), ["arrived_ms", "action_id"])

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, key, hashes = None, None, {}
        for batch in batches:
            out = []
            for action in batch.to_pylist():
                if take is None or action["take"] != key:
                    take, key, hashes = Take(), action["take"], {}
                client = action["client_id"]
                row = answered(take, action, hashes.get(client) if client is not None else None, grace_ms)
                if row["verdict"] == "accepted" and client is not None:
                    hashes[client] = action["request_hash"]
                out.append({"take": key, **row})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("take", batch.schema.field("take").type), *_RESULT_TYPES]))

    return own.mapInArrow(fold, f"take {kind}, {RESULT}")


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_RESULT_TYPES = [(name, _TYPES[kind]) for name, kind in (c.split() for c in RESULT.split(", "))]


def live(results: DataFrame) -> DataFrame:
    """take, revision and the play of each take behind its last accepted action; takes without one are left out."""
    names = ["revision", *[c.split()[0] for c in PLAY.split(", ")]]
    last = F.max_by(F.struct(*names), F.struct("revision", "action_id"))
    return results.filter("verdict = 'accepted'").groupBy("take").agg(last.alias("s")).select("take", "s.*")


def played(actions: DataFrame) -> DataFrame:
    """take, action_id, kind and the play behind each action that is not undone, by either rule set.

    actions: as replayed has them. Unknown and null kinds change nothing; a null rule set is side-out.
    """
    kind = actions.schema["take"].dataType.simpleString()
    own = _in_order(actions.filter(~F.coalesce("undone", F.lit(False))).select("take", "action_id", "revision", "created_ms", "kind", "server", "a", "b", "ruleset"), ["revision", "created_ms", "action_id"])

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, play = None, None
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if play is None or x["take"] != key:
                    key, play = x["take"], Play()
                play = step(play, x["kind"], x["server"], x["a"], x["b"], x["ruleset"])
                out.append({"take": key, "action_id": x["action_id"], "kind": x["kind"], **asdict(play)})
            plays = [t for t in _RESULT_TYPES if t[0] not in ("action_id", "verdict", "revision")]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("take", batch.schema.field("take").type), ("action_id", pa.int64()), ("kind", pa.string()), *plays]))

    return own.mapInArrow(fold, f"take {kind}, action_id long, kind string, {PLAY}")


FACTS = ["server", "a", "b", "games_a", "games_b", "phase"]
_FACT_TYPES = [("server", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("games_a", pa.int32()), ("games_b", pa.int32()), ("phase", pa.string())]
#: Actions after which a correction no longer reaches back to the rally before.
_CLOSES = frozenset({"start_game", "end_game", "end_set", "rally_result_a", "rally_result_b", "rally_replay", "end_rally", "start_timeout", "change_side"})


def replayed(actions: DataFrame) -> DataFrame:
    """take, action_id and the facts before each rally (one for each start_next_rally), by the actions that are not undone.

    actions: take, action_id, revision, created_ms, kind, server, a, b, ruleset, undone (null: no). Order is by revision,
    creation and id. A correction while a rally is open, with no result yet, restates the facts before it.
    """
    kind = actions.schema["take"].dataType.simpleString()
    own = _in_order(actions.filter(~F.coalesce("undone", F.lit(False))).select("take", "action_id", "revision", "created_ms", "kind", "server", "a", "b", "ruleset"), ["revision", "created_ms", "action_id"])

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, key, play, rally = None, None, None, None

        def facts(where: object, action_id: int, then: Play) -> dict:
            return {"take": where, "action_id": action_id, **{c: getattr(then, c) for c in FACTS}}

        for batch in batches:
            schema = pa.schema([("take", batch.schema.field("take").type), ("action_id", pa.int64()), *_FACT_TYPES])
            out = []
            for x in batch.to_pylist():
                if play is None or x["take"] != key:
                    out += [facts(key, *rally)] if rally else []
                    key, play, rally = x["take"], Play(), None
                play = step(play, x["kind"], x["server"], x["a"], x["b"], x["ruleset"])
                if rally and x["kind"] == "correct_score":
                    rally = rally[0], play
                elif rally and (x["kind"] in _CLOSES or x["kind"] == "start_next_rally"):
                    out.append(facts(key, *rally))
                    rally = None
                if x["kind"] == "start_next_rally":
                    rally = x["action_id"], play
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if rally:
            yield pa.RecordBatch.from_pylist([facts(key, *rally)], schema)

    return own.mapInArrow(fold, f"take {kind}, action_id long, server string, a int, b int, games_a int, games_b int, phase string")


def reprojected(snapshots: DataFrame, actions: DataFrame) -> DataFrame:
    """What a replay makes of the snapshots: one row each, and one for each new revision.

    snapshots: take, action_id, revision, status (effective, superseded, undone) and FACTS. An effective snapshot whose
    action is undone or gone becomes undone. Where the replay's facts differ from the newest snapshot's (nulls are
    values), and that one is not undone, a row with change new and the next revision stands beside it, and it becomes
    superseded. Rallies without any snapshot get none. change is unchanged for all others.
    """
    facts = F.struct(*FACTS)
    executed = actions.filter(~F.coalesce("undone", F.lit(False))).select(F.col("take").alias("__t"), F.col("action_id").alias("__a")).distinct()
    derived = replayed(actions).select(F.col("take").alias("__t"), F.col("action_id").alias("__a"), facts.alias("derived"))
    current = executed.join(derived.withColumnsRenamed({"__t": "__t2", "__a": "__a2"}), F.col("__t").eqNullSafe(F.col("__t2")) & (F.col("__a") == F.col("__a2")), "left").drop("__t2", "__a2")
    newest = snapshots.groupBy(F.col("take").alias("__nt"), F.col("action_id").alias("__na")).agg(F.max("revision").alias("newest"))
    own = snapshots.join(newest, F.col("take").eqNullSafe(F.col("__nt")) & (F.col("action_id") == F.col("__na"))).drop("__nt", "__na")
    own = own.join(current, F.col("take").eqNullSafe(F.col("__t")) & (F.col("action_id") == F.col("__a")), "left")
    gone = F.col("__a").isNull() & (F.col("status") == "effective")
    differs = F.col("derived").isNotNull() & (F.col("revision") == F.col("newest")) & (F.col("status") != "undone") & ~facts.eqNullSafe(F.col("derived"))
    told = own.withColumn("change", F.when(gone, "undone").when(differs, "superseded").otherwise("unchanged"))
    told = told.withColumn("status", F.when(F.col("change") == "unchanged", F.col("status")).otherwise(F.col("change")))
    names = ["take", "action_id", "revision", "status", "change"]
    new = told.filter("change = 'superseded'").select("take", "action_id", (F.col("revision") + 1).alias("revision"), F.lit("effective").alias("status"), F.lit("new").alias("change"), "derived.*")
    return told.select(*names, *FACTS).unionByName(new)
