"""Conversation structure repair: cheapest edits that give alternating roles, by A* on the lattice of rows and role states.

A conversation is cut into chunks of rows in order, wherever its rows lie. A* finds the cheapest edits of a chunk from each
role state in which it may begin to each in which it may end; states then meet over the chunks by costs alone. So no task
holds a conversation, however long, and edits are the same as if A* had run over all of it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_CHARS, materialise, trim

#: Rows of a chunk at most, and characters of text after which a chunk ends.
CHUNK, CHUNK_CHARS = 256, 1 << 20
#: Faults of a row; the first that holds counts.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Role states: nothing said, a system turn, the user's turn said, the assistant's turn said.
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: Initials of roles that may follow one another.
LEGAL = frozenset({("s", "u"), ("u", "a"), ("a", "u")})
INSERTED = {USER: "user", ASSISTANT: "assistant"}


@dataclass(frozen=True)
class Costs:
    """Charges of edits, all positive but keeping's; `truncated` is added for a truncated row that is not deleted."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def spoken(state: int) -> int:
    """The state behind the turn that an insertion or a new role gives: the user's, unless the user has just spoken."""
    return ASSISTANT if state == USER else USER


def kept(state: int, initial: str) -> int | None:
    """The state behind a row that keeps its role, or None where that role may not stand."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    return spoken(state) if initial == ("a" if state == USER else "u") else None


def search(initials: list[str], faults: list[int], begin: int, costs: Costs) -> list[tuple[int, str] | None]:
    """The cheapest edits of rows from state `begin` to each state, and the ASCII-least initials of such edits.

    A* over (rows done, state), keyed (cost plus heuristic, audit). The heuristic sums over the rows left what no path
    avoids: deletions that are required, and the lesser of a deletion and the charge of a truncated row. It never falls
    by more than a step costs, so the first visit of a node is its cheapest. Insertions stand before a row, never behind
    the last one; so no audit of a node begins another one, and the least audit of a node stays least in all its paths.
    """
    n = len(initials)
    least = {SOUND: 0, BLANK: costs.delete, DUPLICATE: costs.delete, TRUNCATED: min(costs.delete, costs.truncated)}
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + least[faults[i]]
    found: list[tuple[int, str] | None] = [None] * len(STATES)
    queue, seen = [(ahead[0], "", 0, begin)], set()
    while queue:
        bound, audit, i, state = heapq.heappop(queue)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == n:
            found[state] = bound, audit
            continue
        cost = bound - ahead[i]
        steps = [(costs.delete, "D", i + 1, state), (costs.insert, "I", i, spoken(state))]
        if faults[i] in (SOUND, TRUNCATED):
            charge = costs.truncated if faults[i] == TRUNCATED else 0
            steps.append((charge + costs.rerole, "R", i + 1, spoken(state)))
            if (after := kept(state, initials[i])) is not None:
                steps.append((charge, "K", i + 1, after))
        for more, letter, row, after in steps:
            if (row, after) not in seen:
                heapq.heappush(queue, (cost + more + ahead[row], audit + letter, row, after))
    return found


def missing(state: int) -> int:
    """Turns to insert behind the last row so that a conversation may end."""
    return {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[state]


def fault_of(text: Column, repeated: Column) -> Column:
    last = F.substring(F.rtrim(text, F.lit(WHITE_CHARS)), -1, 1)
    return F.when(last == "", BLANK).when(repeated, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)


def _counted(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct rows with their number of copies and the fault of the first copy; equal rows meet before any shuffle.

    A row repeats an earlier one if its role and text have a smaller turn (null is the smallest) somewhere: only role and
    texts with several turns are joined, with salt, as one of them may come at very many turns.
    """
    string = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), string(role).alias("role"), string(text).alias("text"))
    own = own.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    name = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("-"))
    key = F.sha2(F.concat_ws("\0", name, F.length("role").cast("string"), "role", "text").cast("binary"), 256)
    at = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    own = own.withColumn("said", key).withColumn("at", at)
    salts = 16
    several = own.groupBy("said").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    several = several.select(F.col("said").alias("same"), "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("turn"), F.lit(salts)).cast("int")
    joined = own.join(several, (F.col("said") == F.col("same")) & (salt == F.col("salt")), "left")
    earlier = F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    return joined.select("conv", "turn", "role", "text", "copies", fault_of(F.col("text"), earlier).alias("fault"))


_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.int32())])
_FACTS = {"rows": "array<struct<turn:long,role:string,text:string,fault:int>>", "costs": "array<int>", "ranks": "array<int>", "audits": "array<string>", "first_role": "string", "last_role": "string", "first_turn": "long", "last_turn": "long", "n_turns": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long"}


def _chunk(rows: list[tuple], begins: tuple[int, ...], costs: Costs) -> dict:
    """What a chunk says of itself: its rows, the cheapest edits between all states (by 4 * begin + end), and its counts."""
    initials, faults = [r[1][:1] for r in rows], [r[3] for r in rows]
    cost, rank, audits = [None] * 16, [None] * 16, [None] * 16
    for begin in begins:
        found = search(initials, faults, begin, costs)
        for place, end in enumerate(sorted((e for e in STATES if found[e]), key=lambda e: found[e][1])):
            cost[4 * begin + end], audits[4 * begin + end] = found[end]
            rank[4 * begin + end] = place
    turns = sorted({r[0] for r in rows} - {None})
    return {
        "rows": [dict(zip(("turn", "role", "text", "fault"), r, strict=True)) for r in rows],
        "costs": cost, "ranks": rank, "audits": audits,
        "first_role": initials[0], "last_role": initials[-1],
        "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "n_turns": len(turns),
        **{k: faults.count(v) for k, v in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))},
        "illegal": sum(p not in LEGAL for p in zip(initials, initials[1:], strict=False)),
    }


def _chunks(counted: DataFrame, costs: Costs) -> DataFrame:
    """Chunks of the rows in order, numbered in order over all conversations; a written table.

    Rows are cut by range of conversation, turn, role and text: a conversation may lie in many tasks.
    """
    kind = counted.schema["conv"].dataType
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text")]
    n = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counted.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        schema = None
        rows: list[tuple] = []
        done: list[dict] = []
        conv, size, begins = None, 0, STATES

        def close() -> None:
            nonlocal rows, size, number
            if rows:
                done.append({"conv": conv, "chunk": number, **_chunk(rows, tuple(begins), costs)})
                number, rows, size = number + 1, [], 0

        some = False
        for batch in batches:
            schema = schema or pa.schema([("conv", batch.schema.field("conv").type), ("chunk", pa.int64()), ("rows", pa.list_(_ROW)), ("costs", pa.list_(pa.int32())), ("ranks", pa.list_(pa.int32())), ("audits", pa.list_(pa.string())), ("first_role", pa.string()), ("last_role", pa.string()), *[(c, pa.int64()) for c in list(_FACTS)[6:]]])
            for key, turn, role, text, copies, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not some or key != conv:
                    close()
                    # the first conversation of a task may have begun in the task before
                    conv, begins = key, (NOTHING,) if some else STATES
                    some = True
                for copy in range(copies):
                    if len(rows) == CHUNK or (rows and size + len(text) > CHUNK_CHARS):
                        close()
                        begins = STATES
                        if len(done) == 64:
                            yield pa.RecordBatch.from_pylist(done, schema)
                            done = []
                    own = fault if not copy or fault == BLANK else DUPLICATE
                    # rows that must go leave their texts here
                    rows.append((turn, role, text if own in (SOUND, TRUNCATED) else None, own))
                    size += len(text) if own in (SOUND, TRUNCATED) else 0
            if len(done) >= 64:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
        trim()

    return materialise(ranged.mapInArrow(cut, f"conv {kind.simpleString()}, chunk long, " + ", ".join(f"{k} {v}" for k, v in _FACTS.items())), "chunks")


class _Fold:
    """Costs over the chunks of one conversation, in order: a few numbers a chunk."""

    def __init__(self):
        self.cost: list[int | None] = [0, None, None, None]
        self.rank = [0, 0, 0, 0]
        self.chunks: list[int] = []
        self.came: list[tuple[int, ...]] = []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.last_role = self.first_turn = self.last_turn = None

    def add(self, chunk: dict) -> None:
        found: list[tuple | None] = []
        for end in STATES:
            # of equal costs the one whose audit so far is least: no audit begins another one
            ways = [(self.cost[b] + c, self.rank[b], b) for b in STATES if self.cost[b] is not None and (c := chunk["costs"][4 * b + end]) is not None]
            found.append(min(ways) if ways else None)
        order = sorted((e for e in STATES if found[e]), key=lambda e: (found[e][1], chunk["ranks"][4 * found[e][2] + e]))
        self.cost = [w and w[0] for w in found]
        self.rank = [order.index(e) if found[e] else 0 for e in STATES]
        self.came.append(tuple(w[2] if w else 0 for w in found))
        self.chunks.append(chunk["chunk"])
        for k in ("blank", "duplicate", "truncated", "illegal"):
            self.counts[k] += chunk[k]
        if self.last_role is not None and (self.last_role, chunk["first_role"]) not in LEGAL:
            self.counts["illegal"] += 1
        self.last_role = chunk["last_role"]
        if chunk["n_turns"]:
            self.counts["turns"] += chunk["n_turns"] - (chunk["first_turn"] == self.last_turn)
            self.first_turn = chunk["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = chunk["last_turn"]

    def rows(self, conv: object, costs: Costs) -> list[dict]:
        """One row a chunk: the states between which its edits go; the last one carries the report."""
        total, _, end = min((c + missing(s) * costs.insert, self.rank[s], s) for s, c in enumerate(self.cost) if c is not None)
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.counts.pop("turns")
        self.counts.pop("turns", None)
        out, tail = [], missing(end)
        report = {"conv": conv, "gaps": gaps, **self.counts, "cost": total}
        for i in range(len(self.chunks) - 1, -1, -1):
            begin = self.came[i][end]
            out.append({"chunk": self.chunks[i], "begin": begin, "way": 4 * begin + end, "tail": tail, "report": report})
            end, tail, report = begin, 0, None
        return out


def _folded(chunks: DataFrame, costs: Costs) -> DataFrame:
    """chunk, begin, way (of the 16), tail and, for the last chunk of a conversation, report; a written table."""
    kind = chunks.schema["conv"].dataType.simpleString()
    facts = ["conv", "chunk", "costs", "ranks", *list(_FACTS)[4:]]
    sorted_ = chunks.select(*facts).repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "chunk")

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, own, conv, done = None, None, None, []
        for batch in batches:
            key = batch.schema.field("conv").type
            report = pa.struct([("conv", key), *[(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]])
            schema = pa.schema([("chunk", pa.int64()), ("begin", pa.int32()), ("way", pa.int32()), ("tail", pa.int32()), ("report", report)])
            for row in batch.to_pylist():
                if own is None or row["conv"] != conv:
                    done += own.rows(conv, costs) if own else []
                    own, conv = _Fold(), row["conv"]
                own.add(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if own:
            yield pa.RecordBatch.from_pylist(own.rows(conv, costs), schema)

    report = f"struct<conv:{kind},gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long>"
    return materialise(sorted_.mapInArrow(fold, f"chunk long, begin int, way int, tail int, report {report}"), "ways")


def _edits(rows: list[dict], audit: str, state: int) -> list[dict]:
    """The edits that an audit spells over rows from a state; inserted turns have no turn and no text."""
    out, at = [], iter(rows)
    for letter in audit:
        row = {"turn": None, "role": None, "text": ""} if letter == "I" else next(at)
        if letter == "D":
            out.append({"edit": "D", "turn": row["turn"], "role": row["role"], "text": None})
            continue
        state = kept(state, row["role"][:1]) if letter == "K" else spoken(state)
        out.append({"edit": letter, "turn": row["turn"], "role": row["role"] if letter == "K" else INSERTED[state], "text": row["text"]})
    return out


EDIT = "array<struct<edit:string,turn:long,role:string,text:string>>"


@dataclass(frozen=True)
class Repair:
    """report: conv, gaps, blank, duplicate, truncated, illegal, cost. edits: conv, chunk, edits, in order by chunk."""

    report: DataFrame
    edits: DataFrame

    def rows(self) -> DataFrame:
        """The repaired conversations: conv, chunk, place, edit, turn, role, text; deleted rows are left out."""
        return self.edits.select("conv", "chunk", F.posexplode("edits").alias("place", "e")).filter("e.edit <> 'D'").select("conv", "chunk", "place", "e.*")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", costs: Costs | None = None) -> Repair:
    """Cheapest edits of each conversation's rows (by turn, nulls first, then role and text) to roles `(s?(ua)+)?`.

    Null roles and texts count as one space, so such a text is blank; a null conversation is one of its own. Equal rows
    are repeats: all but the first are duplicates. An empty table gives no conversation. Only the four named columns
    are read. A fault is the first that holds of blank, duplicate (role and text came earlier) and truncated (the last
    character that is not white space is none of `.!?`).
    """
    costs = costs or Costs()
    chunks = _chunks(_counted(turns, conv, turn, role, text), costs)
    ways = _folded(chunks, costs)
    chosen = chunks.join(ways.withColumnRenamed("chunk", "at"), F.col("chunk") == F.col("at")).select("conv", "chunk", "rows", F.get("audits", F.col("way")).alias("audit"), "begin", "tail")
    kind = chunks.schema["conv"].dataType.simpleString()

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_type = pa.list_(pa.struct([(c, pa.int64() if c == "turn" else pa.string()) for c in ("edit", "turn", "role", "text")]))
        for batch in batches:
            edits = []
            for row in batch.select(["rows", "audit", "begin", "tail"]).to_pylist():
                own = _edits(row["rows"], row["audit"], row["begin"])
                if row["tail"]:
                    own += [{"edit": "I", "turn": None, "role": r, "text": ""} for r in ("user", "assistant")[-row["tail"] :]]
                edits.append(own)
            yield pa.RecordBatch.from_arrays([batch["conv"], batch["chunk"], pa.array(edits, kept_type)], ["conv", "chunk", "edits"])

    report = ways.filter("report IS NOT NULL").select("report.*")
    return Repair(report, chosen.mapInArrow(spell, f"conv {kind}, chunk long, edits {EDIT}"))


def joined(edits: DataFrame) -> DataFrame:
    """conv, audit and repaired_sha256 (of `role:text` lines) of each conversation.

    A digest runs over its whole text in order, so one task reads a conversation's chunks one by one and keeps none.
    """
    import hashlib

    left = F.filter("edits", lambda e: e["edit"] != "D")
    lines = F.array_join(F.transform(left, lambda e: F.concat(e["role"], F.lit(":"), e["text"])), "\n")
    own = edits.select("conv", "chunk", F.array_join(F.transform("edits", lambda e: e["edit"]), "").alias("audit"), lines.alias("lines"))
    kind = edits.schema["conv"].dataType.simpleString()

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, conv, audit, state, said = None, None, None, hashlib.sha256(), False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv": conv, "audit": "".join(audit), "repaired_sha256": state.hexdigest()}], schema)

        for batch in batches:
            schema = pa.schema([("conv", batch.schema.field("conv").type), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            done = []
            for key, letters, text in zip(batch["conv"].to_pylist(), batch["audit"].to_pylist(), batch["lines"].to_pylist(), strict=True):
                if audit is None or key != conv:
                    if audit is not None:
                        done.append(row())
                    conv, audit, state, said = key, [], hashlib.sha256(), False
                audit.append(letters)
                if text:
                    state.update((b"\n" if said else b"") + text.encode())
                    said = True
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if audit is not None:
            yield row()

    by_conv = own.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "chunk")
    return by_conv.mapInArrow(digest, f"conv {kind}, audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of conversations as the contract damages them, by crc32 of conversation and turn; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20).alias("harm"))
    own = own.filter("harm <> 0")
    role = F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")
