"""Assignment of players between two cameras: exact least-cost matching of a tick, and identities that hold over ticks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: feet within which two observations may be one player, ticks of evidence that change a partner, and the
# weight of the distance to where a known player was expected
GATE_FT, HYSTERESIS, BIAS = 3.0, 5, 0.5
#: Observations of one camera in a tick, at most; a court has four players and few strays.
MOST = 12
REFERENCE, SECONDARY = "reference", "secondary"

Point = tuple[float, float]


def distance(a: Point, b: Point) -> float:
    return ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5


def cheapest(costs: list[list[int | None]]) -> list[tuple[int, int]]:
    """Pairs (row, column): as many as can be, then the least sum of costs, then the first rows, then the first columns.

    None is no pair. Over sets of columns used: each row is left out or takes a free column, and the best way to each
    set is kept, so n columns take 2 ** n sets, not n! orders. Costs are whole numbers, so sums and ties are exact.
    """
    ways: dict[int, tuple] = {0: (0, (), ())}
    for i, row in enumerate(costs):
        after = dict(ways)
        for used, (cost, rows, columns) in ways.items():
            for j, more in enumerate(row):
                if more is not None and not used >> j & 1:
                    way = cost + more, (*rows, i), (*columns, j)
                    place = used | 1 << j
                    if place not in after or way < after[place]:
                        after[place] = way
        ways = after
    best = min(ways.items(), key=lambda w: (-w[0].bit_count(), w[1]))[1]
    return list(zip(best[1], best[2], strict=True))


def matched(reference: dict[str, Point], secondary: dict[str, Point], gate: float = GATE_FT, expected: dict[str, Point] | None = None, bias: float = BIAS) -> list[tuple[str, str]]:
    """The cheapest pairs of one tick. The gate is on the distance alone; an expected place only ranks what it lets pass.

    Costs are in millionths of a foot. Rows are the smaller side (the reference of equal ones), in the order given.
    """
    expected = expected or {}

    def cost(r: str, s: str) -> int | None:
        apart = distance(reference[r], secondary[s])
        if apart > gate:
            return None
        return round(1e6 * (apart + (bias * distance(secondary[s], expected[r]) if r in expected else 0.0)))

    refs, secs = list(reference), list(secondary)
    if len(secs) < len(refs):
        return [(refs[j], secs[i]) for i, j in cheapest([[cost(r, s) for r in refs] for s in secs])]
    return [(refs[i], secs[j]) for i, j in cheapest([[cost(r, s) for s in secs] for r in refs])]


def _seen(observations: DataFrame, by: list[str]) -> DataFrame:
    """One row a tick with its observations as arrays in order of player; those without player or place are left out.

    Of several of one player in a tick the one of the largest (x, y) counts. More than MOST of a camera is an error.
    """
    good = observations.filter("player IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").groupBy(*by, "view", "player").agg(F.max(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("at"))
    side = lambda v: F.array_sort(F.collect_list(F.when(F.col("view") == v, F.struct("player", "at.x", "at.y")))).alias(v)
    ticks = good.groupBy(*by).agg(side(REFERENCE), side(SECONDARY))
    fits = (F.size(REFERENCE) <= MOST) & (F.size(SECONDARY) <= MOST)
    return ticks.withColumn(REFERENCE, F.when(fits, F.col(REFERENCE)).otherwise(F.raise_error(F.lit(f"more than {MOST} observations of a camera in a tick"))))


def _places(seen: list[dict]) -> dict[str, Point]:
    return {o["player"]: (o["x"], o["y"]) for o in seen}


def assigned(observations: DataFrame, by: list[str], gate: float = GATE_FT) -> DataFrame:
    """by, reference, secondary, cost (millionths of a foot) of the cheapest pairs of each tick.

    observations: the columns of `by`, view (reference or secondary), player, x, y (feet, one orientation). Ticks are a
    handful of rows each and independent: they are dealt over all tasks, many to a task. Ticks that lack a camera, or
    where no pair passes the gate, give no row; null keys are keys of their own.
    """
    ticks = _seen(observations, by)
    kinds = ", ".join(f"{c} {ticks.schema[c].dataType.simpleString()}" for c in by)

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, refs, secs, costs = [], [], [], []
            for i, (a, b) in enumerate(zip(batch[REFERENCE].to_pylist(), batch[SECONDARY].to_pylist(), strict=True)):
                reference, secondary = _places(a), _places(b)
                for r, s in matched(reference, secondary, gate):
                    at.append(i)
                    refs.append(r)
                    secs.append(s)
                    costs.append(round(1e6 * distance(reference[r], secondary[s])))
            own = [batch[c].take(pa.array(at, pa.int64())) for c in by]
            yield pa.RecordBatch.from_arrays([*own, pa.array(refs, pa.string()), pa.array(secs, pa.string()), pa.array(costs, pa.int64())], [*by, REFERENCE, SECONDARY, "cost"])

    return ticks.mapInArrow(match, f"{kinds}, {REFERENCE} string, {SECONDARY} string, cost long")


class Identities:
    """Who is who over the ticks of one take. A partner is changed only by evidence of several ticks."""

    def __init__(self, gate: float = GATE_FT, hysteresis: int = HYSTERESIS):
        self.gate, self.hysteresis = gate, max(1, hysteresis)
        self.of: dict[tuple[str, str], int] = {}  # a camera's player: identity
        self.partner: dict[str, str | None] = {}  # reference players of the last tick
        self.since: dict[int, int] = {}  # identities of the last tick: ticks in a row
        self.evidence: dict[tuple[str, str], int] = {}
        self.known = 0

    def tick(self, reference: dict[str, Point], secondary: dict[str, Point], expected: dict[int, Point] | None = None) -> list[tuple[int, str, str | None, float]]:
        """identity, reference player, its partner, confidence. A tick without any observation changes nothing."""
        if not reference and not secondary:
            return []
        held = {r: s for r, s in self.partner.items() if s is not None and r in reference and s in secondary and distance(reference[r], secondary[s]) <= self.gate}
        free_r = {r: p for r, p in reference.items() if r not in held}
        free_s = {s: p for s, p in secondary.items() if s not in held.values()}
        places = {r: expected[i] for r in free_r if expected and (i := self.of.get((REFERENCE, r))) in expected}
        pairs = dict(held)
        for r, s in matched(free_r, free_s, self.gate, places):
            self.evidence[r, s] = seen = self.evidence.get((r, s), 0) + 1
            if self.partner.get(r) in (None, s) or seen >= self.hysteresis:
                pairs[r] = s
        out, since = [], {}
        # pairs first, then reference players of whom the other camera sees nothing
        for r in [*pairs, *(r for r in reference if r not in pairs)]:
            if (REFERENCE, r) not in self.of:
                self.known += 1
                self.of[REFERENCE, r] = self.known
            identity, s = self.of[REFERENCE, r], pairs.get(r)
            if s is not None:
                self.of[SECONDARY, s] = identity
            since[identity] = self.since.get(identity, 0) + 1
            out.append((identity, r, s, 1 / (1 + distance(reference[r], secondary[s])) if s is not None else 0.0))
        self.partner, self.since = {r: pairs.get(r) for r in reference}, since
        # what speaks for a pair is forgotten once neither of the two is free any more
        self.evidence = {(r, s): n for (r, s), n in self.evidence.items() if r in free_r or s in free_s}
        return out


def identities(observations: DataFrame, take: str = "take", tick: str = "tick", gate: float = GATE_FT, hysteresis: int = HYSTERESIS) -> DataFrame:
    """take, tick, identity, reference, secondary, confidence, stable: the players of each tick under identities that hold.

    A take is a fold over its ticks in order: one task reads them one by one and holds a few players; takes are dealt over
    all tasks. The rules for odd rows are those of assigned; a null take is one of its own.
    """
    ticks = _seen(observations, [take, tick]).repartition(take).sortWithinPartitions(F.col(take).asc_nulls_first(), F.col(tick).asc_nulls_first())
    kinds = ", ".join(f"{c} {ticks.schema[c].dataType.simpleString()}" for c in (take, tick))

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, None
        for batch in batches:
            at, rows = [], []
            for i, (key, a, b) in enumerate(zip(batch[take].to_pylist(), batch[REFERENCE].to_pylist(), batch[SECONDARY].to_pylist(), strict=True)):
                if own is None or key != last:
                    own, last = Identities(gate, hysteresis), key
                for row in own.tick(_places(a), _places(b)):
                    at.append(i)
                    rows.append((*row, own.since[row[0]]))
            columns = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(at, pa.int64())) for c in (take, tick)] + made, [take, tick, "identity", REFERENCE, SECONDARY, "confidence", "stable"])

    return ticks.mapInArrow(fold, f"{kinds}, identity long, {REFERENCE} string, {SECONDARY} string, confidence double, stable long")
