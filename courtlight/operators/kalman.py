"""Constant-velocity Kalman filter of tracks, as a scan: chunks of a track are summed up apart and then joined exactly.

What a chunk does to the state before it has a form of fixed size that composes from step to step (Sarkka and
Garcia-Fernandez, Temporal parallelization of Bayesian smoothers). One pass sums up the chunks, a fold over the sums gives
each chunk the state before it, and a second pass runs the plain recursion in all chunks at a time: a long track is many
tasks' work.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A range of so many milliseconds of a track is a chunk.
WIDTH_MS = 60_000
LEAST_VARIANCE = 1e-6


def _before(m: np.ndarray, p: np.ndarray, e: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """State and covariance behind an element from those before it."""
    a, b, c, told, weight = e
    through = a @ np.linalg.inv(np.eye(2) + p @ weight)
    return through @ (m + p @ told) + b, through @ p @ a.T + c


class _Chunk:
    """The plain recursion over points, in single numbers: an axis has place and velocity, both axes have one covariance.

    With `summed`, also what the points do to the state (2 x axes) before them. Begun from no state and no covariance, the
    recursion gives b and c; a moves on with the gains, told and weight with the innovations.
    """

    def __init__(self, q: float, r: float, state: list[float] | None = None, summed: bool = False):
        self.q, self.r, self.summed = q, r, summed
        self.x, self.y, self.vx, self.vy, self.p00, self.p01, _, self.p11 = state or [0.0] * 8
        self.a = [1.0, 0.0, 0.0, 1.0]
        self.told, self.weight = [0.0] * 4, [0.0] * 4

    def begin(self, zx: float, zy: float) -> None:
        """A track's first point: as it is, at rest, whatever was before."""
        self.x, self.y, self.vx, self.vy, self.p00, self.p01, self.p11 = zx, zy, 0.0, 0.0, 1.0, 0.0, 1.0
        self.a, self.told, self.weight = [0.0] * 4, [0.0] * 4, [0.0] * 4

    def step(self, dt: float, zx: float, zy: float) -> None:
        x, y = self.x + dt * self.vx, self.y + dt * self.vy
        p00 = self.p00 + 2 * dt * self.p01 + dt * dt * self.p11 + self.q * dt**4 / 4
        p01 = self.p01 + dt * self.p11 + self.q * dt**3 / 2
        p11 = self.p11 + self.q * (dt * dt)
        scale = p00 + self.r
        k0, k1 = p00 / scale, p01 / scale
        ex, ey = zx - x, zy - y
        if self.summed:
            a00, a01, a10, a11 = self.a
            h0, h1 = a00 + dt * a10, a01 + dt * a11
            self.a = [h0 - k0 * h0, h1 - k0 * h1, a10 - k1 * h0, a11 - k1 * h1]
            t, w = self.told, self.weight
            self.told = [t[0] + h0 * ex / scale, t[1] + h0 * ey / scale, t[2] + h1 * ex / scale, t[3] + h1 * ey / scale]
            self.weight = [w[0] + h0 * h0 / scale, w[1] + h0 * h1 / scale, w[2] + h0 * h1 / scale, w[3] + h1 * h1 / scale]
        self.x, self.y = x + k0 * ex, y + k0 * ey
        self.vx, self.vy = self.vx + k1 * ex, self.vy + k1 * ey
        self.p00, self.p01, self.p11 = p00 - k0 * p00, p01 - k0 * p01, p11 - k1 * p01

    def element(self) -> list[float]:
        """a, b, c, told, weight. Behind the chunk the state is a(I + p weight)^-1 (m + p told) + b, the covariance a(I + p weight)^-1 p a' + c."""
        return [*self.a, self.x, self.y, self.vx, self.vy, self.p00, self.p01, self.p01, self.p11, *self.told, *self.weight]


def _steps(batch: pa.RecordBatch) -> Iterator[tuple]:
    """place, whether a track begins, seconds since the point before, x and y of a batch's rows.

    Times that don't rise are no time apart, nor is what follows a point at time zero.
    """
    columns = (batch[c].to_pylist() for c in ("place", "t_ms", "before_ms", "x", "y"))
    for place, t, before, x, y in zip(*columns, strict=True):
        yield place, before is None, max(t / 1000 - before / 1000, 0.0) if before else 0.0, x, y


def filtered(points: DataFrame, process: float = 1.0, measurement: float = 1.0, width: int = WIDTH_MS) -> DataFrame:
    """track, t_ms, seq, x, y, vx, vy, radius of each point: the filtered place and velocity and the root of its variance.

    points: track, t_ms, seq (order of points of one time), x, y. Points without a time or a place are no points; equal
    times are no time apart; a null track is one of its own. A track's first point is taken as it is, at rest, with unit
    covariance. A range of `width` milliseconds of a track is one task's work. Results are those of the plain recursion
    up to rounding, wherever ranges lie.
    """
    good = points.filter("t_ms IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").select("track", "t_ms", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    good = good.withColumn("chunk", F.floor(F.col("t_ms") / width))
    # the point before, in the chunk or else the last one of the chunks before
    inside = W.partitionBy("track", "chunk").orderBy("t_ms", "seq", "x", "y")
    ends = good.groupBy("track", "chunk").agg(F.max("t_ms").alias("last_ms"))
    ends = ends.withColumn("came_ms", F.lag("last_ms").over(W.partitionBy("track").orderBy("chunk"))).withColumn("last", F.lead("chunk").over(W.partitionBy("track").orderBy("chunk")).isNull()).withColumnsRenamed({"track": "__track", "chunk": "__chunk"})
    same = F.col("track").eqNullSafe(F.col("__track")) & (F.col("chunk") == F.col("__chunk"))
    own = good.join(ends, same).withColumn("place", F.row_number().over(inside)).withColumn("before_ms", F.coalesce(F.lag("t_ms").over(inside), "came_ms")).drop("__track", "__chunk", "last_ms", "came_ms")
    kind = good.schema["track"].dataType.simpleString()
    key = f"track {kind}, chunk long"

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each chunk does, but for the last of a track, behind which no chunk asks."""
        name, chunk = None, None
        for batch in batches:
            out: list[tuple] = []
            for track, number, last, (place, begins, dt, x, y) in zip(batch["track"].to_pylist(), batch["chunk"].to_pylist(), batch["last"].to_pylist(), _steps(batch), strict=True):
                if place == 1:
                    if name:
                        out.append((*name, chunk and chunk.element()))
                    name, chunk = (track, number), None if last else _Chunk(process, measurement, summed=True)
                if chunk:
                    chunk.begin(x, y) if begins else chunk.step(dt, x, y)
            if out:
                yield elements(out, batch.schema)
        if name:
            yield elements([(*name, chunk and chunk.element())], batch.schema)

    def elements(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
        track, chunk, element = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(track, kinds.field("track").type), pa.array(chunk, pa.int64()), pa.array(element, pa.list_(pa.float64()))], ["track", "chunk", "element"])

    def carry(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """State and covariance before each chunk, over the chunks of a track in order."""
        last, m, p = object(), np.zeros((2, 2)), np.eye(2)
        for rows in groups:
            before = []
            for track, element in zip(rows["track"], rows["element"], strict=True):
                track = None if pd.isna(track) else track
                if track != last:
                    last, m, p = track, np.zeros((2, 2)), np.eye(2)
                before.append(np.concatenate([m.ravel(), p.ravel()]))
                if element is not None:
                    m, p = _before(m, p, tuple(np.asarray(element).reshape(5, 2, 2)))
            yield rows[["track", "chunk"]].assign(before=before)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(process, measurement)
        for batch in batches:
            found = []
            for carried, (place, begins, dt, x, y) in zip(batch["before"].to_pylist(), _steps(batch), strict=True):
                if place == 1:
                    chunk = _Chunk(process, measurement, carried)
                chunk.begin(x, y) if begins else chunk.step(dt, x, y)
                found.append((chunk.x, chunk.y, chunk.vx, chunk.vy, math.sqrt(max(chunk.p00, LEAST_VARIANCE))))
            if found:
                yield pa.RecordBatch.from_arrays([batch["track"], batch["t_ms"], batch["seq"], *[pa.array(c, pa.float64()) for c in zip(*found, strict=True)]], ["track", "t_ms", "seq", "x", "y", "vx", "vy", "radius"])

    # a task reads its chunks one behind the other, each from its first point on; that one brings what was before
    dealt = lambda df: df.repartition("track", "chunk").sortWithinPartitions("track", "chunk", "place")
    in_order = [F.col("track").asc_nulls_first(), "chunk"]
    sums = dealt(own).mapInArrow(summed, f"{key}, element array<double>")
    carried = sums.repartition("track").sortWithinPartitions(*in_order).mapInPandas(carry, f"{key}, before array<double>").withColumnsRenamed({"track": "__track", "chunk": "__chunk"})
    first = own.join(carried, same & (F.col("place") == 1), "left").drop("__track", "__chunk")
    seq = good.schema["seq"].dataType.simpleString()
    return dealt(first).mapInArrow(run, f"track {kind}, t_ms {good.schema['t_ms'].dataType.simpleString()}, seq {seq}, x double, y double, vx double, vy double, radius double")
