"""Folds over sorted rows: tasks read many groups as one stream, so that small groups cost no call of their own."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def whole_groups(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in which equal keys lie together, cut so that no group lies in two batches; none is empty."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k] for k in key]
        at_row = lambda i, columns=columns: tuple(c[i].as_py() for c in columns)
        last = at_row(batch.num_rows - 1)
        first = at_row(0)
        begin = 0 if first == last else batch.num_rows - 1
        while begin and at_row(begin - 1) == last:
            begin -= 1
        if held and (begin or first != name):
            yield pa.concat_batches([*held, batch.slice(0, begin)])
            held = []
        elif begin:
            yield batch.slice(0, begin)
        held.append(batch.slice(begin))
        name = last
    if held:
        yield pa.concat_batches(held)


def bounds(batch: pa.RecordBatch, key: list[str]) -> Iterator[tuple[int, int]]:
    """First row of each group of a batch, and the row behind its last."""
    names = list(zip(*(batch[k].to_pylist() for k in key), strict=True))
    begin = 0
    for i in range(1, len(names)):
        if names[i] != names[i - 1]:
            yield begin, i
            begin = i
    yield begin, len(names)
