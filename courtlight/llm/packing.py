"""Shortest-pack-first packing over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import materialise, prefix_sums, text_of, trim


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False, id_column: str = "doc_id", text: str = "text", remembered: int = tokens.REMEMBERED) -> DataFrame:
    """Every document's ids and an end id, cut every `capacity` ids: one row a piece.

    Null texts count as empty and still have their end id. Rows of equal ids stay rows of their own; null ids stay
    null. keep_ids adds the ids, as little-endian unsigned 32-bit bytes. Only the two named columns are read.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.slices(whole, "text"):
                ids, bounds = tokens.encode(tokenizer, False, batch["text"], remembered)
                n = np.diff(bounds) + 1
                each = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), each)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)) * capacity
                length = np.minimum(n[row] - start, capacity)
                shifted = bounds[:-1] + np.arange(len(n))
                flat = np.insert(ids, bounds[1:], np.uint32(end_id)).astype("<u4")
                raw = memoryview(flat).cast("B")
                begin = shifted[row] + start
                spans = [raw[4 * a : 4 * b] for a, b in zip(begin, begin + length, strict=True)]
                out = [batch["id"].take(pa.array(row)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(x) for x in spans], pa.int64()), pa.array(n[row], pa.int64())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    out, names = [*out, pa.array([bytes(x) for x in spans], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)
        trim()

    return docs.select(F.col(id_column).alias("id"), text_of(text).alias("text")).mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Packing patterns, (how many packs, lengths in them), from counts of lengths.

    Lengths go longest first into the packs that are shortest so far; packs of one pattern are kept as a count, and a
    pattern is split where fewer pieces than packs are left. An entry of the result holds at most `capacity` lengths,
    and every length adds at most one pattern besides those that it moves: the size depends on capacity only.
    """
    room: dict[int, list[tuple[int, list[int]]]] = {}
    done: list[tuple[int, list[int]]] = []

    def put(count: int, lengths: list[int], left: int) -> None:
        (room.setdefault(left, []) if left else done).append((count, lengths))

    for length in sorted(histogram, reverse=True):
        need = histogram[length]
        while need:
            widest = max(room, default=0)
            if widest < length:
                put(need, [length], capacity - length)
                break
            count, lengths = room[widest].pop()
            if not room[widest]:
                del room[widest]
            if count > need:
                put(count - need, lengths, widest)
            put(min(count, need), [*lengths, length], widest - length)
            need -= min(count, need)
    return done + [x for left in sorted(room) for x in room[left]]


def _slots(patterns: list[tuple[int, list[int]]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys length << 40 | first rank, and for each the first rank's sequence and the offset in it."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length << 40 | given.get(length, 0), sequence, offset))
            given[length] = given.get(length, 0) + count
            offset += length
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def pack(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """pieces (with a column `length`, 1 to capacity) and their sequence_id and offset.

    The histogram, at most `capacity` rows, is all that the driver sees; patterns go back as arrays whose size depends
    on `capacity` alone. A piece's rank among those of its length, by a hash of the `order` columns, finds its slot.
    Ranks come from running counts over ranges of that hash, so a length that most pieces share is not sorted in one
    task. Equal rows get ranks of their own. pieces should be a written table: it is read twice.
    """
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    keys, sequences, offsets = _slots(plan(counts, capacity), capacity)
    slots = pieces.sparkSession.sparkContext.broadcast((keys, sequences, offsets))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, sequences, offsets = slots.value
        own = (length.to_numpy() << 40) | rank.to_numpy()
        at = np.searchsorted(keys, own, side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + own - keys[at], "offset": offsets[at]})

    total = sum(counts.values())
    hashed = pieces.withColumns({"__order": F.xxhash64(*order), "__one": F.lit(1).cast("long")})
    ranked = prefix_sums(hashed, ["length"], [F.col("__order"), *map(F.col, order)], "__one", "__rank", max(64, total // 20_000))
    return ranked.withColumn("__slot", slot("length", "__rank")).select(*pieces.columns, "__slot.sequence_id", "__slot.offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, keep_ids: bool = False, id_column: str = "doc_id", text: str = "text", remembered: int = tokens.REMEMBERED) -> DataFrame:
    """All documents as pieces in sequences of at most `capacity` ids; see token_pieces and pack. Empty in, empty out."""
    pieces = materialise(token_pieces(docs, tokenizer, end_id, capacity, keep_ids, id_column, text, remembered), "pieces")
    return pack(pieces, capacity, ["doc_id", "start", "ids_crc32"])


def sequences(packed: DataFrame, capacity: int, pad_id: int) -> DataFrame:
    """One row a sequence: ids and piece numbers as arrays, padded to capacity unless the length is a power of two.

    A sequence has at most `capacity` pieces, so each group is small. Needs the ids of keep_ids.
    """

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("offset")
        ids = np.frombuffer(b"".join(own["ids"]), "<u4").astype(np.int64)
        part = np.repeat(np.arange(len(own)), own["length"])
        if len(ids) & (len(ids) - 1):
            ids, part = np.pad(ids, (0, capacity - len(ids)), constant_values=pad_id), np.pad(part, (0, capacity - len(part)), constant_values=-1)
        return pd.DataFrame({"sequence_id": [own["sequence_id"].iloc[0]], "ids": [ids], "piece": [part]})

    return packed.groupBy("sequence_id").applyInPandas(fill, "sequence_id long, ids array<long>, piece array<long>")
