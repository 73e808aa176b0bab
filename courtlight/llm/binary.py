"""Token ids in binary files: fixed-width bit packing with block offsets.

A file: magic, then bits, block, n_ids, n_docs (little-endian 64-bit), then per document a validity byte, its id and
the place of its first id (one more place at the end), then the byte offset of each block in the payload (one more at
the end), then the payload. Ids are packed least significant bit first, each block from a byte of its own, so that
any range of ids is read with one seek and unpacked by numpy.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import materialise, new_path, text_of

MAGIC = b"CLTOKEN1"
BLOCK = 4096
#: Ids in a file at most, but for a last document that goes beyond.
FILE_IDS = 4 << 20


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread.ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count).astype("<u4")
    spread = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: count * bits].reshape(count, bits)
    whole = np.zeros((count, 32), np.uint8)
    whole[:, :bits] = spread
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel()


def encode_file(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """starts has a place for each document and the end."""
    parts = [pack_bits(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])
    head = np.array([bits, block, len(ids), len(doc_ids)], "<i8").tobytes()
    valid = bytes(x is not None for x in doc_ids)
    return b"".join([MAGIC, head, valid, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), starts.astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), *parts])


@dataclass
class TokenFile:
    """A file opened for random access; reads its tables at once and ids as they are asked for."""

    source: object

    def __post_init__(self) -> None:
        if self.source.read(8) != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, self.n_ids, self.n_docs = np.frombuffer(self.source.read(32), "<i8").tolist()
        self.valid = self.source.read(self.n_docs)
        self.doc_ids = np.frombuffer(self.source.read(8 * self.n_docs), "<i8")
        self.starts = np.frombuffer(self.source.read(8 * self.n_docs + 8), "<i8")
        self.offsets = np.frombuffer(self.source.read(8 * (-(-self.n_ids // self.block) + 1)), "<i8")
        self.payload = self.source.tell()

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids begin to end: one seek to the first block, one read, unpacked block by block."""
        if begin >= end:
            return np.zeros(0, "<u4")
        first, last = begin // self.block, -(-end // self.block)
        self.source.seek(self.payload + int(self.offsets[first]))
        raw = self.source.read(int(self.offsets[last] - self.offsets[first]))
        cuts = self.offsets[first : last + 1] - self.offsets[first]
        parts = [unpack_bits(raw[cuts[i] : cuts[i + 1]], self.bits, min(self.block, self.n_ids - (first + i) * self.block)) for i in range(last - first)]
        return np.concatenate(parts)[begin - first * self.block : end - first * self.block]


def write_files(docs: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id", text: str = "text", directory: str | None = None) -> DataFrame:
    """Write all documents' ids, in ascending id order; returns the written table of files.

    Null ids come first; rows of equal ids go by a hash of their text, then by text. Null texts count as empty and
    have their end id. An empty table makes no file. A file gets its name from its task's place in the order and is
    moved there whole, so a task that runs again, after a loss, only puts the same bytes in place again. Table of
    files: part, roll, path, n_docs, n_ids, bytes, base (ids of all files before).
    """
    spark = docs.sparkSession
    to = directory or new_path(spark, "tokens")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store, root = fs.FileSystem.from_uri(to)
        store.create_dir(root, recursive=True)
        bits = None
        held_ids, held_docs, lengths, roll = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held_ids, held_docs, lengths, roll
            ids = np.concatenate(held_ids)
            raw = encode_file(held_docs, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), ids, bits)
            name = f"tokens-{part:06d}-{roll:04d}"
            with store.open_output_stream(f"{root}/.{name}-{attempt}") as f:
                f.write(raw)
            store.move(f"{root}/.{name}-{attempt}", f"{root}/{name}.bin")
            row = pa.RecordBatch.from_pylist([{"part": part, "roll": roll, "path": f"{to}/{name}.bin", "n_docs": len(held_docs), "n_ids": len(ids), "bytes": len(raw)}])
            held_ids, held_docs, lengths, roll = [], [], [], roll + 1
            return row

        for whole in batches:
            for batch in tokens.slices(whole, "text"):
                if bits is None:
                    from tokenizers import Tokenizer

                    bits = max(1, (max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id)).bit_length())
                ids, bounds = tokens.encode(tokenizer, True, batch["text"])
                held_ids.append(np.insert(ids, bounds[1:], np.uint32(end_id)))
                held_docs += batch["id"].to_pylist()
                lengths += (np.diff(bounds) + 1).tolist()
                if sum(map(len, held_ids)) >= FILE_IDS:
                    yield flush()
        if held_docs:
            yield flush()

    own = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = own.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")
    files = materialise(ordered.mapInArrow(write, "part long, roll long, path string, n_docs long, n_ids long, bytes long"), "token-files")
    # two steps: files within a task's own part, then the parts, of which there are as many as tasks
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("roll").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("inside", inside).join(before, F.col("part") == F.col("p")).select(*files.columns, (F.col("first") + F.col("inside")).alias("base"))


def read_documents(files: DataFrame) -> DataFrame:
    """One row a document, from the files' bytes: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    file = TokenFile(f)
                    raw = memoryview(file.ids(0, file.n_ids)).cast("B")
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(file.starts[:-1], file.starts[1:], strict=True)]
                    ids = pa.array(file.doc_ids, pa.int64(), mask=np.frombuffer(file.valid, np.uint8) == 0)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(base + file.starts[:-1]), pa.array(np.diff(file.starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = files.select("path", "base").repartition(max(1, files.count()))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
