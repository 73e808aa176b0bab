"""Media columns: texts' bytes as grey samples of lossless WebP images, and features of the images read back."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens, webp
from .common import materialise, text_of

#: Bytes of payload that are written or read at once, about: memory is bounded by it and by the longest text.
AT_ONCE = 1 << 20


def payload(text: bytes) -> bytes:
    """The text and spaces up to a positive multiple of a row."""
    return text + b" " * (-len(text) % webp.WIDTH if text else webp.WIDTH)


def write_media(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table doc_id, n_bytes, media: each whole text as lossless WebP.

    Null texts count as empty, and an empty text has one row of spaces. Equal texts have equal media: nothing but the
    text counts. Very long texts make several images in one media. Rows of equal or null ids stay rows of their own.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.slices(whole, "text", AT_ONCE):
                texts = [x.encode() for x in batch["text"].to_pylist()]
                media = webp.encode_many([payload(x) for x in texts])
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    own = docs.select(F.col(id_column).alias("doc_id"), text_of(text).alias("text"))
    return materialise(own.mapInArrow(write, f"doc_id {kind}, n_bytes long, media binary"), "media")


def feature(samples: np.ndarray) -> str:
    """Size, mean sample and a difference hash of a grey image (rows x columns): 8 bands of rows by 9 of columns."""
    height, width = samples.shape
    bands = lambda n, k: np.unique(np.arange(k) * n // k)
    rows, columns = bands(height, 8), bands(width, 9)
    sums = np.add.reduceat(np.add.reduceat(samples, rows, axis=0, dtype=np.int64), columns, axis=1)
    area = np.diff(np.append(rows, height))[:, None] * np.diff(np.append(columns, width))[None]
    mean = sums / area
    bits = np.zeros((8, 8), np.uint8)
    rising = (mean[:, 1:] > mean[:, :-1]).astype(np.uint8)
    bits[: rising.shape[0], : rising.shape[1]] = rising
    return f"{width}x{height}:{int(sums.sum()) // samples.size}:{np.packbits(bits).tobytes().hex()}"


def pixel_arrays(media: list[bytes]) -> list[np.ndarray]:
    """Each media's grey samples, rows x columns; the images of one media stand one below another."""
    return [np.concatenate([(i >> 8 & 0xFF).astype(np.uint8) for i in images]) for images in webp.decode_many(media)]


def read_media(table: DataFrame) -> DataFrame:
    """One row a media: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    kind = table.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.slices(whole, "media", AT_ONCE // 2):
                media = batch["media"].to_pylist()
                samples = pixel_arrays(media)
                stored = [x.tobytes() for x in samples]
                out = [
                    batch["doc_id"],
                    batch["n_bytes"],
                    pa.array([len(x) for x in stored], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in stored], pa.string()),
                    pa.array([zlib.crc32(x[-16:]) for x in stored], pa.int64()),
                    pa.array([len(x) for x in media], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in media], pa.string()),
                    pa.array([feature(x) for x in samples], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return table.select("doc_id", "n_bytes", "media").mapInArrow(read, schema)
