"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic and one on ordinary text.

A window is one word between spaces. Its distance is the bytes that it takes with the ordinary dictionary less the bytes
it takes with the toxic one. A document labelled toxic is mostly ordinary text, so its toxic windows are found first: a
dictionary trained on all windows of toxic documents tells, by its distance from the ordinary one, which of them are
toxic, and the toxic dictionary is trained on these. How often each distance occurs in documents of either label, in a
fold that no dictionary has seen, gives the size of the toxic dictionary, the threshold of a window's distance, its
weight, and the threshold of a document's evidence.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import fold, materialise, text_of, trim

#: Labelled documents of each label used for fitting, about, at most: those with the smallest hashes of their ids.
FIT_TOXIC, FIT_ORDINARY = 8_000, 16_000
#: Windows that a dictionary is trained on, about, at most, and the bytes of the longest of them.
TRAIN_WINDOWS, TRAIN_BYTES = 400_000, 64
#: Bytes of the ordinary dictionary (a quarter of its windows, at most) and of the first toxic one.
ORDINARY_BYTES, FIRST_BYTES = 1 << 20, 64 << 10
#: Bytes of the toxic dictionary, and distances from which on a window counts: calibration chooses.
TOXIC_BYTES, CUTS = (8 << 10, 16 << 10, 32 << 10), (1, 2, 3, 4, 5)
#: A window of a toxic document is toxic from this distance of the first dictionaries on.
TOXIC_FROM = 2
#: The trainer's segments and what it compares: of the length of words.
SEGMENT, PART = 16, 6
LEVEL = 19
#: Behind every window, in training as in scoring: zstandard stores blocks of a dozen bytes as they stand.
FRAME = bytes(range(1, 14))
#: Distances are kept between these; more extreme ones count as the nearest.
LOW, HIGH = -8, 12
LEVELS = HIGH - LOW + 1
#: Ordinary documents of the calibration fold that the threshold may flag, as a share.
ALARMS = 0.03
#: Windows that a task remembers, twice: beyond so many, those not met since the last time are forgotten. Only speed depends on it.
REMEMBERED = 150_000


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    usual: float
    slope: float
    threshold: float


def windows(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts, lower-cased (A-Z), and the place of each word's text."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, row = cut.flatten(), np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some).cast(pa.binary()), row[some.to_numpy(zero_copy_only=False)]


def framed(word: bytes) -> bytes:
    return b" " + word + b" " + FRAME


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(content)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)


class Distances:
    """Distances of windows between the ordinary dictionary and each of some toxic ones."""

    def __init__(self, toxic: list[bytes], ordinary: bytes):
        self.toxic, self.ordinary = [_compressor(t) for t in toxic], _compressor(ordinary)
        self.memory: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        """The distances of different words: a row a toxic dictionary."""
        if len(self.memory) > REMEMBERED:
            self.memory, self.older = {}, self.memory
        new = [w for w in words if w not in self.memory]
        self.memory.update((w, self.older[w]) for w in new if w in self.older)
        new = [w for w in new if w not in self.older]
        for at in range(0, len(new), 10_000):
            part = [framed(w) for w in new[at : at + 10_000]]
            size = lambda c: np.array([len(x) for x in c.multi_compress_to_buffer(part, threads=0)])  # noqa: B023, E731
            usual, packed = size(self.ordinary), np.zeros(len(part), np.int64)
            for c in self.toxic[::-1]:
                packed = packed * LEVELS + np.clip(usual - size(c), LOW, HIGH) - LOW
            self.memory.update(zip(new[at : at + 10_000], packed.tolist(), strict=True))
        packed = np.fromiter(map(self.memory.__getitem__, words), np.int64, len(words))
        return np.stack([packed // LEVELS**i % LEVELS + LOW for i in range(len(self.toxic))])

    def histograms(self, texts: pa.Array) -> np.ndarray:
        """For each text and toxic dictionary, how many of its windows have each distance."""
        flat, row = windows(texts)
        coded = flat.dictionary_encode()
        level = self.of(coded.dictionary.to_pylist())[:, coded.indices.to_numpy()] - LOW if len(flat) else np.zeros((len(self.toxic), 0), np.int64)
        return np.stack([np.bincount(row * LEVELS + own, minlength=len(texts) * LEVELS).reshape(-1, LEVELS) for own in level], axis=1)


def _labelled(docs: DataFrame, labels: DataFrame, id_column: str, text: str, id_in_labels: str, toxic: str, keep: int) -> DataFrame:
    """Different texts of a bounded sample of the labelled documents outside the held-out fold; a written table.

    Ids are taken whose hash is below a share that gives about FIT_TOXIC and FIT_ORDINARY of them, so the ids can be
    broadcast and only these texts are shuffled.
    """
    known = labels.select(F.col(id_in_labels).cast("string").alias("__id"), F.col(toxic).cast("int").alias("toxic")).filter((F.crc32(F.col("__id").cast("binary")) % keep != 0) & F.col("toxic").isin(0, 1)).groupBy("__id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.shiftrightunsigned(F.xxhash64("__id"), 1).cast("double") / 2.0**63
    share = F.when(F.col("toxic") == 1, F.lit(FIT_TOXIC / max(1, sizes.get(1, 0)))).otherwise(F.lit(FIT_ORDINARY / max(1, sizes.get(0, 0))))
    own = docs.select(F.col(id_column).cast("string").alias("id"), text_of(text).alias("text"))
    # some 24,000 ids
    sample = own.join(F.broadcast(known.filter(place < share)), F.col("id") == F.col("__id"))
    # the fold that calibrates is kept out of the dictionaries
    return materialise(sample.groupBy("text").agg(F.max("toxic").alias("toxic"), F.max(fold("id", keep) == 1).alias("calibrates")), "toxicity-sample")


def _count_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window, and how many toxic and ordinary texts have it; long ones are left out of training."""
    for whole in batches:
        for batch in tokens.slices(whole, "text"):
            flat, row = windows(batch["text"])
            if not len(flat):
                continue
            coded = flat.dictionary_encode()
            names = coded.dictionary
            found = np.unique(coded.indices.to_numpy().astype(np.int64) * batch.num_rows + row)
            toxic = batch["toxic"].to_numpy(zero_copy_only=False)[found % batch.num_rows] == 1
            n = [np.bincount(found[own] // batch.num_rows, minlength=len(names)) for own in (toxic, ~toxic)]
            short = pc.less_equal(pc.binary_length(names), TRAIN_BYTES)
            yield pa.RecordBatch.from_arrays([names, pa.array(n[0], pa.int64()), pa.array(n[1], pa.int64())], ["word", "toxic", "ordinary"]).filter(short)


def _training(counted: DataFrame, n: str, most: int) -> list[bytes]:
    """About `most` windows, each as often as its share of the counts `n` says; fractions are settled by its hash."""
    total = counted.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first()["n"]
    luck = F.shiftrightunsigned(F.xxhash64("word"), 1).cast("double") / 2.0**63
    copies = F.floor(F.col(n) * F.lit(min(1.0, most / max(1, total))) + luck)
    rows = counted.filter(F.col(n) > 0).select("word", copies.alias("copies")).filter("copies > 0").toArrow().sort_by("word")
    words = np.repeat(np.array([framed(w) for w in rows["word"].to_pylist()] or [b""], object)[: rows.num_rows], rows["copies"].to_numpy().astype(np.int64))
    # the trainer takes samples in order, and neighbours in order of their bytes are much alike
    return words[np.random.default_rng(2).permutation(len(words))].tolist()


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary. Samples too few or too small for zstandard's trainer are its content as they stand."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=PART).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) + FRAME)[-max(size, len(FRAME)) :]


def _slope(x: np.ndarray, toxic: np.ndarray) -> float:
    """Slope of a logistic curve of x, by Newton's method with a little ridge; both labels weigh the same."""
    each = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum())) * len(toxic)
    rows, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        h = (rows * (each * p * (1 - p))[:, None]).T @ rows + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, rows.T @ (each * (p - toxic)) + 1e-2 * w), -2, 2)
    return max(float(w[0]), 1e-3)


def evidence(found: np.ndarray, weights: np.ndarray, usual: float) -> np.ndarray:
    """Sum of the weights of a text's windows, less what so many windows of an ordinary text would let one expect."""
    return found @ weights - usual * found.sum(axis=1)


def calibrated(found: np.ndarray, toxic: np.ndarray, cut: int) -> tuple[np.ndarray, float, float, float, float]:
    """Weights, usual, slope, threshold and recall, from a row of window counts and a label each document.

    Windows count from distance `cut` on. The threshold is the lowest evidence that flags at most ALARMS of the ordinary
    documents; it is above zero, so a text without windows is never flagged.
    """
    of = [found[toxic == v].sum(axis=0) for v in (0, 1)]
    share = [(n + 0.5) / (n.sum() + 0.5 * LEVELS) for n in of]
    counts = np.arange(LEVELS) + LOW >= cut
    weights = np.where(counts, np.maximum(0.0, np.log(share[1] / share[0])), 0.0)
    usual = max(0.0, float((share[1] - share[0])[counts].sum()))
    x = evidence(found, weights, usual)
    ordinary = np.sort(x[toxic == 0])
    threshold = max(1e-3, float(np.nextafter(ordinary[len(ordinary) - 1 - int(ALARMS * len(ordinary))], np.inf)))
    return weights, usual, _slope(x, toxic), threshold, float((x[toxic == 1] >= threshold).mean())


def fit(docs: DataFrame, labels: DataFrame, keep: int = 5, id_column: str = "doc_id", text: str = "text", id_in_labels: str = "doc_id", toxic: str = "toxic") -> Model:
    """A model from the labelled rows whose crc32(id as text) mod `keep` is not 0, of those the bounded sample.

    Rows without a label, or of another label than 0 and 1, teach nothing; an id or text labelled both ways counts as
    toxic, and equal texts count once. Samples are chosen by hashes of ids and windows, so neither order nor ties matter.
    Where the calibration fold lacks a label, all scores are the share of toxic documents in it, at most just below one
    half, and 0 if it is empty. What reaches the driver is bounded by the constants above.
    """
    sample = _labelled(docs, labels, id_column, text, id_in_labels, toxic, keep)
    shape = "word binary, toxic long, ordinary long"
    counted = materialise(sample.filter(~F.col("calibrates")).select("text", "toxic").mapInArrow(_count_windows, shape).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "toxicity-windows")
    usual = _training(counted, "ordinary", TRAIN_WINDOWS)
    ordinary = dictionary(usual, min(ORDINARY_BYTES, max(4096, sum(map(len, usual)) // 4)))
    first = dictionary(_training(counted, "toxic", TRAIN_WINDOWS), FIRST_BYTES)

    def toxic_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances([first], ordinary)
        for batch in batches:
            yield batch.filter(pa.array(distances.of(batch["word"].to_pylist())[0] >= TOXIC_FROM))
        del distances
        trim()

    found = materialise(counted.filter("toxic > 0").mapInArrow(toxic_windows, shape), "toxicity-found")
    samples = _training(found, "toxic", TRAIN_WINDOWS // 4)
    kinds = [dictionary(samples, size) for size in TOXIC_BYTES]

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(kinds, ordinary)
        for whole in batches:
            for batch in tokens.slices(whole, "text"):
                rows = distances.histograms(batch["text"]).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(list(rows), pa.list_(pa.int64()))], ["toxic", "found"])
        del distances
        trim()

    rows = sample.filter("calibrates").select("text", "toxic").mapInArrow(measure, "toxic int, found array<long>").toPandas()
    if rows["toxic"].nunique() < 2:
        rate = min(0.499, sum(rows["toxic"]) / max(1, len(rows)))
        return Model(FRAME, FRAME, np.zeros(LEVELS), 0.0, 1.0, float(-np.log(max(rate, 1e-9) / (1 - rate))))
    counts, y = np.stack(rows["found"]).reshape(len(rows), len(kinds), LEVELS), rows["toxic"].to_numpy()
    fits = [(calibrated(counts[:, i], y, cut), content) for i, content in enumerate(kinds) for cut in CUTS]
    (weights, each, slope, threshold, _), content = max(fits, key=lambda x: x[0][-1])
    return Model(content, ordinary, weights, each, slope, threshold)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """docs and a double column `out`, 0 to 1, which replaces one of that name; one half is the calibrated threshold.

    Null texts count as empty and are not flagged. A score depends on the text alone, so equal texts have equal scores;
    other columns of docs may have any names. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # a task's own memory, gone with the task: workers live on and serve other stages
        own = shared.value
        distances = Distances([own.toxic], own.ordinary)
        for texts in series:
            batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
            parts = [evidence(distances.histograms(x["text"])[:, 0], own.weights, own.usual) for x in tokens.slices(batch, "text")]
            x = np.concatenate(parts) if parts else np.zeros(0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(own.slope * (x - own.threshold), -30, 30))))
        del distances
        trim()

    return docs.withColumn(out, toxicity(text_of(text)))
