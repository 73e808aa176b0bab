"""Language identification with error-correcting output codes over byte n-grams.

Every language has a codeword. For each of its bits a binary n-gram classifier (log-odds of hashed n-grams, from counts
of all training documents) predicts the bit from the text. Decoding adds up each bit's loss, weighted by how reliable
its classifier is, and takes the nearest codeword; a small lead over the next one is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import fold, text_of

#: Hash buckets of n-grams of each order, and the orders.
BUCKETS, ORDERS = 1 << 15, (2, 3, 4)
#: A codeword's length is this many bits more than languages can be told apart with, at least.
SPARE_BITS = 12
#: A lead in probability below this is ambiguous.
AMBIGUOUS = 0.2
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    """What each byte counts as: A-Z as a-z, bytes beyond ASCII as themselves, all else as one space."""
    out = np.full(256, 32, np.uint8)
    out[128:] = np.arange(128, 256)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    return out


_LETTERS = _letters()


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams (a row an order), and where each text's begin.

    Each text is led by a space and ends in as many as the longest n-gram reaches over its end, so that no n-gram
    holds anything of another text. Runs of spaces inside a text count as they stand.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    bounds, seam = offsets - offsets[0], max(ORDERS) - 1
    begin = bounds[:-1] + np.arange(len(texts)) * (1 + seam)
    codes = np.full(len(data) + len(texts) * (1 + seam) + seam, 32, np.uint32)
    codes[np.arange(len(data)) + np.repeat(np.arange(len(texts)) * (1 + seam) + 1, np.diff(bounds))] = _LETTERS[data]
    starts = bounds + np.arange(len(bounds))
    own = np.arange(starts[-1]) + np.repeat(begin - starts[:-1], np.diff(starts))
    out = np.empty((len(ORDERS), len(own)), np.int64)
    held = codes[: len(codes) - seam].copy()
    for n in range(1, max(ORDERS)):
        held = held * np.uint32(257) + codes[n : n + len(held)]
        if n + 1 in ORDERS:
            at = ORDERS.index(n + 1)
            out[at] = ((held[own] * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64) + at * BUCKETS
    return out, starts


def codebook(languages: int, seed: int = 6) -> np.ndarray:
    """A codeword (+1 or -1) a language. Few languages: every way to part them; more: seeded words, the farthest apart."""
    if languages <= 5:
        parts = [[1 if (i + (1 << languages - 1)) >> b & 1 else -1 for b in range(languages)] for i in range((1 << (languages - 1)) - 1)]
        return np.array(parts or [[1] * languages], np.int64).T
    bits = 2 * (languages - 1).bit_length() + SPARE_BITS
    draws = np.random.default_rng(seed).choice([-1, 1], (200, languages, bits))
    # bits in which the two nearest words differ, from products of words
    apart = [(bits - np.max(w @ w.T - 2 * bits * np.eye(languages, dtype=np.int64))) // 2 for w in draws]
    return draws[int(np.argmax(apart))]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    odds: np.ndarray
    reliability: np.ndarray
    sharpness: float


def _count(languages: list[str]):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's n-gram counts of each language: at most languages x buckets numbers, sent once."""
        total = np.zeros((len(languages), len(ORDERS) * BUCKETS), np.int64)
        for whole in batches:
            for batch in tokens.slices(whole, "text", 1 << 20):
                found, starts = grams(batch["text"])
                row = np.repeat(batch["language"].to_numpy(), np.diff(starts))
                for own in found:
                    total += np.bincount(row * total.shape[1] + own, minlength=total.size).reshape(total.shape)
        language, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(language), pa.array(bucket), pa.array(total[language, bucket])], ["language", "bucket", "n"])

    return count


def fit(docs: DataFrame, keep: int = 4, held: int = 2, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Classifiers from the rows with a language whose crc32(id as text) mod `keep` is not `held`; all such rows count.

    Null texts teach nothing. Counts are summed by tasks before they are shuffled and have languages x buckets rows at
    most, so what reaches the driver does not grow with the documents. Without rows there are no languages.
    """
    own = docs.filter((fold(id_column, keep) != held) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), text_of(text).alias("text"))
    languages = [r["lang"] for r in own.select("lang").distinct().orderBy("lang").collect()]
    width = len(ORDERS) * BUCKETS
    counts = np.zeros((len(languages), width))
    if languages:
        place = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1
        rows = own.select(place.cast("long").alias("language"), "text").mapInArrow(_count(languages), "language long, bucket long, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts[rows["language"], rows["bucket"]] = rows["n"]
    code = codebook(len(languages)) if languages else np.zeros((0, 1), np.int64)
    # each language as a distribution over the buckets of each order, however much text it has
    shares = np.concatenate([(c + 0.5) / (c + 0.5).sum(axis=1, keepdims=True) for c in np.split(counts, len(ORDERS), axis=1)], axis=1)
    odds = np.zeros((width, code.shape[1]), np.float32)
    expected = np.zeros((len(languages), code.shape[1]))
    for b in range(code.shape[1]):
        if (code[:, b] > 0).any() and (code[:, b] < 0).any():
            odds[:, b] = np.log(shares[code[:, b] > 0].mean(axis=0)) - np.log(shares[code[:, b] < 0].mean(axis=0))
            expected[:, b] = shares @ odds[:, b] / len(ORDERS)
    # a classifier is as reliable as the weakest language's expected margin on its own side
    reliability = np.maximum(1e-3, (expected * code).min(axis=0)) if languages else np.zeros(code.shape[1])
    return Model(languages, code, odds, reliability / max(1e-9, reliability.sum()), 12.0)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, its probability and its lead, from a row of bit margins a text."""
    loss = np.zeros((len(margins), len(model.languages)))
    for b in range(model.code.shape[1]):
        signed = margins[:, b, None] * model.code[None, :, b]
        loss += model.reliability[b] * np.log1p(np.exp(np.clip(-4 * signed, -30, 30)))
    near = np.exp(np.clip(-model.sharpness * (loss - loss.min(axis=1, keepdims=True)), -50, 0))
    near /= near.sum(axis=1, keepdims=True)
    best = near.argmax(axis=1)
    top = near[np.arange(len(near)), best]
    near[np.arange(len(near)), best] = 0
    return best, top, top - near.max(axis=1)


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """docs and a struct column `out` (lang, score 0 to 1, ambiguous), which replaces one of that name.

    Null texts, and those without a letter, are `und` with score 0 and ambiguous, as all are of a model without
    languages. The text alone counts, so equal texts have equal results; of equally near codewords the first language
    in order of names wins, and is ambiguous.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,score:double,ambiguous:boolean>")
    def language(texts):
        import pandas as pd

        own = shared.value
        parts = [pd.DataFrame({"lang": [], "score": [], "ambiguous": []})]
        for batch in tokens.slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), "text", 1 << 20):
            some = pc.fill_null(pc.match_substring_regex(batch["text"], r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if not own.languages:
                some = np.zeros(len(some), bool)
            found, starts = grams(pc.fill_null(batch["text"], ""))
            margins = np.zeros((len(some), own.code.shape[1]))
            for one in found:
                margins += np.add.reduceat(own.odds[one], starts[:-1], axis=0)
            margins /= (len(ORDERS) * np.diff(starts))[:, None]
            lang, score, lead = np.full(len(some), UNDETERMINED, object), np.zeros(len(some)), np.zeros(len(some))
            if own.languages:
                best, top, ahead = decode(own, margins)
                lang = np.where(some, np.array(own.languages, object)[best], UNDETERMINED)
                score, lead = np.where(some, top, 0.0), np.where(some, ahead, 0.0)
            parts.append(pd.DataFrame({"lang": lang, "score": score, "ambiguous": lead < AMBIGUOUS}))
        return pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]

    return docs.withColumn(out, language(F.col(text).cast("string")))
