"""Phrase collocations by level-wise passes: k-grams are counted only where both of their (k-1)-grams are frequent.

What a pass knows of the level before is a map of hashed bits of fixed size, so a broadcast never grows with the corpus.
A bit that two phrases share lets a rare phrase be counted in vain; the exact count then drops it, so results don't
depend on the map.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import materialise, text_of, trim

#: Bits of the map, as a power of two: 16 MB.
BITS = 27
#: Bytes of text counted together.
SLICE_BYTES = 2 << 20
#: Seed of the hash of words, the same for Spark's function and the library's.
SEED = 42
#: Turns the hash of a phrase before the next word's is added.
TURN = 21
#: The phrase under which a language's number of words is counted; no phrase is empty.
ALL = ""
#: floor(1000000 * a * a / (l * r)) in decimals: counts up to 10 ** 15 are exact.
SCORE = "(CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * CAST(1000000 AS DECIMAL(7,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"

_SPACE, _CUT = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_SPACE)], _KIND[list(_CUT)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The words of texts (no nulls), lower-cased (A-Z), with each one's text and piece; pieces are numbered over all."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = kind == 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    at = np.nonzero(begin)[0]
    piece = np.cumsum((kind == 2) | edge[:-1], dtype=np.int32)[at]
    row = np.searchsorted(offsets, at, side="right") - 1
    cuts = np.append((np.cumsum(inside, dtype=np.int32) - 1)[at], inside.sum()).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(cuts), pa.py_buffer(_LOWER[data[inside]]))
    return words.dictionary_encode(), row, piece


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))


def _turned(h: np.ndarray) -> np.ndarray:
    return (h << np.uint64(TURN)) | (h >> np.uint64(64 - TURN))


def place_of(lang: Column, phrase: Column, bits: int) -> Column:
    """The bit of a phrase in the map: the hashes of its language and words, each turned before the next is added."""
    turned = lambda h: F.shiftleft(h, TURN).bitwiseOR(F.shiftrightunsigned(h, 64 - TURN))
    whole = F.aggregate(F.split(phrase, " "), F.xxhash64(lang), lambda h, w: turned(h).bitwiseXOR(F.xxhash64(w)))
    return F.shiftrightunsigned(whole, 64 - bits)


def bit_map(frequent: DataFrame, bits: int = BITS) -> np.ndarray:
    """The map of the phrases of a table (lang, phrase), as 64-bit words; at most 2 ** (bits - 6) rows reach the driver."""
    place = place_of(F.col("lang"), F.col("phrase"), bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    rows = frequent.filter(F.col("phrase") != ALL).select(place.alias("place")).groupBy(F.shiftrightunsigned("place", 6).alias("word")).agg(F.bit_or(one).alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["word"].to_numpy()] = rows["set"].to_numpy()
    return out.view(np.uint64)


def _counted(batch: pa.RecordBatch, k: int, known: np.ndarray | None) -> pa.RecordBatch:
    """The phrases of k words of a batch (lang, text), with their counts; for k > 1 only those whose parts may be frequent."""
    words, row, piece = words_of(batch["text"])
    langs = batch["lang"].dictionary_encode()
    names, code = words.dictionary, words.indices.to_numpy().astype(np.int64)
    lang = langs.indices.to_numpy().astype(np.int64)[row]
    n = max(0, len(code) - k + 1)
    here = np.arange(n) if k == 1 else np.nonzero(piece[:n] == piece[k - 1 :])[0]
    if k > 1:
        bits = len(known).bit_length() + 5
        each = _hashes(names.to_pylist())[code] if len(code) else np.zeros(0, np.uint64)
        h = _hashes(langs.dictionary.to_pylist())[lang[: len(code) - k + 2]] if len(code) > k - 2 else np.zeros(0, np.uint64)
        for j in range(k - 1):
            h = _turned(h) ^ each[j : j + len(h)]
        place = h >> np.uint64(64 - bits)
        some = (known[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        here = here[some[here] & some[here + 1]]
    key, bound, size = lang[here], len(langs.dictionary), max(1, len(names))
    for j in range(k):
        if bound * size >= 1 << 62:
            distinct, key = np.unique(key, return_inverse=True)
            bound = len(distinct)
        key, bound = key * size + code[here + j], bound * size
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    at = here[first]
    parts = [names.take(pa.array(code[at + j])) for j in range(k)]
    phrase = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
    of = langs.dictionary.take(pa.array(lang[at]))
    if k == 1:
        totals = np.bincount(lang, minlength=len(langs.dictionary))
        phrase = pa.concat_arrays([phrase, pa.array([ALL] * len(totals), pa.string())])
        of, counts = pa.concat_arrays([of, langs.dictionary]), np.concatenate([counts, totals])
    return pa.RecordBatch.from_arrays([of, phrase, pa.array(counts, pa.int64())], ["lang", "phrase", "n"])


def level(texts: DataFrame, k: int, least: int, known: np.ndarray | None) -> DataFrame:
    """lang, phrase, f of the phrases of k words that come at least `least` times; for k = 1 also each language's total.

    Counts are summed by slice of a task before the shuffle, which then deals them by language and phrase.
    """
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.slices(whole, "text", SLICE_BYTES):
                yield _counted(batch, k, shared.value)
        trim()

    counts = texts.mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    return materialise(counts.filter((F.col("f") >= least) | (F.col("phrase") == ALL)), f"level-{k}")


def _with_count(rows: DataFrame, part: str, known: DataFrame, out: str) -> DataFrame:
    """rows with the count of the phrase in `part`. A common word is a hot key: adaptive execution splits it."""
    own = known.select(F.col("lang").alias("__lang"), F.col("phrase").alias("__phrase"), F.col("f").alias(out))
    return rows.join(own, (F.col("lang") == F.col("__lang")) & (F.col(part) == F.col("__phrase"))).drop("__lang", "__phrase")


def _outlived(candidates: DataFrame, share: int) -> DataFrame:
    """Candidates without those that lie in a longer one which comes at least `share` per cent as often."""
    words = F.split("phrase", " ")
    size = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice("words", i, k), " "))))
    longer = candidates.select("lang", "a", words.alias("words")).filter(size > 2).select("lang", "a", F.explode(inner).alias("__inner"))
    most = longer.groupBy(F.col("lang").alias("__lang"), "__inner").agg(F.max("a").alias("__most"))
    joined = candidates.join(most, (F.col("lang") == F.col("__lang")) & (F.col("phrase") == F.col("__inner")), "left")
    return joined.filter(100 * F.coalesce("__most", F.lit(0)) < share * F.col("a")).drop("__lang", "__inner", "__most")


def _first(scored: DataFrame, top: int) -> DataFrame:
    """The first `top` of each language, ranked. Each of many shares of a language is cut to `top` before they meet."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    shares = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64("phrase"), F.lit(shares)).alias("__share")
    some = scored.select("*", share)
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("lang", "__share").orderBy(*order))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("__share")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, bits: int = BITS, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases of two to `longest` words.

    Null texts count as empty, a null language is `und`; texts without words and an empty table give nothing. Repeated
    rows count as often as they come. Ties in score go to the larger a, then to the phrase (in bytes); ties of cuts to
    the shorter first part. Only the two named columns are read. Scores are exact: products are decimals of 38 digits.
    """
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).alias("text"))
    levels = [level(own, 1, least, None)]
    for k in range(2, longest + 1):
        levels.append(level(own, k, least, bit_map(levels[-1], bits)))
    known = levels[0].filter(F.col("phrase") != ALL)
    candidates = None
    for k, counted in enumerate(levels[1:], 2):
        candidates = counted if candidates is None else candidates.unionByName(counted)
        known = known.unionByName(counted) if k < longest else known
    left = _outlived(candidates.withColumnRenamed("f", "a"), share)
    words = F.split("phrase", " ")
    cuts = left.select("lang", "phrase", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    both = _with_count(_with_count(cuts, "head", known, "l"), "rest", known, "r")
    both = both.withColumn("score", F.expr(SCORE))
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    totals = levels[0].filter(F.col("phrase") == ALL).select(F.col("lang").alias("__lang"), F.col("f").alias("n"))
    ranked = _first(best, top)
    return ranked.join(totals, F.col("lang") == F.col("__lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
