"""SimHash near-duplicates by tiled exact comparison.

Tables of masks deal fingerprints into buckets: rows whose masked bits agree share one. A bucket is sorted by bit count and
compared tile by tile with exclusive-or and bit counts; pairs of tiles whose bit counts differ by more than the radius
are skipped. For a small radius the masks are complements of choices of blocks, and any two fingerprints within the
radius share a bucket: all links are found. For a similarity, fingerprints are longer and masks are seeded draws of
bits, as many as find a pair of that similarity with a stated probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of, trim
from .graph import components, salted_join

SEED = 42
#: Side of a tile of the comparison, and rows of a bucket beyond which its pairs of tiles are dealt over tasks.
TILE, TASK_ROWS = 128, 16_384
#: Mean rows of a bucket beyond which masks have more bits (more tables, each with fewer rows in a bucket).
BUCKET_ROWS = 1000
#: A text that more than one in so many rows share is joined by a broadcast: at most so many rows.
HOT_SHARE = 256
_LANES = np.uint64(0x0101010101010101)


@dataclass(frozen=True)
class Kind:
    """Words of a shingle, 64-bit words of a fingerprint, the most bits that linked ones differ in, and for masks drawn
    at random the share of bits that pairs at the limit differ in (0: masks that find every link)."""

    shingle: int = 4
    width: int = 1
    radius: int = 4
    apart: float = 0.0

    def masks(self, rows: int) -> np.ndarray:
        """Tables x width masks."""
        return drawn_masks(rows, self.width, self.apart) if self.apart else block_masks(rows, self.radius)


#: Links at 4 or fewer of 64 bits, of 4-word shingles.
CLOSE = Kind()


def similar(shingle: int = 5, similarity: float = 0.8, width: int = 4) -> Kind:
    """Texts whose shingle sets have a Jaccard similarity from about `similarity` on.

    A bit differs with probability angle / pi; the radius lies 1.6 standard deviations above the mean of pairs at the
    limit, so some 95 % of these are within it, and nearly all of more similar ones.
    """
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * width
    return Kind(shingle, width, int(bits * apart + 1.6 * math.sqrt(bits * apart * (1 - apart))), apart)


def block_masks(rows: int, radius: int) -> np.ndarray:
    """Masks of 64 bits: any two fingerprints within the radius agree on all bits of at least one."""
    for k in range(radius + 1, 17):
        cuts = [round(i * 64 / k) for i in range(k + 1)]
        blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
        tables = [sum(c) for c in combinations(blocks, k - radius)]
        if rows >> min(t.bit_count() for t in tables) <= BUCKET_ROWS or k == 16:
            return np.array(tables, np.uint64)[:, None]
    raise AssertionError


def drawn_masks(rows: int, width: int, apart: float, found: float = 0.97) -> np.ndarray:
    """Seeded masks, so many that a pair whose bits differ with probability `apart` agrees on one with probability `found`."""
    bits = max(8, math.ceil(math.log2(max(1, rows / BUCKET_ROWS))))
    n = math.ceil(math.log(1 - found) / math.log1p(-((1 - apart) ** bits)))
    rng, out = np.random.default_rng(SEED), np.zeros((n, 64 * width), np.uint8)
    for row in out:
        row[rng.choice(64 * width, bits, replace=False)] = 1
    return np.packbits(out, axis=1).view(">u8").astype(np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of hashes."""
    h = h + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str, shingle: int = 4, width: int = 1) -> np.ndarray:
    """`width` words of 64 bits; the first is made of the shingles' own hashes. No word: zero."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(width, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros((width, 8, 8), np.int64), len(words) - k + 1
    for at in range(0, total, 1 << 16):
        spans = zip(starts[at : at + (1 << 16)].tolist(), ends[at + k - 1 : at + k - 1 + (1 << 16)].tolist(), strict=False)
        own = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        for word in range(width):
            h = _mixed(own, word) if word else own
            h = np.pad(h, (0, -len(h) % 255)).reshape(-1, 255)
            for bit in range(8):  # one bit of all eight bytes at a time; 255 rows can't overflow a byte
                lanes = ((h >> np.uint64(bit)) & _LANES).sum(axis=1)
                counts[word, :, bit] += lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return np.packbits((2 * counts > total).reshape(width, 64), axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, kind: Kind = CLOSE, text: str = "text") -> DataFrame:
    """docs with fp (big-endian bytes) and node (a long: the fingerprint itself if it has 64 bits, or else its hash).

    Null and wordless texts have a fingerprint of zeros.
    """

    @F.pandas_udf("struct<fp:binary,node:long>")
    def bits(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            rows = np.stack([fingerprint(x, kind.shingle, kind.width) for x in texts]) if len(texts) else np.zeros((0, kind.width), np.uint64)
            raw = [r.tobytes() for r in rows.astype(">u8")]
            node = rows[:, 0] if kind.width == 1 else np.array([xxhash.xxh64_intdigest(r, SEED) for r in raw], np.uint64)
            yield pd.DataFrame({"fp": raw, "node": np.ascontiguousarray(node).view(np.int64) if len(rows) else np.zeros(0, np.int64)})
        trim()

    return docs.withColumn("__bits", bits(text_of(text))).select(*docs.columns, "__bits.fp", "__bits.node")


def merge(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n rows reaches over pairs i, j."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def linked(fps: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked fingerprints (rows x words), sorted by bucket and bit count, as a forest: each with its root.

    Tiles are compared within buckets only, and pairs of tiles whose bit counts can't be within the radius are skipped.
    Pairs found are reduced to a forest as they pile up, so memory stays in proportion to the rows.
    """
    n, pops = len(fps), np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    found_i, found_j, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for s in range(0, n, TILE):
        e = min(s + TILE, n)
        for t in range(s, n, TILE):
            f = min(t + TILE, n)
            if t > s and bucket[t] != bucket[e - 1]:
                break
            alone = bucket[s] == bucket[f - 1]
            if alone and pops[t] - pops[e - 1] > radius:
                break
            apart = np.zeros((e - s, f - t), np.uint16)
            for word in range(fps.shape[1]):
                apart += np.bitwise_count(fps[s:e, None, word] ^ fps[None, t:f, word])
            near = apart <= radius
            if not alone:
                near &= bucket[s:e, None] == bucket[None, t:f]
            i, j = np.nonzero(near)
            later = i + s < j + t
            found_i.append(i[later] + s)
            found_j.append(j[later] + t)
            held += len(found_i[-1])
        if held > 4 * n + (1 << 16):
            label = merge(n, np.concatenate(found_i), np.concatenate(found_j))
            moved = np.nonzero(label != np.arange(n))[0]
            found_i, found_j, held = [moved], [label[moved]], len(moved)
    label = merge(n, np.concatenate(found_i), np.concatenate(found_j))
    moved = np.nonzero(label != np.arange(n))[0]
    return moved, label[moved]


def _words(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, width)


def _keyed(masks: np.ndarray):
    """For each fingerprint a row a table: bucket, bit count, and the fingerprint."""

    def key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                batch = whole.slice(at, 20_000)
                fps = _words(batch["fp"], masks.shape[1])
                buckets = np.empty((len(masks), len(fps)), np.uint64)
                for t, mask in enumerate(masks):
                    h = np.full(len(fps), t, np.uint64)
                    for word, own in enumerate(mask):
                        h = _mixed(h ^ (fps[:, word] & own), word + 1)
                    buckets[t] = h
                place = pa.array(np.tile(np.arange(len(fps)), len(masks)))
                pops = pa.array(np.bitwise_count(fps).sum(axis=1, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(buckets.ravel().view(np.int64)), pops.take(place), batch["node"].take(place), batch["fp"].take(place)], ["bucket", "pop", "node", "fp"])

    return key


def _links_in_buckets(kind: Kind):
    """Batches sorted by bucket and bit count; the last bucket of a batch waits for the next."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros((0, kind.width), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

        def out(fps: np.ndarray, bucket: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            i, j = linked(fps, bucket, kind.radius)
            return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["a", "b"])

        for batch in batches:
            now = (_words(batch["fp"], kind.width), batch["bucket"].to_numpy(), batch["node"].to_numpy())
            held = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            changes = np.nonzero(np.diff(held[1]))[0]
            if len(changes):
                cut = int(changes[-1]) + 1
                yield out(*[x[:cut] for x in held])
                held = tuple(x[cut:] for x in held)
        if len(held[1]):
            yield out(*held)
        held = ()
        trim()

    return find


def near_links(distinct: DataFrame, kind: Kind = CLOSE, task_rows: int = TASK_ROWS) -> DataFrame:
    """Links a, b (a forest of each bucket) between nodes of distinct fingerprints (node, fp; a written table)."""
    masks = kind.masks(distinct.count())
    keyed = distinct.select("node", "fp").mapInArrow(_keyed(masks), "bucket long, pop int, node long, fp binary")
    # hot buckets: counts, combined before the shuffle
    many = keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > task_rows)
    hot = materialise(many.select(F.col("bucket").alias("hot"), (F.ceil(2 * F.col("n") / task_rows)).cast("int").alias("salts")), "hot-buckets")
    find = _links_in_buckets(kind)
    in_order = lambda df: df.repartition("bucket").sortWithinPartitions("bucket", "pop").mapInArrow(find, "a long, b long")
    if hot.isEmpty():
        return in_order(keyed)
    links = in_order(keyed.join(hot, F.col("bucket") == F.col("hot"), "left_anti"))
    # a hot bucket's rows are dealt into tiles, and every pair of tiles becomes a bucket of its own
    dealt = keyed.join(hot, F.col("bucket") == F.col("hot")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).filter("other <> own")
    pairs = paired.withColumn("bucket", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
    return links.unionByName(in_order(pairs.select("bucket", "pop", "node", "fp")))


def _classes(own: DataFrame, first: Column, kind: Kind, task_rows: int) -> tuple[DataFrame, DataFrame]:
    """Of a written table (node, fp): one row a fingerprint (node, first, n), and node, label of those with links."""
    classes = materialise(own.groupBy("node").agg(F.first("fp").alias("fp"), first.alias("first"), F.count("*").alias("n")), "fingerprint-classes")
    return classes.drop("fp"), materialise(components(near_links(classes, kind, task_rows), "a", "b"), "fingerprint-labels")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", kind: Kind = CLOSE, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits a word), component_id, the smallest id reachable over links.

    Equal fingerprints are links, that of wordless and null texts (zero) too. Rows of equal ids stay rows of their
    own; a component of null ids only has a null component_id. An empty table gives no rows.
    """
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    own = materialise(fingerprints(named, kind).select("doc_id", "fp", "node"), "fingerprints")
    classes, labels = _classes(own, F.min("doc_id"), kind, task_rows)
    linked_rows = classes.join(labels.withColumnRenamed("node", "node2"), F.col("node") == F.col("node2")).select("node", "first", "label")
    firsts = linked_rows.groupBy(F.col("label").alias("label2")).agg(F.min("first").alias("least"))
    found = salted_join(linked_rows, "label", firsts, "label2").select(F.col("node").alias("node2"), "least", F.lit(True).alias("has"))
    ids = materialise(classes.join(found, F.col("node") == F.col("node2"), "left").select(F.col("node").alias("node2"), F.when(F.col("has"), F.col("least")).otherwise(F.col("first")).alias("component_id"), "n"), "component-ids")
    shown = ["doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id"]
    # a text with very many copies meets its one row by a broadcast of at most HOT_SHARE rows
    common = ids.filter(F.col("n") * HOT_SHARE > own.count()).drop("n")
    dealt = own.join(F.broadcast(common.withColumn("has", F.lit(True))), F.col("node") == F.col("node2"), "left")
    rest = dealt.filter("has IS NULL").select("doc_id", "fp", "node").join(ids.drop("n"), F.col("node") == F.col("node2"))
    return dealt.filter("has").select(*shown).unionByName(rest.select(*shown))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", kind: Kind = CLOSE, task_rows: int = TASK_ROWS) -> DataFrame:
    """docs without near-duplicates: of each component the row of the smallest id stays, once, null ids last.

    Of rows that share that id the one with the smallest hash of its text stays; of rows of equal id and text one.
    Components are of texts: rows that share an id, or have none, but not a component do not stand for each other.
    Columns of docs may have any names. Texts are shuffled once, to meet the rows that stay.
    """
    tie = F.md5(text_of(text).cast("binary"))
    # keys without nulls, the same in the join and behind it, so that one shuffle serves both
    spelled = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_column).isNull().alias("none"), spelled(F.col(id_column)).alias("id"), tie.alias("tie"))
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), tie.alias("tie"))
    narrow = materialise(fingerprints(named, kind).select("doc_id", "tie", "fp", "node"), "fingerprints")
    classes, labels = _classes(narrow, F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")), kind, task_rows)
    found = classes.join(labels.withColumnRenamed("node", "node2"), F.col("node") == F.col("node2"), "left")
    firsts = found.filter("label IS NOT NULL").groupBy("label").agg(F.min("first").alias("first")).select("first").unionByName(found.filter("label IS NULL").select("first"))
    chosen = materialise(firsts.select(F.col("first.none").alias("none"), spelled(F.col("first.doc_id")).alias("id"), F.col("first.tie").alias("tie")), "kept")
    kept = row.join(chosen, ["none", "id", "tie"], "left_semi")
    return kept.dropDuplicates(["none", "id", "tie"]).select("row.*")
