"""A hidden Markov language model: Baum-Welch counts are summed across partitions, the scaled forward recursion scores.

Symbols are the end of a text, the most frequent words, and classes of all other words by their last letters; inside a
class a word has its smoothed share of the class's counts, so every text, with unknown words too, has a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import fold, materialise, text_of

STATES, CLASSES, SUFFIX = 8, 512, 3
#: Words with a symbol of their own, and words whose counts every task holds, at most; the others meet theirs in a join.
SYMBOL_WORDS, HELD_WORDS = 8_000, 120_000
#: Training: Baum-Welch rounds, each over all training documents.
ROUNDS = 7
#: Symbols of a chunk and of a block: the variables of a block are held at a time, some 30 MB.
CHUNK, BLOCK = 256, 1 << 17
#: Steps from scale to scale; the emissions of so many stay far from the smallest double.
SCALED = 8
#: Bytes of symbols that become chunks together, or one text's.
SLICE_BYTES = 1 << 21
#: Weight of the corpus distribution in each state's emissions, in tokens.
PRIOR = 50.0
#: The key of the end of a text in the table of counts; no word is empty.
END = ""


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words, lower-cased (A-Z), and how many each text has."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, row = cut.flatten(), np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some), np.bincount(row[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


def word_class(words: pa.Array) -> np.ndarray:
    """Classes of words, by their last bytes."""
    coded = pc.binary_slice(words.cast(pa.binary()), -SUFFIX).dictionary_encode() if len(words) else words.cast(pa.binary()).dictionary_encode()
    of = np.array([zlib.crc32(x) % CLASSES for x in coded.dictionary.to_pylist()], np.int64)
    return of[coded.indices.to_numpy()] if len(of) else np.zeros(0, np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """Table word, c of texts (column text, no nulls): exact counts, END among them; summed before the shuffle."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.slices(whole, "text", 8 << 20):
                found = _words(batch["text"])[0].value_counts()
                values = pa.concat_arrays([found.field("values"), pa.array([END], pa.string())])
                yield pa.RecordBatch.from_arrays([values, pa.concat_arrays([found.field("counts"), pa.array([batch.num_rows], pa.int64())])], ["word", "n"])

    return materialise(texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c")), "word-counts")


@dataclass(frozen=True)
class Vocabulary:
    """held: frequent words and their counts, the first `n_symbols` of them with a symbol of their own (from 1 on)."""

    held: pa.Array
    counts: np.ndarray
    n_symbols: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    end_count: int
    total: int
    distinct: int

    @property
    def size(self) -> int:
        return 1 + self.n_symbols + CLASSES

    def unigram(self) -> np.ndarray:
        """The corpus distribution over symbols, none of them zero."""
        own = np.concatenate([[self.end_count], self.counts[: self.n_symbols], self.class_tokens]) + 1.0
        return own / own.sum()


def vocabulary(counts: DataFrame, symbol_words: int = SYMBOL_WORDS, held_words: int = HELD_WORDS) -> Vocabulary:
    """The frequent words of a table of counts (ties: by word), `held_words` at most, and sums of the rest by class."""
    # counts in steps of a fortieth of a power of ten: the lowest step above which no more than `held_words` words stand
    step = F.floor(F.log10("c") * 40)
    steps = sorted(((r["step"], r["n"]) for r in counts.filter(F.col("word") != END).groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    above = np.cumsum([n for _, n in steps])
    lowest = next((k for (k, _), n in zip(steps[::-1], above[::-1], strict=True) if n <= held_words), None)
    kept = counts.filter((F.col("word") != END) & (step >= lowest)) if lowest is not None else counts.limit(0)
    top = kept.toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    held = top["word"].combine_chunks().cast(pa.string()) if top.num_rows else pa.array([], pa.string())
    own = top["c"].to_numpy().astype(np.int64) if top.num_rows else np.zeros(0, np.int64)
    n = min(symbol_words, len(own))

    def classify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch["c"].to_numpy()
            of = word_class(batch["word"])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(np.bincount(of, c, CLASSES).astype(np.int64)), pa.array(np.bincount(of, minlength=CLASSES))], ["k", "tokens", "words"])

    rows = counts.filter(F.col("word") != END).mapInArrow(classify, "k long, tokens long, words long").groupBy("k").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect()
    class_tokens, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in rows:
        class_tokens[r["k"]], class_words[r["k"]] = r["tokens"], r["words"]
    first = word_class(held[:n])
    class_tokens -= np.bincount(first, own[:n], CLASSES).astype(np.int64)
    class_words -= np.bincount(first, minlength=CLASSES)
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("c"))), F.lit(0)).alias("e")).first()
    return Vocabulary(held, own, n, class_tokens, class_words, whole["e"], whole["n"], whole["v"])


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """docs (row, doc_id, held_out, text) as symbols, with what their tokens add to the scores; a written table.

    Columns: row, doc_id, held_out, n_tokens, n_known, base (sum of log10(c + 1) of the words held), spelled (of those
    among them without a symbol), symbols (16-bit, as bytes), rest (words not held, with how often the text has them).
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        log_counts = np.log10(np.append(v.counts, 0) + 1.0)
        for whole in batches:
            for batch in tokens.slices(whole, "text"):
                flat, n = _words(batch["text"])
                coded = flat.dictionary_encode()
                names = coded.dictionary
                place = pc.fill_null(pc.index_in(names, value_set=v.held), len(v.held)).to_numpy(zero_copy_only=False).astype(np.int64)
                symbol = np.where(place < v.n_symbols, place + 1, 1 + v.n_symbols + word_class(names))
                at = coded.indices.to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                where = place[at]
                add = log_counts[where]
                rows = len(n)
                known = np.bincount(row[where < len(v.held)], minlength=rows) + (v.end_count > 0)
                base = np.bincount(row, add, rows).astype(float) + np.log10(v.end_count + 1.0)
                spelled = np.bincount(row, np.where(where < v.n_symbols, 0.0, add), rows).astype(float)
                ends = np.cumsum(n)
                symbols = np.insert(symbol[at], ends, 0).astype("<u2")
                cuts = np.concatenate([[0], ends + np.arange(1, rows + 1)])
                raw = memoryview(symbols).cast("B")
                packed = [bytes(raw[2 * a : 2 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                rare = where == len(v.held)
                pairs, times = np.unique(row[rare] << 32 | at[rare], return_counts=True)
                words = pa.StructArray.from_arrays([names.take(pa.array(pairs & 0xFFFFFFFF)), pa.array(times, pa.int64())], ["word", "n"])
                bounds = np.concatenate([[0], np.cumsum(np.bincount(pairs >> 32, minlength=rows))])
                rest = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words)
                out = [batch["row"], batch["doc_id"], batch["held_out"], pa.array(n + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(spelled), pa.array(packed, pa.binary()), rest]
                yield pa.RecordBatch.from_arrays(out, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "spelled", "symbols", "rest"])

    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, spelled double, symbols binary, rest array<struct<word:string,n:long>>"
    return materialise(docs.select("row", "doc_id", "held_out", "text").mapInArrow(code, schema), "symbols")


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states


def first_model(unigram: np.ndarray, states: int = STATES, seed: int = 8) -> Hmm:
    """States that stay, each with the corpus distribution, disturbed."""
    emit = unigram[:, None] * np.exp(np.random.default_rng(seed).normal(0, 0.6, (len(unigram), states)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Hmm(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


class Sequences:
    """Texts as chunks of symbols side by side: the tokens of one time stand together, longest chunk first.

    A text is cut into chunks of CHUNK symbols, but nothing is cut off: what the forward variables are before a chunk, and
    the backward ones behind it, follows exactly from the products of the chunks' transition matrices. So the steps of
    a pass are CHUNK, however long the texts, and a pass works on BLOCK symbols at a time. A first chunk's end and a last
    one's beginning are vectors, so that only the chunks between them need a product of matrices.

    Variables are scaled every SCALED steps; a scale divides the emissions of its step, so that forward times backward
    variables sum to the same all along a chunk.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.lengths, self.symbols = lengths, symbols
        self.each = -(-lengths // CHUNK)
        self.text = np.repeat(np.arange(len(lengths)), self.each)
        self.first = np.cumsum(self.each) - self.each
        self.place = np.arange(len(self.text)) - self.first[self.text]
        self.begin = (np.cumsum(lengths) - lengths)[self.text] + self.place * CHUNK
        self.size = np.minimum(lengths[self.text] - self.place * CHUNK, CHUNK)
        self.order = np.argsort(-self.size, kind="stable")

    def _blocks(self, chunks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Chunks (longest first) of about BLOCK symbols, where each time's tokens begin, and the symbols in that order."""
        block = (np.cumsum(self.size[chunks]) - 1) // BLOCK
        for own in np.split(chunks, np.nonzero(np.diff(block))[0] + 1) if len(chunks) else []:
            size = self.size[own]
            active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
            offsets = np.concatenate([[0], np.cumsum(active)])
            symbols = np.empty(offsets[-1], np.int64)
            begin = self.begin[own]
            for time, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                symbols[a:b] = self.symbols[begin[: b - a] + time]
            yield own, offsets, symbols

    def _carried(self, m: Hmm, chunks: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """What rows of variables (rows x states) before whole chunks are at their last symbols: states x rows x chunks."""
        table, step = np.ascontiguousarray(m.emit.T), np.ascontiguousarray(m.move.T)
        out = [np.zeros((len(step), len(rows), 0))]
        for own, offsets, symbols in self._blocks(chunks):
            emit, k = np.take(table, symbols, axis=1), len(own)
            now = np.einsum("rs,sk->srk", rows, emit[:, :k], order="C")
            other = np.empty_like(now)
            for time, a in enumerate(offsets[1:-1], 1):
                np.matmul(step, now.reshape(len(step), -1), out=other.reshape(len(step), -1))
                other *= emit[:, None, a : a + k]
                now, other = other, now
                if not time % SCALED:
                    now /= now.max(axis=(0, 1))
            out.append(now / now.max(axis=(0, 1)))
        return np.concatenate(out, axis=2)

    def _led(self, m: Hmm, chunks: np.ndarray) -> np.ndarray:
        """The backward variables of chunks that end their texts times the emissions, at the chunks' first symbols (states x chunks)."""
        table = np.ascontiguousarray(m.emit.T)
        out = [np.zeros((len(table), 0))]
        for own, offsets, symbols in self._blocks(chunks):
            emit, later = np.take(table, symbols, axis=1), np.zeros((len(table), 0))
            for time in range(len(offsets) - 2, -1, -1):
                now = emit[:, offsets[time] : offsets[time + 1]]
                now[:, : later.shape[1]] *= m.move @ later
                if not time % SCALED:
                    now /= now.max(axis=0)
                later = now
            out.append(later)
        return np.concatenate(out, axis=1)

    def edges(self, m: Hmm, both: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The states' distribution before each chunk's first symbol, and (if both) the backward variables at its last (states x chunks)."""
        n, states = len(self.text), len(m.start)
        before, behind = np.repeat(m.start[:, None], n, axis=1), np.ones((states, n))
        final = self.place == self.each[self.text] - 1
        head, middle = np.nonzero((self.place == 0) & ~final)[0], np.nonzero((self.place > 0) & ~final)[0]
        if not len(head):
            return before, behind
        x = self._carried(m, head, m.start[None, :])[:, 0]
        before[:, head + 1] = m.move.T @ (x / x.sum(axis=0))
        product, slot = self._carried(m, middle, np.eye(states)), np.zeros(n, np.int64)
        slot[middle] = np.arange(len(middle))
        most = int(self.each.max())
        for k in range(2, most):
            c = self.first[self.each > k] + k
            x = np.einsum("sc,tsc->tc", before[:, c - 1], product[:, :, slot[c - 1]])
            before[:, c] = m.move.T @ (x / x.sum(axis=0))
        if both:
            last = self.order[(final & (self.place > 0))[self.order]]
            x = m.move @ self._led(m, last)
            behind[:, last - 1] = x / x.max(axis=0)
            for k in range(most - 2, 0, -1):
                c = self.first[self.each > k + 1] + k
                x = m.move @ np.einsum("tsc,tc->sc", product[:, :, slot[c]], behind[:, c])
                behind[:, c - 1] = x / x.max(axis=0)
        return before, behind

    def log10_likelihood(self, m: Hmm) -> np.ndarray:
        """Of each text, by the scaled forward recursion; the product of scales is the likelihood."""
        before, out = self.edges(m, both=False)[0], np.zeros(len(self.lengths))
        table, step = np.ascontiguousarray(m.emit.T), np.ascontiguousarray(m.move.T)
        for own, offsets, symbols in self._blocks(self.order):
            emit, sums = np.take(table, symbols, axis=1), np.zeros(len(own))
            now = before[:, own] * emit[:, : len(own)]
            for time, (a, b) in enumerate(zip(offsets[1:-1], offsets[2:], strict=True), 1):
                if b - a < now.shape[1]:
                    sums[b - a : now.shape[1]] += np.log10(now[:, b - a :].sum(axis=0))
                now = step @ now[:, : b - a]
                now *= emit[:, a:b]
                if not time % SCALED:
                    scale = now.sum(axis=0)
                    sums[: b - a] += np.log10(scale)
                    now /= scale
            sums[: now.shape[1]] += np.log10(now.sum(axis=0))
            out += np.bincount(self.text[own], sums, len(out))
        return out

    def expected(self, m: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts: of first states, of moves, of states by symbol."""
        size, states = m.emit.shape
        start, moves, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((states, size))
        before, behind = self.edges(m)
        table, step = np.ascontiguousarray(m.emit.T), np.ascontiguousarray(m.move.T)
        # forward variables at the ends of chunks, for the moves into the chunks behind them
        last = np.zeros((states, len(self.text)))
        seams, weights = [np.zeros(0, np.int64)], [np.zeros((states, 0))]
        for own, offsets, symbols in self._blocks(self.order):
            emit = np.take(table, symbols, axis=1)
            alpha = np.empty_like(emit)
            now = before[:, own]
            for time, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                now = np.multiply(step @ now[:, : b - a] if time else now, emit[:, a:b], out=alpha[:, a:b])
                if not time % SCALED:
                    scale = now.sum(axis=0)
                    now /= scale
                    emit[:, a:b] /= scale
            ends = alpha[:, offsets[self.size[own] - 1] + np.arange(len(own))]
            last[:, own] = ends / ends.sum(axis=0)
            beta = behind[:, own]
            beta /= (ends * beta).sum(axis=0)
            later = np.zeros((states, 0))
            for time in range(len(offsets) - 2, -1, -1):
                a, b = offsets[time], offsets[time + 1]
                beta[:, : later.shape[1]] = m.move @ later
                later = emit[:, a:b] * beta[:, : b - a]
                if time:
                    c = offsets[time - 1]
                    moves += alpha[:, c : c + b - a] @ later.T
                alpha[:, a:b] *= beta[:, : b - a]
            for s in range(states):
                emitted[s] += np.bincount(symbols, alpha[s], size)
            heads = self.place[own] == 0
            start += alpha[:, : len(own)][:, heads].sum(axis=1)
            seams.append(own[~heads])
            weights.append(later[:, ~heads])
        moves += last[:, np.concatenate(seams) - 1] @ np.concatenate(weights, axis=1).T
        return start, m.move * moves, emitted.T


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    symbols = np.frombuffer(b"".join(batch["symbols"].to_pylist()), "<u2")
    return symbols, pc.binary_length(batch["symbols"]).to_numpy().astype(np.int64) // 2


def expected_counts(encoded: DataFrame, model: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts over all partitions. Each task sends its own sums: rows of states by symbol, moves and starts."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    size, states = model.emit.shape

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total = np.zeros((size + states + 1, states))
        for whole in batches:
            for batch in tokens.slices(whole, "symbols", SLICE_BYTES):
                start, moves, emitted = Sequences(*_unpacked(batch)).expected(m)
                total[:size] += emitted
                total[size : size + states] += moves
                total[-1] += start
        some = np.nonzero(total.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(total[some, s]) for s in range(states)]], ["place", *[f"s{s}" for s in range(states)]])

    sums = encoded.select("symbols").mapInArrow(count, "place long, " + ", ".join(f"s{s} double" for s in range(states))).groupBy("place").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(states)]).toPandas()
    total = np.zeros((size + states + 1, states))
    total[sums["place"]] = sums[[f"s{s}" for s in range(states)]].to_numpy()
    return total[-1], total[size : size + states], total[:size]


def maximised(start: np.ndarray, moves: np.ndarray, emitted: np.ndarray, unigram: np.ndarray) -> Hmm:
    """The model that the counts, with a prior each, make likeliest."""
    emit = emitted + PRIOR * unigram[:, None]
    moves = moves + 1.0 / len(moves)
    return Hmm((start + 1) / (start + 1).sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def fit(encoded: DataFrame, vocab: Vocabulary, states: int = STATES) -> Hmm:
    """Trained on the rows that are not held out, all of them in each of ROUNDS rounds."""
    training = encoded.filter(~F.col("held_out"))
    unigram = vocab.unigram()
    model = first_model(unigram, states)
    for _ in range(ROUNDS):
        model = maximised(*expected_counts(training, model), unigram)
    return model


def score(encoded: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Hmm) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words that tasks hold were counted as they were encoded. The rest meet their counts in a join by word: they are
    rare words, so no key is hot, and their sums come back by row.
    """
    shared = encoded.sparkSession.sparkContext.broadcast((replace(vocab, held=pa.array([], pa.string())), model))

    def forward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = shared.value
        inside = np.concatenate([np.zeros(1 + v.n_symbols), np.log10(v.class_tokens + v.class_words + 1.0)])
        for whole in batches:
            for batch in tokens.slices(whole, "symbols", SLICE_BYTES):
                symbols, lengths = _unpacked(batch)
                sums = Sequences(symbols, lengths).log10_likelihood(m)
                sums -= np.bincount(np.repeat(np.arange(len(lengths)), lengths), inside[symbols], len(lengths))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums)], [*batch.schema.names[:-1], "hidden"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "spelled", "symbols"]
    scored = encoded.select(*names).mapInArrow(forward, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, spelled double, hidden double")
    rest = encoded.filter(F.size("rest") > 0).select("row", F.inline("rest"))
    own = counts.select(F.col("word").alias("known"), "c")
    found = rest.join(own, F.col("word") == F.col("known"))
    sums = found.groupBy(F.col("row").alias("r")).agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("logs"))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(sums, F.col("row") == F.col("r"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(float(np.log10(vocab.total + vocab.distinct + 1.0)))).alias("base_score"),
        (F.col("hidden") + F.col("spelled") + logs).alias("score"),
    )


def score_documents(docs: DataFrame, keep: int = 7, held: int = 2, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all whole texts by a model of those whose crc32(id as text) mod `keep` is not `held`.

    Null texts count as empty: their one token is the end. Rows of equal or null ids stay rows of their own. Only the
    two named columns are read. Without training rows every word is unknown and both scores are still finite.
    """
    own = docs.select(F.col(id_column).alias("doc_id"), (fold(id_column, keep) == held).alias("held_out"), text_of(text).alias("text"))
    counts = word_counts(own.filter(~F.col("held_out")).select("text"))
    vocab = vocabulary(counts)
    encoded = encode(own.withColumn("row", F.monotonically_increasing_id()), vocab)
    return score(encoded, counts, vocab, fit(encoded, vocab))
