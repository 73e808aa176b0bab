"""SentencePiece BPE with byte fallback by a table of each prefix's last token, and back to text.

A prefix of a BPE token sequence is the BPE sequence of that prefix of the text, so every prefix of a text has one last
token. It is found from the pieces that end there (matches of an automaton): the one whose pair with the last token of
what stands before it is a pair that BPE itself would leave. Following last tokens backwards from the end gives the ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import text_of, trim

#: What stands for a space in pieces.
SPACE = "▁"
_RUNS = re.compile(" +[^ ]*")


class PrefixTable:
    """The tokens of a string by its prefix table. Names are pieces; characters without a piece are tokens of their own."""

    def __init__(self, scores: dict[str, float]):
        import ahocorasick

        order = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: order[s] for piece, s in scores.items()}
        self.known: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in scores:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """Plain BPE: the pair of the best rank, the leftmost of equals, becomes one token until no pair is a piece."""
        parts, rank = list(text), self.rank
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether BPE leaves the two tokens as they are, side by side; an empty left one: right on its own."""
        pair = left, right
        if pair not in self.known:
            if len(self.known) > 1_000_000:
                self.known.clear()
            self.known[pair] = self.merged(left + right) == [x for x in pair if x]
        return self.known[pair]

    def last_tokens(self, text: str) -> list[str]:
        """The last token of each prefix, from the prefix of one character on."""
        last: list[str] = [""] * len(text)
        for end, length in self.automaton.iter(text):
            if not last[end]:
                begin = end - length
                before = "" if begin < 0 else last[begin] or text[begin]
                # nothing merges with a character that is no piece: it counts as the text's begin
                if self.compatible(before if before in self.rank else "", text[begin + 1 : end + 1]):
                    last[end] = text[begin + 1 : end + 1]
        return [x or c for x, c in zip(last, text, strict=True)]

    def tokens(self, text: str) -> list[str]:
        last, found, end = self.last_tokens(text), [], len(text)
        while end:
            found.append(last[end - 1])
            end -= len(found[-1])
        return found[::-1]


class PieceTable(tokens.PieceEncoder):
    """Ids of whole texts with a sentencepiece model; words are remembered as the other encoders remember them.

    No piece of the model may hold a space behind another character, or texts could not be cut before spaces.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        n, t = model.normalizer_spec, model.trainer_spec
        if n.name != "identity" or not n.add_dummy_prefix or n.remove_extra_whitespaces or not t.byte_fallback or t.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with the identity normaliser, a dummy prefix and byte fallback")
        normal = {p.piece: p.score for p in model.pieces if p.type == p.NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in normal) or any(p.type in (p.USER_DEFINED, p.UNUSED) for p in model.pieces):
            raise ValueError("pieces with inner spaces and pieces that users define are not supported")
        self.table = PrefixTable({p.replace(SPACE, " "): s for p, s in normal.items()})
        self.id = {p.replace(SPACE, " "): self.library.piece_to_id(p) for p in normal}
        self.byte = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.memory: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _keys(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words, each without the one space that stands before it (the dummy prefix is the first one's)."""
        plain = pc.replace_substring(texts, SPACE, " ")
        # an empty text has no dummy prefix; in a text with no run of spaces every space begins a word
        odd = pc.or_(pc.or_(pc.equal(pc.binary_length(plain), 0), pc.match_substring(plain, "  ")), pc.starts_with(plain, " "))
        odd = odd.to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(plain, " ")
        keys, counts = cut.flatten(), np.diff(cut.offsets.to_numpy())
        if not odd.any():
            return keys, counts
        begins = np.cumsum(counts) - counts
        parts, at = [], 0
        for i in np.nonzero(odd)[0]:
            parts.append(keys.slice(at, begins[i] - at))
            text = plain[i].as_py()
            own = [x[1:] for x in _RUNS.findall(" " + text)] if text else []
            parts.append(pa.array(own, keys.type))
            at, counts[i] = begins[i] + counts[i], len(own)
        return pa.concat_arrays([*parts, keys.slice(at)]), counts

    def _ids(self, key: str) -> list[int]:
        found: list[int] = []
        for token in self.table.tokens(" " + key):
            if token in self.id:
                found.append(self.id[token])
            else:
                found += [self.byte[b] for b in token.encode()]
        return found

    def _learn(self, keys: list[str]) -> None:
        ids, lengths = [self.ids], []
        for key in keys:
            ids.append(np.array(self._ids(key), "<u4"))
            lengths.append(len(ids[-1]))
        first = len(self.memory)
        self.memory.update(zip(keys, range(first, first + len(keys)), strict=True))
        self.ids = np.concatenate(ids)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths, dtype=np.int64)])

    def encode(self, texts: pa.Array, remembered: int = tokens.REMEMBERED) -> tuple[np.ndarray, np.ndarray]:
        found = super().encode(texts, remembered)
        # long words are met once: leave room for the others
        if self.starts[-1] > 16 * remembered:
            self._forget()
        return found


_TABLES: dict[str, PieceTable] = {}


def encoder(path: str) -> PieceTable:
    """A worker's table of a model file."""
    if path not in _TABLES:
        _TABLES[path] = PieceTable(path)
    return _TABLES[path]


def encode_documents(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit, begin and end ids included) and decoded of every row's whole text.

    Null texts count as empty and have the begin and end ids alone. Rows stay rows: repeated ones are repeated, null ids
    stay null, an empty table gives an empty one. Only the two named columns are read, so others may have any name.
    """
    own = docs.select(F.col(id_column).alias("doc_id"), text_of(text).alias("text"))

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder(model)
        ends = np.array([table.bos], "<u4"), np.array([table.eos], "<u4")
        for whole in batches:
            for batch in tokens.slices(whole, "text"):
                ids, bounds = table.encode(batch["text"])
                each = [np.concatenate([ends[0], ids[a:b], ends[1]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                decoded = [table.library.decode(x.tolist()) for x in each]
                out = [batch["doc_id"], pa.array([x.tobytes() for x in each], pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"])
        trim()

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(code, f"doc_id {kind}, ids binary, decoded string")
