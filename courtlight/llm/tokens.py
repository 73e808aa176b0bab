"""Encoding whole texts with a tokenizer file, with a memory for pieces that come again and again."""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers; when it has more it keeps those met first, the common ones. Only speed depends on it.
REMEMBERED = 800_000
#: White space, as any of the libraries sees it, before a space or line feed.
_SPACED = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}][ \n]"

#: A word of common letters, with at most one character of white space before and one mark behind: each of these is
#: a pre-token of its own (a space goes with the word).
_PLAIN = re.compile("([ \n]?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)")


def _spelled() -> dict[int, int]:
    """The byte-level alphabet by its rule: visible Latin-1 characters stand for themselves, others for 256 and on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: 256 + i for i, b in enumerate(hidden)}


_SPELLED = _spelled()


class PieceEncoder:
    """The ids that encoding each whole text gives, one text behind the other, and where each text's ids begin.

    A text is cut before every space or line feed that follows a character other than white space. Neither kind of
    pre-tokenizer lets a token pass such a place, nor does a special token's string hold white space, so pieces can
    be encoded one by one and joined. dropped: white space gives no ids at all, and a cut may fall at any space.
    """

    def __init__(self, path: str, dropped: bool):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.dropped = Tokenizer.from_file(path), dropped
        self.single = {x: self._whole([x])[0] for x in ("", ".", ",", "\n", " ")}
        self.memory: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Keep the first two fifths of the pieces: they are numbered in the order in which they were met."""
        kept = len(self.memory) * 2 // 5
        self.memory = dict(zip(islice(self.memory, kept), range(kept), strict=True))
        self.starts = self.starts[: len(self.memory) + 1].copy()
        self.ids = self.ids[: self.starts[-1]].copy()

    def _keys(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pieces and how many each text has. A key is a piece; \\0 before it means that no space goes before."""
        if self.dropped:
            cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            return cut.flatten(), np.diff(cut.offsets.to_numpy())
        odd = pc.or_(pc.match_substring_regex(texts, _SPACED), pc.match_substring(texts, "\0")).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts) if odd.any() else texts
        cut = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\0", texts.type), pc.replace_substring(plain, "\n", " \n"), pa.scalar("", texts.type)), " ")
        keys, counts = cut.flatten(), np.diff(cut.offsets.to_numpy())
        if odd.any():
            values = keys.to_pylist()
            ends = np.cumsum(counts)
            merged: list[str] = []
            for i, (n, end, is_odd) in enumerate(zip(counts, ends, odd, strict=True)):
                own = ["\0" + x for x in re.split(r"(?<=\S)(?=[ \n])", texts[i].as_py())] if is_odd else values[end - n : end]
                merged += own
                counts[i] = len(own)
            keys = pa.array(merged, texts.type)
        return keys, counts

    def _shown(self, key: str) -> str:
        return key if self.dropped else key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else " " + key

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model_ids(self, word: str) -> list[int]:
        """A pre-token of letters, perhaps behind a space, straight to the model's merges."""
        spelled = (word.lower() if self.dropped else word).encode()
        return [t.id for t in self.tokenizer.model.tokenize(spelled.decode("latin-1").translate(_SPELLED))]

    def _learn(self, keys: list[str]) -> None:
        lengths, ids = [], [self.ids]
        for at in range(0, len(keys), 20_000):
            shown = [self._shown(k) for k in keys[at : at + 20_000]]
            plain = list(map(_PLAIN.fullmatch, shown))
            others = iter(self._whole([x for x, m in zip(shown, plain, strict=True) if not m]))
            got = []
            for m in plain:
                if not m:
                    got.append(next(others))
                    continue
                lead, word, mark = m.groups()
                if not self.dropped and lead == " ":
                    lead, word = "", lead + word
                got.append(self.single[lead] + self._model_ids(word) + self.single[mark])
            lengths += map(len, got)
            ids.append(np.fromiter((i for x in got for i in x), "<u4"))
        first = len(self.memory)
        self.memory.update(zip(keys, range(first, first + len(keys)), strict=True))
        self.ids = np.concatenate(ids)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths, dtype=np.int64)])

    def encode(self, texts: pa.Array, remembered: int = REMEMBERED) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memory) > remembered:
            self._forget()
        keys, counts = self._keys(texts)
        coded = keys.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [k for k in names if k not in self.memory]:
            self._learn(new)
        known = np.fromiter(map(self.memory.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]
        starts, lengths = self.starts[known], self.starts[known + 1] - self.starts[known]
        ends = np.cumsum(lengths)
        places = np.repeat(starts - (ends - lengths), lengths)
        places += np.arange(len(places))
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.ids[places], bounds


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encode(path: str, dropped: bool, texts: pa.Array, remembered: int = REMEMBERED) -> tuple[np.ndarray, np.ndarray]:
    """PieceEncoder.encode; a worker keeps one encoder, whose memory serves all its tasks."""
    if (path, dropped) not in _ENCODERS:
        _ENCODERS[path, dropped] = PieceEncoder(path, dropped)
    return _ENCODERS[path, dropped].encode(texts, remembered)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Parts of a batch whose texts have about `most` bytes, or one row: memory stays bounded for long texts."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)
