"""Token ids of whole columns with a ``tokenizers`` file whose pre-tokens never cross white space."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import ASCII_LOWER, string_buffers

#: Words whose ids a worker keeps; beyond it starts afresh.
KEEP_WORDS = 400_000

# 0 white space, 1 ASCII letter, 2 other ASCII, 3 never cut beside it (apostrophe, bytes of longer characters)
_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[0x41:0x5B] = 1
_KIND[0x61:0x7B] = 1
_KIND[0x27] = 3
_KIND[0x80:] = 3


class WordEncoder:
    """Encodes each distinct chunk of text once with the tokenizer and puts the documents' ids together.

    For the word-level byte-pair vocabularies served here (lower-casing, white space dropped), ids of a text
    are the ids of its parts, if it is cut at white space or between an ASCII letter and another ASCII
    character that is not an apostrophe: no pre-token and no normal form spans such a place. Texts that spell
    out a special token are given to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.clear()

    def clear(self) -> None:
        self.where: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.n = 0

    def _learn(self, words: list[str]) -> None:
        model = self.tokenizer.model
        ids, plain = [None] * len(words), []
        for i, w in enumerate(words):
            if w.isascii() and w.isalpha():
                ids[i] = [t.id for t in model.tokenize(w)]
            else:
                plain.append(i)
        for i, e in zip(plain, self.tokenizer.encode_batch_fast([words[i] for i in plain], add_special_tokens=False)):
            ids[i] = e.ids
        self.lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        self.parts.append(np.fromiter((x for y in ids for x in y), np.uint32, int(self.lengths[-1].sum())))
        for w in words:
            self.where[w] = self.n
            self.n += 1

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint32 of all rows, offsets of the rows); null counts as empty."""
        raw, off = string_buffers(column)
        whole = self._special_rows(raw, off)
        raw = ASCII_LOWER[raw]
        kind = _KIND[raw]
        prior = np.zeros_like(kind)
        prior[1:] = kind[:-1]
        filled = off[:-1] < off[1:]
        prior[off[:-1][filled]] = 0
        start = (kind > 0) & ((prior == 0) | ((kind ^ prior) == 3) & (kind < 3) & (prior < 3))
        at = np.flatnonzero(start)
        ink = kind > 0
        upto = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(ink, out=upto[1:])
        cuts = np.append(upto[at], upto[-1]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(cuts), pa.py_buffer(raw[ink]))
        coded = words.dictionary_encode()
        table = coded.dictionary.to_pylist()
        if self.n + len(table) > KEEP_WORDS:
            self.clear()
        new = [w for w in table if w not in self.where]
        if new:
            self._learn(new)
        place = np.fromiter((self.where[w] for w in table), np.int64, len(table))
        if len(self.parts) > 1:
            self.parts, self.lengths = [np.concatenate(self.parts)], [np.concatenate(self.lengths)]
        if not len(at):
            ids, bounds = np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        else:
            pool, length = self.parts[0], self.lengths[0]
            first = np.cumsum(length) - length
            use = place[np.asarray(coded.indices)]
            n = length[use]
            total = np.zeros(len(n) + 1, np.int64)
            np.cumsum(n, out=total[1:])
            ids = pool[np.repeat(first[use] - total[:-1], n) + np.arange(total[-1])]
            bounds = total[np.searchsorted(at, off)]
        return self._replaced(column, whole, ids, bounds) if len(whole) else (ids, bounds)

    def _special_rows(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        data, rows = raw.tobytes(), set()
        for token in self.special:
            mark, i = token.encode(), -1
            while (i := data.find(mark, i + 1)) >= 0:
                rows.add(int(np.searchsorted(off, i, side="right")) - 1)
        return np.array(sorted(rows), np.int64)

    def _replaced(self, column, rows, ids, bounds):
        out, upto = [], 0
        for r in rows:
            text = column[int(r)].as_py()
            text = text.decode() if isinstance(text, bytes) else text
            out += [ids[bounds[upto] : bounds[r]], np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)]
            upto = r + 1
        out.append(ids[bounds[upto] :])
        n = np.diff(bounds)
        n[rows] = [len(x) for x in out[1::2]]
        return np.concatenate(out), np.concatenate([[0], np.cumsum(n)])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file, kept between batches and tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
