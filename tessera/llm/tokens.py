"""Public tokenizers over Arrow string arrays, part by part through a compact memo.

A text is cut before every run of ASCII white space, and before a closing mark that follows a plain letter. The
supported vocabularies pre-split at such places whatever stands around them, so the ids of the whole text are the
joined ids of its parts. Parts are hashed by whole batches; each distinct part is encoded once and its ids are kept
in one pool of integers. Rows with any other white space are encoded whole, and so is every text where a vocabulary's
normaliser or pre-splitting isn't one of those known to allow such cuts. A remembered part is known by two hashes of
64 bits each; a row with a part that shares only the first is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

from tessera.llm import words as W

#: Parts that a worker remembers; beyond it the memo starts anew. About 45 bytes each.
MEMO = 1_500_000
SLICE = 1 << 20
#: Slices after which freed memory goes back to the system: the memo's copies break up the heap.
TURNS = 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 13, 32]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?")] = True
_CONTROL = np.zeros(256, dtype=bool)
_CONTROL[[11, 12, 28, 29, 30, 31]] = True
#: White space and formatting beyond ASCII, which a vocabulary's own pattern may see differently.
_ODD = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the parts begin."""
    gap = _GAP[data]
    cut = gap.copy()
    cut[1:] &= ~gap[:-1]
    after = _LETTER[data]
    if len(data) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # U+00C0 to U+00FF
        after[1:] |= latin
        cut[1:] |= after[:-1] & _MARK[data[1:]]
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


def _odd_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    places = [np.flatnonzero(_CONTROL[data])]
    if (data == 0xC2).any() or (data >= 0xE1).any():
        text = data.tobytes()
        for needle in _ODD:
            at = text.find(needle)
            while at >= 0:
                places.append(np.array([at]))
                row = np.searchsorted(offsets, at, side="right")
                at = text.find(needle, int(offsets[row]) if row < len(offsets) else len(text))  # one a row will do
    return np.unique(np.searchsorted(offsets, np.concatenate(places), side="right") - 1)


#: Digests of the settings (normaliser, pre-splitting, model but for its tables, further tokens) that allow the cuts.
CUTTABLE = {"c63d8964dc8cefdc", "7f92f49fd8bb9caa"}  # byte-level pre-splitting; words in lower case


def settings_digest(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    model = {k: v for k, v in found["model"].items() if k not in ("vocab", "merges")}
    further = [{k: v for k, v in t.items() if k not in ("id", "content")} for t in found["added_tokens"]]
    told = [found["normalizer"], found["pre_tokenizer"], model, [t for t in further if not t["special"]]]
    return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()[:16]


class Encoder:
    """Slices of texts to unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cuttable = settings_digest(path) in CUTTABLE
        self.turns = 0
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.second = np.empty(0, np.uint64)
        self.first = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.pool = np.empty(1 << 16, np.uint32)
        self.used = 0

    def _learn(self, names: np.ndarray, seconds: np.ndarray, parts: list[str]) -> None:
        """names: sorted hashes that aren't known yet; seconds: the same parts' other hashes."""
        first, size = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        for lo in range(0, len(parts), 4096):
            found = [x.ids for x in self.tokenizer.encode_batch_fast(parts[lo : lo + 4096], add_special_tokens=False)]
            size[lo : lo + len(found)] = lengths = [len(x) for x in found]
            flat = np.fromiter((i for x in found for i in x), np.uint32, sum(lengths))
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
            self.pool[self.used : self.used + len(flat)] = flat
            first[lo : lo + len(found)] = self.used + np.cumsum(lengths) - lengths
            self.used += len(flat)
        at = np.searchsorted(self.known, names)
        self.known, self.second = np.insert(self.known, at, names), np.insert(self.second, at, seconds)
        self.first, self.size = np.insert(self.first, at, first), np.insert(self.size, at, size)

    def slices(self, array: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, bounds of the rows in ids); null counts as empty."""
        for lo, hi, data, offsets in W.slices(array, SLICE):
            self.turns += 1
            if self.turns % TURNS == 0:
                W.release()
            if self.cuttable:
                ids, bounds, mistaken = self._slice(data, offsets)
                odd = np.union1d(_odd_rows(data, offsets), mistaken)
            else:
                ids, bounds, odd = np.empty(0, np.uint32), np.zeros(hi - lo + 1, np.int64), np.arange(hi - lo)
            if len(odd):
                rows = [ids[bounds[i] : bounds[i + 1]] for i in range(hi - lo)]
                for i in odd:
                    rows[i] = np.array(self.tokenizer.encode_batch_fast([data[offsets[i] : offsets[i + 1]].tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
                ids, bounds = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
            yield lo, hi, ids, bounds

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, bounds, and the rows with a part that was taken for another one."""
        if len(self.known) > MEMO:
            self._forget()
        starts = _cuts(data, offsets)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64), np.empty(0, np.int64)
        sums, inverse = W.prefix_sums(data, W.RAW)
        names = W.mix((sums[ends] - sums[starts]) * inverse[starts])
        for i in np.flatnonzero(ends - starts > W.LONG_WORD):
            names[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
        sums, inverse = W.prefix_sums(data, W.OTHER)
        others = W.mix((sums[ends] - sums[starts]) * inverse[starts])
        distinct, sample, seat = np.unique(names, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            text = data.tobytes()
            self._learn(distinct[new], others[sample[new]], [text[s:e].decode() for s, e in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist(), strict=True)])
            at = np.searchsorted(self.known, distinct)
        at = at[seat]
        size = self.size[at]
        ahead = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.repeat(self.first[at] - ahead[:-1], size) + np.arange(ahead[-1])]
        wrong = np.flatnonzero(self.second[at] != others)
        return ids, ahead[np.searchsorted(starts, offsets)], np.unique(np.searchsorted(offsets, starts[wrong], side="right") - 1)

    def rows(self, array: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """Each row's ids and end_id, little-endian."""
        end = np.array([end_id], "<u4")
        for lo, hi, ids, bounds in self.slices(array):
            for i in range(hi - lo):
                yield np.concatenate([ids[bounds[i] : bounds[i + 1]], end]).astype("<u4", copy=False)


@cache
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


def vocabulary(name: str) -> str:
    """The default place of a public vocabulary file; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
