"""Fast exact encoding with a public tokenizer, in a Python worker.

A unit is a run of ASCII white space with the word after it.  In the
tokenizers used here no pre-token spans the end of a word before ASCII white
space, and normalisation doesn't look across it, so the ids of a text are the
ids of its units in order.  A text with white space beyond ASCII, which may
merge with its neighbours, is one unit.  Units repeat; each worker keeps the
ids of those it has met, up to a bound.  Hashes find a unit, bytes decide.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from lexloom.llm import textkit as tk

#: Bytes of units and ids that a worker remembers before it starts anew.
REMEMBERED = 96 << 20
#: Bytes that are new before they are merged with those that are known.
RECENT = 5 << 20
#: White space beyond ASCII: texts that have it may merge it with ASCII white space, so they are encoded whole.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_OTHER_BYTES = re.compile(b"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


@lru_cache(4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def plain(path: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def encoded(path: str, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of slices that are texts, one after another, and how many each has."""
    data = buf[int(s.min()) : int(e.max())].tobytes() if len(s) else b""
    low = int(s.min()) if len(s) else 0
    got = plain(path, [data[a:b].decode() for a, b in zip((s - low).tolist(), (e - low).tolist(), strict=True)])
    size = np.array([len(x) for x in got], np.int64)
    return np.fromiter((i for x in got for i in x), np.uint32, int(size.sum())), size


def units(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first unit of each text; white space at the end is a unit too."""
    _, e, first = tk.spans(buf, off)
    docs = np.arange(len(off) - 1)
    last_end = np.where(first[1:] > first[:-1], e[np.maximum(first[1:] - 1, 0)] if len(e) else 0, off[:-1])
    tail = docs[last_end < off[1:]]
    end = np.concatenate([e, off[1:][tail]])
    whole = alone(buf, off)
    if whole.any():
        doc = np.searchsorted(off, end, "left") - 1
        end = end[~whole[doc] | (end == off[doc + 1])]
    end.sort(kind="stable")
    first = np.searchsorted(end, off, "right")
    first[0] = 0
    start = np.empty_like(end)
    if len(end):
        start[0] = off[0]
        start[1:] = end[:-1]
    return start, end, first


def distinct(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct units, the first of each, and for each unit which it is."""
    h = tk.slice_hashes(buf, s, e)
    keys, rep, back = np.unique(h, return_index=True, return_inverse=True)
    again = np.flatnonzero(rep[back] != np.arange(len(s)))
    r = rep[back[again]]
    odd = again[~tk.same_bytes(buf, s[again], e[again], buf, s[r], e[r])]
    if len(odd):  # units that share a hash: each stands for itself
        back[odd] = len(rep) + np.arange(len(odd))
        keys, rep = np.concatenate([keys, h[odd]]), np.concatenate([rep, odd])
    return keys, rep, back


def joined_slices(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return gather(buf, s, e - s)


class UnitTable:
    """Ids by unit: sorted hashes, the units' bytes, where their ids start, and the ids."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.start, self.end, self.at, self.size = (np.zeros(0, np.int64) for _ in range(4))
        self.data, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each unit its place in the table, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        near = np.flatnonzero(hit)
        hit[near] = tk.same_bytes(buf, s[near], e[near], self.data, self.start[at[near]], self.end[at[near]])
        return at, hit

    def add(self, keys, data: np.ndarray, length: np.ndarray, ids: np.ndarray, size: np.ndarray):
        """Adds units (``data`` has their bytes, one after another) and their ids."""
        end, order = np.cumsum(length), np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        at = np.cumsum(size) - size + len(self.ids)
        for name, new in (("keys", keys), ("start", end - length + len(self.data)), ("end", end + len(self.data)), ("at", at), ("size", size)):
            setattr(self, name, np.concatenate([getattr(self, name), new])[order])
        self.data, self.ids = np.concatenate([self.data, data]), np.concatenate([self.ids, ids])

    def added(self, other: UnitTable):
        self.add(other.keys, joined_slices(other.data, other.start, other.end), other.end - other.start, gather(other.ids, other.at, other.size), other.size)

    def nbytes(self) -> int:
        return len(self.data) + 4 * len(self.ids) + 40 * len(self.keys)


def gather(ids: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenates ``ids[at : at + size]`` for each entry."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, ids.dtype)
    ends = np.cumsum(size)
    step = np.repeat(at - (ends - size), size)
    return ids[step + np.arange(total)]


#: Bytes with which white space beyond ASCII may start.
_LEADS = np.isin(np.arange(256), [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3])


def alone(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts that can't be cut into units: they have white space beyond ASCII."""
    out = np.zeros(len(off) - 1, bool)
    maybe = np.flatnonzero(_LEADS[buf])
    if not len(maybe):
        return out
    for i in np.unique(np.searchsorted(off, maybe, "right") - 1).tolist():
        out[i] = _OTHER_BYTES.search(buf[off[i] : off[i + 1]].tobytes()) is not None
    return out


class Encoder:
    """Encodes pieces of texts; what it remembers stays below ``remembered`` bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.path, self.remembered = path, remembered
        self.own, self.recent = UnitTable(), UnitTable()

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and where each text's ids start."""
        s, e, first = units(buf, off)
        keys, rep, back = distinct(buf, s, e)
        at, size, flat, base = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), [], 0
        left = np.arange(len(keys))
        for table in (self.own, self.recent):
            place, hit = table.find(keys[left], buf, s[rep[left]], e[rep[left]])
            at[left[hit]], size[left[hit]] = table.at[place[hit]] + base, table.size[place[hit]]
            flat.append(table.ids)
            base += len(table.ids)
            left = left[~hit]
        if len(left):
            ids, n = encoded(self.path, buf, s[rep[left]], e[rep[left]])
            at[left], size[left] = base + np.cumsum(n) - n, n
            flat.append(ids)
            self.recent.add(keys[left], joined_slices(buf, s[rep[left]], e[rep[left]]), e[rep[left]] - s[rep[left]], ids, n)
        out = self._gather(flat, at[back], size[back])
        bounds = np.concatenate([[0], np.cumsum(size[back])])[first]
        if self.recent.nbytes() > min(RECENT, self.remembered):
            if self.own.nbytes() + self.recent.nbytes() > self.remembered:
                self.own.clear()
            if self.recent.nbytes() <= self.remembered:
                self.own.added(self.recent)
            self.recent.clear()
        return out, bounds

    @staticmethod
    def _gather(flat: list[np.ndarray], at: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros(int(size.sum()), np.uint32)
        ends = np.cumsum(size)
        index = np.repeat(at - (ends - size), size) + np.arange(len(out))
        low = 0
        for part in flat:
            mine = (index >= low) & (index < low + len(part))
            out[mine] = part[index[mine] - low]
            low += len(part)
        return out


@lru_cache(2)
def worker_encoder(path: str) -> Encoder:
    """The encoder that this worker keeps between tasks."""
    return Encoder(path)
