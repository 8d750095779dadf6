"""Words, window hashes and the like over Arrow text columns, by numpy over the UTF-8 bytes (inside tasks)."""

from __future__ import annotations

import ctypes
import hashlib
import os
from functools import wraps

import numpy as np
import pyarrow as pa

#: The separators of words: space and tab to carriage return. In UTF-8 these bytes stand for nothing else.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
BYTES, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5  # odd multipliers
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool keeps it, and so does malloc where it can be told not to."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim:
        trim(0)


def giving_back(run):
    """A function of batches after which its worker, which waits for other tasks, holds no memory that it has freed."""

    @wraps(run)
    def each(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return each


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            both.append(np.cumprod(a))
        got = (both[0], both[1])
        if size <= 1 << 21:
            _powers[base] = got
    return got[0][:n], got[1][:n]


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of documents of at most `most` bytes together, or of one document."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word and, for each document, where its words start (n + 1)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = SEPARATOR[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    before[firsts] = True
    after[firsts[firsts > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    power, inverse = powers(BYTES, len(data))
    sums = _sums((data.astype(np.uint64) + np.uint64(1)) * power)
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(SECOND))
    return hashes, np.searchsorted(starts, offsets)


def window_hashes(words: np.ndarray, k: int, base: int = FIRST) -> np.ndarray:
    """A 64-bit hash of each k consecutive words; windows that run over the end of a document are for the caller to drop."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    power, inverse = powers(base, len(words))
    sums = _sums(words * power)
    return mix((sums[k:] - sums[:-k]) * inverse[: len(words) - k + 1])


def sliding_argmin(x: np.ndarray, k: int) -> np.ndarray:
    """For each k consecutive values the place of the first least one, by doubling."""
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, span = np.arange(len(x)), 1

    def least(a, b):
        return np.where(x[b] < x[a], b, a)

    while span * 2 <= k:
        at = least(at[: len(at) - span], at[span:])
        span *= 2
    return least(at[:n], at[k - span : k - span + n])


class Growing:
    """A numpy array that grows at its end, in amortised time."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1024, kind), 0

    def add(self, x: np.ndarray) -> None:
        n = self.n + len(x)
        if n > len(self.data):
            bigger = np.zeros(max(n, 2 * len(self.data)), self.data.dtype)
            bigger[: self.n] = self.data[: self.n]
            self.data = bigger
        self.data[self.n : n] = x
        self.n = n

    @property
    def now(self) -> np.ndarray:
        return self.data[: self.n]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1] and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one, its code points, and where each text begins (n + 1)."""
    joined = "".join(texts)
    return joined, np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64)).astype(np.int64)


class Known:
    """Pieces of text that were met before, numbered from 0: found by hash, then compared in full.

    The caller keeps what it knows about each piece under its number. When there are more than `most` pieces, those met
    only once since the last time go, the others are numbered anew (`forget` says how)."""

    def __init__(self, most: int):
        self.most = most
        self._reset(np.zeros(0, np.uint64), Growing(np.uint32), np.zeros(0, np.int64))

    def _reset(self, hashes: np.ndarray, codes: Growing, lengths: np.ndarray) -> None:
        self.hashes, self.codes = Growing(np.uint64), codes
        self.start, self.length, self.again = Growing(np.int64), Growing(np.int64), Growing(bool)
        self.slots = np.full(1 << 16, -1, np.int64)
        self._enter(hashes, lengths)

    def _enter(self, hashes: np.ndarray, lengths: np.ndarray) -> None:
        first = self.hashes.n
        at = self.start.now[-1] + self.length.now[-1] if self.start.n else 0
        self.start.add(at + np.cumsum(lengths) - lengths)
        self.length.add(lengths)
        self.hashes.add(hashes)
        self.again.add(np.zeros(len(hashes), bool))
        if 3 * self.hashes.n > len(self.slots):
            self.slots = np.full(1 << (4 * self.hashes.n).bit_length(), -1, np.int64)
            first = 0
        new = np.arange(first, self.hashes.n)
        slot = (self.hashes.now[first:] & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(new):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]
            left = self.slots[slot] != new
            new, slot = new[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _look(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the piece of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        open_, slot = np.arange(len(hashes)), (hashes & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(open_):
            got = self.slots[slot]
            hit = (got >= 0) & (self.hashes.now[np.maximum(got, 0)] == hashes[open_]) if self.hashes.n else np.zeros(len(open_), bool)
            out[open_[hit]] = got[hit]
            on = (got >= 0) & ~hit
            open_, slot = open_[on], (slot[on] + 1) & (len(self.slots) - 1)
        return out

    def find(self, joined: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn, forget) -> np.ndarray:
        """The numbers of the pieces codes[starts:ends].

        learn(list of new pieces) is called with pieces that get the next numbers; forget(numbers that stay) before that."""
        lengths = ends - starts
        power, inverse = powers(BYTES, len(codes) + 1)
        sums = _sums((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)])
        hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + lengths.astype(np.uint64) * np.uint64(SECOND))
        number = self._look(hashes)
        if self.hashes.n and self.hashes.n + np.count_nonzero(number < 0) > self.most:
            stay = np.flatnonzero(self.again.now)
            stay = stay if 2 * len(stay) <= self.most else stay[:0]
            kept, old = Growing(np.uint32), self.codes.now
            kept.add(old[spread(self.start.now[stay], self.length.now[stay])])
            forget(stay)
            self._reset(self.hashes.now[stay], kept, self.length.now[stay])
            number = self._look(hashes)
        self.again.now[number[number >= 0]] = True
        out, open_, level = np.empty(len(starts), np.int64), np.arange(len(starts)), 0
        while len(open_):  # a second time only if two pieces have one hash: then the later one gets another
            missed = np.flatnonzero(number < 0)
            if len(missed):
                _, first = np.unique(hashes[missed], return_index=True)
                new = missed[np.sort(first)]
                a, n = starts[open_[new]], lengths[open_[new]]
                self.codes.add(codes[spread(a, n)])
                learn([joined[x : x + y] for x, y in zip(a.tolist(), n.tolist())])
                self._enter(hashes[new], n)
                number[missed] = self._look(hashes[missed])
            own = lengths[open_]
            good = self.length.now[number] == own
            own = np.where(good, own, 0)
            equal = self.codes.now[spread(self.start.now[number], own)] == codes[spread(starts[open_], own)]
            if not equal.all():
                good[np.repeat(np.arange(len(number)), own)[~equal]] = False
            out[open_[good]] = number[good]
            open_, level = open_[~good], level + 1
            if len(open_):
                other = [hashlib.blake2b(joined[a:b].encode(), digest_size=8, salt=level.to_bytes(8)).digest() for a, b in zip(starts[open_].tolist(), ends[open_].tolist())]
                hashes = np.frombuffer(b"".join(other), np.uint64)
                number = self._look(hashes)
        return out


def groups_of(lengths: list[int], most: int = 1 << 18):
    """Ranges of texts of at most `most` characters together, or of one text."""
    at, held = 0, 0
    for i, n in enumerate(lengths):
        if i > at and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(lengths):
        yield at, len(lengths)
