"""Vectorised words, word hashes and shingles over Arrow text columns (UTF-8 bytes, no per-word Python)."""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
LONG = 1024  # bytes of a word from which on it is hashed by itself
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)  # of the first k bytes


def powers(n: int) -> list[np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; for strings of a few characters only (long ones can be made to collide)."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 12)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(size, base, U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return [p[:n] for p in _powers]


def release() -> None:
    """Give freed memory back to the system: a Python worker stays after its task and counts for its executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What a Python worker does to forget all that its tasks remembered for the next ones.
forgets: list = []


def released(work, remembers: bool = False):
    """``work(batches)`` that releases memory at its end; what other work remembered is forgotten at its beginning, unless this one ``remembers`` too."""

    def run(batches):
        if not remembers:
            for forget in forgets:
                forget()
        try:
            yield from work(batches)
        finally:
            release()

    return run


def streamed(keys: int, work, enough: int = 20_000):
    """Arrow batches sorted by their first ``keys`` columns, handed to ``work`` (table, bounds of the groups) in runs of whole groups."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
            new = np.zeros(batch.num_rows, bool)
            for k, c in enumerate(columns):
                new[1:] |= c[1:] != c[:-1]
                new[0] |= last is None or last[k] != c[0]
            last = [c[-1] for c in columns]
            cuts = np.flatnonzero(new)
            if len(cuts) and held and sum(b.num_rows for b in held) + cuts[-1] >= enough:
                held.append(batch.slice(0, cuts[-1]))
                yield from groups(held)
                held = [batch.slice(cuts[-1])]
            else:
                held.append(batch)
        if held:
            yield from groups(held)

    def groups(held):
        t = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in range(keys):
            c = t.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        if out := list(work(t, np.append(np.flatnonzero(new), t.num_rows))):
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and xor-shift rounds."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xA0761D6478BD642F)
    h ^= h >> U(32)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null text is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = pa.compute.fill_null(column, b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw, at - (at[0] if len(at) else 0)


def packed(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.itemsize * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def unpacked(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The matrix of a column of binary values of one size."""
    data, at = utf8(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return np.ascontiguousarray(data).view(kind).reshape(len(at) - 1, -1) if len(data) else np.zeros((len(at) - 1, 0), kind)


def chunks(at: np.ndarray, limit: int = 1 << 20):
    """Runs of texts of about ``limit`` bytes; a longer text is a run of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return data + ((data - np.uint8(65) < 26) * np.uint8(32)).astype(np.uint8)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a run of texts: byte spans, text number, 64-bit hash."""

    def __init__(self, data: np.ndarray, at: np.ndarray, fold: bool = True):
        data = lower(data) if fold else data
        n = len(data)
        solid = ~((data == 32) | (data - np.uint8(9) < 5))
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        self.start = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, at)  # of the words of each text, and the end
        self.data, self.at = data, at
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """Of each word, eight bytes at a time: each step is one-to-one in the bytes and in the state before, so short words never collide
        and nothing about a longer word's pattern makes it collide. Equal words have equal hashes wherever they are."""
        size = self.end - self.start
        raw = np.zeros(len(self.data) + 8, np.uint8)
        raw[: len(self.data)] = self.data
        eight = np.ndarray(len(self.data) + 1, "<u8", raw, strides=(1,))  # the eight bytes from each place on
        out = (size.astype(U) + U(1)) * U(0x8CB92BA72F3D8DD7)
        live, at = np.arange(len(size)), self.start
        for done in range(0, LONG, 8):
            part = eight[at] & _MASKS[np.minimum(size[live] - done, 8)]
            out[live] = mix(out[live] + part * U(0x9E3779B97F4A7C15))
            more = size[live] > done + 8
            live, at = live[more], at[more] + 8
            if not len(live):
                break
        for m in live:
            out[m] = U(int.from_bytes(hashlib.blake2b(self.data[self.start[m] : self.end[m]].tobytes(), digest_size=8).digest(), "little"))
        return out

    def text(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words, positions of their first words, and where each text's begin.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    first, h = words.first, words.hash
    count = np.diff(first)
    many = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(many)])
    pos = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], many)
    out = np.full(len(pos), U(size))
    short = np.repeat(count < size, many)
    length = np.where(short, np.repeat(count, many), size)
    for k in range(size):
        rest = k < length
        if rest.all():
            out = mix(out * U(0xE7037ED1A0B428DB) + h[pos + k])
        else:
            out[rest] = mix(out[rest] * U(0xE7037ED1A0B428DB) + h[pos[rest] + k])
    out[short] ^= mix(length[short].astype(U))
    return out, pos, bounds


class Arena:
    """Id sequences by key in one flat array; emptied when it holds more than ``room`` keys (results do not depend on it)."""

    def __init__(self, room: int):
        self.room = room
        self.forget()

    def forget(self) -> None:
        self.number: dict = {}
        self.begin, self.end = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.flat, self.full = np.zeros(1, np.int32), 0

    def learn(self, keys: list, ids: np.ndarray, counts: np.ndarray) -> None:
        """``keys`` not yet known, their ids one after the other and how many each has."""
        first = len(self.number)
        self.number.update(zip(keys, range(first, first + len(keys))))
        grown = lambda x, n: x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])
        many = len(self.number)
        self.begin, self.end, self.flat = grown(self.begin, many), grown(self.end, many), grown(self.flat, self.full + len(ids))
        self.end[first:many] = self.full + np.cumsum(counts)
        self.begin[first:many] = self.end[first:many] - counts
        self.flat[self.full : self.full + len(ids)] = ids
        self.full += len(ids)

    def gather(self, keys: list, meet) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``keys`` one after the other, and where each key's begin (and the end). ``meet`` learns a list of new keys."""
        if len(self.number) > self.room:
            self.forget()
        number = np.fromiter(map(self.number.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(number < 0).tolist()
        if new:
            meet(list({keys[k] for k in new}))
            number[new] = [self.number[keys[k]] for k in new]
        begin, counts = self.begin[number], (self.end - self.begin)[number]
        at = np.concatenate([[0], np.cumsum(counts)])
        return self.flat[np.arange(at[-1]) + np.repeat(begin - at[:-1], counts)], at
