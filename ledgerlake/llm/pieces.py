"""SentencePiece encoding and decoding by batched numpy Viterbi.

A model file's pieces become a sorted array of 64-bit keys. Text is cut before each run of spaces (no piece
reaches from a letter into a following space), each distinct cut is segmented once, and cuts of equal length
advance together: for each end, substring hashes of all starts probe the keys, and vectorised maxima keep the
backpointers. A cut of more than ``LONG`` characters is alone with its length, so there all its places are probed together and
one pass keeps the backpointers. Unknown characters become byte pieces, so decoding gives the text back; decoding gathers the bytes of all pieces of a batch at once.

A BPE file has merge ranks in place of log probabilities; they become Zipf weights, log(1 / (rank + 2)).

Defined cases: a null or empty text has no pieces and decodes to an empty text; a literal U+2581 reads back as
a space; null doc_ids pass through; equal rows get equal rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._words import Arena, U, chunks, forgets, mix, powers, released, utf8

SPACE, PENALTY, ROOM, LONG = "▁", np.float32(10), 1_000_000, 1024
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values: kinds of piece in a model file
BPE = 2
_open: dict[str, Model] = {}
forgets.append(_open.clear)


def fields(data: bytes):
    """(number, value) of a protocol buffer message: integers, raw 4- or 8-byte values, or bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[i : i + n]
            i += n


def hashes(code: np.ndarray) -> np.ndarray:
    """Prefix sums (rows, length + 1) from which any substring's hash follows."""
    p, _ = powers(code.shape[1] + 1)
    out = np.zeros((code.shape[0], code.shape[1] + 1), U)
    np.cumsum((code.astype(U) + U(1)) * p[:-1], axis=1, out=out[:, 1:])
    return out


def spans(total: np.ndarray, s: int, e: int) -> np.ndarray:
    """Hash of characters s to e of every row; ``total`` has a row for each place."""
    _, q = powers(len(total))
    return (total[e] - total[s]) * q[s]


def keyed(h: np.ndarray, size: int) -> np.ndarray:
    return mix(h + U(size * 0x8CB92BA72F3D8DD7 & 0xFFFFFFFFFFFFFFFF))


class Model:
    def __init__(self, path: str):
        raw = open(path, "rb").read()
        self.pieces, self.kinds, scores, spec = [], [], [], {}
        for number, value in fields(raw):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(fields(value))
        scores = np.array(scores)
        if spec.get(3) == BPE:
            scores = -np.log(2 - np.minimum(scores, 0))
        self.scores = scores.astype(np.float32)
        usable = [k for k, kind in enumerate(self.kinds) if kind == NORMAL]
        self.unknown = self.scores[usable].min() - PENALTY
        self.bytes = {int(self.pieces[k][3:5], 16): k for k, kind in enumerate(self.kinds) if kind == BYTE}
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(SPACE, " ").encode() for p, kind in zip(self.pieces, self.kinds)]
        self.sizes = np.array([len(x) for x in self.raw], np.int64)
        self.bytes_at, self.all = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.raw), np.uint8)
        self.widths = np.array([len(p) for p in self.pieces])
        self.longest = max(len(self.pieces[k]) for k in usable)
        self.characters = {self.pieces[k] for k in usable if len(self.pieces[k]) == 1}
        lengths: dict[int, list[int]] = {}
        for k in usable:
            lengths.setdefault(len(self.pieces[k]), []).append(k)
        keys, ids, self.seen = [], [], np.zeros(1 << 20, bool)
        for n, group in lengths.items():
            code = np.frombuffer("".join(self.pieces[k] for k in group).encode("utf-32-le"), np.uint32).reshape(-1, n)
            h = spans(np.ascontiguousarray(hashes(code).T), 0, n)
            self.seen[h >> U(44)] = True
            keys.append(keyed(h, n))
            ids += group
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(ids)[order]
        self.memory = Arena(ROOM)  # distinct cuts met so far

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """Ids of words of one length, a list for each."""
        ids, counts = self.segment(words)
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, one after the other, and how many each has: all advance together.

        Most substrings are no piece; a bit for the top of each hash says so before the keys are searched.
        """
        size, many = len(words[0]), len(words)
        code = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(many, size)
        total = np.ascontiguousarray(hashes(code).T)
        best = np.full((size + 1, many), -np.inf, np.float32)
        best[0] = 0
        back, piece = (np.zeros((size + 1, many), np.int32) for _ in range(2))
        for e in range(1, size + 1):
            for s in range(max(0, e - self.longest), e):
                h = spans(total, s, e)
                row = np.flatnonzero(self.seen[h >> U(44)])
                key = keyed(h[row], e - s)
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                row, which = row[hit], self.ids[at[hit]]
                score = best[s, row] + self.scores[which]
                if s == e - 1:
                    known = np.zeros(many, bool)
                    known[row] = True
                    odd = np.flatnonzero(~known)
                    row, which = np.concatenate([row, odd]), np.concatenate([which, np.full(len(odd), -1)])
                    score = np.concatenate([score, best[s, odd] + self.unknown])
                better = score > best[e, row]
                row = row[better]
                best[e, row], back[e, row], piece[e, row] = score[better], s, which[better]
        ends, found, rows = np.full(many, size), [], []
        live = np.arange(many)
        while len(live):
            found.append(piece[ends, live])
            rows.append(live)
            ends = back[ends, live]
            live, ends = live[ends > 0], ends[ends > 0]
        found, rows, turn = np.concatenate(found), np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        order = np.lexsort((-turn, rows))
        found, counts = found[order], np.bincount(rows, minlength=many)
        odd = np.flatnonzero(found < 0)
        if len(odd):  # unknown characters become their bytes
            rows = rows[order]
            width = np.where(found < 0, 1, self.widths[found])
            start = np.cumsum(width) - width - rows * size
            raw = [[self.bytes[x] for x in chr(c).encode("utf-8", "replace")] for c in code[rows[odd], start[odd]].tolist()]
            times = np.ones(len(found), np.int64)
            times[odd] = [len(r) for r in raw]
            counts = np.bincount(rows, times, many).astype(np.int64)
            unknown = np.repeat(found < 0, times)
            found = np.repeat(found, times)
            found[unknown] = [k for r in raw for k in r]
        return found, counts

    def segment_long(self, word: str) -> np.ndarray:
        """Ids of one long word: pieces of each length are probed at all places together, then one pass over the places."""
        code = np.frombuffer(word.replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        total = hashes(code[None])[0]
        _, q = powers(n + 1)
        ends, starts, found = [], [], []
        for size in range(1, min(self.longest, n) + 1):
            h = (total[size:] - total[:-size]) * q[: n - size + 1]
            row = np.flatnonzero(self.seen[h >> U(44)])
            key = keyed(h[row], size)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            starts.append(row[hit])
            ends.append(row[hit] + size)
            found.append(self.ids[at[hit]])
        start, end, which = (np.concatenate(x) for x in (starts, ends, found))
        order = np.lexsort((start, end))
        start, which, score = start[order].tolist(), which[order].tolist(), self.scores[which[order]].tolist()
        cut = np.searchsorted(end[order], np.arange(n + 2)).tolist()
        unknown, best, back, piece = float(self.unknown), [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        for e in range(1, n + 1):
            top, s0, w0, single = -np.inf, e - 1, -1, False
            for k in range(cut[e], cut[e + 1]):
                s = start[k]
                single = single or s == e - 1
                if best[s] + score[k] > top:
                    top, s0, w0 = best[s] + score[k], s, which[k]
            if not single and best[e - 1] + unknown > top:
                top, s0, w0 = best[e - 1] + unknown, e - 1, -1
            best[e], back[e], piece[e] = top, s0, w0
        out, e = [], n
        while e:
            out += [piece[e]] if piece[e] >= 0 else [self.bytes[x] for x in reversed(chr(code[e - 1]).encode("utf-8", "replace"))]
            e = back[e]
        return np.array(out[::-1], np.int64)

    def meet(self, words: list[str]) -> None:
        """Segment new words, those of one length together."""
        new: dict[int, list[str]] = {}
        for w in words:
            new.setdefault(len(w), []).append(w)
        for size, group in new.items():
            if size > LONG:
                ids = [self.segment_long(w) for w in group]
                self.memory.learn(group, np.concatenate(ids), np.array([len(x) for x in ids]))
                continue
            step = max(1, min(20_000, 4_000_000 // (size + 1)))
            for i in range(0, len(group), step):
                part = group[i : i + step]
                self.memory.learn(part, *self.segment(part))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cuts = [self.cut(t) for t in texts]
        ids, at = self.memory.gather([w for c in cuts for w in c], self.meet)
        return np.split(ids, at[np.cumsum([len(c) for c in cuts], dtype=np.int64)][:-1]) if texts else []

    @staticmethod
    def cut(text: str) -> list[str]:
        """Runs of spaces each with what follows; a space comes before the text."""
        return re.findall(" +[^ ]*", " " + text.replace(SPACE, " ")) if text else []

    def decode(self, ids) -> str:
        return self.decode_all([np.asarray(ids, np.int64)])[0]

    def decode_all(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of id sequences: the bytes of all their pieces gathered at once."""
        flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
        sizes = self.sizes[flat]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.all[np.arange(ends[-1]) + np.repeat(self.bytes_at[flat] - ends[:-1], sizes)].tobytes()
        cut = ends[np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])].tolist()
        return [raw[s:e].decode("utf-8", "replace")[1:] for s, e in zip(cut, cut[1:])]


def model(path: str) -> Model:
    if path not in _open:
        _open[path] = Model(path)
    return _open[path]


def encode_texts(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian 32-bit ids), decoded_sha256, same (decodes to its text)[, ids] of ``docs(doc_id, text)``."""
    import hashlib

    def work(batches):
        m = model(path)
        for b in batches:
            _, at = utf8(b.column(1))
            for i, j in chunks(at, 1 << 23):
                texts = [t or "" for t in b.column(1).slice(i, j - i).to_pylist()]
                ids = m.encode(texts)
                back = m.decode_all(ids)
                out = [b.column(0).slice(i, j - i), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in back]), pa.array([x == t for x, t in zip(back, texts)], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*out, pa.array(ids, pa.list_(pa.int32()))] if with_ids else out, ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "same", *["ids"] * with_ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(work, remembers=True), "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, same boolean" + ", ids array<int>" * with_ids)


def known(m: Model, column: pa.ListArray) -> list[str | None]:
    """Texts of a column of id lists; null where the list is."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    texts = m.decode_all([flat[s:e] for s, e in zip(ends[:-1], ends[1:])])
    return [t if ok else None for t, ok in zip(texts, column.is_valid().to_pylist())]


def decode_texts(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of ``encoded(doc_id, ids)``; null ids give a null text."""

    def work(batches):
        m = model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(known(m, b.column(1)), pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")
