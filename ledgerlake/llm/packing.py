"""Best-two-fit packing of tokenised documents into sequences.

Packing works on the histogram of piece lengths (at most ``size`` entries, whatever the corpus): a bin
*pattern* is filled greedily with the longest lengths that fit, its smallest length is replaced by two
unpacked lengths that fill the widened gap more tightly, and the pattern is repeated as often as the
counts allow. Every pattern exhausts a length, so there are few. A piece finds its place from its
number among pieces of its length; numbers are running counts inside a task plus offsets over tasks,
so no length, however common, is sorted or gathered in one task.

Defined cases: a null or empty text is the single id 0; a null ``doc_id`` is packed like any other and
stays null; equal rows are packed once each; extra columns are ignored; an empty table packs to nothing.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ._spark import settle
from ._words import Arena, chunks, forgets, released, utf8

SIZE, ROOM, TOGETHER = 2048, 1_500_000, 200
_open: dict[str, tuple] = {}
forgets.append(_open.clear)


def tokenizer(path: str) -> tuple:
    """The vocabulary and the ids of words met so far."""
    if path not in _open:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads would spin on the others
        from tokenizers import Tokenizer

        _open[path] = (Tokenizer.from_file(path), Arena(ROOM))
    return _open[path]


def learn(words: list[bytes], path: str) -> None:
    """Ids of new words, ``TOGETHER`` of them encoded as one text at a time; the place of each id tells its word."""
    known, memory = tokenizer(path)
    for i in range(0, len(words), TOGETHER * 512):
        part = [w.decode("utf-8", "replace") for w in words[i : i + TOGETHER * 512]]
        size = np.fromiter(map(len, part), np.int64, len(part)) + 1
        found = known.encode_batch([" ".join(part[k : k + TOGETHER]) for k in range(0, len(part), TOGETHER)], add_special_tokens=False)
        before = np.cumsum(size) - size  # places of the words in the texts, one after the other
        place = [np.array(x.offsets, np.int64).reshape(-1, 2)[:, 0] + before[k * TOGETHER] for k, x in enumerate(found)]
        of = np.searchsorted(before, np.concatenate(place), "right") - 1
        memory.learn(words[i : i + TOGETHER * 512], np.concatenate([np.array(x.ids, np.int32) for x in found]), np.bincount(of, minlength=len(part)))


def encode(texts: list[bytes], path: str) -> list[np.ndarray]:
    """Ids of each text. The vocabulary's splitter never crosses white space, so each distinct word (by its bytes) is encoded once and remembered."""
    cut = [t.split() for t in texts]  # white space of bytes: \x20 and \x09 to \x0D
    words = [w for c in cut for w in c]
    ids, at = tokenizer(path)[1].gather(words, lambda new: learn(new, path))
    return np.split(ids, at[np.cumsum([len(c) for c in cut], dtype=np.int64)][:-1]) if texts else []


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def cutter(path: str, size: int, end_id: int, with_ids: bool):
    def cut(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in chunks(at):
                rows, ids = [], []
                raw, ends = data[at[i] : at[j]].tobytes(), (at[i : j + 1] - at[i]).tolist()
                for k, x in enumerate(encode([raw[p:q] for p, q in zip(ends, ends[1:])], path), i):
                    x = np.append(x, np.int32(end_id)).astype("<u4")
                    for p in range(0, len(x), size):
                        y = x[p : p + size]
                        rows.append((k, p // size, p, len(y), zlib.crc32(y.tobytes()), task, seen[len(y)]))
                        seen[len(y)] += 1
                        if with_ids:
                            ids.append(y.astype(np.int32))
                col = list(zip(*rows))
                out = [batch.column(0).take(pa.array(col[0])), *(pa.array(c, t) for c, t in zip(col[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())))]
                yield pa.RecordBatch.from_arrays([*out, pa.array(ids, pa.list_(pa.int32()))] if with_ids else out, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", *["ids"] * with_ids])

    return cut


def patterns(counts: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """Bins of the best-two-fit rule over a histogram of lengths: (lengths in a bin, number of such bins)."""
    left = np.zeros(size + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    out = []
    while left.any():
        have, taken, gap = left.copy(), [], size
        while gap > 0 and (fits := np.flatnonzero(have[1 : gap + 1])).size:  # greedy: the longest that fits
            x = int(fits[-1]) + 1
            n = min(int(have[x]), gap // x)
            taken += [x] * n
            have[x] -= n
            gap -= x * n
        if gap and len(taken) > 1:
            small, room = taken[-1], gap + taken[-1]
            there = np.flatnonzero(have[1 : room + 1]) + 1
            best = (small, None)
            for b in there[there <= room // 2]:  # the shorter of the two
                a = there[there <= room - b]
                a = a[a >= b]
                if len(a) and (a[-1] > b or have[b] > 1) or len(a) > 1:
                    x = int(a[-1]) if a[-1] > b or have[b] > 1 else int(a[-2])
                    if x + b > best[0]:
                        best = (x + int(b), (x, int(b)))
            if best[1]:
                taken = [*taken[:-1], *best[1]]
        need = np.bincount(taken, minlength=size + 1)
        used = np.flatnonzero(need)
        times = int((left[used] // need[used]).min())
        left -= need * times
        out.append((taken, times))
    return out


def places(bins: list[tuple[list[int], int]]) -> dict[int, tuple[list, list]]:
    """For each length: first numbers of ranges, and for each range (first bin, places of it in a bin)."""
    used: dict[int, int] = {}
    out: dict[int, tuple[list, list]] = {}
    first = 0
    for taken, times in bins:
        spots: dict[int, list[int]] = {}
        offset = 0
        for x in taken:
            spots.setdefault(x, []).append(offset)
            offset += x
        for x, offsets in spots.items():
            out.setdefault(x, ([], []))
            out[x][0].append(used.get(x, 0))
            out[x][1].append((first, offsets))
            used[x] = used.get(x, 0) + times * len(offsets)
        first += times
    return out


def placer(ranges):
    def place(batches):
        for batch in batches:
            length, number = batch.column("length").to_pylist(), batch.column("number").to_pylist()
            bins, offsets = [], []
            for x, n in zip(length, number):
                starts, spots = ranges.value[x]
                k = bisect_right(starts, n) - 1
                first, at = spots[k]
                turn, slot = divmod(n - starts[k], len(at))
                bins.append(first + turn)
                offsets.append(at[slot])
            keep = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())], [*keep, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` and their places: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    ``vocabulary``: path of a tokenizer file whose splitter drops white space. A document's ids end in
    ``end_id``; only documents longer than ``size`` are cut. ``with_ids`` adds the ids themselves.
    """
    spark = docs.sparkSession
    schema = PIECES + ", ids array<int>" * with_ids
    pieces = settle(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(cutter(vocabulary, size, end_id, with_ids), remembers=True), schema))
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = per_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).select("length", "task", F.coalesce("before", F.lit(0)).alias("before"))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    ranges = spark.sparkContext.broadcast(places(patterns(counts, size)))
    numbered = pieces.join(before, ["length", "task"]).withColumn("number", F.col("before") + F.col("nth"))
    columns = [c.split()[0] for c in schema.split(", ") if c.split()[0] not in ("task", "nth")]
    kinds = ", ".join(c for c in schema.split(", ") if c.split()[0] not in ("task", "nth"))
    return numbered.select(*columns, "number").mapInArrow(placer(ranges), f"{kinds}, sequence_id long, offset long")
