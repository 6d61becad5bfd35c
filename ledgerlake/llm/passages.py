"""Substring dedup by compact windows.

Words become hashes of five-word shingles. For each of several hash functions the Cartesian tree over a
document's values is cut at windows of at least ``least`` words: a node's window is the longest stretch in
which its value is the smallest, so all stretches inside it that hold the node share that min-hash, and the
windows of a document are about 2n/least rows. Documents with windows of one (function, value) form a group.

1. All of a group meet its earliest document. The windows of a pair of documents are joined where they overlap, over
   all functions, and each such stretch is verified on its shingles; one agreeing function is enough.
2. A window that no verified passage covers goes on with the shingles round its node (2 * least of them, 16 bits each):
   the group is dealt again by the smallest value, in each stretch of ``least`` words that holds the node, among the shingles that the earliest
   document lacks. The earliest of each new group is compared with all of it, what agrees is verified, the rest is dealt again. All of a group
   share one more shingle each time, so this ends; groups split at once where a frequent line, but no passage, made them.

Two stretches at the threshold num/den share a value with that chance under each function; ``miss`` bounds the
chance that they share none, and sets the number of functions. An exact copy always shares a value, there and in all groups of 2.
Missed beside that: a passage of which the group's earliest document holds as many shingles, but in another order; and in 2 a near copy
whose smallest value among the rest is in an edit, in every stretch.
No group is in one task: its earliest member's text serves ``SALT`` others at a time.

Defined cases: null texts and texts under ``least`` words repeat nothing; null doc_ids take no part and pass
``drop_passages`` as they are; rows with equal doc_id are one document and never repeat each other; extra
columns pass through; a document with nothing left after removal goes; an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._spark import discard, scratch, settle
from ._words import U, Words, chunks, mix, packed, released, shingles, streamed, unpacked, utf8

SHINGLE, SEGMENT, SALT, NEAR, NEARBY = 5, 1 << 15, 256, 1024, 128


def functions_for(num: int, den: int, miss: float) -> int:
    """Hash functions so that two stretches at the threshold share no min-hash with probability ``miss`` at most."""
    return ceil(log(miss) / log(1 - num / den)) if num < den else 1


def reaches(values: np.ndarray, at: np.ndarray, own: np.ndarray, first: np.ndarray, last: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How far left all values are above ``own`` and right not below, from places ``at`` within first to last and less than ``most`` away; and where that is not the end."""
    tables = [values]
    while 2 << (len(tables) - 1) < most and len(tables[-1]) > 1 << (len(tables) - 1):
        step = 1 << (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-step], tables[-1][step:]))
    left, right = at.copy(), at.copy()
    for k in reversed(range(len(tables))):
        step, t = 1 << k, tables[k]
        to = left - step
        ok = to >= first
        ok[ok] = t[to[ok]] > own[ok]
        left[ok] -= step
        to = right + 1
        ok = right + step <= last
        ok[ok] = t[to[ok]] >= own[ok]
        right[ok] += step
    full = (1 << len(tables)) - 1
    return left, right, at - left == full, right - at == full


def compact_windows(values: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions c and inclusive ends l, r of all Cartesian-tree nodes of at least ``least`` (below ``NEARBY``) values.

    ``bounds``: where each document's values begin. The leftmost of equal smallest values is the node.
    """
    n = len(values)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    first, last = (np.repeat(x, np.diff(bounds)) for x in (bounds[:-1], bounds[1:] - 1))
    # A node's window holds a stretch of ``least`` values of which it is the smallest.
    low, width = values, 1
    while 2 * width <= least:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
        if not len(low):
            return (np.zeros(0, np.int64),) * 3
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    low = np.minimum(low[: n - least + 1], low[least - width : least - width + n - least + 1])
    inside = last[: len(low)] >= np.arange(len(low)) + least - 1
    low = np.where(inside, low, U(0))
    top = np.concatenate([np.zeros(least - 1, U), low, np.zeros(least - 1, U)])
    width = 1
    while 2 * width <= least:
        top, width = np.maximum(top[:-width], top[width:]), 2 * width
    top = np.maximum(top[:n], top[least - width : least - width + n])
    c = np.flatnonzero(top == values)
    own = values[c]
    left, right, open_left, open_right = reaches(values, c, own, first[c], last[c], NEARBY)
    # What bounds a window further than NEARBY >= least away is itself the smallest of a stretch, so it is among the nodes.
    begin, end = np.searchsorted(c, first[c]), np.searchsorted(c, last[c], "right") - 1
    far = np.arange(len(c))
    before, after, _, _ = reaches(own, far, own, begin, end, 1 << max(1, int((end - begin).max(initial=0)).bit_length()))
    left = np.where(open_left, np.where(before > begin, c[np.maximum(before - 1, 0)] + 1, first[c]), left)
    right = np.where(open_right, np.where(after < end, c[np.minimum(after + 1, len(c) - 1)] - 1, last[c]), right)
    wide = right - left + 1 >= least
    return c[wide], left[wide], right[wide]


def segments(bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values of long documents cut into overlapping parts, and the parts' bounds: every stretch of ``least`` values is whole in one."""
    if len(bounds) < 2 or np.diff(bounds).max() <= SEGMENT:
        return np.arange(bounds[-1]), bounds
    step = max(1, SEGMENT - least + 1)
    parts = [np.arange(i, min(i + SEGMENT, e)) for s, e in zip(bounds[:-1], bounds[1:]) for i in range(s, max(s + 1, e - least + 1), step) if e > s]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def windower(least: int, functions: int):
    """Arrow batches (d, text) to (key, d, c, s, e): the node's first byte, and first byte and end of its window."""
    n = least - SHINGLE + 1

    def work(batches):
        for b in batches:
            data, at = utf8(b.column(1))
            ids = b.column(0).to_numpy()
            for i, j in chunks(at):
                w = Words(data[at[i] : at[j]], at[i : j + 1] - at[i])
                h, pos, bounds = shingles(w, SHINGLE)
                if not len(h):
                    continue
                owner = np.repeat(np.arange(j - i), np.diff(bounds))
                place, cuts = segments(bounds, n)
                for k in range(functions):
                    v = mix(h * U(0x9E3779B97F4A7C15) + U(k)) | U(1)
                    v = v[place]
                    c, left, right = compact_windows(v, cuts, n)
                    # The same shingle again within ``least`` words lies in the window of the place before.
                    again = np.zeros(len(c), bool)
                    inner = np.flatnonzero(left > np.repeat(cuts[:-1], np.diff(cuts))[c])
                    again[inner] = (v[left[inner] - 1] == v[c[inner]]) & (c[inner] - left[inner] + 1 < n)
                    c, left, right = (place[x[~again]] for x in (c, left, right))
                    base = w.at[owner[c]]
                    out = (w.start[pos[c]] - base, w.start[pos[left]] - base, w.end[pos[right] + SHINGLE - 1] - base)
                    yield pa.RecordBatch.from_arrays([pa.array(mix(mix(h[c] * U(0x9E3779B97F4A7C15) + U(k)) + U(k)).view(np.int64)), pa.array(ids[i:j][owner[c]]), *(pa.array(x.astype(np.int32)) for x in out)], ["key", "d", "c", "s", "e"])

    return work


def same(p: np.ndarray, q: np.ndarray, least: int, num: int, den: int) -> list[tuple[int, int]]:
    """Stretches of the shingles ``p``, of ``least`` words or more, that near-duplicate one of ``q``: first and last shingle."""
    if min(len(p), len(q)) + SHINGLE - 1 < least:
        return []
    known, code, times = np.unique(q, return_inverse=True, return_counts=True)
    of = np.minimum(np.searchsorted(known, p), len(known) - 1)
    hit = known[of] == p
    if not hit.any():
        return []
    size = len(q) + 1
    spots = np.sort(code * size + np.arange(len(q)))  # by shingle, then place
    place = lambda want: spots[np.minimum(np.searchsorted(spots, of * size + want), len(spots) - 1)]
    at = place(0) - of * size
    # A shingle of several places goes to the one nearest to where the last certain one points.
    sure = np.flatnonzero(hit & (times[of] == 1))
    if len(sure) and (times[of[hit]] > 1).any():
        guide = sure[np.maximum(np.searchsorted(sure, np.arange(len(p)), "right") - 1, 0)]
        want = np.clip(np.arange(len(p)) + (at - np.arange(len(p)))[guide], 0, len(q) - 1)
        after = np.searchsorted(spots, of * size + want)
        options = np.stack([spots[np.clip(after + k, 0, len(spots) - 1)] - of * size for k in (-1, 0)])
        options = np.where((options >= 0) & (options < len(q)), options, 4 * size)
        at = np.where(hit, np.take_along_axis(options, np.abs(options - want).argmin(0)[None], 0)[0], at)
    # Without repeats a stretch at the threshold has at least num/den of its shingles in common.
    need = -(-num * (least - SHINGLE + 1) // den) if len(np.unique(p)) == len(p) else 1
    out, todo = [], [np.flatnonzero(hit)]
    while todo:
        run = todo.pop()
        if len(run) < need or run[-1] - run[0] + SHINGLE < least:
            continue
        gaps, back = np.diff(run), np.diff(at[run])
        wide = (gaps > 2 * SHINGLE + 1) | (back < -2 * SHINGLE) | (back > gaps + 4 * SHINGLE)
        if wide.any():
            todo += np.split(run, np.flatnonzero(wide) + 1)
            continue
        if (gaps == 1).all() and (back == 1).all():  # the same words in the same order
            out.append((int(run[0]), int(run[-1])))
            continue
        there = at[run]
        left, right = np.unique(p[run[0] : run[-1] + 1]), np.unique(q[there.min() : there.max() + 1])
        both = len(np.intersect1d(left, right, True))
        if den * both >= num * (len(left) + len(right) - both):
            out.append((int(run[0]), int(run[-1])))
        elif (gaps > 1).any():
            todo += np.split(run, [int(gaps.argmax()) + 1])
        elif len(run) > 1 and ((back != 1).any()):
            todo += np.split(run, [int((np.abs(back - 1)).argmax()) + 1])
    return out


def stretches(spans) -> list[tuple[int, int, int, int]]:
    """Windows (s, e) of one document with their windows (rs, re) of the other, joined where they overlap in both."""
    out: list[list[int]] = []
    for s, e, rs, re in sorted(spans):
        for o in reversed(out):
            if s < o[1] and rs < o[3] and o[2] < re:
                o[1], o[2], o[3] = max(o[1], e), min(o[2], rs), max(o[3], re)
                break
        else:
            out.append([s, e, rs, re])
    return [tuple(o) for o in out]


def part_of(text: tuple, s: int, e: int) -> tuple[np.ndarray, int]:
    """Shingles of ``text`` (shingles, first bytes, ends) between bytes s and e, and the number of the first word."""
    p, start, end = text
    i, j = np.searchsorted(start, s), np.searchsorted(end, e, "right")
    return p[i : max(i, j - SHINGLE + 1)], int(i)


def candidates(h: np.ndarray, bounds: np.ndarray, group: np.ndarray, heads: np.ndarray, carried: list, least: int, num: int, den: int) -> np.ndarray:
    """Which texts (shingles ``h`` between ``bounds``) may hold a passage of a head of their group: enough shingles in common, or repeated ones.

    A stretch of ``least`` words without repeats has ``least`` - 4 shingles, of which num/den are in the other. ``carried``: shingles of heads of group 0.
    """
    n = least - SHINGLE + 1
    row = np.repeat(np.arange(len(group)), np.diff(bounds))
    key = mix(h + (group[row].astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
    known = np.unique(np.concatenate([key[heads[row]], *(mix(x + U(0x9E3779B97F4A7C15)) for x in carried)]))
    if not len(known):
        return np.zeros(len(group), bool)
    mine = np.flatnonzero(~heads[row])
    seen = np.zeros(1 << 20, bool)  # most shingles are in no head: a bit for the top of each key says so before the search
    seen[known >> U(44)] = True
    mine = mine[seen[key[mine] >> U(44)]]
    at = np.minimum(np.searchsorted(known, key[mine]), len(known) - 1)
    hit = np.bincount(row[mine][known[at] == key[mine]], minlength=len(group))
    few = (hit > 0) & (den * hit < num * n) & (np.diff(bounds) >= n)
    live = (den * hit >= num * n) & (np.diff(bounds) >= n)
    some = np.flatnonzero(few[row] & ~heads[row])
    if len(some):
        order = np.lexsort((h[some], row[some]))
        x, y = h[some][order], row[some][order]
        live[y[1:][(x[1:] == x[:-1]) & (y[1:] == y[:-1])]] = True
    return live


def verifier(least: int, num: int, den: int):
    """Sorted Arrow batches (r, salt, d, spans, first, bytes; d null: of r itself) to passages of d that repeat one of r."""

    def work(batches):
        head, sources = None, []
        for b in batches:
            r, salt, d, first = (b.column(k).to_pylist() for k in (0, 1, 2, 4))
            lists = b.column(3)
            at = np.asarray(lists.offsets)
            spans = list(zip(*(lists.values.field(k).to_pylist() for k in range(4)))) if len(lists.values) else []
            data, ends = utf8(b.column(5))
            rows = []
            for i, j in chunks(ends):
                raw = data[ends[i] : ends[j]]
                w = Words(raw, ends[i : j + 1] - ends[i])
                h, _, bounds = shingles(w, SHINGLE)
                group = np.cumsum([head != (r[i], salt[i]), *((r[k], salt[k]) != (r[k - 1], salt[k - 1]) for k in range(i + 1, j))])
                theirs = np.array([d[k] is None for k in range(i, j)])
                live = candidates(h, bounds, group, theirs, [x[0] for x in sources] if head == (r[i], salt[i]) else [], least, num, den)
                for k in (i + np.flatnonzero(live | theirs)).tolist():
                    if head != (r[k], salt[k]):
                        head, sources = (r[k], salt[k]), []
                    base, own = int(w.at[k - i]), slice(w.first[k - i], w.first[k - i + 1])
                    text = h[bounds[k - i] : bounds[k - i + 1]], w.start[own] - base + first[k], w.end[own] - base + first[k]
                    if d[k] is None:
                        sources.append(tuple(x.copy() for x in text))
                        continue
                    for s, e, rs, re in stretches(spans[at[k] : at[k + 1]]):
                        p, word = part_of(text, s, e)
                        for source in sources:
                            for x, y in same(p, part_of(source, rs, re)[0], least, num, den):
                                s, e = int(text[1][word + x]), int(text[2][word + y + SHINGLE - 1])
                                rows.append((d[k], r[k], s, e, y - x + SHINGLE, raw[base + s - first[k] : base + e - first[k]].tobytes()))
            col = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in col[:5]), pa.array(col[5], pa.binary())], ["doc_id", "source_id", "start", "stop", "n_words", "passage"])

    return work


def verified(meet: DataFrame, raw: DataFrame, least: int, num: int, den: int) -> DataFrame:
    """Passages of ``meet(d, r, s, e, rs, re)``: windows of d and of r that share a value; ``raw(d, t)``: texts as bytes."""
    pairs = settle(meet.groupBy("d", "r").agg(F.collect_set(F.struct("s", "e", "rs", "re")).alias("spans")))
    low = lambda k: F.array_min(F.transform("spans", lambda x: x[k]))
    high = lambda k: F.array_max(F.transform("spans", lambda x: x[k]))
    salts = pairs.groupBy("r").agg(F.ceil(F.count("*") / SALT).alias("salts"))
    dealt = pairs.join(salts.hint("merge"), "r").withColumn("salt", F.pmod(F.xxhash64("d"), F.col("salts")))
    part = lambda first, end: F.substring("t", F.col(first) + 1, F.col(end) - F.col(first))
    heads = dealt.groupBy("r", "salt").agg(F.min(low("rs")).alias("first"), F.max(high("re")).alias("end")).join(raw.withColumnRenamed("d", "r"), "r")
    heads = heads.select("r", "salt", F.lit(None).cast("long").alias("d"), F.lit(None).cast(pairs.schema["spans"].dataType).alias("spans"), "first", part("first", "end").alias("t"))
    rest = dealt.withColumn("first", low("s")).withColumn("end", high("e")).join(raw, "d").select("r", "salt", "d", "spans", "first", part("first", "end").alias("t"))
    rows = heads.union(rest).repartition("r", "salt").sortWithinPartitions("r", "salt", F.asc_nulls_first("d"))
    found = rows.mapInArrow(released(verifier(least, num, den)), "doc_id long, source_id long, start long, stop long, n_words long, passage binary")
    out = settle(found.select("doc_id", "source_id", "start", "stop", "n_words", F.xxhash64("passage").alias("check")))
    discard(pairs)
    return out


AROUND = "k long, d long, c int, asks boolean, a int, b int, codes binary"


def surroundings(least: int):
    """Arrow batches (d, text, nodes(key, c, asks)) to ``AROUND``: 16-bit codes of the shingles round each node, a of them before and b after it."""
    n = least - SHINGLE + 1

    def work(batches):
        for batch in batches:
            data, ends = utf8(batch.column(1))
            lists = batch.column(2)
            many, first = np.diff(np.asarray(lists.offsets)), int(lists.offsets[0].as_py()) if len(lists) else 0
            nodes = [lists.values.field(k).slice(first, int(many.sum())) for k in range(3)]
            begin = np.concatenate([[0], np.cumsum(many)])
            for i, j in chunks(ends):
                w = Words(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                h, _, bounds = shingles(w, SHINGLE)
                key, c, asks = (x.slice(int(begin[i]), int(begin[j] - begin[i])) for x in nodes)
                text = np.repeat(np.arange(j - i), many[i:j])
                # Words and shingles of a text have the same numbers, but for its last words.
                at = bounds[text] + np.searchsorted(w.start, c.to_numpy() + w.at[text]) - w.first[text]
                real = at < bounds[text + 1]
                at, text = at[real], text[real]
                a, b = np.minimum(at - bounds[text], n - 1), np.minimum(bounds[text + 1] - 1 - at, n - 1)
                wide = np.concatenate([np.zeros(n - 1, np.uint16), (h >> U(48)).astype(np.uint16), np.zeros(n - 1, np.uint16)])
                codes = wide[at[:, None] + np.arange(2 * n - 1)]
                keep = pa.array(real)
                out = [key.filter(keep), batch.column(0).slice(i, j - i).take(pa.array(text)), c.filter(keep), asks.filter(keep), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*out, packed(codes)], [x.split()[0] for x in AROUND.split(", ")])

    return work


def regroup(least: int, num: int, den: int, turn: int):
    """Groups (k, salt) of ``AROUND`` with ``head``, the earliest document's rows first: pairs to verify (d, r), and the rest with new k."""
    n = least - SHINGLE + 1
    need = ceil(2 * n * num / (num + den))

    def work(t: pa.Table, bounds: np.ndarray):
        col = {x: t[x].to_numpy() for x in ("k", "salts", "head", "d", "c", "asks", "a", "b")}
        codes = unpacked(t["codes"], np.uint16)
        there = np.arange(2 * n - 1)
        real = (there >= n - 1 - col["a"][:, None]) & (there <= n - 1 + col["b"][:, None])
        flag = np.zeros(1 << 16, bool)
        for s, e in zip(bounds[:-1], bounds[1:]):
            heads = s + np.flatnonzero(col["head"][s:e])
            rows = s + np.flatnonzero(~col["head"][s:e])
            if not len(heads) or not len(rows):
                continue
            mine = codes[heads][real[heads]]
            flag[mine] = True
            theirs = flag[codes[rows]] & real[rows]
            flag[mine] = False
            near = col["asks"][rows] & (theirs.sum(1) >= need)
            if near.any():
                of = col["d"][rows[near]]
                yield batch(pa.array(of), pa.array(np.full(len(of), col["d"][heads[0]])))
            rows, theirs = rows[~near], theirs[~near]
            left = col["d"][rows]
            if col["salts"][s] == 1 and not (col["asks"][rows] & (left > left.min(initial=left[0] if len(left) else 0))).any():
                continue  # the whole group is here, and no two are left to meet
            value = mix(codes[rows].astype(U) + U(turn << 16)) >> U(17) << U(16) | codes[rows]
            value[theirs | ~real[rows]] = ~U(0)
            low, width = value, 1  # smallest of each stretch of n that holds the node
            while 2 * width <= n:
                low, width = np.minimum(low[:, :-width], low[:, width:]), 2 * width
            low = np.minimum(low[:, :n], low[:, n - width : 2 * n - width])
            start = np.arange(n)
            low[(start < n - 1 - col["a"][rows][:, None]) | (start > col["b"][rows][:, None])] = ~U(0)
            low.sort(1)
            fresh = low != ~U(0)
            fresh[:, 1:] &= low[:, 1:] != low[:, :-1]
            row, _ = np.nonzero(fresh)
            if len(row):
                k = col["k"][rows[row]] ^ mix((low[fresh] & U(0xFFFF)) * U(0x9E3779B97F4A7C15) + U(1)).view(np.int64)
                part = t.take(pa.array(rows[row]))
                yield batch(part["d"], None, pa.array(k), *(part[x] for x in ("c", "asks", "a", "b", "codes")))

    def batch(*columns):
        many = len(columns[0])
        columns = [pa.nulls(many, f.type) if x is None else x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for f, x in zip(FIELDS, (*columns, *[None] * (len(FIELDS) - len(columns))))]
        return pa.RecordBatch.from_arrays(columns, schema=FIELDS)

    return work


FOUND = "d long, r long, k long, c int, asks boolean, a int, b int, codes binary"
FIELDS = pa.schema([("d", pa.int64()), ("r", pa.int64()), ("k", pa.int64()), ("c", pa.int32()), ("asks", pa.bool_()), ("a", pa.int32()), ("b", pa.int32()), ("codes", pa.binary())])


def further(shared: DataFrame, found: DataFrame, raw: DataFrame, least: int, num: int, den: int) -> DataFrame | None:
    """Pairs (d, r, s, e, rs, re), whole texts, of the windows ``shared(key, d, c, r, n)`` that no passage in ``found`` covers with others than their group's earliest."""
    covered = found.groupBy(F.col("doc_id").alias("d")).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    inside = F.exists("spans", lambda x: (F.col("c") >= x["start"]) & (F.col("c") < x["stop"]))
    nodes = open_nodes = settle(shared.filter("n > 2 and d > r").join(covered.hint("merge"), "d", "left").select("key", "d", "c", (~F.coalesce(inside, F.lit(False))).alias("asks")))
    live = settle(nodes.groupBy("key").agg(F.min("d").alias("p"), F.max(F.when(F.col("asks"), F.col("d"))).alias("q")).filter("p < q").select("key"))
    nodes = nodes.join(live.hint("merge"), "key").groupBy("d").agg(F.collect_list(F.struct("key", "c", "asks")).alias("nodes"))
    state = settle(nodes.join(raw, "d").select("d", "t", "nodes").mapInArrow(released(surroundings(least)), AROUND))
    discard(open_nodes)
    out, turn = None, 0
    while True:
        # Groups in which a row that asks comes after another document's.
        groups = state.groupBy("k").agg(F.min("d").alias("r"), F.max(F.when(F.col("asks"), F.col("d"))).alias("last"), F.ceil(F.count("*") / NEAR).alias("salts")).filter("r < last").drop("last")
        groups = settle(groups)
        now = state.join(groups.hint("merge"), "k")
        each = now.filter("d = r").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        rest = now.filter("d > r").withColumn("salt", F.pmod(F.xxhash64("d", "c"), F.col("salts")))
        names = [x.split()[0] for x in AROUND.split(", ")]
        rows = each.union(rest).select("k", "salt", "salts", (F.col("d") == F.col("r")).alias("head"), *names[1:])
        rows = rows.repartition("k", "salt").sortWithinPartitions("k", "salt", F.desc("head"))
        done = settle(rows.mapInArrow(released(streamed(2, regroup(least, num, den, turn))), FOUND))
        pairs = done.filter("r is not null").select("d", "r").distinct()
        out = pairs if out is None else out.union(pairs)
        before, turn = state, turn + 1
        state = settle(done.filter("k is not null").select(*names).dropDuplicates(["k", "d", "c"]))
        discard(before)
        if state.isEmpty():
            break
    # The passage may reach beyond the shingles compared: whole texts are verified.
    zero, end = F.lit(0), F.lit(1 << 30)
    return out.distinct().select("d", "r", zero.alias("s"), end.alias("e"), zero.alias("rs"), end.alias("re"))


@scratch
def repeats(docs: DataFrame, least: int = 50, num: int = 80, den: int = 100, miss: float = 2e-3) -> DataFrame:
    """Passages of ``docs(doc_id, text)`` that repeat one of an earlier document (smaller doc_id).

    doc_id, source_id, start, stop (bytes of the UTF-8 text), n_words, check (xxhash64 of those bytes).
    """
    raw = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("binary").alias("t")).filter("d is not null and t is not null")
    windows = settle(raw.mapInArrow(released(windower(least, functions_for(num, den, miss))), "key long, d long, c int, s int, e int"))
    groups = windows.groupBy("key").agg(F.min("d").alias("r"), F.max("d").alias("x"), F.count("*").alias("n")).filter("r < x").select("key", "r", "n")
    shared = settle(windows.join(groups.hint("shuffle_hash"), "key"))  # the larger side need not be sorted
    discard(windows)
    heads = settle(shared.filter("d = r").groupBy("key").agg(F.min("s").alias("rs"), F.max("e").alias("re")))  # settled, so that a large group can be split in the join
    meet = shared.filter("d > r").join(heads.hint("merge"), "key").select("d", "r", "s", "e", "rs", "re")
    large = raw.hint("merge")  # the same plan at every size: nothing that grows with the documents is broadcast
    found = verified(meet, large, least, num, den)
    others = settle(further(shared, found, large, least, num, den))
    asked = others.select("d").union(others.select("r")).distinct()
    some = settle(large.join(asked, "d", "left_semi"))  # the texts of these pairs only
    more = verified(others, some.hint("merge"), least, num, den)
    return found.union(more).distinct()


def drop_passages(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the passages that repeat an earlier document; columns as they were."""
    spans = repeats(docs, **options).groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop", "check")).alias("spans"))
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(x) for c, x in names.items()])
    spans = spans.withColumnRenamed("doc_id", "_d")
    raw = F.col(names["text"]).cast("binary")
    real = F.filter("spans", lambda x: F.xxhash64(F.substring(raw, (x["start"] + 1).cast("int"), (x["stop"] - x["start"]).cast("int"))) == x["check"])
    rows = rows.join(spans, F.col(names["doc_id"]) == F.col("_d"), "left").drop("_d").withColumn("spans", F.array_sort(F.coalesce(real, F.array())))
    kept = lambda at, end: F.substring(raw, (at + 1).cast("int"), (end - at).cast("int"))
    some = F.size("spans") > 0
    step = lambda done, x: F.struct(F.when(x["start"] > done["at"], F.concat(done["out"], kept(done["at"], x["start"]))).otherwise(done["out"]).alias("out"), F.greatest(done["at"], x["stop"]).alias("at"))
    whole = F.aggregate("spans", F.struct(F.lit("").cast("binary").alias("out"), F.lit(0).cast("long").alias("at")), step, lambda done: F.concat(done["out"], kept(done["at"], F.octet_length(raw))).cast("string"))
    # The generator holds the new text, so the filter on it can't go below and cut the texts twice.
    rows = rows.select(*names.values(), F.explode(F.array(F.struct(F.when(some, whole).otherwise(F.col(names["text"])).alias("text"), some.alias("cut")))).alias("new"))
    rows = rows.filter(~F.col("new.cut") | F.col("new.text").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(*[F.col("new.text").alias(c) if c == "text" else F.col(x).alias(c) for c, x in names.items()])
