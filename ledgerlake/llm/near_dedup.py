"""MinHash near-duplicates with sequential Bayesian verification.

Banded MinHash gives candidate pairs; the signatures of a pair are compared batch by batch, and the
pair is dropped as soon as the posterior probability that its similarity reaches the threshold falls
under ``miss``. What survives is confirmed on the full sets of shingles (their words, not hashes).

Shape of the work. Texts with equal sets form a class, and one row of a class goes on, so copies never meet.

1. Each row meets the smallest member of the bucket that it shares with it most often (pairs: at most the rows).
2. A bucket that still mixes components is streamed to a task: its members outside the largest component (askers)
   against all members of other components, each pair in the first bucket it shares only. Each asker's ``BEST``
   best agreeing survivors are confirmed; a bucket with an asker that has more is held back.
3. Buckets held back come again with the rows' sets: survivors are confirmed inside the task, and rows that
   a link found there has joined need not meet, so a bucket gives fewer links than it has rows. Nothing is held back.

So every pair of a bucket that lies across components and survives its signatures is confirmed. A bucket of N
rows with A askers is dealt into blocks of ``BLOCK`` rows (and ``ROOM`` shingles): rows are copied A / BLOCK times, askers N / BLOCK times.
Comparisons are N times A; they are the price of rows that share a bucket and are not linked.

Defined cases: a null text or one without words has an empty set (``n_shingles`` 0) and is linked with
nothing; rows with equal ``doc_id`` count as one document with several texts; a row with null
``doc_id`` takes no part, its ``component_id`` is null and it is kept; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._spark import connected, joined, scratch, settle
from ._words import U, Words, chunks, mix, packed, released, shingles, streamed, unpacked, utf8

ROWS, STEP, SEED, BLOCK, ROOM, BEST, SALT = 5, 20, 0x51ED270B, 1024, 4_000_000, 4, 256


def bands_for(similarity: float, rows: int = ROWS, miss: float = 1e-5) -> int:
    """Bands so that a pair at the threshold shares no band with probability ``miss`` at most."""
    return ceil(log(miss) / log(1 - similarity**rows))


def least_matches(similarity: float, miss: float, length: int, step: int = STEP) -> dict[int, int]:
    """After n compared values, the fewest matches with P(similarity >= threshold) >= ``miss`` (uniform prior)."""

    def posterior(m: int, n: int) -> float:
        return sum(comb(n + 1, i) * similarity**i * (1 - similarity) ** (n + 1 - i) for i in range(m + 1))

    return {n: next(m for m in range(n + 1) if posterior(m, n) >= miss) for n in [*range(step, length, step), length]}


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(SEED))
    return x[:n] | U(1), x[n:]


SIGNED = "n_shingles long, s1 long, s2 long, sig binary, bands array<long>"


def signer(size: int, bands: int, rows: int = ROWS):
    """Arrow batches (doc_id, text) to (doc_id, n_shingles, s1, s2, sig, bands); s1, s2: hashes of the set."""
    a, b = multipliers(bands * rows)

    def sign(batches):
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in chunks(at):
                h, _, bounds = shingles(Words(data[at[i] : at[j]], at[i : j + 1] - at[i]), size)
                parts = [np.unique(h[s:e]) for s, e in zip(bounds[:-1], bounds[1:])]
                n = np.array([len(p) for p in parts])
                full = np.flatnonzero(n)
                sig = np.zeros((j - i, len(a)), np.uint32)
                s1 = s2 = np.zeros(j - i, U)
                if len(full):
                    h = np.concatenate(parts)
                    begin = np.concatenate([[0], np.cumsum(n)])[:-1][full]
                    for k in range(len(a)):
                        sig[full, k] = np.minimum.reduceat(h * a[k] + b[k], begin) >> U(32)
                    s1, s2 = np.zeros(j - i, U), np.zeros(j - i, U)
                    s1[full] = np.add.reduceat(h * (h >> U(7) | U(1)), begin)
                    s2[full] = np.bitwise_xor.reduceat(mix(h), begin)
                keys = np.zeros((j - i, bands), U)
                for r in range(rows):
                    keys = mix(keys * U(0xE7037ED1A0B428DB) + sig[:, r::rows] + np.arange(1, bands + 1, dtype=U))
                keys = keys.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), packed(sig), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel()))],
                    ["doc_id", "n_shingles", "s1", "s2", "sig", "bands"],
                )

    return sign


def pruner(least: dict[int, int]):
    """Arrow batches (u, v, a, b) to the (u, v) whose signatures survive every batch of comparisons."""

    def prune(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (unpacked(batch.column(k), np.uint32) for k in (2, 3))
            live, found, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, int), 0
            for n, m in least.items():
                found = found + (x[live, done:n] == y[live, done:n]).sum(1)
                keep = found >= m
                live, found, done = live[keep], found[keep], n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(live)), batch.column(1).take(pa.array(live))], ["u", "v"])

    return prune


def pairs_in(bounds: np.ndarray, asks: np.ndarray, limit: int = 1 << 20):
    """(asker, other row) of every group, about ``limit`` pairs at a time."""
    first, size = (np.repeat(x, np.diff(bounds)) for x in (bounds[:-1], np.diff(bounds)))
    askers = np.flatnonzero(asks)
    ends = np.cumsum(size[askers])
    i = 0
    while i < len(askers):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        part = askers[i:j]
        n = size[part]
        at = np.cumsum(n) - n
        yield np.repeat(part, n), np.arange(n.sum()) - np.repeat(at - first[part], n)
        i = j


def signatures(column: pa.ChunkedArray) -> np.ndarray:
    return unpacked(column, np.uint32)


#: asker: outside the bucket's largest component; asks, member: the parts that this copy of the row takes.
ROW = ("key", "i", "j", "u", "c", "n", "band", "asker", "asks", "member", "sig")


def alive(p: np.ndarray, q: np.ndarray, row: dict, sig: np.ndarray, least: dict[int, int], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of rows of a bucket those across components that no earlier band holds and that survive every batch: p, q, values in common.

    ``sig``: signatures turned round, a row for each place. Of two askers the one with the larger id asks.
    """
    u, c, n, band = (row[k] for k in ("u", "c", "n", "band"))
    ok = row["member"][q] & (c[p] != c[q]) & (den * np.minimum(n[p], n[q]) >= num * np.maximum(n[p], n[q])) & (~row["asker"][q] | (u[p] > u[q]))
    p, q = p[ok], q[ok]
    found, done, same = np.zeros(len(p), np.int32), 0, None
    for stop, fewest in least.items():
        before = np.zeros(len(p), bool)
        for k in range(done, stop):
            hit = sig[k][p] == sig[k][q]
            found += hit
            same = hit if k % ROWS == 0 else same & hit
            if k % ROWS == ROWS - 1:
                before |= same & (k // ROWS < band[p])
        ok = (found >= fewest) & ~before
        p, q, found, done = p[ok], q[ok], found[ok], stop
    return p, q, found


def columns_of(t: pa.Table) -> dict:
    return {k: t[k].to_numpy() for k in ROW[:-1]}


def closest(least: dict[int, int], num: int, den: int, best: int):
    """Groups of ``ROW`` to (u, v, held): each asker's ``best`` best agreeing survivors; held: key of a bucket that has more."""

    def work(t: pa.Table, bounds: np.ndarray):
        row, sig = columns_of(t), np.ascontiguousarray(signatures(t["sig"]).T)
        for p, q in pairs_in(bounds, row["asks"]):
            p, q, found = alive(p, q, row, sig, least, num, den)
            if not len(p):
                continue
            order = np.lexsort((row["u"][q], -found, p))
            p, q = p[order], q[order]
            turn = np.arange(len(p)) - np.searchsorted(p, p)
            held = np.unique(row["key"][p[turn >= best]])
            p, q = p[turn < best], q[turn < best]
            x, y = row["u"][p], row["u"][q]
            none = pa.nulls(len(held), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(np.maximum(x, y)), none]), pa.concat_arrays([pa.array(np.minimum(x, y)), none]), pa.concat_arrays([pa.nulls(len(p), pa.int64()), pa.array(held)])], ["u", "v", "held"])

    return work


def spanning(least: dict[int, int], num: int, den: int):
    """Groups of ``ROW`` with ``grams`` (sorted hashes) to (u, v): survivors at the threshold that join what is not joined yet."""

    def work(t: pa.Table, bounds: np.ndarray):
        for s, e in zip(bounds[:-1], bounds[1:]):
            part = t.slice(s, e - s).combine_chunks()
            row, sig = columns_of(part), np.ascontiguousarray(signatures(part["sig"]).T)
            sets = [np.frombuffer(x, np.int64) for x in part["grams"].to_pylist()]
            size = np.array([len(x) for x in sets])
            code = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, int)
            at = np.concatenate([[0], np.cumsum(size)])
            mark = np.zeros(int(code.max()) + 1 if len(code) else 1, bool)
            out, c = [], row["c"].copy()
            row["c"] = c  # components as joined so far
            for asker in np.flatnonzero(row["asks"]):
                q = np.arange(e - s)
                _, q, found = alive(np.full(len(q), asker), q, row, sig, least, num, den)
                if not len(q):
                    continue
                q = q[np.argsort(-found, kind="stable")]
                mark[code[at[asker] : at[asker + 1]]] = True
                width = size[q]
                begin = np.cumsum(width) - width
                both = np.add.reduceat(mark[code[np.arange(width.sum()) + np.repeat(at[q] - begin, width)]].astype(np.int64), begin)
                mark[code[at[asker] : at[asker + 1]]] = False
                for d in q[den * both >= num * (size[asker] + width - both)]:
                    if c[asker] != c[d]:
                        c[c == c[d]] = c[asker]
                        out.append((max(row["u"][asker], row["u"][d]), min(row["u"][asker], row["u"][d])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])

    return work


def word_sets(text: bytes | None, size: int) -> set:
    """Shingles of ``size`` words as words: of fewer words the whole sequence."""
    w = (text or b"").lower().split()
    return {tuple(w)} if 0 < len(w) < size else set(zip(*(w[k:] for k in range(size))))


def confirmer(size: int, num: int, den: int):
    """Sorted Arrow batches (v, salt, u, text; u null: a text of v) to the (u, v) with a pair of sets at the threshold."""

    def confirm(batches):
        head, sets = None, []
        for batch in batches:
            out = []
            for v, salt, u, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if head != (v, salt):
                    head, sets = (v, salt), []
                own = word_sets(text, size)
                if u is None:
                    sets.append(own)
                else:
                    fits = (x for x in sets if x and den * min(len(x), len(own)) >= num * max(len(x), len(own)))
                    if any(den * (both := len(own & x)) >= num * (len(own) + len(x) - both) for x in fits):
                        out.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])

    return confirm


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The ``pairs(u, v)`` with texts at the threshold. A text of v serves ``SALT`` pairs, so no document, however many its pairs, is in one task."""
    salts = pairs.groupBy("v").agg(F.ceil(F.count("*") / SALT).alias("salts"))
    heads = salts.select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    heads = heads.join(texts.select(F.col("doc_id").alias("v"), "text"), "v").select("v", "salt", F.lit(None).cast("long").alias("u"), "text")
    rest = pairs.join(salts, "v").select("v", F.pmod(F.xxhash64("u"), F.col("salts")).alias("salt"), "u")
    rest = rest.join(texts.select(F.col("doc_id").alias("u"), "text"), "u").select("v", "salt", "u", "text")
    rows = heads.union(rest).select("v", "salt", "u", F.col("text").cast("binary").alias("text"))
    rows = rows.repartition("v", "salt").sortWithinPartitions("v", "salt", F.asc_nulls_first("u"))
    return settle(rows.mapInArrow(released(confirmer(size, num, den)), "u long, v long").distinct())


def shingler(size: int):
    """Arrow batches (u, text) to (u, grams): the set's hashes, sorted."""

    def work(batches):
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in chunks(at):
                h, _, bounds = shingles(Words(data[at[i] : at[j]], at[i : j + 1] - at[i]), size)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([np.unique(h[s:e]).tobytes() for s, e in zip(bounds[:-1], bounds[1:])], pa.binary())], ["u", "grams"])

    return work


def dealt(members: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of ``ROW`` of the buckets of ``members(key, band, u)`` that mix components, dealt into blocks (key, i, j)."""
    now = members.join(labels.select(F.col("node").alias("u"), F.col("component").alias("c")), "u", "left").withColumn("c", F.coalesce("c", "u"))
    now = settle(now.join(classes.select("u", F.col("n_shingles").alias("n")), "u"))
    parts = now.groupBy("key", "c").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    main = parts.groupBy("key").agg(F.max_by(F.struct("c", "rows", "grams"), F.struct("rows", "c")).alias("x"), F.sum("rows").alias("rows"), F.sum("grams").alias("grams")).filter("rows > x.rows")
    blocks = lambda rows, grams: F.greatest(F.ceil(rows / BLOCK), F.ceil(grams / ROOM), F.lit(1).cast("long")).cast("int")
    main = main.select("key", F.col("x.c").alias("main"), blocks(F.col("rows"), F.col("grams")).alias("wide"), blocks(F.col("rows") - F.col("x.rows"), F.col("grams") - F.col("x.grams")).alias("tall"))
    main = settle(main)  # so that a large bucket can be split in the join
    now = now.join(main, "key").withColumn("asker", F.col("c") != F.col("main"))
    deal = lambda n: F.pmod(F.xxhash64("u"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shape = lambda df, i, j, asks, member: df.select("key", i.alias("i"), j.alias("j"), "u", "c", "n", "band", "asker", asks.alias("asks"), member.alias("member"))
    yes, no, one = F.lit(True), F.lit(False), (F.col("wide") == 1) & (F.col("tall") == 1)
    small = shape(now.filter(one), F.lit(0), F.lit(0), F.col("asker"), yes)
    asking = shape(now.filter(~one & F.col("asker")), deal("tall"), each("wide"), yes, no)
    asked = shape(now.filter(~one), each("tall"), deal("wide"), no, yes)
    return small.union(asking).union(asked).join(classes.select("u", "sig"), "u").select(*ROW)


@scratch
def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, miss: float = 1e-5) -> DataFrame:
    """Components of ``docs(doc_id, text)`` under Jaccard similarity of word shingles >= num/den.

    Returns doc_id, n_shingles, component_id, kept (doc_id = component_id), one row for each input row.
    ``miss`` bounds, separately, the chance that a pair at the threshold shares no band and the
    posterior under which a pair is dropped.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bands = bands_for(num / den, miss=miss)
    least = least_matches(num / den, miss, bands * ROWS)
    signed = settle(docs.mapInArrow(released(signer(shingle, bands)), f"doc_id long, {SIGNED}"))
    known = signed.filter("doc_id is not null and n_shingles > 0")
    classes = known.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("u"), F.min(F.struct("doc_id", "sig", "bands")).alias("x"))
    classes = settle(classes.select("n_shingles", "s1", "s2", "u", "x.sig", "x.bands"))
    buckets = classes.select("u", F.posexplode("bands").alias("band", "key"))
    ends = buckets.groupBy("key").agg(F.min("u").alias("m"), F.max("u").alias("x")).filter("m < x").select("key", "m")
    members = settle(buckets.join(ends, "key").distinct())
    texts = docs.filter("doc_id is not null")

    votes = members.filter("u > m").groupBy("u", "m").agg(F.count("*").alias("votes"))
    first = votes.groupBy("u").agg(F.min(F.struct(-F.col("votes"), F.col("m").alias("v"))).alias("x")).select("u", "x.v")
    both = first.join(classes.select("u", F.col("sig").alias("a"), F.col("n_shingles").alias("n")), "u")
    both = both.join(classes.select(F.col("u").alias("v"), F.col("sig").alias("b"), F.col("n_shingles").alias("m")), "v")
    both = both.filter(den * F.least("n", "m") >= num * F.greatest("n", "m"))
    links = confirmed(settle(both.select("u", "v", "a", "b").mapInArrow(released(pruner(least)), "u long, v long")), texts, shingle, num, den)
    twice = known.groupBy("doc_id").agg(F.min("s1").alias("a"), F.max("s1").alias("b")).filter("a <> b").select("doc_id")
    of = known.join(classes.select("n_shingles", "s1", "s2", "u"), ["n_shingles", "s1", "s2"])
    links = links.union(of.join(twice, "doc_id").select(F.col("doc_id").alias("u"), F.col("u").alias("v")))
    labels = settle(connected(links))

    grouped = lambda rows: rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    members = members.select("key", "band", "u")
    rows = dealt(members, labels, classes)
    found = settle(grouped(rows).mapInArrow(released(streamed(3, closest(least, num, den, BEST))), "u long, v long, held long"))
    labels = joined(labels, confirmed(found.filter("u is not null").select("u", "v").distinct(), texts, shingle, num, den))
    held = settle(found.filter("held is not null").select(F.col("held").alias("key")).distinct())
    if not held.isEmpty():
        rows = dealt(members.join(held, "key"), labels, classes)
        wanted = settle(rows.select("u").distinct().join(texts.withColumnRenamed("doc_id", "u"), "u").select("u", "text").mapInArrow(released(shingler(shingle)), "u long, grams binary").distinct())
        pairs = settle(grouped(rows.join(wanted, "u").select(*ROW, "grams")).mapInArrow(released(streamed(3, spanning(least, num, den), 1)), "u long, v long").distinct())
        labels = joined(labels, confirmed(pairs, texts, shingle, num, den))

    member = known.select("doc_id", "n_shingles", "s1", "s2").join(classes.select("n_shingles", "s1", "s2", "u"), ["n_shingles", "s1", "s2"])
    member = member.join(labels.withColumnRenamed("node", "u"), "u", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "u")).alias("component_id"))
    return (
        signed.select("doc_id", "n_shingles")
        .join(member, "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, with all columns."""
    gone = near_duplicates(docs, **options).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
