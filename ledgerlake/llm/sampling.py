"""Quality selection by importance resampling of hashed n-gram features.

Two bag-of-hashed-n-gram models (words and word pairs, ``BUCKETS`` cells): target texts (labelled good) and raw
text (all rows). A document's log importance weight is the sum over its n-grams of the log ratio of the two;
its key is that weight plus a Gumbel number drawn from its doc_id and text, and the top k keys stay: a sample without
replacement in proportion to the weights. The k-th largest key is found by radix counts over its bits, so nothing is sorted or
gathered in one place. ``temper`` divides the log weights (off by default: 1).

Target texts are found by an exact join on doc_id, which moves whole texts; a Bloom filter of the good ids, broadcast and
of at most ``WORDS`` rows, goes before it, so that few others are moved. Where the good ids are so many that the filter lets all
pass, all texts are moved once, and the result is the same.

Defined cases: an empty or null text has weight 0 and is never kept; no good labels make all weights 0; labels
of the same doc_id: good if none says otherwise; null doc_ids match no label; equal rows draw equal numbers; ties at the k-th
key all stay; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._spark import settle
from ._words import U, Words, chunks, mix, released, utf8

BUCKETS = 1 << 16
WORDS = 1 << 19  # 64 bits each, 21 MB broadcast at most; beside 4.55 million ids 6 % of other rows pass


def cells(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the words and word pairs of each text, and their bounds."""
    w = Words(data, at)
    pair = mix(w.hash[:-1] * U(0xE7037ED1A0B428DB) + w.hash[1:]) if len(w.hash) > 1 else np.zeros(0, U)
    owner = w.text()
    same = owner[:-1] == owner[1:]
    h, o = np.concatenate([w.hash, pair[same]]), np.concatenate([owner, owner[:-1][same]])
    order = np.argsort(o, kind="stable")
    return (h[order] % U(BUCKETS)).astype(np.int64), np.searchsorted(o[order], np.arange(len(at)))


def count(batches):
    """Arrow batches (text) to (cell, n)."""
    held = np.zeros(BUCKETS, np.int64)
    for b in batches:
        data, at = utf8(b.column(0))
        for i, j in chunks(at):
            held += np.bincount(cells(data[at[i] : at[j]], at[i : j + 1] - at[i])[0], minlength=BUCKETS)
    cell = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(held[cell])], ["cell", "n"])


def counts(texts: DataFrame) -> np.ndarray:
    """N-grams of all ``texts`` in each cell."""
    found = texts.mapInArrow(released(count), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    out = np.zeros(BUCKETS)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each cell, the log of its smoothed share in the target over that in raw text; zeros without a target."""
    share = lambda n: np.log((n + 1) / (n.sum() + BUCKETS))
    return share(target) - share(raw) if target.any() else np.zeros(BUCKETS)


def gumbel(ids: np.ndarray, sums: np.ndarray, seed: int) -> np.ndarray:
    """A Gumbel number of each (doc_id, checksum of the text)."""
    u = (mix(mix(ids.astype(U) + U(seed)) + sums.astype(U) * U(0xE7037ED1A0B428DB) + U(0x9E3779B97F4A7C15)) >> U(11)).astype(float)
    return -np.log(-np.log((u + 0.5) / 2**53))


FIXED, SHIFT = 2.0**20, 2**62  # keys as whole numbers, order kept: a millionth apart, of weights up to 2**41


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest ``key`` (long, not negative) by counts of 16 bits at a time; None if there are fewer."""
    low, left = 0, k
    for shift in (48, 32, 16, 0):
        part = keys.filter(F.shiftright("key", shift + 16) == low) if shift < 48 else keys
        found = sorted(part.groupBy(F.shiftright("key", shift).alias("b")).count().collect(), reverse=True)  # 65,536 rows at most
        for b, n in found:
            if n >= left:
                low = b
                break
            left -= n
        else:
            return None
    return low


def possible(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """All rows of ``docs`` whose doc_id (long) is in ``ids``, and a few others: two bits of one word of a Bloom filter for each id."""
    word = F.expr(f"xxhash64(doc_id) & {WORDS - 1}")
    bits = F.expr(" | ".join(f"shiftleft(1L, cast(shiftright(xxhash64(doc_id), {k}) & 63 as int))" for k in (32, 40)))
    held = ids.select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("held"))
    asked = docs.withColumns({"_word": word, "_bits": bits})
    return asked.join(F.broadcast(held), F.expr("_word = word and _bits & held = _bits"), "left_semi").select(*docs.columns)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 0, temper: float = 1.0) -> DataFrame:
    """doc_id, n_grams, log_weight, key, kept of ``docs(doc_id, text)``.

    ``labels(doc_id, good)``. ``share`` of the non-empty documents stay; by default the labels' share of good ones.
    """
    spark = docs.sparkSession
    marks = labels.filter("doc_id is not null and good is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("good").cast("int")).alias("target"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    good = marks.filter("target = 1").select("doc_id")
    wanted = possible(docs, good).join(good.hint("merge"), "doc_id", "left_semi")  # the same plan at every size
    shared = spark.sparkContext.broadcast(log_ratio(counts(docs.select("text")), counts(wanted.select("text"))))

    def score(batches):
        for b in batches:
            data, at = utf8(b.column(1))
            ids = np.array([0 if x is None else x for x in b.column(0).to_pylist()], np.int64)
            for i, j in chunks(at):
                raw, ends = data[at[i] : at[j]], (at[i : j + 1] - at[i])
                cell, bounds = cells(raw, ends)
                size, weight = np.diff(bounds), np.zeros(j - i)
                full = np.flatnonzero(size)
                if len(full):
                    weight[full] = np.add.reduceat(shared.value[cell], bounds[:-1][full])
                view = memoryview(np.ascontiguousarray(raw))
                sums = np.array([zlib.crc32(view[s:e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(size), pa.array(weight), pa.array(weight / temper + gumbel(ids[i:j], sums, seed))], ["doc_id", "n_grams", "log_weight", "key"])

    scored = settle(docs.mapInArrow(released(score), "doc_id long, n_grams long, log_weight double, key double"))
    if share is None:
        share = marks.agg(F.avg("target")).first()[0]
    some = scored.filter("n_grams > 0")
    k = round((1.0 if share is None else share) * some.count())
    fixed = F.floor(F.col("key") * FIXED) + F.lit(SHIFT)
    keys = settle(some.select(fixed.alias("key")))
    least = kth_largest(keys, k) if k else None
    kept = F.lit(False) if not k else F.lit(True) if least is None else fixed >= least
    return scored.withColumn("kept", kept & (F.col("n_grams") > 0))
