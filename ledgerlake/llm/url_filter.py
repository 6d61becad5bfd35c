"""URL filter: host and path rules, then segmented hosts scored by multinomial naive Bayes.

A unigram model of words (from the pages' own visible text, all rows) splits concatenated host names by
Viterbi; host words and path tokens, hashed to ``BUCKETS`` cells, are scored by naive Bayes learned from the
pages that rules decide. Both models have a fixed bound: a word needs a share of at least ``1 / WORDS``,
and cells are a table of fixed size.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed;
so is every url while rules decide no page or only one way to allow; equal rows get equal verdicts; null
page_id passes through; extra columns are ignored; null html teaches no words.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._spark import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS, WORDS, LONGEST = 1 << 18, 200_000, 24
Rule = tuple[str, str]  # verdict; host, slash, beginning of the path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where ``://`` is missing."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does. Equal rules: the first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class Segmenter:
    """Unigram Viterbi over letters; a word not in the model costs more with each letter."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """``total``: words in all, where ``counts`` holds the common ones only."""
        self.counts, self.total = counts, total or sum(counts.values()) or 1
        self.score = {w: log(n / self.total) for w, n in counts.items() if len(w) <= LONGEST}
        self.split = lru_cache(100_000)(self._split)

    def _split(self, name: str) -> tuple[str, ...]:
        out: list[str] = []
        for run in re.findall(r"[^\W\d_]+|\d+", name):
            if run[0].isdigit():
                out.append("#")
                continue
            best, back = [0.0], [0]
            for e in range(1, len(run) + 1):
                found = max(((best[s] + self.score.get(run[s:e], -log(self.total) - 2.5 * (e - s)), -s) for s in range(max(0, e - LONGEST), e)))
                best.append(found[0])
                back.append(-found[1])
            e, words = len(run), []
            while e:
                words.append(run[back[e] : e])
                e = back[e]
            out += reversed(words)
        return tuple(out)


def tokens(host: str, path: str, seg: Segmenter) -> list[int]:
    words = [f"h:{w}" for label in host.split(".") for w in seg.split(label)]
    words += ["p:#" if t.isdigit() else f"p:{t}" for t in re.findall(r"[^\W_]+", path.lower())]
    return [zlib.crc32(w.encode()) % BUCKETS for w in words]


def learn_words(pages: DataFrame) -> Segmenter:
    plain = F.lower(F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " "))
    each = pages.filter("html is not null").select(F.explode(F.split(plain, r"[^\p{L}]+")).alias("w")).filter((F.length("w") > 0) & (F.length("w") <= LONGEST))
    counts = settle(each.groupBy("w").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(F.col("n") >= max(1, total / WORDS)).toArrow()  # WORDS rows at most
    return Segmenter(dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())), total)


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score (log odds of blocking; null where a rule decides) of ``pages(page_id, url, html)``."""
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.*")
    learned = learn_words(pages)
    seg = spark.sparkContext.broadcast((learned.counts, learned.total))

    def counted(batches):
        x, held = Segmenter(*seg.value), np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for h, p, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                np.add.at(held[int(v == "block")], tokens(h, p, x), 1)
        kind, cell = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(cell, pa.int32()), pa.array(held[kind, cell])], ["kind", "cell", "n"])

    ruled = rows.filter("verdict is not null")
    found = ruled.select("host", "path", "verdict").mapInArrow(counted, "kind int, cell int, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).toArrow()  # 2 * BUCKETS rows at most
    prior = dict(ruled.groupBy("verdict").count().collect())
    held = np.zeros((2, BUCKETS))
    held[found.column(0).to_numpy(), found.column(1).to_numpy()] = found.column(2).to_numpy()
    both = np.log((held + 1) / (held.sum(1, keepdims=True) + BUCKETS))
    odds = spark.sparkContext.broadcast((both[1] - both[0]).astype(np.float32))
    start = log((prior.get("block", 0) + 1) / (prior.get("allow", 0) + 1)) if prior.get("block") else -1.0
    none = not prior.get("block")

    def scored(batches):
        x = Segmenter(*seg.value)
        for b in batches:
            score = [None if r is not None else -1.0 if none or not h and not p else start + float(odds.value[tokens(h, p, x)].sum()) for h, p, r in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            verdict = [v or ("block" if s > 0 else "allow") for v, s in zip(b.column(4).to_pylist(), score)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(verdict), pa.array(score, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "block_score"])

    return rows.mapInArrow(scored, "page_id long, host string, path string, rule string, verdict string, block_score double")


def allowed(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows of ``pages`` whose page_id no verdict blocks, with their own columns."""
    gone = judge(pages, rules).filter("verdict = 'block'").select("page_id").distinct()
    return pages.join(gone, "page_id", "left_anti").select(*pages.columns)
