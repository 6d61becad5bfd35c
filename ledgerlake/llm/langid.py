"""Language ID by n-gram language bitmasks in a bit-sliced Bloom filter.

Character n-grams are counted per language over all learning rows (partial counts in each task, one
aggregation on the n-gram). An n-gram enters the filter of a language if its share of that language's
n-grams is at least ``1 / GRAMS`` and at least ``NEAR`` times its largest share in any language; so a
language has at most GRAMS n-grams and the model has a fixed bound, whatever the corpus. Cell i of the
table holds the bitmask of the languages whose filter has bit i, 64 languages a word; the AND of an n-gram's cells is the
set of languages that contain it. Per-language popcounts over a text, corrected for each filter's false
positives, decide.

Defined cases: a null text or one without a letter is ``und`` with score 0; null texts and null
languages teach nothing; nothing learned makes every text ``und``; ties go to the language with more
learned n-grams, then the smaller name; a null doc_id learns as the empty text's checksum would; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._spark import settle
from ._words import U, chunks, mix, released, utf8

SIZES = (2, 3, 4)
GRAMS, NEAR, CELLS, PROBES, CHUNK = 50_000, 0.25, 1 << 20, 4, 1 << 18


def letters(code: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    out = ((code | 32) - 97 < 26) & (code < 128)
    high = np.flatnonzero(code >= 128)
    if len(high):
        distinct, back = np.unique(code[high], return_inverse=True)
        out[high] = np.array([chr(c).isalpha() for c in distinct.tolist()], bool)[back]
    return out


def grams(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size, hashes of the n-grams of lower-cased letters with one space between words, and bounds of each text."""
    joined = "\n".join((t or "").replace("\n", " ") for t in texts).lower() + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    ends = np.flatnonzero(code == 10)
    letter = letters(code)
    text = np.zeros(len(code), np.int64)
    text[ends[:-1] + 1] = 1
    text = np.cumsum(text)
    sign = np.where(letter, code, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a space after each word
    keep[:-1] |= letter[1:]  # and before
    sign, text = sign[keep].astype(U), text[keep]
    once = np.ones(len(sign), bool)
    once[1:] = (sign[1:] != 32) | (sign[:-1] != 32) | (text[1:] != text[:-1])
    sign, text = sign[once], text[once]
    out, each = [], np.arange(len(texts) + 1)
    for n in SIZES:
        h = np.full(max(0, len(sign) - n + 1), U(n))
        for k in range(n):
            h = h * U(0x100000001B3) + sign[k : len(sign) - n + 1 + k]
        of = text[: len(h)]
        whole = of == text[n - 1 :]
        out.append((mix(h[whole] * U(0x9E3779B97F4A7C15)), np.searchsorted(of[whole], each)))
    return out


def count(batches):
    """Arrow batches (text, lang) to (lang, gram, n), counts added up over each task's batches in turn."""
    held: dict[str, list] = {}

    def flush(lang: str):
        h, n = (np.concatenate(x) for x in zip(*held[lang]))
        keys, back = np.unique(h, return_inverse=True)
        return keys, np.bincount(back, n, len(keys)).astype(np.int64)

    def rows(lang: str, keys: np.ndarray, n: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    for batch in batches:
        _, at = utf8(batch.column(0))
        langs = np.array(batch.column(1).to_pylist(), object)
        for i, j in chunks(at, CHUNK):
            texts = batch.column(0).slice(i, j - i).to_pylist()
            for lang in sorted(set(langs[i:j])):
                h = np.concatenate([h for h, _ in grams([t for t, x in zip(texts, langs[i:j]) if x == lang])])
                keys, n = np.unique(h, return_counts=True)
                held.setdefault(lang, []).append((keys, n))
                if sum(len(x[0]) for x in held[lang]) > 2_000_000:
                    keys, n = flush(lang)
                    held[lang] = [(keys, n)]
                    if len(keys) > 1_000_000:  # bounded memory: hand on what has gathered
                        yield rows(lang, keys, n)
                        del held[lang]
    for lang in list(held):
        yield rows(lang, *flush(lang))


def probes(h: np.ndarray) -> list[np.ndarray]:
    """Cells of each n-gram: double hashing."""
    a, b = h & U(0xFFFFFFFF), (h >> U(32)) | U(1)
    return [((a + U(k) * b) % U(CELLS)).astype(np.int64) for k in range(PROBES)]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # uint64[words, CELLS]: bit l of cell i is bit i of the filter of language l, 64 languages a word
    false: np.ndarray  # expected false positive rate of each filter

    def languages_of(self, cells: list[np.ndarray], word: int = 0) -> np.ndarray:
        """Bitmask, of one word of languages, of those that contain each n-gram."""
        mask = np.full(len(cells[0]), ~U(0))
        for cell in cells:
            mask &= self.table[word][cell]
        return mask

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        parts = grams(texts)
        n = sum(np.diff(bounds) for _, bounds in parts)
        some = n > 0
        if not self.langs or not some.any():
            return [("und", 0.0)] * len(texts)
        hits = np.zeros((len(self.langs), len(texts)), np.int64)
        for h, bounds in parts:
            full, at = np.flatnonzero(np.diff(bounds)), probes(h)
            for k in range(len(self.langs) if len(full) else 0):
                if k % 64 == 0:
                    mask = self.languages_of(at, k // 64)
                hits[k, full] += np.add.reduceat((mask >> U(k % 64) & U(1)).astype(np.int64), bounds[:-1][full])
        share = np.clip((hits.T / np.maximum(n, 1)[:, None] - self.false) / (1 - self.false), 0, 1)
        best = share.argmax(1)
        return [(self.langs[b], float(s[b])) if ok else ("und", 0.0) for b, s, ok in zip(best, share, some)]


def learn(rows: DataFrame) -> Model:
    """A model of ``rows(text, lang)``."""
    rows = rows.filter("text is not null and lang is not null").select("text", "lang")
    counts = settle(rows.mapInArrow(released(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}  # a row for each language
    langs = sorted(totals, key=lambda x: (-totals[x], x))
    if not langs:
        return Model([], np.zeros((1, CELLS), U), np.zeros(0))
    sizes = counts.sparkSession.createDataFrame(list(totals.items()), "lang string, total long")
    share = F.col("n") / F.col("total")
    often = counts.join(F.broadcast(sizes), "lang").withColumn("share", share).filter(F.col("share") >= 1 / GRAMS)
    most = often.groupBy("gram").agg(F.max("share").alias("most"))
    chosen = often.join(most, "gram").filter(F.col("share") >= NEAR * F.col("most")).select("lang", "gram").toArrow()  # at most GRAMS a language
    table, false = np.zeros((-(-len(langs) // 64), CELLS), U), np.zeros(len(langs))
    gram, of = chosen.column("gram").to_numpy().view(U), np.array(chosen.column("lang").to_pylist(), object)
    for k, lang in enumerate(langs):
        for cell in probes(gram[of == lang]):
            np.bitwise_or.at(table[k // 64], cell, U(1) << U(k % 64))
        false[k] = ((table[k // 64] >> U(k % 64) & U(1)).mean()) ** PROBES
    return Model(langs, table, false)


def identify(docs: DataFrame, model: Model) -> Column:
    """struct(lang_pred, score) of ``text`` of ``docs`` (score 0 to 1: corrected share of the text's n-grams in that language). Only the text goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def said(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def work(batches):
            for batch in batches:
                batch = [t if isinstance(t, str) else None for t in batch]
                size = np.cumsum([0, *(len(t or "") for t in batch)])
                found = [x for i, j in chunks(size, CHUNK) for x in shared.value.predict(batch[i:j])]
                yield pd.DataFrame(found, columns=["lang_pred", "score"])

        yield from released(work)(texts)

    return F.pandas_udf(said, "lang_pred string, score double")(F.col("text"))


def held_out(docs: DataFrame):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def label_languages(docs: DataFrame) -> DataFrame:
    """Learns from the rows of ``docs`` whose crc32(doc_id as text) mod 5 is not 0; doc_id, held_out, lang_pred, score of all."""
    model = learn(docs.filter(~held_out(docs)))
    out = docs.select("doc_id", held_out(docs).alias("held_out"), identify(docs, model).alias("said"))
    return out.select("doc_id", "held_out", "said.lang_pred", "said.score")


def keep_languages(docs: DataFrame, least: float = 0.05, model: Model | None = None) -> DataFrame:
    """Rows of ``docs`` that are in a learned language: not ``und``, score at least ``least``. Columns as they were."""
    model = model or learn(docs)
    said = identify(docs, model)
    return docs.filter((said["lang_pred"] != "und") & (said["score"] >= least))
