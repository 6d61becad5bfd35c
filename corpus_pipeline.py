"""Stages from raw documents to packed training sequences; each works on all that the one before kept.

Defined cases, beside those of the operators: a null, empty or letterless text is in no language and goes at the first stage; with no ``lang``
at all nothing is learned and every document goes; a null doc_id takes no part in near and substring dedup and stays; rows with equal doc_id are one
document (one row of equal ones may stay in each place that the operators say); n_chars, if there is such a column, follows the text; all other columns, whatever their
names, pass to the last stage as they were; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake.llm._spark import discard, settle, table
from ledgerlake.llm.langid import keep_languages
from ledgerlake.llm.line_dedup import dedup_lines
from ledgerlake.llm.near_dedup import drop_near_duplicates
from ledgerlake.llm.packing import pack
from ledgerlake.llm.passages import drop_passages
from ledgerlake.llm.queries import vocabulary


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` with n_chars, if there is such a column, of the text as it now is."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_languages(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(rest)], F.lit(0).alias("_")).alias("_rest"))
    kept = dedup_lines(packed).select("doc_id", "text", *[F.col(f"_rest._{i}").alias(c) for i, c in enumerate(rest)])
    return counted(kept, docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, shingle=5, num=80, den=100)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(drop_passages(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near), ("substring_dedup", passages), ("best_fit_packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
        discard(*before)
        before = [docs]
    return docs


#: The stages learn, hash and pack; SQL can't express them. tests/llm/test_brute.py holds them against plain Python, pair by pair.
ORACLE_SQL = None
