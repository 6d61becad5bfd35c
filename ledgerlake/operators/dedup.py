"""Deduplication across attempts and the uniqueness guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerlake.errors import CorpusError


def latest_attempt(rows: DataFrame, key: list[str], attempt: str = "attempt") -> DataFrame:
    """Of each key (null equals null) the row of the highest attempt."""
    w = Window.partitionBy(*key).orderBy(F.desc(attempt))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def guarded(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows``, failing at run time if (run, attempt, *key) repeats.

    The guard is a filter on the window's column, so it can't be pruned, and it comes before any choice
    among attempts, so it sees a superseded attempt's repeats too. Call after ``repartition("run", *key)``:
    both windows then share that one exchange.
    """
    w = Window.partitionBy("run", "attempt", *key)
    told = F.raise_error(F.concat_ws(" ", F.lit("duplicate metric key in run"), F.col("run"), F.lit("attempt"), F.col("attempt").cast("string"), F.col("name")))
    return rows.withColumn("_dups", F.count("*").over(w)).filter(F.when(F.col("_dups") == 1, F.lit(True)).otherwise(told.cast("boolean"))).drop("_dups")


def check_duplicates(rows: DataFrame, key: list[str]) -> None:
    """Raise CorpusError naming up to five repeated keys."""
    found = rows.groupBy("run", "attempt", *key).count().filter("count > 1").limit(5).collect()
    if found:
        raise CorpusError("duplicate metric key: " + "; ".join(str({k: v for k, v in r.asDict().items() if v is not None}) for r in found))
