"""Aggregation over repeats that refuses to return a misleading error bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlake.errors import CorpusError

#: Columns that identify or carry a measurement, never a dimension that must be named.
NOT_DIMENSIONS = ("run", "attempt", "value", "nonfinite")


def distinct(c: str):
    """Number of distinct values, a null being one."""
    return F.count_distinct(F.struct(c))


def curve(frame: DataFrame, over: str, x: str, by: list[str]) -> DataFrame:
    """Columns ``by`` and ``x``, then y (mean), yerr (standard error over ``over``; null for one), n; null values left out."""
    group = frame.filter("value IS NOT NULL").groupBy(*by, x)
    return group.agg(F.avg("value").alias("y"), (F.stddev_samp("value") / F.sqrt(distinct(over))).alias("yerr"), distinct(over).alias("n"))


def ragged_groups(points: DataFrame, by: list[str]) -> DataFrame:
    """Groups of a curve whose n varies along x: by, least, most."""
    out = points.groupBy(*by).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count_distinct("n").alias("_k"))
    return out.filter("_k > 1").drop("_k")


def varying_columns(frame: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """How many values each of ``columns`` takes in each group."""
    return frame.groupBy(*group).agg(*[distinct(c).alias(c) for c in columns])


def check_one_row_per_repeat(frame: DataFrame, by: list[str], x: str, over: str) -> None:
    group = [*by, x, over]
    others = [c for c in frame.columns if c not in group and c not in NOT_DIMENSIONS]
    counted = frame.groupBy(*group).agg(F.count("*").alias("_rows"), *[distinct(c).alias(f"_{i}") for i, c in enumerate(others)]).filter("_rows > 1")
    row = counted.agg(F.count("*").alias("groups"), *[F.max(f"_{i}").alias(f"_{i}") for i in range(len(others))]).first()
    if row["groups"]:
        differ = [c for i, c in enumerate(others) if row[f"_{i}"] > 1]
        raise CorpusError(f"{row['groups']} groups of {group} hold more than one row; " + (f"these columns differ: {', '.join(differ)}" if differ else "no column tells them apart"))


def aggregate(frame: DataFrame, *, over: str, x: str, by: str | list[str] | None = None, allow_ragged: bool = False, allow_nonfinite: bool = False) -> DataFrame:
    """Mean, standard error and n of ``value`` over repeats, sorted by (by, x).

    Refuses, in this order: a missing column; mixed metric names that ``by`` doesn't separate; more than one
    row for a (by, x, over); diverged values (unless ``allow_nonfinite``); n that varies along x (unless
    ``allow_ragged``). The checks are jobs of their own: cache ``frame`` if it is dear.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    if missing := [c for c in [*by, x, over, "value"] if c not in frame.columns]:
        raise CorpusError(f"no column {', '.join(missing)}; there are {', '.join(frame.columns)}")
    if "name" in frame.columns and "name" not in [*by, x]:
        names = [r[0] for r in frame.select("name").distinct().orderBy("name").limit(6).collect()]
        if len(names) > 1:
            raise CorpusError(f"metrics {', '.join(map(str, names))} are mixed; filter to one or put name in by")
    check_one_row_per_repeat(frame, by, x, over)
    if not allow_nonfinite:
        bad = frame.filter("value IS NULL")
        if bad.limit(1).count():
            who = [r[0] for r in bad.select(F.col(over).cast("string")).distinct().orderBy(over).limit(5).collect()]
            raise CorpusError(f"{bad.count()} values are not finite, at {over} {', '.join(map(str, who))}; allow_nonfinite=True leaves them out")
    out = curve(frame, over, x, by)
    if not allow_ragged:
        uneven = (ragged_groups(out, by) if by else ragged_groups(out.withColumn("_all", F.lit(1)), ["_all"])).limit(5).collect()
        if uneven:
            raise CorpusError("n varies along x: " + "; ".join(str(r.asDict()) for r in uneven) + "; allow_ragged=True permits it")
    return out.orderBy(*by, x)
