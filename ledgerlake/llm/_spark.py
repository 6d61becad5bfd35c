"""Shared folder, lineage cuts and connected components."""

from __future__ import annotations

import contextlib
import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake.session import shared_dir


_open: list[list[DataFrame]] = []


@contextlib.contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int = 2_000):
    """Arrow batches of ``rows`` rows at most, as texts are long: each task holds several copies of a batch on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage ends at files that survive any executor, and later uses prune columns. What was shuffled to
    make ``df`` is then garbage; the collection lets Spark's cleaner free that disk at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    with few_rows_a_batch(spark):
        df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    if _open:
        _open[-1].append(out)
    return out


def scratch(operator):
    """``operator`` with its result settled and all other tables that it settled deleted at its end."""

    @functools.wraps(operator)
    def run(*args, **options) -> DataFrame:
        _open.append([])
        out, done = None, []
        try:
            out = settle(operator(*args, **options))
        finally:
            done = _open.pop()
            discard(*[t for t in done if t is not out])
        if _open:
            _open[-1].append(out)
        return out

    return run


def discard(*tables: DataFrame) -> None:
    """Delete the files of settled ``tables``, once each; only when all that reads them is settled itself."""
    for t in tables:
        if t._settled:
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(t._settled)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            t._settled = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)``: rows ``node, component`` (smallest node reachable).

    Alternates the large-star and small-star contractions until the edge set stops changing. Each
    step is two shuffles of id pairs; nothing is collected but a count and a checksum.
    Nulls in ``u`` or ``v`` are dropped, self loops and repeated edges change nothing.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return settle(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = tidy(edges)
    seen = mark(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = tidy(large)
        low = kept.groupBy("u").agg(F.min("v").alias("m"))
        small = kept.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = tidy(small)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(node, component)`` after further ``links(u, v)``: only links between components are contracted."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}c"))
    across = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("uc", "u").alias("u"), F.coalesce("vc", "v").alias("v"))
    moved = settle(connected(across))
    new = labels.join(moved.toDF("component", "moved"), "component", "left").select("node", F.coalesce("moved", "component").alias("component"))
    return settle(new.union(moved.join(labels, "node", "left_anti").select("node", "component")))
