"""Corpus invariants, each a DataFrame of problems; one read of all lines serves the record checks."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake import blobs
from ledgerlake.errors import LedgerError
from ledgerlake.functions.columns import attempt_of, run_of
from ledgerlake.identity import ID_DIGITS, canonical
from ledgerlake.plans.reader import CORE, run_ids
from ledgerlake.runlog import attempt_paths, run_dir
from ledgerlake.sources import tails

ERROR, WARNING = "ERROR", "WARNING"
SHAPE = "level string, run string, message string"
_parsed: list[DataFrame] = []


@dataclass(frozen=True)
class Problem:
    level: str
    run: str
    message: str

    def __str__(self) -> str:
        return f"{self.level:<7} {self.run:<16} {self.message}"


def identity_problem(rid: str, text: str | None) -> str | None:
    """The first thing wrong with the text of a run.json."""
    import hashlib
    import json

    if text is None:
        return "no run.json"
    try:
        config = json.loads(text)
    except ValueError:
        return "run.json is not JSON"
    try:
        right = canonical(config)
    except (LedgerError, TypeError) as e:
        return f"run.json is not a configuration: {e}"
    if text != right:
        return "run.json is not in canonical form"
    if hashlib.sha256(text.encode()).hexdigest()[:ID_DIGITS] != rid:
        return "run.json does not hash to the directory's name"
    return None


def identities(spark: SparkSession, root: str | Path) -> DataFrame:
    ids = run_ids(root)
    there = [str(p) for r in ids if (p := run_dir(root, r) / "run.json").is_file()]

    def work(batches):
        import pandas as pd

        for b in batches:
            found = [(ERROR, r, m) for r, t in zip(b.run, b.value) if (m := identity_problem(r, t))]
            yield pd.DataFrame(found, columns=["level", "run", "message"])

    missing = spark.createDataFrame([(ERROR, r, "no run.json") for r in ids if not (run_dir(root, r) / "run.json").is_file()], SHAPE)
    if not there:
        return missing
    texts = spark.read.text(there, wholetext=True).withColumn("run", run_of(F.col("_metadata.file_path")))
    return missing.union(texts.select("run", "value").mapInPandas(work, SHAPE))


def lines(spark: SparkSession, root: str | Path) -> DataFrame:
    """run, attempt, line_no, fields, keys and the fields that the checks need, of every line that is an object."""
    paths = [str(p) for r in run_ids(root) for p in attempt_paths(run_dir(root, r))]
    raw = tails.load(spark, tails.Lines, paths)
    at = raw.select(run_of(F.col("path")).alias("run"), attempt_of(F.col("path")).alias("attempt"), "line_no", "line")
    rows = at.withColumn("keys", F.json_object_keys("line")).filter("keys IS NOT NULL").withColumn("fields", F.from_json("line", "map<string,string>"))
    field = lambda k: F.col("fields")[k]
    coords = F.when(field("kind") == "status", F.from_json(field("coords"), "map<string,string>"))
    return rows.select("run", "attempt", "line_no", "fields", "keys", field("kind").alias("kind"), field("git").alias("git"), coords.alias("coords"))


def problems_of(df: DataFrame, message, level: str = ERROR) -> DataFrame:
    return df.select(F.lit(level).alias("level"), "run", message.alias("message"))


def record_problems(spark: SparkSession, root: str | Path, rows: DataFrame) -> list[DataFrame]:
    file = ["run", "attempt"]
    where = F.concat(F.lit("attempt "), F.col("attempt").cast("string"), F.lit(": "))
    metrics = rows.filter("kind = 'metric'")
    fields = [k for k in CORE.fieldNames()]
    used = metrics.select(*file, F.explode("keys").alias("key")).filter(~F.col("key").isin(*fields)).groupBy(*file).agg(F.array_sort(F.collect_set("key")).alias("used"))
    first = rows.filter("kind = 'status'").groupBy(*file).agg(F.count("*").alias("n"), F.min("line_no").alias("at"), F.min_by(F.map_keys("coords"), "line_no").alias("declared"), F.min_by(F.col("coords").isNull(), "line_no").alias("none"))
    last = rows.groupBy(*file).agg(F.max("line_no").alias("end"))
    ended = last.join(first, file)
    out = [
        problems_of(ended.filter("n > 1"), F.concat(where, F.lit("more than one status"))),
        problems_of(ended.filter("n = 1 AND at < end"), F.concat(where, F.lit("the status is not the last record"))),
    ]
    both = first.join(used, file, "left").withColumn("used", F.coalesce("used", F.array().cast("array<string>"))).withColumn("declared", F.array_sort(F.coalesce("declared", F.array().cast("array<string>"))))
    out.append(problems_of(both.filter("none AND size(used) > 0"), F.concat(where, F.lit("coordinates are used and none are declared: "), F.array_join("used", ", "))))
    out.append(problems_of(both.filter("NOT none AND declared <> used"), F.concat(where, F.lit("declared "), F.array_join("declared", ", "), F.lit(" but used "), F.array_join("used", ", "))))
    # The key of a metric: every field but its kind and value, in order of name.
    key = F.to_json(F.map_from_entries(F.array_sort(F.filter(F.map_entries("fields"), lambda e: ~e["key"].isin("kind", "value", "nonfinite") & e["value"].isNotNull()))))
    repeated = metrics.groupBy(*file, key.alias("key")).agg(F.count("*").alias("n")).filter("n > 1").groupBy(*file).agg(F.count("*").alias("k"), F.min("key").alias("key"))
    out.append(problems_of(repeated, F.concat(where, F.col("k").cast("string"), F.lit(" repeated metric keys, such as "), F.col("key"))))
    there = [str(p) for r in run_ids(root) if (p := run_dir(root, r) / "run.json").is_file()]
    if there:
        config = spark.read.text(there, wholetext=True).withColumn("run", run_of(F.col("_metadata.file_path"))).select("run", F.explode(F.json_object_keys("value")).alias("key"))
        shadow = metrics.select(*file, F.explode("keys").alias("key")).distinct().join(config, ["run", "key"]).groupBy(*file).agg(F.array_join(F.array_sort(F.collect_set("key")), ", ").alias("k"))
        out.append(problems_of(shadow, F.concat(where, F.lit("shadows configuration keys: "), F.col("k"))))
    commits = rows.filter("kind = 'start' AND git IS NOT NULL").groupBy("run").agg(F.count_distinct("git").alias("n")).filter("n > 1")
    out.append(problems_of(commits, F.concat(F.lit("attempts come from "), F.col("n").cast("string"), F.lit(" commits")), WARNING))
    return out


def gaps(spark: SparkSession, root: str | Path) -> DataFrame:
    files = [(r, int(p.name.split(".")[1])) for r in run_ids(root) for p in attempt_paths(run_dir(root, r))]
    seen = spark.createDataFrame(files, "run string, attempt int").groupBy("run").agg(F.count("*").alias("n"), F.max("attempt").alias("top"), F.min("attempt").alias("low"))
    return problems_of(seen.filter("low <> 0 OR top + 1 <> n"), F.lit("attempt numbers are not 0, 1, 2, ..."))


def blob_problems(spark: SparkSession, root: str | Path, rehash: bool) -> list[DataFrame]:
    named, held = blobs.reachable(spark, root), blobs.stored(spark, root, content=rehash)
    out = [named.join(held, "ref", "left_anti").select(F.lit(ERROR).alias("level"), F.lit("-").alias("run"), F.concat(F.lit("dangling "), F.col("ref")).alias("message"))]
    if rehash:
        wrong = held.filter(F.concat(F.lit("blob:"), F.col("sha256")) != F.col("ref"))
        out.append(wrong.select(F.lit(ERROR).alias("level"), F.lit("-").alias("run"), F.concat(F.col("ref"), F.lit(" holds other content")).alias("message")))
    return out


def problems(spark: SparkSession, root: str | Path, *, rehash: bool = False) -> DataFrame:
    """level, run, message of all broken invariants, in order of run."""
    rows = lines(spark, root).persist()  # one parse for all checks
    _parsed.append(rows)
    parts = [identities(spark, root), gaps(spark, root), *record_problems(spark, root, rows), *blob_problems(spark, root, rehash)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("run", "level", "message")


def verify(spark: SparkSession, root: str | Path, *, blobs: bool = False) -> list[Problem]:
    try:
        return [Problem(*r) for r in problems(spark, root, rehash=blobs).collect()]
    finally:
        while _parsed:
            _parsed.pop().unpersist()
