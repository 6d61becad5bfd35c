"""Queries over run-log corpora that the engine's own writer makes from the driver's tables, with SQL over those tables.

A corpus has a run for each supplier. Of a supplier k: configuration ``{"method": "m<k mod 3>", "seed": k}``; steps 0 to 5, and where k mod 4
is 0 a second attempt that logs steps 4 to 7 again; two splits; it fails where k mod 7 is 3 and stays open where k mod 7 is 5.
"""

from __future__ import annotations

import hashlib
import shutil
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake import blobs, provenance, runlog
from ledgerlake.operators.aggregate import aggregate
from ledgerlake.plans import reader, verify
from ledgerlake.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_made: dict[tuple, Path] = {}


def query(sql: str):
    """Register a function under its own name, with its SQL."""

    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def value_at(balance: float, step: int, split: str) -> float:
    return balance + step * 0.5 + (1000.0 if split == "train" else 0.0)


def log_attempt(run: runlog.Run, k: int, balance: float, steps: range, again: bool) -> None:
    for step in steps:
        for split in ("test", "train"):
            value = value_at(balance, step, split) + (0.25 if again else 0.0)
            if k % 11 == 0 and step == 3:
                value = float("nan") if split == "test" else float("inf")
            extra = {"layer": step % 3} if k % 2 == 0 else {}
            extra |= {"width": 1 if k % 3 == 0 else 1.5} if k % 3 < 2 else {}
            run.metric("acc", value, step=step, split=split, **extra)
    run.metric("size", k)
    run.event("phase", step=steps[-1], loud=k % 2 == 0)
    run.blob("artifact", f"artifact {k % 10}".encode(), step=steps[0])
    if k % 5 == 0:
        run.blob("array", np.arange(k % 4 + 1, dtype="int32"))


def write_run(root: Path, k: int, balance: float) -> None:
    config = {"method": f"m{k % 3}", "seed": k}
    if k % 4 == 0:
        first = runlog.init(root, config, runtime={"worker": k})
        log_attempt(first, k, balance, range(6), False)
        first.close()
    run = runlog.init(root, config, resumed_from="checkpoint" if k % 4 == 0 else None)
    log_attempt(run, k, balance, range(4, 8) if k % 4 == 0 else range(6), k % 4 == 0)
    if k % 7 == 3:
        run.fail("Stopped")
    elif k % 7 == 5:
        run.close()
        with open(runlog.attempt_paths(runlog.run_dir(root, run.rid))[-1], "a") as f:  # a line cut short
            f.write('{"kind":"metric","step":99,"split":"te')
    else:
        run.finish()


def suppliers(spark: SparkSession, sf_dir: str) -> list:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_acctbal").orderBy("s_suppkey").collect()


def made(spark: SparkSession, sf_dir: str, kind: str, build: Callable[[Path], None]) -> Path:
    """The folder of a corpus, made once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _made or not _made[key].is_dir():
        root = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:")) / f"corpus-{kind}-{uuid.uuid4().hex}"
        root.mkdir(parents=True)
        with provenance.held():
            build(root)
        _made[key] = root
    return _made[key]


def corpus(spark: SparkSession, sf_dir: str) -> Path:
    def build(root: Path) -> None:
        for k, balance in suppliers(spark, sf_dir):
            write_run(root, k, balance)
        (root / "runs" / "empty").mkdir()  # a directory without attempts
        for j in range(10, 15):  # nothing names these
            blobs.put(root, f"artifact {j}".encode())

    return made(spark, sf_dir, "whole", build)


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# Parts of the SQL: the corpus as the writer's rules say it is.
RUN = """s AS (SELECT s_suppkey AS k, s_acctbal AS balance, 'm' || (s_suppkey % 3) AS method, substr(sha256('{"method":"m' || (s_suppkey % 3) || '","seed":' || s_suppkey || '}'), 1, 16) AS run,
 CASE WHEN s_suppkey % 7 = 3 THEN 'failed' WHEN s_suppkey % 7 = 5 THEN 'incomplete' ELSE 'finished' END AS status FROM supplier),
a AS (SELECT s.*, CAST(0 AS INTEGER) AS attempt, 0 AS low, 6 AS high, 0.0 AS more FROM s UNION ALL SELECT s.*, 1, 4, 8, 0.25 FROM s WHERE k % 4 = 0),
p AS (SELECT a.*, CAST(step AS BIGINT) AS step, split FROM (SELECT a.*, unnest(range(low, high)) AS step FROM a) a, (VALUES ('test'), ('train')) t(split)),
v AS (SELECT p.*, 'acc' AS name, CASE WHEN k % 11 = 0 AND step = 3 THEN NULL ELSE balance + step * 0.5::DOUBLE + CASE WHEN split = 'train' THEN 1000.0::DOUBLE ELSE 0.0::DOUBLE END + more::DOUBLE END AS value,
 CASE WHEN k % 11 = 0 AND step = 3 THEN CASE WHEN split = 'test' THEN 'nan' ELSE '+inf' END END AS nonfinite,
 CASE WHEN k % 2 = 0 THEN CAST(step % 3 AS BIGINT) END AS layer, CASE k % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.5::DOUBLE END AS width FROM p),
m AS (SELECT run, attempt, step, split, name, value, nonfinite, layer, width, method, CAST(k AS BIGINT) AS seed, status FROM v
 UNION ALL SELECT run, attempt, NULL, NULL, 'size', CAST(k AS DOUBLE), NULL, NULL, NULL, method, CAST(k AS BIGINT), status FROM a),
tidy AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY run, name, step, split, layer, width ORDER BY attempt DESC) = 1)"""
COLUMNS = "run, attempt, step, split, name, round(value, 6) AS value, nonfinite, layer, width, method, seed"


def tidy(df: DataFrame) -> DataFrame:
    return df.select("run", "attempt", "step", "split", "name", F.round("value", 6).alias("value"), "nonfinite", "layer", "width", "method", "seed")


@query(f"WITH {RUN} SELECT run, status, CAST(CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS attempts, CAST(CASE WHEN k % 4 = 0 AND status = 'incomplete' THEN 2 WHEN k % 4 = 0 OR status = 'incomplete' THEN 1 ELSE 0 END AS BIGINT) AS undeclared FROM s UNION ALL SELECT 'empty', 'incomplete', 0, 0")
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reader.scan(spark, corpus(spark, sf_dir))
    return frame(spark, [(r.rid, r.status, len(r.paths), len(r.undeclared)) for r in found], "run string, status string, attempts long, undeclared long")


@query(f"""WITH {RUN} SELECT run, string_agg(key || ' ' || kind, ', ' ORDER BY key) AS declared FROM (SELECT run, 'layer' AS key, 'BIGINT' AS kind FROM s WHERE k % 2 = 0 AND status <> 'incomplete'
 UNION ALL SELECT run, 'width', CASE WHEN k % 3 = 0 THEN 'BIGINT' ELSE 'DOUBLE' END FROM s WHERE k % 3 < 2 AND status <> 'incomplete') GROUP BY run""")
def log_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(r.rid, ", ".join(f"{k} {v}" for k, v in sorted(r.coords.items()))) for r in reader.scan(spark, corpus(spark, sf_dir)) if r.coords]
    return frame(spark, found, "run string, declared string")


@query(f"WITH {RUN} SELECT status, CAST(count(*) AS BIGINT) AS n FROM (SELECT status FROM s UNION ALL SELECT 'incomplete') GROUP BY status")
def log_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reader.census(spark, corpus(spark, sf_dir))
    return frame(spark, [(s, n) for s, n in found.items() if s != "runs" and n], "status string, n long")


@query("SELECT 'layer' AS key, 'BIGINT' AS kind UNION ALL SELECT 'width', 'DOUBLE'")
def log_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, list(reader.discover(spark, corpus(spark, sf_dir)).items()), "key string, kind string")


@query(f"WITH {RUN} SELECT run, status FROM s WHERE k <= 12")
def log_status_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = corpus(spark, sf_dir)
    ids = [runlog.run_id({"method": f"m{k % 3}", "seed": k}) for k, _ in suppliers(spark, sf_dir) if k <= 12]
    return frame(spark, [(r, reader.status_of(spark, root, r)) for r in ids], "run string, status string")


@query(f"WITH {RUN} SELECT {COLUMNS} FROM tidy WHERE status = 'finished'")
def log_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(reader.load(spark, corpus(spark, sf_dir)))


@query(f"WITH {RUN} SELECT {COLUMNS} FROM tidy")
def log_load_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(reader.load(spark, corpus(spark, sf_dir), require_finished=False, validate=False))


@query(f"WITH {RUN} SELECT {COLUMNS} FROM tidy WHERE status = 'finished' AND name = 'acc' AND layer IS NOT NULL")
def log_load_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(reader.load(spark, corpus(spark, sf_dir), names=["acc"], coords=["layer"]))


@query(f"""WITH {RUN} SELECT method, step AS x, round(avg(value), 6) AS y, round(stddev_samp(value) / sqrt(count(*)), 6) AS yerr, count(*) AS n FROM tidy
WHERE status = 'finished' AND name = 'acc' AND split = 'test' AND value IS NOT NULL GROUP BY method, step""")
def log_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reader.load(spark, corpus(spark, sf_dir), names=["acc"]).filter("split = 'test'")
    out = aggregate(rows, over="seed", x="step", by="method", allow_ragged=True, allow_nonfinite=True)
    return out.select("method", F.col("step").alias("x"), F.round("y", 6).alias("y"), F.round("yerr", 6).alias("yerr"), "n")


@query(f"WITH {RUN} SELECT method, name, count(*) AS n, round(avg(value), 6) AS y FROM tidy GROUP BY method, name")
def log_query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.query(spark, corpus(spark, sf_dir), "SELECT method, name, count(*) AS n, round(avg(value), 6) AS y FROM metrics GROUP BY method, name")


@query(f"WITH {RUN} SELECT run, step, round(value, 6) AS value FROM tidy WHERE name = 'acc' AND split = 'train' AND run IN (SELECT run FROM s WHERE method = 'm1' AND k > 2) AND value > (SELECT avg(value) FROM tidy WHERE name = 'acc')")
def log_query_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar subquery, IN (SELECT ...) and values bound by name."""
    sql = "SELECT run, step, round(value, 6) AS value FROM metrics WHERE name = :name AND split = 'train' AND run IN (SELECT run FROM runs WHERE method = :method AND seed > :least) AND value > (SELECT avg(value) FROM metrics WHERE name = :name)"
    return reader.query(spark, corpus(spark, sf_dir), sql, name="acc", method="m1", least=2)


@query(f"WITH {RUN} SELECT run, step, round(value, 6) AS value FROM tidy WHERE name = 'acc' AND split = 'test' AND value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run ORDER BY value DESC, step) = 1")
def log_query_qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QUALIFY and list_contains as other dialects write them."""
    sql = "SELECT run, step, round(value, 6) AS value FROM metrics WHERE list_contains(array('acc', 'none'), name) AND split = 'test' AND value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run ORDER BY metrics.value DESC, step) = 1 ORDER BY run"
    return reader.query(spark, corpus(spark, sf_dir), sql)


@query(f"WITH {RUN} SELECT method, status, count(*) AS n FROM s GROUP BY method, status")
def log_query_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.query(spark, corpus(spark, sf_dir), "SELECT * EXCLUDE (run, seed), count(*) AS n FROM runs GROUP BY ALL")


@query(f"""WITH {RUN} SELECT run, attempt, kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT run, attempt, 'metric' AS kind, count(*) AS n FROM m GROUP BY run, attempt UNION ALL SELECT run, attempt, unnest(['start', 'event']), 1 FROM a
UNION ALL SELECT run, attempt, 'blob', CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END FROM a UNION ALL SELECT run, attempt, 'status', 1 FROM a WHERE status <> 'incomplete' AND (attempt = 1 OR k % 4 <> 0)) GROUP BY run, attempt, kind""")
def log_query_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.query(spark, corpus(spark, sf_dir), "SELECT run, attempt, kind, count(*) AS n FROM events GROUP BY run, attempt, kind")


@query(f"WITH {RUN} SELECT run, attempt, CASE WHEN attempt = 1 THEN 'checkpoint' END AS resumed_from, CASE WHEN k % 4 = 0 AND attempt = 0 THEN CAST(k AS BIGINT) END AS worker, k % 2 = 0 AS loud, CAST(high - 1 AS BIGINT) AS last_step FROM a")
def log_query_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of start and event records, as inferred."""
    sql = """SELECT s.run, s.attempt, s.resumed_from, s.runtime.worker AS worker, e.loud, e.step AS last_step
FROM events s JOIN events e ON s.run = e.run AND s.attempt = e.attempt WHERE s.kind = 'start' AND e.kind = 'event' AND e.name = 'phase'"""
    return reader.query(spark, corpus(spark, sf_dir), sql)


@query(f"WITH {RUN} SELECT run, CAST(CASE WHEN k % 4 = 0 THEN 4 ELSE 0 END AS BIGINT) AS step, 'blob:' || sha256('artifact ' || (k % 10)) AS ref FROM s")
def log_last_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = corpus(spark, sf_dir)
    configs = [{"method": f"m{k % 3}", "seed": k} for k, _ in suppliers(spark, sf_dir)]
    found = [(runlog.run_id(c), runlog.last_blob(root, c, "artifact")) for c in configs]
    return frame(spark, [(r, b.step, b.ref) for r, b in found], "run string, step long, ref string")


@query(f"WITH {RUN} SELECT run, CAST(k % 4 + 1 AS BIGINT) AS size, CAST((k % 4) * (k % 4 + 1) // 2 AS BIGINT) AS total FROM s WHERE k % 5 = 0")
def log_get_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, rows = corpus(spark, sf_dir), []
    for k, _ in suppliers(spark, sf_dir):
        config = {"method": f"m{k % 3}", "seed": k}
        if found := runlog.last_blob(root, config, "array"):
            array = blobs.get(root, found.ref)
            rows.append((runlog.run_id(config), array.size, int(array.sum())))
    return frame(spark, rows, "run string, size long, total long")


NAMED = "SELECT DISTINCT 'blob:' || sha256('artifact ' || (s_suppkey % 10)) AS ref FROM supplier"


@query(f"SELECT ref FROM ({NAMED})")
def log_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = {blobs.put(corpus(spark, sf_dir), np.arange(n + 1, dtype="int32")) for n in range(4)}
    return blobs.reachable(spark, corpus(spark, sf_dir)).filter(~F.col("ref").isin(*arrays))


@query("SELECT 'blob:' || sha256('artifact ' || j) AS ref, CAST(length('artifact ' || j) AS BIGINT) AS length FROM range(10, 15) t(j)")
def log_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the collector would remove, with its size; the arrays are left out, as SQL can't write their files."""
    root = corpus(spark, sf_dir)
    texts = {f"blob:{hashlib.sha256(f'artifact {j}'.encode()).hexdigest()}" for j in range(10, 15)}
    gone = [r for r in blobs.gc(spark, root, dry_run=True, grace_s=-1) if r in texts]
    return blobs.stored(spark, root, content=True).filter(F.col("ref").isin(*gone) & (F.concat(F.lit("blob:"), "sha256") == F.col("ref"))).select("ref", "length")


@query(f"""WITH {RUN} SELECT run, '{{"method":"' || method || '","seed":' || k || '}}' AS canonical, status = 'finished' AS done FROM s""")
def log_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, rows = corpus(spark, sf_dir), []
    for k, _ in suppliers(spark, sf_dir):
        config = {"seed": k, "method": f"m{k % 3}"}
        rid = runlog.run_id(config)
        rows.append((rid, (runlog.run_dir(root, rid) / "run.json").read_text(), runlog.done(root, config)))
    return frame(spark, rows, "run string, canonical string, done boolean")


@query(f"WITH {RUN} SELECT run, attempt, CAST(count(*) + 3 + CASE WHEN seed % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN status <> 'incomplete' AND (attempt = 1 OR seed % 4 <> 0) THEN 1 ELSE 0 END AS BIGINT) AS records FROM m GROUP BY run, attempt, seed, status")
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records of each attempt file: a line cut short is none."""
    root = corpus(spark, sf_dir)
    files = [(rid, runlog.attempt_index(p), len(runlog.records(p))) for rid in reader.run_ids(root) for p in runlog.attempt_paths(runlog.run_dir(root, rid))]
    return frame(spark, files, "run string, attempt int, records long")


def broken(spark: SparkSession, sf_dir: str) -> Path:
    """A corpus of which every run breaks the rule that its number says."""

    def build(root: Path) -> None:
        for k, balance in suppliers(spark, sf_dir):
            config = {"method": f"m{k % 3}", "seed": k}
            run = runlog.init(root, config)
            directory = runlog.run_dir(root, run.rid)
            run.metric("acc", balance, step=1, **({"layer": 1} if k % 10 == 4 else {}))
            if k % 10 == 1:
                run._emit({"kind": "metric", "step": 1, "name": "acc", "value": 0.5})  # the key again
            if k % 10 == 2:
                run._emit({"kind": "metric", "name": "acc", "value": 0.5, "seed": 3})  # a configuration key
            if k % 10 == 3:
                run._emit({"kind": "blob", "name": "lost", "ref": f"blob:{hashlib.sha256(str(k).encode()).hexdigest()}"})
            run.finish()
            (path,) = runlog.attempt_paths(directory)
            if k % 10 == 4:
                path.write_text(path.read_text().replace('"coords":{"layer":"BIGINT"}', '"coords":{}'))
            elif k % 10 == 5:
                path.write_text(path.read_text() + '{"kind":"event","name":"late"}\n')
            elif k % 10 == 6:
                path.rename(directory / "events.01.jsonl")
            elif k % 10 == 7:
                (directory / "run.json").unlink()
            elif k % 10 == 8:
                (directory / "run.json").write_text(f'{{"seed": {k}, "method": "m{k % 3}"}}')
            elif k % 10 == 9:
                path.write_text(path.read_text() + path.read_text().splitlines()[-1] + "\n")

    return made(spark, sf_dir, "broken", build)


@query(f"""WITH {RUN} SELECT 'ERROR' AS level, CASE WHEN k % 10 = 3 THEN '-' ELSE run END AS run, CASE k % 10 WHEN 1 THEN 'attempt 0: 1 repeated metric keys, such as {{"name":"acc","step":"1"}}'
WHEN 2 THEN 'attempt 0: declared  but used seed' WHEN 3 THEN 'dangling blob:' || sha256(CAST(k AS VARCHAR)) WHEN 4 THEN 'attempt 0: declared  but used layer' WHEN 5 THEN 'attempt 0: the status is not the last record'
WHEN 6 THEN 'attempt numbers are not 0, 1, 2, ...' WHEN 7 THEN 'no run.json' WHEN 8 THEN 'run.json is not in canonical form' ELSE 'attempt 0: more than one status' END AS message FROM s WHERE k % 10 > 0
UNION ALL SELECT 'ERROR', run, 'attempt 0: shadows configuration keys: seed' FROM s WHERE k % 10 = 2""")
def log_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.problems(spark, broken(spark, sf_dir))


@query("SELECT 'empty' AS run, 'no run.json' AS message")
def log_verify_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus that the writer made breaks no rule but for the folder that has no run."""
    return verify.problems(spark, corpus(spark, sf_dir), rehash=True).select("run", "message")


def stream_root(spark: SparkSession) -> Path:
    root = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:")) / f"stream-{uuid.uuid4().hex}"
    root.parent.mkdir(parents=True, exist_ok=True)
    return root


KEY = ["o_orderkey"]


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_no FROM orders")
def stream_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended in three commits of two appends each, one rolled back, sealed and read again."""
    from ledgerlake.streaming.record_stream import RecordStream

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(*KEY, "o_custkey")
    n, cuts = orders.count(), [int(x) for x in orders.approxQuantile("o_orderkey", [0.2, 0.4, 0.6, 0.8], 0.01)]
    key = F.col("o_orderkey")
    parts = [orders.filter((key > a) & (key <= b)) for a, b in zip([-1, *cuts], [*cuts, 2**62])]
    stream = RecordStream(stream_root(spark), "orders", {"table": "orders"}, orders.schema, n, shard_rows=4096)
    writer = stream.open(spark, "start")
    writer.append(parts[0], KEY)
    writer.append(parts[1], KEY)
    writer.checkpoint("one")
    writer.append(parts[2], KEY)
    writer.rollback("one")
    writer.retain("one")
    writer = stream.open(spark, "one")
    writer.append(parts[2], KEY)
    writer.append(parts[3], KEY)
    writer.checkpoint("two")
    writer.retain("two")
    writer.append(parts[4], KEY)
    writer.checkpoint("three")
    writer.retain("three")
    writer.finalize("three")
    return stream.open(spark, "three").frame().select(*KEY, "o_custkey", "row_no")


@query("SELECT path, CAST(octet_length(encode(body)) AS BIGINT) AS size, sha256(body) AS digest FROM (SELECT 'nation-' || n_nationkey || '.txt' AS path, n_name || ' ' || n_regionkey AS body FROM nation)")
def published_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sealed publication of a file for each nation, inventoried by the executors."""
    from ledgerlake import storage

    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()  # 25 rows

    def build(folder: Path) -> dict:
        for r in rows:
            (folder / f"nation-{r.n_nationkey}.txt").write_text(f"{r.n_name} {r.n_regionkey}")
        return {"files": len(rows)}

    root = stream_root(spark)
    storage.publish_directory(root, "nations", {"table": "nation"}, build)
    storage.verify_directory(root, "nations", {"table": "nation"})
    return storage.inventory_frame(spark, root).select("path", "size", "digest")


@query("SELECT 's' || r_regionkey AS name, [CAST(r_regionkey + 1 AS BIGINT), 2] AS shape, CAST((r_regionkey + 1) * (2 * r_regionkey + 1) AS DOUBLE) AS total FROM region")
def published_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named arrays published, loaded and summed; shapes from the inventory."""
    from ledgerlake import storage

    keys = [r[0] for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey").collect()]
    root = stream_root(spark)
    storage.publish_arrays(root, {f"s{k}": np.arange(2.0 * (k + 1)).reshape(k + 1, 2) for k in keys}, {"table": "region"})
    total = frame(spark, [(name, float(x.sum())) for name, x in storage.load_arrays(root).items()], "name string, total double")
    return storage.arrays_frame(spark, root).select("name", F.col("shape").cast("array<long>").alias("shape")).join(total, "name")


@query("SELECT CAST(count(*) - 1 AS BIGINT) AS generation, CAST(max(r_regionkey) AS BIGINT) AS step FROM region")
def journal_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal replaced once for each region; the newest value is read back."""
    from ledgerlake import storage

    path = stream_root(spark)
    for n, (k,) in enumerate(spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey").orderBy("r_regionkey").collect()):
        storage.replace_journal(path, "steps", {"table": "region"}, {"step": k}, n - 1)
    found = storage.load_journal(path, "steps", {"table": "region"})
    return frame(spark, [(found.generation, found.value["step"])], "generation long, step long")


@query("SELECT CAST(count(*) AS BIGINT) AS step, CAST(sum(n_regionkey) AS DOUBLE) AS total FROM nation")
def checkpoint_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlake import checkpoints

    keys = np.array([r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_regionkey").collect()], np.float64)
    root = stream_root(spark)
    checkpoints.save_checkpoint(root, {"weights": (keys, None)}, len(keys))
    step, state = checkpoints.restore_checkpoint(root, {"weights": (np.zeros_like(keys), None)})
    return frame(spark, [(step, float(state["weights"][0].sum()))], "step long, total double")


def clean(spark: SparkSession) -> None:
    """Delete the corpora of this session."""
    for key in [k for k in _made if k[0] == spark.sparkContext.applicationId]:
        shutil.rmtree(_made.pop(key), ignore_errors=True)
