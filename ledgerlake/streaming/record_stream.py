"""A restartable, exactly-once record stream of a registered length, sealed as equal Parquet shards.

Committed segments are listed in a two-slot journal beside the data, with the size and sha256 of every file; a segment that no
checkpoint lists is dropped at the next opening, and one that is not as listed is refused. ``sink`` makes a Structured Streaming query append to one.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ledgerlake.blobs import file_digest
from ledgerlake.errors import StorageError
from ledgerlake.storage import load_journal, partial_of, publication_exists, replace_journal, seal, sync, verify_directory

SHARD_ROWS, BATCH_ROWS = 65_536, 2_048
STATE = "ledgerlake.stream-state.v2"
ROW = "row_no"
SEGMENT = re.compile(r"segment-(\d{6})\Z")


def numbered(df: DataFrame, order: list[str], folder: Path | None = None) -> DataFrame:
    """``df`` with row_no from 0 in the given order, without one task seeing all rows.

    Range partitions are sorted; each row's number is its place in its partition plus the sizes of those before. With a
    ``folder`` the sorted rows are written there once and numbered as they are read; without, both uses share one exchange.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    local = parts.withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33))
    if folder is not None:
        local.write.mode("overwrite").parquet(str(folder))
        local = df.sparkSession.read.schema(local.schema).parquet(str(folder))
    sizes = local.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before.select("_p", "_b")), "_p").withColumn(ROW, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


@dataclass(frozen=True)
class Checkpoint:
    """``files``: (path below the stream, bytes, sha256) of all committed files, in order."""

    identity: str
    segments: tuple[str, ...]
    rows: int
    files: tuple[tuple[str, int, str], ...] = ()


@dataclass(frozen=True)
class RecordStream:
    """The immutable description: where, what, which schema, and how many rows in all."""

    root: Path
    format_name: str
    identity: dict[str, str]
    schema: T.StructType
    rows: int
    shard_rows: int = SHARD_ROWS

    def __post_init__(self):
        if not Path(self.root).is_absolute() or not self.format_name or not self.format_name.isascii() or self.rows <= 0:
            raise StorageError("a stream has an absolute root, an ASCII format and rows")
        names = [f.name.lower() for f in self.schema.fields]
        if not names or len(set(names)) != len(names) or ROW in names:
            raise StorageError("columns have different names, none of them row_no")

    @property
    def pending(self) -> Path:
        return partial_of(self.root)

    @property
    def _known(self) -> dict[str, str]:
        spec = json.dumps([self.identity, self.schema.json(), self.rows, self.shard_rows], sort_keys=True)
        return {**self.identity, "specification": hashlib.sha256(spec.encode()).hexdigest()}

    @property
    def _journal(self) -> Path:
        return Path(self.root).parent / f"{Path(self.root).name}.state"

    def state(self) -> tuple[int, list[Checkpoint]]:
        """Generation and the current checkpoint, with its predecessor while that is kept."""
        found = load_journal(self._journal, STATE, self._known)
        if found is None:
            return -1, []
        return found.generation, [Checkpoint(x["identity"], tuple(x["segments"]), x["rows"], tuple((f["path"], f["size"], f["digest"]) for f in x["files"])) for x in found.value["checkpoints"]]

    def promote(self, generation: int, checkpoints: list[Checkpoint]) -> int:
        files = lambda c: [dict(zip(("path", "size", "digest"), f)) for f in c.files]
        value = {"checkpoints": [{"identity": c.identity, "segments": list(c.segments), "rows": c.rows, "files": files(c)} for c in checkpoints]}
        return replace_journal(self._journal, STATE, self._known, value, generation).generation

    def check_history(self, kept: list[Checkpoint]) -> None:
        """Counts and names of the checkpoints agree, and the one before is the beginning of the current one."""
        for c in kept:
            if not 0 <= c.rows <= self.rows or [n for n, s in enumerate(c.segments) if s != f"segment-{n:06d}"] or {Path(f[0]).parts[0] for f in c.files} != set(c.segments):
                raise StorageError(f"{self.root}: checkpoint {c.identity!r} is inconsistent")
        for old, new in zip(kept, kept[1:]):
            if old.identity == new.identity or old.rows > new.rows or new.segments[: len(old.segments)] != old.segments or new.files[: len(old.files)] != old.files:
                raise StorageError(f"{self.root}: {new.identity!r} does not follow {old.identity!r}")

    def check_files(self, spark: SparkSession, kept: list[Checkpoint]) -> None:
        """Every committed file is as listed (hashed by the executors), and its rows are numbered without a gap."""
        current = kept[-1]
        if not current.files:
            return
        root = str(self.pending)

        def differ(batches):
            for b in batches:
                for path, size, digest in zip(b["path"], b["size"], b["digest"]):
                    file = Path(root) / path
                    if not file.is_file() or file.stat().st_size != size or file_digest(str(file)) != digest:
                        yield b[b["path"] == path][["path"]]

        listed = spark.createDataFrame([*current.files], "path string, size long, digest string")
        if wrong := listed.repartition(min(len(current.files), 256)).mapInPandas(differ, "path string").limit(3).collect():
            raise StorageError(f"{self.root}: files differ from the checkpoint: {', '.join(r.path for r in wrong)}")
        for c in kept:
            if c.segments:
                found = spark.read.parquet(*[f"{root}/{s}" for s in c.segments]).agg(F.count("*"), F.min(ROW), F.max(ROW), F.count_distinct(ROW)).first()
                if tuple(found) != (c.rows, 0, c.rows - 1, c.rows):
                    raise StorageError(f"{self.root}: the rows of {c.identity!r} are not those committed")

    def open(self, spark: SparkSession, checkpoint: str) -> StreamWriter:
        """A writer at ``checkpoint``; after a crash, in whatever state the folders are."""
        self.root.parent.mkdir(parents=True, exist_ok=True)
        final, partial = publication_exists(self.root), publication_exists(self.pending)
        generation, kept = self.state()
        if final and partial:
            raise StorageError(f"{self.root} and {self.pending} both exist")
        if partial and (self.pending / "manifest.json").exists():
            verify_directory(self.pending, self.format_name, self._known)
            os.rename(self.pending, self.root)
            final, partial = True, False
        if final:
            verify_directory(self.root, self.format_name, self._known)
            if not kept or kept[-1].identity != checkpoint:
                raise StorageError(f"{self.root} is final at another checkpoint than {checkpoint!r}")
        elif not kept:
            if partial:
                shutil.rmtree(self.pending)
            self.pending.mkdir()
            kept = [Checkpoint(checkpoint, (), 0)]
            generation = self.promote(generation, kept)
        elif not partial:
            raise StorageError(f"{self.pending} is missing")
        else:
            self.check_history(kept)
            self.check_files(spark, kept)
        writer = StreamWriter(spark, self, generation, kept, final)
        if not final:
            writer.rollback(checkpoint)
        return writer


class StreamWriter:
    def __init__(self, spark: SparkSession, stream: RecordStream, generation: int, kept: list[Checkpoint], final: bool):
        self.spark, self.stream, self._generation, self._kept, self.final = spark, stream, generation, kept, final
        self._staged: list[tuple[str, int]] = []  # folders and rows of appends since the checkpoint

    @property
    def current(self) -> Checkpoint:
        return self._kept[-1]

    @property
    def committed_rows(self) -> int:
        return self.current.rows

    @property
    def rows(self) -> int:
        return self.current.rows + sum(n for _, n in self._staged)

    @property
    def checkpoint_identity(self) -> str:
        return self.current.identity

    def _writable(self) -> None:
        if self.final:
            raise StorageError("the stream is final")

    def _sweep(self) -> None:
        named = {s for c in self._kept for s in c.segments}
        for p in self.stream.pending.iterdir():
            if p.name not in named:
                if not (SEGMENT.match(p.name) or p.name.startswith("stage") or p.name in ("shards", "sorted")):
                    raise StorageError(f"{p} is none of the stream's files")
                shutil.rmtree(p)
        self._staged = []

    def append(self, df: DataFrame, order: list[str]) -> int:
        """Stage the rows of ``df``, in the given order, after those before; any number of times a checkpoint. Returns their count."""
        self._writable()
        plain = lambda s: [(f.name, f.dataType, f.metadata) for f in s.fields]
        if plain(df.schema) != plain(self.stream.schema):
            raise StorageError(f"the schema is {df.schema.simpleString()}")
        stage, once = self.stream.pending / f"stage-{len(self._staged):06d}", self.stream.pending / "sorted"
        try:
            numbered(df, order, once).withColumn(ROW, F.col(ROW) + self.rows).write.mode("overwrite").parquet(str(stage))
        finally:
            shutil.rmtree(once, ignore_errors=True)
        n = self.spark.read.parquet(str(stage)).count()
        if not n or self.rows + n > self.stream.rows:
            shutil.rmtree(stage)
            raise StorageError(f"{self.rows + n} rows; {self.stream.rows} are registered" if n else "nothing was appended")
        self._staged.append((stage.name, n))
        return n

    def checkpoint(self, identity: str) -> None:
        """Commit what is staged under a new name; the checkpoint before stays as a way back until retain()."""
        self._writable()
        if len(self._kept) > 1:
            raise StorageError("retain or roll back the last checkpoint first")
        if identity == self.current.identity or not identity:
            raise StorageError(f"a checkpoint needs a new name, not {identity!r}")
        segments, files, rows = self.current.segments, self.current.files, self.rows
        for stage, _ in self._staged:
            name = f"segment-{len(segments):06d}"
            folder = self.stream.pending / name
            os.rename(self.stream.pending / stage, folder)
            made = sorted(folder.glob("part-*.parquet"))
            for p in [*made, folder]:
                sync(p)
            segments = (*segments, name)
            files += tuple((f"{name}/{p.name}", p.stat().st_size, file_digest(str(p))) for p in made)
        sync(self.stream.pending)
        new = [self.current, Checkpoint(identity, segments, rows, files)]
        self._generation = self.stream.promote(self._generation, new)
        self._kept, self._staged = new, []

    def rollback(self, identity: str) -> None:
        """Back to the current checkpoint (drops what is staged) or the one before it."""
        self._writable()
        if identity not in [c.identity for c in self._kept]:
            raise StorageError(f"no checkpoint {identity!r}")
        if identity != self.current.identity:
            self._kept = self._kept[:1]
            self._generation = self.stream.promote(self._generation, self._kept)
        self._sweep()

    def retain(self, identity: str) -> None:
        """Give up the way back behind the current checkpoint."""
        self._writable()
        if identity != self.current.identity:
            raise StorageError(f"the current checkpoint is {self.current.identity!r}")
        if len(self._kept) > 1:
            self._kept = self._kept[-1:]
            self._generation = self.stream.promote(self._generation, self._kept)

    def frame(self, identity: str | None = None) -> DataFrame:
        """The rows committed at a checkpoint, with row_no."""
        at = next((c for c in self._kept if c.identity == (identity or self.checkpoint_identity)), None)
        if at is None:
            raise StorageError(f"no checkpoint {identity!r}")
        if self.final:
            return self.spark.read.parquet(f"{self.stream.root}/shard-*.parquet")
        if not at.segments:
            return self.spark.createDataFrame([], T.StructType([*self.stream.schema.fields, T.StructField(ROW, T.LongType())]))
        return self.spark.read.parquet(*[str(self.stream.pending / s) for s in at.segments])

    def batches(self, identity: str | None = None, rows: int = BATCH_ROWS):
        """Arrow batches of at most ``rows`` rows committed at a checkpoint, in order, without row_no."""
        at = next((c for c in self._kept if c.identity == (identity or self.checkpoint_identity)), None)
        if at is None:
            raise StorageError(f"no checkpoint {identity!r}")
        paths = sorted(self.stream.root.glob("shard-*.parquet")) if self.final else [self.stream.pending / f[0] for f in at.files]
        n = 0
        for path in paths:
            for batch in pq.ParquetFile(path).iter_batches(rows):
                number = batch.column(ROW).to_numpy()
                if len(number) and (number[0] != n or (np.diff(number) != 1).any()):
                    raise StorageError(f"{path}: rows are out of order")
                n += len(number)
                yield batch.drop_columns([ROW])
        if n != at.rows:
            raise StorageError(f"{n} of {at.rows} rows are there")

    def finalize(self, identity: str):
        """Compact to shards of equal size, the same whatever the segments were, and seal."""
        self._writable()
        if self._staged or identity != self.checkpoint_identity:
            raise StorageError("finalize at the current checkpoint with nothing staged")
        if self.committed_rows != self.stream.rows:
            raise StorageError(f"{self.committed_rows} of {self.stream.rows} rows are there")
        s = self.stream
        count = -(-s.rows // s.shard_rows)
        rows = self.frame().withColumn("shard", F.expr(f"{ROW} div {s.shard_rows}"))
        out = s.pending / "shards"
        rows.repartition(count, "shard").sortWithinPartitions("shard", ROW).write.mode("overwrite").partitionBy("shard").parquet(str(out))
        for k in range(count):
            (made,) = (out / f"shard={k}").glob("*.parquet")
            os.rename(made, s.pending / f"shard-{k:06d}.parquet")
        for p in list(s.pending.iterdir()):
            if p.is_dir():
                shutil.rmtree(p)
        manifest = seal(s.pending, s.root, s.format_name, s._known, {"rows": s.rows, "shards": count})
        self.final = True
        return manifest


def sink(stream: RecordStream, spark: SparkSession, order: list[str], start: str = "start") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch becomes a checkpoint named by its number; a repeated batch changes nothing."""
    def put(df: DataFrame, batch: int) -> None:
        _, kept = stream.state()
        writer = stream.open(spark, kept[-1].identity if kept else start)
        name = f"batch-{batch}"
        done = re.fullmatch(r"batch-(\d+)", writer.checkpoint_identity)
        if done and int(done[1]) >= batch:
            return
        writer.retain(writer.checkpoint_identity)
        if not df.isEmpty():
            writer.append(df, order)
        writer.checkpoint(name)

    return put

