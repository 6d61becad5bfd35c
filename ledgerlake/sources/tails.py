"""Spark data sources: the tails of attempt files, and numbered lines."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES_PER_TASK, ROWS, FEW = 256, 32_768, 20_000


class Paths(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TailReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [Paths(self.paths[i : i + FILES_PER_TASK]) for i in range(0, len(self.paths), FILES_PER_TASK)] or [Paths([])]

    def read(self, partition):
        from ledgerlake.runlog import tail_line

        for path in partition.paths:
            yield path, tail_line(path)


class Tails(DataSource):
    """path, tail: the last line of each file, at most 64 KiB read of each. Option ``paths``: a JSON list."""

    @classmethod
    def name(cls) -> str:
        return "runlog_tail"

    def schema(self) -> str:
        return "path string, tail string"

    def reader(self, schema) -> TailReader:
        return TailReader(json.loads(self.options["paths"]))


def line_batches(path: str, size: int = 8 << 20):
    """Arrow batches (path, line_no, line) of a file, read ``size`` bytes at a time; bytes that are no UTF-8 are replaced."""
    n, rest = 0, b""
    with open(path, "rb") as f:
        while part := f.read(size):
            whole, found, tail = (rest + part).rpartition(b"\n")
            rest = tail if found else whole + tail
            if found:
                yield batch(path, n, whole.split(b"\n"))
                n += whole.count(b"\n") + 1
    if rest:
        yield batch(path, n, [rest])


def batch(path: str, n: int, lines: list[bytes]) -> pa.RecordBatch:
    try:
        text = pa.array(lines, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        text = pa.array([x.decode(errors="replace") for x in lines], pa.string())
    return pa.RecordBatch.from_arrays([pa.array([path], pa.string()).take(pa.array(np.zeros(len(lines), np.int32))), pa.array(np.arange(n, n + len(lines))), text], ["path", "line_no", "line"])


class LineReader(TailReader):
    def partitions(self):
        step = max(1, min(FILES_PER_TASK, len(self.paths) // 16))
        return [Paths(self.paths[i : i + step]) for i in range(0, len(self.paths), step)] or [Paths([])]

    def read(self, partition):
        held, rows = [], 0
        for path in partition.paths:
            for b in line_batches(path):
                held, rows = [*held, b], rows + b.num_rows
                if rows >= ROWS:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class Lines(DataSource):
    """path, line_no, line: DataFrames have no order, so each line carries its number. Arrow batches, no Python row."""

    @classmethod
    def name(cls) -> str:
        return "runlog_lines"

    def schema(self) -> str:
        return "path string, line_no long, line string"

    def reader(self, schema) -> LineReader:
        return LineReader(json.loads(self.options["paths"]))


def load(spark: SparkSession, source: type[DataSource], paths: list[str]):
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("paths", json.dumps(list(map(str, paths)))).load()


def last_lines(spark: SparkSession, paths: list[str]) -> list[tuple[str, str]]:
    """path and last line of each file: by threads of the driver for ``FEW`` files at most, else by the executors."""
    from ledgerlake.runlog import tail_line

    if len(paths) > FEW:
        return [(r.path, r.tail) for r in load(spark, Tails, paths).collect()]
    with ThreadPoolExecutor(16) as pool:
        return list(zip(paths, pool.map(tail_line, paths)))
