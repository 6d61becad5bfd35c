"""The append-only writer: one directory for each run, one JSON-lines file for each attempt."""

from __future__ import annotations

import json
import math
import numbers
import os
import re
import time
import uuid
from dataclasses import dataclass
from pathlib import Path

import numpy as np

from ledgerlake import blobs, provenance
from ledgerlake.errors import AlreadyFinishedError, CollisionError, RecordError
from ledgerlake.identity import canonical, check_name, run_id

TAIL_BYTES = 1 << 16
#: Fields of records that may be absent.
FIELDS = ("kind", "step", "split", "nonfinite")
ATTEMPT = re.compile(r"events\.(\d+)\.jsonl\Z")
#: Types of coordinates as they are declared.
TYPES = {bool: "BOOLEAN", int: "BIGINT", float: "DOUBLE", str: "VARCHAR"}


@dataclass(frozen=True)
class BlobRecord:
    step: int | None
    ref: str


def run_dir(root: str | Path, rid: str) -> Path:
    return Path(root) / "runs" / rid


def attempt_index(path: str | Path) -> int:
    return int(ATTEMPT.search(str(path))[1])


def attempt_paths(directory: str | Path) -> list[Path]:
    """Attempt files in order of their numbers."""
    directory = Path(directory)
    return sorted((p for p in directory.iterdir() if ATTEMPT.fullmatch(p.name)), key=attempt_index) if directory.is_dir() else []


def decode(line: str | bytes) -> dict | None:
    """The object on a line; None for anything else."""
    try:
        out = json.loads(line)
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


def records(path: str | Path) -> list[dict]:
    with open(path, "rb") as f:
        return [x for x in map(decode, f) if x is not None]


def tail_line(path: str | Path) -> str:
    """The last line, read from the end of the file; a truncated one as it is."""
    with open(path, "rb") as f:
        size = f.seek(0, os.SEEK_END)
        f.seek(max(0, size - TAIL_BYTES))
        lines = f.read().splitlines()
    return lines[-1].decode(errors="replace") if lines else ""


def tail_status(path: str | Path) -> dict | None:
    last = decode(tail_line(path))
    return last if last and last.get("kind") == "status" else None


def is_finished(root: str | Path, rid: str) -> bool:
    return any((tail_status(p) or {}).get("status") == "finished" for p in attempt_paths(run_dir(root, rid)))


def done(root: str | Path, config: dict) -> bool:
    """Whether the run of ``config`` needs no further attempt."""
    return is_finished(root, run_id(config))


def blob_records(path: str | Path):
    """Blob records of a file; only lines that can be one are parsed."""
    with open(path, "rb") as f:
        for line in f:
            if b'"kind":"blob"' in line and (x := decode(line)) and x.get("kind") == "blob":
                yield x


def _last_blob(paths: list[Path], name: str) -> BlobRecord | None:
    for path in reversed(paths):
        if found := [x for x in blob_records(path) if x.get("name") == name]:
            return BlobRecord(found[-1].get("step"), found[-1]["ref"])
    return None


def last_blob(root: str | Path, config: dict, name: str) -> BlobRecord | None:
    """The blob of that name logged last (by attempt and line, not by step)."""
    return _last_blob(attempt_paths(run_dir(root, run_id(config))), name)


def widen(old: str | None, new: str, name: str, error: type[Exception] = RecordError) -> str:
    """One type for a coordinate: BIGINT and DOUBLE make DOUBLE, other mixtures are refused."""
    if old in (None, new):
        return new
    if {old, new} == {"BIGINT", "DOUBLE"}:
        return "DOUBLE"
    raise error(f"{name!r} is {old} and {new}")


def plain(value: object) -> object:
    """A numpy (or other) scalar as Python's own."""
    if isinstance(value, (str, bytes, bool, int, float)) or value is None or not hasattr(value, "item"):
        return value
    if getattr(value, "ndim", 0) or getattr(value, "size", 1) != 1:
        raise RecordError("only scalars are logged")
    return value.item()


def present(kind: str, **fields) -> dict:
    """A record's beginning: what has no value is left out."""
    return {"kind": kind} | {k: v for k, v in fields.items() if v is not None}


class Run:
    """One open attempt. Leaving the block finishes it, an exception fails it, close() leaves it incomplete."""

    def __init__(self, root: str | Path, rid: str, attempt: int, handle, config: dict):
        self.root, self.rid, self.attempt = Path(root), rid, attempt
        self._file, self._config = handle, set(config)
        self._folded = {k.lower() for k in config}
        self._pid, self._began, self._types = os.getpid(), time.monotonic(), {}

    def __enter__(self) -> Run:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if not self._file.closed:
            self.finish() if kind is None else self.fail(kind.__name__)

    def __del__(self):
        file = getattr(self, "_file", None)
        if file is not None and not file.closed and getattr(self, "_pid", None) == os.getpid():
            file.close()

    def _emit(self, record: dict) -> None:
        if self._file.closed:
            raise RecordError("the attempt is closed")
        if os.getpid() != self._pid:
            raise RecordError("an attempt has one writer: this process was forked from it")
        try:
            line = json.dumps(record, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        except (TypeError, ValueError) as e:
            raise RecordError(f"not JSON: {e}") from e
        self._file.write(line + "\n")

    def _start(self, runtime: dict | None, resumed_from: str | None) -> None:
        record = {"kind": "start", "time": time.time(), **provenance.collect()}
        if resumed_from is not None:
            record["resumed_from"] = resumed_from
        if runtime is not None:
            record["runtime"] = runtime
        self._emit(record)

    def _extra(self, record: dict, extra: dict) -> dict:
        out = {}
        for key, value in extra.items():
            if key in record or key in FIELDS:
                raise RecordError(f"{key!r} is a field of the record itself")
            check_name(key, "field", RecordError)
            value = plain(value)
            if type(value) not in TYPES or isinstance(value, float) and not math.isfinite(value):
                raise RecordError(f"{key!r} is {value!r}: only finite scalars")
            out[key] = value
        return out

    @staticmethod
    def _core(name: object, step: object, split: object = None) -> object:
        if not isinstance(name, str) or not name:
            raise RecordError("a name is a non-empty string")
        step = plain(step)
        if step is not None and (isinstance(step, bool) or not isinstance(step, int)):
            raise RecordError(f"step {step!r} is not an integer")
        if split is not None and not isinstance(split, str):
            raise RecordError(f"split {split!r} is not a string")
        return step

    def metric(self, name: str, value: object, *, step: int | None = None, split: str | None = None, **coords) -> None:
        value = plain(value)
        if isinstance(value, bool) or not isinstance(value, numbers.Real):
            raise RecordError(f"value {value!r} is not a real number")
        step, value = self._core(name, step, split), float(value)
        record = present("metric", step=step, split=split) | {"name": name, "value": value}
        if not math.isfinite(value):
            record |= {"value": None, "nonfinite": "nan" if math.isnan(value) else "+inf" if value > 0 else "-inf"}
        coords = self._extra(record, coords)
        if clash := [k for k in coords if k.lower() in self._folded]:
            raise RecordError(f"{clash[0]!r} is a key of the configuration")
        types = dict(self._types)
        for key, x in coords.items():
            if other := next((k for k in types if k != key and k.lower() == key.lower()), None):
                raise RecordError(f"coordinates {other!r} and {key!r} differ only in case")
            types[key] = widen(types.get(key), TYPES[type(x)], key)
        self._emit(record | coords)
        self._types = types

    def blob(self, name: str, obj: object, *, step: int | None = None, **meta) -> str:
        step = self._core(name, step)
        record = present("blob", step=step) | {"name": name, "ref": "", "format": blobs.format_of(obj), "bytes": 0}
        if isinstance(obj, np.ndarray):
            record |= {"shape": list(obj.shape), "dtype": str(obj.dtype)}
        meta = self._extra(record, meta)
        ref = blobs.put(self.root, obj)
        self._emit(record | {"ref": ref, "bytes": blobs.get_path(self.root, ref).stat().st_size} | meta)
        return ref

    def event(self, name: str, *, step: int | None = None, **fields) -> None:
        record = present("event", step=self._core(name, step)) | {"name": name}
        self._emit(record | self._extra(record, fields))

    def last_blob(self, name: str) -> BlobRecord | None:
        """From the attempts before this one."""
        return _last_blob([p for p in attempt_paths(run_dir(self.root, self.rid)) if attempt_index(p) < self.attempt], name)

    def close(self) -> None:
        if not self._file.closed:
            self._file.flush()
            os.fsync(self._file.fileno())
            self._file.close()

    def _terminate(self, status: str, exc: str | None = None) -> None:
        record = {"kind": "status", "status": status, **({"exc": exc} if exc else {}), "wall_s": time.monotonic() - self._began, "coords": dict(sorted(self._types.items()))}
        self._emit(record)
        self.close()

    def finish(self) -> None:
        self._terminate("finished")

    def fail(self, exc: str) -> None:
        self._terminate("failed", exc)


def _write_config(directory: Path, text: str) -> None:
    target = directory / "run.json"
    if not target.exists():
        temporary = directory / f".{uuid.uuid4().hex}"
        temporary.write_text(text)
        with temporary.open() as f:
            os.fsync(f.fileno())
        try:
            os.link(temporary, target)  # the first writer wins; others compare
        except FileExistsError:
            pass
        finally:
            temporary.unlink()
    if target.read_bytes() != text.encode():
        raise CollisionError(f"{target} holds another configuration")


def _open_attempt(directory: Path):
    """The lowest free number; exclusive creation decides between writers."""
    n = max((attempt_index(p) for p in attempt_paths(directory)), default=-1) + 1
    while True:
        path = directory / f"events.{n:02d}.jsonl"
        try:
            fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
        except FileExistsError:
            n += 1
            continue
        return n, path, os.fdopen(fd, "w", buffering=1, encoding="utf-8")


def init(root: str | Path, config: dict, *, runtime: dict | None = None, resumed_from: str | None = None, allow_rerun: bool = False) -> Run:
    """Open the next attempt of the run of ``config``."""
    text, rid = canonical(config), run_id(config)
    directory = run_dir(root, rid)
    directory.mkdir(parents=True, exist_ok=True)
    _write_config(directory, text)
    if is_finished(root, rid) and not allow_rerun:
        raise AlreadyFinishedError(f"run {rid} is finished")
    attempt, path, handle = _open_attempt(directory)
    run = Run(root, rid, attempt, handle, config)
    try:
        run._start(runtime, resumed_from)
    except RecordError:
        handle.close()
        path.unlink()
        raise
    return run
