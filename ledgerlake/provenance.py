"""Best-effort facts about where a run happens: a table of probes, of which one that fails gives None."""

from __future__ import annotations

import contextlib
import os
import socket
import subprocess
from collections.abc import Callable, Iterator
from hashlib import sha256
from pathlib import Path

#: Seconds for a command, and the lock files in order of preference.
TIMEOUT_S = 10
LOCKFILES = ("uv.lock", "poetry.lock", "requirements.txt")
#: The commands asked.
COMMIT = ("git", "rev-parse", "HEAD")
CHANGES = ("git", "diff", "HEAD")
GPUS = ("nvidia-smi", "--query-gpu=name", "--format=csv,noheader")


def said(command: tuple[str, ...]) -> str:
    return subprocess.run(command, capture_output=True, text=True, timeout=TIMEOUT_S, check=True).stdout


def digest_of_first(names: tuple[str, ...]) -> str | None:
    there = [p for p in map(Path, names) if p.is_file()]
    return sha256(there[0].read_bytes()).hexdigest() if there else None


#: The fields of a start record; each with its probe and what it is where the probe fails.
PROBES: dict[str, tuple[Callable[[], object], object]] = {
    "git": (lambda: said(COMMIT).strip(), None),
    "dirty": (lambda: (x := said(CHANGES)) and sha256(x.encode()).hexdigest() or None, None),
    "lock": (lambda: digest_of_first(LOCKFILES), None),
    "host": (socket.gethostname, None),
    "gpus": (lambda: [x for line in said(GPUS).split("\n") if (x := line.strip())], []),
    "slurm_job_id": (lambda: os.environ.get("SLURM_JOB_ID"), None),
}
_held: list[dict] = []


def probe(ask: Callable[[], object], otherwise: object) -> object:
    try:
        return ask()
    except (OSError, ValueError, subprocess.SubprocessError):
        return otherwise


def collect() -> dict:
    """All facts, asked anew unless a block ``held`` them."""
    return dict(_held[-1]) if _held else {name: probe(*p) for name, p in PROBES.items()}


@contextlib.contextmanager
def held() -> Iterator[dict]:
    """Ask once for all the runs that are opened inside the block."""
    _held.append(collect())
    try:
        yield _held[-1]
    finally:
        _held.pop()
