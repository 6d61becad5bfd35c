"""The corpus's own description, made from the constants that the code uses."""

from __future__ import annotations

from pathlib import Path

from ledgerlake.identity import RESERVED
from ledgerlake.plans.reader import CORE

CANONICAL = {
    "points of one metric": "SELECT run, step, value FROM metrics WHERE name = 'acc' AND step = (SELECT max(step) FROM metrics WHERE name = 'acc')",
    "mean and standard error": "SELECT step, avg(value) AS y, stddev_samp(value) / sqrt(count(*)) AS yerr, count(*) AS n FROM metrics WHERE name = 'acc' GROUP BY step ORDER BY step",
    "best value for each configuration": "SELECT * EXCEPT (run, attempt, step, split, name, value, nonfinite), max(value) AS best FROM metrics GROUP BY ALL",
    "values that are not finite": "SELECT DISTINCT run, name FROM metrics WHERE nonfinite IS NOT NULL",
    "runs that aren't finished": "SELECT run, status FROM runs WHERE status <> 'finished'",
}


def render() -> str:
    pinned = "\n".join(f"- `{f.name}` {f.dataType.simpleString()}" for f in CORE.fields)
    queries = "\n".join(f"{k}:\n\n    {v}\n" for k, v in CANONICAL.items())
    return f"""# Corpus

    runs/<run>/run.json              the configuration, canonical JSON; <run> is its sha256's first 16 digits
    runs/<run>/events.<NN>.jsonl     one attempt, one JSON object a line, append only
    blobs/<2 hex>/<62 hex>           bytes named by their sha256

Kinds of record: start, metric, blob, event, status. A finished attempt's last line is its status, which
declares the types of the coordinates that its metrics use.

Pinned fields of a metric, besides run and attempt (any other field is a coordinate):

{pinned}

Names that coordinates and configuration keys can't have: {", ".join(sorted(RESERVED))}.

Views for SQL: `metrics` (deduplicated, all runs, with configuration), `runs` (configuration and status),
`events` (all records).

{queries}"""


def write(path: str | Path) -> Path:
    Path(path).write_text(render())
    return Path(path)


write_schema = write
