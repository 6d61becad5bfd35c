"""Names, configurations, and the run id: the first 16 hex digits of the canonical form's sha256."""

from __future__ import annotations

import hashlib
import json
import math
import re

from ledgerlake.errors import ConfigError

Scalar = str | int | float | bool | None
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")

# Names that records use themselves.
RESERVED = frozenset({"run", "attempt", "kind", "step", "split", "name", "value", "nonfinite", "ref", "status", "time"})
ID_DIGITS = 16


def check_name(name: object, kind: str, error: type[Exception] = ConfigError) -> None:
    if not isinstance(name, str) or not NAME.match(name):
        raise error(f"{kind} {name!r} is not an identifier")
    if name in RESERVED:
        raise error(f"{kind} {name!r} is reserved")


def _scalar(value: object) -> bool:
    return value is None or isinstance(value, (str, bool, int)) or isinstance(value, float) and math.isfinite(value)


def validate(config: object) -> dict:
    """``config`` itself if it is a flat mapping of names to finite scalars or lists of them."""
    if not isinstance(config, dict):
        raise ConfigError("a configuration is a mapping")
    seen: dict[str, str] = {}
    for key, value in config.items():
        check_name(key, "key")
        if (other := seen.setdefault(key.lower(), key)) != key:
            raise ConfigError(f"keys {other!r} and {key!r} differ only in case")
        items = value if isinstance(value, (list, tuple)) else [value]
        if bad := [x for x in items if not _scalar(x)]:
            raise ConfigError(f"{key!r} holds {bad[0]!r}: only finite scalars and lists of them")
    return config


def canonical(config: dict) -> str:
    validate(config)
    return json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def run_id(config: dict) -> str:
    return hashlib.sha256(canonical(config).encode()).hexdigest()[:ID_DIGITS]
