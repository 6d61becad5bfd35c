"""Column forms of the engine's small functions; all run on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerlake.identity import RESERVED

REF = "blob:[0-9a-f]{64}"


def is_name(name: Column) -> Column:
    """An identifier that isn't reserved."""
    return name.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~name.isin(*sorted(RESERVED))


def is_ref(ref: Column) -> Column:
    return ref.rlike(f"^{REF}$")


def blob_path(ref: Column) -> Column:
    return F.concat_ws("/", F.lit("blobs"), F.substring(ref, 6, 2), F.substring(ref, 8, 62))


def refs_in(text: Column, pattern: str = REF) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)


def nonfinite_tag(value: Column) -> tuple[Column, Column]:
    """value (null unless finite) and nonfinite (nan, +inf, -inf or null)."""
    tag = F.when(F.isnan(value), "nan").when(value == float("inf"), "+inf").when(value == float("-inf"), "-inf")
    return F.when(tag.isNull(), value).alias("value"), tag.alias("nonfinite")


def attempt_of(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"events\.(\d+)\.jsonl$", 1).cast("int")


def run_of(file_path: Column) -> Column:
    return F.regexp_extract(file_path, r"([^/]+)/[^/]+$", 1)


def run_id_of(canonical: Column) -> Column:
    return F.substring(F.sha2(canonical.cast("binary"), 256), 1, 16)
