"""Experiment-log analytics on Spark: run logs, tidy metrics, blobs, publications, record streams.

    ref = ledgerlake.put(root, array)
    with ledgerlake.init(root, {"method": "m", "seed": 0}) as run:
        run.metric("acc", 0.42, step=200, split="test")
    frame = ledgerlake.load(spark, root, names=["acc"])
    ledgerlake.aggregate(frame, over="seed", x="step", by="method")
"""

from importlib import import_module

__version__ = "0.1.0"

#: Where each public name is; modules are imported when first used.
_PLACES = {
    "errors": ("AlreadyFinishedError", "BlobError", "CollisionError", "ConfigError", "CorpusError", "LedgerError", "RecordError", "StorageError"),
    "identity": ("RESERVED", "canonical", "run_id"),
    "runlog": ("BlobRecord", "Run", "done", "init", "last_blob"),
    "blobs": ("gc", "get", "get_path", "put", "reachable"),
    "plans.reader": ("RunInfo", "census", "coords_of", "discover", "info", "load", "query", "scan", "status_of"),
    "operators.aggregate": ("aggregate",),
    "plans.verify": ("Problem", "verify"),
    "schema_doc": ("write_schema",),
    "session": ("session",),
    "streaming.record_stream": ("RecordStream", "sink"),
}
_MODULE = {name: module for module, names in _PLACES.items() for name in names}
__all__ = sorted([*_MODULE, "storage"])


def __getattr__(name: str):
    if name == "storage":
        return import_module("ledgerlake.storage")
    if name not in _MODULE:
        raise AttributeError(f"module 'ledgerlake' has no attribute {name!r}")
    return getattr(import_module(f"ledgerlake.{_MODULE[name]}"), name)
