"""Errors of the engine."""


class LedgerError(Exception):
    """Base of all errors."""


class ConfigError(LedgerError):
    """A configuration is not flat, named and finite."""


class CollisionError(LedgerError):
    """A run directory holds another configuration."""


class AlreadyFinishedError(LedgerError):
    """A finished run was opened again."""


class RecordError(LedgerError):
    """A record breaks the rules of its kind."""


class BlobError(LedgerError):
    """A reference is malformed or names nothing."""


class CorpusError(LedgerError):
    """The corpus breaks an invariant that reading needs."""


class StorageError(LedgerError):
    """Stored content is invalid or not what was expected."""
