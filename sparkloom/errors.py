"""Errors that the engine raises; all are ``SparkloomError``."""


class SparkloomError(Exception):
    pass


class PredicateError(SparkloomError, ValueError):
    """A predicate or projection that can't be meant so."""


class AggregateError(SparkloomError, ValueError):
    """An unknown aggregate, or a column that isn't there."""


class CatalogError(SparkloomError, KeyError):
    """An unknown or already known table, family or index."""


class WriteError(SparkloomError, ValueError):
    """A row that may not be written."""


class LockedError(WriteError):
    """The family is locked while an index is built or dropped."""
