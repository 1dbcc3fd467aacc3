"""Exceptions of the engine; every one is a ``VellumError``."""

from __future__ import annotations


class VellumError(Exception):
    pass


class ValidationError(VellumError):
    """A document, id or option is not acceptable."""


class QueryError(ValidationError):
    """A query is not well formed."""


class StorageError(VellumError):
    """Files cannot be read or written."""


class RecoveryError(StorageError):
    """The log cannot be replayed."""


class CorruptionError(StorageError):
    """A stored file does not hold what its metadata says."""


class DatabaseClosedError(VellumError):
    pass


class LockError(StorageError):
    """Another process holds the database."""


def summary(what: str, issues: list[str], most: int = 3) -> str:
    """``what`` and the first few issues."""
    rest = f" (and {len(issues) - most} more)" if len(issues) > most else ""
    return f"{what}: " + "; ".join(issues[:most]) + rest
