"""Errors of the engine."""


class StrataError(Exception):
    """Base of all errors of the engine."""


class TypeMismatchError(StrataError, TypeError):
    """A row or value doesn't fit its collection or lattice."""


class KeyConstraintError(StrataError):
    """Two different rows of a collection agree on its key."""


class CompileError(StrataError):
    """A program can't be compiled: wrong schema, reference, rule or stratification."""


class IllegalSourceError(StrataError):
    """A source can't be read this way."""


class ShutdownWithCallbacksError(StrataError):
    """A program stopped while a caller waited for its output."""
