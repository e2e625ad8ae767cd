"""Errors.  Analysis reports them as failed metrics; repairs and readers raise them."""

from __future__ import annotations


class TesseraError(Exception):
    pass


class AnalysisError(TesseraError):
    pass


class PreconditionError(AnalysisError):
    """Found from the schema or the arguments, before any job runs."""


class NoSuchColumnError(PreconditionError):
    pass


class WrongTypeError(PreconditionError):
    pass


class IllegalParameterError(PreconditionError):
    pass


class EmptyStateError(AnalysisError):
    """No row was left to compute the metric from."""


class RuntimeAnalysisError(AnalysisError):
    pass


class TransformError(TesseraError):
    """A repair cannot be applied."""

    @staticmethod
    def wrap(error: Exception) -> TransformError:
        return error if isinstance(error, TransformError) else TransformError(f"{type(error).__name__}: {error}")


class InconsistentDependenciesError(TesseraError):
    """The constants of conditional functional dependencies contradict each other."""
