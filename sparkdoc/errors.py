"""Errors with the codes that clients act on."""

from __future__ import annotations


class StoreError(Exception):
    """``code`` names the error; ``outcome`` is ``not_applied`` or ``unknown``; extras such as current_version are attributes."""

    code = "internal"

    def __init__(self, message: str, code: str | None = None, outcome: str = "not_applied", **extra: object) -> None:
        super().__init__(message)
        self.code, self.outcome = code or self.code, outcome
        self.__dict__.update(extra)


class FilterError(StoreError):
    code = "invalid_filter"


class ArgumentError(StoreError):
    code = "invalid_argument"


class SortUnavailable(StoreError):
    code = "sort_unavailable"


class ConditionFailed(StoreError):
    code = "condition_failed"


class MutationIdReused(StoreError):
    code = "mutation_id_reused"
