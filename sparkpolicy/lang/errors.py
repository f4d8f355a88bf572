"""Errors with a place in the policy text."""

from __future__ import annotations


class PolicyError(Exception):
    """Base of all errors of a policy; ``line`` and ``column`` count from 1 where they are known."""

    def __init__(self, message: str, at: tuple[int, int] | None = None) -> None:
        self.message, self.line, self.column = message, *(at or (None, None))
        super().__init__(f"{message} (line {self.line}, column {self.column})" if at else message)

    def to_dict(self) -> dict:
        return {"type": type(self).__name__, "message": self.message, "line": self.line, "column": self.column}


class ScanError(PolicyError):
    """A character that begins no token, or an unfinished string."""


class ParseError(PolicyError):
    """A text that is no policy."""


class CompileError(PolicyError):
    """A policy that breaks a static rule."""


class EvaluationError(PolicyError):
    """Conflicting values and the like."""


class UnsupportedPlan(CompileError):
    """A construct that has no DataFrame plan."""
