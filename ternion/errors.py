"""Errors of the engine, each with a category, a code and whether trying again may help."""

from __future__ import annotations


class TernionError(Exception):
    category, code, retriable = "internal", 5000, False


class ParseError(TernionError):
    """A query or update that is no SPARQL; says where and, for common mistakes, what to change."""

    category, code = "query", 1000

    def __init__(self, message: str, line: int = 0, column: int = 0, hint: str | None = None):
        super().__init__(f"{message} (line {line}, column {column})" + (f"; {hint}" if hint else ""))
        self.line, self.column, self.hint = line, column, hint


class UnsupportedError(TernionError):
    category, code = "query", 1003


class LimitError(TernionError):
    """A limit on the size or depth of a query, or on the rounds of a fixpoint, was hit."""

    category, code = "query", 1002


class QueryTimeout(TernionError):
    category, code, retriable = "query", 1001, True


class RdfError(TernionError):
    """A document that can't be read as RDF."""

    category, code = "data", 2000


class LoadError(TernionError):
    """A file that is refused: its path, size or format."""

    category, code = "data", 2001


class ReasoningError(TernionError):
    category, code = "reasoning", 4000
