"""The one exception of the library: a code that a caller can branch on, and a message."""

from __future__ import annotations


class QueryError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
