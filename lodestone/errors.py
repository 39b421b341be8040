"""The one error type, told apart by its code."""

from __future__ import annotations


class ToolkitError(Exception):
    def __init__(self, code: str, message: str, cause: BaseException | None = None):
        super().__init__(message)
        self.code, self.message = code, message
        self.__cause__ = cause
