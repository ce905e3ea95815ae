"""Errors as values: a code, a message and perhaps the file that it is about."""

from __future__ import annotations


class AnalysisError(ValueError):
    """An error of a query. Its codes are part of what the queries promise."""

    def __init__(self, code: str, message: str, file_path: str | None = None):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.file_path = code, message, file_path

    def as_dict(self) -> dict:
        out = {"code": self.code, "message": self.message}
        return out | {"filePath": self.file_path} if self.file_path else out


class SyncError(AnalysisError):
    """A failed synchronisation, with the phase it failed in. The graph before it stays."""

    def __init__(self, phase: str, cause: BaseException):
        super().__init__("scan_failed", f"{phase}: {chain(cause)}")
        self.phase = phase


def chain(error: BaseException | None) -> str:
    """``Type: message --> Type: message`` of an error and what caused it."""
    parts = []
    while error is not None:
        parts.append(f"{type(error).__name__}: {error}")
        error = error.__cause__ or error.__context__
    return " --> ".join(parts)
