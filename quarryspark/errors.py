"""Errors of the engine, with the status a service would answer with."""

from __future__ import annotations


class EngineError(Exception):
    def __init__(self, message: str, status: int = 400) -> None:
        super().__init__(message)
        self.status = status
