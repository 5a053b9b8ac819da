"""Errors of the engine."""

from __future__ import annotations


class TidemarkError(ValueError):
    pass


class InvalidDefinition(TidemarkError):
    """A feature definition cannot be compiled."""

    def __init__(self, index: int, reason: str):
        super().__init__(f"invalid indicator definition at index {index}: {reason}")
        self.index, self.reason = index, reason


class InvalidEvent(TidemarkError):
    """An input row breaks the event contract."""
