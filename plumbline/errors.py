"""Typed refusals."""

from __future__ import annotations

from typing import Any


class Refusal(Exception):
    """The requested work would be unsafe or ambiguous, so it is not done."""

    def __init__(self, code: str, message: str, **details: Any) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code
        self.message = message
        self.details = details
