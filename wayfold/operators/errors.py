"""Errors with a code and details, as callers of the trajectory API see them."""

from __future__ import annotations


class WayfoldError(Exception):
    def __init__(self, code: str, message: str, **details: object):
        super().__init__(message)
        self.code, self.message, self.details = code, message, details

    def as_dict(self) -> dict:
        return {"error": self.code, "message": self.message, **self.details}
