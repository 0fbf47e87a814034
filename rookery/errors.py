"""Typed errors with a code, a category and the status an HTTP edge answers with."""

from __future__ import annotations


class RookeryError(Exception):
    code, category, status = "internal_error", "internal", 500

    def payload(self) -> dict:
        return {"code": self.code, "category": self.category, "message": str(self)}


class InvalidRequest(RookeryError):
    code, category, status = "invalid_request", "client", 400


class InvalidQuery(InvalidRequest):
    code = "invalid_query"


class UnsupportedVersion(InvalidRequest):
    code = "unsupported_api_version"


class NotActive(InvalidRequest):
    code, status = "language_not_active", 409


class SnapshotMismatch(RookeryError):
    code, category, status = "snapshot_mismatch", "conflict", 409


class SelectionNotFound(RookeryError):
    code, category, status = "selection_not_found", "not_found", 404


class SelectionEvicted(RookeryError):
    code, category, status = "selection_evicted", "gone", 410


class IndexNotFound(RookeryError):
    code, category, status = "index_not_found", "not_found", 404


class Forbidden(RookeryError):
    code, category, status = "forbidden", "authorization", 403
