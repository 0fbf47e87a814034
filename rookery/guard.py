"""Who may ask for what: tenants with their roots and path prefixes.

A policy is a mapping ``{"tenants": {id: {"allowed_roots": [...], "allowed_path_prefixes": [...]}}}``, from JSON or EDN. Nothing is allowed that it does not
name. Path prefixes are optional; where a tenant has some, every request has to name its paths. ``*`` and ``.`` stand for all paths.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Mapping, Sequence

from rookery import errors
from rookery.sources import edn


def load(path: str) -> dict:
    """A policy file, by its ending."""
    if path.endswith(".edn"):
        return edn.read(path)
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def relative(path: str) -> str | None:
    """A relative path in one spelling; none where it is absolute or leaves its root."""
    p = str(path).strip().replace("\\", "/")
    parts = [s for s in p.split("/") if s not in ("", ".")]
    return None if not p or p.startswith("/") or ".." in parts else "/".join(parts) or None


def _below(path: str, prefix: str) -> bool:
    return path == prefix or path.startswith(prefix.rstrip("/") + "/")


def authorize(policy: Mapping | None, tenant: str | None, root: str, paths: Sequence[str] | None = None) -> None:
    """Raises unless the tenant may use the root, and the paths below it. Without a policy all is allowed."""
    if policy is None:
        return
    name = (tenant or "").strip()
    if not name:
        raise errors.InvalidRequest("a tenant is required")
    rules = dict(policy.get("tenants") or {}).get(name)
    if rules is None:
        raise errors.Forbidden(f"tenant {name} is not configured")
    at = posixpath.normpath(root)
    if not any(_below(at, posixpath.normpath(r)) for r in rules.get("allowed_roots") or []):
        raise errors.Forbidden(f"tenant {name} is not allowed for {at}")
    if paths is not None and (isinstance(paths, str) or not isinstance(paths, Sequence)):
        raise errors.InvalidRequest("paths have to be a list of relative paths")
    raw = list(rules.get("allowed_path_prefixes") or [])
    everything = any(str(p).strip() in ("", "*", ".") for p in raw)
    prefixes = [relative(p) for p in raw if str(p).strip() not in ("", "*", ".")]
    if None in prefixes:
        raise errors.Forbidden(f"tenant {name} has a path prefix that is not relative")
    if raw and not paths:
        raise errors.Forbidden(f"tenant {name} has to name its paths")
    asked = [relative(p) for p in paths or []]
    if None in asked:
        raise errors.InvalidRequest("paths have to be relative and stay below the root")
    if raw and not everything and not all(any(_below(p, x) for x in prefixes) for p in asked):
        raise errors.Forbidden(f"tenant {name} is not allowed for one of the paths")
