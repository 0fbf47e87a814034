"""EDN documents as plain values, and back: keywords and symbols are strings, maps with other keys get their text as key."""

from __future__ import annotations

import json
import re

from rookery.sources.extract import read_forms

_FIXED = {"nil": None, "true": True, "false": False}
_INT, _REAL = re.compile(r"[-+]?\d+N?"), re.compile(r"[-+]?\d+(\.\d*)?([eE][-+]?\d+)?M?")
_ESCAPES = {"\\n": "\n", "\\t": "\t", "\\r": "\r", '\\"': '"', "\\\\": "\\"}


def _value(form):
    if isinstance(form, tuple):
        kind, items = form
        if kind == "{":
            return {k if isinstance(k := _value(a), str) else json.dumps(k): _value(b) for a, b in zip(items[::2], items[1::2])}
        return [_value(x) for x in items] if isinstance(items, list) else _value(items)
    if form in _FIXED:
        return _FIXED[form]
    if form[0] == '"':
        return re.sub(r'\\[ntr"\\]', lambda m: _ESCAPES[m[0]], form[1:-1])
    if _INT.fullmatch(form):
        return int(form.rstrip("N"))
    return float(form.rstrip("M")) if _REAL.fullmatch(form) else form.removeprefix(":")


def loads(text: str):
    """The first value of a document; an empty document is null. Lists, vectors and sets are lists; tags and metadata are left out."""
    forms = [f for f in read_forms(text) if not (isinstance(f, str) and f.startswith("#") and f != "#_")]
    return _value(forms[0]) if forms else None


def dumps(value) -> str:
    """A value as EDN; keys become keywords where they can."""
    if isinstance(value, dict):
        key = lambda k: f":{k}" if re.fullmatch(r"[A-Za-z_][\w./*+!?-]*", k) else json.dumps(k, ensure_ascii=False)
        return "{" + " ".join(f"{key(k)} {dumps(v)}" for k, v in value.items()) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + " ".join(map(dumps, value)) + "]"
    if value is None:
        return "nil"
    return json.dumps(value, ensure_ascii=False) if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else repr(value)


def read(path: str):
    with open(path, encoding="utf-8") as f:
        return loads(f.read())
