"""Document values: what policies compute with on the driver.

Strings, integers and floats are Python's. The rest are immutable and hashable, so that sets and object keys
may hold any value: booleans are :data:`TRUE` and :data:`FALSE` (apart from 1 and 0), null is
:data:`NULL`, arrays are tuples, sets frozensets and objects :class:`Doc`. Undefined has no value at all.
"""

from __future__ import annotations

import json
import math


class _Named:
    def __init__(self, name: str) -> None:
        self.name = name

    def __repr__(self) -> str:
        return self.name

    def __reduce__(self):
        return _named, (self.name,)


TRUE, FALSE, NULL = _Named("true"), _Named("false"), _Named("null")
_NAMES = {"true": TRUE, "false": FALSE, "null": NULL}


def _named(name: str) -> _Named:
    return _NAMES[name]


class Doc(dict):
    """An object; it is never changed once made."""

    def __hash__(self) -> int:
        return hash(frozenset(self.items()))


def boolean(x: bool) -> object:
    return TRUE if x else FALSE


def is_number(x: object) -> bool:
    return type(x) in (int, float)


def truthy(x: object) -> bool:
    return x is not FALSE and x is not NULL


def value(x: object) -> object:
    """A document value from Python data; raises ``TypeError`` for what has no counterpart."""
    if x is None or x is NULL:
        return NULL
    if isinstance(x, bool):
        return boolean(x)
    if isinstance(x, (str, int, float, _Named)):
        return x
    if isinstance(x, dict):
        out = Doc((value(k), value(v)) for k, v in x.items())
        if len(out) != len(x):
            raise ValueError("keys of an object collide")
        return out
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    if isinstance(x, (set, frozenset)):
        return frozenset(map(value, x))
    raise TypeError(f"{type(x).__name__} is no document value")


def python(x: object) -> object:
    """Python data from a document value; a set becomes a set where its members allow, else a list."""
    if x is TRUE or x is FALSE:
        return x is TRUE
    if x is NULL:
        return None
    if isinstance(x, Doc):
        return {k if isinstance(k, str) else _key(k): python(v) for k, v in x.items()}
    if isinstance(x, tuple):
        return [python(v) for v in x]
    if isinstance(x, frozenset):
        items = [python(v) for v in sorted(x, key=order)]
        try:
            return set(items)
        except TypeError:
            return items
    return x


def _key(k: object) -> object:
    found = python(k)
    return found if isinstance(found, (str, int, float, bool, type(None))) else text(k)


def kind(x: object) -> str:
    if x is TRUE or x is FALSE:
        return "boolean"
    if x is NULL:
        return "null"
    for name, types in (("string", str), ("number", (int, float)), ("array", tuple), ("object", Doc), ("set", frozenset)):
        if isinstance(x, types):
            return name
    raise TypeError(type(x).__name__)


_RANK = ("null", "boolean", "number", "string", "array", "object", "set")


def order(x: object) -> tuple:
    """A sort key over all values: by type, then by value."""
    k = kind(x)
    if k == "boolean":
        own: object = x is TRUE
    elif k == "array":
        own = [order(v) for v in x]
    elif k == "object":
        own = sorted((order(a), order(b)) for a, b in x.items())
    elif k == "set":
        own = sorted(map(order, x))
    else:
        own = 0 if k == "null" else x.encode() if k == "string" else x
    return _RANK.index(k), own


def number_text(x: float) -> str:
    """A number as the text that casts and templates show."""
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        return {math.inf: "Infinity", -math.inf: "-Infinity"}.get(x, "NaN")
    shown = repr(x)
    if "e" not in shown:
        return shown
    head, power = shown.split("e")
    return f"{head if '.' in head else head + '.0'}e{int(power):+03d}"


def text(x: object) -> str:
    """A value in a template: strings bare, collections as JSON in canonical order."""
    if isinstance(x, str):
        return x
    return number_text(x) if is_number(x) else json.dumps(plain(x), ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def plain(x: object) -> object:
    """JSON data: sets become sorted lists."""
    if isinstance(x, frozenset):
        return [plain(v) for v in sorted(x, key=order)]
    if isinstance(x, tuple):
        return [plain(v) for v in x]
    if isinstance(x, Doc):
        return {k if isinstance(k, str) else text(k): plain(v) for k, v in x.items()}
    return python(x)
