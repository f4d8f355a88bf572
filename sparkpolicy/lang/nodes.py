"""Syntax tree of a policy. Places don't count in comparisons."""

from __future__ import annotations

from dataclasses import dataclass, field

Place = tuple[int, int]


@dataclass(frozen=True)
class Node:
    at: Place | None = field(default=None, compare=False, kw_only=True, repr=False)


@dataclass(frozen=True)
class Lit(Node):
    value: object  # str, int, float, bool or None


@dataclass(frozen=True)
class Template(Node):
    parts: tuple[Node, ...]  # text parts are Lit


@dataclass(frozen=True)
class Var(Node):
    name: str


@dataclass(frozen=True)
class Ref(Node):
    base: Node
    path: tuple[Node, ...]


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Bin(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Un(Node):
    op: str
    value: Node


@dataclass(frozen=True)
class Arr(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Obj(Node):
    pairs: tuple[tuple[Node, Node], ...]


@dataclass(frozen=True)
class SetOf(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Compr(Node):
    """``kind``: array, set or object; ``key`` is None but for objects."""

    kind: str
    key: Node | None
    value: Node
    body: tuple[Stmt, ...]


@dataclass(frozen=True)
class Every(Node):
    key: str | None
    value: str
    domain: Node
    body: tuple[Stmt, ...]


@dataclass(frozen=True)
class With(Node):
    target: tuple[str, ...]
    value: Node


@dataclass(frozen=True)
class Stmt(Node):
    """One literal of a body: an expression, perhaps negated, or a declaration of variables."""

    expr: Node | None = None
    negated: bool = False
    declares: tuple[str, ...] = ()
    key: Node | None = None
    value: Node | None = None
    domain: Node | None = None
    withs: tuple[With, ...] = ()


@dataclass(frozen=True)
class Rule(Node):
    """``kind``: complete, set, object or function. ``keys`` has a node for each level of an object head."""

    name: str
    kind: str
    args: tuple[Node, ...] = ()
    keys: tuple[Node, ...] = ()
    value: Node | None = None
    body: tuple[Stmt, ...] = ()
    orelse: tuple[tuple[Node, tuple[Stmt, ...]], ...] = ()
    default: bool = False
    nested: bool = False


@dataclass(frozen=True)
class Import(Node):
    path: tuple[str, ...]
    alias: str


@dataclass(frozen=True)
class Module(Node):
    package: tuple[str, ...]
    imports: tuple[Import, ...]
    rules: tuple[Rule, ...]


def children(node: object):
    """The nodes right below a node."""
    if isinstance(node, Node):
        for name in node.__dataclass_fields__:
            if name != "at":
                yield from _flat(getattr(node, name))


def _flat(x: object):
    if isinstance(x, Node):
        yield x
    elif isinstance(x, tuple):
        for y in x:
            yield from _flat(y)


def walk(node: Node):
    yield node
    for c in children(node):
        yield from walk(c)
