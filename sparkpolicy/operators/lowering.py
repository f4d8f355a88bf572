"""From a policy to DataFrame plans.

A body is a relation of bindings. Where it only reads its input row, it becomes Column expressions, with
higher-order functions for the arrays it ranges over (:class:`RowBody`). Where it ranges over tables, it
becomes joins: a table in a ``some`` is a cross join whose conditions Catalyst turns into an equi-join, a
membership a semi-join, a negation or an ``every`` over a table an anti-join, and a comprehension that an
aggregate reads a grouping on the variables it shares with its surroundings (:class:`Relation`).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import COLUMNS, text
from ..functions.documents import BUILTINS
from ..lang.errors import CompileError, UnsupportedPlan
from ..lang.nodes import Arr, Bin, Call, Compr, Every, Lit, Node, Obj, Ref, Rule, SetOf, Stmt, Template, Un, Var, With, children, walk
from ..plans.analysis import Compiled, arranged, binds, bound, dotted, pattern_vars, reads
from ..sources.catalog import Catalog
from .terms import (
    NUMBERS, UNDEFINED, VARIANT, WHOLE, Cell, Collection, Deferred, Fields, Items, Null, Term, Undefined, as_kind, as_members, boolean,
    cell, conjunction, constant, defined, equal, from_variant, integer, kind, known, mapping, only_if_defined, opened, row, set_operation, solid,
    truthy, variant, widest,
)

_numbers = itertools.count(1)


class NeedsRelation(Exception):
    """A row plan met a table."""


class Outer(Exception):
    """A subquery's expression mixes its own columns with its surroundings'."""


class Open(Term):
    """A declared variable without a value yet."""


@dataclass(frozen=True)
class DataRoot(Term):
    """``data``, or what is below it that is neither a table, a document nor a rule."""

    path: tuple[str, ...] = ()


@dataclass(frozen=True, eq=False)
class World:
    """What a body is planned against: the policy, its documents, and overrides."""

    compiled: Compiled
    catalog: Catalog
    spark: SparkSession
    input: Term = UNDEFINED
    placed: tuple[tuple[tuple[str, ...], Term], ...] = ()
    renamed: dict[str, str | Term] = field(default_factory=dict)
    columns: dict = field(default_factory=lambda: dict(COLUMNS))


@dataclass(frozen=True, eq=False)
class Scope:
    vars: dict[str, Term]
    world: World

    def bind(self, **terms: Term) -> Scope:
        return replace(self, vars={**self.vars, **terms})

    def opened(self, body: tuple[Stmt, ...]) -> Scope:
        new = dict(self.vars)
        for s in body:
            plain = isinstance(s.expr, Bin) and s.expr.op == "="
            for n in binds(s):
                if not plain or n not in new and n not in self.world.compiled.names() and n not in self.world.compiled.imports:
                    new[n] = Open()
        return replace(self, vars=new)


class Planner:
    """Expressions to terms; what a context can't do row by row it does by joins or refuses."""

    # -- what contexts differ in
    def aggregate(self, t: Term, name: str) -> Term:
        raise NeedsRelation

    def contains(self, x: Term, t: Collection) -> Term:
        raise NeedsRelation

    def single(self, name: str, scope: Scope) -> Term:
        raise NeedsRelation

    def uncorrelated(self, t: Term) -> Collection:
        raise NeedsRelation

    def settled(self, t: Term) -> Term:
        raise NeedsRelation

    # -- expressions
    def term(self, node: Node, scope: Scope) -> Term:
        if isinstance(node, Lit):
            return constant(node.value)
        if isinstance(node, Var):
            return self.name(node.name, scope)
        if isinstance(node, Ref):
            return self.reference(node, scope)
        if isinstance(node, Call):
            return self.call(node, scope)
        if isinstance(node, Bin):
            return self.binary(node, scope)
        if isinstance(node, Un):
            if node.op == "not":
                p = truthy(t := self.term(node.value, scope))
                return known(False) if p is None else boolean(~F.coalesce(p, F.lit(False)), t)
            c = as_kind(self.term(node.value, scope), "number")
            return UNDEFINED if c is None else cell(c.type, c, col=-c.col)
        if isinstance(node, (Arr, SetOf)):
            items = tuple(self.term(x, scope) for x in node.items)
            return UNDEFINED if any(isinstance(x, Undefined) for x in items) else Items(items, isinstance(node, SetOf))
        if isinstance(node, Obj):
            return self.object(node, scope)
        if isinstance(node, Template):
            parts = [text(self.term(p, scope)) for p in node.parts]
            if any(p is None for p in parts):
                raise UnsupportedPlan("a template shows a value without a text form", node.at)
            used = [self.term(p, scope) for p in node.parts]
            return cell(T.StringType(), *used, col=F.concat(F.lit(""), *(F.coalesce(p, F.lit("<undefined>")) for p in parts)))
        if isinstance(node, Compr):
            return self.comprehension(node, scope)
        if isinstance(node, Every):
            p = self.every(node, scope)
            return known(True) if p is None else boolean(F.when(p, F.lit(True)))
        raise UnsupportedPlan(f"{type(node).__name__} has no plan", node.at)

    def name(self, name: str, scope: Scope) -> Term:
        if name in scope.vars:
            found = scope.vars[name]
            return UNDEFINED if isinstance(found, Open) else found
        w = scope.world
        if name == "input":
            return w.input
        if name == "data":
            return DataRoot()
        if name in w.compiled.imports:
            path = w.compiled.imports[name]
            return self.reference(Ref(Var(path[0]), tuple(map(Lit, path[1:]))), Scope({}, w))
        return self.rule(name, w) if name in w.compiled.names() else UNDEFINED

    def object(self, node: Obj, scope: Scope) -> Term:
        pairs = [(self.term(k, scope), self.term(x, scope)) for k, x in node.pairs]
        if any(isinstance(y, Undefined) for p in pairs for y in p):
            return UNDEFINED
        if all(isinstance(k, Cell) and isinstance(k.const, str) for k, _ in pairs):
            return Fields({k.const: x for k, x in pairs})
        keys, values = solid(Items(tuple(k for k, _ in pairs))), solid(Items(tuple(x for _, x in pairs)))
        if keys is None or values is None or isinstance(keys.type.elementType, (T.VariantType, T.ArrayType, T.MapType, T.StructType)):
            raise UnsupportedPlan("an object of mixed keys or values has no column form", node.at)
        return cell(T.MapType(keys.type.elementType, values.type.elementType), keys, values, col=F.map_from_arrays(keys.col, values.col))

    def reference(self, node: Ref, scope: Scope) -> Term:
        t = self.term(node.base, scope)
        for key in node.path:
            t = self.step(t, self.term(key, scope) if not isinstance(key, Lit) else constant(key.value), scope)
            if isinstance(t, Undefined):
                break
        return t

    def step(self, t: Term, key: Term, scope: Scope) -> Term:
        if isinstance(t, DataRoot):
            return self.data(t, key, scope)
        if isinstance(t, (Undefined, Null)) or isinstance(key, Undefined):
            return UNDEFINED
        if isinstance(t, (Collection, Deferred)):
            return self.lookup(t, key)
        if isinstance(t, Cell) and isinstance(t.type, T.StructType):
            t = opened(t)
        if isinstance(t, Fields):
            if isinstance(key, Cell) and key.const is not None:
                return t.fields.get(key.const, UNDEFINED) if isinstance(key.const, str) else UNDEFINED
            return by_name(t, key)
        if isinstance(t, Items) and not t.is_set and isinstance(key, Cell) and isinstance(key.const, int) and not isinstance(key.const, bool):
            return t.items[key.const] if -len(t.items) <= key.const < len(t.items) else UNDEFINED
        if isinstance(t, Items) and (t := solid(t)) is None:
            raise UnsupportedPlan("a set of mixed values has no column form")
        if not isinstance(t, Cell):
            raise UnsupportedPlan("a key of such a value has no plan")
        if isinstance(t.type, T.MapType):
            k = as_kind(key, kind(Cell(t.col, t.type.keyType)))
            return UNDEFINED if k is None else cell(t.type.valueType, t, key, col=F.try_element_at(t.col, k.col))
        if isinstance(t.type, T.ArrayType) and t.is_set:
            k = solid(key)
            if k is None:
                raise UnsupportedPlan("a member of such a set has no column form")
            return cell(k.type, t, key, col=F.when(F.exists(t.col, lambda e: F.coalesce(equal(Cell(e, t.type.elementType), k).col, F.lit(False))), k.col))
        if isinstance(t.type, T.ArrayType):
            return at_index(t, key)
        if isinstance(t.type, T.VariantType):
            if isinstance(key, Cell) and isinstance(key.const, str) and "'" not in key.const and "\\" not in key.const:
                return cell(VARIANT, t, col=F.try_variant_get(t.col, f"$['{key.const}']", "variant"))
            found = [at_index(from_variant(t, "array"), key)]
            if (name := as_kind(key, "string")) is not None:
                found.append(cell(VARIANT, t, key, col=F.try_element_at(from_variant(t, "object").col, name.col)))
            cells = [c for c in found if isinstance(c, Cell)]
            return cell(VARIANT, t, key, col=F.coalesce(*(c.col for c in cells))) if cells else UNDEFINED
        return UNDEFINED

    def lookup(self, t: Term, key: Term) -> Term:
        """The value under a key of a table or rule."""
        raise NeedsRelation

    def data(self, t: DataRoot, key: Term, scope: Scope) -> Term:
        if not isinstance(key, Cell) or not isinstance(key.const, str):
            raise UnsupportedPlan("a key under data must be written out")
        path, w = (*t.path, key.const), scope.world
        for place, x in reversed(w.placed):
            if place == path:
                return x
        at = w.compiled.rule_of(path)
        if at and at[1] == len(path):
            return self.rule(at[0], w)
        if len(path) == 1 and path[0] in w.catalog.tables:
            df = w.catalog.tables[path[0]]
            index = w.catalog.indexes.get(path[0])
            return Collection(df, row(df), "array", key=row(df).fields[index] if index else None)
        lead = w.compiled.package[: len(path)] == path or any(p[: len(path)] == path for p, _ in w.placed)
        found = w.catalog.document_at(path)
        if found is not None and not lead:
            return constant(found)
        return DataRoot(path) if lead or found is not None else UNDEFINED

    def binary(self, node: Bin, scope: Scope) -> Term:
        op = node.op
        if op in (":=", "="):
            raise UnsupportedPlan("an assignment inside of an expression has no plan", node.at)
        a, b = self.term(node.left, scope), self.term(node.right, scope)
        if op in ("and", "or"):
            x, y = self.kleene(a), self.kleene(b)
            return boolean(x & y if op == "and" else x | y, a, b)
        if op == "in":
            return self.member(a, b)
        return scalar(op, a, b)

    @staticmethod
    def kleene(t: Term) -> Column:
        """Truthiness with NULL for undefined."""
        if isinstance(t, Undefined):
            return F.lit(None).cast("boolean")
        p = truthy(t)
        if p is None:
            return F.lit(True)
        return p if isinstance(t, (Cell, Null)) and (isinstance(t, Null) or isinstance(t.type, T.BooleanType)) else F.when(p, F.lit(True))

    def member(self, x: Term, of: Term) -> Term:
        if isinstance(x, Undefined) or isinstance(of, Undefined):
            return UNDEFINED
        if isinstance(of, (Collection, Deferred)):
            return self.contains(x, of)
        if isinstance(of, Fields) and not of.row:
            return self.member(x, Items(tuple(constant(k) for k in of.fields)))
        if isinstance(of, Fields) or isinstance(of, Cell) and isinstance(of.type, T.StructType):  # an absent key is NULL
            keys = w_keys(of)
            k = as_kind(x, "string")
            return boolean(only_if_defined(F.lit(False), x, of), x, of) if k is None else boolean(only_if_defined(F.coalesce(F.array_contains(keys.col, k.col), F.lit(False)), x, of), x, of)
        if isinstance(of, Items):
            same = [kind(i) == kind(x) for i in of.items]
            if isinstance(x, Cell) and all(isinstance(i, Cell) and i.const is not None for i in of.items):
                fit = [i.const for i, s in zip(of.items, same, strict=True) if s]
                return boolean(x.col.isin(fit) if fit else only_if_defined(F.lit(False), x), x)
            parts = [equal(i, x) for i in of.items]
            out = None
            for p in parts:
                c = F.coalesce(p.col, F.lit(False))
                out = c if out is None else out | c
            return boolean(only_if_defined(F.lit(False) if out is None else out, x, of), x, of)
        if not isinstance(of, Cell):
            return UNDEFINED
        if isinstance(of.type, T.VariantType):
            a, o = from_variant(of, "array"), from_variant(of, "object")
            inside = F.exists(a.col, lambda e: F.coalesce(equal(Cell(e, VARIANT), x).col, F.lit(False)))
            k = as_kind(x, "string")
            keyed = F.lit(False) if k is None else F.coalesce(F.map_contains_key(o.col, k.col), F.lit(False))
            return boolean(only_if_defined(F.when(a.col.isNotNull(), inside).when(o.col.isNotNull(), keyed), x), x, of)
        if isinstance(of.type, T.MapType):
            c = as_kind(x, kind(Cell(of.col, of.type.keyType)))
            return boolean(only_if_defined(F.lit(False), x, of), x, of) if c is None else boolean(only_if_defined(F.coalesce(F.map_contains_key(of.col, c.col), F.lit(False)), x, of), x, of)
        if isinstance(of.type, T.ArrayType):
            c = solid(x)
            if c is not None and c.type == of.type.elementType and not isinstance(c.type, (T.VariantType, T.StructType, T.MapType)):
                return boolean(only_if_defined(F.exists(of.col, lambda e: e.eqNullSafe(c.col)), x), x, of)
            if c is not None and kind(c) != kind(Cell(of.col, of.type.elementType)) and None not in (kind(c), kind(Cell(of.col, of.type.elementType))):
                return boolean(only_if_defined(F.lit(False), x, of), x, of)
            inside = F.exists(of.col, lambda e: F.coalesce(equal(Cell(e, of.type.elementType), x).col, F.lit(False)))
            return boolean(only_if_defined(inside, x, of), x, of)
        return UNDEFINED

    # -- calls
    def call(self, node: Call, scope: Scope) -> Term:
        return self.apply(node.name, tuple(self.argument(a, scope) for a in node.args), scope.world, node)

    def argument(self, node: Node, scope: Scope) -> Term:
        return self.term(node, scope)

    def apply(self, name: str, args: tuple[Term, ...], w: World, node: Node) -> Term:
        user = function_name(name, w.compiled)
        for n in (name, user):
            if n in w.renamed:
                other = w.renamed[n]
                rest = replace(w, renamed={k: x for k, x in w.renamed.items() if k != n})
                return other if isinstance(other, Term) else self.apply(other, args, rest, node)
        if any(isinstance(a, Undefined) for a in args):
            return UNDEFINED
        if user:
            return self.inline(user, args, w, node)
        if name not in w.columns or name in BUILTINS and len(args) not in BUILTINS[name][0]:
            return UNDEFINED
        if any(isinstance(a, (Collection, Deferred)) for a in args):
            return self.over_tables(name, args, w, node)
        return w.columns[name](*args)

    def over_tables(self, name: str, args: tuple[Term, ...], w: World, node: Node) -> Term:
        if len(args) == 1 and name in ("count", "sum", "max", "min", "all", "any"):
            return self.aggregate(args[0], name)
        if len(args) == 1 and (name == "type_name" or name.startswith("is_")):
            return constant(kind(args[0])) if name == "type_name" else known(name == f"is_{kind(args[0])}")
        try:
            cs = [self.uncorrelated(a) if isinstance(a, (Collection, Deferred)) else a for a in args]
        except Outer:  # it shares variables with its surroundings
            return w.columns[name](*(self.settled(a) for a in args))
        first = cs[0]
        if name in ("set", "cast_set") and len(cs) == 1:
            return distinct_set(first)
        if name == "cast_array" and first.kind != "object":
            return replace(first, kind="array", df=distinct_set(first).df, key=None) if first.kind == "set" else first
        if name == "cast_object" and first.kind == "object":
            return first
        if name == "object.keys" and first.kind == "object" and isinstance(first.key, Cell):
            keys = first.df.select(first.key.col.alias("value"))
            return Collection(keys, Cell(F.col("value"), first.key.type, frozenset(["value"])), "set")
        if name == "object.get" and first.kind == "object" and len(cs) == 3:
            return COLUMNS["object.get"](Fields({"k": self.lookup(first, cs[1])}, row=True), constant("k"), cs[2])
        if name == "sort" and first.kind == "array":
            return replace(first, order="asc")
        if name == "array.reverse" and first.order:
            return replace(first, order="desc" if first.order == "asc" else "asc")
        if name == "array.slice" and first.order and all(isinstance(a, Cell) and isinstance(a.const, int) for a in cs[1:]):
            lo, hi = max(cs[1].const, 0), max(cs[2].const, 0)
            value = solid(first.value)
            by = value.col.asc() if first.order == "asc" else value.col.desc()
            df = first.df.where(value.col.isNotNull()).orderBy(by).limit(hi)
            return replace(first, df=df.offset(lo) if lo else df)
        if name in ("union", "intersection", "set_diff") and all(isinstance(c, Collection) and c.kind == "set" for c in cs):
            a, b = (single_column(c) for c in cs)
            type_ = widest([a.value.type, b.value.type])
            x, y = (c.df.select(c.value.col.cast(type_).alias("value")) for c in (a, b))
            df = {"union": lambda: x.union(y).distinct(), "intersection": lambda: x.intersect(y), "set_diff": lambda: x.subtract(y)}[name]()
            return Collection(df, Cell(F.col("value"), type_, frozenset(["value"])), "set")
        if name == "array.concat":
            a, b = (single_column(c) for c in cs)
            type_ = widest([a.value.type, b.value.type])
            df = a.df.select(a.value.col.cast(type_).alias("value")).union(b.df.select(b.value.col.cast(type_).alias("value")))
            return Collection(df, Cell(F.col("value"), type_, frozenset(["value"])), "array")
        return w.columns[name](*(self.settled(a) for a in args))  # over the collected value

    def inline(self, name: str, args: tuple[Term, ...], w: World, node: Node) -> Term:
        """A user function, expanded in place."""
        if any(isinstance(a, (Collection, Deferred)) for a in args):
            return self.inline_tables(name, args, w, node)
        options = []
        for r in w.compiled.rules.get(name, ()):
            if len(r.args) != len(args):
                return UNDEFINED
            scope, guards = Scope({n: Open() for a in r.args for n in pattern_vars(a)}, w), []
            for p, a in zip(r.args, args, strict=True):
                scope, more = unify(self, p, a, scope)
                guards += more
            options.append((r, scope, guards))
        return choose(name, [clause(r, scope, guards) for r, scope, guards in options], w)

    def inline_tables(self, name: str, args: tuple[Term, ...], w: World, node: Node) -> Term:
        raise NeedsRelation

    def rule(self, name: str, w: World) -> Term:
        if isinstance(w.renamed.get(name), Term):
            return w.renamed[name]
        k = w.compiled.kind(name)
        if k == "function":
            return UNDEFINED
        if k == "complete":
            try:
                return choose(name, [clause(r, Scope({}, w), []) for r in w.compiled.rules.get(name, ())], w)
            except NeedsRelation:
                found = collection_rule(name, w)
                return found if found is not None else self.single(name, Scope({}, w))
        if k == "set":
            try:
                return row_set(name, w)
            except NeedsRelation:
                return set_rule(name, w)
        try:
            return row_object(name, w)
        except NeedsRelation:
            return object_rule(name, w)

    def comprehension(self, node: Compr, scope: Scope) -> Term:
        if ranges_over_tables(node.body, scope):
            return Deferred(node, scope)
        b = RowBody(node.body, scope)
        if node.kind == "object":
            return b.mapping(node.key, node.value)
        return b.array(node.value, node.kind == "set")

    def every(self, node: Every, scope: Scope) -> Column | None:
        """Whether all elements of an array, set, map or written-out domain satisfy the body."""
        domain = self.term(node.domain, scope)
        if isinstance(domain, (Collection, Deferred)):
            raise NeedsRelation
        if isinstance(domain, Undefined) or node.key is not None and kind(domain) == "set" or kind(domain) in ("number", "string", "boolean", "null", "extension"):
            return F.lit(False)
        pairs, kt, vt = entries_of(domain, node.key is not None)
        bind = lambda e: {node.value: Cell(e["value"], vt, domain.uses), **({node.key: Cell(e["key"], kt, domain.uses)} if node.key else {})}
        holds = lambda e: F.lit(True) if (p := RowBody(node.body, scope.bind(**bind(e))).exists()) is None else F.coalesce(p, F.lit(False))
        return F.forall(pairs, holds)


def w_keys(t: Term) -> Cell:
    """The keys of a row or struct that are present."""
    return COLUMNS["object.keys"](t)


def by_name(t: Fields, key: Term) -> Term:
    """The field whose name is a column: of one type if all fields have it, else a variant."""
    name = as_kind(key, "string")
    if name is None or not t.fields:
        return UNDEFINED
    cells = {k: solid(x) for k, x in t.fields.items()}
    if any(c is None for c in cells.values()) or len({(kind(c), c.is_set, c.type.simpleString() if kind(c) in ("array", "object", "set") else "") for c in cells.values()}) > 1:
        cells = {k: variant(x) for k, x in t.fields.items()}
        if any(c is None for c in cells.values()):
            raise UnsupportedPlan("fields of such types have no column form together")
    type_ = widest([c.type for c in cells.values()])
    found = F.lit(None).cast(type_)
    for k, c in cells.items():
        found = F.when(name.col == k, c.col.cast(type_)).otherwise(found)
    return cell(type_, t, key, col=found, is_set=next(iter(cells.values())).is_set)


def at_index(t: Cell, key: Term) -> Term:
    """The element of an array at an index, from the end if it is negative."""
    k = integer(key)
    if k is None:
        return UNDEFINED
    at = F.lit(k.const + (k.const >= 0)) if k.const is not None else F.when(k.col < 0, k.col).otherwise(k.col + 1)
    return cell(t.type.elementType, t, key, col=F.try_element_at(t.col, at.cast("int")))


def entries_of(t: Term, keyed: bool) -> tuple[Column, T.DataType, T.DataType]:
    """An array of (key, value) structs of what a value ranges over, and the types of both. The keys of a variant are variants."""
    pair = lambda k, x: F.struct(k.alias("key"), x.alias("value"))
    if isinstance(t, Fields) or isinstance(t, Cell) and isinstance(t.type, T.StructType):
        t = mapping(t)
        if t is None:
            raise UnsupportedPlan("an object of such values has no column form")
    c = solid(t)
    if c is None:
        raise UnsupportedPlan("a set of mixed values has no column form")
    if isinstance(c.type, T.ArrayType):
        if c.is_set:
            return F.transform(c.col, lambda x: pair(x, x)), c.type.elementType, c.type.elementType
        return F.transform(c.col, lambda x, i: pair(i.cast("long"), x)), T.LongType(), c.type.elementType
    if isinstance(c.type, T.MapType):
        return F.map_entries(c.col), c.type.keyType, c.type.valueType
    if isinstance(c.type, T.VariantType):
        listed = F.transform(from_variant(c, "array").col, lambda x, i: pair(i.cast("long").cast("variant"), x))
        named = F.transform(F.map_entries(from_variant(c, "object").col), lambda e: pair(e["key"].cast("variant"), e["value"]))
        return F.coalesce(listed, named), VARIANT, VARIANT
    raise UnsupportedPlan("what is ranged over has no plan")


def function_name(name: str, c: Compiled) -> str | None:
    parts = tuple(name.split("."))
    if parts[0] in c.imports:
        parts = (*c.imports[parts[0]], *parts[1:])
    if parts[0] == "data":
        at = c.rule_of(parts[1:])
        return at[0] if at and at[1] == len(parts) - 1 and c.kind(at[0]) == "function" else None
    return name if name in c.names() and c.kind(name) == "function" else None


def scalar(op: str, a: Term, b: Term) -> Term:
    """Comparison and arithmetic."""
    if op in ("==", "!="):
        same = equal(a, b)
        if isinstance(same, Undefined) or op == "==":
            return same
        if isinstance(a, Cell) and isinstance(b, Cell) and kind(a) == kind(b) is not None and not isinstance(a.type, (T.MapType,)):
            return boolean(a.col != b.col, a, b)
        return known(not same.const) if same.const is not None else boolean(~same.col, a, b)
    for k in ("number", "string", "extension"):
        if kind(a) == k or kind(b) == k:
            x, y = as_kind(a, k), as_kind(b, k)
            break
    else:
        if kind(a) is None and kind(b) is None:
            x, y, k = as_kind(a, "number"), as_kind(b, "number"), "number"
        else:
            return UNDEFINED
    if x is None or y is None:
        return UNDEFINED
    if op in ("<", "<=", ">", ">="):
        return boolean({"<": x.col < y.col, "<=": x.col <= y.col, ">": x.col > y.col, ">=": x.col >= y.col}[op], a, b)
    if k != "number":
        return UNDEFINED
    whole = isinstance(x.type, WHOLE) and isinstance(y.type, WHOLE)
    if not whole:
        type_ = T.DoubleType()
        p, q = x.col.cast("double"), y.col.cast("double")
        made = {"+": lambda: p + q, "-": lambda: p - q, "*": lambda: p * q, "/": lambda: F.try_divide(p, q), "%": lambda: floored(p, q)}[op]()
        return cell(type_, a, b, col=made)
    p, q = x.col.cast("long"), y.col.cast("long")
    if op in "+-*":
        return cell(T.LongType(), a, b, col={"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](p, q))
    if op == "%":
        return cell(T.LongType(), a, b, col=floored(p, q))
    return cell(T.LongType(), a, b, col=F.call_function("div", p - floored(p, q), F.nullif(q, F.lit(0).cast("long"))))


def floored(p: Column, q: Column) -> Column:
    """The remainder with the divisor's sign; NULL for a divisor of zero."""
    n = F.nullif(q, F.lit(0))
    return (p % n + n) % n


def unify(planner: Planner, pattern: Node, t: Term, scope: Scope) -> tuple[Scope, list[Column]]:
    """The scope with a pattern's variables bound, and the conditions under which it matches."""
    if isinstance(t, Undefined):
        return scope, [F.lit(False)]
    if isinstance(pattern, Var) and pattern.name == "_":
        return scope, [d] if (d := defined(t)) is not None else []
    if isinstance(pattern, Var) and isinstance(scope.vars.get(pattern.name), Open):
        return scope.bind(**{pattern.name: t}), [d] if (d := defined(t)) is not None else []
    if isinstance(pattern, Arr):
        if isinstance(t, Items) and not t.is_set:
            if len(t.items) != len(pattern.items):
                return scope, [F.lit(False)]
            parts, guards = list(t.items), []
        elif isinstance(t, Cell) and kind(t) in ("array", None):
            c = as_kind(t, "array")
            guards = [F.coalesce(F.size(c.col) == len(pattern.items), F.lit(False))]
            parts = [cell(c.type.elementType, t, col=F.get(c.col, F.lit(i))) for i in range(len(pattern.items))]
        else:
            return scope, [F.lit(False)]
    elif isinstance(pattern, Obj):
        if any(is_open(k, scope) for k, _ in pattern.pairs):
            raise UnsupportedPlan("an object pattern that enumerates keys has no plan", pattern.at)
        keys = [constant(k.value) if isinstance(k, Lit) else planner.term(k, scope) for k, _ in pattern.pairs]
        if any(isinstance(k, Undefined) for k in keys) or kind(t) not in ("object", None) or not isinstance(t, (Fields, Cell)):
            return scope, [F.lit(False)]
        names = [k.const if isinstance(k, Cell) else None for k in keys]
        if isinstance(t, Fields) and not t.row and None not in names:
            if set(t.fields) != set(names):
                return scope, [F.lit(False)]
            parts, guards = [t.fields[n] for n in names], []
        elif None not in names and (isinstance(t, Fields) or isinstance(t.type, T.StructType)):  # absent keys are NULL
            fields = (t if isinstance(t, Fields) else opened(t)).fields
            if not set(names) <= set(fields):
                return scope, [F.lit(False)]
            held = [d if n in names else ~d for n, x in fields.items() if (d := defined(x)) is not None]
            if any(defined(x) is None for n, x in fields.items() if n not in names):
                return scope, [F.lit(False)]
            parts, guards = [fields[n] for n in names], [*held, *([d] if (d := defined(t)) is not None else [])]
        else:
            m = mapping(t)
            if m is None:
                raise UnsupportedPlan("an object of such values has no column form", pattern.at)
            found = [as_kind(k, kind(Cell(m.col, m.type.keyType))) for k in keys]
            if None in found:
                return scope, [F.lit(False)]
            distinct = F.size(F.array_distinct(F.array(*(k.col for k in found)))) if found else F.lit(0)
            guards = [F.coalesce((F.size(m.col) == len(keys)) & (distinct == len(keys)), F.lit(False)), *(F.coalesce(F.map_contains_key(m.col, k.col), F.lit(False)) for k in found)]
            if kind(t) is None and None not in names:  # read by path, not from the map
                parts = [planner.step(t, k, scope) for k in keys]
            else:
                parts = [cell(m.type.valueType, t, k, col=F.try_element_at(m.col, k.col)) for k in found]
        pattern = Arr(tuple(x for _, x in pattern.pairs))
    else:
        p = truthy(equal(planner.term(pattern, scope), t))
        return scope, [] if p is None else [p]
    for p, x in zip(pattern.items, parts, strict=True):
        scope, more = unify(planner, p, x, scope)
        guards += more
    return scope, guards


def is_open(node: Node, scope: Scope) -> bool:
    return isinstance(node, Var) and node.name == "_" or any(isinstance(scope.vars.get(n), Open) for n in pattern_vars(node))


def open_keys(node: Node, scope: Scope) -> int | None:
    """The first step of a reference that enumerates."""
    if not isinstance(node, Ref):
        return None
    return next((i for i, k in enumerate(node.path) if isinstance(k, Var) and (k.name == "_" or isinstance(scope.vars.get(k.name), Open))), None)


def ranges_over_tables(body: tuple[Stmt, ...], scope: Scope) -> bool:
    """Whether a body takes rows from a table, seen by planning its domains."""
    try:
        RowBody(body, scope).guard_only()
    except NeedsRelation:
        return True
    except Outer:
        return True
    return False


def overridden(s: Stmt, planner: Planner, scope: Scope) -> Scope | None:
    """The scope of a literal under its ``with`` clauses; None if an override is undefined."""
    w = scope.world
    for x in s.withs:
        w = override(x, planner, replace(scope, world=w), w)
        if w is None:
            return None
    return replace(scope, world=w)


def override(x: With, planner: Planner, scope: Scope, w: World) -> World | None:
    name, other = ".".join(x.target), dotted(x.value)
    target = function_name(name, w.compiled) or (name if name in BUILTINS else None)
    if target and other and (function_name(other, w.compiled) or other in BUILTINS):
        return replace(w, renamed={**w.renamed, target: other})
    t = planner.term(x.value, scope)
    if isinstance(t, Undefined):
        return None
    if target:
        return replace(w, renamed={**w.renamed, target: t})
    if x.target[0] == "input":
        return replace(w, input=placed(w.input, x.target[1:], t))
    if x.target[0] == "data":
        at = w.compiled.rule_of(x.target[1:])
        if at and at[1] == len(x.target) - 1:
            return replace(w, renamed={**w.renamed, at[0]: t})
        return replace(w, placed=(*w.placed, (x.target[1:], t)))
    raise CompileError(f"with can't override {name}", x.at)


def placed(base: Term, path: tuple[str, ...], x: Term) -> Term:
    if not path:
        return x
    if isinstance(base, Cell) and isinstance(base.type, T.StructType):
        base = Fields({n: cell(base.type[n].dataType, base, col=base.col[n]) for n in base.type.names}, row=True)
    fields = base.fields if isinstance(base, Fields) else {}
    return Fields({**fields, path[0]: placed(fields.get(path[0], UNDEFINED), path[1:], x)}, row=True)


# -- row plans


class RowBody(Planner):
    """A body over one row, as Column expressions."""

    def __init__(self, body: tuple[Stmt, ...], scope: Scope) -> None:
        have = {n for n, t in scope.vars.items() if not isinstance(t, Open)}
        self.body = arranged(body, have, set())
        self.scope = scope.opened(body)

    def lead(self, body: tuple[Stmt, ...], scope: Scope) -> tuple[list[Column], Scope, tuple | None]:
        """Conditions and bindings up to the first generator, and the generator with what follows it."""
        guards: list[Column] = []
        for i, s in enumerate(body):
            if s.withs:
                inner = overridden(s, self, scope)
                if inner is None:
                    return [F.lit(False)], scope, None
                found = RowBody((replace(s, withs=()),), replace(inner, vars={k: t for k, t in scope.vars.items()}))
                more, after, gen = found.lead(found.body, replace(scope, world=inner.world))
                guards += more
                scope = replace(after, world=scope.world)
                if gen is not None:
                    domain, key, value, rest = gen
                    return guards, scope, (domain, key, value, (*(replace(x, withs=s.withs) for x in rest), *body[i + 1 :]))
                continue
            if s.domain is not None:
                return guards, scope, (self.term(s.domain, scope), s.key, s.value, body[i + 1 :])
            if s.expr is None:
                continue
            e = s.expr
            if s.negated:
                guards.append(self.absent(e, scope))
                continue
            if isinstance(e, Bin) and e.op in (":=", "="):
                left, right = (e.left, e.right) if e.op == ":=" or is_open(e.left, scope) or not is_open(e.right, scope) else (e.right, e.left)
                if (n := open_keys(right, scope)) is not None or (n := open_keys(left, scope)) is not None and e.op == "=":
                    ref, other = (right, left) if open_keys(right, scope) is not None else (left, right)
                    name = f"__{next(_numbers)}"
                    gen = self.term(Ref(ref.base, ref.path[:n]) if n else ref.base, scope)
                    tail = Ref(Var(name), ref.path[n + 1 :]) if ref.path[n + 1 :] else Var(name)
                    return guards, scope.bind(**{name: Open()}), (gen, ref.path[n], Var(name), (Stmt(expr=Bin("=", other, tail)), *body[i + 1 :]))
                scope, more = unify(self, left, self.term(right, scope), scope)
                guards += more
                continue
            if (n := open_keys(e, scope)) is not None:
                name = f"__{next(_numbers)}"
                gen = self.term(Ref(e.base, e.path[:n]) if n else e.base, scope)
                tail = Ref(Var(name), e.path[n + 1 :]) if e.path[n + 1 :] else Var(name)
                return guards, scope.bind(**{name: Open()}), (gen, e.path[n], Var(name), (Stmt(expr=tail), *body[i + 1 :]))
            lifted = lift(s, scope)
            if lifted:
                return self._joined(guards, scope, (*lifted, *body[i + 1 :]))
            p = self.every(e, scope) if isinstance(e, Every) else truthy(self.term(e, scope))
            if p is not None:
                guards.append(p)
        return guards, scope, None

    def _joined(self, guards: list[Column], scope: Scope, body: tuple[Stmt, ...]) -> tuple:
        more, scope, gen = self.lead(body, scope.opened(body[:-1]))
        return guards + more, scope, gen

    def absent(self, e: Node, scope: Scope) -> Column:
        """Where an expression has no truthy value."""
        if any(open_keys(n, scope) is not None for n in walk(e)):
            p = RowBody((Stmt(expr=e),), scope).exists()
            return ~F.coalesce(p, F.lit(False))
        p = truthy(self.term(e, scope))
        return F.lit(False) if p is None else ~p | p.isNull()

    def guard_only(self) -> None:
        """Plan the body without a use of it."""
        self.results(self.body, self.scope, lambda _: F.lit(1))

    def elements(self, t: Term, keyed: bool) -> tuple[Column, T.DataType, T.DataType]:
        """An array of (key, value) structs of what a generator ranges over."""
        if isinstance(t, (Collection, Deferred)):
            raise NeedsRelation
        if kind(t) in ("number", "string", "boolean", "null", "extension") or kind(t) == "set" and keyed:
            return F.slice(F.array(F.struct(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("value"))), 1, 0), T.LongType(), T.LongType()
        return entries_of(t, keyed)

    def results(self, body: tuple[Stmt, ...], scope: Scope, head) -> tuple[Column | None, Column, bool]:
        """The condition that holds before any generator, the head's column, and whether that is an array of results."""
        guards, inner, gen = self.lead(body, scope)
        if gen is None:
            return conjunction(guards), head(inner), False
        domain, key, value, rest = gen
        if isinstance(domain, Undefined):
            return F.lit(False), F.array(head_type_probe(head, inner)), True
        pairs, kt, vt = self.elements(domain, key is not None and not (isinstance(key, Var) and key.name == "_"))
        uses = domain.uses

        def at(e: Column) -> tuple[Column | None, Column, bool]:
            s, conds = unify(self, value, Cell(e["value"], vt, uses), inner)
            if key is not None:
                s, more = unify(self, key, Cell(e["key"], kt, uses), s)
                conds += more
            guard, col, many = self.results(rest, s, head)
            return conjunction([*conds, *([guard] if guard is not None else [])]), col, many

        held = F.filter(pairs, lambda e: F.lit(True) if (g := at(e)[0]) is None else F.coalesce(g, F.lit(False)))
        many = self._many(rest, value, key, inner, vt, kt)
        made = F.transform(held, lambda e: at(e)[1])
        return conjunction(guards), F.flatten(made) if many else made, True

    def _many(self, rest, value, key, inner, vt, kt) -> bool:
        probe = Cell(F.lit(None).cast(vt), vt), Cell(F.lit(None).cast(kt), kt)
        s, _ = unify(self, value, probe[0], inner)
        if key is not None:
            s, _ = unify(self, key, probe[1], s)
        return self.lead(rest, s)[2] is not None

    def exists(self) -> Column | None:
        """Whether the body has a solution; None if it always has."""
        guard, col, many = self.results(self.body, self.scope, lambda _: F.lit(True))
        return conjunction([*([guard] if guard is not None else []), F.size(col) > 0]) if many else guard

    def head(self, value: Node):
        """A function from a scope to the value's column; its type is noted on the side."""
        seen: dict[str, T.DataType] = {}

        def column(scope: Scope) -> Column:
            c = solid(self.term(value, scope))
            if c is None:
                raise UnsupportedPlan("a value of mixed types has no column form", value.at)
            seen["type"] = c.type
            return c.col

        return column, seen

    def array(self, value: Node, is_set: bool) -> Term:
        column, seen = self.head(value)
        guard, col, many = self.results(self.body, self.scope, column)
        col = col if many else F.array(col)
        col = F.filter(col, lambda x: x.isNotNull())
        if guard is not None:
            col = F.when(F.coalesce(guard, F.lit(False)), col).otherwise(F.slice(col, 1, 0))
        type_ = seen.get("type", T.NullType())  # without a solution there is no type
        col = F.coalesce(col, F.array().cast(T.ArrayType(type_)))
        col = as_members(col, type_) if is_set and not isinstance(type_, T.NullType) else col
        return Cell(col, T.ArrayType(type_), self._uses(), is_set)

    def mapping(self, key: Node, value: Node) -> Term:
        """An object; a key that occurs twice raises."""
        col, kt, vt = self.entries(key, value)
        return Cell(F.map_from_entries(col), T.MapType(kt, vt), self._uses())

    def entries(self, key: Node, value: Node) -> tuple[Column, T.DataType, T.DataType]:
        """An array of (key, value) structs, and the types of both."""
        types: dict[str, T.DataType] = {}

        def column(scope: Scope) -> Column:
            k, x = solid(self.term(key, scope)), solid(self.term(value, scope))
            if k is None or x is None:
                raise UnsupportedPlan("an object of mixed values has no column form", value.at)
            if isinstance(k.type, T.VariantType):
                name = from_variant(k, "string")
                other = F.when(k.col.isNotNull(), F.raise_error(F.lit("an object key of a document is no string")).cast("string"))
                k = cell(T.StringType(), k, col=F.coalesce(name.col, other))
            types.update(key=k.type, value=x.type)
            return F.when(k.col.isNotNull() & x.col.isNotNull(), F.struct(k.col.alias("key"), x.col.alias("value")))

        guard, col, many = self.results(self.body, self.scope, column)
        col = F.filter(col if many else F.array(col), lambda x: x.isNotNull())
        if guard is not None:
            col = F.when(F.coalesce(guard, F.lit(False)), col).otherwise(F.slice(col, 1, 0))
        kt, vt = types.get("key", T.StringType()), types.get("value", VARIANT)
        empty = F.array().cast(T.ArrayType(T.StructType([T.StructField("key", kt), T.StructField("value", vt)])))
        return F.coalesce(col, empty) if types else empty, kt, vt

    def _uses(self) -> frozenset[str]:
        return frozenset().union(*(t.uses for t in (*self.scope.vars.values(), self.scope.world.input)))


def head_type_probe(head, scope: Scope) -> Column:
    try:
        return head(scope)
    except Exception:
        return F.lit(None)


def lift(s: Stmt, scope: Scope) -> tuple[Stmt, ...] | None:
    """A literal with enumerating references inside of it as generators and the literal over their variables."""
    found: list[Stmt] = []

    def swap(n):
        if isinstance(n, Ref) and open_keys(n, scope) is not None:
            name = f"__{next(_numbers)}"
            found.append(Stmt(expr=Bin("=", Var(name), n)))
            return Var(name)
        if isinstance(n, (Bin, Un, Call, Arr, SetOf, Obj)):
            return replace(n, **{f: swap(getattr(n, f)) for f in n.__dataclass_fields__ if f not in ("at", "op", "name")})
        return tuple(map(swap, n)) if isinstance(n, tuple) else n

    made = swap(s.expr)
    return (*found, replace(s, expr=made)) if found else None


def clause(r: Rule, scope: Scope, guards: list[Column]) -> list[tuple[Column | None, Term]]:
    """The values of a row-local rule clause and of its else branches, each with its condition, in order."""
    out = []
    for value, body in ((r.value, r.body), *r.orelse):
        b = RowBody(body, scope)
        lead, inner, gen = b.lead(b.body, b.scope)
        if gen is None:
            lead = [*guards, *lead]
            t = b.term(value, inner)
            if not isinstance(t, Undefined):
                if (d := defined(t)) is not None:
                    lead.append(d)
                out.append((conjunction(lead), t))
        else:
            t = b.term(value, b.scope) if not reads(value) & bound(body) else None
            if t is not None:
                found = b.exists()
            else:
                all_ = b.array(value, True)
                if isinstance(all_, Undefined):
                    continue
                clash = F.raise_error(F.lit(f"conflicting values for {r.name}"))
                one = F.when(F.size(all_.col) > 1, clash.cast(all_.type.elementType)).otherwise(F.try_element_at(all_.col, F.lit(1)))
                t, found = cell(all_.type.elementType, all_, col=one), F.size(all_.col) > 0
            out.append((conjunction([*guards, *([found] if found is not None else [])]), t))
    return out


def choose(name: str, clauses: list[list[tuple[Column | None, Term]]], w: World) -> Term:
    """One value out of a rule's clauses, its else branches and its default; differing values raise."""
    d = w.compiled.defaults.get(name)
    default = RowBody((), Scope({}, w)).term(d.value, Scope({}, w)) if d else None
    options = [c for c in clauses if c]
    if any(isinstance(t, Deferred) for c in options for _, t in c):
        raise NeedsRelation
    if not options:
        return UNDEFINED if default is None else default
    if len(options) == 1 and len(options[0]) == 1 and default is None:
        cond, t = options[0][0]
        if cond is None:
            return t
        if isinstance(t, Fields):
            return Fields({k: guarded(x, cond) for k, x in t.fields.items()})
        if isinstance(t, (Collection, Deferred)):
            raise NeedsRelation
    cells = [solid(t) for c in options for _, t in c] + ([solid(default)] if default is not None else [])
    if any(c is None for c in cells) or len({kind(c) for c in cells}) > 1:
        if any(isinstance(t, (Collection, Deferred)) for c in options for _, t in c):
            raise NeedsRelation
        raise UnsupportedPlan(f"the values of {name} have several types")
    type_ = widest([c.type for c in cells])
    made = []
    for c in options:
        col = None
        for cond, t in c:
            value = solid(t).col.cast(type_)
            if cond is None:
                col = value if col is None else col.otherwise(value)
                break
            col = F.when(cond, value) if col is None else col.when(cond, value)
        made.append(col)
    consts = {solid(t).const for c in options for _, t in c}
    if len(made) == 1:
        out = made[0]
    elif len(consts) == 1 and None not in consts:  # all clauses give the same value
        conds = [cond for c in options for cond, _ in c]
        any_ = None
        for c in conds:
            c = F.lit(True) if c is None else c
            any_ = c if any_ is None else any_ | c
        out = F.when(any_, cells[0].col.cast(type_))
    else:
        found = F.array_distinct(F.filter(F.array(*made), lambda x: x.isNotNull()))
        clash = F.raise_error(F.lit(f"conflicting values for {name}")).cast(type_)
        out = F.when(F.size(found) > 1, clash).otherwise(F.try_element_at(found, F.lit(1)))
    if default is not None:
        out = F.coalesce(out, solid(default).col.cast(type_))
    return Cell(out, type_, frozenset().union(*(c.uses for c in cells), w.input.uses), cells[0].is_set)


def guarded(t: Term, cond: Column) -> Term:
    c = solid(t)
    if c is None:
        raise UnsupportedPlan("a nested value of mixed types has no column form")
    return cell(c.type, c, col=F.when(cond, c.col), is_set=c.is_set)


def row_set(name: str, w: World) -> Term:
    """A set rule over one row: the union of its clauses, undefined if that is empty."""
    parts = [RowBody(r.body, Scope({}, w)).array(r.value, True) for r in w.compiled.rules[name]]
    parts = [p for p in parts if not isinstance(p.type.elementType, T.NullType)]
    if not parts:
        return UNDEFINED
    if len({kind(Cell(p.col, p.type.elementType)) for p in parts}) > 1:
        lists = [variant(replace(p, is_set=False)) for p in parts]
        if None in lists:
            raise UnsupportedPlan(f"the members of {name} have no column form together")
        parts = [from_variant(c, "array") for c in lists]
    type_ = widest([p.type.elementType for p in parts])
    col = parts[0].col.cast(T.ArrayType(type_))
    for p in parts[1:]:
        col = set_operation(F.array_union, col, p.col.cast(T.ArrayType(type_)), type_)
    col = col if isinstance(type_, T.VariantType) else F.array_sort(col)
    return Cell(F.when(F.size(col) > 0, col), T.ArrayType(type_), w.input.uses, True)


def row_object(name: str, w: World) -> Term:
    """An object rule over one row; differing values of a key raise, and an empty object is undefined."""
    rules = w.compiled.rules[name]
    parts = [RowBody(r.body, Scope({}, w)).entries(r.keys[0], r.value) for r in rules]
    if any(len(r.keys) > 1 for r in rules):
        if w.input is UNDEFINED:
            raise NeedsRelation
        raise UnsupportedPlan(f"the nested heads of {name} have no row plan", rules[0].at)
    kt, vt = widest([p[1] for p in parts]), widest([p[2] for p in parts])
    of = T.ArrayType(T.StructType([T.StructField("key", kt), T.StructField("value", vt)]))
    col = F.concat(*[p[0].cast(of) for p in parts])
    if isinstance(vt, (T.VariantType, T.MapType)):  # of pairs with the same text the first stays
        texts = F.transform(col, lambda e: F.to_json(e))
        col = F.filter(col, lambda e, i: F.array_position(texts, F.get(texts, i)) == i + 1)
    else:
        col = F.array_distinct(col)
    clash = F.raise_error(F.lit(f"conflicting object key in {name}")).cast(of)
    col = F.when(F.size(F.array_distinct(F.transform(col, lambda e: e["key"]))) < F.size(col), clash).otherwise(col)
    return Cell(F.when(F.size(col) > 0, F.map_from_entries(col)), T.MapType(kt, vt), w.input.uses)


# -- relations


class Relation(Planner):
    """A body over tables: a DataFrame with a row for each solution, and the scope over its columns."""

    def __init__(self, world: World, df: DataFrame | None = None) -> None:
        self.world, self.df = world, df
        self.keys: list[tuple[Cell, Cell]] = []
        self.outside: list[Column] = []
        self.memo: dict = {}
        #: Whether a row of the start may have become several.
        self.many = False
        #: The columns whose order is the order of solutions; None if they have no order.
        self.order: list[str] | None = []
        #: What the rows are as long as nothing is joined or filtered: (rows, source, their columns by the source's).
        self.scan: tuple[DataFrame, DataFrame, dict[str, str]] | None = None
        #: (rows, source, column, name here): the rows are the distinct values of the source's column.
        self.seed: tuple[DataFrame, DataFrame, str, str] | None = None
        #: (rows, column): the column differs from row to row.
        self.unique: tuple[DataFrame, str] | None = None

    @property
    def own(self) -> frozenset[str]:
        return frozenset(self.df.columns) if self.df is not None else frozenset()

    def closed(self, name: str) -> DataFrame:
        """The rows of a rule, which has no surroundings to share variables with."""
        if self.keys or self.outside:
            raise UnsupportedPlan(f"rule {name} reads both its input row and a table where only tables have a plan")
        return self.frame()

    def frame(self) -> DataFrame:
        if self.df is None:
            self.df = self.world.spark.range(1).select(F.lit(1).alias(f"one_{next(_numbers)}"))
        return self.df

    def inner(self, *terms: Term) -> bool:
        return all(t.uses <= self.own for t in terms)

    def where(self, cond: Column | None, *terms: Term) -> None:
        if cond is None:
            return
        if not self.inner(*terms):
            if any(t.uses & self.own for t in terms):
                raise Outer
            self.outside.append(cond)
            return
        self.df = self.frame().where(cond)

    def fresh(self, df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        """``df`` under new column names."""
        n = next(_numbers)
        names = {c: f"r{n}_{c}" for c in df.columns}
        return df.select(*[F.col(f"`{c}`").alias(names[c]) for c in df.columns]), names

    def cross(self, df: DataFrame) -> None:
        self.df = df if self.df is None else self.df.crossJoin(df)

    # -- what tables allow
    def uncorrelated(self, t: Term) -> Collection:
        if isinstance(t, Collection):
            return t
        if "relation" not in t.memo:
            rel, value, key = subquery(t, self.world_of(t))
            if rel.keys or rel.outside:
                raise Outer
            t.memo["relation"] = collected(t.node, rel, value, key)
        return t.memo["relation"]

    @staticmethod
    def world_of(t: Deferred) -> World:
        return t.scope.world

    def members(self, t: Term) -> tuple[Term, Term]:
        """Join with a collection's rows; its key and value there."""
        c = self.uncorrelated(t)
        df, names = self.fresh(c.df)
        first, self.many = self.df is None, True
        self.cross(df)
        if first:
            self.scan = (self.df, c.df, names)
            if c.values_of and isinstance(c.value, Cell):
                (own,) = c.value.uses
                self.seed, self.unique = (self.df, *c.values_of, names[own]), (self.df, names[own])
        if c.kind == "array" and c.order:
            self.order = None
        elif c.kind == "array" and isinstance(c.key, Cell) and self.order is not None:
            self.order.append(names[next(iter(c.key.uses))])
        else:
            self.order = None
        return (renamed(c.key, names) if c.key is not None else UNDEFINED), renamed(c.value, names)

    def single(self, name: str, scope: Scope) -> Term:
        """The value of a complete rule over tables, joined as one row."""
        key = ("single", name, id(scope.world))
        if key not in self.memo:
            df, value = complete_relation(name, scope.world)
            df, names = self.fresh(df)
            self.cross(df)
            self.memo[key] = renamed(value, names)
        return self.memo[key]

    def aggregate(self, t: Term, name: str) -> Term:
        """An aggregate of a collection: grouped by what it shares with this relation, and joined back."""
        if isinstance(t, Collection):
            out = self._whole(t)
        else:
            if id(t.node) not in self.memo or self.memo[id(t.node)][0] is not t.scope:
                self.memo[id(t.node)] = (t.scope, self._grouped(t))
            out = self.memo[id(t.node)][1]
        return out.get(name, UNDEFINED)

    def _whole(self, c: Collection) -> dict[str, Term]:
        key = ("whole", id(c.df))
        if key not in self.memo:
            df, names = aggregates(c.df, c.value, c.kind)
            df, new = self.fresh(df.where(F.col("count") > 0) if c.empty_undefined else df)
            self.cross(df)
            self.memo[key] = {n: finished(n, new[n], type_) for n, type_ in names.items()}
        return self.memo[key]

    def _grouped(self, t: Deferred) -> dict[str, Term]:
        def make(rel: Relation, df, value: Term, _: Term | None) -> tuple[DataFrame, dict[str, T.DataType]]:
            return aggregates(df, value, t.node.kind)

        return {n: finished(n, c, type_) for n, (c, type_) in self._joined_back(t, make).items()}

    def _joined_back(self, t: Deferred, make) -> dict[str, tuple[str, T.DataType]]:
        """What ``make`` aggregates of a comprehension's rows, joined on the variables it shares: columns and types by name."""
        self.frame()
        try:
            rel, value, key = subquery(t, self.world_of(t))
            keys, conds = rel.keys, rel.outside
        except Outer:
            rel, value, key, keys = self.seeded(t)
            conds = []
        on = [(a, F.col(f"k{i}"), b) for i, (a, b) in enumerate(keys)]
        df, names = make(rel, rel.frame().groupBy(*[b.col.alias(f"k{i}") for i, (_, b) in enumerate(keys)]) if keys else rel.frame(), value, key)
        if len(keys) == 1 and not conds and self._same_values(rel, *keys[0]):  # one grouping instead of distinct values and a join
            here = self.seed[3]
            new = {c: f"g{next(_numbers)}_{c}" for c in names}
            self.df = df.where(F.col("k0").isNotNull()).select(F.col("k0").alias(here), *[F.col(c).alias(new[c]) for c in names])
            self.unique, self.seed, self.scan = (self.df, here), None, None
            return {n: (new[n], type_) for n, type_ in names.items()}
        df, new = self.fresh(df)
        join = [*[a.col == F.col(new[f"k{i}"]) for i, (a, _, _) in enumerate(on)], *conds]
        cond = conjunction(join)
        left, unique = self.df, self.unique
        self.df = self.df.join(df, cond if cond is not None else F.lit(True), "left")
        if keys and unique and unique[0] is left and not conds:  # a group at most joins a row
            self.unique = (self.df, unique[1])
        return {n: (new[n], type_) for n, type_ in names.items()}

    def _same_values(self, rel: Relation, here: Cell, there: Cell) -> bool:
        """Whether the rows are the distinct values of the very column that a subquery's plain scan is grouped by."""
        if not self.seed or self.seed[0] is not self.df or not rel.scan or rel.scan[0] is not rel.df or self.seed[1] is not rel.scan[1]:
            return False
        return here.uses == {self.seed[3]} and there.uses == {rel.scan[2].get(self.seed[2])}

    # -- values of heads
    def settled(self, t: Term) -> Term:
        """A head's value, in which comprehensions and rules over tables become a row's arrays, sets and maps.

        An array is in the order of the indexes of what its body ranges over; without them it is sorted.
        """
        if isinstance(t, Deferred):
            def make(rel: Relation, df, value: Term, key: Term | None) -> tuple[DataFrame, dict[str, T.DataType]]:
                return gathered(df, rel.settled(value), key, t.node.kind, rel.order)

            ((column, type_),) = self._joined_back(t, make).values()
            return Cell(F.coalesce(F.col(column), empty_of(type_)), type_, frozenset([column]), t.node.kind == "set")
        if isinstance(t, Collection):
            places = [next(iter(t.key.uses))] if t.kind == "array" and isinstance(t.key, Cell) and not t.order else [] if t.order else list(t.by)
            df, names = gathered(t.df, t.value, t.key, t.kind, places, descending=t.order == "desc")
            df, new = self.fresh(df.where(F.size("all") > 0) if t.empty_undefined else df)
            self.cross(df)
            return Cell(F.coalesce(F.col(new["all"]), empty_of(names["all"])), names["all"], frozenset([new["all"]]), t.kind == "set")
        if isinstance(t, Items):
            return Items(tuple(self.settled(x) for x in t.items), t.is_set)
        if isinstance(t, Fields):
            return Fields({k: self.settled(x) for k, x in t.fields.items()}, t.row, t.held)
        return t

    def lookup(self, t: Term, key: Term) -> Term:
        """The value under a key of an object rule, the row of an indexed table, or a member of a set: a left join."""
        if isinstance(t, Deferred) and t.node.kind == "array" or isinstance(t, Collection) and t.kind == "array" and (t.by or t.order):
            return at_index(self.settled(t), key)
        c = self.uncorrelated(t)
        k = solid(key)
        if c.kind == "set":
            held = self.contains(key, c)
            return UNDEFINED if k is None or held.const is False else cell(k.type, held, key, col=F.when(held.col, k.col))
        if not isinstance(c.key, Cell):
            raise UnsupportedPlan("the rows have no key: a table's index is a column named in the catalogue")
        if c.kind == "array" and k is not None and k.const is not None and isinstance(k.const, (int, float)) and k.const < 0:
            raise UnsupportedPlan("an index from the end of a table has no plan")
        if k is None or kind(k) != kind(c.key):
            return UNDEFINED
        if not self.inner(key):
            raise Outer
        df, names = self.fresh(c.df)
        own, found = renamed(c.key, names), renamed(c.value, names)
        self.df = self.frame().join(df, k.col == own.col, "left")
        return replace(found, held=own.col.isNotNull()) if isinstance(found, Fields) else found

    def inline_tables(self, name: str, args: tuple[Term, ...], w: World, node: Node) -> Term:
        """A user function of tables, expanded in place: its conditions become those of its value."""
        options = []
        for r in w.compiled.rules.get(name, ()):
            if len(r.args) != len(args):
                return UNDEFINED
            scope, guards = Scope({n: Open() for a in r.args for n in pattern_vars(a)}, w), []
            for p, a in zip(r.args, args, strict=True):
                if isinstance(a, (Collection, Deferred)) and not isinstance(p, Var):
                    raise UnsupportedPlan("a pattern of a table has no plan", node.at)
                scope, more = unify(self, p, a, scope)
                guards += more
            branches = []
            for value, body in ((r.value, r.body), *r.orelse):
                at, conds = scope.opened(body), list(guards)
                for s in arranged(body, {n for n, t in scope.vars.items() if not isinstance(t, Open)}, set()):
                    at, more = self.condition(s, at, node)
                    conds += more
                t = self.settled(self.term(value, at))
                if isinstance(t, Undefined):
                    continue
                if (d := defined(t)) is not None:
                    conds.append(d)
                branches.append((conjunction(conds), t))
            options.append(branches)
        return choose(name, options, w)

    def condition(self, s: Stmt, scope: Scope, node: Node) -> tuple[Scope, list[Column]]:
        """A literal without solutions of its own as conditions."""
        e = s.expr
        if s.withs or s.domain is not None or isinstance(e, Every) or any(open_keys(n, scope) is not None for n in walk(e) if e is not None):
            raise UnsupportedPlan("a function of a table that enumerates has no plan", node.at)
        if e is None:
            return scope, []
        if isinstance(e, Bin) and e.op in (":=", "="):
            left, right = (e.left, e.right) if e.op == ":=" or is_open(e.left, scope) or not is_open(e.right, scope) else (e.right, e.left)
            return unify(self, left, self.term(right, scope), scope)
        t = self.term(e, scope)
        if isinstance(t, (Collection, Deferred)):
            raise UnsupportedPlan("a table as a condition has no plan", node.at)
        p = truthy(t)
        if s.negated:
            return scope, [F.lit(False) if p is None else ~p | p.isNull()]
        return scope, [] if p is None else [p]

    def seeded(self, t: Deferred) -> tuple[Relation, Term, Term | None, list[tuple[Cell, Cell]]]:
        """The subquery over the distinct values of the outer columns that it reads, for any condition."""
        used = sorted(outer_columns(t, self.own))
        n = next(_numbers)
        seeds = self.df.select(*[F.col(f"`{c}`").alias(f"s{n}_{c}") for c in used]).distinct()
        names = {c: f"s{n}_{c}" for c in used}
        scope = replace(t.scope, vars={k: renamed(x, names) for k, x in t.scope.vars.items()}, world=replace(t.scope.world, input=renamed(t.scope.world.input, names)))
        rel = Relation(scope.world, seeds)
        value, key = rel.body(t.node.body, scope.opened(t.node.body), t.node)
        pairs = [(Cell(F.col(f"`{c}`"), self.df.schema[c].dataType, frozenset([c])), Cell(F.col(f"`{names[c]}`"), self.df.schema[c].dataType, frozenset([names[c]]))) for c in used]
        rel.order = None
        return rel, value, key, pairs

    def contains(self, x: Term, t: Term) -> Term:
        """Membership as a value: a left join with the distinct members."""
        df, names, on = self._matching(x, t)
        if df is None:
            return known(False)
        mark = f"m{next(_numbers)}"
        self.df = self.frame().join(df.distinct().withColumn(mark, F.lit(True)), on, "left")
        return cell(T.BooleanType(), Cell(F.col(mark), T.BooleanType(), frozenset([mark])), x, col=only_if_defined(F.coalesce(F.col(mark), F.lit(False)), x))

    def _matching(self, x: Term, t: Term) -> tuple:
        c = self.uncorrelated(t)
        member = c.key if c.kind == "object" else c.value
        a, b = solid(x), solid(member)
        if a is None or b is None or kind(a) != kind(b):
            return None, None, None
        name = f"i{next(_numbers)}"
        return c.df.select(b.col.alias(name)), name, a.col == F.col(name)

    def semi(self, x: Term, t: Term, how: str) -> None:
        if isinstance(x, Undefined):
            return self.where(F.lit(how == "left_anti"))
        df, _, on = self._matching(x, t)
        if df is None:
            return self.where(F.lit(how == "left_anti"))
        if not self.inner(x):
            raise Outer
        self.df = self.frame().join(df, on, how)
        return None

    # -- bodies
    def body(self, body: tuple[Stmt, ...], scope: Scope, node: Node) -> tuple[Term, Term | None]:
        """All literals of a comprehension, then its value and key."""
        scope = self.solve(body, scope)
        value = self.term(node.value, scope)
        return value, self.term(node.key, scope) if node.key is not None else None

    def solve(self, body: tuple[Stmt, ...], scope: Scope) -> Scope:
        have = {n for n, t in scope.vars.items() if not isinstance(t, Open)}
        for s in arranged(body, have, set()):
            scope = self.literal(s, scope)
        return scope

    def literal(self, s: Stmt, scope: Scope) -> Scope:
        if s.withs:
            inner = overridden(s, self, scope)
            if inner is None:
                self.where(F.lit(False))
                return scope
            return replace(self.literal(replace(s, withs=()), inner), world=scope.world)
        if s.domain is not None:
            return self.generate(self.term(s.domain, scope), s.key, s.value, scope)
        if s.expr is None:
            return scope
        e = s.expr
        if s.negated:
            self.absent(e, scope)
            return scope
        if isinstance(e, Every):
            self.all_of(e, scope)
            return scope
        if isinstance(e, Bin) and e.op in (":=", "="):
            return self.assign(e, scope)
        if isinstance(e, Bin) and e.op == "in":
            x, of = self.term(e.left, scope), self.term(e.right, scope)
            if isinstance(of, (Collection, Deferred)):
                self.semi(x, of, "left_semi")
                return scope
        if isinstance(e, Bin) and e.op == "==" and self.correlate(self.term(e.left, scope), self.term(e.right, scope)):
            return scope
        if open_keys(e, scope) is not None:
            t, scope = self.enumerate(e, scope)
            self.where(truthy(t), t)
            return scope
        if lifted := lift(s, scope):
            return self.solve(lifted, scope.opened(lifted[:-1]))
        t = self.term(e, scope)
        if isinstance(t, (Collection, Deferred)):
            if isinstance(t, Collection) and t.empty_undefined:
                self.semi_any(t, "left_semi")
            return scope
        self.where(truthy(t), t)
        return scope

    def correlate(self, a: Term, b: Term) -> bool:
        """Note an equality of an own term and an outer one as a grouping key."""
        if not isinstance(a, Cell) or not isinstance(b, Cell) or kind(a) != kind(b):
            return False
        for x, y in ((a, b), (b, a)):
            if x.uses and not x.uses & self.own and y.uses and y.uses <= self.own:
                self.keys.append((x, y))
                return True
        return False

    def assign(self, e: Bin, scope: Scope) -> Scope:
        left, right = (e.left, e.right) if e.op == ":=" or is_open(e.left, scope) or not is_open(e.right, scope) else (e.right, e.left)
        if open_keys(right, scope) is not None:
            t, scope = self.enumerate(right, scope)
        elif e.op == "=" and open_keys(left, scope) is not None:
            t, scope = self.enumerate(left, scope)
            left = right
        else:
            t = self.term(right, scope)
        if isinstance(t, (Collection, Deferred)) and isinstance(left, Var):
            return scope.bind(**{left.name: t})
        if not is_open(left, scope) and not isinstance(left, (Arr, Obj)) and self.correlate(self.term(left, scope), t):
            return scope
        scope, guards = unify(self, left, t, scope)
        others = [x for n in pattern_vars(left) if isinstance(x := scope.vars.get(n), Term)]
        for g in guards:
            self.where(g, t, *others)
        return scope

    def enumerate(self, node: Ref, scope: Scope) -> tuple[Term, Scope]:
        """A reference with unbound keys: a generator for each of them."""
        n = open_keys(node, scope)
        base = self.term(Ref(node.base, node.path[:n]), scope) if n else self.term(node.base, scope)
        name = f"__{next(_numbers)}"
        scope = self.generate(base, node.path[n], Var(name), scope.bind(**{name: Open()}), set_keys=True)
        rest = node.path[n + 1 :]
        if rest and open_keys(Ref(Var(name), rest), scope) is not None:
            return self.enumerate(Ref(Var(name), rest), scope)
        return self.term(Ref(Var(name), rest) if rest else Var(name), scope), scope

    def generate(self, t: Term, key: Node | None, value: Node, scope: Scope, set_keys: bool = False) -> Scope:
        keyed = key is not None and not (isinstance(key, Var) and key.name == "_")
        if isinstance(t, Undefined):
            self.where(F.lit(False))
            t = Items(())
        if isinstance(t, (Collection, Deferred)):
            k, v = self.members(t)
            if keyed and kind(t) == "array" and not isinstance(k, Cell):
                raise UnsupportedPlan("the rows have no index: a table's is a column named in the catalogue")
            if keyed and kind(t) == "set":
                k = v
        else:
            if not self.inner(t):
                raise Outer
            pairs, kt, vt = RowBody((), scope).elements(t, keyed and not set_keys)
            n = next(_numbers)
            self.many = True
            self.df = self.frame().withColumn(f"e{n}", F.explode(pairs)).withColumns({f"k{n}": F.col(f"e{n}.key"), f"v{n}": F.col(f"e{n}.value")}).drop(f"e{n}")
            k, v = Cell(F.col(f"k{n}"), kt, frozenset([f"k{n}"])), Cell(F.col(f"v{n}"), vt, frozenset([f"v{n}"]))
            if self.order is not None and kind(t) == "array":
                self.order.append(f"k{n}")
            else:
                self.order = None
        for p, x in ((value, v), *([(key, k)] if keyed else [])):
            if isinstance(p, Var) and isinstance(scope.vars.get(p.name), Open):
                scope = scope.bind(**{p.name: x})
            else:
                scope, guards = unify(self, p, x, scope)
                for g in guards:
                    self.where(g, x)
        return scope

    def absent(self, e: Node, scope: Scope) -> None:
        """Negation: an anti-join where tables are involved, else an inverted predicate."""
        if isinstance(e, Bin) and e.op == "in":
            x, of = self.term(e.left, scope), self.term(e.right, scope)
            if isinstance(of, (Collection, Deferred)):
                self.semi(x, of, "left_anti")
                return
        if any(open_keys(n, scope) is not None for n in walk(e)):
            self.without((Stmt(expr=e),), scope)
            return
        t = self.term(e, scope)
        if isinstance(t, Collection):
            if t.empty_undefined:
                self.semi_any(t, "left_anti")
            else:
                self.where(F.lit(False))
            return
        p = truthy(t)
        self.where(F.lit(False) if p is None else ~p | p.isNull(), t)

    def semi_any(self, t: Collection, how: str) -> None:
        self.df = self.frame().join(t.df.limit(1), F.lit(True), how)

    def all_of(self, e: Every, scope: Scope) -> None:
        domain = self.term(e.domain, scope)
        if isinstance(domain, Undefined):
            self.where(F.lit(False))
            return
        if not isinstance(domain, (Collection, Deferred)):
            self.where(RowBody((), scope).every(e, scope), domain)
            return
        if e.key is not None and kind(domain) == "set":
            self.where(F.lit(False))
            return
        inner = Scope({**scope.vars, e.value: Open()}, scope.world)
        self.counter_examples(e, domain, inner)

    def counter_examples(self, e: Every, domain: Term, scope: Scope) -> None:
        """Anti-join with the elements that fail the body."""

        def build(rel: Relation, s: Scope) -> None:
            if isinstance(domain, Deferred):
                value, key = rel.body(domain.node.body, replace(domain.scope, vars={**s.vars, **{k: x for k, x in domain.scope.vars.items() if k not in s.vars}}).opened(domain.node.body), domain.node)
            else:
                key, value = rel.members(domain)
            if e.key is not None and not isinstance(key, Cell):
                raise UnsupportedPlan("the rows have no index: a table's is a column named in the catalogue", e.at)
            at = replace(s, vars={**s.vars, e.value: value, **({e.key: key} if e.key is not None else {})})
            p = RowBody(e.body, at).exists()
            rel.where(F.lit(False) if p is None else ~p | p.isNull(), *terms_of(e.body, at))

        self._anti(build, scope, domain.scope if isinstance(domain, Deferred) else scope)

    def without(self, body: tuple[Stmt, ...], scope: Scope) -> None:
        self._anti(lambda rel, s: rel.solve(body, s), scope, scope)

    def _anti(self, build, scope: Scope, outer: Scope) -> None:
        self.frame()
        rel = Relation(scope.world)
        try:
            build(rel, scope)
            keys, conds = rel.keys, rel.outside
        except Outer:
            used = sorted(self.own & frozenset().union(*(t.uses for t in (*scope.vars.values(), *outer.vars.values(), scope.world.input))))
            n = next(_numbers)
            names = {c: f"s{n}_{c}" for c in used}
            rel = Relation(scope.world, self.df.select(*[F.col(f"`{c}`").alias(names[c]) for c in used]).distinct())
            build(rel, replace(scope, vars={k: renamed(t, names) for k, t in scope.vars.items()}))
            keys, conds = [(Cell(F.col(f"`{c}`"), None), Cell(F.col(names[c]), None)) for c in used], []
        n = next(_numbers)
        df = rel.frame().select(*[b.col.alias(f"k{n}_{i}") for i, (_, b) in enumerate(keys)])
        cond = conjunction([*[a.col == F.col(f"k{n}_{i}") for i, (a, _) in enumerate(keys)], *conds])
        self.df = self.df.join(df, cond if cond is not None else F.lit(True), "left_anti")


def terms_of(body: tuple[Stmt, ...], scope: Scope) -> list[Term]:
    """The bound terms that a body reads; of an object with known fields those that it names."""
    out: list[Term] = []

    def bound_to(name: str) -> Term | None:
        return scope.vars.get(name, scope.world.input if name == "input" else None)

    def visit(n: Node) -> None:
        if isinstance(n, Ref) and isinstance(n.base, Var) and n.path and isinstance(n.path[0], Lit):
            t = bound_to(n.base.name)
            if isinstance(t, Fields) and n.path[0].value in t.fields:
                out.append(t.fields[n.path[0].value])
                for key in n.path[1:]:
                    visit(key)
                return
        if isinstance(n, Var) and (t := bound_to(n.name)) is not None:
            out.append(t)
        for c in children(n):
            visit(c)

    for stmt in body:
        visit(stmt)
    return out


def renamed(t: Term, names: dict[str, str]) -> Term:
    """A term over renamed columns; only plain columns and what is made of them can be renamed."""
    if isinstance(t, Fields):
        return Fields({k: renamed(x, names) for k, x in t.fields.items()}, t.row, t.held)
    if isinstance(t, Items):
        return Items(tuple(renamed(x, names) for x in t.items), t.is_set)
    if isinstance(t, Cell) and t.uses & names.keys():
        if len(t.uses) > 1:
            raise UnsupportedPlan("a computed value can't be taken into a subquery")
        (c,) = t.uses
        return Cell(F.col(f"`{names[c]}`"), t.type, frozenset([names[c]]), t.is_set)
    return t


def outer_columns(t: Deferred, own: frozenset[str]) -> frozenset[str]:
    """The columns that a comprehension reads from its surroundings."""
    found: set[str] = set()
    for node in walk(t.node):
        if isinstance(node, Ref) and isinstance(node.base, Var) and isinstance(x := t.scope.vars.get(node.base.name), Fields) and node.path and isinstance(node.path[0], Lit):
            found |= getattr(x.fields.get(node.path[0].value), "uses", frozenset())
        elif isinstance(node, Var) and not isinstance(t.scope.vars.get(node.name), (Fields, type(None))):
            found |= t.scope.vars[node.name].uses
    return frozenset(found) & own


def subquery(t: Deferred, world: World) -> tuple[Relation, Term, Term | None]:
    rel = Relation(world)
    value, key = rel.body(t.node.body, t.scope.opened(t.node.body), t.node)
    if not rel.inner(value, *([key] if key is not None else [])):
        raise Outer
    return rel, value, key


def collected(node: Compr, rel: Relation, value: Term, key: Term | None) -> Collection:
    """The rows of a comprehension under fixed names."""
    scan, unique = rel.scan if rel.scan and rel.scan[0] is rel.df else None, rel.unique if rel.unique and rel.unique[0] is rel.df else None
    of = next((c for c, here in scan[2].items() if {here} == value.uses), None) if scan and plain_column(value, scan[0]) else None
    alone = unique and key is not None and key.uses == {unique[1]} and plain_column(key, rel.df)
    value = rel.settled(value)
    by = list(rel.order or ()) if node.kind == "array" and rel.order else []
    df, value, key = projected(rel.frame(), value, key, by)
    if node.kind == "set":
        df = df.distinct()
    elif node.kind == "object" and not alone:
        df = unique_keys(df, key, "conflicting object key", strict=True)
    return Collection(df, value, node.kind, key, by=tuple(f"__by{i}" for i in range(len(by))), values_of=(scan[1], of) if node.kind == "set" and of is not None else None)


def plain_column(t: Term, df: DataFrame) -> bool:
    """Whether a term is a column of ``df`` as it is."""
    if not isinstance(t, Cell) or len(t.uses) != 1:
        return False
    (name,) = t.uses
    return name in df.columns and t.col._jc.toString().strip("`") == name and t.type == df.schema[name].dataType


def gathered(df, value: Term, key: Term | None, kind_: str, order: list[str] | None, *, descending: bool = False) -> tuple[DataFrame, dict[str, T.DataType]]:
    """All of a grouping's values in one column, ``all``: an array in the given order or else sorted, a set, or a map."""
    v = solid(value) or variant(value)
    k = solid(key) if kind_ == "object" and key is not None else None
    if v is None or kind_ == "object" and k is None:
        raise UnsupportedPlan("collected values of such types have no column form")
    if kind_ == "set":
        type_: T.DataType = T.ArrayType(v.type)
        made = as_members(F.collect_list(v.col), v.type) if isinstance(v.type, (T.VariantType, T.MapType)) else F.array_sort(F.collect_set(v.col))
    elif kind_ == "object":
        type_ = T.MapType(k.type, v.type)
        pairs = F.collect_list(F.when(k.col.isNotNull() & v.col.isNotNull(), F.struct(k.col.alias("key"), v.col.alias("value"))))
        clash = F.raise_error(F.lit("conflicting object key")).cast(T.ArrayType(T.StructType([T.StructField("key", k.type), T.StructField("value", v.type)])))
        twice = F.size(F.array_distinct(F.transform(pairs, lambda e: e["key"]))) < F.size(pairs)
        made = F.map_from_entries(F.when(twice, clash).otherwise(pairs))
    else:
        type_ = T.ArrayType(v.type)
        by = [F.col(c) for c in order or ()]
        if not by and not isinstance(v.type, (T.VariantType, T.MapType)):
            by = [v.col]
        one = F.when(v.col.isNotNull(), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)], F.struct(v.col.alias("value")).alias("of") if by and not order else v.col.alias("value")))
        pairs = F.collect_list(one)
        if by:  # the places decide, so what has no order can be carried along
            places = F.array_sort(F.transform(pairs, lambda e, i: F.struct(*[e[f"o{j}"].alias(f"o{j}") for j in range(len(by))], i.alias("i"))))
            made = F.transform(places, lambda e: F.get(pairs, e["i"])["value"] if order else F.get(pairs, e["i"])["of"]["value"])
        else:
            made = F.transform(pairs, lambda e: e["value"])
        made = F.reverse(made) if descending else made
    return df.agg(made.alias("all")), {"all": type_}


def empty_of(type_: T.DataType) -> Column:
    return F.from_json(F.lit("{}"), type_) if isinstance(type_, T.MapType) and not isinstance(type_.valueType, T.VariantType) and isinstance(type_.keyType, T.StringType) else F.map_from_entries(F.array().cast(T.ArrayType(T.StructType([T.StructField("key", type_.keyType), T.StructField("value", type_.valueType)])))) if isinstance(type_, T.MapType) else F.array().cast(type_)


def projected(df: DataFrame, value: Term, key: Term | None = None, by: list[str] | tuple = ()) -> tuple[DataFrame, Term, Term | None]:
    """``df`` with the columns of a value, a key and an order alone, where value and key are defined."""
    for t in (value, key):
        if t is not None and (d := defined(t)) is not None:
            df = df.where(d)
    columns, new = [], []
    for t, name in ((value, "value"), (key, "key")):
        if t is None:
            new.append(None)
        elif isinstance(t, Fields):
            cells = {k: solid(x) for k, x in t.fields.items()}
            if any(c is None for c in cells.values()):
                raise UnsupportedPlan("an object of mixed values has no column form")
            columns += [c.col.alias(k) for k, c in cells.items()]
            new.append(Fields({k: Cell(F.col(f"`{k}`"), c.type, frozenset([k]), c.is_set) for k, c in cells.items()}, row=True))
        else:
            c = solid(t)
            if c is None:
                raise UnsupportedPlan("a value of mixed types has no column form")
            columns.append(c.col.alias(name))
            new.append(Cell(F.col(name), c.type, frozenset([name]), c.is_set))
    return df.select(*columns, *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]), *new


def single_column(c: Collection) -> Collection:
    v = solid(c.value)
    if v is None:
        raise UnsupportedPlan("a set of mixed values has no column form")
    return replace(c, value=v)


def distinct_set(c: Collection) -> Collection:
    return replace(c, df=c.df.drop(*c.by).distinct(), kind="set", order=None, by=(), key=None)


def unique_keys(df: DataFrame, key: Term, message: str, *, strict: bool = False) -> DataFrame:
    """Rows with a key each; differing values of a key raise, under ``strict`` any second row does."""
    keys = [c for c in df.columns if c in key.uses] if not isinstance(key, list) else key
    values = [c for c in df.columns if c not in keys]
    clash = F.raise_error(F.lit(message)).cast("boolean")
    if strict:
        df = df.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in values])
        return df.where(F.when(F.col("__n") > 1, clash).otherwise(F.lit(True))).select(*keys, *values)
    shown = {c: F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) else F.col(c) for c in values}
    least = {c: F.first(c) if isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) else F.min(c) for c in values}
    df = df.groupBy(*keys).agg(*[x.alias(c) for c, x in least.items()], *[(~F.min(x).eqNullSafe(F.max(x))).alias(f"__{c}") for c, x in shown.items()])
    differ = None
    for c in values:
        differ = F.col(f"__{c}") if differ is None else differ | F.col(f"__{c}")
    return df.where(F.when(differ, clash).otherwise(F.lit(True))).select(*keys, *values)


def aggregates(df, value: Term, kind_: str) -> tuple[DataFrame, dict[str, T.DataType]]:
    """Every aggregate that a collection allows; Catalyst drops those that nobody reads."""
    v = value if isinstance(value, Cell) else None
    count = F.count(F.lit(1))
    if kind_ == "set":
        parts = [solid(x).col for x in value.fields.values()] if isinstance(value, Fields) else [solid(value).col]
        count = F.count_distinct(*parts)
    out = [count.alias("count")]
    types: dict[str, T.DataType] = {"count": T.LongType()}
    if v is not None and kind_ == "array":
        if isinstance(v.type, NUMBERS):
            type_ = widest([T.LongType(), v.type])
            out += [F.sum(v.col).cast(type_).alias("sum"), F.max(v.col).alias("max"), F.min(v.col).alias("min")]
            types |= {"sum": type_, "max": v.type, "min": v.type}
        p = F.coalesce(v.col, F.lit(False)) if isinstance(v.type, T.BooleanType) else F.lit(True)
        out += [F.bool_and(p).alias("all"), F.bool_or(p).alias("any")]
        types |= {"all": T.BooleanType(), "any": T.BooleanType()}
    return df.agg(*out), types


_EMPTY = {"count": 0, "sum": 0, "all": True, "any": False}


def finished(name: str, column: str, type_: T.DataType) -> Cell:
    col = F.col(column)
    if name in _EMPTY:
        col = F.coalesce(col, F.lit(_EMPTY[name]).cast(type_))
    return Cell(col, type_, frozenset([column]))


# -- rules over tables


def set_rule(name: str, w: World) -> Collection:
    parts = []
    for r in w.compiled.rules[name]:
        rel = Relation(w)
        scope = rel.solve(r.body, Scope({}, w).opened(r.body))
        value = rel.settled(rel.term(r.value, scope))
        parts.append(projected(rel.closed(name), value)[:2])
    df, value = parts[0]
    for other, v in parts[1:]:
        if isinstance(value, Cell) and isinstance(v, Cell) and value.type != v.type:
            type_ = widest([value.type, v.type])
            df, other = (x.select(F.col("value").cast(type_).alias("value")) for x in (df, other))
            value = replace(value, type=type_)
        df = df.unionByName(other)
    return Collection(df.distinct(), value, "set", empty_undefined=True)


def object_rule(name: str, w: World) -> Collection:
    """Rows (key, value), or (k1, k2, ..., v) for nested heads."""
    rules = w.compiled.rules[name]
    depth = max(len(r.keys) for r in rules)
    names = ["key", "value"] if depth == 1 else [*(f"k{i + 1}" for i in range(depth)), "v"]
    parts = []
    for r in rules:
        rel = Relation(w)
        scope = rel.solve(r.body, Scope({}, w).opened(r.body))
        cells = [solid(t) or variant(t) for t in (rel.settled(rel.term(x, scope)) for x in (*r.keys, r.value))]
        if None in cells or len(r.keys) != depth:
            raise UnsupportedPlan(f"rule {name} has no column form", r.at)
        df = rel.closed(name)
        held = conjunction([d for c in cells if (d := defined(c)) is not None])
        df = df if held is None else df.where(held)
        parts.append((df, cells))
    types = [widest([c[i].type for _, c in parts]) for i in range(depth + 1)]
    frames = [df.select(*[c.col.cast(t).alias(n) for c, t, n in zip(cells, types, names, strict=True)]) for df, cells in parts]
    df = frames[0]
    for other in frames[1:]:
        df = df.unionByName(other)
    df = unique_keys(df, names[:-1], f"conflicting object key in {name}")
    terms = [Cell(F.col(n), t, frozenset([n])) for n, t in zip(names, types, strict=True)]
    return Collection(df, terms[-1], "object", terms[0] if depth == 1 else Fields(dict(zip(names[:-1], terms[:-1], strict=True)), row=True), empty_undefined=True)


def collection_rule(name: str, w: World) -> Term | None:
    """A complete rule without a body whose value is a collection over tables."""
    rules = w.compiled.rules[name]
    if len(rules) != 1 or rules[0].body or rules[0].orelse:
        return None
    rel = Relation(w)
    t = rel.term(rules[0].value, Scope({}, w))
    try:
        return rel.uncorrelated(t) if isinstance(t, (Collection, Deferred)) and rel.df is None else None
    except Outer:  # it reads the input row
        return None


def set_relation(name: str, w: World, base: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows (keys, v) of a set rule over input rows and tables: each row's sorted members."""
    frames, types = [], []
    for r in w.compiled.rules[name]:
        rel = Relation(w, base)
        scope = rel.solve(r.body, Scope({}, w).opened(r.body))
        c = solid(rel.settled(rel.term(r.value, scope)))
        if c is None:
            raise UnsupportedPlan(f"the members of {name} have no column form", r.at)
        frames.append(rel.closed(name).select(*keys, c.col.alias("v")).where("v is not null"))
        types.append(c.type)
    df = frames[0].select(*keys, F.col("v").cast(widest(types)).alias("v"))
    for other in frames[1:]:
        df = df.unionByName(other.select(*keys, F.col("v").cast(widest(types)).alias("v")))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set("v")).alias("v"))


def complete_relation(name: str, w: World, base: DataFrame | None = None, keys: tuple[str, ...] = ()) -> tuple[DataFrame, Term]:
    """The rows (keys, value) of a complete rule over tables; several values for the same keys raise."""
    frames, terms, rels = [], [], []
    for r in w.compiled.rules.get(name, ()):
        done = None
        for value, body in ((r.value, r.body), *r.orelse):
            rel = Relation(w, base)
            rels.append(rel)
            scope = rel.solve(body, Scope({}, w).opened(body))
            t = rel.settled(rel.term(value, scope))
            if isinstance(t, Undefined):
                continue
            if isinstance(t, Fields) and not t.row:
                t = Fields({k: solid(x) or variant(x) for k, x in t.fields.items()})
            df = rel.closed(name)
            for d in [d for d in [defined(t)] if d is not None]:
                df = df.where(d)
            cells = {k: solid(x) or variant(x) for k, x in t.fields.items()} if isinstance(t, Fields) else {"v": solid(t) or variant(t)}
            if None in cells.values():
                raise UnsupportedPlan(f"the value of {name} has no column form", r.at)
            df = df.select(*[F.col(k) for k in keys], *[c.col.alias(k) for k, c in cells.items()])
            if r.orelse and keys:
                df = df if done is None else df.join(done, list(keys), "left_anti")
                done = df.select(*keys) if done is None else done.union(df.select(*keys))
            elif r.orelse:  # a branch counts if none before it has a value
                df = df if done is None else df.join(done, F.lit(True), "left_anti")
                one = df.limit(1).select(F.lit(1).alias(f"done_{next(_numbers)}"))
                done = one if done is None else done.unionAll(one)
            frames.append(df)
            terms.append(Fields({k: Cell(F.col(k), c.type, frozenset([k])) for k, c in cells.items()}, row=True) if isinstance(t, Fields) else Cell(F.col("v"), cells["v"].type, frozenset(["v"])))
    if not frames:
        df = (base if base is not None else w.spark.range(1)).select(*keys, F.lit(None).cast("string").alias("v")).where("false")
        return df, Cell(F.col("v"), T.StringType(), frozenset(["v"]))
    values = [c for c in frames[0].columns if c not in keys]
    if any(f.columns != frames[0].columns for f in frames):
        raise UnsupportedPlan(f"the values of {name} are objects of different keys")
    types = [widest([f.schema[c].dataType for f in frames]) for c in values]
    if any(kind(Cell(F.col(c), f.schema[c].dataType)) != kind(Cell(F.col(c), t)) for f in frames for c, t in zip(values, types, strict=True)):
        raise UnsupportedPlan(f"the values of {name} have several types")
    frames = [f.select(*keys, *[F.col(c).cast(t).alias(c) for c, t in zip(values, types, strict=True)]) for f in frames]
    df = frames[0]
    for other in frames[1:]:
        df = df.unionByName(other)
    found = [Cell(F.col(c), t, frozenset([c])) for c, t in zip(values, types, strict=True)]
    terms = [Fields(dict(zip(values, found, strict=True)), row=True) if isinstance(terms[0], Fields) else found[0]]
    if len(frames) == 1 and not any(rel.many for rel in rels):  # a row of the start has one value at most
        return df, terms[0]
    df = df.distinct() if not any(isinstance(t, (T.VariantType, T.MapType)) for t in types) else df
    if keys:
        df = unique_keys(df, list(keys), f"conflicting values for {name}")
    else:
        clash = F.raise_error(F.lit(f"conflicting values for {name}")).cast("boolean")
        df = df.agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in values]).where(F.when(F.col("__n") > 1, clash).otherwise(F.col("__n") == 1)).select(*values)
    return df, terms[0]
