"""The builtin functions as Column expressions: terms in, a term out, nothing leaves the JVM.

A surely wrong argument type gives undefined while the plan is built; at run time NULL is undefined. What may be
right but has no column form raises :class:`UnsupportedPlan`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.errors import UnsupportedPlan
from ..operators.terms import (
    UNDEFINED, VARIANT, WHOLE, Cell, Fields, Items, Null, Term, all_defined, as_kind, as_members, boolean, cell, constant, defined, equal,
    Undefined, from_variant, integer, kind, mapping, only_if_defined, opened, set_operation, solid, truthy, variant, widest,
)

STRING, LONG, DOUBLE = T.StringType(), T.LongType(), T.DoubleType()


def _strings(fn: Callable[..., Column], type_: T.DataType = STRING) -> Callable:
    """A function of strings alone."""

    def build(*terms: Term) -> Term:
        cells = [as_kind(t, "string") for t in terms]
        return UNDEFINED if None in cells else cell(type_, *cells, col=fn(*(c.col for c in cells)))

    return build


def _whole(t: Term) -> Column | None:
    """An integral number as a long; NULL where it has a fraction."""
    c = as_kind(t, "number")
    if c is None:
        return None
    return c.col.cast("long") if isinstance(c.type, WHOLE) else F.when(c.col == F.floor(c.col), c.col.cast("long"))


def _list(t: Term) -> Cell | None:
    """An array term as a column; None if it surely is no array."""
    if kind(t) not in ("array", None):
        return None
    c = as_kind(t, "array")
    if c is None:
        raise UnsupportedPlan("an array of such values has no column form")
    return c


def _each(c: Cell, want: str) -> Cell:
    """An array of variants as one of a scalar kind; undefined if a member is of another kind."""
    made = F.transform(c.col, lambda x: from_variant(Cell(x, VARIANT), want).col)
    type_ = {"number": DOUBLE, "string": STRING}[want]
    return cell(T.ArrayType(type_), c, col=F.when(F.forall(made, lambda x: x.isNotNull()), made))


def _split(s: Column, delim: Cell) -> Column:
    if delim.const is not None:
        found = F.split(s, re.escape(delim.const) if delim.const else "", -1)
    else:
        found = F.split(s, F.concat(F.lit(r"\Q"), F.replace(delim.col, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(found)


def split(s: Term, delim: Term) -> Term:
    s, d = as_kind(s, "string"), as_kind(delim, "string")
    return UNDEFINED if s is None or d is None else cell(T.ArrayType(STRING), s, d, col=_split(s.col, d))


def concat(delim: Term, parts: Term) -> Term:
    d = as_kind(delim, "string")
    if d is None or kind(parts) not in ("array", None):
        return UNDEFINED
    if isinstance(parts, Items):
        cells = [as_kind(p, "string") for p in parts.items]
        if None in cells:
            return UNDEFINED
        return cell(STRING, d, *cells, col=F.when(all_defined([d, *cells]), F.concat_ws(d.const, *(c.col for c in cells)) if d.const is not None else F.call_function("array_join", F.array(*(c.col for c in cells)).cast("array<string>"), d.col)))
    c = _list(parts)
    if isinstance(c.type.elementType, T.VariantType):
        c = _each(c, "string")
    if not isinstance(c.type.elementType, (T.StringType, T.NullType)):
        return UNDEFINED
    return cell(STRING, d, c, col=F.call_function("array_join", c.col.cast("array<string>"), d.col))


def substring(s: Term, start: Term, length: Term) -> Term:
    c, a, n = as_kind(s, "string"), _whole(start), _whole(length)
    if c is None or a is None or n is None:
        return UNDEFINED
    return cell(STRING, s, start, length, col=F.when((a >= 0) & (n >= 0), F.substring(c.col, (a + 1).cast("int"), n.cast("int"))))


def _trimmed(name: str) -> Callable:
    def build(s: Term, chars: Term) -> Term:
        c, k = as_kind(s, "string"), as_kind(chars, "string")
        if c is None or k is None:
            return UNDEFINED
        made = {"btrim": F.btrim, "ltrim": F.ltrim, "rtrim": F.rtrim}[name](c.col, k.col)
        return cell(STRING, c, k, col=F.when(k.col == "", c.col).otherwise(made))

    return build


_SPEC = re.compile(r"%(?:%|([-+ #0]*)(\d+)?(?:\.(\d+))?([a-zA-Z]))")


def sprintf(pattern: Term, args: Term) -> Term:
    """The specifiers of a format that is written out decide the casts; those of a column do so row by row."""
    f = as_kind(pattern, "string")
    if f is None or kind(args) not in ("array", None):
        return UNDEFINED
    if isinstance(args, Items):
        used: list[Term] = []

        def at(i: int) -> Term | None:
            if i >= len(args.items):
                return None
            used.append(args.items[i])
            return args.items[i]
    else:
        used, c = [args], _list(args)

        def at(i: int) -> Term | None:
            return cell(c.type.elementType, c, col=F.get(c.col, F.lit(i)))

    if f.const is None:
        return _sprintf_column(f, list(args.items) if isinstance(args, Items) else _list(args))
    parts, done, n = [], 0, 0
    for m in _SPEC.finditer(f.const):
        if "%" in f.const[done : m.start()]:
            return UNDEFINED
        parts.append(F.lit(f.const[done : m.start()]))
        done = m.end()
        if m[0] == "%%":
            parts.append(F.lit("%"))
            continue
        t = at(n)
        n += 1
        made = None if t is None else _formatted(m, t)
        if made is None:
            return UNDEFINED
        parts.append(made)
    if "%" in f.const[done:]:
        return UNDEFINED
    parts.append(F.lit(f.const[done:]))
    return cell(STRING, *used, col=only_if_defined(F.concat(*parts), *used))


def _sprintf_column(f: Cell, args: list[Term] | Cell) -> Term:
    """A format that differs from row to row: its specifiers and what stands between them, put together one after another."""
    spec = r"%(?:%|[-+ #0]*\d*(?:\.\d+)?[a-zA-Z])"
    specs, between = F.regexp_extract_all(f.col, F.lit(spec), F.lit(0)), F.split(f.col, spec, -1)

    def piece(used: Column, found: Column) -> Column:
        if isinstance(args, Cell):
            return _formatted_by(found, cell(args.type.elementType, args, col=F.get(args.col, used)))
        out = F.lit(None).cast("string")
        for i, t in enumerate(args):
            out = F.when(used == i, _formatted_by(found, t)).otherwise(out)
        return out

    def add(state: Column, i: Column) -> Column:
        found = F.get(specs, i)
        plain = found == "%%"
        shown = F.when(plain, F.lit("%")).otherwise(piece(state["used"], found))
        return F.struct(F.concat(state["out"], shown, F.get(between, i + 1)).alias("out"), (state["used"] + F.when(plain, 0).otherwise(1)).alias("used"))

    start = F.struct(F.get(between, F.lit(0)).alias("out"), F.lit(0).alias("used"))
    upto = F.when(F.size(specs) > 0, F.sequence(F.lit(0), F.size(specs) - 1)).otherwise(F.array().cast("array<int>"))
    made = F.aggregate(upto, start, add, lambda state: state["out"])
    stray = F.exists(between, lambda x: F.contains(x, F.lit("%")))
    uses = args if isinstance(args, list) else [args]
    return cell(STRING, f, *uses, col=only_if_defined(F.when(~stray, made), f, *uses))


def _formatted_by(found: Column, t: Term) -> Column:
    """A term shown by a specifier that is a column."""
    how, out = F.substring(found, -1, 1), F.lit(None).cast("string")
    width = F.call_function("nullif", F.regexp_extract(found, r"^%[-+ #0]*(\d+)", 1), F.lit(""))
    zero = F.regexp_like(found, F.lit("^%[-+ #]*0"))
    shown = text(t)
    if shown is not None:
        flags = F.regexp_replace(found, r"^%([-+ #0]*)", "%")
        left = F.regexp_like(found, F.lit("^%[+ #0]*-"))
        as_text = F.call_function("format_string", F.when(left, F.concat(F.lit("%-"), F.substring(flags, F.lit(2), F.length(flags)))).otherwise(flags), shown)
        out = F.when((how == "s") & shown.isNotNull(), F.when(found == "%s", shown).otherwise(as_text)).otherwise(out)
    c = _as_number(t)
    if c is None:
        return out
    n = (c.col if isinstance(c.type, WHOLE) else F.floor(c.col)).cast("long")
    format_ = lambda spec, x: F.when(x.isNotNull(), F.call_function("format_string", spec, x))
    whole = F.regexp_replace(F.regexp_replace(found, r"\.\d+", ""), "i$", "d")
    real = F.when(F.contains(found, F.lit(".")), found).otherwise(F.concat(F.substring(found, F.lit(1), F.length(found) - 1), F.lit(".6"), how))
    padded = F.when(width.isNull(), F.bin(n)).otherwise(F.lpad(F.bin(n), F.greatest(width.cast("int"), F.length(F.bin(n))), F.when(zero, "0").otherwise(" ")))
    return F.when(how.isin("d", "i"), format_(whole, n)).when(how.isin("f", "e", "E", "g", "G"), format_(real, c.col.cast("double"))).when(how.isin("x", "X", "o"), format_(whole, n)).when(how == "b", padded).otherwise(out)


def _as_number(t: Term) -> Cell | None:
    """What a numeric specifier shows: a number, or text that is one."""
    c = as_kind(t, "number")
    if c is None and kind(t) == "string":
        return to_number(t)
    if c is not None and kind(t) is None:
        other = to_number(from_variant(t, "string"))
        return cell(DOUBLE, c, col=F.coalesce(c.col, other.col))
    return c


def _formatted(m: re.Match, t: Term) -> Column | None:
    flags, width, digits, how = m[1], m[2] or "", m[3], m[4]
    places = "" if digits is None else f".{digits}"
    if how == "s":
        shown = text(t)
        if shown is None:
            raise UnsupportedPlan("a format shows a value without a text form")
        plain = not (flags or width or places)
        return shown if plain else F.when(shown.isNotNull(), F.format_string(f"%{re.sub('[^-]', '', flags)}{width}{places}s", shown))
    c = _as_number(t)
    if c is None:
        return None
    n = c.col if isinstance(c.type, WHOLE) else F.floor(c.col)
    if how in "di":
        return n.cast("long").cast("string") if not (flags or width) else F.when(n.isNotNull(), F.format_string(f"%{flags}{width}d", n.cast("long")))
    if how in "feEgG":
        return F.when(c.col.isNotNull(), F.format_string(f"%{flags}{width}{places or '.6'}{how}", c.col.cast("double")))
    if how in "xXo":
        return F.when(n.isNotNull(), F.format_string(f"%{flags}{width}{how}", n.cast("long")))
    if how == "b":
        return F.lpad(F.bin(n.cast("long")), int(width), "0" if "0" in flags else " ") if width else F.bin(n.cast("long"))
    return None


def text(t: Term) -> Column | None:
    """What a template shows of a term; NULL where it is undefined."""
    if isinstance(t, Null):
        return F.lit("null")
    c = solid(t)
    if c is None:
        return F.lit(None).cast("string") if t is UNDEFINED else None
    if isinstance(c.type, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_json(c.col)
    if isinstance(c.type, T.VariantType):
        return F.coalesce(F.when(F.schema_of_variant(c.col) == "STRING", F.try_variant_get(c.col, "$", "string")), F.to_json(c.col))
    return c.col.cast("string")


def format_int(x: Term, base: Term) -> Term:
    n, b = _whole(x), _whole(base)
    if n is None or b is None:
        return UNDEFINED
    inside = F.when(b.between(2, 36), b.cast("int"))
    shown = F.lower(F.call_function("conv", F.abs(n).cast("string"), F.lit(10), inside))
    return cell(STRING, x, base, col=F.when(inside.isNotNull(), F.concat(F.when(n < 0, F.lit("-")).when(n >= 0, F.lit("")), shown)))


def to_number(t: Term) -> Term:
    if (c := as_kind(t, "number")) is not None and kind(t) == "number":
        return c
    if isinstance(t, Cell) and kind(t) is None:
        return _as_number(t)
    c = as_kind(t, "string")
    if c is None:
        return UNDEFINED
    number = F.when(c.col.rlike(r"^\s*[+-]?\d+(\.\d+)?([eE][+-]?\d+)?\s*$"), c.col.try_cast("double"))
    return cell(DOUBLE, c, col=number)


def cast_string(t: Term) -> Term:
    if isinstance(t, Null):
        return constant("null")
    if kind(t) is None:
        return cell(STRING, t, col=F.when(~F.coalesce(type_name(t).col, F.lit("array")).isin("array", "object"), text(t)))
    return cell(STRING, t, col=text(t)) if kind(t) in ("string", "number", "boolean") else UNDEFINED


def cast_boolean(t: Term) -> Term:
    k = kind(t)
    if k == "boolean":
        return t
    if k is None:
        parts = [from_variant(t, "boolean"), *(cast_boolean(from_variant(t, w)) for w in ("string", "number"))]
        return boolean(F.coalesce(*(p.col for p in parts)), t)
    if k == "string":
        s = F.lower(F.regexp_replace(solid(t).col, r"^[\x00\s]+|[\x00\s]+$", ""))
        return boolean(F.when(s == "true", True).when(s == "false", False), t)
    if k == "number":
        n = solid(t).col
        return boolean(F.when(n == 1, True).when(n == 0, False), t)
    return UNDEFINED


def as_set(t: Term) -> Term:
    if isinstance(t, Items):
        return Items(t.items, True)
    if kind(t) == "set":
        return t
    if kind(t) not in ("array", None):
        return UNDEFINED
    c = _list(t)
    return cell(c.type, c, col=as_members(c.col, c.type.elementType), is_set=True)


def as_array(t: Term) -> Term:
    if kind(t) == "array":
        return t
    if kind(t) is None:
        return as_kind(t, "array")
    c = solid(t) if kind(t) == "set" else None
    return UNDEFINED if c is None else cell(c.type, c, col=c.col)


def type_name(t: Term) -> Term:
    k = kind(t)
    if k == "undefined":
        return UNDEFINED
    if k is not None:
        return cell(STRING, t, col=only_if_defined(F.lit(k), t))
    # The schema is computed once: its first word decides.
    names = F.create_map(*map(F.lit, ("VOID", "null", "STRING", "string", "BOOLEAN", "boolean", "OBJECT", "object", "ARRAY", "array")))
    found = F.coalesce(F.try_element_at(names, F.regexp_extract(F.schema_of_variant(t.col), "^[A-Z]+", 0)), F.lit("number"))
    return cell(STRING, t, col=F.when(t.col.isNotNull(), found))


def _is(name: str) -> Callable:
    def build(t: Term) -> Term:
        k = kind(t)
        if k == "undefined":
            return UNDEFINED
        return boolean(type_name(t).col == name, t) if k is None else boolean(only_if_defined(F.lit(k == name), t), t)

    return build


def count(t: Term) -> Term:
    if isinstance(t, Fields) and t.row or isinstance(t, Cell) and isinstance(t.type, T.StructType):
        fields = t if isinstance(t, Fields) else opened(t)
        held = [F.lit(1) if (d := defined(x)) is None else F.when(d, 1).otherwise(0) for x in fields.fields.values()]
        n = F.lit(0)
        for h in held:
            n = n + h
        return cell(LONG, t, col=only_if_defined(n.cast("long"), t))
    if isinstance(t, (Items, Fields)):
        items = t.items if isinstance(t, Items) else t.fields
        if isinstance(t, Items) and t.is_set and len(items) > 1:
            t = solid(t)
            if t is None:
                raise UnsupportedPlan("a set of mixed values has no column form")
        else:
            return constant(len(items)) if (d := defined(t)) is None else cell(LONG, t, col=F.when(d, F.lit(len(items)).cast("long")))
    k = kind(t)
    if k is None and isinstance(t, Cell):
        s, a, o = (from_variant(t, w).col for w in ("string", "array", "object"))
        return cell(LONG, t, col=F.coalesce(F.char_length(s), F.when(a.isNotNull(), F.size(a)), F.when(o.isNotNull(), F.size(o))).cast("long"))
    if k == "string":
        return cell(LONG, t, col=F.char_length(t.col).cast("long"))
    if k in ("array", "set", "object"):
        return cell(LONG, t, col=F.when(t.col.isNotNull(), F.size(t.col).cast("long")))
    return UNDEFINED


def _numbers(t: Term) -> Cell | None:
    c = _list(t)
    if c is not None and isinstance(c.type.elementType, T.VariantType):
        return _each(c, "number")
    return c if c is not None and (isinstance(c.type.elementType, T.NullType) or kind(Cell(c.col, c.type.elementType)) == "number") else None


def total(t: Term) -> Term:
    if isinstance(t, Items) and not t.is_set:
        cells = [as_kind(x, "number") for x in t.items]
        if None in cells:
            return UNDEFINED
        type_ = widest([LONG, *(c.type for c in cells)])
        out = F.lit(0).cast(type_)
        for c in cells:
            out = out + c.col
        return cell(type_, *cells, col=out)
    c = _numbers(t)
    if c is None:
        return UNDEFINED
    type_ = widest([LONG, c.type.elementType])
    return cell(type_, c, col=F.aggregate(c.col, F.lit(0).cast(type_), lambda a, x: a + x))


def _extreme(fn: Callable) -> Callable:
    def build(t: Term) -> Term:
        c = _numbers(t)
        return UNDEFINED if c is None or isinstance(c.type.elementType, T.NullType) else cell(c.type.elementType, c, col=fn(c.col))

    return build


def _quantified(fn: Callable) -> Callable:
    def build(t: Term) -> Term:
        if isinstance(t, Items) and not t.is_set:
            parts = [F.lit(True) if (p := truthy(x)) is None else F.coalesce(p, F.lit(False)) for x in t.items]
            return boolean(only_if_defined(fn(F.array(*parts).cast("array<boolean>"), lambda x: x), t), t)
        c = _list(t)
        if c is None:
            return UNDEFINED
        if isinstance(c.type.elementType, T.VariantType):
            return boolean(fn(c.col, lambda x: F.coalesce(truthy(Cell(x, VARIANT)), F.lit(False))), c)
        if not isinstance(c.type.elementType, T.BooleanType):
            return boolean(fn(c.col, lambda x: x.isNotNull()), c)
        return boolean(fn(c.col, lambda x: F.coalesce(x, F.lit(False))), c)

    return build


def sort(t: Term) -> Term:
    c = _list(t)
    if c is None:
        return UNDEFINED
    if isinstance(c.type.elementType, T.VariantType):
        ordered = lambda a: F.transform(F.array_sort(F.transform(a.col, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda e: F.get(c.col, e["i"]))
        return cell(c.type, c, col=F.coalesce(ordered(_each(c, "number")), ordered(_each(c, "string"))))
    if isinstance(c.type.elementType, T.NullType):
        return c
    return cell(c.type, c, col=F.array_sort(c.col)) if kind(Cell(c.col, c.type.elementType)) in ("number", "string") else UNDEFINED


def reverse(t: Term) -> Term:
    c = _list(t)
    return UNDEFINED if c is None else cell(c.type, c, col=F.reverse(c.col))


def array_concat(a: Term, b: Term) -> Term:
    x, y = _list(a), _list(b)
    if x is None or y is None:
        return UNDEFINED
    for p, q in ((x, y), (y, x)):
        if isinstance(p.type.elementType, T.NullType):
            return cell(q.type, a, b, col=only_if_defined(q.col, a, b))
    if kind(Cell(x.col, x.type.elementType)) != kind(Cell(y.col, y.type.elementType)):
        x, y = (from_variant(variant(c), "array") for c in (x, y))
    type_ = T.ArrayType(widest([x.type.elementType, y.type.elementType]))
    return cell(type_, x, y, col=F.concat(x.col.cast(type_), y.col.cast(type_)))


def array_slice(t: Term, start: Term, stop: Term) -> Term:
    c = _list(t)
    ends = [integer(x) for x in (start, stop)]
    if c is None or None in ends:
        return UNDEFINED
    lo, hi = (F.when(e.col.isNotNull(), x) for e, x in zip(ends, (F.greatest(ends[0].col, F.lit(0)), F.least(ends[1].col, F.size(c.col))), strict=True))
    return cell(c.type, c, *ends, col=F.slice(c.col, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")))


def _sets(fn: Callable[..., Column]) -> Callable:
    def build(a: Term, b: Term) -> Term:
        if kind(a) != "set" or kind(b) != "set":
            return UNDEFINED
        x, y = solid(a), solid(b)
        if x is None or y is None:
            raise UnsupportedPlan("a set of mixed values has no column form")
        for p, q in ((x, y), (y, x)):
            if isinstance(p.type.elementType, T.NullType):
                p_of = F.array().cast(q.type)
                left, right = (p_of, q.col) if p is x else (q.col, p_of)
                return cell(q.type, x, y, col=F.array_sort(fn(left, right)), is_set=True)
        if kind(Cell(x.col, x.type.elementType)) != kind(Cell(y.col, y.type.elementType)):
            lists = [variant(replace(c, is_set=False)) for c in (x, y)]
            if None in lists:
                raise UnsupportedPlan("sets of such values have no column form together")
            x, y = (from_variant(c, "array") for c in lists)
        type_ = T.ArrayType(widest([x.type.elementType, y.type.elementType]))
        return cell(type_, x, y, col=set_operation(fn, x.col.cast(type_), y.col.cast(type_), type_.elementType), is_set=True)

    return build


def union(a: Term, b: Term) -> Term:
    if isinstance(a, Fields) and isinstance(b, Fields) and not a.row and not b.row:
        same = [equal(a.fields[k], b.fields[k]) for k in sorted(a.fields.keys() & b.fields.keys())]
        if any(isinstance(s, Cell) and s.const is False for s in same):
            return UNDEFINED
        out = Fields({**a.fields, **b.fields})
        if not same:
            return out
        c = solid(out)
        if c is not None:
            held = same[0].col
            for s in same[1:]:
                held = held & s.col
            return cell(c.type, c, col=F.when(held, c.col))
    if {kind(a), kind(b)} <= {"object", None}:
        x, y = _maps(a, b)
        entries = lambda c: F.map_entries(c.col)
        of = lambda e: Cell(e, x.type.valueType)
        clash = F.exists(entries(y), lambda e: F.map_contains_key(x.col, e["key"]) & ~F.coalesce(equal(of(F.try_element_at(x.col, e["key"])), of(e["value"])).col, F.lit(False)))
        return cell(x.type, x, y, col=F.when(~clash, F.map_concat(F.map_filter(x.col, lambda k, _: ~F.map_contains_key(y.col, k)), y.col)))
    if None in (kind(a), kind(b)):
        return UNDEFINED  # a set is no document
    return _sets(F.array_union)(a, b)


def _map(t: Term) -> Cell:
    c = mapping(t)
    if c is None:
        raise UnsupportedPlan("an object of such values has no column form")
    return c


def _maps(a: Term, b: Term) -> tuple[Cell, Cell]:
    """Two objects as maps of one type."""
    x, y = _map(a), _map(b)
    if x.type != y.type:
        if kind(Cell(x.col, x.type.keyType)) != kind(Cell(y.col, y.type.keyType)) or not isinstance(x.type.keyType, T.StringType):
            raise UnsupportedPlan("objects of different keys have no column form together")
        x, y = (_of_variants(c) for c in (x, y))
    return x, y


def _of_variants(c: Cell) -> Cell:
    of = c.type.valueType
    if isinstance(of, T.VariantType):
        return c
    return cell(T.MapType(STRING, VARIANT), c, col=F.transform_values(c.col, lambda _, v: variant(Cell(v, of)).col))


def _found(t: Term, key: Term) -> Term:
    """The value of a key that may be a column."""
    fields = t if isinstance(t, Fields) else opened(t) if isinstance(t, Cell) and isinstance(t.type, T.StructType) else None
    if fields is not None and isinstance(key, Cell) and key.const is not None:
        return fields.fields.get(key.const, UNDEFINED) if isinstance(key.const, str) else UNDEFINED
    m = _map(t)
    k = as_kind(key, kind(Cell(m.col, m.type.keyType)))
    return UNDEFINED if k is None else cell(m.type.valueType, t, key, col=F.try_element_at(m.col, k.col))


def object_get(t: Term, key: Term, default: Term) -> Term:
    if kind(t) not in ("object", None):
        return UNDEFINED
    found = _found(t, key)
    if isinstance(found, Undefined):
        return default if kind(t) == "object" else _or_else(cell(VARIANT, t, col=F.lit(None).cast("variant")), default, t)
    if defined(found) is None:
        return found
    return _or_else(found, default, t)


def _or_else(found: Term, default: Term, held: Term) -> Term:
    f, d = solid(found), solid(default)
    if f is None or d is None or kind(d) != kind(f) or kind(f) in ("object", "array") and f.type != d.type:
        f, d = variant(found), variant(default)
        if f is None or d is None:
            raise UnsupportedPlan("a found value and its default have no column form together")
    type_ = widest([f.type, d.type])
    made = F.coalesce(f.col.cast(type_), d.col.cast(type_))
    if kind(held) is None:  # what is no object has no keys
        made = F.when(from_variant(held, "object").col.isNotNull(), made)
    return cell(type_, found, default, held, col=made, is_set=f.is_set)


def object_keys(t: Term) -> Term:
    if isinstance(t, Fields) and not t.row:
        return Items(tuple(constant(k) for k in sorted(t.fields)), True) if defined(t) is None else cell(T.ArrayType(STRING), t, col=only_if_defined(F.array(*map(F.lit, sorted(t.fields))).cast("array<string>"), t), is_set=True)
    fields = t if isinstance(t, Fields) else opened(t) if isinstance(t, Cell) and isinstance(t.type, T.StructType) else None
    if fields is not None:
        names = [F.lit(k) if (d := defined(x)) is None else F.when(d, F.lit(k)) for k, x in sorted(fields.fields.items())]
        return cell(T.ArrayType(STRING), t, col=only_if_defined(F.array_compact(F.array(*names)).cast("array<string>"), t), is_set=True)
    if kind(t) not in ("object", None):
        return UNDEFINED
    m = _map(t)
    return cell(T.ArrayType(m.type.keyType), m, col=F.array_sort(F.map_keys(m.col)), is_set=True)


def object_remove(t: Term, keys: Term) -> Term:
    if kind(keys) not in ("array", "set", None) or kind(t) not in ("object", None):
        return UNDEFINED
    fields = t if isinstance(t, Fields) else opened(t) if isinstance(t, Cell) and isinstance(t.type, T.StructType) else None
    if fields is not None and isinstance(keys, Items) and all(isinstance(k, Cell) and k.const is not None for k in keys.items) and (not isinstance(t, Cell)):
        gone = {k.const for k in keys.items}
        return Fields({k: x for k, x in fields.fields.items() if k not in gone}, t.row)
    m = _map(t)
    c = solid(keys) if kind(keys) == "set" else _list(keys)
    if c is None:
        raise UnsupportedPlan("keys of mixed kinds have no column form")
    of = c.type.elementType
    if isinstance(of, T.NullType):
        return m
    same = lambda k: F.exists(c.col, lambda x: F.coalesce(equal(Cell(x, of), Cell(k, m.type.keyType)).col, F.lit(False)))
    return cell(m.type, m, c, col=F.when(c.col.isNotNull(), F.map_filter(m.col, lambda k, _: ~same(k))))


def as_object(t: Term) -> Term:
    return t if kind(t) == "object" else as_kind(t, "object") if kind(t) is None else UNDEFINED


def set_of(*args: Term) -> Term:
    return as_set(args[0]) if args else Items((), True)


#: Name: function of terms. Their numbers of arguments are those of the document functions.
COLUMNS: dict[str, Callable[..., Term]] = {
    **{f"is_{k}": _is(k) for k in ("string", "number", "boolean", "array", "object", "set", "null")},
    "type_name": type_name,
    "equal": equal,
    "to_number": to_number,
    "cast_string": cast_string,
    "cast_boolean": cast_boolean,
    "cast_array": as_array,
    "cast_set": as_set,
    "cast_object": as_object,
    "count": count,
    "sum": total,
    "max": _extreme(F.array_max),
    "min": _extreme(F.array_min),
    "all": _quantified(F.forall),
    "any": _quantified(F.exists),
    "concat": concat,
    "contains": _strings(F.contains, T.BooleanType()),
    "startswith": _strings(F.startswith, T.BooleanType()),
    "endswith": _strings(F.endswith, T.BooleanType()),
    "indexof": _strings(lambda s, p: (F.call_function("instr", s, p) - 1).cast("long"), LONG),
    "lower": _strings(F.lower),
    "upper": _strings(F.upper),
    "split": split,
    "substring": substring,
    "trim": _trimmed("btrim"),
    "trim_left": _trimmed("ltrim"),
    "trim_right": _trimmed("rtrim"),
    "trim_space": _strings(lambda s: F.regexp_replace(s, r"^[\x00\s]+|[\x00\s]+$", "")),
    "sprintf": sprintf,
    "format_int": format_int,
    "sort": sort,
    "array.reverse": reverse,
    "array.concat": array_concat,
    "array.slice": array_slice,
    "union": union,
    "intersection": _sets(F.array_intersect),
    "set_diff": _sets(F.array_except),
    "set": set_of,
    "object.get": object_get,
    "object.keys": object_keys,
    "object.remove": object_remove,
}
