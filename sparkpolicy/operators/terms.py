"""Terms: what an expression of a policy is while its plan is built.

SQL NULL stands for undefined. A term's type is known, so that a comparison across types is decided here and
Spark never coerces. ``uses`` names the columns that a term reads, which tells apart what is bound inside of
a subquery from what comes from outside of it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.errors import UnsupportedPlan


class Term:
    uses: frozenset[str] = frozenset()


class Undefined(Term):
    """Known to have no value."""


@dataclass(frozen=True)
class Null(Term):
    """The literal null."""


@dataclass(frozen=True, eq=False)
class Cell(Term):
    """A column; ``is_set`` marks an array that is kept sorted and distinct; ``const`` is a literal's value."""

    col: Column
    type: T.DataType
    uses: frozenset[str] = frozenset()
    is_set: bool = False
    const: object = None


@dataclass(frozen=True, eq=False)
class Items(Term):
    """An array or set written out."""

    items: tuple[Term, ...]
    is_set: bool = False

    @property
    def uses(self) -> frozenset[str]:
        return frozenset().union(*(x.uses for x in self.items))


@dataclass(frozen=True, eq=False)
class Fields(Term):
    """An object of known keys. One written out has a value only if all its cells have; a ``row`` has one where ``held`` is true."""

    fields: dict[str, Term]
    row: bool = False
    held: Column | None = None

    @property
    def uses(self) -> frozenset[str]:
        return frozenset().union(*(x.uses for x in self.fields.values()))


@dataclass(frozen=True, eq=False)
class Collection(Term):
    """The rows of a relation as an array, set or object. ``empty_undefined``: without a row it is undefined.

    ``values_of`` tells that the rows are the distinct values of a column of another relation, without a filter; ``by``
    names the columns that the rows are in order of.
    """

    df: DataFrame
    value: Term
    kind: str
    key: Term | None = None
    order: str | None = None
    empty_undefined: bool = False
    values_of: tuple[DataFrame, str] | None = None
    by: tuple[str, ...] = ()


@dataclass(frozen=True, eq=False)
class Deferred(Term):
    """A comprehension over tables that is planned once its use is known. ``build`` takes a context."""

    node: object
    scope: object
    memo: dict = field(default_factory=dict)


UNDEFINED = Undefined()
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def kind(t: Term) -> str | None:
    """The value type of a term as far as it is known: a variant has None."""
    if isinstance(t, Null):
        return "null"
    if isinstance(t, Items):
        return "set" if t.is_set else "array"
    if isinstance(t, Fields):
        return "object"
    if isinstance(t, (Collection, Deferred)):
        return t.kind if isinstance(t, Collection) else t.node.kind
    if isinstance(t, Cell):
        for name, types in (("number", NUMBERS), ("string", T.StringType), ("boolean", T.BooleanType), ("object", (T.StructType, T.MapType)), ("array", T.ArrayType)):
            if isinstance(t.type, types):
                return "set" if t.is_set else name
        return None if isinstance(t.type, T.VariantType) else "extension"
    return "undefined"


def constant(x: object) -> Term:
    """The term of JSON data."""
    if x is None:
        return Null()
    if isinstance(x, bool):
        return Cell(F.lit(x), T.BooleanType(), const=x)
    if isinstance(x, int):
        if -(1 << 63) <= x < 1 << 63:
            return Cell(F.lit(x).cast("long"), T.LongType(), const=x)
        return Cell(F.lit(str(x)).cast("decimal(38,0)"), T.DecimalType(38, 0), const=x)
    if isinstance(x, float):
        return Cell(F.lit(x), T.DoubleType(), const=x)
    if isinstance(x, str):
        return Cell(F.lit(x), T.StringType(), const=x)
    if isinstance(x, (list, tuple)):
        return Items(tuple(map(constant, x)))
    if isinstance(x, (set, frozenset)):
        return Items(tuple(map(constant, sorted(x))), True)
    return Fields({str(k): constant(v) for k, v in x.items()})


def cell(type_: T.DataType, *uses: Term, col: Column, is_set: bool = False) -> Cell:
    return Cell(col, type_, frozenset().union(*(u.uses for u in uses)), is_set)


VARIANT = T.VariantType()


def row(df: DataFrame, names: dict[str, str] | None = None) -> Fields:
    """The columns of ``df`` as an object; ``names`` maps fields to columns."""
    names = names or {c: c for c in df.columns}
    return Fields({f: Cell(F.col(f"`{c}`"), df.schema[c].dataType, frozenset([c])) for f, c in names.items()}, row=True)


def solid(t: Term) -> Cell | None:
    """A term as one column; None for what has no column form."""
    if isinstance(t, Cell):
        return t
    if isinstance(t, Items):
        cells = [solid(x) for x in t.items]
        if any(c is None for c in cells):
            cells = [variant(x) for x in t.items]
        if any(c is None for c in cells):
            return None
        if not cells:
            return cell(T.ArrayType(T.NullType()), col=F.array(), is_set=t.is_set)
        if len({kind(c) for c in cells}) > 1 or any(isinstance(c.type, (T.ArrayType, T.MapType, T.StructType)) and c.type != cells[0].type for c in cells):
            cells = [variant(x) for x in t.items]
            if any(c is None for c in cells):
                return None
        type_ = widest([c.type for c in cells])
        made = F.array(*(c.col.cast(type_) for c in cells))
        made = as_members(made, type_) if t.is_set else made
        return cell(T.ArrayType(type_), *cells, col=F.when(all_defined(cells), made), is_set=t.is_set)
    if isinstance(t, Fields):
        cells = {k: solid(x) for k, x in t.fields.items()}
        if any(c is None for c in cells.values()):
            return None
        type_ = T.StructType([T.StructField(k, c.type) for k, c in cells.items()])
        held = (F.lit(True) if t.held is None else t.held) if t.row else all_defined(list(cells.values()))
        return cell(type_, *cells.values(), col=F.when(held, F.struct(*(c.col.alias(k) for k, c in cells.items()))))
    return None


def variant(t: Term) -> Cell | None:
    """A term as a variant, for values of several types; None for sets and what has no column form. Absent keys stay absent."""
    if isinstance(t, Items) and t.is_set:
        return None
    if isinstance(t, Null):
        return Cell(F.parse_json(F.lit("null")), VARIANT)
    if isinstance(t, Items):
        cells = [None if t.is_set else variant(x) for x in t.items]
        if any(c is None for c in cells):
            return None
        made = F.to_variant_object(F.array(*(c.col for c in cells)) if cells else F.array().cast("array<string>"))
        return cell(VARIANT, *cells, col=F.when(all_defined(cells), made))
    if isinstance(t, Fields):
        cells = {k: variant(x) for k, x in t.fields.items()}
        if any(c is None for c in cells.values()):
            return None
        made, held = F.to_variant_object(present(cells)), defined(t)
        return cell(VARIANT, *cells.values(), col=made if held is None else F.when(held, made))
    if not isinstance(t, Cell) or t.is_set:
        return None
    if isinstance(t.type, T.VariantType):
        return t
    if isinstance(t.type, T.StructType):
        c = variant(opened(t))
        return None if c is None else cell(VARIANT, t, col=F.when(t.col.isNotNull(), c.col))
    if isinstance(t.type, T.MapType):
        return cell(VARIANT, t, col=F.to_variant_object(t.col)) if isinstance(t.type.keyType, T.StringType) and _plain(t.type.valueType) else None
    if isinstance(t.type, T.ArrayType):
        if isinstance(t.type.elementType, T.StructType):
            return cell(VARIANT, t, col=F.to_variant_object(F.transform(t.col, lambda x: variant(Cell(x, t.type.elementType)).col)))
        return cell(VARIANT, t, col=F.to_variant_object(t.col)) if _plain(t.type.elementType) else None
    return cell(VARIANT, t, col=t.col.cast("variant"))


def _plain(type_: T.DataType) -> bool:
    """Whether a variant of this type has no absent keys that would become nulls."""
    if isinstance(type_, T.ArrayType):
        return _plain(type_.elementType)
    return not isinstance(type_, (T.StructType, T.MapType))


def as_members(col: Column, type_: T.DataType) -> Column:
    """An array as a set's: sorted and distinct. Variants, which have no order, go by their text."""
    if isinstance(type_, T.VariantType):
        return F.transform(F.array_sort(F.array_distinct(F.transform(col, _normal))), lambda x: F.parse_json(x))
    return F.array_sort(F.array_distinct(col))


def set_operation(fn, a: Column, b: Column, type_: T.DataType) -> Column:
    """A function of two sets' arrays."""
    if isinstance(type_, T.VariantType):
        return F.transform(F.array_sort(fn(F.transform(a, _normal), F.transform(b, _normal))), lambda x: F.parse_json(x))
    return F.array_sort(fn(a, b))


def opened(t: Cell) -> Fields:
    """A struct's fields; a NULL one is an absent key."""
    return Fields({n: cell(t.type[n].dataType, t, col=t.col[n]) for n in t.type.names}, row=True)


def present(cells: dict[str, Cell]) -> Column:
    """A map of the cells that have a value, which must be of one type."""
    type_ = next((c.type for c in cells.values()), VARIANT)
    of = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", type_)]))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), c.col.alias("value")) for k, c in cells.items()]) if cells else F.array().cast(of)
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def mapping(t: Term) -> Cell | None:
    """An object as a map column; the values are variants where they are of several types. None if it surely is no object."""
    if isinstance(t, Cell) and isinstance(t.type, T.MapType):
        return t
    if isinstance(t, Cell) and kind(t) is None:
        return from_variant(t, "object")
    if kind(t) != "object" or not isinstance(t, (Fields, Cell)):
        return None
    fields = t if isinstance(t, Fields) else opened(t)
    cells = {k: solid(x) for k, x in fields.fields.items()}
    if any(c is None or c.is_set for c in cells.values()) or len({(kind(c), c.type.simpleString()) for c in cells.values()}) != 1:
        cells = {k: variant(x) for k, x in fields.fields.items()}
    if any(c is None for c in cells.values()):
        return None
    type_ = next((c.type for c in cells.values()), VARIANT)
    held = defined(t)
    made = present(cells)
    return cell(T.MapType(T.StringType(), type_), t, col=made if held is None else F.when(held, made))


def widest(types: list[T.DataType]) -> T.DataType:
    if all(t == types[0] for t in types):
        return types[0]
    if all(isinstance(t, WHOLE) for t in types):
        return T.LongType()
    return T.DoubleType() if all(isinstance(t, NUMBERS) for t in types) else types[0]


def all_defined(cells: list[Cell]) -> Column:
    open_ = [c.col.isNotNull() for c in cells if c.const is None]
    found = conjunction(open_)
    return F.lit(True) if found is None else found


def defined(t: Term) -> Column | None:
    """Whether a term has a value; None if it always has."""
    if isinstance(t, Cell):
        return None if t.const is not None else t.col.isNotNull()
    if isinstance(t, Undefined):
        return F.lit(False)
    if isinstance(t, Fields) and t.row:
        return t.held
    parts = t.items if isinstance(t, Items) else list(t.fields.values()) if isinstance(t, Fields) and not t.row else []
    return conjunction([d for p in parts if (d := defined(p)) is not None])


def conjunction(parts: list[Column]) -> Column | None:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def truthy(t: Term) -> Column | None:
    """A predicate that is true where the term is truthy, else false or NULL; None if it always is."""
    if isinstance(t, (Null, Undefined)):
        return F.lit(False)
    if isinstance(t, Cell):
        if isinstance(t.type, T.BooleanType):
            return t.col if t.const is None else None if t.const else F.lit(False)
        if isinstance(t.type, T.VariantType):
            boolean = F.schema_of_variant(t.col) == "BOOLEAN"
            return t.col.isNotNull() & ~F.is_variant_null(t.col) & F.when(boolean, F.try_variant_get(t.col, "$", "boolean")).otherwise(F.lit(True))
    return defined(t)


def boolean(col: Column, *uses: Term) -> Cell:
    return cell(T.BooleanType(), *uses, col=col)


def known(x: bool) -> Cell:
    return Cell(F.lit(x), T.BooleanType(), const=x)


def only_if_defined(col: Column, *terms: Term) -> Column:
    held = conjunction([d for t in terms if (d := defined(t)) is not None])
    return col if held is None else F.when(held, col)


def equal(a: Term, b: Term) -> Cell | Undefined:
    """Deep equality; undefined where a side is."""
    if isinstance(a, Undefined) or isinstance(b, Undefined):
        return UNDEFINED
    ka, kb = kind(a), kind(b)
    if ka is None or kb is None:
        return _variant_equal(a, b)
    if ka != kb:
        return boolean(only_if_defined(F.lit(False), a, b), a, b) if not (isinstance(a, Null) and isinstance(b, Null)) else known(True)
    if ka == "null":
        return known(True)
    if isinstance(a, Items) and isinstance(b, Items) and not a.is_set:
        parts = [equal(x, y) for x, y in zip(a.items, b.items, strict=False)]
        return known(False) if len(a.items) != len(b.items) else _every(parts)
    if isinstance(a, Fields) and isinstance(b, Fields) and (a.row or b.row):
        return _every_key(a, b)
    if isinstance(a, Fields) and isinstance(b, Fields):
        return _every([equal(x, b.fields[k]) for k, x in a.fields.items()]) if a.fields.keys() == b.fields.keys() else known(False)
    x, y = solid(a), solid(b)
    if x is None or y is None:
        return known(False)
    if ka == "object":
        if isinstance(x.type, T.StructType) and isinstance(y.type, T.StructType):
            return boolean(F.when(x.col.isNotNull() & y.col.isNotNull(), _every_key(opened(x), opened(y)).col), a, b)
        x, y = mapping(x), mapping(y)
        if x is None or y is None or kind(Cell(x.col, x.type.keyType)) != kind(Cell(y.col, y.type.keyType)):
            return known(False)
        same = F.forall(F.map_entries(x.col), lambda e: F.coalesce(F.map_contains_key(y.col, e["key"]) & equal(Cell(e["value"], x.type.valueType), Cell(F.try_element_at(y.col, e["key"]), y.type.valueType)).col, F.lit(False)))
        return boolean(F.when(x.col.isNotNull() & y.col.isNotNull(), (F.size(x.col) == F.size(y.col)) & same), a, b)
    if ka in ("array", "set") and (x.type != y.type or isinstance(x.type.elementType, (T.VariantType, T.MapType))):
        u, v = x.type.elementType, y.type.elementType
        if isinstance(u, T.NullType) or isinstance(v, T.NullType):
            return boolean(F.size(x.col) == F.size(y.col), a, b)
        pairs = F.zip_with(x.col, y.col, lambda p, q: equal(Cell(p, u), Cell(q, v)).col)
        return boolean((F.size(x.col) == F.size(y.col)) & F.forall(pairs, lambda e: F.coalesce(e, F.lit(False))), a, b)
    return boolean(x.col == y.col, a, b)


def _every_key(a: Fields, b: Fields) -> Cell | Undefined:
    """Equality of objects whose absent keys are NULL."""
    out = F.lit(True)
    for k in a.fields.keys() | b.fields.keys():
        x, y = a.fields.get(k), b.fields.get(k)
        if x is None or y is None:
            d = defined(x or y)
            out = out & (F.lit(False) if d is None else ~d)
            continue
        same, dx, dy = equal(x, y), defined(x), defined(y)
        absent = F.lit(False) if dx is None or dy is None else ~dx & ~dy
        out = out & (absent | F.coalesce(same.col if isinstance(same, Cell) else F.lit(False), F.lit(False)))
    return boolean(out, a, b)


def _every(parts: list[Term]) -> Cell | Undefined:
    if any(isinstance(p, Undefined) for p in parts):
        return UNDEFINED
    out = conjunction([p.col for p in parts])
    return known(True) if out is None else boolean(out, *parts)


def _variant_equal(a: Term, b: Term) -> Cell:
    x, y = (a, b) if kind(a) is None else (b, a)
    if isinstance(y, Null):
        return boolean(F.is_variant_null(x.col), x)
    other = kind(y)
    if other is None:
        return boolean(_normal(x.col) == _normal(y.col), x, y)
    if other in ("array", "object"):
        if (same := variant(y)) is None:
            raise UnsupportedPlan("a document is compared with a value that has no variant form")
        return boolean(_normal(x.col) == _normal(same.col), x, y)
    if (own := from_variant(x, other)) is not None and isinstance(y, Cell):
        return boolean(F.when(x.col.isNotNull() & y.col.isNotNull(), F.coalesce(own.col == y.col, F.lit(False))), x, y)
    return boolean(only_if_defined(F.lit(False), x, y), x, y)


def _normal(v: Column) -> Column:
    """Variants of one text are equal, but for numbers like 1 and 1.0 below the top, of which the fraction is cut off here."""
    return F.regexp_replace(F.to_json(v), r'("(?:[^"\\\\]|\\\\.)*")|(?<=[\d])\.0+(?![\d])', "$1")


def from_variant(t: Cell, want: str) -> Cell | None:
    """A variant as a scalar of a type; undefined where it holds another."""
    schema = F.schema_of_variant(t.col)
    if want == "number":
        return cell(T.DoubleType(), t, col=F.when(schema.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"), F.try_variant_get(t.col, "$", "double")))
    if want == "string":
        return cell(T.StringType(), t, col=F.when(schema == "STRING", F.try_variant_get(t.col, "$", "string")))
    if want == "boolean":
        return cell(T.BooleanType(), t, col=F.when(schema == "BOOLEAN", F.try_variant_get(t.col, "$", "boolean")))
    if want == "array":
        return cell(T.ArrayType(VARIANT), t, col=F.try_variant_get(t.col, "$", "array<variant>"))
    if want == "object":
        return cell(T.MapType(T.StringType(), VARIANT), t, col=F.try_variant_get(t.col, "$", "map<string,variant>"))
    return None


def integer(t: Term) -> Cell | None:
    """A term as a long where it is a whole number by its type; None if it surely isn't."""
    if isinstance(t, Cell) and kind(t) is None:
        held = F.schema_of_variant(t.col).isin("TINYINT", "SMALLINT", "INT", "BIGINT")
        return cell(T.LongType(), t, col=F.when(held, F.try_variant_get(t.col, "$", "bigint")))
    return t if isinstance(t, Cell) and isinstance(t.type, WHOLE) else None


def as_kind(t: Term, want: str) -> Cell | None:
    """A scalar or array term of a type, or None if it surely has another."""
    if isinstance(t, Cell) and kind(t) is None:
        return from_variant(t, want)
    return solid(t) if kind(t) == want else None

