"""The public interface: parse, compile, evaluate one document, decide rows, read relations."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .document import Evaluator
from .functions import values as v
from .functions.columns import COLUMNS
from .functions.documents import BUILTINS
from .lang.errors import CompileError, EvaluationError, PolicyError, UnsupportedPlan
from .lang.nodes import Module, Node
from .lang.parser import parse, parse_expression
from .operators.lowering import Collection, Deferred, NeedsRelation, RowBody, Scope, World, clause, complete_relation, set_relation
from .operators.terms import UNDEFINED, Cell, Fields, Term, Undefined, constant, defined, row, solid, variant, widest
from .plans.analysis import Compiled, compile_module
from .sources.catalog import Catalog
from .sources.workers import ship_package


@dataclass(frozen=True)
class Result:
    """A decision over one document. ``value`` is Python data."""

    value: object = None
    bindings: dict = field(default_factory=dict)
    success: bool = True
    errors: tuple[PolicyError, ...] = ()

    def to_dict(self) -> dict:
        return {"value": _json(self.value), "bindings": {k: _json(x) for k, x in sorted(self.bindings.items())}, "success": self.success, "errors": [e.to_dict() if isinstance(e, PolicyError) else {"message": str(e)} for e in self.errors]}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False)


def _columns(t: Term, *, strict: bool = True) -> dict[str, Cell] | None:
    """The columns of a decision: one for each field of an object, or ``v``. Values of several types are variants."""
    cells = {k: solid(x) or variant(x) for k, x in t.fields.items()} if isinstance(t, Fields) else {"v": solid(t) or variant(t)}
    if all(c is not None for c in cells.values()):
        void = T.ArrayType(T.NullType())  # an array that surely is empty; files have no such type
        return {k: replace(c, col=c.col.cast("array<string>"), type=T.ArrayType(T.StringType())) if c.type.simpleString() == void.simpleString() else c for k, c in cells.items()}
    if strict:
        raise UnsupportedPlan("a decision of such values has no column form")
    return None


def _json(x: object) -> object:
    return v.plain(v.value(x))


class Policy:
    """A compiled policy; it is immutable and serves any number of documents, batches and streams."""

    def __init__(self, text: str | Module, *, functions: dict[str, Registered] | None = None) -> None:
        self.compiled: Compiled = compile_module(parse(text) if isinstance(text, str) else text)
        self.functions = dict(functions or {})

    @property
    def package(self) -> str:
        return ".".join(self.compiled.package)

    @property
    def rules(self) -> list[str]:
        return self.compiled.names()

    @property
    def dependencies(self) -> dict[str, frozenset[str]]:
        return self.compiled.depends

    # -- one document
    def evaluate(self, input: object = None, data: object = None, query: str | Node | None = None) -> Result | None:
        """The value of a query over one document, or None if it is undefined.

        A query is an expression; ``data.<package>.<rule>`` and the bare name of a rule are two. Without one all
        rules that have a value are evaluated.
        """
        e = Evaluator.of(self.compiled, input, data, {n: (f.counts, f.value) for n, f in self.functions.items() if f.value is not None})
        value, bindings = e.query(parse_expression(query) if isinstance(query, str) else query)
        if value is None:
            return None
        return Result(v.python(value), {k: v.python(x) for k, x in bindings.items()})

    # -- rows
    def decide(self, df: DataFrame, rule: str, *, keys: list[str], catalog: Catalog | None = None) -> DataFrame:
        """A row (keys, value) for each input row for which ``rule`` has a value; a stream works as well.

        The columns of ``df`` are the fields of ``input``. The value's column is ``v``, an object's fields have a
        column each. Rules that read the row alone become expressions; others join the catalog's tables, and
        there ``keys`` must tell the rows apart.
        """
        w = self._world(df.sparkSession, catalog, row(df))
        try:
            only = self._single_clause(rule, w)
            if only is not None:  # its condition is a plain filter, which reaches the scan
                cond, t = only
                df = df if cond is None else df.where(cond)
                cells = _columns(t)
                return df.select(*keys, *[c.col.alias(k) for k, c in cells.items()])
            t = RowBody((), Scope({}, w)).rule(rule, w)
            if isinstance(t, Collection):
                raise NeedsRelation
        except (NeedsRelation, UnsupportedPlan):
            return self._joined(df, rule, keys, w)
        if isinstance(t, Undefined):
            return df.select(*keys, F.lit(None).cast("string").alias("v")).where("false")
        d = defined(t)
        held = df if d is None else df.where(d)
        return held.select(*keys, *[c.col.alias(k) for k, c in _columns(t).items()])

    def _single_clause(self, rule: str, w: World) -> tuple | None:
        """Condition and value of a complete rule of one clause, if it reads the row alone."""
        clauses = self.compiled.rules.get(rule, ())
        if len(clauses) != 1 or rule in self.compiled.defaults or clauses[0].kind != "complete" or clauses[0].orelse:
            return None
        found = clause(clauses[0], Scope({}, w), [])
        if not found or isinstance(found[0][1], (Collection, Deferred)):
            return None
        t = found[0][1]
        return found[0] if _columns(t, strict=False) is not None else None

    def _joined(self, df: DataFrame, rule: str, keys: list[str], w: World) -> DataFrame:
        if self.compiled.kind(rule) == "set":
            return set_relation(rule, w, df, tuple(keys))
        if self.compiled.kind(rule) != "complete":
            raise CompileError(f"rule {rule} over tables and rows is no complete rule")
        found, value = complete_relation(rule, w, df, tuple(keys))
        default = self.compiled.defaults.get(rule)
        if default is None:
            return found
        if isinstance(value, Fields):
            raise CompileError("a default of an object rule over tables has no plan")
        d = solid(RowBody((), Scope({}, w)).term(default.value, Scope({}, w)))
        type_ = widest([value.type, d.type])
        return df.select(*keys).join(found, keys, "left").select(*keys, F.coalesce(F.col("v").cast(type_), d.col.cast(type_)).alias("v"))

    # -- relations
    def relation(self, spark: SparkSession, rule: str, catalog: Catalog) -> DataFrame:
        """The rows of a rule over the catalog's tables.

        A set gives ``value`` or a column for each key of its objects, an object ``key`` and ``value`` (nested
        heads ``k1``, ``k2``, ... and ``v``), any other value one row.
        """
        w = self._world(spark, catalog, UNDEFINED)
        try:
            t: Term = RowBody((), Scope({}, w)).rule(rule, w)
        except NeedsRelation:
            df, _ = complete_relation(rule, w)
            return df
        if isinstance(t, Collection):
            if t.kind == "array" and isinstance(t.value, Cell):
                return t.df.select(t.value.col.alias("value"))
            return t.df.drop(*t.by)
        one = spark.range(1)
        if isinstance(t, Fields):
            return one.select(*[c.col.alias(k) for k, c in _columns(t).items()])
        if isinstance(t, Undefined):
            return one.select(F.lit(None).cast("string").alias("v")).where("false")
        return one.select(_columns(t)["v"].col.alias("v")).where("v is not null")

    def verify(self, spark: SparkSession, catalog: Catalog) -> None:
        """Run every relation once, so that all conflict checks are made; a lazy read makes only those it touches."""
        for name in self.compiled.order:
            if self.compiled.kind(name) != "function":
                self.relation(spark, name, catalog).write.format("noop").mode("overwrite").save()

    def explain(self, spark: SparkSession, rule: str, catalog: Catalog) -> str:
        """The physical plan of a relation."""
        df = self.relation(spark, rule, catalog)
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    # -- documents without a common schema
    def decide_documents(self, df: DataFrame, query: str, *, json_col: str, keys: list[str], data: object = None) -> DataFrame:
        """The query's value, as JSON text, for each row's JSON document; undefined decisions have no row.

        For documents that share no schema: they are evaluated one by one in Arrow batches.
        """
        compiled, functions, node = self.compiled, {n: (f.counts, f.value) for n, f in self.functions.items() if f.value is not None}, parse_expression(query)

        def run(batches):
            for batch in batches:
                out, kept = [], []
                for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    value, _ = Evaluator.of(compiled, json.loads(text) if text is not None else None, data, functions).query(node)
                    if value is not None:
                        kept.append(i)
                        out.append(json.dumps(v.plain(value), ensure_ascii=False, sort_keys=True))
                rows = batch.take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(out, pa.string())], [*keys, "v"])

        ship_package(df.sparkSession)
        slim = df.select(*keys, F.col(json_col))
        return slim.mapInArrow(run, T.StructType([*(slim.schema[k] for k in keys), T.StructField("v", T.StringType())]))

    def _world(self, spark: SparkSession, catalog: Catalog | None, input: Term) -> World:
        columns = COLUMNS | {n: f.column for n, f in self.functions.items() if f.column is not None}
        return World(self.compiled, catalog or Catalog(), spark, input, columns=columns)


@dataclass(frozen=True)
class Registered:
    """A function of one's own: over document values, over terms of columns, or both."""

    counts: tuple[int, ...]
    value: Callable | None = None
    column: Callable[..., Term] | None = None


class Functions:
    """A table of own functions to compile policies with."""

    def __init__(self) -> None:
        self.entries: dict[str, Registered] = {}

    def register(self, name: str, counts: int | tuple[int, ...], *, value: Callable | None = None, column: Callable | None = None) -> None:
        """``value`` maps Python data to Python data (None: undefined); ``column`` maps terms to a term."""
        if name in BUILTINS or name in self.entries:
            raise CompileError(f"function {name} is already registered")
        wrapped = None if value is None else lambda *xs: None if (y := value(*map(v.python, xs))) is None else v.value(y)
        self.entries[name] = Registered((counts,) if isinstance(counts, int) else tuple(counts), wrapped, column)


def compile(text: str, functions: Functions | None = None) -> Policy:
    return Policy(text, functions=functions.entries if functions else None)


def evaluate(text: str, input: object = None, data: object = None, query: str | None = None) -> Result | None:
    """Compile a policy and evaluate a query over one document."""
    return Policy(text).evaluate(input, data, query)


__all__ = ["Catalog", "EvaluationError", "Functions", "Policy", "Result", "compile", "constant", "evaluate", "parse"]
