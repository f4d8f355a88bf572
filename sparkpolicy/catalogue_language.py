"""Queries that show the language's front end, its static checks, its decisions on single documents, the command line and streams.

Their rows are results of the engine itself: a row for each case, or for each row of a driver table.
"""

from __future__ import annotations

import contextlib
import io
import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .api import Catalog, Policy, evaluate
from .functions import values as v
from .lang.errors import PolicyError
from .query import Query
from .sources.catalog import load_document

#: Name, policy (without its package line), and the value of ``a`` as JSON text.
VALUES: tuple[tuple[str, str, str], ...] = (
    ("tokens: numbers", "a := [0, 12, 1.5, 2e3, -4, 1E-2]", "[0,12,1.5,2000.0,-4,0.01]"),
    ("tokens: strings", r'a := ["x\n\t\"\\\u0041", `raw \n`, "é"]', r'["x\n\t\"\\A","raw \\n","é"]'),
    ("tokens: comments", "# first\na := 1 # last", "1"),
    ("tokens: words", "a := [true, false, null]", "[true,false,null]"),
    ("precedence: sums", "a := 1 + 2 * 3 - 8 / 4 % 3", "5"),
    ("precedence: comparisons", "a := 1 + 1 == 2", "true"),
    ("precedence: membership", "a := 1 + 1 in [2] == true", "true"),
    ("precedence: and before or", "a := [x] if x := true or false and false", "[true]"),
    ("precedence: left", "a := 10 - 4 - 3", "3"),
    ("precedence: brackets", "a := (1 + 2) * -3", "-9"),
    ("module: old heads", "a[x] { x := 3 }", "[3]"),
    ("module: old bodies", "a = 4 { true }", "4"),
    ("module: imports", "import data.roles as r\na := r.admin", '"root"'),
    ("module: defaults and else", "default a := 1\na := 2 if false else := 3 if true", "3"),
    ("module: nested heads", 'a["x"].y := 1\na["x"].z := 2', '{"x":{"y":1,"z":2}}'),
    ("separators: lines", "a := x if {\n  y := 2\n\n  x := y + 1\n}", "3"),
    ("separators: semicolons", "a := x if { y := 2; x := y + 1; x > 2 }", "3"),
    ("separators: unbraced", "a := 1 if 1 < 2\nb := 5", "1"),
    ("some and every", "a := [i, x, y] if { some i, x in [7, 8]; x == 8; some y in [1]; every k, e in [0, 1] { k == e } }", "[1,8,1]"),
    ("with, twice", "a := x if x := input.p + data.q2 with input.p as 1 with data.q2 as 2", "3"),
)

#: Name, policy, and the error: its type and its line.
ERRORS: tuple[tuple[str, str, str, int], ...] = (
    ("one kind a name", "a := 1\na contains 2", "CompileError", 3),
    ("one arity a function", "f(x) := 1\nf(x, y) := 2", "CompileError", 3),
    ("one default", "default a := 1\ndefault a := 2", "CompileError", 3),
    ("no builtin's name", "count(x) := 1", "CompileError", 2),
    ("alias is reserved", "import data.x as input\na := 1", "CompileError", 2),
    ("alias is a rule", "import data.x as a\na := 1", "CompileError", 2),
    ("alias is unique", "import data.x as y\nimport data.z as y\na := 1", "CompileError", 3),
    ("default is ground", "default a := input.x", "CompileError", 2),
    ("variables are safe", "a := x", "CompileError", 2),
    ("negation is safe", "a if not x == 1", "CompileError", 2),
    ("no recursion", "a := b\nb := a", "CompileError", 2),
    ("no leading zero", "a := 01", "ScanError", 2),
    ("closed strings", 'a := "x', "ScanError", 2),
    ("closed brackets", "a := [1", "ParseError", 2),
)

_ORDER = "d contains m if { some c in data.customer; m := c.c_name }\ne := count(d)\nf := e + 1"


def _front_end(spark: SparkSession, _: str) -> DataFrame:
    rows = []
    for name, body, _expected in VALUES:
        found = evaluate(f"package p\n{body}", {}, {"roles": {"admin": "root"}}, "a")
        rows.append((name, None if found is None else json.dumps(v.plain(v.value(found.value)), ensure_ascii=False, separators=(",", ":"))))
    return spark.createDataFrame(rows, "name string, value string")


def _static_checks(spark: SparkSession, _: str) -> DataFrame:
    rows = []
    for name, body, _type, _line in ERRORS:
        try:
            Policy(f"package p\n{body}")
            rows.append((name, "none", 0))
        except PolicyError as e:
            rows.append((name, type(e).__name__, e.line or 0))
    return spark.createDataFrame(rows, "name string, error string, line int")


def _dependencies(spark: SparkSession, _: str) -> DataFrame:
    p = Policy(f"package q\n{_ORDER}")
    rows = [(name, i, ",".join(sorted(p.dependencies.get(name, ())))) for i, name in enumerate(p.compiled.order)]
    return spark.createDataFrame(rows, "rule string, place int, needs string")


def _values(rows, columns: str) -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({columns})"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation as a JSON document, decided one by one: the JSON text of the decision."""
    df = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("j"))
    p = Policy('package q\nv := {"big": input.region > 2, "name": lower(input.name), "tags": [t | some t in ["a", input.region]]} if input.region != 4')
    return p.decide_documents(df, "v", json_col="j", keys=["n_nationkey"])


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result objects as JSON text, for each region."""
    p = Policy("package q\nok if input.r_regionkey < 3\nxs := [1, input.r_regionkey]")
    rows = []
    for r in spark.read.parquet(f"{sf_dir}/region.parquet").collect():  # a single-document API, over five rows
        found = p.evaluate(r.asDict(), query="[a, b] = data.q.xs")
        ok = p.evaluate(r.asDict(), query="data.q.ok")
        rows.append((r["r_regionkey"], found.to_json(), ok is not None))
    return spark.createDataFrame(rows, "r_regionkey int, result string, ok boolean")


#: Name, policy, the config's file name and text, more arguments, and the expected exit code and output.
COMMANDS: tuple[tuple[str, str, str, str, str, int, str], ...] = (
    ("json passes", "allow if input.port > 1000", "c.json", '{"port": 8080}', "", 0, "pass"),
    ("json fails", "deny contains m if { input.port < 1000; m := sprintf(\"port %d\", [input.port]) }", "c.json", '{"port": 80}', "", 1, "fail|- port 80"),
    ("empty set is undefined", "deny contains 1 if input.port < 1", "c.json", '{"port": 80}', "", 1, "fail|- undefined"),
    ("yaml", "allow if input.a.b == [1, 2]", "c.yaml", "a:\n  b: [1, 2]\n", "", 0, "pass"),
    ("yaml aliases refused", "allow if input.y.k == 1", "c.yaml", "x: &q {k: 1}\ny: *q\n", "--format json", 2, ""),
    ("yaml aliases", "allow if input.y.k == 1", "c.yaml", "x: &q {k: 1}\ny: *q\n", "--yaml-aliases", 0, "pass"),
    ("query by name", "deny contains 1\nallow if true", "c.json", "{}", "--query data.p.allow", 0, "pass"),
    ("deny goes first", "allow if true\nviolation contains 3", "c.json", "{}", "", 1, "fail|- 3"),
    ("as json", "allow if input.x", "c.json", '{"x": true}', "--format json", 0, '{"success": true, "errors": [], "result": true}'),
    ("object is an error", 'errors := {"k": 1}', "c.json", "{}", "", 1, 'fail|- {"k":1}'),
    ("false is an error", "default allow := false", "c.json", "{}", "", 1, "fail|- false"),
    ("bad policy", "allow := [1", "c.json", "{}", "", 2, ""),
    ("profile", "allow if true", "c.json", "{}", "--profile", 0, "pass"),
)


def _command_line(spark: SparkSession, _: str) -> DataFrame:
    rows = []
    for name, policy, file, text, more, _code, output in COMMANDS:
        with tempfile.TemporaryDirectory() as d, contextlib.redirect_stdout(io.StringIO()) as out, contextlib.redirect_stderr(io.StringIO()) as err:
            Path(d, "p.policy").write_text(f"package p\n{policy}", encoding="utf-8")
            Path(d, file).write_text(text, encoding="utf-8")
            code = cli.main(["--policy", f"{d}/p.policy", "--config", f"{d}/{file}", *more.split()])
        shown = out.getvalue().strip().replace("\n", "|") if output else ""
        rows.append((name, code, shown, "profile evaluate" in err.getvalue()))
    return spark.createDataFrame(rows, "name string, code int, output string, profiled boolean")


def _config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders above a limit that a config file sets, JSON and YAML."""
    with tempfile.TemporaryDirectory() as d:
        Path(d, "c.json").write_text(json.dumps({"limit": 450000}), encoding="utf-8")
        Path(d, "c.yaml").write_text("limit: 480000\nflags: [F, O]\n", encoding="utf-8")
        catalog = Catalog.parquet(spark, sf_dir, "orders").document("low", load_document(f"{d}/c.json")).document("high", load_document(f"{d}/c.yaml"))
    p = Policy('package q\ns contains {"k": o.o_orderkey, "high": o.o_totalprice > data.high.limit} if { some o in data.orders; o.o_totalprice > data.low.limit; o.o_orderstatus in data.high.flags }')
    return p.relation(spark, "s", catalog)


def _shared(spark: SparkSession) -> str:
    """A new folder under the one that driver and executors share; without one set, as on a single machine, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(found or 'file://' + tempfile.mkdtemp()).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a stream, decided against a static set of customers, written and read again."""
    from .streaming.decisions import decide_stream, write_decisions

    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    p = Policy('package q\nrich contains c.c_custkey if { some c in data.customer; c.c_acctbal > 9000 }\nv := "rich" if { input.o_custkey in rich; input.o_totalprice > 100000 }')
    path = _shared(spark)
    out = decide_stream(p, stream, "v", keys=["o_orderkey"], catalog=Catalog.parquet(spark, sf_dir, "customer"))
    write_decisions(out, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


LANGUAGE_QUERIES: dict[str, Query] = {
    "front_end": Query("", "", _values([(n, x) for n, _, x in VALUES], "name, value"), made=_front_end),
    "static_checks": Query("", "", _values([(n, e, line) for n, _, e, line in ERRORS], "name, error, line"), made=_static_checks),
    "rule_order": Query("", "", _values([("d", 0, ""), ("e", 1, "d"), ("f", 2, "e")], "rule, place, needs"), made=_dependencies),
    "document_decisions": Query(
        "", "", """select n_nationkey, '{"big":'||(n_regionkey>2)::varchar||',"name":"'||lower(n_name)||'","tags":["a",'||n_regionkey||']}' as v from nation where n_regionkey<>4""",
        made=lambda spark, sf_dir: _documents(spark, sf_dir).select("n_nationkey", F.regexp_replace("v", r'([:,]) ', "$1").alias("v")),
    ),
    "results": Query(
        "", "", """select r_regionkey, '{"value": true, "bindings": {"a": 1, "b": '||r_regionkey||'}, "success": true, "errors": []}' as result, r_regionkey<3 as ok from region""", made=_results,
    ),
    "command_line": Query("", "", _values([(n, code, x) for n, _, _, _, _, code, x in COMMANDS], "name, code, output").replace("select *", "select *, name='profile' as profiled"), made=_command_line),
    "config_files": Query("", "", """select o_orderkey as k, o_totalprice>480000 as high from orders where o_totalprice>450000 and o_orderstatus in ('F','O')""", made=_config_files),
    "stream_decisions": Query("", "", """select o_orderkey, 'rich' as v from orders where o_totalprice>100000 and o_custkey in (select c_custkey from customer where c_acctbal>9000)""", made=_stream),
}
