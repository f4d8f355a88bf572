"""Every catalogued policy gives the rows of its SQL, and plans stay what they should be."""

import glob
import os

import duckdb
import pytest

import sparkpolicy as sp
from sparkpolicy.catalogue import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_rows(spark, con, sf_dir, name):
    q = QUERIES[name]
    df = q.run(spark, sf_dir)
    expected = con.execute(q.sql)
    columns = [d[0] for d in expected.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = sorted(repr(tuple(r[i] for i in order)) for r in expected.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r[c] for c in sorted(columns))) for r in df.collect()) == rows
    plan = plan_of(df)
    assert "Python" not in plan and ("Arrow" not in plan or name == "document_decisions")


@pytest.mark.parametrize("name,there,absent", [
    ("undefined_dropped", "PushedFilters: [IsNotNull(c_acctbal), LessThan(c_acctbal,0.0)]", ""),
    ("equi_join3", "HashJoin", "NestedLoop"),
    ("every_anti", "LeftAnti", "NestedLoop"),
    ("anti_join_not", "LeftAnti", "NestedLoop"),
    ("semi_join_in_set", "LeftSemi", "NestedLoop"),
    ("theta_join", "Join", "Cartesian"),
    ("top_k", "TakeOrderedAndProject", ""),
    ("comp_count", "HashAggregate", "collect_list"),
])
def test_plans(spark, sf_dir, name, there, absent):
    plan = plan_of(QUERIES[name].run(spark, sf_dir))
    assert there in plan and (not absent or absent not in plan)


def test_scan_reads_only_what_is_used(spark, sf_dir):
    plan = plan_of(QUERIES["every_anti"].run(spark, sf_dir))
    assert "struct<l_orderkey:bigint,l_quantity:double>" in plan and "struct<o_orderkey:bigint>" in plan


ROWS = [(1, "a", [1, 2], {"k": 1}), (2, "b", [], {}), (3, None, [5], {"k": 9, "z": 2}), (4, "d", None, None)]
POLICIES = [
    "v := count(input.xs)",
    "v := [x * 2 | some x in input.xs]",
    "v := {i | some i, x in input.xs; x > 1}",
    "v if every x in input.xs { x > 1 }",
    "v if some x in input.xs",
    "v if 5 in input.xs",
    "v if \"z\" in input.m",
    "v := input.m.k",
    "v := input.name",
    "v if not input.name",
    "v if not input.name == \"a\"",
    "default v := \"none\"\nv := input.name if count(input.xs) > 0",
    "v := x if { some x in input.xs; x > 4 }",
    "v := $\"{input.name}/{input.m.k}\"",
    "v contains x if { some x in input.xs; x > 1 }",
    "v := input.xs[-1]",
    "v := sum([x | some x in input.xs; x < 5])",
    "f(x) := \"one\" if x == 1 else := \"many\" if x > 1\nv := f(count(input.xs))",
    "v := [y | some x in input.xs; some y in input.xs; y > x]",
    "v if { some i; input.xs[i] == 2 }",
]


@pytest.mark.parametrize("policy", POLICIES)
def test_rows_and_documents_agree(spark, policy):
    """A batch row is decided like the same document on its own."""
    df = spark.createDataFrame(ROWS, "id int, name string, xs array<bigint>, m map<string,bigint>")
    p = sp.Policy(f"package q\n{policy}")
    norm = lambda x: sorted(x) if isinstance(x, (set, list)) and "contains" in policy + " contains" * ("{i" in policy) else x
    got = {r["id"]: norm(r["v"]) for r in p.decide(df, "v", keys=["id"]).collect()}
    expected = {}
    for id_, name, xs, m in ROWS:
        doc = {k: x for k, x in (("id", id_), ("name", name), ("xs", xs), ("m", m)) if x is not None}
        r = p.evaluate(doc, query="v")
        if r is not None:
            expected[id_] = norm(sorted(r.value) if isinstance(r.value, set) else r.value)
    assert got == expected


def test_conflicts_raise(spark):
    df = spark.range(3)
    with pytest.raises(Exception, match="conflicting values"):
        sp.Policy("package q\nv := 1 if input.id > 0\nv := 2 if input.id > 1").decide(df, "v", keys=["id"]).collect()
    t = spark.createDataFrame([(1, 1), (1, 2)], "k int, x int")
    p = sp.Policy("package q\no[r.k] := r.x if some r in data.t")
    with pytest.raises(Exception, match="conflicting object key"):
        p.relation(spark, "o", sp.Catalog({"t": t})).count()
    with pytest.raises(Exception, match="conflicting object key"):
        p.verify(spark, sp.Catalog({"t": t}))


def test_rows_against_tables(spark):
    users = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "cid")], "id int, name string")
    blocked = spark.createDataFrame([("bob",)], "name string")
    p = sp.Policy("package q\nbad contains b.name if some b in data.blocked\ndefault v := true\nv := false if input.name in bad")
    got = p.decide(users, "v", keys=["id"], catalog=sp.Catalog({"blocked": blocked}))
    assert sorted(map(tuple, got.collect())) == [(1, True), (2, False), (3, True)]


def test_sets_and_objects_of_rows(spark):
    users = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "cid")], "id int, name string")
    grants = spark.createDataFrame([("bob", "read"), ("bob", "write"), ("ann", "read"), ("ann", "read")], "who string, what string")
    p = sp.Policy("package q\ncan contains g.what if { some g in data.grants; g.who == input.name }\no[k] := n if { some k in [\"a\", \"b\"]; n := count(input.name) }\no[\"c\"] := input.id if input.id > 1")
    got = p.decide(users, "can", keys=["id"], catalog=sp.Catalog({"grants": grants}))
    assert sorted((r["id"], r["v"]) for r in got.collect()) == [(1, ["read"]), (2, ["read", "write"])]
    objects = {r["id"]: r["v"] for r in p.decide(users, "o", keys=["id"]).collect()}
    assert objects == {1: {"a": 3, "b": 3}, 2: {"a": 3, "b": 3, "c": 2}, 3: {"a": 3, "b": 3, "c": 3}}
    with pytest.raises(Exception, match="conflicting object key"):
        sp.Policy("package q\no[\"a\"] := x if some x in [1, input.id]").decide(users, "o", keys=["id"]).collect()
    with pytest.raises(sp.PolicyError):
        sp.Policy("package q\nn := count(can)\ncan contains g.what if { some g in data.grants; g.who == input.name }").decide(users, "n", keys=["id"], catalog=sp.Catalog({"grants": grants}))


def test_empty_tables_and_theta_correlation(spark):
    t = spark.createDataFrame([(1, 5), (2, 7), (3, 6)], "k int, x int")
    p = sp.Policy("package q\no[a.k] := count([1 | some b in data.t; b.x < a.x]) if some a in data.t\ns contains a.k if { some a in data.t; a.x > 100 }")
    c = sp.Catalog({"t": t})
    assert sorted(map(tuple, p.relation(spark, "o", c).collect())) == [(1, 0), (2, 2), (3, 1)]
    assert p.relation(spark, "s", c).count() == 0


def test_documents_without_a_schema(spark):
    df = spark.createDataFrame([(1, '{"a": [1, "x"]}'), (2, '{"a": {"b": 1}}'), (3, None)], "id int, j string")
    got = sp.Policy("package q\nv := type_name(input.a)").decide_documents(df, "v", json_col="j", keys=["id"])
    assert sorted(map(tuple, got.collect())) == [(1, '"array"'), (2, '"object"')]


def test_stream(spark, tmp_path):
    from sparkpolicy.streaming.decisions import decide_stream, write_decisions

    spark.range(10).write.parquet(f"{tmp_path}/in")
    allowed = spark.createDataFrame([(3,), (4,)], "n long")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    p = sp.Policy("package q\nok contains a.n if some a in data.allowed\nv := \"big\" if input.id > 6 else := \"small\"\nw if input.id in ok")
    out = decide_stream(p, stream, "v", keys=["id"])
    write_decisions(out, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").where("v = 'big'").count() == 3
    catalog = sp.Catalog({"allowed": allowed})
    write_decisions(decide_stream(p, stream, "w", keys=["id"], catalog=catalog), f"{tmp_path}/w", f"{tmp_path}/cw").awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/w").collect()) == [3, 4]
    with pytest.raises(sp.PolicyError):  # it would have to remember the stream's rows
        decide_stream(sp.Policy("package q\nx := a.n if { some a in data.allowed; a.n > input.id }"), stream, "x", keys=["id"], catalog=catalog)
    with pytest.raises(ValueError):
        decide_stream(p, spark.range(1), "v", keys=["id"])
