"""Queries over rows with documents, over literals and builtins of collections, and over tables by key and index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .api import Functions
from .operators.terms import Term, as_kind, cell
from .query import Query


def _document(df: DataFrame) -> DataFrame:
    """Events with a column ``doc`` of JSON whose members differ in type from row to row."""
    number = lambda c: F.col(c).cast("string")
    odd = F.when(F.col("event_id") % 4 == 0, F.lit("7")).when(F.col("event_id") % 4 == 1, F.lit('"seven"')).when(F.col("event_id") % 4 == 2, F.lit("[7, 8]")).otherwise(F.lit('{"seven": 7, "eight": null}'))
    text = F.concat(
        F.lit('{"xs": ['), (F.col("event_id") % 5).cast("string"), F.lit(", "), (F.col("event_id") % 3).cast("string"), F.lit(', 2], "mixed": [1, "a", null, ['), number("user_id"),
        F.lit(']], "o": {"a": 1, "b": null}, "p": {"t": "'), F.col("event_type"), F.lit('", "u": '), number("user_id"), F.lit('}, "rows": [{"c": [1, '), number("user_id"), F.lit(']}, {"c": [3]}], "odd": '), odd, F.lit("}"),
    )
    return df.withColumn("doc", F.parse_json(text))


def _which(df: DataFrame) -> DataFrame:
    return df.withColumn("which", F.when(F.col("p_size") % 4 == 0, "p_name").when(F.col("p_size") % 4 == 1, "p_brand").when(F.col("p_size") % 4 == 2, "p_partkey").otherwise("nothing"))


def _formats(df: DataFrame) -> DataFrame:
    kinds = ("%s-%05d", "[%9s] %x", "100%% %s", "%s %d %d")
    return df.withColumns({"fmt": F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_size") % 4 + 1).cast("int")), "base": (F.col("p_size") % 40).cast("long")})


def _half() -> Functions:
    functions = Functions()

    def half(t: Term) -> Term:
        c = as_kind(t, "number")
        return cell(T.DoubleType(), c, col=c.col / 2)

    functions.register("half", 1, value=lambda x: x / 2, column=half)
    return functions


DOCUMENT_QUERIES: dict[str, Query] = {
    # -- documents without a schema
    "variant_aggregates": Query(
        r'''v := {"n": count(input.doc.xs), "s": sum(input.doc.xs), "hi": max(input.doc.xs), "lo": min(input.doc.xs), "m": count(input.doc.mixed), "keys": count(object.keys(input.doc.o)), "all": all(input.doc.xs), "any": any(input.doc.mixed)}''',
        "v",
        """select event_id, 3::bigint as n, (event_id%5+event_id%3+2)::double as s, greatest(event_id%5,event_id%3,2)::double as hi, least(event_id%5,event_id%3,2)::double as lo, 4::bigint as m, 2::bigint as keys, true as "all", true as "any" from events""",
        ("events", "event_id"), prepare=_document,
    ),
    "variant_every": Query(
        r'''v if every x in input.doc.xs { x > 0 }''',
        "v",
        """select event_id, true as v from events where event_id%5>0 and event_id%3>0""", ("events", "event_id"), prepare=_document,
    ),
    "variant_pattern": Query(
        r'''v := {"t": cast_string(t), "u": to_number(u)} if {"t": t, "u": u} = input.doc.p''',
        "v",
        """select event_id, event_type as t, user_id::double as u from events""", ("events", "event_id"), prepare=_document,
    ),
    "variant_membership": Query(
        r'''v := {"one": 1 in input.doc.xs, "key": "b" in input.doc.o, "text": "a" in input.doc.mixed, "none": 9 in input.doc.mixed}''',
        "v",
        """select event_id, (event_id%5=1 or event_id%3=1) as one, true as "key", true as "text", false as none from events""", ("events", "event_id"), prepare=_document,
    ),
    "type_tests_of_documents": Query(
        r'''v := {"s": is_string(input.doc.odd), "n": is_number(input.doc.odd), "a": is_array(input.doc.odd), "o": is_object(input.doc.odd), "z": is_null(input.doc.o.b), "t": type_name(input.doc.odd)}''',
        "v",
        """select event_id, event_id%4=1 as s, event_id%4=0 as n, event_id%4=2 as a, event_id%4=3 as o, true as z, case event_id%4 when 0 then 'number' when 1 then 'string' when 2 then 'array' else 'object' end as t from events""",
        ("events", "event_id"), prepare=_document,
    ),
    "nested_key_enumeration": Query(
        r'''v := sum([to_number(x) | some i, j; x = input.doc.rows[i].c[j]])''',
        "v",
        """select event_id, (4+user_id)::double as v from events""", ("events", "event_id"), prepare=_document,
    ),
    "nested_keys_of_tables": Query(
        r'''s contains {"j": j, "x": x} if { some j; data.embeddings[_].embedding[j] = x; x > 0.33 }''',
        "s",
        """select distinct (j-1)::bigint as j, x from (select unnest(embedding) as x, generate_subscripts(embedding,1) as j from embeddings) where x>0.33""",
    ),
    "dynamic_key": Query(
        r'''v := cast_string(input[input.which])''',
        "v",
        """select p_partkey, case p_size%4 when 0 then p_name when 1 then p_brand else p_partkey::varchar end as v from part where p_size%4<3""", ("part", "p_partkey"), prepare=_which,
    ),
    "dynamic_index": Query(
        r'''v := split(input.p_name, " ")[input.p_size % 3]''',
        "v",
        """select p_partkey, string_split(p_name,' ')[p_size%3+1] as v from part where p_size%3<len(string_split(p_name,' '))""", ("part", "p_partkey"),
    ),
    "some_over_input": Query(
        r'''v := {"strings": count([k | some k, x in input; is_string(x)]), "numbers": concat(",", sort([cast_string(k) | some k, x in input; is_number(x)]))}''',
        "v",
        """select n_nationkey, 1::bigint as strings, 'n_nationkey,n_regionkey' as numbers from nation""", ("nation", "n_nationkey"),
    ),
    # -- formats
    "sprintf_dynamic": Query(
        r'''v := sprintf(input.fmt, [input.p_brand, input.p_size])''',
        "v",
        """select p_partkey, case p_size%4 when 0 then p_brand||'-'||printf('%05d',p_size) when 1 then '['||lpad(p_brand,9,' ')||'] '||lower(hex(p_size)) else '100% '||p_brand end as v from part where p_size%4<3""",
        ("part", "p_partkey"), prepare=_formats,
    ),
    "format_int_dynamic": Query(
        r'''v := format_int(input.p_partkey - 1000, input.base)''',
        "v",
        """select p_partkey, case when p_partkey<1000 then '-' else '' end||lower(to_base(abs(p_partkey-1000),(p_size%40)::integer)) as v from part where p_size%40 between 2 and 36""",
        ("part", "p_partkey"), prepare=_formats,
    ),
    # -- literals and builtins of collections
    "array_literal": Query(
        r'''v := {"n": count(xs), "second": xs[1], "last": xs[-1]} if xs := [input.s_suppkey, input.s_nationkey, 7]''',
        "v",
        """select s_suppkey, 3::bigint as n, s_nationkey as second, 7::bigint as last from supplier""", ("supplier", "s_suppkey"),
    ),
    "set_literal": Query(
        r'''v := {"n": count({input.n_regionkey, 1, 2}), "same": {input.n_regionkey, 1} == {1, input.n_regionkey, 1}}''',
        "v",
        """select n_nationkey, case when n_regionkey in (1,2) then 2 else 3 end::bigint as n, true as same from nation""", ("nation", "n_nationkey"),
    ),
    "set_builtin": Query(
        r'''v := {"e": count(set()), "n": count(set([input.n_regionkey, 1, input.n_regionkey]))}''',
        "v",
        """select n_nationkey, 0::bigint as e, case when n_regionkey=1 then 1 else 2 end::bigint as n from nation""", ("nation", "n_nationkey"),
    ),
    "object_union": Query(
        r'''v := {"n": count(u), "b": u.b} if u := union({"a": 1, "z": input.n_name}, {"a": input.n_regionkey, "b": input.n_nationkey})''',
        "v",
        """select n_nationkey, 3::bigint as n, n_nationkey as b from nation where n_regionkey=1""", ("nation", "n_nationkey"),
    ),
    "array_concat": Query(
        r'''v := {"n": count(xs), "last": xs[-1]} if xs := array.concat(split(input.p_name, " "), [input.p_brand])''',
        "v",
        """select p_partkey, (len(string_split(p_name,' '))+1)::bigint as n, p_brand as last from part""", ("part", "p_partkey"),
    ),
    "type_tests": Query(
        r'''v := {"s": is_string(input.event_type), "n": is_string(input.user_id), "b": is_boolean(input.user_id > 5), "a": is_array(split(input.event_type, "e")), "o": is_object({"k": input.value}), "t": is_set({1, input.user_id}), "f": is_set([1]), "z": is_null(null)}''',
        "v",
        """select event_id, true as s, false as n, true as b, true as a, true as o, true as t, false as f, true as z from events""", ("events", "event_id"),
    ),
    "casts_of_collections": Query(
        r'''v := {"a": count(cast_array({input.s_nationkey, 1})), "t": count(cast_set([input.s_nationkey, 1, 1])), "o": cast_object({"k": input.s_name}).k}''',
        "v",
        """select s_suppkey, case when s_nationkey=1 then 1 else 2 end::bigint as a, case when s_nationkey=1 then 1 else 2 end::bigint as t, s_name as o from supplier""", ("supplier", "s_suppkey"),
    ),
    "equal_values": Query(
        r'''v := {"e": equal([input.n_regionkey, "x"], [1, "x"]), "d": equal({"k": input.n_name}, {"k": "FRANCE"}), "x": equal(input.n_name, 1)}''',
        "v",
        """select n_nationkey, n_regionkey=1 as e, n_name='FRANCE' as d, false as x from nation""", ("nation", "n_nationkey"),
    ),
    "not_as_value": Query(
        r'''v := {"a": not (input.c_acctbal > 0), "m": not input.missing}''',
        "v",
        """select c_custkey, not c_acctbal>0 as a, true as m from customer""", ("customer", "c_custkey"),
    ),
    "row_comprehensions": Query(
        r'''ws := split(input.p_name, " ")
v := {"s": count([w | some w in ws; startswith(w, "s")]), "u": count({substring(w, 0, 1) | some w in ws}), "o": count({i: w | some i, w in ws}), "j": concat("/", [upper(w) | some w in ws])}''',
        "v",
        """select p_partkey, len(list_filter(string_split(p_name,' '), lambda x: starts_with(x,'s')))::bigint as s, len(list_distinct(list_transform(string_split(p_name,' '), lambda x: substring(x,1,1))))::bigint as u, len(string_split(p_name,' '))::bigint as o, replace(upper(p_name),' ','/') as j from part""",
        ("part", "p_partkey"),
    ),
    "with_generator": Query(
        r'''v := sum([x * input.n_regionkey | some x in data.cfg.limits with data.cfg.limits as [1, 2, 4]])''',
        "v",
        """select n_nationkey, (7*n_regionkey)::bigint as v from nation""", ("nation", "n_nationkey"),
    ),
    # -- functions
    "call_by_reference": Query(
        r'''twice(x) := x * 2
v := data.q.twice(input.s_suppkey) + data.q["twice"](1)''',
        "v",
        """select s_suppkey, s_suppkey*2+2 as v from supplier""", ("supplier", "s_suppkey"),
    ),
    "registered_function": Query(
        r'''v := half(input.c_acctbal)''',
        "v",
        """select c_custkey, c_acctbal/2 as v from customer""", ("customer", "c_custkey"), functions=_half(),
    ),
    "table_function": Query(
        r'''customers(xs, key) := n if { n := count([1 | some x in xs; x.c_nationkey == key]); n > 50 } else := 0
o[n.n_name] := customers(data.customer, n.n_nationkey) if some n in data.nation''',
        "o",
        """select n_name as key, case when count(c_custkey)>50 then count(c_custkey) else 0 end::bigint as value from nation left join customer on c_nationkey=n_nationkey group by n_name""",
    ),
    # -- tables by key and index
    "else_over_tables": Query(
        r'''v := "many" if count(data.nation) > 100 else := "some" if count(data.nation) > 10 else := "few"''',
        "v",
        """select case when count(*)>100 then 'many' when count(*)>10 then 'some' else 'few' end as v from nation""",
    ),
    "collected_arrays": Query(
        r'''o[r.r_name] := concat(",", sort([n.n_name | some n in data.nation; n.n_regionkey == r.r_regionkey])) if some r in data.region''',
        "o",
        """select r_name as key, coalesce(string_agg(n_name,',' order by n_name),'') as value from region left join nation on n_regionkey=r_regionkey group by r_name""",
    ),
    "collected_in_order": Query(
        r'''o[c.c_mktsegment] := xs[0] if { some c in data.customer; c.c_custkey < 40; xs := ordered }
ordered := [s.s_name | some s in data.supplier; s.s_acctbal > 5000]''',
        "o",
        """select distinct c_mktsegment as key, (select s_name from supplier where s_acctbal>5000 order by s_suppkey limit 1) as value from customer where c_custkey<40""",
        indexes={"supplier": "s_suppkey"},
    ),
    "indexed_table": Query(
        r'''s contains {"i": i, "n": n.n_name} if { some i, n in data.nation; i % 2 == 0 }
s contains {"i": 100, "n": data.nation[3].n_name}''',
        "s",
        """select n_nationkey::bigint as i, n_name as n from nation where n_nationkey%2=0 union select 100, n_name from nation where n_nationkey=3""",
        indexes={"nation": "n_nationkey"},
    ),
    "every_with_key": Query(
        r'''s contains r.r_name if { some r in data.region; every i, n in data.nation { i < 20 + r.r_regionkey } }''',
        "s",
        """select r_name as value from region where not exists (select 1 from nation where not n_nationkey<20+r_regionkey)""",
        indexes={"nation": "n_nationkey"},
    ),
    "lookup_by_key": Query(
        r'''names[n.n_nationkey] := n.n_name if some n in data.nation
o[s.s_suppkey] := names[s.s_nationkey] if some s in data.supplier''',
        "o",
        """select s_suppkey as key, n_name as value from supplier join nation on n_nationkey=s_nationkey""",
    ),
    "get_with_default": Query(
        r'''rich[n.n_nationkey] := k if { some n in data.nation; k := count([1 | some c in data.customer; c.c_nationkey == n.n_nationkey; c.c_acctbal > 9000]); k > 6 }
o[n.n_name] := object.get(rich, n.n_nationkey, 0) if some n in data.nation''',
        "o",
        """select n_name as key, coalesce((select count(*) from customer where c_nationkey=n_nationkey and c_acctbal>9000 having count(*)>6),0)::bigint as value from nation""",
    ),
}
