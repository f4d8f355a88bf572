"""Queries over the driver tables: policies, and SQL that gives the same rows."""

from __future__ import annotations

from .catalogue_documents import DOCUMENT_QUERIES
from .catalogue_language import LANGUAGE_QUERIES
from .query import Query

QUERIES: dict[str, Query] = {
    "complete_default": Query(
        r'''default v := false
v if input.o_orderstatus == "F"''',
        "v",
        """select o_orderkey, o_orderstatus='F' as v from orders""", ("orders", "o_orderkey"),
    ),
    "complete_clauses_or": Query(
        r'''default v := false
v if input.o_orderstatus == "F"
v if input.o_totalprice > 300000''',
        "v",
        """select o_orderkey, (o_orderstatus='F' or o_totalprice>300000) as v from orders""", ("orders", "o_orderkey"),
    ),
    "else_chain": Query(
        r'''v := "gold" if input.c_acctbal > 8000 else := "silver" if input.c_acctbal > 4000 else := "basic"''',
        "v",
        """select c_custkey, case when c_acctbal>8000 then 'gold' when c_acctbal>4000 then 'silver' else 'basic' end as v from customer""", ("customer", "c_custkey"),
    ),
    "undefined_dropped": Query(
        r'''v := "neg" if input.c_acctbal < 0''',
        "v",
        """select c_custkey, 'neg' as v from customer where c_acctbal<0""", ("customer", "c_custkey"),
    ),
    "partial_set": Query(
        r'''s contains c.c_mktsegment if { some c in data.customer; c.c_acctbal > 9000 }''',
        "s",
        """select distinct c_mktsegment as value from customer where c_acctbal>9000""",
    ),
    "partial_set_union": Query(
        r'''s contains c.c_nationkey if { some c in data.customer; c.c_acctbal > 9900 }
s contains p.s_nationkey if { some p in data.supplier; p.s_acctbal > 9000 }''',
        "s",
        """select c_nationkey as value from customer where c_acctbal>9900 union select s_nationkey from supplier where s_acctbal>9000""",
    ),
    "partial_object_join": Query(
        r'''o[n.n_name] := r.r_name if { some n in data.nation; some r in data.region; r.r_regionkey == n.n_regionkey }''',
        "o",
        """select n_name as key, r_name as value from nation join region on r_regionkey=n_regionkey""",
    ),
    "nested_heads": Query(
        r'''t[r.r_name].nations := count([1 | some n in data.nation; n.n_regionkey == r.r_regionkey]) if some r in data.region
t[r.r_name].id := r.r_regionkey if some r in data.region''',
        "t",
        """select r_name as k1,'nations' as k2,(select count(*) from nation where n_regionkey=r_regionkey)::bigint as v from region union all select r_name,'id',r_regionkey::bigint from region""",
    ),
    "equi_join3": Query(
        r'''s contains {"o": o.o_orderkey, "c": c.c_name, "n": n.n_name} if { some o in data.orders; o.o_totalprice > 450000; some c in data.customer; c.c_custkey == o.o_custkey; some n in data.nation; n.n_nationkey == c.c_nationkey }''',
        "s",
        """select distinct o_orderkey as o, c_name as c, n_name as n from orders join customer on c_custkey=o_custkey join nation on n_nationkey=c_nationkey where o_totalprice>450000""",
    ),
    "theta_join": Query(
        r'''s contains {"a": a.s_suppkey, "b": b.s_suppkey} if { some a in data.supplier; some b in data.supplier; a.s_nationkey == b.s_nationkey; a.s_acctbal < b.s_acctbal }''',
        "s",
        """select a.s_suppkey as a,b.s_suppkey as b from supplier a join supplier b on a.s_nationkey=b.s_nationkey and a.s_acctbal<b.s_acctbal""",
    ),
    "unify_join": Query(
        r'''s contains {"n": n.n_name, "r": r.r_name} if { some n in data.nation; k = n.n_regionkey; some r in data.region; k = r.r_regionkey }''',
        "s",
        """select n_name as n,r_name as r from nation join region on n_regionkey=r_regionkey""",
    ),
    "semi_join_in_set": Query(
        r'''big contains o.o_custkey if { some o in data.orders; o.o_totalprice > 400000 }
s contains c.c_custkey if { some c in data.customer; c.c_custkey in big }''',
        "s",
        """select c_custkey as value from customer where c_custkey in (select o_custkey from orders where o_totalprice>400000)""",
    ),
    "anti_join_not": Query(
        r'''buyers contains o.o_custkey if { some o in data.orders; o.o_totalprice > 100000 }
s contains c.c_custkey if { some c in data.customer; not (c.c_custkey in buyers) }''',
        "s",
        """select c_custkey as value from customer where not exists(select 1 from orders where o_custkey=c_custkey and o_totalprice>100000)""",
    ),
    "every_anti": Query(
        r'''s contains o.o_orderkey if { some o in data.orders; every l in [l | some l in data.lineitem; l.l_orderkey == o.o_orderkey] { l.l_quantity >= 10 } }''',
        "s",
        """select o_orderkey as value from orders where not exists(select 1 from lineitem where l_orderkey=o_orderkey and not l_quantity>=10)""",
    ),
    "comp_count": Query(
        r'''o[c.c_custkey] := count([1 | some x in data.orders; x.o_custkey == c.c_custkey]) if some c in data.customer''',
        "o",
        """select c_custkey as key, count(o_orderkey)::bigint as value from customer left join orders on o_custkey=c_custkey group by 1""",
    ),
    "comp_sum": Query(
        r'''o[x.o_orderkey] := sum([l.l_quantity | some l in data.lineitem; l.l_orderkey == x.o_orderkey]) if { some x in data.orders; x.o_totalprice > 200000 }''',
        "o",
        """select o_orderkey as key, coalesce(sum(l_quantity),0)::double as value from orders left join lineitem on l_orderkey=o_orderkey where o_totalprice>200000 group by 1""",
    ),
    "comp_max_min": Query(
        r'''s contains {"k": c.c_custkey, "hi": max(p), "lo": min(p)} if { some c in data.customer; p := [o.o_totalprice | some o in data.orders; o.o_custkey == c.c_custkey] }''',
        "s",
        """select o_custkey as k,max(o_totalprice) as hi,min(o_totalprice) as lo from orders where o_custkey in (select c_custkey from customer) group by 1""",
    ),
    "set_comp_distinct": Query(
        r'''o[n.n_nationkey] := count({c.c_mktsegment | some c in data.customer; c.c_nationkey == n.n_nationkey}) if some n in data.nation''',
        "o",
        """select n_nationkey as key, count(distinct c_mktsegment)::bigint as value from nation left join customer on c_nationkey=n_nationkey group by 1""",
    ),
    "group_by_idiom": Query(
        r'''flags := {l.l_returnflag | some l in data.lineitem}
g := {f: count([1 | some l in data.lineitem; l.l_returnflag == f]) | some f in flags}''',
        "g",
        """select l_returnflag as key, count(*)::bigint as value from lineitem group by 1""",
    ),
    "all_any": Query(
        r'''s contains {"k": o.o_orderkey, "a": all(f), "b": any(f)} if { some o in data.orders; o.o_totalprice > 300000; f := [l.l_returnflag == "N" | some l in data.lineitem; l.l_orderkey == o.o_orderkey] }''',
        "s",
        """select o_orderkey as k, coalesce(bool_and(l_returnflag='N'),true) as a, coalesce(bool_or(l_returnflag='N'),false) as b from orders left join lineitem on l_orderkey=o_orderkey where o_totalprice>300000 group by 1""",
    ),
    "top_k": Query(
        r'''p := [o.o_totalprice | some o in data.orders]
s contains x if some x in array.slice(array.reverse(sort(p)), 0, 10)''',
        "s",
        """select distinct value from (select o_totalprice as value from orders order by 1 desc limit 10)""",
    ),
    "set_ops": Query(
        r'''a := {c.c_nationkey | some c in data.customer; c.c_acctbal > 9500}
b := {x.s_nationkey | some x in data.supplier; x.s_acctbal > 5000}
s contains {"op": "u", "v": v} if some v in union(a, b)
s contains {"op": "i", "v": v} if some v in intersection(a, b)
s contains {"op": "d", "v": v} if some v in set_diff(a, b)''',
        "s",
        """with a as (select distinct c_nationkey v from customer where c_acctbal>9500), b as (select distinct s_nationkey v from supplier where s_acctbal>5000) select 'u' as op,v from (select v from a union select v from b) union all select 'i',v from (select v from a intersect select v from b) union all select 'd',v from (select v from a except select v from b)""",
    ),
    "member_literal": Query(
        r'''v := input.c_mktsegment in ["BUILDING", "MACHINERY"]''',
        "v",
        """select c_custkey, c_mktsegment in ('BUILDING','MACHINERY') as v from customer""", ("customer", "c_custkey"),
    ),
    "member_object_keys": Query(
        r'''v := input.c_mktsegment in {"BUILDING": false, "FURNITURE": 1}''',
        "v",
        """select c_custkey, c_mktsegment in ('BUILDING','FURNITURE') as v from customer""", ("customer", "c_custkey"),
    ),
    "kleene": Query(
        r'''v := input.missing or input.c_acctbal > 0''',
        "v",
        """select c_custkey, true as v from customer where c_acctbal>0""", ("customer", "c_custkey"),
    ),
    "floor_div_mod": Query(
        r'''v := {"q": (input.p_partkey - 1000) / 7, "m": (input.p_partkey - 1000) % 7}''',
        "v",
        """select p_partkey, cast(floor((p_partkey-1000)/7.0) as bigint) as q, (((p_partkey-1000)%7)+7)%7 as m from part""", ("part", "p_partkey"),
    ),
    "neg_unary": Query(
        r'''v := -input.s_suppkey''',
        "v",
        """select s_suppkey, -s_suppkey as v from supplier""", ("supplier", "s_suppkey"),
    ),
    "cmp_strings": Query(
        r'''v := input.p_name < "m"''',
        "v",
        """select p_partkey, p_name<'m' as v from part""", ("part", "p_partkey"),
    ),
    "str_affixes": Query(
        r'''v := {"a": startswith(input.p_name, "s"), "b": endswith(input.p_name, "ring"), "c": contains(input.p_name, "d w")}''',
        "v",
        """select p_partkey, starts_with(p_name,'s') as a, ends_with(p_name,'ring') as b, contains(p_name,'d w') as c from part""", ("part", "p_partkey"),
    ),
    "str_index_sub": Query(
        r'''v := {"i": indexof(input.p_name, "ring"), "s": substring(input.p_name, 1, 3)}''',
        "v",
        """select p_partkey, (instr(p_name,'ring')-1)::bigint as i, substring(p_name,2,3) as s from part""", ("part", "p_partkey"),
    ),
    "str_case_split_concat": Query(
        r'''v := {"u": upper(input.p_name), "l": lower(input.p_type), "j": concat("-", split(input.p_name, " ")), "n": count(split(input.p_name, " "))}''',
        "v",
        """select p_partkey, upper(p_name) as u, lower(p_type) as l, replace(p_name,' ','-') as j, len(string_split(p_name,' '))::bigint as n from part""", ("part", "p_partkey"),
    ),
    "str_trim": Query(
        r'''v := {"b": trim(input.p_name, "srt"), "l": trim_left(input.p_name, "sr"), "r": trim_right(input.p_name, "gt"), "s": trim_space(concat("", ["  ", input.p_name, " "]))}''',
        "v",
        """select p_partkey, trim(p_name,'srt') as b, ltrim(p_name,'sr') as l, rtrim(p_name,'gt') as r, p_name as s from part""", ("part", "p_partkey"),
    ),
    "str_format": Query(
        r'''v := {"f": sprintf("%s #%d", [input.p_brand, input.p_size]), "h": format_int(input.p_partkey, 16), "t": $"part {input.p_partkey}: {input.nope}"}''',
        "v",
        """select p_partkey, printf('%s #%d',p_brand,p_size) as f, lower(to_base(p_partkey,16)) as h, 'part '||p_partkey||': <undefined>' as t from part""", ("part", "p_partkey"),
    ),
    "casts": Query(
        r'''v := {"n": to_number(substring(input.c_name, 9, 9)), "s": cast_string(input.c_custkey), "b": cast_boolean(input.c_custkey % 2)}''',
        "v",
        """select c_custkey, cast(substring(c_name,10,9) as double) as n, cast(c_custkey as varchar) as s, c_custkey%2=1 as b from customer""", ("customer", "c_custkey"),
    ),
    "types": Query(
        r'''v := {"t": type_name(input.props), "k": type_name(input.props.k), "n": is_number(input.value), "z": is_null(input.user_id)}''',
        "v",
        """select event_id,'object' as t,'number' as k,true as n,false as z from events""", ("events", "event_id"), json="",
    ),
    "json_path": Query(
        r'''v := input.props.k if input.props.k > 50''',
        "v",
        """select event_id, cast(json_extract(props,'$.k') as bigint) as v from events where cast(json_extract(props,'$.k') as bigint)>50""", ("events", "event_id"), json="struct<k:bigint>",
    ),
    "object_builtins": Query(
        r'''v := {"g": object.get(input, "zz", "none"), "k": count(object.keys(input)), "r": count(object.remove(input, ["n_name"]))}''',
        "v",
        """select n_nationkey,'none' as g,3::bigint as k,2::bigint as r from nation""", ("nation", "n_nationkey"),
    ),
    "array_index_destructure": Query(
        r'''v := {"a": a, "b": b} if [a, b] := split(input.p_name, " ")''',
        "v",
        """select p_partkey, string_split(p_name,' ')[1] as a, string_split(p_name,' ')[2] as b from part where len(string_split(p_name,' '))=2""", ("part", "p_partkey"),
    ),
    "some_index_value": Query(
        r'''s contains {"k": p.p_partkey, "i": i, "w": w} if { some p in data.part; some i, w in split(p.p_name, " ") }''',
        "s",
        """select distinct p_partkey as k,(i-1)::bigint as i, string_split(p_name,' ')[i] as w from part, generate_series(1,10) g(i) where i<=len(string_split(p_name,' '))""",
    ),
    "var_key_ref": Query(
        r'''s contains {"v": e.vec_id, "i": i} if { some e in data.embeddings; some i; e.embedding[i] = x; x > 0.3 }''',
        "s",
        """select vec_id as v,(i-1)::bigint as i from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding,1) as i from embeddings) where x>0.3""",
    ),
    "user_function_else": Query(
        r'''band(x) := "hi" if x > 5000 else := "mid" if x > 0 else := "neg"
v := band(input.c_acctbal)''',
        "v",
        """select c_custkey, case when c_acctbal>5000 then 'hi' when c_acctbal>0 then 'mid' else 'neg' end as v from customer""", ("customer", "c_custkey"),
    ),
    "function_patterns": Query(
        r'''w("F") := 3
w("O") := 2
default w(_) := 1
v := w(input.o_orderstatus)''',
        "v",
        """select o_orderkey, (case o_orderstatus when 'F' then 3 when 'O' then 2 else 1 end)::bigint as v from orders""", ("orders", "o_orderkey"),
    ),
    "with_input": Query(
        r'''default ok := false
ok if input.c_acctbal > 5000
default v := false
v if ok with input.c_acctbal as 6000''',
        "v",
        """select c_custkey, true as v from customer""", ("customer", "c_custkey"),
    ),
    "with_data_whatif": Query(
        r'''cheap contains p.p_partkey if { some p in data.part; p.p_retailprice < data.cfg.limit }
v := n if { n := count(cheap) with data.cfg.limit as 950 }''',
        "v",
        """select count(*)::bigint as v from part where p_retailprice<950""",
    ),
    "with_function": Query(
        r'''v if count([input.p_size, 1]) > 20 with count as sum''',
        "v",
        """select p_partkey, true as v from part where p_size+1>20""", ("part", "p_partkey"),
    ),
    "import_alias": Query(
        r'''import data.nation as ns
s contains n.n_name if some n in ns''',
        "s",
        """select distinct n_name as value from nation""",
    ),
    "rule_composition": Query(
        r'''quality contains l.doc_id if { some l in data.labels; l.quality == 1 }
toxic contains l.doc_id if { some l in data.labels; l.toxic == 1 }
keep contains d.doc_id if { some d in data.documents; d.doc_id in quality; not (d.doc_id in toxic) }''',
        "keep",
        """select doc_id as value from documents where doc_id in (select doc_id from labels where quality=1) and doc_id not in (select doc_id from labels where toxic=1)""",
    ),
    "deny_messages": Query(
        r'''deny contains m if { some o in data.orders; o.o_totalprice > 490000; m := sprintf("order %d too large", [o.o_orderkey]) }
deny contains m if { some c in data.customer; c.c_acctbal < -900; m := sprintf("customer %s overdrawn", [c.c_name]) }''',
        "deny",
        """select distinct printf('order %d too large',o_orderkey) as value from orders where o_totalprice>490000 union select printf('customer %s overdrawn',c_name) from customer where c_acctbal<-900""",
    ),
}
QUERIES |= DOCUMENT_QUERIES | LANGUAGE_QUERIES
