"""Fingerprints, near-duplicates, vectors, licences, archives and the pipeline against plain versions."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpolicy.llm import components, embeddings, fingerprints, licenses, minhash, queries, warc
from sparkpolicy.llm.common import shared_path

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    import duckdb

    return dict(duckdb.sql(f"select doc_id, text from '{DIR}/documents.parquet'").fetchall())


def smallest(nodes, links):
    """Component of each node by repeated minima."""
    own = {n: n for n in nodes}
    while True:
        new = dict(own)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == own:
            return own
        own = new


# -- fingerprints
def pieces(text, words=fingerprints.PIECE_WORDS):
    return set(re.findall(rf"\S+(?:[^\S\n]+\S+){{0,{words - 1}}}", text or "", re.A))


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprint_query(spark, rows):
    got = {r["doc_id"]: r for r in fingerprints.op1_fingerprints(spark, DIR).collect()}
    ids = sorted(rows, reverse=True)
    assert sorted(got) == sorted(ids)
    for i, d in enumerate(ids):
        text, after = rows[d] or "", rows[ids[(i + 1) % len(ids)]] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(likeness(pieces(text), pieces(edited)))
        assert r["near_next"] == pytest.approx(likeness(pieces(text), pieces(after)))
    by = {}
    for d, r in got.items():
        by.setdefault(rows[d], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by.values())


def test_fingerprint_peeling(spark):
    """Differences of any size come back whole, or not at all."""
    df = spark.range(60).select("id", F.transform(F.sequence(F.lit(1), F.col("id") % 12 + 1), lambda i: F.xxhash64(i, F.col("id"))).alias("a"), F.transform(F.sequence(F.lit(3), F.col("id") % 7 + 4), lambda i: F.xxhash64(i, F.col("id"))).alias("b"))
    size = F.lit(32)
    out = df.select("a", "b", fingerprints.difference(fingerprints.sketch(F.col("a"), size), fingerprints.sketch(F.col("b"), size), size).alias("d"), fingerprints.apart(F.col("a"), F.col("b"), fingerprints.sketch(F.col("a"), F.lit(4)), fingerprints.sketch(F.col("b"), F.lit(4))).alias("n"))
    found = 0
    for r in out.collect():
        want = set(r["a"]) ^ set(r["b"])
        assert r["n"] == len(want)
        if r["d"] is not None:
            found += 1
            assert set(r["d"]) == want and len(r["d"]) == len(want)
    assert found > 50


def test_groups_that_never_peel(spark):
    """Digests that meet in all three subtables at every size are counted exactly."""
    of = lambda *keys: F.array(*[F.lit(k).cast("long") for k in keys])
    got = spark.range(1).select(fingerprints._apart(of(1, 1 << 40), of(2, 1 << 40)).alias("n")).first()["n"]
    assert got == 2


def test_next_rows(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE", 3)
    monkeypatch.setattr(fingerprints, "_STEP", 4)
    ids = [5, 1, 9, 2**60, -7, 100, 101, 102, 103, 50, 51, 52, 53, 54, 55, 56, 57, 58, 59, 60, 61, 62, 63, 64]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(df, ["text"]).collect()}
    down = sorted(ids, reverse=True)
    assert got == {None: None, **{d: f"t{down[(i + 1) % len(down)]}" for i, d in enumerate(down)}}
    one = spark.createDataFrame([(4, "a"), (4, "b")], "doc_id long, text string")
    assert sorted(tuple(r) for r in fingerprints.with_next(one, ["text"]).select("text", "next_text").collect()) == [("a", "b"), ("b", "a")]
    assert fingerprints.with_next(df.limit(0), ["text"]).count() == 0


def test_fingerprint_rows(spark, docs):
    out = fingerprints.fingerprint(docs)
    by = {(r["doc_id"], r["text"]): r["fingerprint"] for r in out.select("doc_id", "text", "fingerprint").collect()}
    assert by[6, ""] == by[7, None] == by[8, " \n\t "] and by[1, docs.first()["text"]] == by[2, docs.first()["text"]]
    assert out.count() == 14


def test_fingerprint_names(spark):
    """Columns under the operators' own names stay as they are."""
    names = ["digests", "cells", "fingerprint", "_id", "_range", "_at", "_copy", "row", "id", "range", "at", "copy", "r", "keys", "next_x"]
    df = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), *[F.lit(f"own {n}").alias(n) for n in names])
    for out in (fingerprints.fingerprint(df), fingerprints.with_next(df, ["text"])):
        assert out.select(*df.columns).distinct().count() == 5
        assert all(out.where(F.col(n) == f"own {n}").count() == 5 for n in names)
    assert {"digests_", "cells_", "fingerprint_"} <= set(fingerprints.fingerprint(df).columns)


# -- near-duplicates
def shingled(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def plain_components(texts, percent):
    sets = {d: shingled(t) for d, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return smallest(ids, links), {d: len(s) for d, s in sets.items()}


def test_near_duplicates_match_all_pairs(spark, rows):
    want, sizes = plain_components(rows, 85)
    got = minhash.op10_minhash(spark, DIR).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chains_and_tiles(spark, monkeypatch):
    """A chain of edits, where most pairs are no links, over tiny tiles."""
    monkeypatch.setattr(minhash, "TILE", 2)
    words = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(14):
        texts[i] = " ".join(words)
        words[(i * 29) % 200] = f"x{i}"
        words[(i * 29 + 90) % 200] = f"y{i}"
    texts |= {100 + i: " ".join(f"q{(i * j) % 97}" for j in range(40)) for i in range(1, 6)}
    for percent in (80, 85, 92):
        want, _ = plain_components(texts, percent)
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, percent=percent).collect()}
        assert got == want


def test_no_task_runs_two_python_functions(spark, rows, monkeypatch):
    plans, write = [], minhash.written
    parts = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for module in (minhash, components):
        monkeypatch.setattr(module, "written", lambda df, what: (plans.append((what, parts(df))), write(df, what))[1])
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert minhash.near_duplicates(df).count() == len(rows)
    assert {what for what, plan in plans if plan.count("MapInArrow") > 1} == set()
    assert any("MapInArrow" in plan for _, plan in plans)


def test_repeated_ids_with_other_texts(spark):
    words = lambda tag: " ".join(f"{tag}{i}" for i in range(60))
    rows = [(5, words("w")), (5, words("z")), (7, words("w") + " more"), (8, words("z") + " more"), (9, words("z") + " more"), (9, words("z") + " more"), (3, "x y"), (3, "X  Y")]
    got = sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3), (3, 3), (5, 5), (5, 5), (7, 5), (8, 5), (9, 5), (9, 5)]


def test_boilerplate_chain(spark):
    """Documents that share half of their words chain into one candidate group, but are compared within buckets only."""
    rng = np.random.default_rng(5)
    half = " ".join(f"b{i}" for i in range(60))
    texts = {i: f"{half} " + " ".join(f"u{i}x{j}" for j in range(int(rng.integers(20, 50)))) for i in range(400)}
    texts |= {1000 + i: texts[i] + " end" for i in range(0, 400, 9)}
    want, _ = plain_components(texts, 80)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), percent=80).collect()}
    assert got == want and sum(d != c for d, c in want.items()) >= 45


def test_near_duplicate_rows(spark, docs):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, percent=80).collect()]
    by = {g[0]: g for g in got}
    assert len(got) == 14 and by[None][2] is None and by[None][3]
    assert by[2][2] == 1 and by[4][2] == 3 and by[5][2] == 3 and by[10][2] == 9
    assert all(by[i][1] == 0 and by[i][2] == i for i in (6, 7, 8))
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    kept = minhash.keep_distinct(spark, docs, DIR)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.select("doc_id").collect()) == [0, 1, 3, 6, 7, 8, 9, 11, 12]


def test_min_and_max_estimate_similarity():
    m = minhash.MinMax(400, 1)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    other = np.unique(np.concatenate([base[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    same = np.mean(m.keys(np.unique(base)) == m.keys(other))
    assert abs(same - 800 / 1200) < 0.1


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 130)] + [(200, x) for x in range(201, 230)] + [(7, 7)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == smallest(nodes, [x for x in links if x[0] != x[1]])
    assert components.components(df.limit(0)).count() == 0


def test_components_beyond_one_task(spark, monkeypatch):
    """Few links are settled without rounds; more than a task may hold go through stars, with the same result."""
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 440)] + [(500, x) for x in range(501, 530)]
    links = [x for x in links if x[0] != x[1]]
    want = smallest({n for x in links for n in x}, links)
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    rounds = []
    star = components._star
    monkeypatch.setattr(components, "_star", lambda *a: rounds.append(1) or star(*a))
    for held, some in ((1 << 20, False), (8, True)):
        monkeypatch.setattr(components, "HELD_LINKS", held)
        rows = [(r["node"], r["component"]) for r in components.components(df).collect()]
        assert dict(rows) == want and len(rows) == len(want)
        assert bool(rounds) == some


def test_near_duplicates_write_few_tables(spark, monkeypatch):
    """Each table costs a stage of small tasks: chains of links don't add any."""
    names = []
    for m in (minhash, components):
        monkeypatch.setattr(m, "written", lambda df, what, f=m.written: names.append(what) or f(df, what))
    words, texts = [f"w{i}" for i in range(200)], {}
    for i in range(24):
        texts[i] = " ".join(words)
        words[(i * 29) % 200] = f"x{i}"
    want, _ = plain_components(texts, 85)
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want and set(want.values()) == {0}
    assert len(names) <= 16, names


# -- vectors
def plain_vectors(rows, cosine):
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, count = [], {i: 0 for i, _, _ in rows}
    for x, (i, v, a) in enumerate(ok):
        for j, w, b in ok[:x]:
            if a == b and len(v) == len(w) and (v * w).sum() >= cosine * np.linalg.norm(v) * np.linalg.norm(w):
                links.append((i, j))
                count[i] += 1
                count[j] += 1
    return count, smallest(list(count), links)


def test_vectors_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 40)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        v = rng.normal(size=24) + (8 * np.eye(24)[i % 3] if i % 2 else 0)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2)))
    rows += [(1000 + i, [2 * x for x in rows[1][1]], 1) for i in range(6)] + [(2000 + i, rows[3][1], 1) for i in range(5)]
    nan, inf = float("nan"), float("inf")
    rows += [(3000, None, 1), (3001, [0.0] * 24, 1), (3002, [nan] + [1.0] * 23, 1), (3003, [inf] + [1.0] * 23, 1), (3004, [None] + [1.0] * 23, 1), (3005, rows[1][1], None), (3006, [], 1), (3007, [1.0, 1.0], 1), (3008, [2.0, 2.0], 1), (3009, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).withColumn("block", F.lit(1))
    got = embeddings.similar_vectors(df, cosine=0.9).collect()
    count, groups = plain_vectors(rows, 0.9)
    assert {r["vec_id"]: r["n_links"] for r in got} == count and len(got) == len(rows)
    assert {r["vec_id"]: r["component_id"] for r in got} == groups
    assert sum(count.values()) > 50
    assert embeddings.similar_vectors(df.limit(0)).count() == 0


def test_vectors_that_repeat_an_id(spark):
    """Rows of one id under several labels or with several vectors are linked for themselves."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a, 1), (5, b, 1), (5, a, 2), (7, [1.0, 0.01, 0.0], 1), (8, [0.01, 1.0, 0.0], 1), (9, b, 2), (9, b, 2), (4, [1e200, 0.0, 0.0], 3), (3, [1e199, 1e190, 0.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.similar_vectors(df).collect())
    assert got == [(3, 1, 3), (4, 1, 3), (5, 0, 5), (5, 1, 5), (5, 1, 5), (7, 1, 5), (8, 1, 5), (9, 1, 9), (9, 1, 9)]


def test_vector_query_matches_all_pairs(spark):
    import duckdb

    rows = duckdb.sql(f"select vec_id, embedding, label from '{DIR}/embeddings.parquet'").fetchall()
    count, groups = plain_vectors(rows, 0.93)
    got = embeddings.op3_embedding_dedup(spark, DIR).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (n, groups[i], groups[i] == i) for i, n in count.items()}


def test_join_prunes():
    """Few distances are computed of vectors without links, and all links are found among many."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 64))
    v[1400:] = v[:100] + rng.normal(size=(100, 64)) * 0.2
    every, ones = np.arange(len(v)), np.ones(len(v), int)
    links, root, examined = embeddings.join_tiles(v, ones, every, every, 0.93)
    assert examined < 0.02 * len(v) ** 2 / 2
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    assert (links == want).all() and want.sum() > 150
    one, two = every[::2], every[1::2]
    parts = [embeddings.join_tiles(v, ones, *x, 0.93)[0] for x in ((one, one), (two, two), (one, two))]
    assert (sum(parts) == want).all()


def test_pigeonhole_budgets():
    assert sum(embeddings.budgets(64, 0.93)) == pytest.approx(0.14)
    q = embeddings.rotation(64)
    assert np.allclose(q @ q.T, np.eye(64))


# -- licences
def test_licenses(spark):
    files = [("a/LICENSE", "MIT License\nReleased under the MIT License."), ("a/b/c/x.py", "print"), ("a/b/COPYING", "Licensed under the Apache License, Version 2.0."), ("z/y.py", "x"), ("a/q.py", None), (None, "Released under the MIT License."), ("top.txt", ""), ("a/own.py", "# This work is licensed under the GNU General Public License, version 3\ncode " * 3), ("a/q.py", None)]
    got = sorted((tuple(r) for r in licenses.license_files(spark.createDataFrame(files, "path string, text string")).select("path", "license", "origin", "licensed_dir").collect()), key=str)
    assert got == sorted([("a/LICENSE", "MIT", "own", None), ("a/b/COPYING", "Apache-2.0", "own", None), ("a/b/c/x.py", "Apache-2.0", "inherited", "a/b"), ("a/own.py", "GPL-3.0", "own", None), ("a/q.py", "MIT", "inherited", "a"), ("a/q.py", "MIT", "inherited", "a"), ("top.txt", None, None, None), ("z/y.py", None, None, None), (None, "MIT", "own", None)], key=str)
    assert licenses.license_files(spark.createDataFrame([], "path string, text string")).count() == 0


def test_license_query(spark, rows):
    got = {r["doc_id"]: r for r in licenses.op6_licenses(spark, DIR).collect()}
    assert sorted(got) == sorted(rows)
    for d, text in rows.items():
        for line, want in (("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0")):
            if line in text.split("\n"):
                assert (got[d]["license"], got[d]["origin"]) == (want, "own")


def test_license_scan_against_a_plain_one(spark):
    """Best licence and cosine of small files by plain dictionaries, and inheritance by walking up the paths."""
    import math
    from collections import Counter

    words = lambda text: [t for t in re.split(r"[^\w.]+|\.(?=\s|$)", text.lower()) if t]
    files = {
        "a/LICENSE": "Released under the MIT License", "a/b/x.py": "print", "a/c/y.py": "# Licensed under the Apache License, Version 2.0\nx = 1", "d/e/f/z.py": "",
        "d/COPYING": "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "d/q.py": "Released under the Foo License and the driver license", "t.txt": "license " + " ".join(f"w{i}" for i in range(16_000)),
    }
    templates = [*sorted(licenses.TEMPLATES), *licenses.full_texts()]
    candidates = {p: t for p, t in files.items() if re.search(licenses.NOTICE, t)}
    held = Counter(t for text in [*candidates.values(), *(v for _, v in templates)] for t in set(words(text)))
    n = len(candidates) + len(templates)

    def vector(text):
        return {t: (math.log(c) + 1) * (1 + math.log((1 + n) / (1 + held[t])) / math.log(1 + n)) for t, c in Counter(words(text)).items()}

    def cosine(a, b):
        return sum(w * b.get(t, 0) for t, w in a.items()) / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))

    own = {}
    for p, text in candidates.items():
        lines, best = text.split("\n"), None
        notes = [i for i, x in enumerate(lines) if re.search(licenses.NOTICE, x)]
        for unit in {*lines, text} if notes else ():
            u = vector(unit)
            for i, (k, t) in enumerate(templates):
                short = i < len(licenses.TEMPLATES)
                named = not short or set(licenses.telling(k, t, licenses.TEMPLATES)) <= set(u) and not set(licenses.BARRED.get(k, ())) & set(u)
                c = round(cosine(u, vector(t)), 9)
                if named and c >= (licenses.LEAST_COSINE if short else licenses.LEAST_TEXT_COSINE):
                    best = min(best or (2,), (int(short), " OR " in k, -c, k))
        own[p] = best
    rows = licenses.license_files(spark.createDataFrame(list(files.items()), "path string, text string")).collect()
    for r in rows:
        best = own.get(r["path"])
        if best:
            assert (r["license"], r["origin"]) == (best[3], "own") and abs(r["cosine"] + best[2]) < 1e-6
    got = {r["path"]: (r["license"], r["origin"], r["licensed_dir"]) for r in rows}
    assert got["a/b/x.py"] == ("MIT", "inherited", "a") and got["a/c/y.py"][:2] == ("Apache-2.0", "own")
    assert got["d/e/f/z.py"] == (got["d/COPYING"][0], "inherited", "d") and got["d/COPYING"][0] == "GPL-2.0"
    assert got["d/q.py"][1] == "inherited" and got["t.txt"] == (None, None, None)


def test_shared_wording_names_all_its_licenses(spark):
    lines = [("BSD-2-Clause OR BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"), ("GPL-2.0 OR GPL-3.0", "GNU GENERAL PUBLIC LICENSE"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991"), ("GPL-3.0", "GNU General Public License, version 3"), ("LGPL-2.1 OR LGPL-3.0", "GNU Lesser General Public License version 2"), ("LGPL-3.0", "GNU Lesser General Public License version 3"), ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3")]
    got = licenses.scan_notices(spark.createDataFrame(lines, "path string, text string")).collect()
    assert [(r["path"], r["license"]) for r in got if r["path"] != r["license"]] == []


def test_licenses_at_every_size(spark):
    """Usual notices keep their licences however many there are, also if each has a name of its own."""
    kinds = [("Apache-2.0", 'Copyright 2021 The Foo Authors. Licensed under the Apache License, Version 2.0 (the "License");'), ("MIT", "// SPDX-License-Identifier: MIT"), ("Apache-2.0", "Copyright 2021 Holder{}. Licensed under the Apache License, Version 2.0")]
    of = lambda values: F.array(*map(F.lit, values))[(F.col("id") % 3).cast("int")]
    for n in (10, 100_000):
        text = F.regexp_replace(of([line for _, line in kinds]), F.lit(r"\{\}"), F.col("id").cast("string"))
        got = licenses.scan_notices(spark.range(n).select(of([want for want, _ in kinds]).alias("path"), text.alias("text")))
        assert got.where("license = path").count() == n
    other = ["Released under the Zlib License.", "SPDX-License-Identifier: Zlib", "the license of a driver"]
    assert {r["license"] for r in licenses.scan_notices(spark.createDataFrame([("p", t) for t in other], "path string, text string")).collect()} == {None}


def test_each_template_is_found(spark):
    """Each template as a text of its own, a grant without a title among them, is found as its own licence."""
    got = licenses.scan_notices(spark.createDataFrame(list(licenses.TEMPLATES), "path string, text string")).select("path", "license").collect()
    assert len(got) == len(licenses.TEMPLATES) and all(r["path"] == r["license"] for r in got)


def test_license_texts(spark):
    """Whole licences license their directories under any name, as do notices over several lines; prose doesn't."""
    files = [(f"{k}/{i}/1.txt", t.replace("<year>", "2021").replace("<copyright holders>", "Jo Doe")) for i in "ab" for k, t in licenses.full_texts()]
    grant = licenses.TEMPLATES[[k for k, _ in licenses.TEMPLATES].index("MIT") + 1][1]
    files += [("Apache-2.0/c/1.txt", "# Licensed under the Apache\n# License, Version 2.0\n" + "x = 1\n" * 9), ("MIT/d/1.txt", "\n".join([*grant.replace(" copy", "\ncopy").split(" of "), "", "x = 1"]))]
    files += [(f"{k}/e/1.txt", "#\n".join(f"# {x}" for x in dict(licenses.full_texts())[k].splitlines(True)) + "\n\n" + "x = 1\n" * 200) for k in ("BSD-2-Clause", "BSD-3-Clause", "MIT")]
    prose = "The driver shows the license of the car to a man of the law and is on the way to the public road. "
    files += [(None, prose * 40), (None, (prose + "\n") * 40)]
    files += [(p.replace("1.txt", "2.txt"), "x") for p, _ in files if p]
    for r in licenses.license_files(spark.createDataFrame(files, "path string, text string")).collect():
        want = r["path"].split("/")[0] if r["path"] else None
        assert (r["path"], r["license"], r["origin"]) == (r["path"], want, None if want is None else "own" if r["path"].endswith("1.txt") else "inherited")


# -- archives
def test_warc_round_trip(spark, tmp_path):
    big, nasty = "x" * 1200, "WARC/1.1\r\n\r\n\r\n" + "é\x00" * 700
    pages = [(1, "http://a.example.com/x", big), (2, "https://a.example.com:8443/x?q=1 2#f", big), (3, None, None), (4, "http://b.example.org/\r\nInjected: 1", nasty), (5, "not a url", "small"), (6, "http://a.example.com/y", "small"), (7, "http://A.example.com/x", big), (8, "", nasty)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("n", F.lit(1)).withColumn("key", F.lit(1))
    archives, index = f"file://{tmp_path}/a folder/100%20/warc", f"file://{tmp_path}/a folder/index"
    warc.write_archives(df, archives)
    assert warc.build_index(spark, archives, index, lines_a_block=2, blocks_a_file=2).count() >= 4
    got = {int(r["id"]): r for r in warc.read_captures(df, index).collect()}
    assert sorted(got) == list(range(1, 9))
    for i, _, html in pages:
        data = (html or "").encode()
        top = max(j for j, _, h in pages if h == html) if len(data) >= 1000 else i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(data), hashlib.sha1(data).hexdigest(), "response" if top == i else "revisit", None if top == i else str(top))
    look = warc.CaptureIndex(spark, index)
    assert sorted(h["WARC-Record-ID"] for h, _ in look.fetch("http://a.example.com/x")) == ["<urn:page:1>", "<urn:page:7>"]
    assert look.fetch("http://a.example.com/y")[0][1] == b"small" and look.fetch("http://nowhere.example/") == []
    assert look.fetch("http://b.example.org/\r\nInjected: 1")[0][1] == b"" or look.fetch("http://b.example.org/\r\nInjected: 1")[0][0]["WARC-Type"] == "revisit"
    some = warc.read_captures(df.where("page_id in (1, 6)").unionByName(df.where("page_id = 6")), index)
    assert sorted(r["id"] for r in some.collect()) == ["1", "6", "7"]
    empty, none = shared_path(spark, "warc"), shared_path(spark, "index")
    warc.write_archives(df.limit(0), empty)
    assert warc.build_index(spark, empty, none).count() == 0 and warc.read_captures(df, none).count() == 0


def test_warc_hot_url_and_file_sizes(spark, tmp_path):
    """A URL whose captures fill several index files, beside others; archives close by bytes, long records count for more."""
    import os

    noise = "".join(chr(33 + (i * i * 7 + i // 3) % 90) for i in range(3000))
    df = spark.range(900).coalesce(1).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("http://z.example/"), F.col("id"))).otherwise("http://hot.example/").alias("url"), F.concat(F.col("id").cast("string"), F.lit(noise)).alias("html"))
    long = spark.range(2).select((F.col("id") + 1000).alias("page_id"), F.lit("http://long.example/").alias("url"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(90_000)), lambda i: F.sha2(F.concat(i, F.col("id")).cast("binary"), 256)), "").alias("html")).coalesce(1)
    pages, archives, index = df.unionByName(long).coalesce(1), f"{tmp_path}/warc", f"{tmp_path}/index"
    warc.write_archives(pages, archives, archive_bytes=2 << 20)
    sizes = [os.path.getsize(f"{archives}/{n}") for n in os.listdir(archives) if n.startswith("part-")]
    assert len([x for x in sizes if x > 1000]) >= 2 and sum(sizes) > 5 << 20 and max(sizes) < 6 << 20
    warc.build_index(spark, archives, index, lines_a_block=20, blocks_a_file=3)
    got = warc.read_captures(pages, index)
    assert sorted(int(r["id"]) for r in got.collect()) == [*range(900), 1000, 1001]
    hot = warc.read_captures(spark.createDataFrame([("http://hot.example/",), ("http://hot.example/",)], "url string"), index)
    assert hot.count() == 600


def test_damaged_archives_raise():
    data = warc.member(warc.record(1, "http://a/", b"text", 4, hashlib.sha1(b"other").hexdigest(), None))
    with pytest.raises(ValueError, match="damaged"):
        warc._checked(data)
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(data[:-9]))


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("pages", "documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{DIR}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = sorted((tuple(r) for r in queries.QUERIES[name](spark, DIR).select(*columns).collect()), key=str)
    assert got == sorted(want.fetchall(), key=str)


def test_url_keys():
    assert warc.url_key("https://user@WWW.Example.com:443/a?b=1#c") == "com,example,www)/a?b=1"
    assert warc.url_key("http://example.com:8080") == "com,example:8080)/"


# -- pipeline
def test_pipeline(spark, rows):
    import corpus_pipeline
    from pyspark.sql import DataFrame

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "secrets", "packing"]
    docs: DataFrame = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        docs = out
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    want, _ = plain_components({d: t for d, t in rows.items() if d in {r["doc_id"] for r in docs.collect()}}, 80)
    assert all(d == c for d, c in want.items())  # no two of those kept are near duplicates
    assert not any(re.search("token = \"[0-9a-f]{40}", t) for t in left.values())
    packed = corpus_pipeline.run(spark, DIR)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(left)
