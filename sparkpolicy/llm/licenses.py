"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest licensed directory.

The candidates are the notices of a file: its lines that speak of licensing, headers and paragraphs of such lines, and then the
whole text too. They are compared with templates of notices and with the full texts of licences. A notice's terms are weighted
by frequency and by how rare they are among all files with a notice and the templates; the counts of all terms stay in a
table. A notice has the licence of the template with the largest cosine, if that is large enough and the notice has the words
that name the licence. A file that is a licence file, by its name or as much
of it, or all, is licence text, licenses its directory, and files without a notice of their own inherit from the
nearest ancestor directory that is licensed. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Notices and grants by SPDX identifier; a licence may have several, and wording that several share has them all.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause Simplified License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-2-Clause OR BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal waiver"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0 OR GPL-3.0", "GNU General Public License"),
    ("HPND", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC", "Released under the ISC License"),
    ("LGPL-2.1 OR LGPL-3.0", "GNU Lesser General Public License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
TEMPLATES += tuple((k, f"SPDX-License-Identifier: {k}") for k in sorted({k for k, _ in TEMPLATES if " OR " not in k}))
NOTICE = r"(?i)licen[cs]|copying permission|public domain|unencumbered|redistribution (and|or) use|permission (is|to)\b|hereby grant|free of charge|warrant(y|ies) of"
NAMED = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"
#: Words that name licences: a notice has those of its template, as "the Foo License" isn't the MIT License.
NAMES = ("affero", "agpl", "apache", "bsd", "by", "cc", "cc0", "commons", "gnu", "gpl", "hpnd", "isc", "lesser", "lgpl", "mit", "mozilla", "mpl", "nc", "sa", "unlicense")
#: Versions that tell licences apart which share wording, and words that these licences' notices don't have.
VERSIONS = ("2", "2.0", "2.1", "3", "3.0")
BARRED = {"GPL-2.0": ("affero", "agpl", "lesser", "lgpl"), "GPL-3.0": ("affero", "agpl", "lesser", "lgpl")}
BLANK_LINE, OTHER_LINE, NOTICE_LINE = 0, 1, 2
#: Smallest cosine of a notice, and the share of a text that makes it a licence file.
LEAST_COSINE = 0.5
#: Smallest cosine to the full text of a licence.
LEAST_TEXT_COSINE = 0.8
LICENSE_SHARE = 0.25


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """The licences in ``license_texts``: identifier and full text."""
    return tuple((p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def terms(text: Column) -> Column:
    """The lower-case words and numbers of a text, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?=\s|$)"), lambda t: t != "")


def telling(license: str, text: str, templates: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    """The words of a template that a notice must have: names, and the version where other versions share wording."""
    shared = {x for k, _ in templates if " OR " in k for x in k.split(" OR ")}
    found = re.split(r"[^\w.]+|\.(?=\s|$)", text.lower())
    return tuple(t for t in (*NAMES, *(VERSIONS if license in shared else ())) if t in found)


def _runs(kinds: Column, least: int) -> Column:
    """The runs of adjoining lines of at least a kind, each (first, last)."""
    n = F.size(kinds)
    breaks = F.concat(F.array(F.lit(-1)), F.filter(F.sequence(F.lit(0), n - 1), lambda i: kinds[i] < least), F.array(n))
    runs = lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda k: F.struct((b[k] + 1).alias("first"), (b[k + 1] - 1).alias("last")))
    return F.filter(F.transform(F.array(breaks), runs)[0], lambda x: x["first"] <= x["last"])


def spans(kinds: Column) -> Column:
    """The stretches of lines that are scored, each (first, last), from the kinds of a text's lines.

    They are its notice lines, runs of adjoining ones, paragraphs that hold one, all from the first of these to
    the last, and the whole text.
    """
    one = F.transform(F.filter(F.sequence(F.lit(0), F.size(kinds) - 1), lambda i: kinds[i] == NOTICE_LINE), lambda i: F.struct(i.alias("first"), i.alias("last")))
    paragraphs = F.filter(_runs(kinds, OTHER_LINE), lambda x: F.array_contains(F.slice(kinds, x["first"] + 1, x["last"] - x["first"] + 1), NOTICE_LINE))
    extent = lambda p: F.struct(p[0]["first"].alias("first"), F.element_at(p, -1)["last"].alias("last"))
    return F.array_distinct(F.concat(one, _runs(kinds, NOTICE_LINE), paragraphs, F.transform(F.array(paragraphs), extent), F.array(F.struct(F.lit(0).alias("first"), (F.size(kinds) - 1).alias("last")))))


def _weight(n: Column, held: Column, texts: int) -> Column:
    """The weight of a term that occurs ``n`` times in a text and stands in ``held`` of all ``texts``.

    The rarity lies between 1 and 2 at every number of texts, so that a decision doesn't hang on it.
    """
    return (F.log(n.cast("double")) + 1) * (F.lit(1.0) + F.log(F.lit(1.0 + texts) / (1 + held)) / math.log(1 + texts))


def scan_notices(files: DataFrame, *, path_col: str = "path", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """``path``, ``n_chars``, ``license``, ``cosine`` and ``notice_chars`` of every row, from its best notice.

    ``notice_chars`` counts all lines that belong to some stretch with a licence: lines, headers, paragraphs or all.
    Without a notice that is close enough ``license`` is null and ``cosine`` 0; a null text is empty. A licence
    in full goes before notices, and these go before wording that licences share (``A OR B``); of equal cosines the licence that
    sorts first wins. Repeated rows give repeated results.
    """
    spark = files.sparkSession
    slim = files.select(F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = lambda x: F.when(x.rlike(NOTICE), NOTICE_LINE).when(x.rlike(r"[\p{L}\p{N}]"), OTHER_LINE).otherwise(BLANK_LINE)
    lines = F.when(F.col("text").rlike(NOTICE), F.transform(F.split("text", "\n"), lambda x: F.trim(x)))
    kinds = F.when(F.col("text").rlike(NOTICE), F.transform(F.split("text", "\n"), kind))
    named = slim.select("path", F.char_length("text").alias("n_chars"), lines.alias("lines"), kinds.alias("kinds"), F.monotonically_increasing_id().alias("row"))
    named = written(named, "files")
    candidates = named.where("lines is not null")
    least_of = [least] * len(templates) + [LEAST_TEXT_COSINE] * len(full_texts())
    needed_of = [" ".join(telling(k, v, templates)) for k, v in sorted(templates)] + [""] * len(full_texts())
    barred_of = [" ".join(BARRED.get(k, ())) for k, _ in sorted(templates)] + [""] * len(full_texts())
    templates, n_notices = [*sorted(templates), *full_texts()], len(templates)
    listed = F.split(F.lit("\x1f".join(v for _, v in templates)), "\x1f")
    models = spark.range(1).select(F.posexplode(listed).alias("at", "text")).select("at", F.explode(terms(F.col("text"))).alias("term"))
    models = written(models.groupBy("at", "term").agg(F.count("*").alias("n")), "license-templates")

    # How many candidates and templates hold each term; all candidates and all terms count.
    held = candidates.select(F.explode(F.array_distinct(terms(F.array_join("lines", "\n")))).alias("term")).unionAll(models.select("term"))
    held = written(held.groupBy("term").agg(F.count("*").alias("held")), "license-terms")
    texts = candidates.count() + len(templates)

    # The terms of the templates are bounded, whatever the files are.
    weighed = models.join(held.hint("merge"), "term").select("at", "term", _weight(F.col("n"), F.col("held"), texts).alias("w"))
    norms = weighed.groupBy("at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    shares = written(weighed.join(norms.hint("broadcast"), "at").select("at", "term", (F.col("w") / F.col("norm")).alias("share")), "license-shares")

    # Each distinct stretch is scored once.
    joined = lambda x: F.array_join(F.slice("lines", x["first"] + 1, x["last"] - x["first"] + 1), "\n")
    units = candidates.select("row", F.explode(F.transform(spans(F.col("kinds")), lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), joined(x).alias("text")))).alias("u"))
    units = written(units.select("row", "u.first", "u.last", F.sha2(F.col("u.text").cast("binary"), 256).alias("key"), "u.text"), "notices")
    counted = units.groupBy("key").agg(F.first("text").alias("text")).select("key", F.explode(terms(F.col("text"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("n"))
    vectors = counted.join(held.hint("merge"), "term").select("key", "term", _weight(F.col("n"), F.col("held"), texts).alias("w"))
    vectors = written(vectors, "notice-terms")
    norms = vectors.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_set(F.when(F.col("term").isin(*NAMES, *VERSIONS), F.col("term"))).alias("names"))
    dots = vectors.join(shares.hint("broadcast"), "term").groupBy("key", "at").agg(F.sum(F.col("w") * F.col("share")).alias("dot")).join(norms.hint("merge"), "key")
    of = lambda values: F.split(F.lit("\x1f".join(values)), "\x1f")[F.col("at")]
    words_of = lambda values: F.filter(F.split(of(values), " "), lambda t: t != "")
    fits = (F.size(F.array_except(words_of(needed_of), "names")) == 0) & ~F.arrays_overlap(words_of(barred_of), F.col("names"))
    scored = dots.select("key", "at", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine"), of([k for k, _ in templates]).alias("license"), of([str(x) for x in least_of]).cast("double").alias("least"), fits.alias("named"))
    scored = scored.where((F.col("cosine") >= F.col("least")) & F.col("named")).groupBy("key").agg(F.min(F.struct((F.col("at") < n_notices).alias("notice"), F.contains("license", F.lit(" OR ")).alias("shared"), (-F.col("cosine")).alias("less"), "license")).alias("best"))

    found = units.select("row", "first", "last", "key").join(scored.hint("merge"), "key")
    top = found.groupBy("row").agg(F.min("best").alias("best"), F.collect_list(F.struct("first", "last")).alias("spans"))
    out = named.join(top, "row", "left")
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["first"], x["last"]))))
    size = F.aggregate(covered, F.lit(0), lambda n, i: n + F.char_length(F.col("lines")[i]))
    return out.select("path", "n_chars", F.col("best.license").alias("license"), F.coalesce(-F.col("best.less"), F.lit(0.0)).alias("cosine"), F.coalesce(size, F.lit(0)).alias("notice_chars"))


def directories(path: Column) -> Column:
    """The directories above a path, nearest first, each with its distance; the root is the empty string."""
    parts = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("up"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/").alias("dir")))


def license_files(files: DataFrame, *, path_col: str = "path", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST_COSINE, share: float = LICENSE_SHARE) -> DataFrame:
    """``path``, ``license``, ``cosine``, ``origin`` and ``licensed_dir`` of every row.

    ``origin`` is ``own`` for a notice in the file, ``inherited`` for the licence of the nearest ancestor directory
    (``licensed_dir``) with a licence file, and null where there is neither. Of a directory's several
    licence files one that its name tells goes first, then the largest cosine, then the path that sorts first. A row
    without a path has its own licence or none.
    """
    found = written(scan_notices(files, path_col=path_col, text_col=text_col, templates=templates, least=least), "own-licenses")
    name, above = F.element_at(F.split("path", "/"), -1), F.element_at(directories(F.col("path")), 1)["dir"]
    is_file = F.coalesce(name.rlike(NAMED), F.lit(False)) | (F.col("notice_chars") >= F.lit(share) * F.col("n_chars"))
    licensed = found.where(F.col("license").isNotNull() & F.col("path").isNotNull() & is_file)
    by_dir = licensed.groupBy(above.alias("dir")).agg(F.min_by("license", F.struct(~name.rlike(NAMED), -F.col("cosine"), "path")).alias("inherited"))
    # Directories are few against files, and each is resolved once.
    wanted = found.where("license is null and path is not null").select(above.alias("home")).distinct()
    ladder = wanted.select("home", F.explode(directories(F.concat("home", F.lit("/x")))).alias("d")).select("home", "d.up", "d.dir")
    nearest = ladder.join(by_dir, "dir").groupBy("home").agg(F.min_by(F.struct("inherited", "dir"), "up").alias("from"))
    nearest = written(nearest.select("home", "from.inherited", "from.dir"), "inherited-licenses")
    out = found.withColumn("home", F.when(F.col("license").isNull(), above)).join(nearest, "home", "left")
    return out.select(
        "path",
        F.coalesce("license", "inherited").alias("license"),
        "cosine",
        F.when(F.col("license").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("license").isNull(), F.col("dir")).alias("licensed_dir"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, as files in a tree of sources and id ranges."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.expr("doc_id div 1000").cast("string"), F.expr("doc_id div 50").cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    found = license_files(docs.select(path.alias("path"), "text"))
    return found.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"), "path", "license", "cosine", "origin", "licensed_dir")
