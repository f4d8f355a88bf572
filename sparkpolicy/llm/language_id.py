"""Language identification by rank-order n-gram profiles.

A profile is a language's most frequent character n-grams (one to three letters, words padded with a
blank), most frequent first. A text is compared with each profile by the out-of-place distance: the sum,
over the text's own most frequent n-grams, of how far the rank in the text is from the rank in the
profile, with a fixed penalty for n-grams that the profile lacks. The nearest profile wins.

The profiles are learnt from a bounded sample of the labelled rows: of each language about
``sample_per_lang`` documents, chosen by a hash of the id, whole texts. Scoring covers every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, map_texts, table

UND = "und"
#: The pipeline rejects what is less like every language than this, if it has so many distinct n-grams.
LEAST_SCORE, LEAST_GRAMS = 0.3, 50
#: One n-gram holds up to three code points of 21 bits each.
_BITS = 21


@dataclass(frozen=True)
class Profiles:
    """Ranked n-grams by language, as a sorted key table: ``ranks[i, k]`` is the rank of ``keys[k]``."""

    langs: tuple[str, ...]
    keys: np.ndarray
    ranks: np.ndarray
    size: int


@cache
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a blank."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.int64)


def points(text: str) -> np.ndarray:
    """A text's words as lower-case code points, one blank before and after each; empty without a letter."""
    c = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = c == 32
    c = c[~(blank & np.concatenate([[False], blank[:-1]]))]
    return c if len(c) > 1 else c[:0]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams (1 to 3) of a text's words as integers, and how often each occurs."""
    c = points(text)
    if not len(c):
        return c, c
    there = np.flatnonzero(np.bincount(c))
    k = len(there)
    if k > 64:  # a large alphabet: sort instead of counting into a table
        middle = c[1:-1] != 32
        return np.unique(np.concatenate([c[c != 32], c[:-1] << _BITS | c[1:], (c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:])[middle]]), return_counts=True)
    dense = np.zeros(there[-1] + 1, np.int64)
    dense[there] = np.arange(k)
    d = dense[c]
    pair = d[:-1] * k + d[1:]
    three = (pair[:-1] * k + d[2:])[d[1:-1] != 0]  # a blank has the lowest code point of all
    found, counts = [], []
    for n, coded in ((1, d[d != 0]), (2, pair), (3, three)):
        table = np.bincount(coded, minlength=1)
        at = np.flatnonzero(table)
        counts.append(table[at])
        key = np.zeros(len(at), np.int64)
        for i in range(n):
            key |= there[at // k**i % k] << _BITS * i
        found.append(key)
    return np.concatenate(found), np.concatenate(counts)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent keys, most frequent first; ties by the key, so the order is fixed."""
    if len(keys) > size:
        cut = np.partition(counts, len(counts) - size)[len(counts) - size]
        held = counts >= cut
        keys, counts = keys[held], counts[held]
    return keys[np.lexsort((keys, -counts))][:size]


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = 400, sample_per_lang: int = 1500, max_langs: int = 512) -> Profiles:
    """Learn profiles from the labelled rows of ``docs``.

    Rows with a null text or language are left out. ``sample_per_lang`` bounds (in expectation) the
    documents that are counted for a language. At most ``max_langs`` languages may occur; more raise
    ``ValueError``. An empty table gives profiles without a language.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = known.groupBy("lang").count().limit(max_langs + 1).collect()
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not sizes:
        return Profiles((), np.empty(0, np.int64), np.empty((0, 0), np.int32), size)
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, sample_per_lang / r["count"])))])
    unit = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("profile")), F.lit(1 << 20)) / float(1 << 20)
    sample = known.where(unit < F.element_at(share, F.col("lang")))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text")
        out = [(lang, *counted(text.as_py())) for lang, text in zip(langs, texts, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x for lang, k, _ in out for x in [lang] * len(k)], pa.string()),
                pa.array(np.concatenate([k for _, k, _ in out]), pa.int64()),
                pa.array(np.concatenate([n for _, _, n in out]).astype(np.int64), pa.int64()),
            ],
            ["lang", "gram", "n"],
        )

    counts = map_texts(sample.select("lang", "text"), "lang string, gram long, n long", count).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The profile itself: at most max_langs * size rows come back.
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size).collect()
    langs = tuple(sorted(r["lang"] for r in sizes))
    keys = np.unique(np.array([r["gram"] for r in top], np.int64))
    ranks = np.full((len(langs), len(keys)), size, np.int32)
    at = {lang: i for i, lang in enumerate(langs)}
    for r in top:
        ranks[at[r["lang"]], np.searchsorted(keys, r["gram"])] = r["rank"] - 1
    return Profiles(langs, keys, ranks, size)


def identify(text: str | None, p: Profiles) -> tuple[str, float]:
    """Language and score of one text; see :func:`predict`."""
    if text is None or not p.langs:
        return UND, 0.0
    found = counted(text)
    if not len(found[0]):
        return UND, 0.0
    own = ranked(*found, p.size)
    at = np.searchsorted(p.keys, own)
    at[at == len(p.keys)] = 0
    hit = p.keys[at] == own
    rank = np.arange(len(own), dtype=np.int32)
    there = p.ranks[:, at]
    apart = np.where(hit & (there < p.size), np.abs(there - rank), p.size).sum(1)
    best = int(np.argmin(apart))
    return p.langs[best], 1.0 - float(apart[best]) / (p.size * len(own))


def predict(docs: DataFrame, profiles: Profiles, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` of every row, with the columns in ``keep``.

    ``score`` is one minus the out-of-place distance over the largest possible one. A null text, an empty
    one and one without a letter are ``und`` with score 0, as is every text when no language was learnt.
    Ties go to the language that sorts first. Texts are read whole; repeated rows give repeated results.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(profiles)  # at most max_langs * size entries
    slim = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text"), *[F.col(c).alias(f"x_{i}") for i, c in enumerate(keep)])

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = sent.value
        found = [identify(t.as_py(), p) for t in batch.column("text")]
        rest = [n for n in batch.schema.names if n != "text"]
        return pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in rest], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
            [*rest, "lang_pred", "score"],
        )

    rest = [f for f in slim.schema.fields if f.name != "text"]
    out = map_texts(slim, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", lang_pred string, score double", score)
    return out.select(F.col("k").alias(id_col), *[F.col(f"x_{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the rows outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = crc_mod("doc_id", 3)
    profiles = fit(docs.where(fold != 1))
    out = predict(docs, profiles)
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str, *, least_score: float = LEAST_SCORE, least_grams: int = LEAST_GRAMS) -> DataFrame:
    """Pipeline stage: documents in none of the learnt languages go.

    These are texts without a language (null, empty, no letter), and texts of at least ``least_grams`` distinct n-grams whose
    score for the nearest language is under ``least_score``: other scripts and languages, codes, noise. Shorter texts give too
    little to be rejected by. Where no language is labelled, documents with a letter stay. The profiles are learnt from the
    labelled rows of the stage's own input. Texts are read whole; repeated rows are decided alike; an empty table gives no row.
    """
    cols = docs.columns
    profiles = fit(docs)
    sent = spark.sparkContext.broadcast(profiles)  # at most max_langs * size entries

    def known(text: str | None) -> bool:
        if not sent.value.langs:
            return bool(len(points(text or "")))
        lang, score = identify(text, sent.value)
        return lang != UND and (score >= least_score or len(counted(text)[0]) < least_grams)

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(cols.index("text"))
        return batch.filter(pa.array([known(t.as_py()) for t in texts], pa.bool_()))

    return map_texts(docs, docs.schema, kept)
