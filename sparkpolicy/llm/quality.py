"""Document quality by regularised quadratic discriminant analysis.

A document becomes a few transformed statistics (lengths, shares of character classes, repetition). Each
class is a Gaussian over them; its covariance is shrunk towards the pooled diagonal, so that it stays
well-conditioned. The score is the posterior of class 1 from the difference of the Mahalanobis
log-densities; the Cholesky factors are computed once and kept with the model.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_texts, table, written

#: What :func:`statistics` measures, in order.
STATISTICS = ("log_chars", "log_words", "word_length", "upper", "digits", "blanks", "marks", "symbols", "distinct_words", "repeats", "top_word", "distinct_lines", "log_line_words")
THRESHOLD = 0.7
_UPPER, _LOWER, _DIGIT, _BLANK, _MARK, _SYMBOL = range(6)


@cache
def _classes() -> np.ndarray:
    """The character class of each code point."""
    out = np.full(0x110000, _SYMBOL, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            out[c] = _UPPER if x.isupper() else _LOWER
        elif x.isdigit():
            out[c] = _DIGIT
        elif x.isspace():
            out[c] = _BLANK
    out[[ord(x) for x in ".,;:!?'\"()-"]] = _MARK
    return out


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; a null text counts as an empty one."""
    text = text or ""
    n = len(text)
    kinds = np.bincount(_classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=6)
    words = text.split()
    m = len(words)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    root = lambda part, whole: math.sqrt(part / whole) if whole else 0.0
    return [
        math.log1p(n),
        math.log1p(m),
        math.log1p((n - int(kinds[_BLANK])) / m) if m else 0.0,
        root(int(kinds[_UPPER]), int(kinds[_UPPER] + kinds[_LOWER])),
        root(int(kinds[_DIGIT]), n),
        root(int(kinds[_BLANK]), n),
        root(int(kinds[_MARK]), n),
        root(int(kinds[_SYMBOL]), n),
        math.log1p(len(counts)) / math.log1p(m) if m else 1.0,
        root(sum(map(str.__eq__, words, words[1:])), m),
        root(max(counts.values(), default=0), m),
        len(set(lines)) / len(lines) if lines else 1.0,
        math.log1p(m / len(lines)) if lines else 0.0,
    ]


@dataclass(frozen=True)
class Quadratic:
    """Mean, inverse Cholesky factor and log-determinant of each class, and the log prior ratio.

    Where a class has fewer than two rows there is nothing to tell apart: ``means`` is empty and every
    score is ``share``, the share of class 1 (one half without any row).
    """

    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    logdets: tuple[float, ...]
    prior: float
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        at = [-0.5 * ((((x - m) @ f.T) ** 2).sum(1) + d) for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(at[1] - at[0] + self.prior, -40, 40)))


def featurize(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``stats`` (array of double) of every row.

    A null text counts as an empty one; texts are read whole; repeated rows are measured each; an empty table gives no row. Other
    columns are ignored.
    """

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(t.as_py()) for t in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(pa.float64()))], ["id", "stats"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(slim, f"id {slim.schema['id'].dataType.simpleString()}, stats array<double>", measure)


def fit(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", shrinkage: float = 0.1) -> Quadratic:
    """Fit on all rows of ``stats`` that have a label.

    Labels other than 0 and 1 and null ids count as missing; several labels of a document are averaged, and
    a half counts as 1. Only class sums come to the driver.
    """
    p = len(STATISTICS)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg((F.avg("y") >= 0.5).alias("y"))
    x = [F.col("stats")[i] for i in range(p)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)]
    got = {r["y"]: r for r in stats.join(known, "id").groupBy("y").agg(F.count("*").alias("n"), *sums).collect()}
    n = [got[c]["n"] if c in got else 0 for c in (False, True)]
    share = n[1] / sum(n) if sum(n) else 0.5
    if min(n) < 2:
        return Quadratic((), (), (), 0.0, share)
    means, covs = [], []
    for c, k in zip((False, True), n, strict=True):
        m = np.array([got[c][f"s{i}"] for i in range(p)]) / k
        q = np.array([[got[c][f"q{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) / k
        means.append(m)
        covs.append(q - np.outer(m, m))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    target = np.diag(np.maximum(np.diag(pooled), 1e-6))
    factors, logdets = [], []
    for cov in covs:
        lower = np.linalg.cholesky((1 - shrinkage) * cov + shrinkage * target)
        factors.append(np.linalg.inv(lower))
        logdets.append(2 * float(np.log(np.diag(lower)).sum()))
    return Quadratic(tuple(means), tuple(factors), tuple(logdets), math.log(n[1] / n[0]), share)


def predict(stats: DataFrame, model: Quadratic, *, threshold: float = THRESHOLD) -> DataFrame:
    """``id``, ``score`` and ``predicted`` (1 from ``threshold`` on) of every row of :func:`featurize`.

    Repeated rows are scored each, an empty table gives no row; a model without both classes scores all rows alike.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.asarray(batch.column("stats").flatten()).reshape(batch.num_rows, -1)
        score = model.score(x)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    return map_texts(stats, f"id {stats.schema['id'].dataType.simpleString()}, score double, predicted int", run)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = written(featurize(docs), "quality-stats")
    fold = crc_mod("id", 4)
    model = fit(stats.where(fold != 2), table(spark, sf_dir, "labels"))
    return predict(stats, model).select(F.col("id").alias("doc_id"), F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, *, least: float = THRESHOLD) -> DataFrame:
    """Pipeline stage: documents with a score under ``least`` go.

    The model is learnt from the stage's own input and the labels outside the held-out quarter; without
    both classes nothing is rejected. Texts are read once to fit and once to score, and never shuffled. A null text
    counts as an empty one; repeated rows are decided alike; an empty table gives no row.
    """
    stats = written(featurize(docs.where(crc_mod("doc_id", 4) != 2)), "quality-stats")
    model = fit(stats, table(spark, sf_dir, "labels"))
    at = docs.columns.index("text")

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not model.means:
            return batch
        score = model.score(np.array([statistics(t.as_py()) for t in batch.column(at)]))
        return batch.filter(pa.array(score >= least))

    return map_texts(docs, docs.schema, kept)
