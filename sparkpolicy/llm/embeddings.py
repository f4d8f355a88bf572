"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine of at least c are at a squared distance of at most D = 2 - 2c. After a fixed random
rotation the coordinates are split into blocks of few dimensions, and each block gets the share of D that
its dimensions have; two vectors within D must be within that budget in at least one block. So each block is
joined by range: along each of its dimensions, and of the dimensions of a second rotation of the block, the vectors fall
into cells a fraction of the budget's root wide, and a bitmap for each cell says which vectors are within reach of it. The
intersection of a vector's bitmaps over all dimensions leaves few, whose distance in the block is then computed. What is within the budget is verified with the cosine of the whole vectors in double precision, in the
first block that lets the pair through, so that no pair counts twice.

Equal vectors collapse first. The vectors of a label are dealt into tiles, and each pair of tiles is a task that joins
all blocks, so that a vector is sent once for each tile of its label and not for each block. A task sends out a count for
each vector and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table, written
from .components import components

BLOCK = 16
#: Vectors of a tile at least; a label has up to ``TILES`` tiles until a tile has ``TILE_BYTES``.
TILE, TILES, TILE_BYTES = 1024, 16, 8 << 20
#: Cells in a block's reach, and along a dimension at most.
FINE, MOST_CELLS = 16, 512
#: Vectors looked up together, bitmap words unpacked together, and numbers of a slice of pairs.
_ROWS, _WORDS, _SLICE = 256, 1 << 13, 1 << 20


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int) -> list[slice]:
    ends = np.cumsum([len(x) for x in np.array_split(np.arange(dim), max(1, math.ceil(dim / BLOCK)))])
    return [slice(int(a), int(b)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def budgets(dim: int, cosine: float) -> list[float]:
    """Squared distance that each block may have, a trifle larger than its share for the sake of rounding."""
    whole = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12
    return [whole * (b.stop - b.start) / dim for b in blocks(dim)]


def _read(raw: pa.Array | pd.Series, dim: int) -> np.ndarray:
    """Vectors as doubles from their bytes, which are those of floats or of doubles."""
    data = b"".join(x.as_py() if isinstance(x, pa.Scalar) else x for x in raw)
    kind = np.float32 if len(data) == 4 * dim * len(raw) else np.float64
    return np.frombuffer(data, kind).reshape(-1, dim).astype(np.float64)


def _rotated(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ rotation(vectors.shape[1])


class Bitmaps:
    """Range lookups in a block: which of its vectors lie in a box around a point."""

    def __init__(self, part: np.ndarray, reach: float) -> None:
        self.turn = rotation(part.shape[1])
        axes = self._axes(part)
        self.low = axes.min(0) - reach - 1e-9
        span = axes.max(0) + reach + 1e-9 - self.low
        self.width = np.maximum(reach / FINE, span / MOST_CELLS) + 1e-12
        self.cells = np.ceil(span / self.width).astype(np.int64) + 1
        codes = ((axes - self.low) / self.width).astype(np.int64)
        far = np.ceil(reach / self.width + 1e-6).astype(np.int64)
        words = -(-len(part) // 64)
        self.within = []  # for each dimension and cell the vectors within reach of some point of the cell, as words of 64
        for j, cells in enumerate(self.cells.tolist()):
            bits = np.zeros((cells + 1, words * 8), np.uint8)
            bits[:, : -(-len(part) // 8)] = np.packbits(codes[:, j].astype(np.int16) < np.arange(cells + 1, dtype=np.int16)[:, None], axis=1, bitorder="little")
            below, at = bits.view(np.uint64), np.arange(cells)
            self.within.append(below[np.minimum(at + far[j] + 1, cells)] & ~below[np.maximum(at - far[j], 0)])

    def _axes(self, part: np.ndarray) -> np.ndarray:
        return np.hstack([part, part @ self.turn]) if part.shape[1] > 1 else part

    def near(self, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a row of ``part`` and a vector in its box, in bounded numbers."""
        codes = np.floor((self._axes(part) - self.low) / self.width).astype(np.int64)
        inside = np.flatnonzero(((codes >= 0) & (codes < self.cells)).all(1))  # who is outside is out of reach of all
        codes = codes[inside]
        held = self.within[0][codes[:, 0]]
        more = np.empty_like(held)
        for j, within in enumerate(self.within[1:], 1):
            np.take(within, codes[:, j], axis=0, out=more, mode="clip")
            np.bitwise_and(held, more, out=held)
        flat, wide = held.ravel(), held.shape[1]
        some = np.flatnonzero(flat)
        for at in range(0, len(some), _WORDS):
            place = some[at : at + _WORDS]
            bits = np.flatnonzero(np.unpackbits(flat[place].view(np.uint8), bitorder="little").view(bool))
            row, word = np.divmod(place[bits >> 6], wide)
            yield inside[row], word * 64 + (bits & 63)


def _square(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of rows ``i`` of ``a`` and ``j`` of ``b``, in bounded slices."""
    step = max(1, _SLICE // max(1, a.shape[1]))
    return np.concatenate([((a[i[k : k + step]] - b[j[k : k + step]]) ** 2).sum(1) for k in range(0, len(i), step)] or [np.empty(0)])


def _cosines(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    step = max(1, _SLICE // max(1, a.shape[1]))
    return np.concatenate([(a[i[k : k + step]] * b[j[k : k + step]]).sum(1) for k in range(0, len(i), step)] or [np.empty(0)])


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over whole arrays; a root is the smallest of its set."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def join_tiles(vectors: np.ndarray, copies: np.ndarray, one: np.ndarray, two: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector the rows linked with it, the position of its root, and how many pairs' distances were computed.

    ``one`` and ``two`` are the positions of two tiles, or of one tile if they are equal.
    """
    n, dim = vectors.shape
    same = np.array_equal(one, two)
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])  # by powers of two, so that no square overflows
    turned, norms = _rotated(vectors), np.linalg.norm(vectors, axis=1)
    spans, most = blocks(dim), budgets(dim, cosine)
    links, parent, examined = np.zeros(n, np.int64), np.arange(n), 0
    for block, (span, budget) in enumerate(zip(spans, most, strict=True)):
        maps = Bitmaps(turned[two][:, span], math.sqrt(budget))
        for at in range(0, len(one), _ROWS):
            for i, j in maps.near(turned[one[at : at + _ROWS]][:, span]):
                a, b = one[at + i], two[j]
                if same:
                    a, b = a[a < b], b[a < b]
                examined += len(a)
                for k, (other, limit) in enumerate(zip(spans[: block + 1], most, strict=False)):
                    within = _square(turned[:, other], a, turned[:, other], b) <= limit
                    keep = within if k == block else ~within  # an earlier block has had the pair
                    a, b = a[keep], b[keep]
                linked = _cosines(vectors, a, vectors, b) >= cosine * norms[a] * norms[b]
                a, b = a[linked], b[linked]
                links += np.bincount(a, copies[b], n).astype(np.int64) + np.bincount(b, copies[a], n).astype(np.int64)
                parent = _merge(parent, a, b)
    return links, parent, examined


def similar_vectors(vectors: DataFrame, *, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Vectors of the same non-null label and dimension are linked when their cosine is at least ``cosine``. A
    vector that is null, empty, zero or holds null or non-finite components links with nothing, as does a row
    without label or id. Rows of equal vectors are linked with one another, repeated rows too; rows that repeat an id
    under other labels or with other vectors are linked for themselves, and ``component_id`` is the smallest id of the rows that a
    row reaches. An empty table gives no row; other columns are ignored.
    """
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"), F.col(label_col).cast("string").alias("label"))
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("vec", lambda c: c != 0)
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    v = v.select("id", "label", F.when(usable, F.col("vec")).alias("vec")).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(7), "vec"), "dim": F.size("vec")})
    usable = F.col("vec").isNotNull()
    distinct = v.where(usable).groupBy("label", "dim", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"))

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [x.values.to_numpy(zero_copy_only=False).tobytes() for x in batch.column("vec")]
        at = batch.schema.get_field_index("vec")
        return batch.set_column(at, "vec", pa.array(raw, pa.binary()))

    kinds = [f"{f.name} {'binary' if f.name == 'vec' else f.dataType.simpleString()}" for f in distinct.schema.fields]
    # A class of equal vectors has a number, which stays as it is once it is written.
    classes = written(map_texts(distinct, ", ".join(kinds), packed).withColumn("node", F.monotonically_increasing_id()), "vector-classes")

    group = ["label", "dim"]
    by_bytes = F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES) / (4 * F.col("dim"))))
    a_tile = F.greatest(F.lit(1), F.least(by_bytes, F.greatest(F.lit(TILE), F.ceil(F.col("size") / TILES))))
    sizes = classes.groupBy(*group).agg(F.count("*").alias("size")).where("size > 1").select(*group, F.ceil(F.col("size") / a_tile).cast("int").alias("tiles"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    dealt = classes.join(written(sizes, "vector-tiles"), group).select(*group, "node", "copies", "vec", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"), "tiles").select("*", other)
    dealt = dealt.select(*group, "node", "copies", "vec", "tile", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2")).repartition(*group, "t1", "t2")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        head, tile, node = pdf.iloc[0], pdf["tile"].to_numpy(), pdf["node"].to_numpy()
        one, two = np.flatnonzero(tile == head["t1"]), np.flatnonzero(tile == head["t2"])
        if not len(one) or not len(two):
            return pd.DataFrame({"a": node[:0], "b": node[:0], "n": node[:0]})
        links, root, _ = join_tiles(_read(pdf["vec"], int(head["dim"])), pdf["copies"].to_numpy(), one, two, cosine)
        found = links > 0
        return pd.DataFrame({"a": node[found], "b": node[root][found], "n": links[found]})

    linked = written(dealt.groupBy(*group, "t1", "t2").applyInPandas(join, "a long, b long, n long"), "vector-links")
    groups = written(components(linked), "vector-components")
    named = classes.select(*group, "h1", "h2", "rep", "copies", "node")
    least = groups.join(named.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    reached = groups.join(least, "component").select("node", "least")
    counts = linked.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = named.join(counts, "node", "left").join(reached, "node", "left")
    named = written(named.select(*group, "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("least", "rep").alias("component")), "named-vectors")
    out = v.select("id", usable.alias("usable"), *group, "h1", "h2")
    alone = out.where("not usable").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    joined = out.where("usable").select("id", *group, "h1", "h2").join(named, [*group, "h1", "h2"]).select("id", "links", "component")
    every = joined.unionByName(alone)
    return every.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all vectors at a cosine of 0.93."""
    return similar_vectors(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
), u as (
  select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v
  where label is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), l as (
  select x.vec_id as a, y.vec_id as b from u x join u y on x.label = y.label and x.vec_id <> y.vec_id and len(x.e) = len(y.e)
  where list_dot_product(x.e, y.e) >= 0.93 * x.norm * y.norm
), r as (
  select a, b from l union select r.a, l.b from r join l on l.a = r.b
), c as (
  select vec_id, (select count(*) from l where a = vec_id)::bigint as n_links, least(vec_id, coalesce((select min(b) from r where a = vec_id), vec_id)) as component_id from v
)
select vec_id, n_links, component_id, vec_id = component_id as kept from c
"""


