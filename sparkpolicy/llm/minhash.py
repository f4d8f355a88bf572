"""Near-duplicate documents by min-max hashing of word shingles, with exact confirmation.

A permutation of the shingle hashes gives two signature values, its minimum and its maximum, so that half
the hash evaluations fill a signature; both agree with the probability of the Jaccard similarity. Minima and
maxima go to different bands, whose rows therefore come from different permutations. Documents with a band
in common are candidates. Candidates are confirmed on their full shingle sets in two steps: with one member of each
band's bucket, which is mostly the same one in all buckets of a document; and, within what buckets are then
not joined by confirmed links, tile by tile. Unconfirmed chains are thus never compared all with all, only those
who share a bucket are. No link is lost to a bound, and a bucket is compared in as many tasks as its bytes ask for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, map_texts, table, written
from .components import components

WORDS = 5
#: The chance that a pair just at the threshold shares no band.
MISS = 1e-6
#: Sets in a tile; tiles grow with their bucket, up to a bound in bytes.
TILE, TILE_BYTES = 256, 8 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def plan(threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bands and rows a band."""
    rows = 7 if threshold >= 0.85 else 6
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows)), rows


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX2
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles.

    Letters A-Z are lower-cased and words are split at ASCII white space. A text of fewer than ``words`` words
    has one shingle, the whole sequence; one without words, or null, has none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(words, len(found))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out * _MIX + h[i : len(h) - k + 1 + i])
    return np.unique(out)


class MinMax:
    """Band keys of shingle sets."""

    def __init__(self, bands: int, rows: int) -> None:
        self.bands, self.rows = bands, rows
        n = -(-bands // 2) * rows
        rng = np.random.default_rng(20240229)
        self.mul = (rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1))[:, None]
        self.weights = rng.integers(0, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)

    def keys(self, sets: np.ndarray) -> np.ndarray:
        """The band keys of one non-empty set: bands of minima, then bands of maxima."""
        x = _mixed(sets).astype(np.uint32)
        low = high = None
        for at in range(0, len(x), 4096):
            p = self.mul * x[at : at + 4096]
            a, b = p.min(1), p.max(1)
            low = a if low is None else np.minimum(low, a)
            high = b if high is None else np.maximum(high, b)
        signature = np.concatenate([low, high]).astype(np.uint64).reshape(-1, self.rows)[: self.bands]
        return _mixed(_mixed(signature * self.weights).sum(1, dtype=np.uint64)).view(np.int64)


def signatures(docs: DataFrame, *, threshold: float, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n`` (shingles), ``h1`` and ``h2`` (a digest of the set) and ``keys`` (a key for each band)."""
    minmax = MinMax(*plan(threshold))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t.as_py(), words) for t in batch.column("text")]
        digests = np.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "S16")
        halves = np.frombuffer(b"".join(x.ljust(16, b"\0") for x in digests.tolist()), np.int64).reshape(-1, 2)
        keys = [minmax.keys(s) if len(s) else np.empty(0, np.int64) for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(keys, pa.list_(pa.int64()))],
            ["id", "n", "h1", "h2", "keys"],
        )

    return map_texts(slim, f"id {slim.schema['id'].dataType.simpleString()}, n long, h1 long, h2 long, keys array<long>", run)


def _alike(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(two) - both)


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) of different nodes whose ``sets`` (node, grams) are linked."""
    sides = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")).hint("merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")).hint("merge"), "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        linked = [_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return map_texts(sides.select("a", "b", "x", "y"), "a long, b long", run)


def tile_links(ids: np.ndarray, grams: list[np.ndarray], one: np.ndarray, two: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two lists of positions, or within one list if they are equal."""
    _, codes = np.unique(np.concatenate(grams), return_inverse=True)
    sizes = np.array([len(g) for g in grams])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    same = np.array_equal(one, two)
    entries = np.concatenate([codes[ends[j] : ends[j + 1]] for j in two])
    starts = np.concatenate([[0], np.cumsum(sizes[two])[:-1]])
    parent = list(range(len(ids)))
    mark, out = np.zeros(codes.max() + 1, bool), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for n, i in enumerate(one.tolist()):
        own = codes[ends[i] : ends[i + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[entries], starts)
        mark[own] = False
        near = 100 * both >= percent * (sizes[i] + sizes[two] - both)
        for j in two[np.flatnonzero(near)].tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j])))
        if same and n + 1 < len(two):  # what follows is compared with the rest alone
            entries, two, starts = entries[sizes[i] :], two[1:], starts[1:] - sizes[i]
    return out


def _open_buckets(members: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows (bucket, node, pivot, component) of the buckets whose members aren't all in one confirmed component."""
    own = members.join(joined.select("node", "component").hint("merge"), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    own = written(own, "bucket-members")
    spread = own.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.min(F.struct("node", "component")).alias("first")).where("c1 <> c2")
    spread = written(spread.select("bucket", F.col("first.node").alias("pivot"), F.col("first.component").alias("at")), "open-buckets")
    return own.join(spread.hint("merge"), "bucket").select("bucket", "node", "pivot", "at", "component")


def _within_buckets(sets: DataFrame, opened: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) between members of a bucket in different components.

    ``opened`` has rows (bucket, node, pivot, at, component), ``at`` being the pivot's component. Those who are in
    it are tied and need no comparison among themselves. The tasks of a bucket are the pairs of tiles of its loose members, and
    these tiles against those of tied ones; a task sends out a spanning forest. A bucket whose only loose member
    has been compared with all, which is the pivot, is left out, as are all but one of buckets with equal members.
    """
    near = opened.select("bucket", "node", (F.col("component") == F.col("at")).alias("linked"))
    sizes = near.join(sets.select("node", F.length("grams").alias("bytes")).hint("merge"), "node").groupBy("bucket").agg(
        F.count_if(~F.col("linked")).alias("loose"), F.count_if("linked").alias("tied"), F.sum("bytes").alias("bytes"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(5), "node")).alias("s2"),
    ).where("loose + tied > 2")
    sizes = sizes.groupBy("loose", "tied", "s1", "s2").agg(F.min_by(F.struct("bucket", "bytes"), "bucket").alias("one")).select("loose", "tied", "one.*")
    # A tile's share of the bucket's bytes is bounded, and small buckets have tiles of so many sets at least.
    tiles = lambda c: F.ceil(F.greatest(F.col(c) / F.greatest(F.lit(TILE), F.greatest("loose", "tied") / 16), F.col("bytes") * F.col(c) / (F.col("loose") + F.col("tied")) / TILE_BYTES)).cast("int")
    sizes = written(sizes.select("bucket", tiles("loose").alias("n_loose"), tiles("tied").alias("n_tied")), "open-tiles")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    spot = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    loose = F.concat(F.transform(upto("n_loose"), lambda j: spot(0, F.least(own("n_loose"), j), F.greatest(own("n_loose"), j))), F.transform(upto("n_tied"), lambda j: spot(1, own("n_loose"), j)))
    tied = F.transform(upto("n_loose"), lambda i: spot(1, i, own("n_tied")))
    dealt = written(near.join(sizes.hint("merge"), "bucket").select("bucket", "node", "linked", F.when(F.col("linked"), tied).otherwise(loose).alias("tasks"), F.when(F.col("linked"), F.lit(0)).otherwise(own("n_loose")).alias("tile")), "dealt")
    full = sets.select("node", "grams").join(dealt.hint("merge"), "node").select("node", "bucket", "linked", "tile", "grams", F.explode("tasks").alias("task")).select("node", "bucket", "linked", "tile", "grams", "task.kind", "task.x", "task.y")

    spots = ["bucket", "kind", "x", "y"]

    def linked(held: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        node, tied, tile, kind, x, y = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "linked", "tile", "kind", "x", "y"))
        one = np.flatnonzero(~tied & (tile == x[0]))
        two = np.flatnonzero(tied if kind[0] else ~tied & (tile == y[0]))
        if not len(one) or not len(two):
            return []
        return tile_links(node, [np.frombuffer(g.as_buffer(), np.uint64) for g in rows.column("grams")], one, two, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a task follow each other: only one task's are held."""
        held: list[pa.RecordBatch] = []
        last, out = None, []
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in spots])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if at == end:
                    continue
                if held and (keys[at] != last).any():
                    out += linked(held)
                    held = []
                held.append(batch.slice(at, end - at))
                last = keys[at]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])
            out = []
        out = linked(held) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    bound_batches(sets.sparkSession)
    ordered = full.select(*spots, "node", "linked", "tile", "grams").repartition(*spots).sortWithinPartitions(*spots, "node")
    return ordered.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, percent: int = 85, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Documents are linked when 100 times the intersection of their shingle sets is at least ``percent`` times
    the union. ``component_id`` is the smallest id reachable by links, the document's own included, and
    ``kept`` tells whether that is its own. A document without shingles (null, empty or blank text) is linked
    with nothing. Rows that repeat an id with another text are linked for themselves; a row without an id has no component and is kept.
    Equal sets collapse into one class before candidates are looked for. An empty table gives no row; other columns are ignored.
    """
    marks = written(signatures(docs, threshold=percent / 100, words=words, id_col=id_col, text_col=text_col), "signatures")
    known = marks.where("n > 0 and id is not null")
    # A class of equal sets has a number, which stays as it is once it is written.
    classes = known.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.first("keys").alias("keys"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    rows = classes.select("node", F.posexplode("keys").alias("band", "key"))
    buckets = rows.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).where("size > 1")
    buckets = written(buckets.select("band", "key", "pivot").withColumn("bucket", F.monotonically_increasing_id()), "buckets")
    members = written(rows.join(buckets.hint("merge"), ["band", "key"]).select("bucket", "node", "pivot"), "members")

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def grams(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t.as_py(), words).tobytes() for t in batch.column("text")]
        own = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s) for s in sets), np.int64).reshape(-1, 2)
        same = (own[:, 0] == batch.column("h1").to_numpy()) & (own[:, 1] == batch.column("h2").to_numpy())  # not another text of that id
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "grams"]).filter(pa.array(same))

    wanted = classes.join(members.select("node").distinct().hint("merge"), "node").select(F.col("rep").cast(kind).alias("id"), "node", "h1", "h2")
    inside = slim.join(wanted.hint("merge"), "id").select("node", "h1", "h2", "text")  # one plan at every size
    sets = map_texts(inside, "node long, grams binary", grams)
    sets = written(sets.groupBy("node").agg(F.max("grams").alias("grams")) if _repeats(marks) else sets, "sets")

    pairs = members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    links = written(_confirmed(sets, pairs, percent), "links-of-buckets")
    joined = written(components(links), "joined")
    opened = written(_open_buckets(members.select("bucket", "node"), joined), "still-open")
    # Written, so that no task runs two Python functions, for which it would hold two workers.
    links = written(links.unionByName(_within_buckets(sets, opened, percent)), "all-links")
    found = written(components(links), "components")

    least = found.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    reached = found.join(least, "component").select("node", "least")
    named = classes.select("n", "h1", "h2", "rep", "node").join(reached.hint("merge"), "node", "left").select("n", "h1", "h2", F.coalesce("least", "rep").alias("component"))
    named = written(named, "named-classes")
    out = marks.select("id", "n", "h1", "h2").join(named.hint("merge"), ["n", "h1", "h2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _repeats(marks: DataFrame) -> bool:
    """Whether an id occurs more than once."""
    return not marks.groupBy("id").count().where("count > 1 and id is not null").isEmpty()


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at 85 %."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as g from d
), n as (
  select doc_id, len(g)::bigint as n_shingles from s
), e as (
  select doc_id, unnest(g) as g from s
), p as (
  select x.doc_id as a, y.doc_id as b, count(*) as shared from e x join e y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2
), l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n_shingles + y.n_shingles - shared)
), r as (
  select a, b from l union select r.a, l.b from r join l on l.a = r.b
), c as (
  select doc_id, n_shingles, least(doc_id, coalesce((select min(b) from r where a = doc_id), doc_id)) as component_id from n
)
select doc_id, n_shingles, component_id, doc_id = component_id as kept from c
"""


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates (80 %) the document with the smallest id stays.

    Of rows that repeat an id one stays; rows without an id stay.
    """
    found = written(near_duplicates(docs, percent=80).select("doc_id", "kept"), "kept")
    left = docs.join(found.where("not kept").select("doc_id").hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    if _repeats(found.select(F.col("doc_id").alias("id"))):
        named = left.where("doc_id is not null").dropDuplicates(["doc_id"])
        left = left.where("doc_id is null").unionByName(named)
    return left
