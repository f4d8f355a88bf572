"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame expressions only.

A text is cut into pieces: its paragraphs (lines), long ones into runs of words. The digests of the distinct
pieces go into a sketch: three subtables of cells, and in each subtable one cell of every digest, where a cell
holds how many digests fell into it and the xor of these and of their check sums. Sketches of two versions
subtract cell by cell, which leaves the digests that only one version has. Peeling takes the digest out of a
cell that holds just one and removes it from its other cells, until all cells are empty: then the differing
digests are known. If cells stay full the pieces are dealt by digest into groups of a few, and each group
is sketched and peeled anew, with more cells each time it fails; so the work stays in proportion to the
number of pieces. A group that no size can peel is compared digest by digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Words of a piece at most.
PIECE_WORDS = 32
#: Cells of a subtable of the fingerprint itself, and of a group's sketches, one size after another.
CELLS = 4
RETRIES = (8, 32, 128)
#: Subtables of a sketch, and rounds of peeling, a third of them for each.
SUBTABLES, ROUNDS = 3, 9
#: Pieces of one version in a group, about.
GROUP = 6
#: Documents whose successor is found together, about, and most such ranges.
RANGE, MOST_RANGES = 64, 40_000
_STEP = 200


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def digests(text: Column, words: int = PIECE_WORDS) -> Column:
    """The sorted distinct digests of a text's pieces; blanks between and after lines don't count."""
    pieces = F.regexp_extract_all(text, F.lit(rf"\S++(?:[^\S\n]++\S++){{0,{words - 1}}}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p))))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(17)).bitwiseAND(F.lit(0xFFFFFFFF))


def _spot(key: Column, sub: int, size: Column) -> Column:
    """The cell of a key in a subtable. The top 42 bits of a digest have 14 for each subtable."""
    return F.call_function("shiftrightunsigned", key, F.lit(22 + 14 * sub)).bitwiseAND(size - 1)


def _upto(n: Column) -> Column:
    return F.sequence(F.lit(0), n.cast("int") - 1)


def _placed(key: Column, size: Column, **more: Column) -> Column:
    """A key with its cell in each subtable, so that these are computed once."""
    return F.struct(key.alias("key"), *[_spot(key, sub, size).alias(f"s{sub}") for sub in range(SUBTABLES)], *[c.alias(n) for n, c in more.items()])


def sketch(keys: Column, size: Column) -> Column:
    """Three subtables, each an array of ``size`` cells (n, key, sum)."""
    zero = F.lit(0).cast("long")
    empty = F.struct(zero.alias("n"), zero.alias("key"), zero.alias("sum"))
    plus = lambda c, x: F.struct((c["n"] + 1).alias("n"), c["key"].bitwiseXOR(x["key"]).alias("key"), c["sum"].bitwiseXOR(x["check"]).alias("sum"))
    part = lambda placed, sub: F.transform(_upto(size), lambda at: F.aggregate(F.filter(placed, lambda x: x[f"s{sub}"] == at), empty, plus))
    return let(F.transform(keys, lambda k: _placed(k, size, check=_check(k))), lambda placed: F.array(*[part(placed, sub) for sub in range(SUBTABLES)]))


def _minus(a: Column, b: Column) -> Column:
    return F.struct((a["n"] - b["n"]).alias("n"), a["key"].bitwiseXOR(b["key"]).alias("key"), a["sum"].bitwiseXOR(b["sum"]).alias("sum"))


def _full(cell: Column) -> Column:
    return (cell["n"] != 0) | (cell["key"] != 0) | (cell["sum"] != 0)


def peel(cells: Column, size: Column) -> Column:
    """``cells`` and ``found``: the cells left and the digests recovered from a difference of sketches.

    Each round takes the pure cells of one subtable, in which no digest occurs twice.
    """

    def turn(state: Column, r: Column) -> Column:
        pure = F.filter(state["cells"][F.pmod(r, F.lit(SUBTABLES))], lambda c: (F.abs(c["n"]) == 1) & (_check(c["key"]) == c["sum"]))

        def without(pure: Column) -> Column:
            gone = F.transform(pure, lambda c: _placed(c["key"], size, n=c["n"], sum=c["sum"]))
            part = lambda gone, sub: F.transform(state["cells"][sub], lambda c, at: F.aggregate(F.filter(gone, lambda x: x[f"s{sub}"] == at), c, _minus))
            left = let(gone, lambda gone: F.array(*[part(gone, sub) for sub in range(SUBTABLES)]))
            return F.when(F.size(pure) == 0, state).otherwise(F.struct(left.alias("cells"), F.concat(state["found"], F.transform(pure, lambda p: p["key"])).alias("found")))

        return let(pure, without)

    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def difference(a: Column, b: Column, size: Column) -> Column:
    """The digests that differ between two sketches of one size, or null if they can't be peeled."""
    cells = F.zip_with(a, b, lambda x, y: F.zip_with(x, y, _minus))
    return let(peel(cells, size), lambda s: F.when(~F.exists(F.flatten(s["cells"]), _full), s["found"]))


def _grouped(keys: Column, one: Column, two: Column) -> Column:
    """The keys dealt into ``one`` times ``two`` groups (powers of two), in two passes."""
    pick = lambda keys, n, shift: F.transform(_upto(n), lambda g: F.filter(keys, lambda k: F.call_function("shiftrightunsigned", k, F.lit(shift)).bitwiseAND(n - 1) == g))
    return F.flatten(F.transform(pick(keys, one, 0), lambda part: pick(part, two, 11)))


def _apart(a: Column, b: Column) -> Column:
    """How many digests differ between two small groups, by sketches that grow until they peel; groups that never do are compared in full."""
    attempt = lambda n, size: F.coalesce(n, F.size(difference(sketch(a, size), sketch(b, size), size)))
    grown = F.aggregate(F.array(*map(F.lit, RETRIES)), F.lit(None).cast("int"), attempt)
    return F.when(a == b, F.lit(0)).otherwise(F.coalesce(grown, F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))))


def apart(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """How many digests differ between two versions, from their digests and fingerprint cells."""
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size(a), F.size(b), F.lit(1)) / GROUP))).cast("int")
    power = lambda n: F.pow(F.lit(2), n).cast("int")
    dealt = lambda n: F.zip_with(_grouped(a, n["one"], n["two"]), _grouped(b, n["one"], n["two"]), _apart)
    groups = let(F.struct(power(F.floor(bits / 2)).alias("one"), power(F.ceil(bits / 2)).alias("two")), lambda n: F.aggregate(dealt(n), F.lit(0), lambda x, y: x + y))
    return F.when(a == b, F.lit(0)).otherwise(F.coalesce(F.size(difference(cells_a, cells_b, F.lit(CELLS))), groups))


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """Jaccard similarity of two digest sets from how many differ; two empty sets are alike."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - differing) / (both + differing).cast("double"))


def encoded(cells: Column) -> Column:
    """Cells as text: for each its count, key and check sum in hexadecimal digits."""
    part = lambda c, n: F.lower(F.lpad(F.hex(c), n, "0"))
    return F.array_join(F.transform(F.flatten(cells), lambda c: F.concat(part(c["n"], 6), part(c["key"], 16), part(c["sum"], 8))), "")


def fingerprint(docs: DataFrame, *, text_col: str = "text", words: int = PIECE_WORDS) -> DataFrame:
    """``docs`` with ``digests``, ``cells`` and ``fingerprint``.

    A column that ``docs`` has already under one of these names stays, and the new one's name gets underscores until it is free. A
    null text counts as empty, as does one of blanks alone; texts are read whole, however long. Equal texts, and texts of equal
    pieces in another order, have equal fingerprints; repeated rows stay. An empty table gives no row.
    """
    names = []
    for name in ("digests", "cells", "fingerprint"):
        while name.lower() in {c.lower() for c in docs.columns}:
            name += "_"
        names.append(name)
    own = docs.select(F.struct(*docs.columns).alias("row"), digests(F.coalesce(F.col(text_col).cast("string"), F.lit("")), words).alias("keys"))
    own = own.select("row", "keys", sketch(F.col("keys"), F.lit(CELLS)).alias("cells"))
    return own.select("row.*", F.col("keys").alias(names[0]), F.col("cells").alias(names[1]), encoded(F.col("cells")).alias(names[2]))


def _ranges(ids: DataFrame) -> list[int]:
    """The largest ids of ranges of about ``RANGE`` rows; at most ``MOST_RANGES`` come to the driver."""
    n = ids.count()
    k = max(1, min(MOST_RANGES, -(-n // RANGE)))
    if k == 1:
        return [r[0] for r in ids.agg(F.max("id")).collect() if r[0] is not None]
    cuts = ids.agg(F.percentile_approx("id", [i / k for i in range(1, k)], 4 * k)).first()[0]
    found = ids.groupBy(_range_of(F.col("id"), sorted(set(cuts)))).agg(F.max("id")).collect()
    return sorted(r[1] for r in found)


def _range_of(x: Column, ends: list[int]) -> Column:
    """How many of the ascending ``ends`` are less than ``x``."""
    listed = lambda v: F.split(F.lit(",".join(map(str, v))), ",").cast("array<bigint>")
    less = lambda v: F.size(F.filter(v, lambda e: e < x))
    if len(ends) <= _STEP:
        return less(listed(ends))
    full = less(listed(ends[_STEP - 1 :: _STEP])) * _STEP
    return full + less(F.slice(listed(ends), full + 1, F.lit(_STEP)))


def with_next(docs: DataFrame, columns: list[str], *, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``next_`` columns: those of the next row by descending id; after the last comes the first.

    Rows that repeat an id follow each other in the order of ``columns``. Rows without an id have no next
    one: their ``next_`` columns are null. The rows are dealt into ranges of ids; the first row of a range is
    copied into the range above, so that one shuffle brings each row and its successor together. An empty table gives no row.
    """
    ends = _ranges(docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null"))
    # Numbered names inside, so that none of its own clashes with those of the steps.
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    back = [F.col(n).alias(c) for c, n in own.items()]
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.col(f"`{id_col}`").cast("long").alias("id"))
    alone = named.where("id is null").select(*back, *[F.lit(None).cast(docs.schema[c].dataType).alias(f"next_{c}") for c in columns])
    if not ends:
        return alone
    spot = named.where("id is not null").withColumn("range", _range_of(F.col("id"), ends))
    tops = F.split(F.lit(",".join(map(str, ends))), ",").cast("array<bigint>")
    above = F.pmod(F.col("range") + 1, F.lit(len(ends)))
    here = F.struct(F.col("range").alias("r"), F.lit(False).alias("copy"))
    places = F.when(F.element_at(tops, F.col("range") + 1) == F.col("id"), F.array(here, F.struct(above.alias("r"), F.lit(True).alias("copy")))).otherwise(F.array(here))
    dealt = spot.select(*own.values(), "id", F.explode(places).alias("at")).select(*own.values(), "id", "at.r", "at.copy")
    order = Window.partitionBy("r").orderBy("copy", F.desc("id"), *[own[c] for c in columns])
    out = dealt.select(*own.values(), "copy", *[F.lead(own[c]).over(order).alias(f"after{i}") for i, c in enumerate(columns)]).where("not copy")
    return out.select(*back, *[F.col(f"after{i}").alias(f"next_{c}") for i, c in enumerate(columns)]).unionByName(alone)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, compared with each other and with the next document's.

    A row without an id has an empty next document.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("digests", digests(F.col("text")))
    both = with_next(docs, ["text", "digests"])
    n = F.char_length("text")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - char_length(text) div 3)"), F.coalesce(F.expr("substring(next_text, 1, char_length(text) div 3)"), F.lit("")))
    out = both.select("doc_id", n.cast("long").alias("n_chars"), "digests", F.coalesce("next_digests", F.array().cast("array<bigint>")).alias("next_digests"), edited.alias("edited"))
    out = out.select("doc_id", "n_chars", "digests", "next_digests", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digests(F.col("edited")).alias("edited_digests"))
    sets = F.array("digests", "edited_digests", "next_digests")
    out = out.withColumn("versions", F.transform(sets, lambda k: F.struct(k.alias("keys"), sketch(k, F.lit(CELLS)).alias("cells"))))
    own = F.col("versions")[0]
    near = F.transform(F.slice("versions", 2, 2), lambda v: likeness(own["keys"], v["keys"], apart(own["keys"], v["keys"], own["cells"], v["cells"])))
    out = out.select("doc_id", "n_chars", "edited_sha256", "versions", near.alias("near"))
    shown = F.transform(F.slice("versions", 1, 2), lambda v: encoded(v["cells"]))
    out = out.select("doc_id", "n_chars", "edited_sha256", shown.alias("shown"), "near")
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("shown")[0].alias("fingerprint"), F.col("shown")[1].alias("edited_fingerprint"), F.col("near")[0].alias("near_edited"), F.col("near")[1].alias("near_next"))
