"""Best-fit-decreasing packing of tokenised documents into sequences of fixed capacity.

Best-fit decreasing depends on the lengths alone, so it runs over the histogram of lengths, which has at
most ``capacity`` entries however many pieces there are: lengths are taken in decreasing order, and for each
a segment tree over the remaining capacities gives the tightest open bin in logarithmic time. Pieces of one
length and bins of one remaining capacity are interchangeable, so whole runs of them move at once. The
resulting plan says, for the n-th piece of a length, its bin and offset; every piece finds its number from
per-chunk counts without a global sort. The packing is that of one global best-fit decreasing.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept_between_tasks, map_texts, shared_path, table

CAPACITY = 2048
#: Pieces that are numbered together.
CHUNK = 20_000
#: Words of a generation of remembered ones, of which there are two; as many of the marks at their ends.
_MOST_CACHED = 300_000
_LONGEST_CACHED = 64
#: Bytes that are split into words at once, unless one text has more.
_CHARS_AT_ONCE = 2_000_000
#: Words that are tokenised at once, and marks that are split off a word's end.
_LINE = 64
_MARKS = ".,;:!?%$&#*()\""
#: Words of letters that NFC leaves as they are and that have one lower-case letter each, whatever stands beside them.
_SIMPLE = re.compile("[A-Za-zÀ-ÖØ-öø-įı-žЀ-џ]+").fullmatch
#: The normalizer and the pre-tokenizer that do no more to such words than to lower them and to write bytes as characters.
_LOWERS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PARTS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: What ByteLevel writes for those bytes, taken as Latin-1, that it writes differently.
_BYTES = dict(zip([*range(33), *range(127, 161), 173], range(256, 324), strict=True)) | {32: 32}  # blanks stay between words
_ASCII_ALNUM = np.array([i < 128 and chr(i).isalnum() for i in range(256)])


class OpenBins:
    """Segment tree over remaining capacities; a leaf holds the runs (first bin, bins) with that much left."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.held = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, first: int, bins: int) -> None:
        if bins and left:
            self.runs[left].append((first, bins))
            self._count(left, bins)

    def take(self, left: int, most: int) -> tuple[int, int]:
        """Up to ``most`` bins of one run with ``left`` remaining."""
        first, bins = self.runs[left].pop()
        used = min(bins, most)
        if used < bins:
            self.runs[left].append((first + used, bins - used))
        self._count(left, -used)
        return first, used

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that an open bin has."""
        at = length + self.leaves
        while not self.held[at]:
            while at & 1:  # a right child: what follows begins beside an ancestor
                at >>= 1
            if at <= 1:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.held[2 * at] else 2 * at + 1
        return at - self.leaves

    def _count(self, left: int, bins: int) -> None:
        at = left + self.leaves
        while at:
            self.held[at] += bins
            at >>= 1


@dataclass(frozen=True)
class Plan:
    """Rows by length and then rank: pieces from ``rank`` on fill bins from ``bin`` on, ``per`` in each from ``offset`` on."""

    starts: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    per: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of pieces by length and rank within the length."""
        at = np.empty(len(length), np.int64)
        for n in np.unique(length):
            own = length == n
            lo, hi = self.starts[n], self.starts[n + 1]
            at[own] = lo + np.searchsorted(self.rank[lo:hi], rank[own], "right") - 1
        j = rank - self.rank[at]
        return self.bin[at] + j // self.per[at], self.offset[at] + j % self.per[at] * length


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing over a histogram of lengths from 1 to ``capacity``."""
    bins, open_bins, rows = 0, OpenBins(capacity), {n: [] for n in range(capacity + 2)}
    for length in sorted(counts, reverse=True):
        rank, left_over = 0, counts[length]
        while left_over:
            left = open_bins.tightest(length)
            room = capacity if left is None else left
            per = min(room // length, left_over)
            want = left_over // per
            if left is None:
                first, used = bins, want
                bins += used
            else:
                first, used = open_bins.take(left, want)
            rows[length].append((rank, first, per, capacity - room))
            open_bins.add(room - per * length, first, used)
            rank += used * per
            left_over -= used * per
    flat = np.array([r for n in range(capacity + 2) for r in rows[n]], np.int64).reshape(-1, 4)
    starts = np.concatenate([[0], np.cumsum([len(rows[n]) for n in range(capacity + 2)])])
    return Plan(starts, *(flat[:, i].copy() for i in range(4)), bins)


class WordTokenizer:
    """A tokenizer of the ``tokenizers`` library, with the ids of words and of the marks at their ends remembered.

    It suits tokenizers that neither keep white space nor look across it, that part letters and digits from
    other characters, and whose tokens mark the end of a part. Texts are split at ASCII white space, other
    white space is left to the tokenizer; marks at the end of a word are split off. Splitting, finding the distinct
    words and putting ids together is done by Arrow for many texts at once; Python sees distinct words alone.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.simple = None  # the same model for simple words that are lowered and written as ByteLevel does
        if [json.loads(x.__getstate__() or "null") for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)] == [_LOWERS, _PARTS]:
            self.simple = Tokenizer(self.tokenizer.model)
            self.simple.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string())
        sizes, out, at = pc.binary_length(texts).to_pylist(), [], 0
        while at < len(texts):
            end, size = at + 1, sizes[at]
            while end < len(texts) and size + sizes[end] <= _CHARS_AT_ONCE:
                size += sizes[end]
                end += 1
            out += self._encode(texts[at:end])
            at = end
        return out

    def _encode(self, texts: pa.Array) -> list[bytes]:
        # What is used again moves to the new generation, so that frequent words stay when the old one goes.
        if len(self.words) > _MOST_CACHED:
            self.old_words, self.words = self.words, {}
        if len(self.parts) > _MOST_CACHED:
            self.old_parts, self.parts = self.parts, {}
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        stems, ends, marks = _cut(words.dictionary)
        stems, marks = stems.dictionary_encode(), marks.dictionary_encode()
        of_stems = self._ids(_strings(stems.dictionary), self.words, self.old_words)
        of_marks = self._ids(_strings(marks.dictionary), self.parts, self.old_parts)
        own = np.zeros(len(stems), np.int64)  # 0 is what words without marks have at their end
        own[ends] = marks.indices.to_numpy() + 1
        ids = pc.binary_join_element_wise(
            pa.array(of_stems, pa.large_binary()).take(stems.indices), pa.array([b"", *of_marks], pa.large_binary()).take(pa.array(own)), pa.scalar(b"", pa.large_binary())
        )
        at, data = _buffers(ids.take(words.indices))
        at = at[split.offsets.to_numpy()].tolist()
        return [data[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]

    def _ids(self, wanted: list[str], held: dict[str, bytes], old: dict[str, bytes]) -> list[bytes]:
        """The ids of distinct ``wanted``, which ``held`` has afterwards but for long ones."""
        found = list(map(held.get, wanted))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in gaps:
            if (ids := old.get(wanted[i])) is None:
                new.append(i)
            else:
                found[i] = held[wanted[i]] = ids
        words = [wanted[i] for i in new]
        for i, w, ids in zip(new, words, self._learn(words), strict=True):
            found[i] = ids
            if len(w) <= _LONGEST_CACHED:
                held[w] = ids
        return found

    def _learn(self, parts: list[str]) -> list[bytes]:
        """What the library gives for each of ``parts``."""
        found: dict[str, bytes] = {}
        simple, plain, alone = [], [], []
        for p in parts:
            (alone if not p.isalpha() else simple if self.simple and (p.isascii() or _SIMPLE(p)) else plain).append(p)
        if simple:
            lines = [" ".join(simple[i : i + _LINE]).lower() for i in range(0, len(simple), _LINE)]
            lines = [x if x.isascii() else x.encode().decode("latin-1").translate(_BYTES) for x in lines]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.simple.encode_batch_fast(lines, add_special_tokens=False)])
            ends, data = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), ids.tobytes()
            found.update((p, data[a:b]) for p, a, b in zip(simple, [0, *ends[:-1]], ends, strict=True))
        lines = [plain[i : i + _LINE] for i in range(0, len(plain), _LINE)]
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(ends) == len(line):
                data = ids.tobytes()
                found.update((p, data[a:b]) for p, a, b in zip(line, [0, *ends], ends, strict=False))
            else:  # some word has several parts after all
                alone += line
        encoded = self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)
        found.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(alone, encoded, strict=True))
        return [found[p] for p in parts]


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()  # many times as fast as to_pylist


def _buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of large strings or large binary values."""
    _, at, data = values.buffers()
    at = np.frombuffer(at, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return at, np.frombuffer(data or b"", np.uint8)


def _cut(words: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """``words`` without the marks at the end that may be split off, the numbers of those that have some, and their marks."""
    stems = pc.ascii_rtrim(words, characters=_MARKS)
    at, data = _buffers(words)
    size, left = np.diff(at), pc.binary_length(stems).to_numpy()
    some = np.flatnonzero((left > 0) & (left < size))
    last = data[at[some] + left[some] - 1]
    apart = _ASCII_ALNUM[last]
    more = np.flatnonzero(last >= 128)
    apart[more] = [unicodedata.normalize("NFC", s[-1].lower()).isalnum() for s in _strings(stems.take(pa.array(some[more])))]
    some = some[apart]
    n = size[some] - left[some]
    ends = np.concatenate([[0], np.cumsum(n)])
    bytes_at = np.arange(ends[-1]) + np.repeat(at[some] + left[some] - ends[:-1], n)
    marks = pa.Array.from_buffers(pa.large_string(), len(some), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[bytes_at])])
    marked = np.zeros(len(words), bool)
    marked[some] = True
    return pc.if_else(pa.array(marked), stems, words), some, marks


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


kept_between_tasks(__name__, word_tokenizer.cache_clear)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut(docs: DataFrame, *, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``piece``, ``start``, ``length`` and ``ids_crc32`` of each document's pieces.

    A document is its ids and then ``end_id``; a null text counts as empty. Only documents longer than
    ``capacity`` are cut, at its multiples. Repeated rows are cut each; an empty table gives no row; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    end = end_id.to_bytes(4, "little")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = batch.column("id"), []
        for i, data in enumerate(word_tokenizer(tokenizer).encode(pc.fill_null(batch.column("text"), ""))):
            data += end
            for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                rows.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        i, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(i)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["id", "piece", "start", "length", "ids_crc32"])

    return map_texts(slim, f"id {slim.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long", run)


def pack(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of :func:`cut` with ``sequence_id`` and ``offset``.

    Null and empty texts give one piece that holds ``end_id`` alone; repeated rows are packed each; an empty
    table gives no row. The driver holds the histogram of lengths and the plan, both bounded by ``capacity``.
    """
    spark = docs.sparkSession
    pieces = cut(docs, tokenizer=tokenizer or default_tokenizer(), end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col)
    path = shared_path(spark, "pieces")
    pieces.write.parquet(path)
    # The files fix the order, so that a piece keeps its number when a task runs again.
    stored = spark.read.schema(pieces.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.expr(f"_metadata.row_index div {CHUNK}").alias("chunk"), F.col("_metadata.row_index").alias("row"))
    counts = stored.groupBy("length", "file", "chunk").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(best_fit(histogram, capacity))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("file", "chunk").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy("length", "file", "chunk").orderBy("row")
    ranked = (
        stored.withColumn("own", F.row_number().over(within) - 1)
        .join(before.select("length", "file", "chunk", F.coalesce("before", F.lit(0)).alias("before")), ["length", "file", "chunk"])
        .select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).cast("long").alias("rank"))
    )

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        sequence, offset = plan.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    kind = pieces.schema["id"].dataType.simpleString()
    out = map_texts(ranked, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", place)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the documents that are left, packed; nulls, repeats and an empty table as in :func:`pack`."""
    return pack(docs)
