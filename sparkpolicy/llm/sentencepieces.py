"""SentencePiece encoding and decoding in batches.

A text is cut where a space follows another character, as no piece reaches across; each distinct unit is
encoded once. Units of equal length advance together: the hash of every substring up to the longest piece
probes the sorted keys of the pieces, which gives a table of piece ids by start and length. Over it a unigram
model takes the Viterbi path, with one vectorised maximum and its backpointer for each position.

A BPE model is defined by its merges, which the path of the best scores doesn't follow. But its encoding is a path as well: cut
between two pieces of an encoding, and each side is the encoding of its text, since no merge went across; and
pieces of which all neighbours are the encoding of their joint text are the encoding of the whole, since the first merge across a
boundary would also occur in that joint text. So the last piece of each prefix is the only one that fits the last piece of the
prefix before it. The same pass finds it for all units at once, with a backpointer for each position, where the maximum is over
who fits (1) and who doesn't (0). Which pieces fit each other is found by merging their joint text, once for each pair met. Ids are those of the SentencePiece library in either case.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

SPACE = "▁"
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNITS = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20
#: Longer units are encoded one by one; units of one length go in slices; units kept between batches.
LONGEST_BATCHED, _SLICE, _MOST_KNOWN, _LONGEST_KNOWN = 48, 20_000, 400_000, 64
#: Pairs of pieces remembered, and what is added to the code of a character that is no piece.
_MOST_PAIRS, _CHARS, _SLOT_BITS = 2_000_000, 1 << 24, 20
#: New pairs up to which each is merged by itself.
_FEW = 200


def _fields(data: bytes):
    """Number and value of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        how = tag & 7
        if how == 0:
            yield tag >> 3, varint()
        elif how == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[how]
            yield tag >> 3, struct.unpack("<d" if n == 8 else "<f", data[at : at + n])[0]
            at += n


@dataclass(frozen=True)
class Model:
    """A model file's pieces and what matters of its settings."""

    pieces: tuple[str, ...]
    scores: np.ndarray
    kinds: np.ndarray
    model_type: int
    byte_fallback: bool
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str) -> Model:
        pieces, scores, kinds, kind, fallback, dummy = [], [], [], UNIGRAM, False, True
        for number, value in _fields(Path(path).read_bytes()):
            if number == 1:
                f = dict(_fields(value))
                pieces.append(f.get(1, b"").decode())
                scores.append(f.get(2, 0.0))
                kinds.append(f.get(3, _NORMAL))
            elif number == 2:
                f = dict(_fields(value))
                kind, fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
                if f.get(24, 0):
                    raise ValueError("models with spaces at the ends of words are not supported")
            elif number == 3:
                f = dict(_fields(value))
                dummy = bool(f.get(3, 1))
                if f.get(2, b"") or f.get(4, 1) or not f.get(5, 1):
                    raise ValueError("only models that leave the text as it is are supported")
        if kind not in (UNIGRAM, BPE) or _USER in kinds:
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        if any(SPACE in p.lstrip(SPACE) for p, k in zip(pieces, kinds, strict=True) if k == _NORMAL):
            raise ValueError("a piece reaches across words")
        return cls(tuple(pieces), np.array(scores, np.float32), np.array(kinds), kind, fallback, dummy)


class Codec:
    def __init__(self, model: Model) -> None:
        self.model = model
        own = np.flatnonzero(model.kinds == _NORMAL)
        self.ids = {model.pieces[i]: int(i) for i in own}
        self.longest = max((len(model.pieces[i]) for i in own), default=1)
        keys = np.array([self._key(model.pieces[i]) for i in own], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], own[order].astype(np.int32)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(model.pieces) if model.kinds[i] == _BYTE}
        self.unknown = int(np.flatnonzero(model.kinds == _UNKNOWN)[0])
        self.lowest = float(model.scores[own].min()) if len(own) else 0.0
        self.known: dict[str, bytes] = {}
        #: Pairs of pieces met and whether they fit; a first piece of 0 stands for the beginning. Before them a table of slots by
        #: hash, each with the pair met last.
        self.met: dict[int, bool] = {}
        self.slots, self.slot_fits = np.full(1 << _SLOT_BITS, -1, np.int64), np.zeros(1 << _SLOT_BITS, bool)
        self.shown = [self._shown(i) for i in range(len(model.pieces))]

    @staticmethod
    def _mix(h, c):
        return (h ^ c) * _BASE

    def _key(self, piece: str) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = self._mix(h ^ (h >> np.uint64(29)), np.uint64(ord(c)))
        return h

    # -- encoding
    def units(self, text: str) -> list[str]:
        if not text:
            return []
        return _UNITS.findall(((" " if self.model.dummy_prefix else "") + text).replace(" ", SPACE))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > _MOST_KNOWN:
            self.known.clear()
        units = [self.units(t) for t in texts]
        new = list(set().union(*units).difference(self.known))
        self._learn(new)
        out = [b"".join(map(self.known.__getitem__, u)) for u in units]
        for u in new:
            if len(u) > _LONGEST_KNOWN:
                del self.known[u]
        return out

    def _learn(self, units: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for u in units:
            if len(u) > LONGEST_BATCHED:
                self.known[u] = self._emit(u, self._one(u))
            else:
                by_length.setdefault(len(u), []).append(u)
        for n, own in by_length.items():
            for at in range(0, len(own), _SLICE):
                part = own[at : at + _SLICE]
                found = self.table(np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n))
                ends = self.viterbi(found) if self.model.model_type == UNIGRAM else self.fitting(part, found)
                self._emit_all(part, found, ends)

    def table(self, codes: np.ndarray) -> np.ndarray:
        """Piece ids by unit, start and length less one; -1 where the substring is no piece."""
        n, size = codes.shape
        wide = min(self.longest, size)
        out = np.full((n, size, wide), -1, np.int32)
        codes = codes.astype(np.uint64)
        h = np.zeros((n, size), np.uint64)
        for k in range(wide):
            h = self._mix(h[:, : size - k] ^ (h[:, : size - k] >> np.uint64(29)), codes[:, k:])
            rows, starts = np.nonzero(self.seen[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            probe = h[rows, starts]
            at = np.searchsorted(self.keys, probe)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == probe
            out[rows[hit], starts[hit], k] = self.key_ids[at[hit]]
        return out

    def viterbi(self, found: np.ndarray) -> np.ndarray:
        """``ends[u, i]``: where the piece that starts at ``i`` ends, on each unit's best path; 0 elsewhere."""
        n, size, wide = found.shape
        scores = np.where(found >= 0, self.model.scores[found], np.float32(-np.inf)).astype(np.float32)
        single = scores[:, :, 0]
        single[found[:, :, 0] < 0] = np.float32(self.lowest - 10)  # an unknown character
        best, back = np.zeros((n, size + 1), np.float32), np.zeros((n, size + 1), np.int32)
        rows = np.arange(n)
        for j in range(1, size + 1):
            starts = np.arange(max(0, j - wide), j)
            sums = best[:, starts] + scores[:, starts, j - starts - 1]
            top = sums.argmax(1)
            best[:, j], back[:, j] = sums[rows, top], starts[top]
        ends, at = np.zeros((n, size), np.int32), np.full(n, size)
        while (live := np.flatnonzero(at > 0)).size:
            begun = back[live, at[live]]
            ends[live, begun] = at[live]
            at[live] = begun
        return ends

    def fitting(self, units: list[str], found: np.ndarray) -> np.ndarray:
        """``ends`` as in :meth:`viterbi` on the path of pieces that fit their neighbours."""
        n, size, wide = found.shape
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).astype(np.int64)
        ids = found.astype(np.int64) + 1  # 0: no piece
        single = ids[:, :, 0]
        single[single == 0] = (codes + _CHARS)[single == 0]  # an unknown character stands for itself
        last, back = np.zeros((n, size + 1), np.int64), np.zeros((n, size + 1), np.int32)
        rows = np.arange(n)
        for j in range(1, size + 1):
            starts = np.arange(max(0, j - wide), j)
            own = ids[:, starts, j - starts - 1]
            fits = np.zeros(own.shape, np.int8)
            u, k = np.nonzero(own)
            fits[u, k] = self._fit(last[u, starts[k]], own[u, k])
            top = fits.argmax(1)
            last[:, j], back[:, j] = own[rows, top], starts[top]
        ends, at = np.zeros((n, size), np.int32), np.full(n, size)
        while (live := np.flatnonzero(at > 0)).size:
            begun = back[live, at[live]]
            ends[live, begun] = at[live]
            at[live] = begun
        return ends

    def _fit(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether pieces follow each other in the encoding of their joint text."""
        keys = before << 32 | after
        slot = (keys.view(np.uint64) * _BASE >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        out = self.slot_fits[slot]
        other = np.flatnonzero(self.slots[slot] != keys)
        if len(other):
            few, first, place = np.unique(keys[other], return_index=True, return_inverse=True)
            found = self._known_fit(few)
            out[other] = found[place]
            into, one = np.unique(slot[other][first], return_index=True)  # one pair for each slot
            self.slots[into], self.slot_fits[into] = few[one], found[one]
        return out

    def _known_fit(self, keys: np.ndarray) -> np.ndarray:
        """Whether pairs fit, from those met or by merging."""
        if len(self.met) > _MOST_PAIRS:
            self.met.clear()
        out = np.fromiter((self.met.get(k, 2) for k in keys.tolist()), np.int8, len(keys))
        if len(new := keys[out == 2]):
            out[out == 2] = found = self._merged_apart(new)
            self.met.update(zip(new.tolist(), found.tolist(), strict=True))
        return out.astype(bool)

    def _text(self, piece: int) -> str:
        return chr(piece - _CHARS) if piece >= _CHARS else self.model.pieces[piece - 1] if piece else ""

    def _merged_apart(self, keys: np.ndarray) -> np.ndarray:
        """Whether the merges of a pair's joint text end in the pair."""
        sides = [(self._text(k >> 32), self._text(k & 0xFFFFFFFF)) for k in keys.tolist()]
        if len(sides) <= _FEW:
            return np.array([self._one_merged(a + b) == [(x, y) for x, y in ((0, len(a)), (len(a), len(a) + len(b))) if x < y] for a, b in sides])
        out = np.zeros(len(keys), bool)
        by_length: dict[int, list[int]] = {}
        for i, (a, b) in enumerate(sides):
            by_length.setdefault(len(a) + len(b), []).append(i)
        for n, own in by_length.items():
            for at in range(0, len(own), _SLICE):
                part = np.array(own[at : at + _SLICE])
                text = "".join(a + b for a, b in (sides[i] for i in part.tolist()))
                ends = self.merge(self.table(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)))
                cut = np.array([len(sides[i][0]) for i in part.tolist()])
                rows = np.arange(len(part))
                out[part] = (ends[rows, 0] == np.where(cut > 0, cut, n)) & ((cut == 0) | (ends[rows, cut % n] == n))
        return out

    def merge(self, found: np.ndarray) -> np.ndarray:
        """``ends`` as in :meth:`viterbi`, by merging the best-ranked neighbours of each unit until none merge."""
        n, size, wide = found.shape
        ends = np.tile(np.arange(1, size + 1, dtype=np.int32), (n, 1))
        scores = np.append(self.model.scores, np.float32(-np.inf))
        worth = np.full((n, size), -np.inf, np.float32)  # of merging the symbol at i with the next
        if size > 1:
            worth[:, :-1] = scores[found[:, :-1, 1]] if wide > 1 else -np.inf
        prior = np.tile(np.arange(-1, size - 1, dtype=np.int32), (n, 1))
        live = np.arange(n)
        while len(live):
            at = worth[live].argmax(1)
            live, at = (x[worth[live, at] > -np.inf] for x in (live, at))
            if not len(live):
                break
            middle = ends[live, at]
            end = ends[live, middle]
            ends[live, at], ends[live, middle] = end, 0
            worth[live, middle] = -np.inf
            more = end < size
            prior[live[more], end[more]] = at[more]
            worth[live, at] = -np.inf
            self._worth(found, scores, worth, live[more], at[more], ends[live[more], end[more]])
            left = prior[live, at]
            some = left >= 0
            self._worth(found, scores, worth, live[some], left[some], end[some])
        return ends

    @staticmethod
    def _worth(found, scores, worth, rows, starts, ends) -> None:
        length = ends - starts
        fits = length <= found.shape[2]
        worth[rows, starts] = -np.inf
        worth[rows[fits], starts[fits]] = scores[found[rows[fits], starts[fits], length[fits] - 1]]

    def _one(self, unit: str) -> list[tuple[int, int]]:
        """Start and end of each piece of a long unit, in time that grows with its length."""
        if self.model.model_type == UNIGRAM:
            n, low = len(unit), np.float32(self.lowest - 10)
            best, back = [np.float32(0)] + [np.float32(-np.inf)] * n, [0] * (n + 1)
            for j in range(1, n + 1):
                for i in range(max(0, j - self.longest), j):
                    k = self.ids.get(unit[i:j])
                    s = self.model.scores[k] if k is not None else low if j - i == 1 else None
                    if s is not None and best[i] + s > best[j]:
                        best[j], back[j] = best[i] + s, i
            out, j = [], n
            while j:
                out.append((back[j], j))
                j = back[j]
            return out[::-1]
        return self._one_merged(unit)

    def _one_merged(self, unit: str) -> list[tuple[int, int]]:
        """The pieces that a BPE model's merges leave of a text."""
        n = len(unit)
        end, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            if end[i] < n:
                k = self.ids.get(unit[i : end[end[i]]]) if end[end[i]] - i <= self.longest else None
                if k is not None:
                    heapq.heappush(heap, (-float(self.model.scores[k]), i, end[i], end[end[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != middle or middle >= n or not alive[middle] or end[middle] != stop:
                continue
            alive[middle], end[i] = False, stop
            if stop < n:
                left[stop] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [(i, end[i]) for i in range(n) if alive[i]]

    def _char(self, c: str) -> list[int]:
        if self.model.byte_fallback:
            return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def _emit(self, unit: str, parts: list[tuple[int, int]]) -> bytes:
        out: list[int] = []
        for i, j in parts:
            k = self.ids.get(unit[i:j])
            if k is not None:
                out.append(k)
            elif self.model.byte_fallback or not out or out[-1] != self.unknown:
                out += self._char(unit[i:j])
        return np.array(out, "<u4").tobytes()

    def _emit_all(self, units: list[str], found: np.ndarray, ends: np.ndarray) -> None:
        rows, starts = np.nonzero(ends)
        ids = found[rows, starts, ends[rows, starts] - starts - 1]
        odd = set(rows[ids < 0].tolist())
        cuts = np.searchsorted(rows, np.arange(len(units) + 1)) * 4
        data = ids.astype("<u4").tobytes()
        bounds = cuts.tolist()
        self.known.update((u, data[bounds[r] : bounds[r + 1]]) for r, u in enumerate(units) if r not in odd)
        for r in odd:
            self.known[units[r]] = self._emit(units[r], [(i, int(ends[r, i])) for i in range(ends.shape[1]) if ends[r, i]])

    # -- decoding
    def _shown(self, i: int) -> bytes:
        kind, piece = self.model.kinds[i], self.model.pieces[i]
        if kind == _BYTE:
            return bytes([int(piece[1:-1], 16)])
        return b"" if kind == _CONTROL else " ⁇ ".encode() if kind == _UNKNOWN else piece.replace(SPACE, " ").encode()

    def decode(self, data: bytes) -> str:
        """The text of little-endian 32-bit ids; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.shown.__getitem__, np.frombuffer(data, "<u4").tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(Model.load(path))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row.

    A null or empty text has none. Texts are read whole, long units one by one; a lone surrogate, which no text of a table can
    hold, would be encoded as its three bytes. Repeated rows are encoded each; an empty table gives no row; other columns are ignored.
    """
    path = model or default_model()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = codec(path).encode([t.as_py() or "" for t in batch.column("text")])
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
        return pa.RecordBatch.from_arrays([batch.column("id"), ids], ["id", "ids"])

    out = map_texts(slim, f"id {slim.schema['id'].dataType.simpleString()}, ids array<int>", run)
    return out.select(F.col("id").alias(id_col), "ids")


def decode(rows: DataFrame, *, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` of every row.

    Null or no ids give an empty text; an id outside of the model raises ``IndexError``. Repeated rows are decoded each; an
    empty table gives no row.
    """
    path = model or default_model()
    slim = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [codec(path).decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in batch.column("ids")]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.string())], ["id", "text"])

    out = map_texts(slim, f"id {slim.schema['id'].dataType.simpleString()}, text string", run)
    return out.select(F.col("id").alias(id_col), "text")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: tokens, a digest of the ids, and whether the text came back."""
    path = default_model()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, own = [t.as_py() or "" for t in batch.column("text")], codec(path)
        found = own.encode(texts)
        same = [own.decode(x) == t for x, t in zip(found, texts, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array(same, pa.bool_())],
            ["doc_id", "n_tokens", "ids_crc32", "round_trip"],
        )

    return map_texts(docs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_crc32 long, round_trip boolean", run)
