"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: trigrams that every match
must hold, joined by AND and OR. Each bounded batch of documents is a shard with an inverted index of the
trigrams that the rules ask for; a query intersects and unites postings, and only the candidates are
searched with the expression. A rule without a mandatory trigram is searched in every document. Sharding
by document needs no shuffle, and a lost shard is simply scanned again.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

#: A Boolean query: a trigram, ("and", ...), ("or", ...), or None, which any text meets.
Query = bytes | tuple | None


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: A private key from its BEGIN line to its END line; where that is missing, to the end of its headers and lines of
#: base64 with a short last one, which may be indented, quoted or parted by a written-out line break.
_KEY = r"PRIVATE KEY(?: BLOCK)?-----"
_BREAK = r"(?:[\s>#*|\"'+,;]|\\[nrt]|//)"
PEM = rf"-----BEGIN [A-Z0-9 ]*{_KEY}(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z0-9 ]*{_KEY}|(?:{_BREAK}*+[A-Za-z-]+: [^\n]*)*+(?:(?:{_BREAK}*+[A-Za-z0-9+/=]{{16,}}+)++(?:{_BREAK}*+[A-Za-z0-9+/]++={{0,2}}+(?=[^\S\n]*+(?:\n|$)|[\"'\\]))?)?)"

#: The three base rules come first, as their order breaks ties.
RULES: tuple[Rule, ...] = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", PEM),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_fine", r"github_pat_[A-Za-z0-9_]{22,}"),
    Rule("forge_access", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("chat_hook", r"hooks\.slack\.com/services/T[A-Z0-9]{6,}/B[A-Z0-9]{6,}/[A-Za-z0-9]{16,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"(?:sk|rk|whsec)_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("mail", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("package", r"(?:npm_[A-Za-z0-9]{36}|pypi-AgEI[A-Za-z0-9_-]{40,})"),
    Rule("url", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@\"']{1,100}:[^\s/@\"']{3,200}@[A-Za-z0-9]"),
    Rule("bearer", r"(?i:bearer)\x20{1,4}[A-Za-z0-9+/_.=-]{24,}"),
)

_MOST_STRINGS = 64


def _every(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return ("and", *parts) if len(parts) > 1 else parts[0] if parts else None


def _either(parts: list[Query]) -> Query:
    if not parts or any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    return ("or", *parts) if len(parts) > 1 else parts[0]


def _strings(found: set[bytes]) -> Query:
    """The query of texts that hold one of some strings."""
    return _either([_every([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(found)])


def _characters(items: list) -> set[bytes] | None:
    """The folded characters of a bracket, or None if they are many."""
    out = set()
    for op, av in items:
        if op is sre.LITERAL:
            span = (av, av)
        elif op is sre.RANGE:
            span = av
        else:
            return None
        if span[1] > 127 or span[1] - span[0] > 8:
            return None
        out |= {chr(c).lower().encode() for c in range(span[0], span[1] + 1)}
    return out if len(out) <= 8 else None


def _sequence(items) -> tuple[set[bytes] | None, Query]:
    """Either all folded strings that a parsed expression matches, or None and its query."""
    exact, parts, whole = {b""}, [], True
    for op, av in items:
        strings, query = _item(op, av)
        if strings is not None and len(exact) * len(strings) <= _MOST_STRINGS:
            exact = {a + b for a in exact for b in strings}
            continue
        whole = False
        parts += [_strings(exact), _strings(strings) if strings is not None else query]
        exact = {b""}
    if whole:
        return exact, None
    return None, _every([*parts, _strings(exact)])


def _item(op, av) -> tuple[set[bytes] | None, Query]:
    if op is sre.LITERAL:
        return ({chr(av).lower().encode()}, None) if av < 128 else (None, None)
    if op is sre.IN:
        return _characters(av), None
    if op is sre.SUBPATTERN:
        return _sequence(av[-1])
    if op is sre.BRANCH:
        found = [_sequence(x) for x in av[1]]
        if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= _MOST_STRINGS:
            return set().union(*(s for s, _ in found)), None
        return None, _either([_strings(s) if s is not None else q for s, q in found])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = av
        strings, query = _sequence(inner)
        if strings is not None and least == most == 1:
            return strings, None
        if strings is not None and (least, most) == (0, 1):
            return strings | {b""}, None
        return None, None if least == 0 else _strings(strings) if strings is not None else query
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {b""}, None
    return None, None


def trigram_query(pattern: str) -> Query:
    """The trigrams, lower case in ASCII, that a text with a match must hold; None if there are none."""
    strings, query = _sequence(_parser.parse(pattern, re.ASCII))
    return _strings(strings) if strings is not None else query


def trigrams(query: Query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1:]))


class Scanner:
    """Rules with their queries, and a table of the trigrams that these ask for."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.rules = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        self.wanted = sorted(set().union(*(trigrams(q) for _, _, q in self.rules)))
        if len(self.wanted) > 65_000:
            raise ValueError("the rules ask for too many trigrams")
        self.table = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(self.wanted):
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = i + 1
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def index(self, texts: pa.Array) -> np.ndarray:
        """The postings of a shard: for each wanted trigram, which texts hold it."""
        postings = np.zeros((len(self.wanted), len(texts)), bool)
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if data is None or ends[-1] - ends[0] < 3:
            return postings
        raw = self.fold[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]].astype(np.uint32)
        which = self.table[raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]]
        at = np.flatnonzero(which)
        ends = ends - ends[0]
        doc = np.searchsorted(ends, at, "right") - 1
        inside = at + 2 < ends[doc + 1]
        postings[which[at[inside]] - 1, doc[inside]] = True
        return postings

    def candidates(self, query: Query, postings: np.ndarray) -> np.ndarray:
        if query is None:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, bytes):
            return postings[self.wanted.index(query)]
        parts = [self.candidates(q, postings) for q in query[1:]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule number, end) in code points, sorted; null: none."""
        postings = self.index(texts)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        read: dict[int, str] = {}
        for n, (rule, regex, query) in enumerate(self.rules):
            for i in np.flatnonzero(self.candidates(query, postings)).tolist():
                text = read.get(i)
                if text is None:
                    text = read[i] = texts[i].as_py() or ""
                for m in regex.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), n, m.end()))
        for spans in found:
            spans.sort()
        return found


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def find_secrets(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col`` and ``spans``, an array of (kind, start, end) in code points.

    Spans are sorted by start and then by the order of ``rules``; within a rule they don't overlap. A null or
    empty text has none. Repeated rows give repeated results.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = [r.kind for r in rules]
        found = scanner(rules).scan(batch.column("text"))
        spans = pa.array([[{"kind": names[n], "start": a, "end": b} for a, n, b in x] for x in found], kind)
        return pa.RecordBatch.from_arrays([batch.column("id"), spans], ["id", "spans"])

    out = map_texts(slim, f"id {slim.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>", run)
    return out.select(F.col("id").alias(id_col), "spans")


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with every stretch that spans cover replaced by one ``mark``."""
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str, *, mark: str = "[SECRET]") -> DataFrame:
    """Pipeline stage: every secret in ``text`` becomes ``mark``; no row goes.

    A column ``n_chars`` follows, if there is one. A null text stays null; texts are read whole; repeated rows are redacted
    alike; an empty table gives no row.
    """
    names = docs.columns
    at, length = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at)
        found = scanner(RULES).scan(texts)
        if not any(found):
            return batch
        new = [redact(t.as_py(), s, mark) if s else t.as_py() for t, s in zip(texts, found, strict=True)]
        columns = batch.columns
        columns[at] = pa.array(new, texts.type)
        if length is not None:
            counts = [len(t) if s else n.as_py() for t, s, n in zip(new, found, batch.column(length), strict=True)]
            columns[length] = pa.array(counts, batch.column(length).type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_texts(docs, docs.schema, run)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts of the base kinds, a digest of the base spans, and all spans."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in RULES if r.base]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in base], F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
