"""WARC archives with a two-level capture index.

Archives: every record is a gzip member of its own, so that it can be read by its byte range. They are
written by Spark's text sink, whose line separator is set to an empty gzip member; the files are therefore
ordinary multi-member gzip files, and any store that Spark can write to will do. A row of the sink stands for
at most a megabyte, so that a limit on a file's rows closes it by bytes.

Index: the captures are sorted by their reversed-host URL key over range partitions and cut into blocks of
lines, each a gzip member. The blocks of a file are followed by its sparse directory, which holds the first key and the place
of each block, and by the place of that directory. A lookup searches the files' first keys by halves, then the file's directory,
reads one block by its range, searches that by halves, and reads the record by its range. Lookups of many URLs run on the
executors: their keys are sorted, so that a task needs few directories, and then dealt by block; only keys and places
are shuffled, no archive content.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, map_texts, shared_path, table, written

#: Payloads with fewer bytes are stored again even if they repeat.
LEAST_REVISIT = 1000
#: An archive is closed after as many bytes and the record that goes over them; a row of the sink stands for so many.
ARCHIVE_BYTES, _ROW_BYTES = 32 << 20, 1 << 20
LINES_A_BLOCK, BLOCKS_A_FILE = 2000, 256
DATE = "1970-01-01T00:00:00Z"
_CHUNK = 1 << 16
#: Records of the same file with a gap of fewer bytes are read together, up to so many; files held open.
_GAP, _MOST_READ, _MOST_OPEN = 1 << 14, 8 << 20, 32


def member(data: bytes) -> bytes:
    """``data`` as one gzip member without a time stamp."""
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


SEPARATOR = member(b"")


def members(data: bytes | memoryview) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of the non-empty gzip members of a file."""
    view, at = memoryview(data).cast("B"), 0
    while at < len(view):
        if view[at : at + len(SEPARATOR)] == SEPARATOR:
            at += len(SEPARATOR)
            continue
        d, parts, end = zlib.decompressobj(31), [], at
        while not d.eof:
            chunk = view[end : end + _CHUNK]
            if not len(chunk):
                raise ValueError("a gzip member is cut off")
            parts.append(d.decompress(chunk))
            end += len(chunk)
        end -= len(d.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def url_key(url: str | None) -> str:
    """The sort key of a URL: its host reversed by labels, then path and query; no scheme, user or fragment."""
    url = quote((url or "").strip(), safe=_SAFE)
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    shown = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{shown}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


_SAFE = "".join(chr(c) for c in range(33, 127))


def record(page_id: object, url: str | None, payload: bytes, size: int, digest: str, refers_to: object, date: str = DATE) -> bytes:
    """A WARC record; ``refers_to`` makes it a revisit, which has no payload."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": quote((url or "").strip(), safe=_SAFE),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Payload-Length": size,
        "Content-Type": "application/http; msgtype=response",
    }
    if revisit:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("a record is cut off")
    return fields, block.partition(b"\r\n\r\n")[2]


def _name(urn: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(.+)>", urn or "")
    return found[1] if found else None


def _write_members(df: DataFrame, path: str, rows_a_file: int) -> None:
    """The only column of ``df``, binary, as gzip members in files under ``path``."""
    raw = df.select(F.col(df.columns[0]).cast("string").alias("value"))
    raw.write.option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", rows_a_file).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def write_archives(pages: DataFrame, path: str, *, least_revisit: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """A record for every row of ``pages`` in archives under ``path``.

    A null html is an empty payload. Of rows with equal payloads of at least ``least_revisit`` bytes the one with
    the largest id is a response and the others revisit it; rows that repeat that id are responses too, and
    a row without an id is a revisit only if some row with an id has its payload. An empty table gives no file
    with a record. Other columns are ignored. Payloads below ``least_revisit`` bytes aren't shuffled.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.select("*", F.length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"))
    small, large = p.where(F.col("size") < least_revisit), p.where(F.col("size") >= least_revisit)
    first = large.groupBy("digest", "size").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "size", "first")
    # The hint keeps one plan at every size: what repeats grows with the pages.
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    marked = large.join(first.hint("merge"), ["digest", "size"], "left").select("id", "url", "payload", "size", "digest", refers.alias("refers_to"))
    marked = marked.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    marked = small.select("id", "url", "payload", "size", "digest", F.lit(None).cast(p.schema["id"].dataType).alias("refers_to")).unionByName(marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c) for c in ("id", "url", "payload", "size", "digest", "refers_to")), strict=True)
            held = bytearray()
            for i, u, x, n, d, r in rows:
                held += member(record(i.as_py(), u.as_py(), x.as_py() or b"", n.as_py(), d.as_py(), r.as_py()))
                if len(held) >= _ROW_BYTES:
                    yield row(bytes(held))
                    held.clear()
            if held:
                yield row(bytes(held))

    def row(data: bytes) -> pa.RecordBatch:
        rest = [b""] * (len(data) // _ROW_BYTES)  # a long record counts as several rows
        return pa.RecordBatch.from_arrays([pa.array([data, *rest], pa.binary())], ["record"])

    bound_batches(pages.sparkSession)
    _write_members(marked.mapInArrow(run, "record binary"), path, max(1, archive_bytes // _ROW_BYTES))


#: The end of an index file: where its directory is and how long.
_TRAILER = struct.Struct("<QQ")


def build_index(spark: SparkSession, archives: str, path: str, *, lines_a_block: int = LINES_A_BLOCK, blocks_a_file: int = BLOCKS_A_FILE) -> DataFrame:
    """Write the index of all records under ``archives`` to files under ``path``, and return its directory.

    The directory has a row (key, file, offset, length) for each block. Records with equal keys are all listed. Archives
    without a record give an index without a block; a cut-off archive raises ``ValueError``.
    """

    def captures(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
            for at, n, data in members(content.as_buffer()):
                head, _ = parse(data)
                rows.append((url_key(head["WARC-Target-URI"]), file.as_py(), at, n))
        return _batch(rows, _PLACES) if rows else None

    found = written(map_texts(_files(spark, archives).select("path", "content"), "key string, file string, offset long, length long", captures), "captures")
    ordered = found.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[tuple[str, bytes]] = []
        lines: list[str] = []

        def file() -> pa.RecordBatch:
            data = _index_file(blocks)
            blocks.clear()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["file"])

        for batch in batches:
            for r in batch.to_pylist():
                lines.append(f"{r['key']} {r['offset']} {r['length']} {quote(r['file'], safe='/:')}")
                if len(lines) == lines_a_block:
                    blocks.append((lines[0].split(" ", 1)[0], member("\n".join(lines).encode())))
                    lines.clear()
                    if len(blocks) == blocks_a_file:
                        yield file()
        if lines:
            blocks.append((lines[0].split(" ", 1)[0], member("\n".join(lines).encode())))
        if blocks:
            yield file()

    _write_members(ordered.mapInArrow(cut, "file binary"), path, 1)

    def directory(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ranges = Ranges()
        rows = [(key, file, at, n) for file, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True) if size > _END for key, at, n in _directory(ranges.read, file, *_end(ranges.read, file, size))]
        return _batch(rows, _PLACES) if rows else None

    return map_texts(_files(spark, path).select("path", "length"), "key string, file string, offset long, length long", directory)


_PLACES = [("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
_END = _TRAILER.size + len(SEPARATOR)


def _index_file(blocks: list[tuple[str, bytes]]) -> bytes:
    """Blocks, each with its first key, and the directory at their end."""
    listed, at = [], 0
    for key, data in blocks:
        listed.append(f"{key} {at} {len(data)}")
        at += len(data)
    directory = member("\n".join(listed).encode())
    return b"".join(data for _, data in blocks) + directory + _TRAILER.pack(at, len(directory))


def _end(read: Callable[[str, int, int], bytes], file: str, size: int) -> tuple[int, int]:
    """Offset and length of an index file's directory."""
    return _TRAILER.unpack(read(file, size - _END, _TRAILER.size))


def _directory(read: Callable[[str, int, int], bytes], file: str, offset: int, length: int) -> list[tuple[str, int, int]]:
    """First key, offset and length of each block of an index file."""
    lines = (line.split(" ") for line in zlib.decompress(read(file, offset, length), 31).decode().split("\n"))
    return [(key, int(at), int(n)) for key, at, n in lines]


class Ranges:
    """Byte ranges of files, in any store that Arrow opens: local or mounted folders, HDFS, S3, GCS."""

    def __init__(self) -> None:
        self.stores: dict[str, pa_fs.FileSystem] = {}
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def _file(self, file: str) -> pa.NativeFile:
        if file in self.open:
            self.open.move_to_end(file)
            return self.open[file]
        scheme, host, path = re.fullmatch(r"(?:([A-Za-z][\w+.-]*):)?(?://([^/]*))?(/.*)", file, re.S).groups()
        scheme = {None: "file", "s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
        if (store := f"{scheme}://{host or ''}") not in self.stores:
            self.stores[store] = pa_fs.LocalFileSystem() if scheme == "file" else pa_fs.FileSystem.from_uri(f"{store}/")[0]
        if scheme in ("s3", "gs"):
            path = f"{host}{path}"
        self.open[file] = found = self.stores[store].open_input_file(path)
        if len(self.open) > _MOST_OPEN:
            self.open.popitem(last=False)[1].close()
        return found

    def read(self, file: str, offset: int, length: int) -> bytes:
        data = self._file(file).read_at(length, offset)
        if len(data) != length:
            raise ValueError(f"{file} ends before {offset + length}")
        return data

    def read_all(self, places: Iterable[tuple[str, int, int]]) -> Iterator[bytes]:
        """The ranges by file and offset; near ones are read together."""
        run: list[tuple[str, int, int]] = []

        def whole() -> Iterator[bytes]:
            if run:
                start = run[0][1]
                data = self.read(run[0][0], start, run[-1][1] + run[-1][2] - start)
                for _, at, n in run:
                    yield data[at - start : at - start + n]

        for file, at, n in sorted(places):
            if run and (file != run[-1][0] or at - run[-1][1] - run[-1][2] > _GAP or at + n - run[0][1] > _MOST_READ):
                yield from whole()
                run = []
            run.append((file, at, n))
        yield from whole()


class Search:
    """Searches by halves: of the index files' first keys, of a file's directory, and of a block's lines."""

    def __init__(self, tops: list[tuple[str, str, int, int]], read: Callable[[str, int, int], bytes]) -> None:
        """``tops``: first key, path, and offset and length of the directory of each index file, sorted."""
        self.tops, self.read = tops, read
        self.firsts = [t[0] for t in tops]
        self.held: tuple[int, list[str], list[tuple[str, int, int]]] = (-1, [], [])

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """File, offset and length of the blocks that may list ``key``."""
        at = max(0, bisect_left(self.firsts, key) - 1)
        while at < len(self.firsts) and self.firsts[at] <= key:
            file = self.tops[at][1]
            if self.held[0] != at:
                found = _directory(self.read, file, *self.tops[at][2:])
                self.held = (at, [d[0] for d in found], found)
            _, firsts, found = self.held
            i = max(0, bisect_left(firsts, key) - 1)
            while i < len(firsts) and firsts[i] <= key:
                yield file, found[i][1], found[i][2]
                i += 1
            at += 1

    def lines(self, block: tuple[str, int, int]) -> list[str]:
        return zlib.decompress(self.read(*block), 31).decode().split("\n")

    @staticmethod
    def captures(lines: list[str], key: str) -> Iterator[tuple[str, int, int]]:
        """File, offset and length of each record that a block lists for ``key``."""
        i = bisect_left(lines, f"{key} ")
        while i < len(lines) and lines[i].startswith(f"{key} "):
            _, offset, length, file = lines[i].split(" ")
            yield unquote(file), int(offset), int(length)
            i += 1


def _tops(spark: SparkSession, path: str) -> list[tuple[str, str, int, int]]:
    """What :class:`Search` needs of each index file: a row for ``BLOCKS_A_FILE * LINES_A_BLOCK`` records or a partition."""

    def top(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ranges, rows = Ranges(), []
        for file, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
            if size > _END:
                at, n = _end(ranges.read, file, size)
                rows.append((_directory(ranges.read, file, at, n)[0][0], file, at, n))
        return _batch(rows, _PLACES) if rows else None

    found = map_texts(_files(spark, path).select("path", "length"), "key string, file string, offset long, length long", top)
    return sorted(tuple(r) for r in found.collect())


class CaptureIndex:
    """Lookups of single URLs from the driver, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.search = Search(_tops(spark, path), self.read)

    def read(self, file: str, offset: int, length: int) -> bytes:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(file)
        stream = p.getFileSystem(conf).open(p)
        try:
            stream.seek(offset)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
        finally:
            stream.close()

    def lookup(self, url: str) -> list[tuple[str, int, int]]:
        """File, offset and length of each capture of ``url``."""
        key = url_key(url)
        return [place for block in self.search.blocks(key) for place in self.search.captures(self.search.lines(block), key)]

    def fetch(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """Header and payload of each capture of ``url``."""
        return [parse(zlib.decompress(self.read(*place), 31)) for place in self.lookup(url)]


def _checked(data: bytes) -> tuple:
    """Id, payload's size and digest, type and reference of a record; a response's payload must have its digest."""
    head, payload = parse(zlib.decompress(data, 31))
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = head["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(head["WARC-Payload-Length"])):
        raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
    return _name(head["WARC-Record-ID"]), int(head["WARC-Payload-Length"]), digest, kind, _name(head.get("WARC-Refers-To"))


_RECORD = [("id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())]


def read_captures(urls: DataFrame, index: str, *, url_col: str = "url") -> DataFrame:
    """Every record whose URL has the key of some row of ``urls``, found through the index and read by its range.

    Columns: ``id``, ``payload_bytes``, ``payload_digest`` (hex SHA-1), ``record_type``, ``refers_to``; a row for each
    record, however often a URL occurs. A null URL counts as an empty one, a URL without a capture gives no row. A response's
    payload is digested again; one that differs from its header raises ``ValueError``. Archives and
    index must be in a store that :class:`Ranges` opens on the executors.
    """
    spark = urls.sparkSession
    tops = _tops(spark, index)

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _batch([(k,) for k in {url_key(u) for u in batch.column("url").to_pylist()}], _PLACES[:1])

    keys = map_texts(urls.select(F.col(url_col).cast("string").alias("url")), "key string", keyed).distinct()

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, rows = Search(tops, Ranges().read), []
        for batch in batches:
            for key in batch.column("key").to_pylist():
                for block in search.blocks(key):
                    rows.append((key, *block))
                    if len(rows) == LINES_A_BLOCK:
                        yield _batch(rows, _PLACES)
                        rows = []
        yield _batch(rows, _PLACES)

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        search, last, lines = Search([], ranges.read), None, []
        for batch in batches:
            places = []
            for key, *block in zip(*(batch.column(n).to_pylist() for n, _ in _PLACES), strict=True):
                if block != last:
                    last, lines = block, search.lines(block)
                places += search.captures(lines, key)
                if len(places) >= LINES_A_BLOCK:
                    yield _batch([_checked(x) for x in ranges.read_all(places)], _RECORD)
                    places = []
            yield _batch([_checked(x) for x in ranges.read_all(places)], _RECORD)

    bound_batches(spark)
    ordered = keys.repartitionByRange("key").sortWithinPartitions("key")
    found = ordered.mapInArrow(located, "key string, file string, offset long, length long")
    by_block = found.repartition("file", "offset").sortWithinPartitions("file", "offset", "key")
    return by_block.mapInArrow(fetched, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, indexed, and read back by looking up each page's URL."""
    archives, index = shared_path(spark, "warc"), shared_path(spark, "capture-index")
    pages = table(spark, sf_dir, "pages")
    write_archives(pages, archives)
    build_index(spark, archives, index)
    found = read_captures(pages, index)
    return found.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP9_SQL = """
with p as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), d as (
  select page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as payload_digest from p
), f as (
  select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes) else page_id end as top from d
)
select page_id, payload_bytes, payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id <> top then top end as refers_to
from f
"""
