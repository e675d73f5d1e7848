"""WARC archives: a writer made of DataFrame functions, and a PySpark Python data source.

The writer makes each record's text by SQL functions and leaves the files to Spark's own
text sink, whose line separator is the end of a WARC record; so files are committed by
Spark and may be on any file system that it can write to. Records with equal payloads are
written once as ``response``; the others are ``revisit`` records that name it.

The reader (``spark.read.format("warc")``) plans partitions of whole files of about equal
bytes, takes over predicates on ``record_type``, ``target_uri``, ``page_id`` and the other
header columns, parses a record's header first, and skips the block of a record that the
predicates reject without reading or decoding it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith

from lexspan.llm.blocks import quoted
from lexspan.session import forget, settled, shared_folder, ship, table

CRLF = "\r\n"
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 0
#: Known firsts of repeated payloads are broadcast up to this many rows; more are joined by shuffle.
BROADCAST_ROWS = 200_000
SALTS = 32
#: Bytes of archives that one read task gets, unless a single file is longer.
PARTITION_BYTES = 64_000_000


# Writing --------------------------------------------------------------------


def base32_sha1(payload: Column) -> Column:
    """The upper-case base32 SHA-1 of a binary or string column."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]  # 40 bits, 8 letters each
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(key: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(" ", F.coalesce(key, F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), *(x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, i, n), F.lit("-" if i < 21 else ">"))))


def records(pages: DataFrame, payload: str = "html", key: str = "page_id", uri: str = "url", date: str = "2024-01-01T00:00:00Z", least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """One column, ``value``: the text of one WARC record per row of ``pages``.

    Of rows with equal payloads of ``least_revisit`` bytes or more, that with the smallest key is a
    response and the others revisit it; rows that share the smallest key are all
    responses. Null keys come after all others; if all keys are null, all rows are
    responses. A null payload is empty, a null uri is left out, and control characters
    in a uri are percent-encoded. Other columns are not read.

    Only digests and keys are shuffled. A payload that a third of all rows share is one
    row after the partial aggregation, and the rows that look their digest up are not
    moved unless the table of repeated payloads is too large to broadcast; then the rows of
    a payload go to ``SALTS`` tasks.
    """
    body = F.coalesce(pages[quoted(payload)], F.lit(""))
    base = pages.select(pages[quoted(key)].alias("k"), F.regexp_replace(pages[quoted(uri)], r"[\x00-\x20\x7f]", "%20").alias("u"), body.alias("p"), F.octet_length(body).cast("long").alias("n"), base32_sha1(body).alias("d"))
    repeated = base.where(F.col("n") >= least_revisit).groupBy("d").agg(F.min("k").alias("first"), F.count("*").alias("times")).where((F.col("times") > 1) & F.col("first").isNotNull()).drop("times")
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = base.join(F.broadcast(repeated), "d", "left")
    else:
        dealt = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = base.withColumn("salt", F.pmod(F.xxhash64("k", "u"), F.lit(SALTS)).cast("int")).join(dealt, ["d", "salt"], "left")
    again = F.col("first").isNotNull() & (F.col("k").isNull() | (F.col("k") > F.col("first"))) & (F.col("n") >= least_revisit)
    page, first = F.col("k").cast("string"), F.col("first").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(2 * CRLF))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("p")))
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    lines = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        header("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", _record_id(page, F.col("d"))),
        F.lit(f"WARC-Date: {date}"),
        header("WARC-Target-URI", F.col("u")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("d"))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(again, header("WARC-Refers-To", _record_id(first, F.col("d")))),
        header("X-Page-ID", page),
        F.when(again, header("X-Refers-To-Page-ID", first)),
        F.lit("Content-Type: application/http; msgtype=response"),
        header("Content-Length", F.octet_length(block).cast("string")),
    )
    return joined.select(F.concat(lines, F.lit(2 * CRLF), block).alias("value"))


def write_warc(pages: DataFrame, path: str, compression: str = "none", **options) -> None:
    """Write ``records(pages)`` as archives in the new folder ``path``; ``compression``: none or gzip."""
    records(pages, **options).write.option("lineSep", 2 * CRLF).option("compression", compression).text(path)


# Reading --------------------------------------------------------------------

SCHEMA = "record_type string, record_id string, target_uri string, date string, page_id string, refers_to string, refers_to_page string, payload_digest string, content_type string, payload_bytes long, payload binary, file string, offset long"
_HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "page_id": "x-page-id",
    "refers_to": "warc-refers-to", "refers_to_page": "x-refers-to-page-id", "payload_digest": "warc-payload-digest", "content_type": "content-type",
}


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str] | None = None):
        self.path = options["path"]
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")] if names is None else names
        self.names = names
        self.want = options.get("payload", "bytes")  # bytes: the payload; digest: checked against its header only; none: not read
        if self.want == "bytes" and "payload" not in names:
            self.want = "none"
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") else None
            if column not in _HEADERS:
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "there", None))
            elif isinstance(f, IsNull):
                self.tests.append((column, "in", (None,)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, place = _file_system(self.path)
        info = system.get_file_info(place)
        if info.type == fs.FileType.File:
            found = [info]
        else:
            found = [i for i in system.get_file_info(fs.FileSelector(place, recursive=True)) if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]
        parts: list[list[str]] = []
        room = 0
        for i in sorted(found, key=lambda i: (-i.size, i.path)):
            if not parts or i.size > room:
                parts.append([])
                room = self.size
            parts[-1].append(i.path)
            room -= i.size
        return [Files(p) for p in parts]

    def wanted(self, header: dict[str, str]) -> bool:
        for column, how, value in self.tests:
            own = header.get(_HEADERS[column])
            if how == "in" and own not in value or how == "there" and own is None or how == "starts" and not (own or "").startswith(value):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(self.path)
        every = [c.split(" ") for c in SCHEMA.split(", ")]
        place = {name: i for i, (name, _) in enumerate(every)}
        kinds = {name: {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[kind] for name, kind in every}
        schema = pa.schema([(name, kinds[name]) for name in self.names])
        told = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[place[n]] for r in rows], kinds[n]) for n in self.names], schema=schema)
        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_stream(path, compression=None) if path.endswith(".gz") else system.open_input_file(path) as raw:
                source = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
                for offset, header, payload, size in self.records(source):
                    rows.append([*(header.get(h) for h in _HEADERS.values()), size, payload, path, offset])
                    held += len(payload or b"") + 500
                    if held > 4_000_000:
                        yield told(rows)
                        rows, held = [], 0
        if rows:
            yield told(rows)

    def records(self, source) -> Iterator[tuple[int, dict[str, str], bytes | None, int]]:
        reader = _Buffered(source, self.want == "none")
        while True:
            offset = reader.at
            head = reader.until(b"\r\n\r\n")
            if head is None:
                return
            first, *lines = head.decode("utf-8").split(CRLF)
            if not first.startswith("WARC/"):
                raise ValueError(f"no WARC record at byte {offset}")
            header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            length = int(header["content-length"])
            if not self.wanted(header):
                reader.skip(length + 4)
                continue
            if self.want == "none":
                size = length
                if header.get("content-type", "").startswith("application/http"):
                    http = reader.head(length)
                    size = _told_length(http, length - len(http))
                    length -= len(http)
                reader.skip(length + 4)
                yield offset, header, None, size
                continue
            block = reader.take(length)
            reader.skip(4)
            payload, size = block, length
            if header.get("content-type", "").startswith("application/http"):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = _told_length(http, len(payload))
            if header.get("warc-type") == "revisit":
                payload = None
            else:
                digest = header.get("warc-payload-digest", "")
                if digest.startswith("sha1:") and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest[5:] or len(payload) != size:
                    raise ValueError(f"the payload of the record at byte {offset} differs from its header")
            yield offset, header, payload if self.want == "bytes" else None, size


def _told_length(http: bytes, otherwise: int) -> int:
    told = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return int(told[0]) if told else otherwise


class _Buffered:
    """A stream read in steps, large ones where blocks are wanted; skipping seeks where the stream can."""

    STEP, HEADER_STEP = 1 << 20, 1 << 13

    def __init__(self, source, headers_only: bool = False):
        self.source, self.held, self.at, self.pos = source, b"", 0, 0
        self.step = self.HEADER_STEP if headers_only else self.STEP

    def _fill(self) -> bool:
        more = self.source.read(self.step)
        self.held = self.held[self.pos :] + more
        self.pos = 0
        return bool(more)

    def until(self, mark: bytes) -> bytes | None:
        while (found := self.held.find(mark, self.pos)) < 0:
            if not self._fill():
                if self.held.strip():
                    raise ValueError("the archive ends within a record")
                return None
        out = self.held[self.pos : found]
        self.at += found + len(mark) - self.pos
        self.pos = found + len(mark)
        return out

    def head(self, most: int) -> bytes:
        """The next bytes up to the end of an HTTP header, of at most ``most`` bytes."""
        seen = self.pos
        while (found := self.held.find(b"\r\n\r\n", seen)) < 0 and len(self.held) - self.pos < most:
            seen = max(0, len(self.held) - self.pos - 3)
            if not self._fill():
                raise ValueError("the archive ends within a record")
        return self.take(min(most, found + 4 - self.pos) if found >= 0 else most)

    def take(self, n: int) -> bytes:
        while len(self.held) - self.pos < n:
            if not self._fill():
                raise ValueError("the archive ends within a record")
        out = self.held[self.pos : self.pos + n]
        self.pos += n
        self.at += n
        return out

    def skip(self, n: int) -> None:
        self.at += n
        there = len(self.held) - self.pos
        if n <= there:
            self.pos += n
            return
        self.held, self.pos, left = b"", 0, n - there
        if hasattr(self.source, "seekable") and self.source.seekable() and not isinstance(self.source, gzip.GzipFile):
            self.source.seek(self.source.tell() + left)
        else:
            while left and (got := self.source.read(min(left, self.step))):
                left -= len(got)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``; options ``payload`` (bytes, digest, none) and ``partitionBytes``.

    Only the columns of a schema given to the reader are made; without ``payload`` among them
    blocks are skipped after their HTTP header, as with the option ``none``.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), schema.names)


def read_warc(spark: SparkSession, path: str, payload: str = "bytes") -> DataFrame:
    """The records of the archives in a folder and the folders in it (or of one file).

    A folder without archives has none. A record that is cut short, does not begin as one, or
    whose payload differs from its digest is an error that names the byte.
    """
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", payload).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, and delete them: one row per record."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/lexspan/{uuid.uuid4().hex}"
    write_warc(pages, path)
    found = read_warc(spark, path, payload="digest")
    kind = pages.schema["page_id"].dataType
    out = settled(spark, found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", F.col("refers_to_page").cast(kind).alias("refers_to")))
    forget(spark, path)
    return out


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))
