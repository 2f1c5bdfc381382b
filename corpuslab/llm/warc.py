"""WARC archives as a Python data source: planned by files, filtered by headers, payloads decoded only where wanted."""

from __future__ import annotations

import glob
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from corpuslab.llm.common import checkpoint_folder, spare

#: The columns of a record that are WARC fields, and the fields' names (fixed values).
FIELDS = {
    "type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
#: What a record consists of, as written and as read. payload_length is that of the whole payload, which a revisit has not.
RECORD = ", ".join(f"{c} string" for c in FIELDS) + ", payload_length long, fields map<string,string>, payload binary"
PLACE = "file string, offset long"
#: Bytes of archive that one reading task takes, in whole files; a writing task starts another file beyond it.
PARTITION_BYTES = 64 << 20
#: Bytes of payload in a batch of rows, and bytes that are read or inflated at a time.
BATCH_BYTES, PIECE = 4 << 20, 1 << 18
#: Payloads of fewer bytes are stored again rather than referred to.
LEAST_REVISITED = 1000
HTTP = ("response", "revisit", "request")
END = b"\r\n\r\n"
GZIP = b"\x1f\x8b"


# Files


class Folder:
    """The files below a path: a local or shared folder, or any store that pyarrow reaches (hdfs, s3, gs, abfs)."""

    def __init__(self, path: str):
        local = re.fullmatch(r"(?:file:/*)?(/.*|[^:]*)", path)
        self.store, self.root = None, path
        if path.startswith("file:"):
            self.root = "/" + path[5:].lstrip("/")
        elif not local:
            from pyarrow import fs

            self.store, self.root = fs.FileSystem.from_uri(path)

    def open(self, name: str, mode: str = "rb"):
        if self.store is None:
            if mode == "wb":
                os.makedirs(os.path.dirname(name), exist_ok=True)
            return open(name, mode)
        return self.store.open_input_file(name) if mode == "rb" else self.store.open_output_stream(name)

    def sizes(self) -> dict[str, int]:
        """The files by full name: those of a folder, of a pattern, or the one file."""
        if self.store is None:
            found = [self.root] if os.path.isfile(self.root) else glob.glob(f"{self.root}/*" if os.path.isdir(self.root) else self.root)
            return {f: os.path.getsize(f) for f in found if os.path.isfile(f)}
        from pyarrow import fs

        about = self.store.get_file_info([self.root])[0]
        found = [about] if about.type == fs.FileType.File else self.store.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return {f.path: f.size for f in found if f.type == fs.FileType.File}

    def remove(self, name: str) -> None:
        if self.store is not None:
            self.store.delete_file(name)
        elif os.path.exists(name):
            os.remove(name)

    def archives(self) -> dict[str, int]:
        """Archives by full name with their bytes. Where jobs have left lists of what they committed, only those
        files count, so that what a lost task wrote is never read."""
        sizes = self.sizes()
        lists = [f for f in sizes if re.search(r"/_committed-[^/]*\.json$", f)]
        if lists:
            kept = set()
            for name in lists:
                with self.open(name) as file:
                    kept.update(json.loads(file.read()))
            return {f: n for f, n in sizes.items() if os.path.basename(f) in kept}
        return {f: n for f, n in sizes.items() if re.search(r"\.warc(\.gz)?$", f)}


# Records


def field_lines(pairs: list[tuple[str, str | None]]) -> bytes:
    """Header lines. Control characters in a value, which would end or break its line, are percent-escaped."""
    safe = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", v)
    return "".join(f"{k}: {safe(v)}\r\n" for k, v in pairs if v is not None).encode()


def parse_fields(block: bytes) -> dict[str, str]:
    """The fields after the first line; a line that begins with a blank goes on with the one before."""
    found: dict[str, str] = {}
    name = None
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            found[name] = value.strip()
    return found


def member(plain: bytes, level: int = 6) -> bytes:
    """A gzip member of a record, whose extra field `sl` holds its compressed and plain length, so that a reader
    can step over it. (Records of 4 GB or more have none.)"""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(plain) + squeeze.flush()
    tail = zlib.crc32(plain).to_bytes(4, "little") + (len(plain) & 0xFFFFFFFF).to_bytes(4, "little")
    size = 10 + 14 + len(body) + 8
    head = GZIP + b"\x08\x04\0\0\0\0\0\xff"
    if max(size, len(plain)) >= 1 << 32:
        return head[:3] + b"\0" + head[4:] + body + tail
    extra = b"sl\x08\0" + size.to_bytes(4, "little") + len(plain).to_bytes(4, "little")
    return head + len(extra).to_bytes(2, "little") + extra + body + tail


def record(row: dict) -> bytes:
    """A whole record. Responses, requests and revisits hold an HTTP head, of whose length the payload's follows."""
    payload = row.get("payload") or b""
    length = row.get("payload_length")
    length = len(payload) if length is None else length
    block = payload
    kind = row["type"]
    if kind in HTTP:
        first = b"GET / HTTP/1.1\r\n" if kind == "request" else b"HTTP/1.1 200 OK\r\n"
        block = first + field_lines([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(length))]) + b"\r\n" + (payload if kind != "revisit" else b"")
    digest = row.get("payload_digest")
    own = [(name, row.get(c)) for c, name in FIELDS.items() if c != "payload_digest"] + [("WARC-Payload-Digest", digest and f"sha1:{digest}")]
    if kind == "revisit":
        own.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    if kind in HTTP:
        own.append(("Content-Type", f"application/http; msgtype={'request' if kind == 'request' else 'response'}"))
    own += [(k, v) for k, v in dict(row.get("fields") or {}).items()] + [("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + field_lines(own) + b"\r\n" + block + END


class Plain:
    """Bytes of an uncompressed archive; what is not wanted is stepped over by seeking."""

    def __init__(self, file, size: int):
        self.file, self.size, self.held = file, size, b""

    def more(self) -> bool:
        piece = self.file.read(PIECE)
        self.held += piece
        return bool(piece)

    def begin(self) -> int | None:
        """The place of the next record; None at the end."""
        self.held = self.held.lstrip(b"\r\n")
        while not self.held:
            if not self.more():
                return None
            self.held = self.held.lstrip(b"\r\n")
        return self.file.tell() - len(self.held)

    def until(self, mark: bytes) -> bytes:
        """The bytes up to ``mark`` and past it."""
        looked = 0
        while (found := self.held.find(mark, looked)) < 0:
            looked = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                raise ValueError("a record ends within its header")
        out, self.held = self.held[:found], self.held[found + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        pieces, held = [self.held[:n]], len(self.held[:n])
        self.held = self.held[n:]
        while held < n:
            if not self.more():
                raise ValueError("a record ends within its block")
            pieces.append(self.held[: n - held])
            held += len(pieces[-1])
            self.held = self.held[len(pieces[-1]) :]
        return b"".join(pieces)

    def skip(self, n: int) -> None:
        here = min(n, len(self.held))
        self.held = self.held[here:]
        if n > here:
            to = self.file.tell() + n - here
            if to > self.size:
                raise ValueError("a record ends within its block")
            self.file.seek(to)

    def end(self) -> None:
        """After a record, whose block was taken or skipped."""


class Gunzip(Plain):
    """Bytes of an archive of one gzip member a record. A member is inflated as far as it is asked for; the rest is
    stepped over by the length in its extra field, or where it has none, inflated piece by piece and dropped."""

    def __init__(self, file, size: int):
        super().__init__(file, size)
        self.raw, self.inflate, self.next = b"", None, None
        self.inflated = 0

    def _raw(self, least: int) -> int:
        while len(self.raw) < least and (piece := self.file.read(PIECE)):
            self.raw += piece
        return len(self.raw)

    def begin(self) -> int | None:
        if self._raw(24) == 0:
            return None
        if self.raw[:2] != GZIP:
            raise ValueError("no gzip member where a record should begin")
        start = self.file.tell() - len(self.raw)
        self.inflate, self.next, self.held = zlib.decompressobj(31), None, b""
        if self.raw[3] & 4 and self.raw[12:16] == b"sl\x08\0":
            self.next = start + int.from_bytes(self.raw[16:20], "little")
        return start

    def more(self) -> bool:
        if self.inflate.eof:
            return False
        if not self.raw and not self._raw(1):
            raise ValueError("a gzip member is cut off")
        piece = self.inflate.decompress(self.raw, PIECE)
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.inflated += len(piece)
        self.held += piece
        return bool(piece) or not self.inflate.eof and bool(self.raw or self._raw(1))

    def skip(self, n: int) -> None:
        """Nothing is inflated now; ``end`` steps over the rest."""

    def end(self) -> None:
        if self.inflate.eof:
            return
        if self.next is not None and self.next <= self.size:
            ahead = self.next - (self.file.tell() - len(self.raw))
            if ahead < len(self.raw):
                self.raw = self.raw[ahead:]
            else:
                self.file.seek(self.next)
                self.raw = b""
            return
        while not self.inflate.eof:
            self.held = b""
            self.more()


def records(file, size: int, keep=None, decode=None) -> Iterator[tuple[int, dict[str, str], int | None, bytes | None]]:
    """(offset, fields, payload length, payload) of each record. ``keep(fields)``, asked once a header is parsed and
    before any more is read, tells whether the record is wanted, ``decode(type)`` whether its payload is."""
    first = file.read(2)
    file.seek(0)
    source = Gunzip(file, size) if first == GZIP else Plain(file, size)
    while (at := source.begin()) is not None:
        head = source.until(END)
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = parse_fields(head)
        rest = int(fields.get("Content-Length", 0))
        if keep is not None and not keep(fields):
            source.skip(rest)
            source.end()
            continue
        kind, length, payload = fields.get("WARC-Type"), rest, None
        if kind in HTTP and fields.get("Content-Type", "").startswith("application/http"):
            http = source.until(END)
            rest -= len(http) + len(END)
            told = parse_fields(http).get("Content-Length", "")
            length = int(told) if told.isdigit() and kind == "revisit" else rest
        if decode is None or decode(kind):
            payload = source.take(rest)
        else:
            source.skip(rest)
        source.end()
        yield at, fields, length, payload


# Filters


def holds(test: ds.Filter, value: str | int | None) -> bool:
    """Whether a pushed filter holds for its column's value; as in SQL, most tests of null do not."""
    match test:
        case ds.IsNull():
            return value is None
        case ds.IsNotNull():
            return value is not None
        case ds.EqualNullSafe():
            return value == test.value
        case ds.Not():
            return value is not None and not holds(test.child, value)
        case _ if value is None:
            return False
        case ds.EqualTo():
            return value == test.value
        case ds.In():
            return value in test.value
        case ds.StringStartsWith():
            return value.startswith(test.value)
        case ds.StringEndsWith():
            return value.endswith(test.value)
        case ds.StringContains():
            return test.value in value
        case ds.GreaterThan():
            return value > test.value
        case ds.GreaterThanOrEqual():
            return value >= test.value
        case ds.LessThan():
            return value < test.value
        case _:
            return value <= test.value


ON_VALUES = (ds.EqualTo, ds.EqualNullSafe, ds.In, ds.IsNull, ds.IsNotNull, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)


def _column(test: ds.Filter) -> str | None:
    """The column a filter is on, if it is one that ``holds`` can judge exactly."""
    if isinstance(test, ds.Not):
        # "not (a <=> null)" and "not (a is null)" hold otherwise than "not" here says
        return _column(test.child) if isinstance(test.child, (ds.EqualTo, ds.In, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains)) else None
    if not isinstance(test, ON_VALUES) or len(test.attribute) != 1 or isinstance(test, ds.In) and None in test.value:
        return None
    return test.attribute[0]


# The data source


@dataclass
class Files(InputPartition):
    names: list[tuple[str, int]]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.named = [n.strip() for n in options.get("fields", "").split(",") if n.strip()]
        wanted = options.get("payload", "all")
        self.decode = None if wanted == "all" else set(wanted.split(","))
        self.tests: list[ds.Filter] = []
        self.columns = {**FIELDS, **{column_of(n): n for n in self.named}}

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        """Keeps the tests of record types and header fields; Spark goes on with the others."""
        for test in filters:
            if _column(test) in self.columns:
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[Files]:
        """Whole files, the largest first, each put with others up to ``partitionBytes`` of archive."""
        out: list[Files] = []
        room, names = 0, []
        for name, size in sorted(Folder(self.path).archives().items(), key=lambda x: (-x[1], x[0])):
            if names and size > room:
                out.append(Files(names))
                names, room = [], self.most
            elif not names:
                room = self.most
            names.append((name, size))
            room -= size
        return [*out, Files(names)] if names else [Files([])]

    def value(self, fields: dict[str, str], column: str) -> str | None:
        found = fields.get(self.columns[column])
        return found.removeprefix("sha1:") if found is not None and column == "payload_digest" else found

    def keep(self, fields: dict[str, str]) -> bool:
        return all(holds(t, self.value(fields, _column(t))) for t in self.tests)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        folder, rows, held = Folder(self.path), [], 0
        decode = None if self.decode is None else self.decode.__contains__
        for name, size in partition.names:
            with folder.open(name) as file:
                for offset, fields, length, payload in records(file, size, self.keep if self.tests else None, decode):
                    known = [self.value(fields, c) for c in self.columns]
                    rest = [(k, v) for k, v in fields.items() if k not in FIELDS.values()]
                    rows.append((name, offset, *known[: len(FIELDS)], length, rest, payload, *known[len(FIELDS) :]))
                    held += 500 + len(payload or b"")
                    if held >= BATCH_BYTES:
                        yield self.batch(rows)
                        rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * len(FIELDS), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), *[pa.string()] * len(self.named)]
        names = ["file", "offset", *FIELDS, "payload_length", "fields", "payload", *map(column_of, self.named)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceArrowWriter):
    """Each task writes files of its own; only those of tasks that succeeded get into the list that commits the job."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.most, self.level = int(options.get("partitionbytes", PARTITION_BYTES)), int(options.get("level", 6))
        self.packed = options.get("compression", "gzip") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, names, file, room = Folder(self.path), [], None, 0
        pack = (lambda r: member(r, self.level)) if self.packed else bytes
        try:
            for batch in iterator:
                for row in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
                    if file is None or room <= 0:
                        if file is not None:
                            file.close()
                        names.append(f"records-{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                        file, room = folder.open(f"{folder.root}/{names[-1]}", "wb"), self.most
                        file.write(pack(record({"type": "warcinfo", "record_id": f"<urn:uuid:{uuid.uuid4()}>", "payload": b"format: WARC File Format 1.1\r\n"})))
                    data = pack(record(row))
                    file.write(data)
                    room -= len(data)
        finally:
            if file is not None:
                file.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        folder = Folder(self.path)
        old = {f for f in folder.archives()} | {f for f in folder.sizes() if "/_committed-" in f} if self.overwrite else set()
        with folder.open(f"{folder.root}/_committed-{uuid.uuid4().hex}.json", "wb") as file:
            file.write(json.dumps([n for m in messages if m is not None for n in m.files]).encode())
        for name in old:
            folder.remove(name)

    def abort(self, messages: list[Written | None]) -> None:
        folder = Folder(self.path)
        for name in (n for m in messages if m is not None for n in m.files):
            folder.remove(f"{folder.root}/{name}")


class Warc(DataSource):
    """``format("warc")``. Options: path (a file, folder or pattern), partitionBytes; reading: fields (names of header
    fields that become columns and take pushed filters), payload (all, or the record types whose payloads are
    wanted); writing: compression (gzip, one member a record, or none), level."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        named = [n.strip() for n in self.options.get("fields", "").split(",") if n.strip()]
        return ", ".join([PLACE, RECORD, *(f"{column_of(n)} string" for n in named)])

    def reader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer({k.lower(): v for k, v in self.options.items()}, overwrite)


def column_of(field: str) -> str:
    """The column that a header field becomes: X-Page-Id, x_page_id."""
    return re.sub(r"[^a-z0-9]+", "_", field.lower())


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records of archives (see ``Warc``). Turns on Spark's push-down of filters to Python data sources, which is
    off by default."""
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**options).load(path)


def write_warc(records: DataFrame, path: str, **options: str) -> None:
    """Archives of ``records``, which has the columns of RECORD."""
    spark = records.sparkSession
    spark.dataSource.register(Warc)
    columns = [F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in RECORD.split(", ")]
    records.select(*columns).write.format("warc").options(**options).mode("append").save(path)


# Pages


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(" ", page_id.cast("string"), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def page_records(pages: DataFrame, least: int = LEAST_REVISITED) -> DataFrame:
    """``pages`` (page_id, url, html) as records: of equal payloads of ``least`` bytes or more that of the largest
    page_id is a response and the others revisit it, smaller ones are responses all.

    Null html is an empty payload, a null page_id smaller than any other. Rows that repeat both page_id and payload
    share their fate; where all page_ids of equal payloads are null, all are responses. Payloads are equal by
    SHA-256 and length. Largest page_ids are found by sums on the map side; then pages meet theirs in one join,
    whose hot keys adaptive execution splits; small pages go by a key of their own each."""
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    big = F.octet_length("html") >= least
    (key,) = spare(pages, "__key")
    keyed = pages.select("page_id", "url", "html", F.when(big, F.unhex(F.sha2("html", 256))).alias(key))
    top = keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("page_id").alias("__top"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    own = keyed.withColumn(key, F.coalesce(key, F.unhex(F.hex(F.xxhash64("page_id", "url")))))
    found = own.join(top, key, "left")
    revisit = F.coalesce(F.col("__top") > F.coalesce("page_id", F.lit(-(2**63))), F.lit(False)) | (F.col("page_id").isNull() & F.col("__top").isNotNull())
    digest = F.sha1(html)
    pairs = F.map_filter(
        F.create_map(F.lit("X-Page-Id"), F.col("page_id").cast("string"), F.lit("X-Refers-To-Page-Id"), F.when(revisit, F.col("__top")).cast("string")),
        lambda _, v: v.isNotNull(),
    )
    return found.select(
        F.when(revisit, "revisit").otherwise("response").alias("type"),
        _record_id(F.col("page_id"), digest).alias("record_id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.col("url").alias("target_uri"),
        digest.alias("payload_digest"),
        F.when(revisit, _record_id(F.col("__top"), digest)).alias("refers_to"),
        F.octet_length(html).cast("long").alias("payload_length"),
        pairs.alias("fields"),
        F.when(~revisit, html).alias("payload"),
    )


def page_rows(archived: DataFrame) -> DataFrame:
    """One row per page of archives that ``page_records`` made: page_id, payload_bytes, payload_digest, record_type,
    refers_to. Of responses, bytes and digest are of the payload as decoded; revisits have those of their headers.
    A response whose payload is not what its header says raises an error."""
    kept = archived.where(F.col("type").isin("response", "revisit"))
    digest = F.sha1("payload")
    as_told = F.when(digest == F.col("payload_digest"), digest).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), "record_id")))
    return kept.select(
        F.col("x_page_id").cast("long").alias("page_id"),
        F.when(F.col("type") == "response", F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(F.col("type") == "response", as_told).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("x_refers_to_page_id").cast("long").alias("refers_to"),
    )


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """``page_rows`` of archives written for ``pages`` to ``path`` (by default a new folder in the shared checkpoint
    folder) and read back. An empty table gives no rows."""
    spark = pages.sparkSession
    path = path or f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(page_records(pages), path)
    return page_rows(read_warc(spark, path, fields="X-Page-Id,X-Refers-To-Page-Id", payload="response"))
