"""WARC archives as a Spark data source, read and written.

Reading: ``spark.read.format("warc").load(folder)`` plans partitions of whole archive
files, small ones together. A task reads a record's header lines first and decides by
them: filters on ``record_type``, ``target_uri``, ``record_id`` and ``payload_digest``
are pushed down, and a record they rule out is passed over by its length, its payload
neither read nor decoded. Option ``payload``: ``decode`` returns the body, ``verify``
only hashes and measures it, ``skip`` (nothing but headers) never touches it.

Writing: ``df.write.format("warc").mode("append").save(folder)`` takes columns
``record_type, record_id, target_uri, refers_to, payload`` and rolls over to another file
at ``max_file_bytes``. Files get their final names only when the job commits, so a task
that is lost or run twice leaves no records behind.

Paths may be any that ``pyarrow.fs`` opens: a local or shared folder, or an object store.

Defined results: a null payload counts as empty. A revisit has no body; its HTTP header
tells the full payload's length and its digest header the full payload's digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .common import join_by_group, stage_path, staged

READ_SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, digest_ok boolean, payload binary, file string, offset long"
#: Schema columns that name a WARC header.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest"}
#: The profile of a revisit record.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: str | None) -> str:
    """A header value without control characters, which would end the line."""
    return "".join(c if c >= " " else "%{:02X}".format(ord(c)) for c in value or "")


def record(kind: str, name: str, uri: str | None, refers_to: str | None, payload: bytes) -> bytes:
    """One WARC/1.1 record around an HTTP response. A revisit keeps the header alone."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind != "revisit" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {one_line(name)}", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {one_line(uri)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {one_line(refers_to)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines if b":" in line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _header(stream) -> dict[str, str] | None:
    """The named fields up to the blank line; None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    lines = []
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        lines.append(line)
    return _fields(lines)


def records(stream, wanted, mode: str) -> Iterator[tuple]:
    """Rows of an archive; ``stream`` can seek or be read on. Bodies that are not wanted
    are passed over."""
    while True:
        at = stream.tell()
        head = _header(stream)
        if head is None:
            return
        size, start = int(head["content-length"]), stream.tell()
        row = {c: head.get(h.lower()) for c, h in HEADERS.items()}
        row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
        if wanted(row):
            body, length, ok = None, None, None
            if "http" in head.get("content-type", ""):
                http, line = [], b""
                while stream.tell() < start + size and (line := stream.readline()) not in (b"\r\n", b"\n"):
                    http.append(line)
                told = _fields(http[1:]).get("content-length")
                length = int(told) if told is not None else None
            left = start + size - stream.tell()
            if mode != "skip" and row["record_type"] != "revisit":
                body = stream.read(left)
                found = digest_of(body)
                ok, length = found == row["payload_digest"], len(body)
                row["payload_digest"] = found
            yield (row["record_type"], row["record_id"], row["target_uri"], head.get("warc-refers-to"), row["payload_digest"], length, ok, body if mode == "decode" else None, at)
        stream.seek(start + size)


@dataclass
class Archives(InputPartition):
    files: list[str]

    def __init__(self, files: list[str]) -> None:
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.mode = options.get("payload", "decode")
        self.target = int(options.get("max_partition_bytes", 128 << 20))
        self.rules: list[tuple[str, frozenset]] = []
        if self.mode not in ("decode", "verify", "skip"):
            raise ValueError("payload must be decode, verify or skip")

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in HEADERS and not (f.attribute[0] == "payload_digest" and self.mode != "skip"):
                self.rules.append((f.attribute[0], frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, root = file_system(self.path)
        found = [i for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.path.endswith((".warc", ".warc.gz"))]
        parts: list[list[str]] = []
        room = 0
        for info in sorted(found, key=lambda i: (-i.size, i.path)):
            if not parts or info.size > room:
                parts.append([])
                room = self.target
            parts[-1].append(info.path)
            room -= info.size
        return [Archives(p) for p in parts]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rules = list(self.rules)

        def wanted(row: dict) -> bool:
            return all(row[c] in values for c, values in rules)

        system, _ = file_system(self.path)
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in READ_SCHEMA.split(", "))])
        rows: list[tuple] = []
        held = 0
        for path in getattr(partition, "files", []):
            raw = system.open_input_file(path)
            stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(pa.PythonFile(raw, "r") if not hasattr(raw, "readinto") else raw, 1 << 20)
            for *row, at in records(stream, wanted, self.mode):
                rows.append((*row, path, at))
                held += len(row[-1] or b"")
                if len(rows) >= 2000 or held > 8 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                    rows, held = [], 0
            raw.close()
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.most = int(options.get("max_file_bytes", 128 << 20))
        self.packed = options.get("compression", "none") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        files: list[str] = []
        out, size = None, 0
        for batch in iterator:
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in ("record_type", "record_id", "target_uri", "refers_to", "payload")}
            for i in range(batch.num_rows):
                raw = record(*(c[i].as_py() for n, c in columns.items() if n != "payload"), columns["payload"][i].as_py() or b"")
                raw = gzip.compress(raw, 6, mtime=0) if self.packed else raw
                if out is None or size + len(raw) > self.most:
                    if out is not None:
                        out.close()
                    files.append(f"{root}/{uuid.uuid4().hex}.warc{'.gz' * self.packed}.part")
                    out, size = system.open_output_stream(files[-1]), 0
                out.write(raw)
                size += len(raw)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            for f in m.files if isinstance(m, Written) else []:
                system.move(f, f.removesuffix(".part"))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            for f in m.files if isinstance(m, Written) else []:
                system.delete_file(f)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Record rows of pages. Of pages with equal payloads the one with the smallest id is
    the response and the others revisit it. Rows that repeat that id are revisits too,
    but one. A null id is larger than any other; its record refers to its own name."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("target_uri"), payload.alias("payload"))
    # Only keys and ids are shuffled: of equal rows `n` says how many there are.
    ids = rows.select(F.sha1("payload").alias("key"), "page_id").groupBy("key", "page_id").agg(F.count(F.lit(1)).alias("same"))
    groups = ids.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("same").alias("all"), F.min_by("same", F.coalesce("page_id", F.lit((1 << 63) - 1))).alias("of_first"))
    groups = staged(groups.where("all > 1"), "warc-groups")
    rows = rows.withColumn("key", F.sha1("payload"))
    rows = join_by_group(rows, groups, "key", "all")
    first = F.col("all").isNull() | (F.col("page_id").eqNullSafe(F.col("first")) & (F.col("of_first") == 1))
    repeated = F.col("page_id").eqNullSafe(F.col("first")) & (F.col("of_first") > 1)
    lone = rows.where(~F.coalesce(repeated, F.lit(False))).withColumn("lead", first)
    out = lone
    if groups.where("of_first > 1").limit(1).count():
        # Rows that repeat the smallest id: counted, then one copy leads.
        named = rows.where(repeated).groupBy("key", "page_id", "target_uri").agg(F.count(F.lit(1)).alias("c"), F.first("payload").alias("payload"), F.first("first").alias("first"))
        least = named.groupBy("key").agg(F.min(F.struct(F.col("target_uri").isNull().alias("none"), "target_uri")).alias("low"))
        leads = F.col("target_uri").eqNullSafe(F.col("low.target_uri"))
        copies = named.join(least, "key").withColumn("lead", F.explode(F.transform(F.sequence(F.lit(1), F.col("c")), lambda i: (i == 1) & leads)))
        out = lone.select("page_id", "target_uri", "payload", "first", "lead").unionByName(copies.select("page_id", "target_uri", "payload", "first", "lead"))
    return out.select(
        F.when(F.col("lead"), "response").otherwise("revisit").alias("record_type"),
        page_name(F.col("page_id")).alias("record_id"),
        "target_uri",
        F.when(~F.col("lead"), page_name(F.col("first"))).alias("refers_to"),
        "payload",
    )


def page_name(page_id):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def page_of(name):
    return F.expr(f"try_cast(regexp_extract({name}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")


def write_pages(pages: DataFrame, folder: str, **options: str) -> None:
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    plan_records(pages).write.format("warc").options(**options).mode("append").save(folder)


def read_archives(spark, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**options).load(folder)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back with their payloads
    hashed and measured, but not handed on."""
    spark = pages.sparkSession
    folder = stage_path(spark, "archives")
    write_pages(pages, folder)
    back = read_archives(spark, folder, payload="verify")
    return back.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"), "digest_ok")
