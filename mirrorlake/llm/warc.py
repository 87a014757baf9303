"""WARC archives as a PySpark Python data source, and page archiving with revisit records.

Reading: ``spark.read.format("warc").load(folder)`` plans partitions of whole files, about
``partition_bytes`` each. Filters on record_type, record_id, target_uri, refers_to and
payload_digest are pushed down: a record's header block is parsed first, and the payload of
a record that a filter rejects is neither inflated nor decoded but skipped. ``payload``
says what becomes of the others: "full" returns the bytes, "digest" checks them against
their digest and returns none, "none" skips them all.

Files are plain or gzip with one member for each record. Members written here carry their
compressed length in the gzip header (the "sl" extra field of the WARC annex), so a reader
can go on to the next one; members without it are inflated to find their end.

Writing: ``df.write.format("warc")`` takes record_type, record_id, target_uri, refers_to,
payload_digest, payload_bytes, payload. Files roll at ``roll_bytes``; every task attempt writes
files of its own, and only those that the commit lists in ``_files.json`` are read, so
failed and repeated attempts leave no records.

Defined results: null html is an empty payload; null url gives no WARC-Target-URI; control
characters in a header value are percent-encoded; rows with null page_id are responses; of
equal payloads all rows that have the smallest page_id are responses.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from mirrorlake.deploy import ship
from mirrorlake.llm.common import new_dir, saved, without

#: Payloads from this size on are stored once.
REVISIT_FROM = 100
#: Repeated payloads up to which their table is broadcast (about 100 bytes a row).
BROADCAST_ROWS = 200_000
SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_COLUMNS = ["record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes"]
_HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_MANIFEST = "_files.json"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


# ---- records --------------------------------------------------------------------------


def _safe(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(row: dict) -> bytes:
    """One WARC/1.1 record; a revisit has no payload."""
    block = b""
    if row["record_type"] == "response":
        payload = row["payload"] or b""
        block = (_HTTP % len(payload)).encode() + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{_safe(row['record_id'])}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {_safe(row['target_uri'])}"] if row["target_uri"] is not None else []),
        *([f"WARC-Refers-To: <{_safe(row['refers_to'])}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if row["refers_to"] is not None else []),
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def _member(f, at: int, size: int):
    """(head, length or None, inflate) of the gzip member at ``at``; ``inflate()`` gives all of its data."""
    f.seek(at)
    start = f.read(min(4096, size - at))
    if start[:3] != b"\x1f\x8b\x08":
        raise ValueError(f"no gzip member at {at}")
    flags, p, length = start[3], 10, None
    if flags & 4:
        n = struct.unpack_from("<H", start, p)[0]
        extra = start[p + 2 : p + 2 + n]
        p += 2 + n
        while len(extra) >= 4:
            kind, m = extra[:2], struct.unpack_from("<H", extra, 2)[0]
            if kind == b"sl" and m == 8:
                length = struct.unpack_from("<I", extra, 4)[0]
            extra = extra[4 + m :]
    for flag in (8, 16):  # file name, comment
        if flags & flag:
            p = start.index(b"\0", p) + 1
    p += 2 * bool(flags & 2)
    z = zlib.decompressobj(-15)
    first = z.decompress(start[p:], 2048)
    at_read = at + len(start)

    def more(out: bytes, enough) -> bytes:
        nonlocal at_read
        f.seek(at_read)
        parts = [out]
        while not z.eof and not enough(out):
            feed = z.unconsumed_tail or f.read(1 << 20)
            if not feed:
                raise ValueError(f"gzip member at {at} is cut short")
            if not z.unconsumed_tail:
                at_read += len(feed)
            out = z.decompress(feed, 1 << 20)
            parts.append(out)
        return b"".join(parts)

    head = first
    while b"\r\n\r\n" not in head and not z.eof:
        grown = more(head, lambda x: b"\r\n\r\n" in x)
        if grown == head:
            break
        head = grown

    def inflate() -> bytes:
        return more(head, lambda _: False)

    def end() -> int:
        inflate()
        return at_read - len(z.unused_data) + 8

    return head, length, inflate, end


def _parse(head: bytes) -> tuple[dict[str, str], int]:
    stop = head.index(b"\r\n\r\n")
    lines = head[:stop].split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    found = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        found[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    return found, stop + 4


def _fields(h: dict[str, str]) -> dict[str, str | None]:
    out = {c: h.get(name) for c, name in _HEADERS.items()}
    for c in ("record_id", "refers_to"):
        out[c] = out[c].strip("<>") if out[c] else None
    kind, _, value = (out["payload_digest"] or "").partition(":")
    out["payload_digest"] = value if kind == "sha256" else out["payload_digest"] or None
    return out


def records(f, size: int, gz: bool, wanted, payloads: bool) -> Iterator[tuple[dict, bytes | None]]:
    """(fields, payload) of the records that ``wanted(fields)`` takes; other payloads are skipped."""
    at = 0
    while at < size:
        if gz:
            head, length, inflate, end = _member(f, at, size)
        else:
            f.seek(at)
            head = f.read(min(2048, size - at))
            while b"\r\n\r\n" not in head:
                grown = f.read(1 << 16)
                if not grown:
                    raise ValueError(f"record at {at} is cut short")
                head += grown
        h, start = _parse(head)
        n = int(h["content-length"])
        fields = _fields(h)
        payload = None
        if wanted(fields):
            if payloads and fields["record_type"] != "revisit":
                if gz:
                    block = inflate()[start : start + n]
                else:
                    f.seek(at + start)
                    block = f.read(n)
                if h.get("content-type", "").startswith("application/http") and n:
                    _, blank, body = block.partition(b"\r\n\r\n")
                    block = body if blank else block  # malformed without: all of it is payload
                payload = block
            own = h.get("x-payload-length")
            fields["payload_bytes"] = int(own) if own is not None else len(payload) if payload is not None else None
            yield fields, payload
        at = (at + length if length else end()) if gz else at + start + n + 4


# ---- the data source ------------------------------------------------------------------


class _Files(InputPartition):
    def __init__(self, names: list[tuple[str, int]]):
        super().__init__(names)
        self.names = names


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "full")
        self.partition_bytes = int(options.get("partition_bytes", 32 << 20))
        self.filters: list[tuple[str, set]] = []
        if self.payload not in ("full", "digest", "none"):
            raise ValueError(f"payload is {self.payload!r}")

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            computed = f.attribute == ("payload_digest",) and self.payload == "digest"
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in _HEADERS and not computed:
                self.filters.append((f.attribute[0], values))
            else:
                yield f

    def partitions(self):
        fs, root = _filesystem(self.path)
        manifest = f"{root}/{_MANIFEST}"
        if fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_stream(manifest) as f:
                found = [tuple(x) for x in json.loads(f.read())]
        else:
            infos = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            found = sorted((i.path.removeprefix(root).lstrip("/"), i.size) for i in infos if i.path.endswith((".warc", ".warc.gz")))
        parts, held = [[]], 0
        for name, size in found:
            if parts[-1] and held + size > self.partition_bytes:
                parts.append([])
                held = 0
            parts[-1].append((name, size))
            held += size
        return [_Files(p) for p in parts]

    def read(self, partition):
        fs, root = _filesystem(self.path)
        wanted = lambda fields: all(fields[c] in v for c, v in self.filters)
        schema = pa.schema([(c, pa.string()) for c in _COLUMNS[:-1]] + [("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0

        def batch():
            out = pa.RecordBatch.from_pylist(rows, schema)
            rows.clear()
            return out

        for name, size in partition.names:
            with fs.open_input_file(f"{root}/{name}") as f:
                for fields, payload in records(f, size, name.endswith(".gz"), wanted, self.payload != "none"):
                    if self.payload == "digest" and fields["record_type"] == "response":
                        got = hashlib.sha256(payload).hexdigest()
                        told = fields["payload_digest"]
                        if (told and ":" not in told and told != got) or fields["payload_bytes"] != len(payload):
                            raise ValueError(f"{name}: payload of {fields['record_id']} does not match its header")
                        fields["payload_digest"] = got
                    rows.append(fields | {"payload": payload if self.payload == "full" else None})
                    held += len(payload or b"")
                    if len(rows) >= 2000 or held > 16 << 20:
                        held = 0
                        yield batch()
        yield batch()


class _Written(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.gz = options["path"], options.get("compression", "gzip") == "gzip"
        self.roll, self.overwrite = int(options.get("roll_bytes", 32 << 20)), overwrite

    def write(self, iterator):
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        f, name, size = None, "", 0
        for batch in iterator:
            for row in batch.to_pylist():
                data = record_bytes(row)
                data = gzip_member(data) if self.gz else data
                if f is None or size + len(data) > self.roll:
                    if f is not None:
                        f.close()
                        files.append((name, size))
                    name, size = f"{uuid.uuid4().hex}.warc" + ".gz" * self.gz, 0
                    f = fs.open_output_stream(f"{root}/{name}", compression=None)
                f.write(data)
                size += len(data)
        if f is not None:
            f.close()
            files.append((name, size))
        return _Written(files)

    def commit(self, messages):
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files = [x for m in messages if m for x in m.files]
        if not self.overwrite and fs.get_file_info(f"{root}/{_MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{root}/{_MANIFEST}") as f:
                files = [*json.loads(f.read()), *files]
        with fs.open_output_stream(f"{root}/{_MANIFEST}.new", compression=None) as f:
            f.write(json.dumps(sorted(map(list, files))).encode())
        fs.move(f"{root}/{_MANIFEST}.new", f"{root}/{_MANIFEST}")

    def abort(self, messages):
        fs, root = _filesystem(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                fs.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# ---- pages ----------------------------------------------------------------------------


def page_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The writer's columns, one record for each page; equal payloads are stored once."""
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("target_uri"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    repeated = saved(
        rows.where(F.col("payload_bytes") >= REVISIT_FROM).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "first"),
        "repeated",
    )
    few = repeated.count() <= BROADCAST_ROWS
    found = rows.join(F.broadcast(repeated) if few else repeated, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id") > F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return found.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"), "target_uri",
        F.when(revisit, urn("first")).alias("refers_to"), "payload_digest", "payload_bytes",
        F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str | None = None, **columns) -> str:
    """Write the pages' records to a folder (a new shared one by default); its path."""
    register(pages.sparkSession)
    path = path or new_dir(pages.sparkSession, "warc")
    page_records(pages, **columns).write.format("warc").mode("append").save(path)
    return path


def read_pages(spark: SparkSession, path: str, *, payload: str = "digest") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload of archived pages."""
    register(spark)
    rows = without(spark.read.format("warc").option("payload", payload).load(path), "page_id")
    number = lambda c: F.expr(f"try_cast(substring({c}, {len('urn:page:') + 1}) AS bigint)")
    return rows.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "target_uri", "payload")
