"""Web archives (WARC 1.1) as a data source: one gzip member per record, read as a stream.

A writing task puts its records in archives of bounded size below a temporary folder; the commit moves them to their places
and an abort deletes them, so neither a failed task nor its second attempt leaves anything behind.  A reading task takes one
archive and holds no more of it than a chunk: members are decompressed step by step, a record's block ends where its
Content-Length says and where its member ends too, and block and payload are held against their SHA-1 digests on the way.

Files are opened through ``pyarrow.fs``, so a path may be on any store that it knows, given as an absolute path or a URI.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import posixpath
import time
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from orogena.llm.common import filter_bits, in_small_batches, key_filter, new_path, stash, through_filter

#: Bytes read and decompressed at a time; of a header at most; of an archive about; of payloads in a batch that is read, about.
CHUNK, MOST_HEADER, ROLL, BATCH_BYTES = 1 << 18, 1 << 16, 64 << 20, 8 << 20
SUFFIX = ".warc.gz"
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = "record_id string, type string, target string, row_key string, refers_to string, payload_bytes long, payload_digest string, payload binary, archive string, record_no long"


class BrokenRecord(ValueError):
    """An archive that isn't what its own lengths and digests say."""


def _sha1(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _line(value: str) -> str:
    """A header's value on one line of ASCII."""
    return urllib.parse.quote(value, safe="%/:?#[]@!$&'()*+,;=-._~ <>")


def record(kind: str, record_id: str, block: bytes, headers: dict[str, str | None]) -> bytes:
    """A record as a gzip member of its own."""
    lines = {"WARC-Type": kind, "WARC-Record-ID": record_id, **headers, "WARC-Block-Digest": _sha1(hashlib.sha1(block).digest()), "Content-Length": str(len(block))}
    head = VERSION + "\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in lines.items() if v is not None) + "\r\n"
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(head.encode("ascii")) + packed.compress(block) + packed.compress(b"\r\n\r\n") + packed.flush()


def page_record(row: dict, date: str) -> bytes:
    """The record of (record_id, type, target, row_key, refers_to, payload, payload_digest, payload_bytes); a revisit has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    revisit = row["type"] == "revisit"
    headers = {
        "WARC-Date": date,
        "WARC-Target-URI": row["target"],
        "Row-Key": row["row_key"],
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": row["refers_to"] if revisit else None,
        "WARC-Payload-Digest": _sha1(bytes.fromhex(row["payload_digest"])),
        "Content-Type": "application/http; msgtype=response",
    }
    return record(row["type"], row["record_id"], http if revisit else http + (row["payload"] or b""), headers)


class Members:
    """The gzip members of a stream, one after another; of the open one, bytes are taken as they are decompressed."""

    def __init__(self, read: Callable[[int], bytes]):
        self._read, self._raw, self._out, self._inflate = read, b"", b"", None

    def next(self) -> bool:
        """Open the next member; False at the end of the stream."""
        self._raw = self._raw or self._read(CHUNK)
        self._inflate, self._out = zlib.decompressobj(31), b""
        return bool(self._raw)

    def _more(self) -> bool:
        if self._inflate.eof:
            return False
        self._raw = self._raw or self._read(CHUNK)
        if not self._raw:
            raise BrokenRecord("the archive ends within a member")
        try:
            self._out += self._inflate.decompress(self._raw, CHUNK)
        except zlib.error as e:
            raise BrokenRecord(f"not a gzip member: {e}") from e
        self._raw = self._inflate.unused_data if self._inflate.eof else self._inflate.unconsumed_tail
        return True

    def take(self, most: int) -> bytes:
        """The next bytes of the member, at most so many; none at its end."""
        while not self._out and self._more():
            pass
        out, self._out = self._out[:most], self._out[most:]
        return out

    def until(self, mark: bytes, most: int) -> bytes:
        """The bytes up to a mark, which is taken too."""
        while (at := self._out.find(mark)) < 0:
            if len(self._out) > most or not self._more():
                raise BrokenRecord("a header has no end")
        out, self._out = self._out[:at], self._out[at + len(mark) :]
        return out


def _headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise BrokenRecord(f"not a header: {line[:80]}")
        out[name.strip().lower()] = value.strip()
    return out


def _checked(what: str, told: str | None, found: bytes) -> None:
    if told and told.lower().startswith("sha1:") and told[5:].upper() != _sha1(found)[5:]:
        raise BrokenRecord(f"{what}: {told} is told, {_sha1(found)} is found")


def read_record(members: Members, with_payload: bool) -> dict:
    """The record in the open member, held against its lengths and digests."""
    head = members.until(b"\r\n\r\n", MOST_HEADER)
    if not head.startswith(b"WARC/1."):
        raise BrokenRecord("a member doesn't begin with a record")
    told = _headers(head)
    try:
        left = int(told["content-length"])
    except (KeyError, ValueError) as e:
        raise BrokenRecord("a record without Content-Length") from e
    block, payload, size, kept, http = hashlib.sha1(), hashlib.sha1(), 0, [], b""
    in_http = told.get("content-type", "").startswith("application/http")
    while left:
        part = members.take(min(left, CHUNK))
        if not part:
            raise BrokenRecord("a block is shorter than its Content-Length")
        left -= len(part)
        block.update(part)
        if in_http:
            http += part
            at = http.find(b"\r\n\r\n")
            if at < 0:
                if len(http) > MOST_HEADER:
                    raise BrokenRecord("an HTTP header has no end")
                continue
            part, in_http = http[at + 4 :], False
        payload.update(part)
        size += len(part)
        if with_payload:
            kept.append(part)
    if members.take(5) + members.take(5) != b"\r\n\r\n" or members.take(1):
        raise BrokenRecord("a block is longer than its Content-Length")
    _checked("block", told.get("warc-block-digest"), block.digest())
    kind, own = told.get("warc-type"), told.get("warc-payload-digest")
    if kind == "revisit":  # its payload, and so its digest, is another record's
        size, digest = None, base64.b32decode(own[5:].upper()).hex() if own and own.lower().startswith("sha1:") else None
    else:
        _checked("payload", own, payload.digest())
        digest = payload.hexdigest()
    target = told.get("warc-target-uri")
    return {
        "record_id": told.get("warc-record-id"),
        "type": kind,
        "target": target,
        "row_key": told.get("row-key"),
        "refers_to": told.get("warc-refers-to"),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": b"".join(kept) if with_payload and kind != "revisit" else None,
    }


def records(read: Callable[[int], bytes], with_payload: bool = True) -> Iterator[dict]:
    """The records of an archive, in order."""
    members = Members(read)
    while members.next():
        yield read_record(members, with_payload)


@dataclass
class Archive(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    """Archives of a folder, or one archive: a task each."""

    def __init__(self, path: str, with_payload: bool):
        self.path, self.with_payload = path, with_payload

    def partitions(self) -> list[Archive]:
        store, path = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            return [Archive(path)]
        found = store.get_file_info(fs.FileSelector(path, recursive=False))
        # an empty folder is an empty table, which Spark wants as one task
        return [Archive(x.path) for x in sorted(found, key=lambda x: x.path) if x.base_name.endswith(SUFFIX) and x.base_name[0] not in "._"] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        with store.open_input_stream(partition.path, compression=None) as f:
            for k, row in enumerate(records(f.read, self.with_payload)):
                rows.append(row | {"archive": posixpath.basename(partition.path), "record_no": k})
                size += len(row["payload"] or b"") + 512
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


ARROW = pa.schema(
    [(c, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[kind]) for c, kind in (x.split() for x in SCHEMA.split(", "))]
)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Archives of rows with the columns of :func:`page_record`."""

    def __init__(self, path: str, overwrite: bool, date: str, roll: int):
        self.path, self.overwrite, self.date, self.roll = path, overwrite, date, roll
        self.job = uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str, str]:
        store, path = fs.FileSystem.from_uri(self.path)
        return store, path, f"{path}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, _, held = self._store()
        store.create_dir(held, recursive=True)
        names, out = [], None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or out.tell() > self.roll:
                        if out is not None:
                            out.close()
                        names.append(f"{self.job[:12]}-{task.partitionId():05d}-{task.taskAttemptId():08d}-{len(names):04d}{SUFFIX}")
                        out = store.open_output_stream(f"{held}/{names[-1]}", compression=None)
                        info = b"software: orogena\r\nformat: WARC File Format 1.1\r\n"
                        out.write(record("warcinfo", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, names[-1])}>", info, {"WARC-Date": self.date, "WARC-Filename": names[-1], "Content-Type": "application/warc-fields"}))
                    out.write(page_record(row, self.date))
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, path, held = self._store()
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if x.base_name.endswith(SUFFIX):
                    store.delete_file(x.path)
        store.create_dir(path, recursive=True)
        for m in messages:
            for name in m.names if m else []:
                store.move(f"{held}/{name}", f"{path}/{name}")
        self._clear()

    def _clear(self) -> None:
        store, _, held = self._store()
        if store.get_file_info(held).type == fs.FileType.Directory:
            store.delete_dir(held)

    def abort(self, messages: list[Written | None]) -> None:
        for _ in range(8):  # other tasks may still be writing for a moment
            with contextlib.suppress(OSError):
                self._clear()
            time.sleep(0.25)


class WarcDataSource(DataSource):
    """``format("warc")``: a folder of archives.  Options: payload (true: read payloads too), date and roll (when writing)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, self.options.get("date", "2000-01-01T00:00:00Z"), int(self.options.get("roll", str(ROLL))))


def _record_id(key: Column, digest: Column) -> Column:
    name = F.md5(F.concat(F.coalesce(key, F.lit("")), F.lit(" "), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def page_records(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The rows of ``pages`` as records to write: record_id, type, target, row_key, refers_to, payload, payload_digest, payload_bytes.

    Of rows with equal payloads of at least ``least`` bytes (by SHA-1 and length) that with the largest id is the response, the others
    are revisits of it and carry no payload.  A null html is an empty payload.  A null id is smaller than any; rows of a group that
    repeat the largest id, or have nulls alone, are all responses.  Repeated rows have records with the same id; an empty table has no records.
    """
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target"), html.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    facts = rows.where(F.col("payload_bytes") >= least).select("id", "payload_digest", "payload_bytes")
    group = ["payload_digest", "payload_bytes"]
    several = facts.groupBy(*group).agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL")
    several = stash(several.select(F.col("payload_digest").alias("shared"), F.col("payload_bytes").alias("size"), "last"), "shared")
    bits = filter_bits(several.count())
    filt = stash(key_filter(several, "shared", bits), "filter")
    columns = ["record_id", "type", "target", "row_key", "refers_to", "payload", *group]
    key = F.col("id").cast("string")
    named = rows.withColumn("row_key", key).withColumn("record_id", _record_id(key, F.col("payload_digest")))
    maybe = through_filter(named, named["payload_digest"], filt, bits)
    same = (maybe["payload_digest"] == several["shared"]) & (maybe["payload_bytes"] == several["size"])
    later = F.col("last").isNotNull() & F.coalesce(F.col("id") < F.col("last"), F.lit(True))
    lead = _record_id(F.col("last").cast("string"), F.col("payload_digest"))
    met = maybe.join(several, same, "left").withColumn("type", F.when(later, "revisit").otherwise("response"))
    met = met.withColumn("refers_to", F.when(later, lead)).withColumn("payload", F.when(~later, F.col("payload")))
    # rows that the filter rules out have payloads of their own and aren't shuffled
    alone = through_filter(named, named["payload_digest"], filt, bits, within=False)
    alone = alone.withColumn("type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("string"))
    return alone.select(*columns).unionByName(met.select(*columns))


def write_warc(records: DataFrame, path: str, **options: str) -> None:
    """Write rows of :func:`page_records` as archives below ``path``, in addition to those that are there."""
    in_small_batches(records)
    records.sparkSession.dataSource.register(WarcDataSource)
    # rows come as the source reads them, whole payloads with them
    records.write.format("warc").options(**options).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive or of a folder of archives, each held against its lengths and digests; see ``SCHEMA``."""
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_outcomes(records: DataFrame) -> DataFrame:
    """From records read back: page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit has its response's payload.

    A revisit whose response isn't among the records, or has another digest, fails the job.
    """
    own = records.where("type IN ('response', 'revisit')").select("record_id", "type", F.col("row_key").cast("long").alias("page_id"), F.col("refers_to").alias("lead"), "payload_bytes", "payload_digest")
    heads = own.where("type = 'revisit'").select(F.col("lead").alias("record_id")).distinct()
    leads = own.where("type = 'response'").drop("lead").join(heads, "record_id", "left_semi").groupBy(F.col("record_id").alias("lead"))
    leads = stash(leads.agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("size"), F.max("payload_digest").alias("digest")), "leads")
    told = own.join(leads, "lead", "left")
    torn = (F.col("type") == "revisit") & ~F.coalesce(F.col("digest") == F.col("payload_digest"), F.lit(False))
    size = F.when(torn, F.raise_error(F.concat(F.lit("no payload for the revisit "), F.col("record_id"))).cast("long")).otherwise(F.coalesce("payload_bytes", "size"))
    return told.select("page_id", size.alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), "refers_to")


def warc_round_trip(pages: DataFrame, least: int = 1000, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row of ``pages``, read the archives back and return a row per page; see the functions above."""
    spark = pages.sparkSession
    path = path or new_path(spark, "archives")
    write_warc(page_records(pages, least, id_col, url_col, html_col), path)
    return page_outcomes(stash(read_warc(spark, path, payload=False).drop("payload"), "records"))
