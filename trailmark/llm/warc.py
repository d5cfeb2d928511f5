"""WARC archives: written, normalised from whole-file gzip streams, and read back through an offset index.

Spark's text writer makes one archive a task, gzipped as a single stream, so no record of it can be reached
without inflating all before it.  The normaliser inflates each such stream once, a chunk at a time, and writes
every record as a gzip member of its own into a new archive; what it yields, and Spark writes as Parquet
beside the archives, is the sidecar index (archive, offset, length, kind of record).  Readers seek.

A task that is lost is run again under another archive name; the index, which Spark commits, names only
archives that are whole.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, delete, map_arrow, new_folder, parts, settle

#: Payloads of fewer bytes are never replaced by a revisit.
LEAST = 100
#: A digest that holds more than this share of all records is joined by broadcast: at most 1 / SHARE digests do.
SHARE = 0.001
#: Bytes inflated or copied at once; a record is never held whole.
CHUNK = 1 << 20
#: The most bytes of a record's header, or of the HTTP header in its block.
HEAD = 1 << 20
#: Compression of single members; the whole-file streams that precede them are short-lived and packed fast.
LEVEL = 6
#: Bytes of archive that a reading task takes.
SPLIT = 8 << 20

#: Fixed values of the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = "\r\n"

INDEX = "archive string, offset long, length long, record_id string, record_type string, target_uri string, block_bytes long"
_RECORD = (
    "record_id string, record_type string, target_uri string, refers_to_id string, payload_bytes long, payload_digest string, "
    "declared_digest string, payload binary"
)


class WarcError(ValueError):
    """An archive that is cut off, damaged or no WARC."""


# --- deciding what a record is -------------------------------------------------------------------------


def decided(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = LEAST) -> DataFrame:
    """``pages`` with ``_n`` (payload bytes), ``_digest`` (SHA-256, hex) and ``_first``.

    ``_first`` is the smallest ``key`` of the records with the same payload where there are several and the
    payload has ``least`` bytes; else null.  Digests of more than a thousandth of all records are joined by
    broadcast, for there are at most a thousand of them; the rest by broadcast if few, else by shuffling.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.withColumns({"_n": F.octet_length(body).cast("long"), "_digest": F.sha2(body, 256)})
    groups = rows.select(key, "_n", "_digest").where(F.col("_n") >= least).groupBy("_digest")
    repeated = settle(groups.agg(F.min(key).alias("_first"), F.count("*").alias("_copies")).where("_copies > 1"))
    repeated = repeated.withColumnRenamed("_digest", "_of")
    total = repeated.agg(F.sum("_copies")).first()[0] or 0
    often = F.col("_copies") > SHARE * total
    hot = F.broadcast(repeated.where(often).select("_of", F.col("_first").alias("_hot")))  # at most 1 / SHARE rows
    rest = bounded(repeated.where(~often).select("_of", "_first"))
    out = rows.join(hot, rows["_digest"] == hot["_of"], "left").drop("_of")
    # a hot digest has no partner in the rest: it goes by a key of its own, so that its rows do not meet in one task
    by = F.when(F.col("_hot").isNull() & (F.col("_n") >= least), F.col("_digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    out = out.withColumn("_by", by)
    out = out.join(rest, out["_by"] == rest["_of"], "left").drop("_of", "_by")
    return out.withColumn("_first", F.coalesce("_hot", "_first")).drop("_hot")


def record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">"))


def _uri(uri: Column) -> Column:
    """A URI fit for a header line: control characters are percent-encoded."""
    for code in (13, 10, 0):
        uri = F.replace(uri, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return uri


def records(pages: DataFrame, key: str = "page_id", payload: str = "html", uri: str = "url", least: int = LEAST,
            date: str = "2024-01-01T00:00:00Z", kind: str = "text/html; charset=utf-8") -> DataFrame:
    """(record): the WARC record of every row but for its last line feed, which the writer adds; a revisit's block is its
    HTTP header alone."""
    rows = decided(pages.select(key, payload, uri), key, payload, least)
    revisit = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col(key))
    body = F.coalesce(F.col(payload), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: {kind}{_EOL}Content-Length: "), F.col("_n").cast("string"), F.lit(_EOL * 2))
    header = F.concat(
        F.lit(f"{VERSION}{_EOL}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{_EOL}WARC-Record-ID: "), record_id(F.col(key)), F.lit(f"{_EOL}WARC-Date: {date}"),
        F.when(F.col(uri).isNotNull(), F.concat(F.lit(f"{_EOL}WARC-Target-URI: "), _uri(F.col(uri)))).otherwise(""),
        F.lit(f"{_EOL}WARC-Payload-Digest: sha256:"), F.col("_digest"),
        F.when(revisit, F.concat(F.lit(f"{_EOL}WARC-Profile: {SAME_PAYLOAD}{_EOL}WARC-Refers-To: "), record_id(F.col("_first")))).otherwise(""),
        F.lit(f"{_EOL}Content-Type: application/http; msgtype=response{_EOL}Content-Length: "),
        (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("_n"))).cast("string"), F.lit(_EOL * 2),
    )
    return rows.select(F.concat(header, http, F.when(revisit, "").otherwise(body), F.lit("\r\n\r")).alias("record"))


def write(made: DataFrame, to: str) -> None:
    """Archives of ``made`` records in folder ``to``, each a single gzip stream, as crawlers that compress whole files leave them."""
    text = made.select(F.col("record").alias("value"))
    text.write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(to)


# --- reading streams of records -----------------------------------------------------------------------


def opened(at: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and path of a file or folder of the shared store."""
    if ":" not in at.split("/", 1)[0]:
        return pafs.LocalFileSystem(), at
    scheme, rest = at.split(":", 1)
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(at)


def inflated(source) -> Iterator[bytes]:
    """The bytes of a stream, CHUNK at most at once: of one gzip member or many, or as they are if not gzipped."""
    first = source.read(CHUNK)
    if first[:2] != b"\x1f\x8b":
        while first:
            yield first
            first = source.read(CHUNK)
        return
    member, waiting = zlib.decompressobj(31), first
    while waiting or not member.eof:
        if member.eof:
            if not waiting.strip(b"\0"):  # padding behind the last member
                return
            member = zlib.decompressobj(31)
        if not waiting:
            waiting = source.read(CHUNK)
            if not waiting:
                raise WarcError("the gzip stream ends early")
        try:
            out = member.decompress(waiting, CHUNK)
        except zlib.error as e:
            raise WarcError(f"damaged gzip stream: {e}") from e
        waiting = member.unused_data if member.eof else member.unconsumed_tail
        if out:
            yield out
        if member.eof and not waiting:
            waiting = source.read(CHUNK)


class Stream:
    """Lines and counted blocks from an iterator of byte chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.at = chunks, b"", 0

    def more(self) -> bool:
        got = next(self.chunks, b"")
        self.held, self.at = self.held[self.at :] + got, 0
        return bool(got)

    def head(self) -> bytes | None:
        """Up to and with the next empty line; None at the end.  Blank lines between records are skipped."""
        while True:
            while self.held[self.at : self.at + 1] in (b"\r", b"\n"):
                self.at += 1
            if self.at < len(self.held):
                break
            if not self.more():
                return None
        while True:
            size, at = 4, self.held.find(b"\r\n\r\n", self.at, self.at + HEAD)
            bare = self.held.find(b"\n\n", self.at, at if at >= 0 else self.at + HEAD)
            if bare >= 0:
                size, at = 2, bare
            if at >= 0:
                out, self.at = self.held[self.at : at + size], at + size
                return out
            if len(self.held) - self.at >= HEAD or not self.more():
                raise WarcError("a header without an end")

    def block(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes, in chunks."""
        while size:
            if self.at == len(self.held) and not self.more():
                raise WarcError("a record ends early")
            out = self.held[self.at : self.at + size]
            self.at += len(out)
            size -= len(out)
            yield out


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; continued lines are joined, the first of a repeated name stays."""
    first, *lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    if not first.startswith("WARC/"):
        raise WarcError(f"no WARC record: {first[:40]!r}")
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out.setdefault(last, value.strip())
    if not out.get("content-length", "").isdigit():
        raise WarcError("a record without Content-Length")
    return out


# --- normalising ------------------------------------------------------------------------------------------


def rewrite(source, sink, level: int = LEVEL) -> Iterator[tuple]:
    """Copies every record of ``source`` to ``sink`` as one gzip member; yields (offset, length, id, type, URI, block bytes)."""
    stream, at = Stream(inflated(source)), 0
    while (head := stream.head()) is not None:
        said = fields(head)
        size = int(said["content-length"])
        member = zlib.compressobj(level, zlib.DEFLATED, 31)
        start = at
        for piece in _framed(head, stream.block(size)):
            packed = member.compress(piece)
            at += len(packed)
            sink.write(packed)
        packed = member.flush()
        at += len(packed)
        sink.write(packed)
        yield start, at - start, said.get("warc-record-id"), said.get("warc-type"), said.get("warc-target-uri"), size


def _framed(head: bytes, block: Iterator[bytes]) -> Iterator[bytes]:
    yield head
    yield from block
    yield b"\r\n\r\n"


def normalise(spark: SparkSession, path: str, to: str, level: int = LEVEL) -> DataFrame:
    """Rewrites all archives below ``path`` into ``to``/archives and their index into ``to``/index; returns the index.

    Archives may be one gzip stream, a member a record already, or not compressed.  A damaged one fails the job
    with its name.  Empty archives give no rows.  Columns: archive, offset, length, record_id, record_type,
    target_uri, block_bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    folder = f"{to}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, at = opened(folder)
        store.create_dir(at, recursive=True)
        attempt, n = TaskContext.get().taskAttemptId(), 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                mine, n = f"{attempt:08d}-{n:05d}.warc.gz", n + 1
                yield from _indexed(name, f"{folder}/{mine}", store, f"{at}/{mine}", level)

    index = map_arrow(files, run, INDEX)
    index.write.mode("overwrite").parquet(f"{to}/index")
    return spark.read.schema(index.schema).parquet(f"{to}/index")


def _indexed(name: str, archive: str, store, at: str, level: int) -> Iterator[pa.RecordBatch]:
    source_store, source_at = opened(name)
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    names = ["archive", "offset", "length", "record_id", "record_type", "target_uri", "block_bytes"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows: list[tuple] = []
    with source_store.open_input_stream(source_at, compression=None) as source, store.open_output_stream(at, compression=None) as sink:
        try:
            for row in rewrite(source, sink, level):
                rows.append((archive, *row))
                if len(rows) == 10_000:
                    yield batch(rows)
                    rows = []
        except WarcError as e:
            raise WarcError(f"{name}: {e}") from e
    if rows:
        yield batch(rows)


# --- reading through the index ------------------------------------------------------------------------


@dataclass
class Payload:
    """An HTTP block as it streams by: its declared length, and the digest, size and (if kept) bytes of its payload."""

    keep: bool
    head: bytes | None = b""
    declared: int | None = None
    size: int = 0
    digest: object = field(default_factory=hashlib.sha256)
    kept: list[bytes] = field(default_factory=list)

    def take(self, piece: bytes) -> None:
        if self.head is not None:
            piece, self.head = self.head + piece, None
            at = piece.find(b"\r\n\r\n", 0, HEAD)
            if at < 0 and len(piece) < HEAD:
                self.head = piece
                return
            if at >= 0:
                for line in piece[:at].split(b"\r\n")[1:]:
                    name, _, value = line.partition(b":")
                    if name.strip().lower() == b"content-length" and value.strip().isdigit():
                        self.declared = int(value)
                piece = piece[at + 4 :]
        self.size += len(piece)
        self.digest.update(piece)
        if self.keep:
            self.kept.append(piece)

    def end(self) -> None:
        """A block without the end of an HTTP header is payload as a whole."""
        if self.head:
            held, self.head = self.head, None
            self.take(held)


def member(packed, keep: bool) -> tuple:
    """One record of a member: _RECORD's fields in order."""
    stream = Stream(inflated(packed))
    head = stream.head()
    if head is None:
        raise WarcError("an empty member")
    said = fields(head)
    http = said.get("content-type", "").startswith("application/http")
    body = Payload(keep, b"" if http else None)
    for piece in stream.block(int(said["content-length"])):
        body.take(piece)
    body.end()
    declared = said.get("warc-payload-digest", "").removeprefix("sha256:") or None
    kind = said.get("warc-type")
    revisit = kind == "revisit"
    return (
        said.get("warc-record-id"), kind, said.get("warc-target-uri"), said.get("warc-refers-to"), body.declared if revisit else body.size,
        declared if revisit else body.digest.hexdigest(), declared, b"".join(body.kept) if keep and not revisit else None,
    )


def read(index: DataFrame, payloads: bool = False, split: int = SPLIT) -> DataFrame:
    """Every record that ``index`` names, read at its offset: record_id, record_type, target_uri, refers_to_id,
    payload_bytes, payload_digest (of the bytes read; for a revisit, of the payload it stands for), declared_digest
    and, if asked for, ``payload`` (null for revisits).

    Tasks take ranges of one archive after another, about ``split`` bytes each.
    """
    spark = index.sparkSession
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(-(-total // split), parts(spark, 64)))
    rows = index.select("archive", "offset", "length").repartitionByRange(int(tasks), "archive", "offset").sortWithinPartitions("archive", "offset")
    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in _RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), types, strict=True)], names)

        now = None
        for batch in batches:
            out, held = [], 0
            for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if now is None or archive != now.archive:
                    now = Members(archive)
                out.append(now.record(offset, length, payloads))
                held += len(out[-1][-1] or b"") + 500
                if held > CHUNK:
                    yield made(out)
                    out, held = [], 0
            if out:
                yield made(out)

    found = map_arrow(rows, run, _RECORD)
    return found if payloads else found.drop("payload")


class Members:
    """The members of one archive, read in order: small ones from a buffer of CHUNK bytes, larger ones as streams."""

    def __init__(self, archive: str):
        self.archive = archive
        store, at = opened(archive)
        self.file = store.open_input_file(at)
        self.start, self.buffer = 0, b""

    def record(self, offset: int, length: int, keep: bool) -> tuple:
        try:
            return member(self._part(offset, length), keep)
        except WarcError as e:
            raise WarcError(f"{self.archive} at {offset}: {e}") from e

    def _part(self, offset: int, length: int):
        if length > CHUNK:
            self.file.seek(offset)
            return _Part(self.file, length)
        if not self.start <= offset <= offset + length <= self.start + len(self.buffer):
            self.file.seek(offset)
            self.start, self.buffer = offset, self.file.read(CHUNK)
        return io.BytesIO(self.buffer[offset - self.start : offset - self.start + length])


class _Part:
    """The next ``left`` bytes of a file, as a stream."""

    def __init__(self, file, left: int):
        self.file, self.left = file, left

    def read(self, n: int) -> bytes:
        got = self.file.read(min(n, self.left))
        self.left -= len(got)
        return got


def archive(pages: DataFrame, to: str | None = None, key: str = "page_id", payload: str = "html", uri: str = "url", least: int = LEAST) -> DataFrame:
    """Writes ``pages`` as WARC records, normalises the archives into ``to`` (else a new shared folder), returns their index.

    The whole-file streams are removed once the normalised archives are written.
    """
    spark = pages.sparkSession
    to = to or new_folder(spark, "warc")
    raw = new_folder(spark, "warc-streams")
    write(records(pages, key, payload, uri, least), raw)
    index = normalise(spark, raw, to)
    delete(spark, raw)
    return index


def payload_digest(pages: DataFrame, to: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as read back from its archive.

    A null html is an empty payload.  Of equal payloads of LEAST bytes or more the smallest page_id is the response:
    rows repeated with that page_id are all responses, a null page_id comes after all others, and rows
    of the same payload without any page_id are all responses.  A null url has no target header.
    An empty table gives no rows.  Other columns, whatever their names, are left behind.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    found = read(archive(pages, to))
    of = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:record:(.*)>$", 1), F.lit("null")).cast(kind)
    return found.select(
        of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", of("refers_to_id")).alias("refers_to"),
    )
