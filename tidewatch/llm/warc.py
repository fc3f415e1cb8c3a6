"""WARC archives: a deduplicating writer and a salvage reader (operator 8).

Writing: one gzip member a record, one file a task; equal payloads are written once, as the
response of the smallest id, and the others revisit it. A task's file gets a name of
its own, and only files that a finished task reported are read, so a lost executor or a
second attempt leaves no half or double records.

Reading: records stream through a buffer of one chunk, whatever their size. After a failed check
(broken gzip data, a bad header, a wrong length or digest) the reader goes back, looks for the next
gzip member or, in uncompressed archives, the next version line that starts a valid
record, goes on from there, and logs the bytes between as a quarantined gap
(`quarantine` writes that log as a table).

Defined cases: a null html is an empty payload, and equals other empty ones; pages with a null
id are written without one and read back as null: they revisit the smallest id that has their payload, and
are responses where none has; a null url is an empty field; rows that repeat an id and payload are responses
both; a payload of more than `largest` bytes is checked as any other and its size and digest are given, but
not its bytes; a header of more than `header` bytes, and longer than any that was written, is a failed check; an empty table writes no
archive and gives no rows; further columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir

VERSION = b"WARC/1.1"
CHUNK = 1 << 20
#: Compressed bytes handed to the decompressor at once; it copies what lies beyond a member.
PIECE = 1 << 14
#: Bytes of the largest payload that is handed on (a column's value holds at most 2 GB); longer ones are checked only.
LARGEST = 1 << 30
#: Bytes of the longest header that is expected of archives of unknown origin; those of `write` come with the length of their longest one.
HEADER = 1 << 20
#: Schemes of Hadoop's file systems under the names that Arrow knows (fixed values).
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "wasbs": "abfss"}
MARKS = (b"\x1f\x8b\x08", b"WARC/1.")
RECORD = "record_type string, record_id string, uri string, refers_to string, payload binary, payload_digest string, payload_bytes long, archive string, start long, end long, gap string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, whichever of the usual schemes names it."""
    scheme, mark, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme.lower(), scheme)}{mark}{rest}")


def urn(page_id: str | None) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{page_id}>"


def bare(found: str | None) -> str | None:
    """The id in a urn; None if it has none."""
    return None if found in (None, urn(None)) else found.removeprefix("<urn:page:").removesuffix(">")


def record(kind: str, record_id: str | None, uri: str, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """One record, uncompressed."""
    head = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(record_id)}", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Check:
    """Takes the bytes of one record in pieces; ValueError at the first check that fails."""

    def __init__(self, largest: int, header: int):
        self.largest, self.header = largest, header
        self.head, self.tail, self.parts, self.sha = bytearray(), b"", [], hashlib.sha1()
        self.fields: dict | None = None
        self.size = self.left = 0
        self.done = False

    def _start(self, piece: bytes) -> int:
        """Bytes of piece that belong to the header."""
        before = len(self.head)
        self.head += piece[: self.header + 4 - before]
        if not self.head.startswith(b"WARC/1."[: len(self.head)]):
            raise ValueError("no version line")
        end = self.head.find(b"\r\n\r\n", max(0, before - 3))
        if end < 0:
            if len(self.head) >= self.header + 4:
                raise ValueError("no header")
            return len(piece)
        try:
            fields = {k.strip().lower(): v.strip() for k, v in (x.decode().split(":", 1) for x in bytes(self.head[:end]).split(b"\r\n")[1:])}
            self.size = self.left = int(fields["content-length"])
        except (ValueError, KeyError) as e:
            raise ValueError("bad header") from e
        if self.size < 0:
            raise ValueError("bad length")
        self.fields = fields
        return end + 4 - before

    def take(self, piece: bytes) -> int:
        """How many bytes of piece belong to the record."""
        used = self._start(piece) if self.fields is None else 0
        if self.fields is None or self.done:
            return used
        body = piece[used : used + self.left]
        self.sha.update(body)
        if self.size <= self.largest:
            self.parts.append(bytes(body))
        self.left -= len(body)
        used += len(body)
        if not self.left:
            last = bytes(piece[used : used + 4 - len(self.tail)])
            self.tail += last
            used += len(last)
            if not b"\r\n\r\n".startswith(self.tail):
                raise ValueError("wrong length")
            if len(self.tail) == 4:
                self._finish()
        return used

    def _finish(self) -> None:
        digest = self.fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if self.fields.get("warc-type") != "revisit" and digest and base64.b32encode(self.sha.digest()).decode() != digest:
            raise ValueError("wrong digest")
        self.fields |= {"payload": b"".join(self.parts) if self.size <= self.largest else None, "digest": digest, "size": self.size}
        self.done = True


class Source:
    """A seekable stream, of which one chunk is held."""

    def __init__(self, stream):
        self.stream, self.start, self.data = stream, 0, b""
        stream.seek(0, 2)
        self.size = stream.tell()

    def at(self, place: int, least: int = 1) -> memoryview:
        """The bytes held from `place` on: at least `least`, unless the stream ends before."""
        if not self.start <= place <= place + least <= self.start + len(self.data):
            self.stream.seek(place)
            self.start, self.data = place, self.stream.read(CHUNK)
        return memoryview(self.data)[place - self.start :]

    def mark(self, place: int) -> int:
        """The next place that may start a record."""
        while place < self.size:
            held = bytes(self.at(place, 8))
            found = [i for i in map(held.find, MARKS) if i >= 0]
            if found:
                return place + min(found)
            place += max(1, len(held) - 6)
        return self.size


def _one(source: Source, place: int, largest: int, header: int) -> tuple[dict, int]:
    """The record at `place`, compressed or not, and the place after it."""
    check = Check(largest, header)
    if bytes(source.at(place, 3)[:3]) == MARKS[0]:
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            part = source.at(place)[:PIECE]
            if not part:
                raise ValueError("truncated member")
            try:
                out = unpack.decompress(part, CHUNK)
            except zlib.error as e:
                raise ValueError("broken member") from e
            place += len(part) - len(unpack.unconsumed_tail) - len(unpack.unused_data)
            if check.take(out) < len(out):
                raise ValueError("more than a record in a member")
        if not check.done:
            raise ValueError("truncated record")
        return check.fields, place
    while not check.done:
        part = source.at(place)
        if not part or place + check.left > source.size:
            raise ValueError("truncated record")
        place += check.take(part)
    return check.fields, place


def salvage(stream, largest: int = LARGEST, header: int = HEADER) -> Iterator[tuple[dict | None, int, int, str | None]]:
    """(fields, start, end, None) of each valid record, and (None, start, end, reason) of each gap."""
    source, place = Source(stream), 0
    while place < source.size:
        at, found, reason = place, None, None
        while found is None and at < source.size:
            try:
                found, end = _one(source, at, largest, header)
            except ValueError as e:
                reason = reason or str(e)
                at = source.mark(at + 1)
        if at > place:
            yield None, place, at, reason
        if found is not None:
            yield found, at, end, None
            at = end
        place = at


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """pages with the id that each one's payload is written under: refers_to is null for responses."""
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    groups = (
        base.filter(F.octet_length("payload") >= least_bytes).select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size"))
        .groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count_if(F.col("page_id").isNull()).alias("nameless"))
        .filter("first < last or (first is not null and nameless > 0)").select("sha", "size", "first")
    )
    groups = materialize(groups, "payloads")
    long = F.octet_length("payload") >= least_bytes
    joined = base.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload")).join(groups, ["sha", "size"], "left")
    return joined.select("page_id", "url", "payload", F.when(long & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write(plan: DataFrame, folder: str) -> DataFrame:
    """Write one archive a task; the manifest (archive, n_records, longest_header) of what finished tasks wrote."""

    def run(batches):
        name, out, n, longest = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for page, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    system, path = located(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                digest, kind = base32_sha1(payload), "response" if first is None else "revisit"
                held = payload if first is None else b""
                data = record(kind, None if page is None else str(page), "".join((url or "").split()), held, digest, len(payload), None if first is None else str(first))
                out.write(member(data))
                n, longest = n + 1, max(longest, len(data) - len(held))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([longest], pa.int64())], ["archive", "n_records", "longest_header"])

    return materialize(plan.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "archive string, n_records long, longest_header long"), "manifest")


def read(archives: DataFrame, with_payload: bool = True, batch_rows: int = 256, largest: int = LARGEST, header: int = HEADER) -> DataFrame:
    """Records and gaps of the archives (column `archive`: URIs), as RECORD columns; gap holds the reason for a gap's rows.

    Where the archives come with a column longest_header, as in a manifest of `write`, headers of that length are read as well.
    """

    def rows(name: str, header: int) -> Iterator[tuple]:
        system, path = located(name)
        with system.open_input_file(path) as stream:
            for f, start, end, gap in salvage(stream, largest if with_payload else -1, header):
                if f is None:
                    yield None, None, None, None, None, None, None, name, start, end, gap
                else:
                    kind, size = f.get("warc-type"), int(f.get("x-payload-length", f["size"]))
                    yield kind, bare(f.get("warc-record-id")), f.get("warc-target-uri"), bare(f.get("warc-refers-to")), f["payload"] if kind != "revisit" else None, f["digest"], size, name, start, end, None

    kinds = [pa.string()] * 4 + [pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches):
        held = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for name, most in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in rows(name, most):
                    held.append(row)
                    if len(held) == batch_rows:
                        yield pack()
                        held.clear()
        if held:
            yield pack()

    longest = F.greatest(F.lit(header), F.coalesce("longest_header", F.lit(0))) if "longest_header" in archives.columns else F.lit(header)
    files = archives.select("archive", longest.cast("long").alias("most"))
    return files.repartition(max(1, files.count()), "archive").mapInArrow(run, RECORD)


def quarantine(found: DataFrame, folder: str) -> int:
    """Write the gaps of `found` (rows of `read`) as a table of archive, start, end, n_bytes, reason under folder/quarantine; their number."""
    gaps = found.filter("gap is not null").select("archive", "start", "end", (F.col("end") - F.col("start")).alias("n_bytes"), F.col("gap").alias("reason"))
    path = f"{folder}/quarantine"
    gaps.write.mode("append").parquet(path)
    return found.sparkSession.read.schema(gaps.schema).parquet(path).count()


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives where every executor can write."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex[:12]}"
