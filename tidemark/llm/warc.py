"""WARC records in ZIP-packaged archives, and a reader that fetches records by ranges.

An archive is a ZIP file of stored (uncompressed) members: ``archive/data.warc.gz``, each record a
gzip member of its own, ``indexes/index.cdxj`` with each record's offset and length, and a data
package file. The reader parses the end-of-directory record, its ZIP64 form where there is one, and
the central directory; it finds where stored members begin and reads single records by their
ranges within the archive, without extracting it.

Equal payloads of at least ``min_bytes`` bytes are written once, as the response of the largest page
id; the others are revisit records that refer to it and hold no payload.

Archives lie in the shared scratch folder, or wherever ``out_dir`` says, through pyarrow's
filesystems. Each attempt at a task writes names of its own and only the names of attempts that
succeeded reach the manifest, so tasks can be run again.

Defined cases: a null payload counts as empty; a null url is written as ``urn:null``; a null page id
is smaller than any other and read back as null; rows that repeat id and payload are responses or
revisits alike; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import filters
from tidemark.llm.textops import as_bytes, small_batches
from tidemark.session import materialize, scratch_path

#: A new archive is begun beyond so many bytes of records.
ARCHIVE_BYTES = 256 << 20
#: Tasks that archives are read in at most.
MOST_TASKS = 100_000
DATE = "2024-01-01T00:00:00Z"
MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Records whose ranges lie this near are fetched in one read, of at most so many bytes.
GAP, READ_BYTES = 1 << 12, 4 << 20
#: Fixed values of the ZIP format: signatures and the number that means "see the ZIP64 field".
LOCAL, CENTRAL, END, END64, LOCATOR, SEE64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0xFFFFFFFF


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def digest32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _page_urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record; digest and size are those of the full payload, which a revisit doesn't hold."""
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_page_urn(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or 'urn:null').replace(chr(13), '').replace(chr(10), '')}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {_page_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if revisit else http + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class ZipWriter:
    """Stored members, written in one pass with data descriptors; ZIP64 fields where numbers need them."""

    def __init__(self, out):
        self.out, self.at, self.entries = out, 0, []

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> int:
        """Start a member; returns the position of its first byte."""
        self.entry = [name.encode(), self.at, 0, 0]
        # flag 8: sizes follow the data; a ZIP64 field makes the descriptor's sizes 64-bit
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 8 | 0x800, 0, 0, 0x21, 0, SEE64, SEE64, len(self.entry[0]), len(extra)) + self.entry[0] + extra)
        return self.at

    def write(self, data: bytes) -> None:
        self.entry[2] = zlib.crc32(data, self.entry[2])
        self.entry[3] += len(data)
        self.put(data)

    def end(self) -> None:
        self.put(struct.pack("<IIQQ", 0x08074B50, self.entry[2], self.entry[3], self.entry[3]))
        self.entries.append(self.entry)

    def close(self, force64: bool = False) -> None:
        start = self.at
        for name, offset, crc, size in self.entries:
            wide = force64 or max(size, offset) >= SEE64
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if wide else b""
            small = (SEE64, SEE64, SEE64) if wide else (size, size, offset)
            self.put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 8 | 0x800, 0, 0, 0x21, crc, small[0], small[1], len(name), len(extra), 0, 0, 0, 0, small[2]) + name + extra)
        size, n = self.at - start, len(self.entries)
        if force64 or max(start, size) >= SEE64 or n >= 0xFFFF:
            there = self.at
            self.put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
            self.put(struct.pack("<IIQI", LOCATOR, 0, there, 1))
            self.put(struct.pack("<IHHHHIIH", END, 0, 0, 0xFFFF, 0xFFFF, SEE64, SEE64, 0))
        else:
            self.put(struct.pack("<IHHHHIIH", END, 0, 0, n, n, size, start, 0))


@dataclass
class Member:
    name: str
    header: int
    size: int
    packed: int
    method: int
    crc: int


class ZipReader:
    """Directories and ranges of an archive of which only reads at a position are asked."""

    def __init__(self, source):
        self.source, self.length = source, source.size()
        self.members = {m.name: m for m in self._directory()}

    def read(self, at: int, n: int) -> bytes:
        return bytes(self.source.read_at(n, at)) if n else b""

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.length - 65557)  # an end record and the longest comment
        tail = self.read(tail_at, self.length - tail_at)
        end = tail.rfind(struct.pack("<I", END))
        while end >= 0 and end + 22 + (struct.unpack_from("<H", tail, end + 20)[0] if end + 22 <= len(tail) else 1 << 20) != len(tail):
            end = tail.rfind(struct.pack("<I", END), 0, end)
        if end < 0:
            raise ValueError("no end of central directory: this is no ZIP archive")
        _, _, _, _, n, size, start, _ = struct.unpack_from("<IHHHHIIH", tail, end)
        if 0xFFFF == n or SEE64 in (size, start):
            sign, _, there, _ = struct.unpack("<IIQI", self.read(tail_at + end - 20, 20))
            if sign != LOCATOR:
                raise ValueError("ZIP64 locator expected")
            sign, _, _, _, _, _, _, n, size, start = struct.unpack("<IQHHIIQQQQ", self.read(there, 56))
            if sign != END64:
                raise ValueError("ZIP64 end of central directory expected")
        data, at = self.read(start, size), 0
        for _ in range(n):
            f = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, at)
            if f[0] != CENTRAL:
                raise ValueError("central directory entry expected")
            name = data[at + 46 : at + 46 + f[10]].decode()
            extra, packed, whole, header = data[at + 46 + f[10] : at + 46 + f[10] + f[11]], f[8], f[9], f[16]
            while len(extra) >= 4:
                kind, length = struct.unpack_from("<HH", extra)
                if kind == 1:  # 64-bit values, of those fields only that don't fit in 32
                    values = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                    whole = next(values) if whole == SEE64 else whole
                    packed = next(values) if packed == SEE64 else packed
                    header = next(values) if header == SEE64 else header
                extra = extra[4 + length :]
            yield Member(name, header, whole, packed, f[4], f[7])
            at += 46 + f[10] + f[11] + f[12]

    def start_of(self, member: Member) -> int:
        """Where a stored member's bytes begin in the archive."""
        if member.method:
            raise ValueError(f"{member.name} is compressed; ranges need stored members")
        head = self.read(member.header, 30)
        if struct.unpack_from("<I", head)[0] != LOCAL:
            raise ValueError("local header expected")
        return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))

    def range(self, member: Member, offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > member.size:
            raise ValueError("range beyond the member")
        return self.read(self.start_of(member) + offset, length)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and the block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("a WARC record begins with its version")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers, rest[: int(headers["content-length"])]


def write_archives(pages: DataFrame, out_dir: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes the archives; (archive, records, bytes) of each."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html").cast("long")).withColumn("big", F.col("size") >= min_bytes)
    # decided on narrow rows: payloads move only where they may be written, and a copy's never
    narrow = materialize(rows.select("page_id", "url", "sha1", "size", "big"), "pages")
    groups = narrow.filter("big").groupBy("sha1").agg(F.max(F.struct("page_id")).alias("top"), F.count("*").alias("c")).filter("c > 1").drop("c")
    # written, so that the joins below have an exchange on either side and Spark can split a large group
    groups = materialize(groups, "groups")
    bits = filters.bits_for(groups.count())
    group, winner = filters.slot(F.xxhash64("sha1"), bits), filters.slot(F.xxhash64("sha1", "page_id"), bits)
    bitmaps = [filters.bitmap_rows(x.select(s.alias("slot"))) for x, s in ((groups, group), (groups.select("sha1", "top.page_id"), winner))]

    def marked(some: DataFrame) -> DataFrame:
        """Whether a row may be of a group of copies, and the one of it that stays."""
        for name, s, rows_of in (("grouped", group, bitmaps[0]), ("first", winner, bitmaps[1])):
            side = F.broadcast(rows_of.select(F.col("bucket").alias("__b"), F.col("bits").alias("__m")))  # MAX_BITS / 8 bytes at most
            some = some.withColumn("__s", s).join(side, F.bitmap_bucket_number("__s") == F.col("__b"), "left").withColumn(name, F.col("big") & filters.bit_set(F.col("__m"), F.col("__s"))).drop("__b", "__m", "__s")
        return some

    def decided(some: DataFrame) -> DataFrame:
        revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("top").isNotNull(), F.lit(False))
        out = some.join(groups, "sha1", "left").withColumn("revisit", revisit)
        return out.select("page_id", "url", "html", "sha1", "size", F.col("top.page_id").alias("first"), "revisit")

    whole = marked(rows)
    single = whole.filter("NOT grouped").select("page_id", "url", "html", "sha1", "size", F.lit(None).cast("long").alias("first"), F.lit(False).alias("revisit"))
    first = decided(whole.filter("grouped AND first"))
    copies = decided(marked(narrow).filter("grouped AND NOT first").withColumn("html", F.lit("")))
    joined = single.unionByName(first).unionByName(copies)

    def run(batches):
        zipped = sink = None
        done = []

        def finish():
            zipped.end()
            zipped.begin(INDEX)
            for line in index:
                zipped.write(line)
            zipped.end()
            zipped.begin("datapackage.json")
            zipped.write(json.dumps({"profile": "data-package", "resources": [{"path": MEMBER}, {"path": INDEX}]}).encode())
            zipped.end()
            zipped.close()
            sink.close()
            done.append((path, len(index), zipped.at))

        for batch in batches:
            payloads, others = as_bytes(batch.column(2)), (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6))
            for payload, number, target, sha1, size, top, revisit in zip(payloads, *others, strict=True):
                if zipped is None:
                    folder, at = open_fs(out_dir)
                    folder.create_dir(at)
                    path = f"{out_dir}/{uuid.uuid4().hex}.wacz"
                    sink = folder.open_output_stream(open_fs(path)[1])
                    zipped, index = ZipWriter(sink), []
                    begun = zipped.begin(MEMBER)
                digest = digest32(sha1)
                member = gzip_member(record(number, target, payload, size, digest, top, revisit))
                index.append(f"{json.dumps(_page_urn(number))} {json.dumps({'offset': zipped.at - begun, 'length': len(member), 'digest': digest})}\n".encode())
                zipped.write(member)
                if zipped.at >= ARCHIVE_BYTES:
                    finish()
                    zipped = None
        if zipped is not None:
            finish()
        yield pa.RecordBatch.from_pydict({"archive": pa.array([d[0] for d in done], pa.string()), "records": pa.array([d[1] for d in done], pa.int64()), "bytes": pa.array([d[2] for d in done], pa.int64())})

    return materialize(joined.mapInArrow(run, "archive string, records long, bytes long"), "manifest")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the manifest's archives; a revisit's payload is null.

    A record whose payload does not have the digest that its header states raises ValueError.
    """

    def run(batches):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                folder, at = open_fs(path)
                with folder.open_input_file(at) as source:
                    archive = ZipReader(source)
                    data, index = archive.members[MEMBER], archive.members[INDEX]
                    lines = [json.loads(x.split(" ", 1)[1]) for x in archive.range(index, 0, index.size).decode().splitlines()]
                    base = archive.start_of(data)
                    for run_of in _ranges(lines):
                        begin, last = run_of[0]["offset"], run_of[-1]
                        chunk = archive.read(base + begin, last["offset"] + last["length"] - begin)
                        rows = [_row(chunk[x["offset"] - begin : x["offset"] - begin + x["length"]], with_payload) for x in run_of]
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # a number of partitions of its own, or archives would be gathered by the size of their names
    names = manifest.select("archive").repartition(min(MOST_TASKS, 2 * manifest.count() + 1), "archive")
    return names.mapInArrow(run, READ)


def _ranges(lines: list[dict]) -> Iterator[list[dict]]:
    """Index lines in runs that one read fetches."""
    held: list[dict] = []
    for x in sorted(lines, key=lambda x: x["offset"]):
        if held and (x["offset"] - held[-1]["offset"] - held[-1]["length"] > GAP or x["offset"] + x["length"] - held[0]["offset"] > READ_BYTES):
            yield held
            held = []
        held.append(x)
    if held:
        yield held


def _row(member: bytes, with_payload: bool) -> dict:
    headers, block = parse(zlib.decompress(member, 31))
    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
    payload = None if kind == "revisit" else block.partition(b"\r\n\r\n")[2]
    if payload is not None and digest32(hashlib.sha1(payload).hexdigest()) != digest:
        raise ValueError(f"{headers['warc-record-id']}: payload and digest differ")
    return {
        "page_id": _page_of(headers["warc-record-id"]), "url": None if headers["warc-target-uri"] == "urn:null" else headers["warc-target-uri"],
        "payload_bytes": int(headers["warc-payload-length"]) if payload is None else len(payload), "payload_digest": digest, "record_type": kind,
        "refers_to": _page_of(headers["warc-refers-to"]) if "warc-refers-to" in headers else None, "payload": payload if with_payload else None,
    }


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_archives(pages, scratch_path(spark, "warc"))
    return read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = {
    "op5_warc": """
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
    m AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, s, max(page_id) OVER (PARTITION BY s) AS first FROM p),
    bits AS (
      SELECT DISTINCT s, array_to_string([format('{:04b}', instr('0123456789abcdef', substr(s, i, 1)) - 1) FOR i IN range(1, 41)], '') AS b FROM m),
    base AS (
      SELECT s, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        16 * substr(b, 5 * i + 1, 1)::INTEGER + 8 * substr(b, 5 * i + 2, 1)::INTEGER + 4 * substr(b, 5 * i + 3, 1)::INTEGER
        + 2 * substr(b, 5 * i + 4, 1)::INTEGER + substr(b, 5 * i + 5, 1)::INTEGER + 1, 1) FOR i IN range(0, 32)], '') AS d FROM bits)
    SELECT page_id, payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM m JOIN base USING (s)
    """
}
