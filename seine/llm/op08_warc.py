"""WARC: a writer that replaces repeated payloads by revisit records, and a salvage reader.

The reader takes standard archives, plain or of gzip members that hold any number of records, and records of all types.
It checks each record: the gzip member's checksum, the version line, the lengths, the closing blank lines and, where the
head names one in an algorithm that is known (sha1, sha256, sha512, md5; hexadecimal or base32), the block digest and
the payload digest. Where a check fails it looks for the next place that holds a valid record (a gzip member that starts
with a version line, or a version line at a line's start; both are searched for everywhere), goes on from there, and
logs the bytes between as a gap row. A record that is whole but whose digest is wrong is logged as a gap too, and the
reader goes on behind it. Offsets are those of the file; records of one member share them.

Writing: digests of payloads that occur more than once are counted first (with partial sums, so one very common
payload is no hot group), written as a table, and joined back by an exchange at every size, which adaptive execution may
split. Each task writes shards of bounded size under the shared folder, whole or not at all.

Defined results: null html counts as the empty payload; a null url gives a record without a target; rows without an
id are responses and nobody's original; rows that repeat both id and payload have the same type; payloads under 100
bytes are always responses; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import mmap
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.llm.common import Workspace, create, opened, table

LEAST = 100
SHARD = 64 << 20
DATE = "2024-01-01T00:00:00Z"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_BASE = uuid.UUID(int=0)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_BASE, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One record, not compressed. A revisit keeps the HTTP head (with the full length) and leaves the payload out."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        head.append(("WARC-Page-ID", str(page_id)))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    else:
        block += payload
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "replace")
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member of its own, the same bytes at every run."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Bad(ValueError):
    pass


#: Digest algorithms by the names that heads give them.
ALGORITHMS = {"md5": 16, "sha1": 20, "sha-1": 20, "sha256": 32, "sha-256": 32, "sha512": 64, "sha-512": 64}


def agrees(label: str | None, data: bytes) -> bool:
    """Whether data has the digest that a head names; true where there is none, or its algorithm or form is not known."""
    name, colon, value = (label or "").partition(":")
    size = ALGORITHMS.get(name.strip().lower())
    if not colon or size is None:
        return True
    value = value.strip()
    own = hashlib.new(name.strip().lower().replace("-", ""), data).digest()
    if len(value) == 2 * size:
        return value.lower() == own.hex()
    if len(value.rstrip("=")) == -(-8 * size // 5):
        return value.rstrip("=").upper() == base64.b32encode(own).decode().rstrip("=")
    return True


def parsed(data: bytes, at: int) -> tuple[dict, int]:
    """The record at an offset and where it ends; Bad if a check fails."""
    if not (m := _VERSION_LINE.match(data, at)):
        raise Bad("no version line")
    stop = data.find(b"\r\n\r\n", m.end() - 2)
    if stop < 0:
        raise Bad("the head does not end")
    head, last = {}, None
    for line in data[m.end() : stop].split(b"\r\n") if stop >= m.end() else []:
        name, colon, value = line.partition(b":")
        if line[:1] in (b" ", b"\t") and last:  # a folded line goes on with the value before
            head[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        if not colon:
            raise Bad("a head line has no colon")
        last = name.strip().lower().decode("utf-8", "replace")
        head[last] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit():
        raise Bad("no content length")
    start = stop + 4
    end = start + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Bad("the record does not end where its length says")
    block, kind = data[start:end], head.get("warc-type")
    if not kind:
        raise Bad("no type")
    payload, n = block, None
    if head.get("content-type", "").lower().startswith("application/http") and head.get("warc-segment-number", "1") == "1":
        http, blank, rest = block.partition(b"\r\n\r\n")
        if blank:
            payload, n = rest, re.search(rb"(?i)^content-length:[ \t]*(\d+)", http, re.M)
    digest = head.get("warc-payload-digest")
    if not agrees(head.get("warc-block-digest"), block) or (kind != "revisit" and not agrees(digest, payload)):
        raise Bad(f"digest\0{end + 4}")
    size, payload = (int(n[1]) if n else None, b"") if kind == "revisit" else (len(payload), payload)
    as_int = lambda k: int(head[k]) if re.fullmatch(r"-?\d+", head.get(k, "")) else None
    return {"page_id": as_int("warc-page-id"), "url": head.get("warc-target-uri"), "record_type": kind, "payload_bytes": size, "payload_digest": digest.removeprefix("sha256:") if digest else None, "refers_to": as_int("warc-refers-to-page-id"), "payload": payload}, end + 4


def unzipped(data: memoryview, at: int, step: int = 1 << 15) -> tuple[bytes, int]:
    """The member at an offset and where it ends; fed in steps, as zlib copies what follows a member."""
    d, out = zlib.decompressobj(31), []
    try:
        while not d.eof:
            if at >= len(data):
                raise Bad("the member does not end")
            out.append(d.decompress(data[at : at + step]))
            at += step
    except zlib.error as e:
        raise Bad(str(e)) from None
    return b"".join(out), min(at, len(data)) - len(d.unused_data)


def salvaged(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(start, end, record or the reason of a gap), in order and without overlap, over all bytes of an archive."""
    at, view = 0, memoryview(data)
    ahead = {"member": -1, "line": -1}  # the next places found so far; searched again only when passed

    def some(at: int) -> tuple[int, list[dict | str]]:
        """The end of what is at an offset, and its records; a gap of bytes within a member comes as its reason."""
        if data[at : at + 2] != b"\x1f\x8b":
            rec, end = parsed(data, at)
            return end, [rec]
        text, end = unzipped(view, at)
        found, k, first = [], 0, None
        while k < len(text):
            try:
                rec, k = parsed(text, k)
                found.append(rec)
            except Bad as e:
                why, _, past = str(e).partition("\0")
                first = first or e
                found.append(f"in a member: {why}")
                m = None if past else _VERSION_LINE.search(text, k + 1)
                k = int(past) if past else m.start() if m else len(text)
        if not any(isinstance(x, dict) for x in found):
            why, _, past = str(first or "the member is empty").partition("\0")
            raise Bad(f"{why}\0{end}" if past else why)
        return end, found

    def valid(at: int) -> bool:
        try:
            parsed(data, at)
        except Bad:
            return False
        return True

    def member_from(at: int) -> int:
        while (at := data.find(b"\x1f\x8b\x08", at)) >= 0:
            try:  # the first bytes of a member tell; the whole member is checked in its turn
                if zlib.decompressobj(31).decompress(view[at : at + 1024], 10).startswith(b"WARC/1."):
                    return at
            except zlib.error:
                pass
            at += 1
        return len(data)

    def line_from(at: int) -> int:
        while m := _VERSION_LINE.search(data, at):
            at = m.start()
            if data[at - 1 : at] == b"\n" or valid(at):
                return at
            at += 1
        return len(data)

    while at < len(data):
        try:
            end, found = some(at)
            for rec in found:
                yield at, end, rec
            at = end
            continue
        except Bad as e:
            why, _, past = str(e).partition("\0")
        if past:  # whole, but not what its digest says
            yield at, int(past), why
            at = int(past)
            continue
        for kind, search in (("member", member_from), ("line", line_from)):
            if ahead[kind] <= at:
                ahead[kind] = search(at + 1)
        nxt = min(ahead.values())
        yield at, nxt, why
        at = nxt


WRITTEN = pa.schema({"uri": pa.string(), "n_records": pa.int64(), "n_bytes": pa.int64()})


def write_warc(pages: DataFrame, work: Workspace, to: str, least: int = LEAST, zipped: bool = True) -> DataFrame:
    """Write archives under the folder; returns a row per shard (uri, n_records, n_bytes), already written."""
    p = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    twice = p.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").drop("n")
    twice = work.write(twice, "repeated")
    rows = p.join(twice.hint("merge"), "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).alias("refers_to"))
    end = "warc.gz" if zipped else "warc"

    def run(batches) -> Iterator[pa.RecordBatch]:
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def shard():
            uri = f"{to}/part-{part:06d}-{k:04d}.{end}"
            with create(uri) as out:
                out.writelines(held)
            return pa.RecordBatch.from_pydict({"uri": [uri], "n_records": [len(held)], "n_bytes": [size]}, schema=WRITTEN)

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                data = record(page_id, url, html.encode(), digest, refers_to)
                held.append(member(data) if zipped else data)
                size += len(held[-1])
                if size >= SHARD:
                    yield shard()
                    k, held, size = k + 1, [], 0
        if held:
            yield shard()

    return work.write(rows.mapInArrow(run, "uri string, n_records long, n_bytes long"), "shards")


FIELDS = "uri string, start long, end long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, gap string"


def held_open(uri: str):
    """The bytes of an archive: mapped where it is a plain file, so that no more of it than is looked at takes memory."""
    with opened(uri) as f:
        try:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        except (AttributeError, OSError, ValueError):  # a store's file, or an empty one
            return f.read()


def read_warc(shards: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row per record, and a row with `gap` set (record_type null) per stretch of bytes that holds none.

    `shards` has a column uri; an archive is read by one task; our writer bounds its size, and a plain file is mapped."""
    names = [x.split()[0] for x in FIELDS.split(", ")] + ["payload"] * with_payload
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                data = held_open(uri)
                rows, held = [], 0
                for start, end, x in salvaged(data):
                    row = {"uri": uri, "start": start, "end": end} | ({"gap": x} if isinstance(x, str) else x)
                    held += len(row.pop("payload", b"") if not with_payload else row.get("payload", b""))
                    rows.append(row)
                    if len(rows) >= 2000 or held >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return shards.select("uri").mapInArrow(run, FIELDS + (", payload binary" if with_payload else ""))


def quarantine(found: DataFrame, work: Workspace) -> DataFrame:
    """The log of gaps (uri, start, end, gap), written, and read again."""
    return work.write(found.where("gap is not null").select("uri", "start", "end", "gap"), "quarantine")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives that this run has written must be whole: a gap is an error, not a row less."""
    work = Workspace(spark, "op8")
    shards = write_warc(table(spark, sf_dir, "pages"), work, work.path("warc"))
    n = max(1, shards.count())
    found = work.write(read_warc(shards.repartition(n), with_payload=False), "found")
    if not (gaps := quarantine(found, work)).isEmpty():
        raise ValueError(f"damaged archives: {gaps.take(3)}")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}
SQL = {
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= 100
""",
}
