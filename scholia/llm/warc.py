"""WARC archives: a writer whose files depend on the rows alone, and a reader.

Records are sorted by (id, digest, url) over all files, rows without an id last. What a shard holds is decided by
the running sum of payload bytes in that order, not by how Spark dealt the rows, so the same rows always give the
same files; within a shard a file is rolled before the record that would take it over the limit of compressed bytes.
Of payloads that occur again, the record of the smallest id holds the payload and the others are revisits of it,
found by a grouped minimum. Every record is a gzip member, compressed before the shuffle.

A task writes its files under temporary names that no other attempt shares and returns them as rows. Once all are
known, a second job gives each file its final name, which may be tried again, and writes the manifest. Readers follow
the manifest, so files of lost tasks are never read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholia.llm.common import _SCRATCH, Shared, _delete, arrow_schema, column, drop_saved, save, session, shared_dir, small_batches

#: Compressed bytes at which a file is rolled; payload bytes of a shard; fewest shards and most (the driver holds the first key of each).
ROLL_BYTES, SHARD_BYTES, FEWEST, MOST = 128 << 20, 256 << 20, 32, 10_000
#: The date of all records, unless another is given: a clock would make each run's files differ.
DATE = "1970-01-01T00:00:00Z"
_ORDER = ["none", "page_id", "digest", "url"]
_CHUNK = 1 << 20
_FILES = "shard int, name string, held string, records long, bytes long, sha256 string"
_RECORDS = "type string, record_id string, page_id long, url string, date string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, url: str, digest: str, repeat: str = "0") -> str:
    """Made of what the record holds; repeat tells equal rows apart."""
    said = f"{'' if page_id is None else page_id}\n{url}\n{digest}\n{repeat}"
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(said.encode()).digest()[:16], version=5)}>"


def _plain(url: str) -> str:
    """Control characters and blanks escaped, since a header is one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*headers, ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).digest())}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def page_member(page_id: int | None, url: str, payload: bytes, digest: str, first: tuple[int, str] | None, date: str = DATE, repeat: str = "0") -> bytes:
    """The compressed record of a page: a response, or a revisit of first (id and url), which has the same payload."""
    bare = _base32(bytes.fromhex(digest))
    headers = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", record_id(page_id, url, digest, repeat)), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", _plain(url))] * bool(url) + [("X-Page-Id", str(page_id))] * (page_id is not None)
    if first:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(*first, digest)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-Id", str(first[0]))]
        headers += [("WARC-Refers-To-Target-URI", _plain(first[1]))] * bool(first[1])
    headers += [("WARC-Payload-Digest", f"sha1:{bare}"), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _member(headers, http if first else http + payload)


def _slim(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """page_id, none (whether it is null), url, html as bytes, and its digests."""
    small_batches(session(pages))
    own = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary").alias("html"))
    return own.select(F.col("page_id").isNull().alias("none"), "*", F.sha1("html").alias("digest"), F.sha2("html", 256).alias("strong"), F.octet_length("html").cast("long").alias("bytes"))


def _cuts(prints: DataFrame, shard_bytes: int) -> list[tuple[tuple, int]]:
    """The first key of each shard, in order, and the number of shards that the rows of that one key fill."""
    spark = session(prints)
    keys = prints.groupBy(*_ORDER).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("bytes")).alias("bytes"))
    ranged = save(keys.repartitionByRange(*_ORDER).withColumn("part", F.spark_partition_id()), "keys")
    base, bases = 0, []
    for r in ranged.groupBy("part").agg(F.sum("bytes").alias("b")).orderBy("part").collect():  # a row a partition
        bases.append((r["part"], base))
        base += r["b"]
    step = max(1, min(shard_bytes, -(-base // FEWEST)), -(-base // MOST))
    within = W.partitionBy("part").orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("bytes").over(within), F.lit(0))
    spread = F.least("n", F.floor(F.col("bytes") / step))
    laid = ranged.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part").select(F.struct(*_ORDER).alias("k"), F.floor(start / step).alias("shard"), F.when(spread > 1, spread).otherwise(1).cast("long").alias("spread"))
    firsts = laid.groupBy("shard").agg(F.min("k").alias("k"))
    # a shard's first key, and those keys that fill shards of their own: no more of either than there are shards
    cuts = firsts.select("k", F.lit(1).cast("long").alias("spread")).unionAll(laid.where("spread > 1").select("k", "spread")).groupBy("k").agg(F.max("spread").alias("spread"))
    found = sorted((_key(*r["k"]), r["spread"]) for r in cuts.collect())
    drop_saved(ranged)
    return found


def _key(none: bool, page_id: int | None, digest: str, url: str) -> tuple:
    return none, page_id or 0, digest, url


def write(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, date: str = DATE, prefix: str = "pages",
) -> DataFrame:
    """Write a record for each row into files of folder, which all executors must share, and return the manifest.

    A payload is the text's UTF-8 bytes; null counts as empty. Of rows with equal payloads of at least min_bytes
    bytes, those with the smallest id are responses and all others revisits; rows without an id come last, and
    where no row of a payload has an id all are responses. Equal rows get records of their own. A null url
    gives a record without a target. A table without rows gives a manifest without files.
    """
    spark = session(pages)
    own = _slim(pages, key, url, payload)
    prints = save(own.groupBy("none", "page_id", "url", "digest", "strong", "bytes").agg(F.count("*").alias("n")), "prints")
    again = prints.where(F.col("bytes") >= min_bytes).groupBy("strong", "bytes").agg(F.sum("n").alias("n"), F.min(F.struct("none", "page_id", "url")).alias("first"))
    # written first, so that its size decides how it is joined
    first = save(again.where("n > 1 and not first.none").select("strong", "bytes", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "firsts")
    cuts = _cuts(prints, shard_bytes)
    drop_saved(prints)
    shards = sum(n for _, n in cuts)
    held = Shared(spark, cuts)
    ddl = "shard int, none boolean, page_id long, digest string, url string, member binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, at = [k for k, _ in held.value], [], 0
        for _, n in held.value:
            numbers.append((at, n))
            at += n
        turns: dict[int, int] = {}  # of keys that fill several shards; the first row of each task goes to the first, which so has one
        want = arrow_schema(ddl)
        for batch in batches:
            rows = [column(batch, c) for c in ("none", "page_id", "digest", "url", "html", "first_id", "first_url")]
            where, members = [], []
            for none, page, digest, address, html, first_id, first_url in zip(*rows):
                i = bisect.bisect_right(keys, _key(none, page, digest, address)) - 1
                start, n = numbers[i]
                share, repeat = n - 1, "0"
                if n > 1 and keys[i] == _key(none, page, digest, address):
                    share = turns.get(i, 0)
                    turns[i], repeat = (share + 1) % n, str(share)
                where.append(start + share)
                later = first_id is not None and (none or page > first_id)
                members.append(page_member(page, address, html, digest, (first_id, first_url) if later else None, date, repeat))
            yield pa.RecordBatch.from_pydict({"shard": where} | dict(zip(("none", "page_id", "digest", "url"), rows)) | {"member": members}, schema=want)

    packed = own.join(first, ["strong", "bytes"], "left").select(*_ORDER, "html", "first_id", "first_url").mapInArrow(pack, ddl)
    dealt = packed.repartitionById(max(1, shards), "shard").sortWithinPartitions("shard", *_ORDER)
    staged = save(dealt.mapInArrow(lambda batches: _write_files(batches, folder, prefix, roll_bytes, date), _FILES), "staged")
    drop_saved(first)
    staged.mapInArrow(lambda batches: _commit_files(batches, folder), _FILES).write.mode("error").parquet(f"{folder}/manifest")
    drop_saved(staged)
    _delete(spark, f"{folder}/_temporary")
    return spark.read.schema(_FILES).parquet(f"{folder}/manifest")


class _File:
    """An open archive: a temporary name, its bytes so far, and a digest of them."""

    def __init__(self, store: fs.FileSystem, folder: str, shard: int, number: int, prefix: str, date: str) -> None:
        self.shard, self.number, self.name = shard, number, f"{prefix}-{shard:05d}-{number:05d}.warc.gz"
        self.held = f"_temporary/{self.name}.{uuid.uuid4().hex}"
        store.create_dir(f"{folder}/_temporary", recursive=True)
        self.out, self.bytes, self.records, self.seen = store.open_output_stream(f"{folder}/{self.held}", compression=None), 0, 0, hashlib.sha256()
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name, "")), ("WARC-Date", date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
        self.put(_member(info, b"format: WARC File Format 1.1\r\n"))

    def put(self, member: bytes) -> None:
        self.out.write(member)
        self.seen.update(member)
        self.bytes += len(member)
        self.records += 1

    def row(self) -> pa.RecordBatch:
        self.out.close()
        one = {"shard": self.shard, "name": self.name, "held": self.held, "records": self.records, "bytes": self.bytes, "sha256": self.seen.hexdigest()}
        return pa.RecordBatch.from_pylist([one], schema=arrow_schema(_FILES))


def _write_files(batches: Iterator[pa.RecordBatch], folder: str, prefix: str, roll_bytes: int, date: str) -> Iterator[pa.RecordBatch]:
    store, path = fs.FileSystem.from_uri(folder)
    now, last, repeat = None, None, 0
    for batch in batches:
        for shard, none, page, digest, url, member in zip(*(column(batch, c) for c in ("shard", "none", "page_id", "digest", "url", "member"))):
            repeat = repeat + 1 if last == (shard, none, page, digest, url) else 0
            last = (shard, none, page, digest, url)
            if repeat:
                own = b"WARC-Record-ID: " + record_id(page, url, digest, f"{shard}.{repeat}").encode()
                raw = re.sub(rb"WARC-Record-ID: <[^>]*>", own, zlib.decompress(member, 31), count=1)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = pack.compress(raw) + pack.flush()
            if now is not None and (now.shard != shard or now.records > 1 and now.bytes + len(member) > roll_bytes):
                number = now.number + 1 if now.shard == shard else 0
                yield now.row()
                now = _File(store, path, shard, number, prefix, date)
            if now is None:
                now = _File(store, path, shard, 0, prefix, date)
            now.put(member)
    if now is not None:
        yield now.row()


def _commit_files(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Give files their final names; what an earlier attempt has moved stays."""
    store, path = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for name, held in zip(column(batch, "name"), column(batch, "held")):
            if store.get_file_info(f"{path}/{held}").type != fs.FileType.NotFound:
                store.move(f"{path}/{held}", f"{path}/{name}")
            elif store.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
                raise FileNotFoundError(f"{folder}/{name} was written but is gone")
        yield batch


def members(stream) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one at a time."""
    unpack, parts = None, []
    while chunk := stream.read(_CHUNK):
        while chunk:
            if unpack is None:
                unpack, parts = zlib.decompressobj(31), []
            parts.append(unpack.decompress(chunk))
            chunk = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack = None
    if unpack is not None:
        raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, held against its length and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{_base32(hashlib.sha1(block).digest())}":
        raise ValueError(f"record {headers.get('WARC-Record-ID')} is damaged")
    return headers, block


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> dict | None:
    kind = headers["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?mi)^content-length: *(\d+)", http)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or _base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
    number = lambda name: int(headers[name]) if name in headers else None
    return {
        "type": kind, "record_id": headers["WARC-Record-ID"], "page_id": number("X-Page-Id"), "url": headers.get("WARC-Target-URI"), "date": headers["WARC-Date"],
        "payload_bytes": length, "payload_digest": digest, "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if payloads and kind == "response" else None,
    }


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The page records of an archive: type, record_id, page_id, url, date, payload_bytes, payload_digest, refers_to, payload.

    Revisits have the length and digest of the payload that they stand for, but no payload. Lengths and digests of
    all records and the sizes of all files are checked; what doesn't hold stops the job.
    """
    manifest = spark.read.schema(_FILES).parquet(f"{folder}/manifest")
    files = manifest.select("shard", "name", "bytes", "records")
    count = files.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        want = pa.schema([*arrow_schema(_RECORDS)])
        for batch in batches:
            for name, size, records in zip(*(column(batch, c) for c in ("name", "bytes", "records"))):
                if store.get_file_info(f"{path}/{name}").size != size:
                    raise ValueError(f"{name} has not the size that the manifest says")
                rows, load, seen = [], 0, 0
                with store.open_input_stream(f"{path}/{name}", compression=None, buffer_size=_CHUNK) as stream:
                    for raw in members(stream):
                        seen += 1
                        if (row := _row(*parse(raw), payloads)) is not None:
                            rows.append(row)
                            load += len(row["payload"] or b"")
                        if len(rows) >= 4096 or load >= _CHUNK * 4:
                            yield pa.RecordBatch.from_pylist(rows, schema=want)
                            rows, load = [], 0
                if seen != records:
                    raise ValueError(f"{name} has {seen} records and the manifest says {records}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=want)

    return files.repartitionById(count, "shard").mapInArrow(run, _RECORDS)


def report(pages: DataFrame) -> DataFrame:
    """Write the pages to an archive in the shared folder and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = session(pages)
    folder = f"{shared_dir(spark)}/scholia-warc-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, folder))
    write(pages, folder)
    return read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


#: The same report for DuckDB.
REPORT_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, coalesce(html, '') AS h, CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS bits FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
         + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (h)
"""
