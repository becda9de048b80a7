"""WARC files: a deterministic sharded writer, and a reader."""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fsio
from .store import bounded_batches, forget, new_folder, save, spread_join, task_each

#: Bytes that are decompressed at once.
BLOCK = 1 << 14
DATE = "2000-01-01T00:00:00Z"
REVISIT_BYTES = 1000
#: Payload bytes of a shard, and compressed bytes after which its file is rolled.
SHARD_BYTES, FILE_BYTES = 16 << 20, 8 << 20
#: At most about so many shards, which are larger for it when there is more data; places looked at for each shard's bounds.
SHARDS, PLACES = 65_536, 16
#: Bytes that a record takes beside its payload.
RECORD_BYTES = 500
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"


def _sha1(data: bytes, digest: bytes | None = None) -> str:
    return "sha1:" + base64.b32encode(digest or hashlib.sha1(data).digest()).decode()


def _record(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("WARC-Block-Digest", _sha1(block)), ("Content-Length", str(len(block)))])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # one gzip member a record, with no time in it
    return z.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, nth: int = 0, digest: str | None = None) -> bytes:
    """The record of one page. A revisit keeps the HTTP header, with the payload's length, and not the payload. ``digest``: the
    payload's SHA-1 in hexadecimal, if it is known."""
    digest = digest or hashlib.sha1(payload).hexdigest()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(f"page:{page_id}:{nth}:{digest}")), ("WARC-Date", DATE),
        ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", _sha1(payload, bytes.fromhex(digest))),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(f"page:{refers_to}:0:{digest}"))]
        if refers_to is not None:
            head.append(("X-Refers-To-Page-Id", str(refers_to)))
    return _record(head, http if revisit else http + payload)


def _info(name: str) -> bytes:
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn("file:" + name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


@dataclass
class Record:
    head: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def http(self) -> dict[str, str]:
        lines = self.block.partition(b"\r\n\r\n")[0].decode("latin-1").split("\r\n")[1:]
        return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def records(data: bytes | Iterator[bytes]) -> Iterator[Record]:
    """The records of a file, one gzip member each, from its bytes or from blocks of them; lengths and block digests are
    checked. Only one record and one block are held."""
    source = iter([data] if isinstance(data, bytes) else data)
    held, at = next(source, b""), 0
    while at < len(held) or (held := next(source, b"")):
        at = 0 if at >= len(held) else at
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(held):
                held, at = next(source, b""), 0
                if not held:
                    raise ValueError("a truncated record")
            piece = held[at : at + BLOCK]
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        top, _, body = b"".join(parts).partition(b"\r\n\r\n")
        first, *lines = top.decode().split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError("not a WARC record")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = body[: int(head["content-length"])]
        if body[len(block) :] != b"\r\n\r\n" or head.get("warc-block-digest", _sha1(block)) != _sha1(block):
            raise ValueError("a damaged record")
        yield Record(head, block)


def _write(folder: str, file_bytes: int, prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[bytes] = []
        size = count = nth = 0
        shard = serial = target = None
        page: tuple | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size, count, serial
            if count:
                name = f"{prefix}-{shard:06d}-{serial:04d}.warc.gz"
                temp, data = f"{folder}/.temporary/{uuid.uuid4().hex}", b"".join(out)
                fsio.write(temp, data)
                yield pa.RecordBatch.from_pydict({"shard": [shard], "serial": [serial], "temp": [temp], "path": [f"{folder}/{name}"], "records": [count], "bytes": [len(data)], "sha256": [hashlib.sha256(data).hexdigest()]})
                serial += 1
            out.clear()
            size = count = 0

        for batch in batches:
            for s, i, same, url, html, digest, to in zip(*(batch[c].to_pylist() for c in ("shard", "page_id", "same", "url", "html", "digest", "refers_to")), strict=True):
                if s != shard:
                    yield from flush()
                    shard, serial = s, 0
                if page != (s, i, same):
                    page, target, nth = (s, i, same), None, 0
                if to is not None:  # comes before the pages of that id and payload
                    target = to
                    continue
                if not count:
                    out.append(_info(f"{prefix}-{shard:06d}-{serial:04d}.warc.gz"))
                    size = len(out[0])
                payload = (html or "").encode()
                again = nth > 0 and len(payload) >= REVISIT_BYTES
                out.append(page_record(i, url, payload, i if target is None and again else target, target is not None or again, nth, digest))
                size, count, nth = size + len(out[-1]), count + 1, nth + 1
                if size >= file_bytes:
                    yield from flush()
        yield from flush()

    return run


def _bounds(small: DataFrame, shard_bytes: int) -> list[tuple[int | None, str]]:
    """Where shards begin, in order: pairs of an id and the start of a payload's hash, nulls first.

    A function of the rows alone: a place is looked at with a chance in proportion to its bytes, which its own hash decides,
    so that each shard has about PLACES of them, and a shard begins where their bytes pass a multiple of a shard's. There are
    at most some SHARDS * PLACES places, which one task puts in order, and two times SHARDS bounds, which reach the driver.
    """
    places = small.groupBy("page_id", F.substring("same", 1, 16).alias("same")).agg(F.sum(F.col("n") + RECORD_BYTES).alias("w"))
    total = small.agg(F.sum(F.col("n") + RECORD_BYTES)).first()[0] or 0
    shard = max(shard_bytes, -(-total // SHARDS))
    step = shard / PLACES
    chance = F.pmod(F.xxhash64("page_id", "same"), F.lit(1 << 30)) / float(1 << 30)
    some = places.where(chance < F.col("w") / step).withColumn("w", F.greatest(F.col("w").cast("double"), F.lit(step)))
    order = Window.orderBy(F.col("page_id").asc_nulls_first(), "same")
    part = F.floor(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)) / shard)
    first = some.withColumn("part", F.coalesce(part, F.lit(0))).withColumn("before", F.lag("part", 1, 0).over(order)).where("part > before")
    return [(r[0], r[1]) for r in first.orderBy(F.col("page_id").asc_nulls_first(), "same").select("page_id", "same").collect()]


def _shard_of(spark: SparkSession, bounds: list[tuple[int | None, str]]) -> Callable[[Column, Column], Column]:
    """The number of bounds up to an id and a payload's hash. Only these two columns go to Python."""
    least = -(1 << 63)
    sent = spark.sparkContext.broadcast((np.array([least if i is None else i for i, _ in bounds], np.int64), [h for _, h in bounds]))

    @F.arrow_udf("long")
    def shard(page_id: pa.Array, same: pa.Array) -> pa.Array:
        ids, hashes = sent.value
        x = page_id.fill_null(least).to_numpy()
        lo, hi = np.searchsorted(ids, x, "left"), np.searchsorted(ids, x, "right")
        for k in np.flatnonzero(lo < hi):  # bounds within an id
            lo[k] += bisect.bisect_right(hashes[lo[k] : hi[k]], same[int(k)].as_py()[:16])
        return pa.array(lo, pa.int64())

    return shard


def _commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for temp, path in zip(batch["temp"].to_pylist(), batch["path"].to_pylist(), strict=True):
            fsio.move(temp, path)
        yield pa.RecordBatch.from_arrays([batch[c] for c in ("shard", "serial", "path", "records", "bytes", "sha256")], ["shard", "serial", "path", "records", "bytes", "sha256"])


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, prefix: str = "pages") -> DataFrame:
    """Write a record per row and return the committed manifest (shard, serial, path, records, bytes, sha256).

    Of equal payloads of at least 1,000 bytes the row with the largest id is a response and the others revisit
    it; smaller payloads are always responses. Null payloads are empty, a null url becomes a urn; of rows that
    repeat id and payload the first is the response. Null ids are written first and refer to the largest id, or
    to none when no copy has an id. An empty table makes an empty manifest.

    Shards are ranges of ids, and of payload hashes within an id that has many, of about ``shard_bytes`` each; their bounds
    follow from the rows alone, whatever the ids, so names and contents are the same whatever the partitions. Payloads are
    shuffled once, a shard to a task; who revisits whom is found on digests alone and meets the pages in the same sort.
    Payloads are equal if SHA-256 and length are. Files are rolled by compressed size, written under temporary names, renamed
    by a second job that reads the first manifest, and count once the second manifest names them: an attempt that was lost
    leaves a temporary file that no manifest names, and a rename that was done twice is done once. Temporary files are
    removed when the manifest is there.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or new_folder(spark, "warc")
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("same", F.sha2(body, 256)).withColumn("digest", F.sha1(body))
    small = save(rows.select("page_id", "same", F.length(body).cast("long").alias("n")), "payloads")
    bounds = _bounds(small, shard_bytes)

    long = small.where(F.col("n") >= REVISIT_BYTES)
    groups = long.groupBy("same", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1")
    groups_ = save(groups, "payload-groups")
    groups = groups_.withColumn("to", F.xxhash64("same"))
    revisits = spread_join(long.select("page_id", "same", F.xxhash64("same").alias("to")), groups.select("to", "refers_to", "c", F.col("same").alias("group")), "to", "c", F.xxhash64("page_id"))
    revisits = revisits.where((F.col("same") == F.col("group")) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "same", "refers_to").distinct()
    none = F.lit(None).cast("string")
    both = rows.withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits.select("page_id", "same", "refers_to", none.alias("url"), none.alias("html"), none.alias("digest")))
    both = both.withColumn("shard", _shard_of(spark, bounds)(F.col("page_id"), F.col("same")))
    ordered = both.repartitionById(len(bounds) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "same", F.col("refers_to").asc_nulls_last(), "url", F.col("html").isNull())
    written = save(ordered.select("shard", "page_id", "same", "url", "html", "digest", "refers_to").mapInArrow(_write(folder, file_bytes, prefix), "shard long, serial long, temp string, path string, records long, bytes long, sha256 string"), "warc-written")
    manifest = task_each(written).mapInArrow(_commit, "shard long, serial long, path string, records long, bytes long, sha256 string")
    path = f"{folder}/manifest"
    manifest.write.parquet(path)
    forget(small, groups_, written)
    fsio.remove(f"{folder}/.temporary")
    return spark.read.schema(manifest.schema).parquet(path)


def read_warc(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to and, if asked for, payload) of every page
    record in the files; a response's digest is computed from its payload and held against its header.

    A file is read in blocks and must be what the manifest says. Null ids come back null, a null url as its urn, and an
    empty manifest gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, sha in zip(batch["path"].to_pylist(), batch["sha256"].to_pylist(), strict=True):
                rows: list[tuple] = []
                seen = hashlib.sha256()
                for r in records(_hashed(path, seen)):
                    kind = r.head["warc-type"]
                    if kind == "warcinfo":
                        continue
                    stated = base64.b32decode(r.head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and hashlib.sha1(r.payload).hexdigest() != stated:
                        raise ValueError(f"{path}: payload and digest differ")
                    i, to = r.head.get("x-page-id"), r.head.get("x-refers-to-page-id")
                    rows.append((i and int(i), r.head["warc-target-uri"], kind, int(r.http["content-length"]), stated, to and int(to), r.payload if with_payload and kind == "response" else None))
                    if len(rows) == 500:
                        yield _page_batch(rows, with_payload)
                        rows = []
                if seen.hexdigest() != sha:
                    raise ValueError(f"{path} is not what the manifest says")
                if rows:
                    yield _page_batch(rows, with_payload)

    return task_each(manifest.select("path", "sha256")).mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload)


def _hashed(path: str, digest) -> Iterator[bytes]:
    for block in fsio.blocks(path):
        digest.update(block)
        yield block


def _page_batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"][: 6 + with_payload]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)
