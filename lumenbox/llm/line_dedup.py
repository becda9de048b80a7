"""Repeated passages: chunks or all two-line windows of lines, removed after the first place that has them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .store import bounded_batches, forget, save, spread_join

#: Line hashes in the rolling window; a boundary in so many lines on average; lines of a chunk that may go.
WINDOW, SPACING, LEAST_LINES = 3, 4, 2


def chunk_bounds(column: pa.Array | pa.ChunkedArray, window: int = WINDOW, spacing: int = SPACING) -> Iterator[list[tuple[int, int, int]]]:
    """For each text its chunks: first byte, end (its last line's break included), number of lines.

    A line ends a chunk when a hash rolled over the last ``window`` line hashes says so. That depends on those
    lines only, so the boundaries inside a passage are the same wherever it stands.
    """
    odd = [words.U64(2 * int(x) + 1) for x in words.mix(np.arange(11, 11 + window, dtype=words.U64)) >> words.U64(1)]
    for a, b, data, at in words.slices(column):
        breaks = np.flatnonzero(data == 0x0A)
        for i in range(b - a):
            lo, hi = int(at[i]), int(at[i + 1])
            ends = breaks[np.searchsorted(breaks, lo) : np.searchsorted(breaks, hi)] + 1
            if not len(ends) or ends[-1] != hi:
                ends = np.append(ends, hi)
            if hi == lo:
                yield []
                continue
            starts = np.concatenate([[lo], ends[:-1]])
            part = data[lo:hi]
            h = words.hashes(part, starts - lo, ends - lo)
            rolled = np.zeros(len(h), words.U64)
            for j in range(min(window, len(h))):
                rolled[j:] += h[: len(h) - j] * odd[j]
            last = np.flatnonzero(words.mix(rolled) % words.U64(spacing) == 0)
            if not len(last) or last[-1] != len(h) - 1:
                last = np.append(last, len(h) - 1)
            first = np.concatenate([[0], last[:-1] + 1])
            yield [(int(starts[p] - lo), int(ends[q] - lo), int(q - p + 1)) for p, q in zip(first, last, strict=True)]


def _key(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column:
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def windows(text: bytes) -> list[tuple[int, int, int]]:
    """Each pair of lines that follow one another, blank lines between them included: first byte, end without its
    break, first byte of the second line. Blank lines alone are no passage, and a text's last line needs no break."""
    lines, at = [], 0
    for line in text.split(b"\n"):
        if line.strip():
            lines.append((at, at + len(line)))
        at += len(line) + 1
    return [(a, d, c) for (a, _), (c, d) in zip(lines, lines[1:], strict=False)]


def _pieces(column: pa.Array, whole: bool) -> Iterator[list[tuple[int, int, int, int]]]:
    """First byte, end, lines and the second line's first byte of what may repeat: windows, or chunks."""
    if whole:
        for text in _texts(column):
            yield [(a, b, 2, c) for a, b, c in windows(text)]
    else:
        for bounds in chunk_bounds(column):
            yield [(a, b, lines, a) for a, b, lines in bounds]


def _list(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, text, bounds in zip(batch["id"].to_pylist(), _texts(batch["text"]), _pieces(batch["text"], whole), strict=True):
            rows += [(_key(text[a:b]), i, no) for no, (a, b, lines, _) in enumerate(bounds) if lines >= LEAST_LINES]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())], ["key", "id", "no"])


def _bodies(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """The bytes of listed chunks; equal bytes of a batch once, with all places."""
    for batch in batches:
        seen: dict[tuple[bytes, bool, bytes], list[tuple[int, int]]] = {}
        for i, text, bounds, marks in zip(batch["id"].to_pylist(), _texts(batch["text"]), _pieces(batch["text"], whole), batch["marks"].to_pylist(), strict=True):
            for m in marks:
                if m["no"] < len(bounds):
                    a, b, *_ = bounds[m["no"]]
                    if _key(text[a:b]) == m["key"]:
                        seen.setdefault((m["key"], m["own"], text[a:b]), []).append((i, m["no"]))
        places = [[{"id": i, "no": n} for i, n in x] for x in seen.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.binary()), pa.array([k[1] for k in seen], pa.bool_()), pa.array([k[2] for k in seen], pa.binary()), pa.array(places, pa.list_(pa.struct([("id", pa.int64()), ("no", pa.int32())])))],
            ["key", "own", "body", "places"],
        )


def _cut(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, removed, spans = [], [], []
        for text, bounds, gone in zip(_texts(batch["text"]), _pieces(batch["text"], whole), batch["gone"].to_pylist(), strict=True):
            drop = {(g["no"], g["key"]) for g in gone or ()}
            cut: list[tuple[int, int]] = []
            before = (b"", False)
            for no, (a, b, lines, second) in enumerate(bounds) if drop else ():
                key = _key(text[a:b])
                goes = lines >= LEAST_LINES and (no, key) in drop
                if goes and whole:
                    if before == (key, False):  # the window before is the one that is kept: its lines stay
                        a = second
                    b += text[b : b + 1] == b"\n"
                if goes and cut and a < cut[-1][1]:
                    cut[-1] = (cut[-1][0], b)
                elif goes:
                    cut.append((a, b))
                before = (key, goes)
            at, keep = 0, []
            for a, b in cut:
                keep.append(text[at:a])
                at = b
            out.append(b"".join([*keep, text[at:]]).decode())
            removed.append(len(cut))
            spans.append([{"first_byte": a, "end_byte": b} for a, b in cut])
        yield pa.RecordBatch.from_arrays([batch["__row_id"], pa.array(out, pa.string()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first_byte", pa.int64()), ("end_byte", pa.int64())])))], ["id", "text", "n_removed", "removed"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(id, text, n_removed, removed) of every row: text without the chunks of two lines or more that stand
    elsewhere first; removed holds their first and end bytes in the old text.

    ``whole``: not chunks but every pair of lines that follow one another is looked up, and all lines of a pair that
    stands elsewhere first go, so of a passage of two lines or more nothing is missed; removed holds the runs. Blank lines
    count with the lines around them only, and a passage may end its text without a line break. Where passages
    overlap, a line that goes is kept at an earlier place, but maybe beside other lines. What is shared inside lines only stays.

    The place with the smallest (id, position) keeps a chunk. Chunks are named by hashes in a table without
    texts; for repeated names the bytes are fetched, once a batch, and only a chunk whose bytes equal those of
    the keeping place goes. A passage that stands in a third of all documents is grouped map-side, the rows of its
    places are spread over all tasks, and no list of them is gathered. Single lines stay, however frequent.

    Null text counts as empty and comes back empty. Rows of null id are left whole. Rows repeated with their id
    keep the same chunks, as places of one id; texts that differ under one id are told apart by the chunk's
    hash. An empty table gives no rows; other columns are ignored.

    Texts are shuffled twice, by id, whatever the sizes: both joins are merge joins.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chunks = base.where("id is not null").mapInArrow(lambda batches: _list(batches, whole), "key binary, id long, no int")
    chunks = save(chunks.withColumn("k", F.xxhash64("key")), "line-chunks", tidy=True)
    repeated = chunks.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("id", "no")).alias("owner")).where("c > 1")
    repeated = save(repeated.select(F.xxhash64("key").alias("k"), F.col("key").alias("name"), "owner", "c"), "line-repeats", tidy=True)
    places = spread_join(chunks, repeated, "k", "c", F.xxhash64("id", "no")).where("key = name").select("key", "id", "no", (F.struct("id", "no") == F.col("owner")).alias("own"))
    marks = places.groupBy(F.col("id").alias("mid")).agg(F.collect_set(F.struct("no", "key", "own")).alias("marks"))
    bodies = save(base.join(marks.hint("merge"), base["id"] == marks["mid"]).select("id", "text", "marks").mapInArrow(lambda batches: _bodies(batches, whole), "key binary, own boolean, body binary, places array<struct<id:long,no:int>>"), "line-bodies", tidy=True)
    forget(chunks, repeated)
    # of bodies that differ under one name, which an id that repeats with other texts could give, the smallest counts
    owners = bodies.where("own").groupBy(F.col("key").alias("okey")).agg(F.min("body").alias("obody"))
    same = bodies.where("not own").join(owners, F.col("key") == F.col("okey")).where(F.col("body") == F.col("obody"))
    gone = same.select("key", F.explode("places").alias("p")).groupBy(F.col("p.id").alias("gid")).agg(F.collect_set(F.struct(F.col("p.no").alias("no"), "key")).alias("gone"))
    joined = base.join(gone.hint("merge"), base["id"] == gone["gid"], "left").select(F.col("id").alias("__row_id"), "text", "gone")
    out = joined.mapInArrow(lambda batches: _cut(batches, whole), "id long, text string, n_removed long, removed array<struct<first_byte:long,end_byte:long>>")
    return out.withColumnRenamed("id", id_col)
