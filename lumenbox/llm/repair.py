"""Token ids in files compressed by a grammar: frequent pairs of ids become nonterminals (Re-Pair)."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import fsio
from .bpe import ChunkEncoder, _spread
from .store import bounded_batches, new_folder, save, task_each

MAGIC = b"IDPAIRS1"
SHARD_IDS = 2_000_000
RULES_A_ROUND, LEAST = 4096, 12
_BUCKETS = 18
#: Stands where a document ends and the next one begins; symbols are below 2^31.
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class WordBPE(ChunkEncoder):
    """A BPE with word ends; lower case, white space dropped, from a tokenizers file."""

    #: Letters whose lower case and normal form are the same in every Unicode version.
    simple = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        end = spec["model"].get("end_of_word_suffix") or ""
        lengths = np.zeros(max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1, np.int64)
        for text, i in spec["model"]["vocab"].items():
            lengths[i] = len(text.removesuffix(end)) or len(text)
        self.size = len(lengths)
        self._setup(Tokenizer.from_file(path), lengths)

    def _trim(self, chunks: pa.Array) -> pa.Array:
        return pc.ascii_trim_whitespace(chunks)

    def _case(self, base: pa.Array) -> pa.Array:
        return pc.utf8_lower(base)


@lru_cache(maxsize=2)
def codec(path: str) -> WordBPE:
    return WordBPE(path)


@dataclass
class Grammar:
    """Nonterminal ``first + i`` stands for the pair ``rules[i]``; ``lengths[i]`` ids in all."""

    first: int
    rules: np.ndarray
    lengths: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All expansions on end, and for each symbol where its own starts and how long it is."""
        start = np.concatenate([np.arange(self.first), self.first + np.cumsum(self.lengths) - self.lengths])
        length = np.concatenate([np.ones(self.first, np.int64), self.lengths])
        raw = np.arange(self.first, dtype="<i4").tobytes()
        own = [raw[i : i + 4] for i in range(0, len(raw), 4)]
        for a, b in self.rules.tolist():
            own.append(own[a] + own[b])
        return np.frombuffer(b"".join(own), "<i4"), start.astype(np.int64), length.astype(np.int64)


def _bucket(pairs: np.ndarray) -> np.ndarray:
    return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BUCKETS)).astype(np.int32)


def _frequent(pairs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that come ``least`` times or more, in order, and how often each comes."""
    ordered = np.sort(pairs)
    same = ordered[: max(0, len(ordered) - least + 1)]
    same = same[same == ordered[least - 1 :]]  # of a pair's run, all but the last least - 1
    begin = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]])) if len(same) else np.zeros(0, np.int64)
    times = np.diff(begin, append=len(same)) + least - 1
    real = same[begin] != _NONE
    return same[begin][real], times[real]


def compress(ids: np.ndarray, ends: np.ndarray, first: int, rounds: int | None = None, a_round: int = RULES_A_ROUND, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, Grammar]:
    """(symbols, end of each document among the symbols, grammar). ``ends`` are the documents' ends among the ids.

    Each round replaces the most frequent pairs, left to right and never across documents; ties go to the
    smaller pair, so that the same ids give the same file. Rounds go on until no pair comes ``least`` times, or for ``rounds``.
    """
    seq = ids.astype(np.uint32)
    bounds = ends.astype(np.int64)
    at = np.zeros(0, np.int64)  # where the last round's symbols are
    rules: list[np.ndarray] = []
    lengths = np.ones(first, np.int64)
    known: dict[int, int] = {}
    full, done = True, 0
    while (rounds is None or done < rounds) and len(seq) > 1 and len(lengths) + a_round <= 1 << 31:
        # when no frequent pair waits, only pairs with a symbol of the last round can have become frequent; the end is found by looking at all
        if full:
            here = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]
            here[bounds[(bounds > 0) & (bounds < len(seq))] - 1] = _NONE
        else:
            near = np.unique(np.concatenate([at - 1, at]))
            near = near[(near >= 0) & (near < len(seq) - 1)]
            here = (seq[near].astype(np.uint64) << np.uint64(32)) | seq[near + 1]
            here[bounds[np.searchsorted(bounds, near + 1)] == near + 1] = _NONE
        pairs, times = _frequent(here, least)
        if not len(pairs):
            if full:
                break
            full = True
            continue
        chosen = pairs[np.lexsort((pairs, -times))[:a_round]]
        fresh = np.array([p for p in chosen.tolist() if p not in known], np.uint64)  # overlaps may leave matches of an earlier round's pair
        known.update(zip(fresh.tolist(), range(len(lengths), len(lengths) + len(fresh))))
        name = np.array([known[p] for p in chosen.tolist()], np.uint32)
        rules.append(np.stack([fresh >> np.uint64(32), fresh & np.uint64(0xFFFFFFFF)], axis=1).astype(np.int64))
        lengths = np.concatenate([lengths, lengths[rules[-1]].sum(axis=1)])
        table = np.full(1 << _BUCKETS, -1, np.int32)
        table[_bucket(chosen)[::-1]] = np.arange(len(chosen) - 1, -1, -1, dtype=np.int32)  # where two meet, the rarer one waits
        place = table[_bucket(here)]
        hit = np.flatnonzero(place >= 0)
        place = place[hit]
        right = chosen[place] == here[hit]
        hit, place = hit[right], place[right]
        at = hit if full else near[hit]
        full = len(pairs) > len(chosen) or np.count_nonzero(table >= 0) < len(chosen)
        nth = np.arange(len(at))
        begin = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, nth, 0))
        take = ((nth - begin) & 1) == 0  # of matches that overlap, every other one counts
        at = at[take]
        seq[at] = name[place[take]]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        bounds -= np.searchsorted(at, bounds - 1)  # a pair is within a document
        at -= np.arange(len(at))
        done += 1
    return seq, bounds, Grammar(first, np.concatenate([np.zeros((0, 2), np.int64), *rules]), lengths[first:])


def pack(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray, first: int) -> bytes:
    """A shard: magic, length of the header, header (JSON), then its sections in the header's order."""
    symbols, bounds, g = compress(ids, ends, first)
    wide = first + len(g.rules) > 1 << 16
    parts = {
        "rules": g.rules.astype("<u4").tobytes(), "lengths": g.lengths.astype("<u4").tobytes(),
        "doc_ids": np.array([x or 0 for x in doc_ids], "<i8").tobytes(), "null_ids": np.packbits([x is None for x in doc_ids]).tobytes(),
        "id_ends": ends.astype("<u8").tobytes(), "symbol_ends": bounds.astype("<u8").tobytes(), "symbols": symbols.astype("<u4" if wide else "<u2").tobytes(),
    }
    head = json.dumps({"documents": len(doc_ids), "first": first, "wide": wide, "sections": {k: len(v) for k, v in parts.items()}, "crc32": zlib.crc32(parts["symbols"])}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts.values())


class Shard:
    """A shard's documents, each of which can be read by itself."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a shard of ids")
        (n,) = struct.unpack("<I", data[8:12])
        head = json.loads(data[12 : 12 + n])
        at, part = 12 + n, {}
        for k, size in head["sections"].items():
            part[k] = data[at : at + size]
            at += size
        if at != len(data) or zlib.crc32(part["symbols"]) != head["crc32"]:
            raise ValueError("a damaged shard")
        null = np.unpackbits(np.frombuffer(part["null_ids"], np.uint8))
        self.doc_ids = [None if null[i] else x for i, x in enumerate(np.frombuffer(part["doc_ids"], "<i8").tolist())]
        self.id_ends = np.frombuffer(part["id_ends"], "<u8").astype(np.int64)
        self.symbol_ends = np.frombuffer(part["symbol_ends"], "<u8").astype(np.int64)
        self.symbols = np.frombuffer(part["symbols"], "<u4" if head["wide"] else "<u2")
        self.flat, self.start, self.length = Grammar(head["first"], np.frombuffer(part["rules"], "<u4").reshape(-1, 2).astype(np.int64), np.frombuffer(part["lengths"], "<u4").astype(np.int64)).tables()

    def read(self, i: int) -> np.ndarray:
        s = self.symbols[self.symbol_ends[i - 1] if i else 0 : self.symbol_ends[i]].astype(np.int64)
        return self.flat[_spread(self.start[s], self.length[s])]

    def slice(self, i: int, a: int, b: int) -> np.ndarray:
        """Ids a to b of document i: only the symbols that reach into them are expanded."""
        s = self.symbols[self.symbol_ends[i - 1] if i else 0 : self.symbol_ends[i]].astype(np.int64)
        ends = np.cumsum(self.length[s])
        p, q = np.searchsorted(ends, a, side="right"), np.searchsorted(ends, b, side="left") + 1
        got = self.flat[_spread(self.start[s[p:q]], self.length[s[p:q]])]
        before = int(ends[p - 1]) if p else 0
        return got[a - before : b - before]


def write_ids(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write the ids of every whole text and ``end_id`` after each, in ascending order of the ids; returns the
    manifest (part, shard, path, documents, ids, base): base is the number of ids in all files before.

    Documents are range-partitioned and sorted by id (nulls first, ties by text); each task rolls its file after
    about two million ids. A file counts once the manifest, which is written when all are there, names it; what
    a lost attempt left has another name and is never read. Null texts count as empty and have the end id only; rows that
    repeat an id are documents of their own; an empty table makes no file and an empty manifest; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    folder = folder or new_folder(docs.sparkSession, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task = codec(tokenizer_path), TaskContext.get()
        names: list[int | None] = []
        held: list[np.ndarray] = []
        n = shard = 0

        def flush() -> pa.RecordBatch:
            nonlocal n, shard
            path = f"{folder}/part-{task.partitionId():06d}-{shard:04d}-{task.taskAttemptId()}.ids"
            fsio.write(path, pack(names, np.concatenate(held), np.cumsum([len(x) for x in held]), bpe.size))
            row = pa.RecordBatch.from_pydict({"part": [task.partitionId()], "shard": [shard], "path": [path], "documents": [len(names)], "ids": [n]})
            names.clear(), held.clear()
            n, shard = 0, shard + 1
            return row

        for batch in batches:
            for i, ids in zip(batch["id"].to_pylist(), bpe.encode(batch["text"]), strict=True):
                names.append(i)
                held.append(np.append(ids, np.int32(end_id)))
                n += len(ids) + 1
                if n >= SHARD_IDS:
                    yield flush()
        if names:
            yield flush()

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = base.repartitionByRange("id").sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    manifest = save(ordered.mapInArrow(run, "part long, shard long, path string, documents long, ids long"), "ids-manifest")
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


def read_ids(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, if asked for, ids: little-endian unsigned 32-bit integers) from the files: a row
    a document, in no order; null ids come back null, and an empty manifest gives no rows. A damaged file is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                shard = Shard(fsio.read(path))
                starts = base + np.concatenate([[0], shard.id_ends[:-1]])
                for a in range(0, len(shard.doc_ids), 500):
                    b = min(a + 500, len(shard.doc_ids))
                    raw = [shard.read(i).astype("<u4").tobytes() for i in range(a, b)]
                    cols = {"doc_id": pa.array(shard.doc_ids[a:b], pa.int64()), "start": pa.array(starts[a:b], pa.int64()), "n_tokens": pa.array([len(x) // 4 for x in raw], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64())}
                    yield pa.RecordBatch.from_pydict(cols | ({"ids": pa.array(raw, pa.binary())} if with_ids else {}))

    parts = task_each(manifest.select("path", "base"))
    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
