"""Exact duplicates: Patricia tries within partitions by length and content hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType, _parse_datatype_string

from .store import bounded_batches, tidy_task


#: Bytes of strings and nodes that one trie holds before the subtrees that are complete are handed over.
TRIE_BYTES, NODE_BYTES = 32 << 20, 200


class PatriciaTrie:
    """Byte strings in a compressed radix trie; a terminal node holds an owner, a count and what came with the owner.

    A node is [label, children by first byte, owner, count, extra]; count 0 marks a node that ends no string.
    """

    def __init__(self, largest: bool = False) -> None:
        self.root: list = [b"", {}, None, 0, None]
        self.largest = largest
        self.strings = self.forks = self.held = 0

    def _better(self, a: int | None, b: int | None) -> bool:
        """Whether owner a goes before b."""
        return b is None if a is not None and b is None else a is not None and (a > b if self.largest else a < b)

    def insert(self, key: bytes, owner: int | None, count: int = 1, extra: object = None) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = node = [key[at:], {}, None, 0, None]
                break
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            part = key[at : at + len(label)]
            lo, hi = 1, min(len(label), len(part))  # the first byte is shared; find how far the labels agree
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if label[:mid] == part[:mid]:
                    lo = mid
                else:
                    hi = mid - 1
            fork = [label[:lo], {label[lo]: child}, None, 0, None]
            child[0] = label[lo:]
            node[1][key[at]] = fork
            self.forks += 1
            self.held += NODE_BYTES
            node, at = fork, at + lo
        if not node[3]:
            self.strings += 1
            self.held += NODE_BYTES + len(key) - at
            node[2], node[4] = owner, extra
        elif self._better(owner, node[2]):
            node[2], node[4] = owner, extra
        node[3] += count

    def items(self) -> Iterator[tuple[bytes, int | None, int, object]]:
        stack = [(self.root, b"")]
        while stack:
            node, before = stack.pop()
            whole = before + node[0]
            if node[3]:
                yield whole, node[2], node[3], node[4]
            stack.extend((x, whole) for x in node[1].values())

    def complete(self, last: bytes) -> list[tuple[bytes, int | None, int, object]]:
        """Take out all subtrees that strings sorted after ``last`` cannot reach: what is left is the path of ``last``."""
        got = list(self.items())
        self.__init__(self.largest)
        for key, owner, count, extra in got:
            if key == last:
                self.insert(key, owner, count, extra)
        return [x for x in got if x[0] != last]


def _combine(largest: bool, rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal texts of a batch become one row, so that a hot text is sent once a batch."""
        for batch in batches:
            seen: dict[bytes, list] = {}
            for at, (i, x) in enumerate(zip(batch["id"].to_pylist(), batch["body"], strict=True)):
                key = x.as_buffer().to_pybytes()
                if (s := seen.get(key)) is None:
                    seen[key] = [i, 1, at]
                else:
                    if i is not None and (s[0] is None or (i > s[0] if largest else i < s[0])):
                        s[0], s[2] = i, at
                    s[1] += 1
            out = {
                "n_bytes": pa.array([len(k) for k in seen], pa.int64()),
                "h": pa.array([xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in seen], pa.int64()),
                "body": pa.array(list(seen), pa.binary()),
                "owner": pa.array([s[0] for s in seen.values()], pa.int64()),
                "n": pa.array([s[1] for s in seen.values()], pa.int64()),
            }
            if rows:
                out["row"] = batch["row"].take(pa.array([s[2] for s in seen.values()], pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    return run


def _own(largest: bool, rows: bool, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last = PatriciaTrie(largest), b""

        def sent(got: list) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(got), 2000):
                part = got[a : a + 2000]
                if rows:
                    row = pa.concat_arrays([x[3] for x in part])
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.binary()), row], ["body", "row"])
                else:
                    yield pa.RecordBatch.from_pydict(
                        {"sha256": pa.array([hashlib.sha256(x[0]).hexdigest() for x in part], pa.string()), "keep_id": pa.array([x[1] for x in part], pa.int64()), "group_size": pa.array([x[2] for x in part], pa.int64())}
                    )

        for batch in batches:
            for i, (x, owner, n) in enumerate(zip(batch["body"], batch["owner"].to_pylist(), batch["n"].to_pylist(), strict=True)):
                last = x.as_buffer().to_pybytes()
                trie.insert(last, owner, n, batch["row"].slice(i, 1) if rows else None)
                if trie.held > limit:
                    yield from sent(trie.complete(last))
            if rows:  # rows refer to their batch, which need not be held longer
                yield from sent(trie.complete(last))
        yield from sent(list(trie.items()))

    return run


def _tries(docs: DataFrame, id_col: str, text_col: str, keep: str, row: Column | None, limit: int) -> DataFrame:
    if keep not in ("min", "max"):
        raise ValueError(keep)
    bounded_batches(docs.sparkSession)
    largest = keep == "max"
    body = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("body"), *([row.alias("row")] if row is not None else []))
    more = [body.schema["row"]] if row is not None else []
    sent = StructType([*_parse_datatype_string("n_bytes long, h long, body binary, owner long, n long").fields, *more])
    parts = body.mapInArrow(tidy_task(_combine(largest, bool(more))), sent).repartition("n_bytes", "h").sortWithinPartitions("body")
    out = StructType([StructField("body", BinaryType()), *more]) if more else "sha256 string, keep_id long, group_size long"
    return parts.mapInArrow(tidy_task(_own(largest, bool(more), limit)), out)


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(sha256, keep_id, group_size) of each different text.

    Texts go by (length, hash of the content) to partitions. Each partition inserts its full byte strings into one
    Patricia trie; a terminal node keeps the id that stays. Strings come in byte order from Spark's sort, which
    spills outside the heap if need be, so subtrees are complete one after another: once the trie holds
    ``trie_bytes``, all but the path of the last string are handed over and freed, and memory stays bounded. Only
    full byte strings decide. ``sha256`` names a terminal for later joins. A text held by a third of all rows is
    combined batch by batch before the shuffle.
    """
    return _tries(docs, id_col, text_col, keep, None, trie_bytes)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of ``docs``: its id, keep_id (the id that stays: smallest, or largest for keep='max'),
    group_size, kept, text_sha256.

    Null texts count as empty and empty texts equal one another. A null id is never the owner while a row of
    the group has one; a group of null ids only has keep_id null and is kept. Rows repeated with their id count
    each in group_size and are kept together. An empty table gives no rows. Other columns are ignored.
    """
    own = owners(docs, id_col, text_col, keep)
    each = docs.select(F.col(id_col).cast("long").alias(id_col), F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256).alias("text_sha256"))
    return each.join(own, each["text_sha256"] == own["sha256"]).select(
        id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, one a text, with all their columns; of rows that repeat an id and a text, one.

    The columns travel with their text through the one shuffle into the tries, and come out of the terminal nodes.
    Null and empty texts are one text, of which the row that stays is given as it was; a null id stays only where
    no row of the text has an id. An empty table gives no rows. Columns may have any names, but must differ.
    """
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(text_col).isNull().alias("none"))
    got = _tries(docs, id_col, text_col, keep, row, trie_bytes)
    text = F.when(~F.col("row.none"), F.col("body").cast("string")).alias(text_col)
    return got.select(*[text if c == text_col else F.col(f"row.c{others.index(c)}").alias(c) for c in docs.columns])
