"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, offsets, and decoding."""

from __future__ import annotations

import base64
import hashlib
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import words
from .store import bounded_batches, extended, tidy_task

SLICE = 12 << 20
#: Words whose ids a worker keeps, some 150 bytes each.
KNOWN = 200_000
#: Letters for which every Unicode version agrees; a piece of these alone, after one space or none, is one match.
SIMPLE = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: ASCII signs but the apostrophe, as a class of a pattern: a run of them after letters is one match.
SIGNS = r"!-&(-/:-@\[-`{-~"


def byte_table() -> list[str]:
    """The character that stands for each byte: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    table = {b: chr(b) for b in seen} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """All pairs of known byte strings whose concatenation is known, by the rank of the whole: at each step the
    pair of the lowest rank is merged, whichever way it is cut."""
    out = []
    for whole, rank in ranks.items():
        for i in range(1, len(whole)):
            a, b = whole[:i], whole[i:]
            if a in ranks and b in ranks:
                out.append((rank, ranks[a], ranks[b], a, b))
    return [(a, b) for *_, a, b in sorted(out)]


class ChunkEncoder:
    """Encodes texts as chunks between which no match reaches; each different chunk of a batch once.

    ``whole`` does everything; its model alone takes chunks that are one match as they stand.
    """

    simple = SIMPLE

    def _setup(self, whole, lengths: np.ndarray) -> None:
        self.whole, self.lengths = whole, lengths
        self.known: dict[str, bytes] = {}
        table = byte_table()
        self.names = str.maketrans({chr(b): table[b] for b in range(256)})
        self.space = table[0x20]

    def _trim(self, chunks: pa.Array) -> pa.Array:
        return chunks

    def _words(self, words_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are one match each, and how many each has. The first KNOWN different words of a worker are kept."""
        tokenize, names, space, known = self.whole.model.tokenize, self.names, self.space, self.known
        parts = []
        for w in words_:
            if (got := known.get(w)) is None:
                if w.isascii():
                    x = space + w[1:] if w[0] == " " else w
                else:
                    x = w.encode().decode("latin-1").translate(names)
                got = array("i", [t.id for t in tokenize(x)]).tobytes()
                if len(known) < KNOWN:
                    known[w] = got
            parts.append(got)
        return np.frombuffer(b"".join(parts), np.int32), np.fromiter(map(len, parts), np.int64, len(parts)) >> 2

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks on end, and each one's number of ids. Chunks of letters, with or without signs after them, are words
        and signs; the library does the others as they are."""
        n = len(chunks)
        plain = pc.match_substring_regex(chunks, self.simple).to_numpy(zero_copy_only=False)
        others = np.flatnonzero(~plain)
        parts = pc.extract_regex(chunks.take(pa.array(others)), f"^(?P<word>{self.simple[1:-1]})(?P<signs>[{SIGNS}]+)$")
        signed = parts.is_valid().to_numpy(zero_copy_only=False)
        parts, marked = parts.filter(pa.array(signed)), others[signed]
        start, count, after, more = (np.zeros(n, np.int64) for _ in range(4))
        easy = np.concatenate([np.flatnonzero(plain), marked])
        ids = np.zeros(0, np.int32)
        if len(easy):
            d = self._case(pa.concat_arrays([chunks.filter(pa.array(plain)), parts.field("word")])).dictionary_encode()
            ids, sizes = self._words(d.dictionary.to_pylist())
            code = d.indices.to_numpy()
            start[easy], count[easy] = (np.cumsum(sizes) - sizes)[code], sizes[code]
        if len(marked):
            d = parts.field("signs").dictionary_encode()
            signs, sizes = self._words(d.dictionary.to_pylist())
            code = d.indices.to_numpy()
            after[marked], more[marked] = (len(ids) + np.cumsum(sizes) - sizes)[code], sizes[code]
            ids = np.concatenate([ids, signs])
        hard = others[~signed]
        if len(hard):
            got = [e.ids for e in self.whole.encode_batch_fast(chunks.take(pa.array(hard)).to_pylist(), add_special_tokens=False)]
            count[hard] = [len(x) for x in got]
            start[hard] = len(ids) + np.cumsum(count[hard]) - count[hard]
            ids = np.concatenate([ids, np.array([i for x in got for i in x], np.int32)])
        whole = count + more
        out = np.empty(int(whole.sum()), np.int32)
        begins = np.cumsum(whole) - whole
        out[_spread(begins, count)] = ids[_spread(start, count)]
        out[_spread(begins + count, more)] = ids[_spread(after, more)]
        return out, whole

    def _case(self, base: pa.Array) -> pa.Array:
        return base

    def encode(self, column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
        """The ids of each text; null is empty."""
        for a, b, data, at in words.slices(column, SLICE):
            if not len(data):
                yield from (np.zeros(0, np.int32) for _ in range(b - a))
                continue
            cut = _cuts(data, at)
            chunks = pa.Array.from_buffers(pa.large_string(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(data))])
            d = chunks.dictionary_encode()
            ids, sizes = self._distinct(self._trim(d.dictionary))
            each = np.concatenate([[0], np.cumsum(sizes)]) * 4
            got = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(each), pa.py_buffer(ids)]).take(d.indices)
            ends = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1) >> 2
            all_ids = np.frombuffer(got.buffers()[2], np.int32, ends[-1])
            bounds = ends[np.searchsorted(cut, at)]
            for i in range(b - a):
                yield all_ids[bounds[i] : bounds[i + 1]]


class ByteBPE(ChunkEncoder):
    """Encoder and decoder for a file of ranks."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(ranks_path)
        table = byte_table()
        name = lambda b: "".join(table[x] for x in b)
        model = {"vocab": {name(k): v for k, v in ranks.items()}, "merges": [(name(a), name(b)) for a, b in merges_of(ranks)], "ignore_merges": True}
        # different words come once each, so the model need not remember them
        whole = Tokenizer(models.BPE(**model, cache_capacity=0))
        del model
        whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        reverse = {c: b for b, c in enumerate(table)}
        raw = [b""] * (max(ranks.values()) + 1)
        for text, i in whole.get_vocab().items():
            raw[i] = bytes(reverse[c] for c in text)  # the byte table, reversed
        self.raw = pa.array(raw, pa.binary())
        self.decimal = pa.array([b"%d," % i for i in range(len(raw))], pa.binary())
        self._setup(whole, np.array([len(x) for x in raw], np.int64))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.raw.take(pa.array(ids)).buffers()[2].to_pybytes()[: int(self.lengths[ids].sum())] if len(ids) else b""

    def decode(self, ids: np.ndarray) -> str:
        """A character that is not whole, because its ids were cut apart, becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each id; an id that holds part of a character spans that character."""
        data = np.frombuffer(self.decode_bytes(ids), np.uint8)
        if not len(data):
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        chars = np.cumsum((data & 0xC0) != 0x80)
        end = np.cumsum(self.lengths[ids])
        return chars[end - self.lengths[ids]] - 1, chars[end - 1]

    def ids_text(self, ids: np.ndarray) -> bytes:
        got = self.decimal.take(pa.array(ids))
        return got.buffers()[2].to_pybytes()[: pc.sum(pc.binary_length(got)).as_py() - 1] if len(ids) else b""


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1] and so on."""
    total = int(counts.sum())
    out = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    out += np.arange(total)
    return out


def _cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where texts can be cut with no effect on the matches: before ASCII white space that follows something else.

    A match never goes on from other characters into white space, and what decides how a run of white space is
    matched is the run and the next character; both are in the same chunk.
    """
    white = words.WHITE[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = white[1:] & ~white[:-1]
    p = np.flatnonzero(cut)
    p = p[data[p - 1] >= 0x80]
    one, two, three = data[p - 1], data[np.maximum(p - 2, 0)], data[np.maximum(p - 3, 0)]
    odd = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    odd |= (three == 0xE1) & (two == 0x9A) & (one == 0x80)
    odd |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF)) & (one >= 0x80)
    odd |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
    odd |= (three == 0xE3) & (two == 0x80) & (one == 0x80)
    cut[p[odd]] = False
    starts = at[:-1]
    cut[starts[starts < len(data)]] = True
    return np.append(np.flatnonzero(cut), len(data)).astype(np.int64)


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> ByteBPE:
    return ByteBPE(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """(id, n_tokens, ids) and, if asked for, (char_start, char_end): little-endian 32-bit integers in binary columns.

    Whole texts, each match of the pattern separately, without special tokens. A text is dealt with as chunks
    between which no match reaches; each different chunk of a batch is encoded once. Null and empty texts have
    no ids; ids of rows, repeated or null, go through as they are; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    names = ["ids"] + ["char_start", "char_end"] * with_offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for batch in batches:
            rows, n = [], []
            for ids in bpe.encode(batch[text_col]):
                n.append(len(ids))
                rows.append([ids.astype("<i4").tobytes(), *(x.astype("<i4").tobytes() for x in (bpe.offsets(ids) if with_offsets else ()))])
            yield pa.RecordBatch.from_arrays([batch[id_col], pa.array(n, pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(len(names)))], [id_col, "n_tokens", *names])

    base = docs.select(id_col, text_col)
    return base.mapInArrow(tidy_task(run), extended(base.select(id_col), n_tokens="long", **{x: "binary" for x in names}))


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The columns that came, with ``decoded`` (binary) and ``text`` (characters cut apart become U+FFFD)."""
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for batch in batches:
            raw = [bpe.decode_bytes(np.frombuffer(x or b"", "<i4")) for x in batch["ids"].to_pylist()]
            cols = [*batch.columns, pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "decoded", "text"])

    return encoded.mapInArrow(tidy_task(run), extended(encoded, decoded="binary", text="string"))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256 of the decimal ids with commas, decoded_sha256 of the bytes that the ids decode to).

    As ``decode(encode(docs))`` and the digests of both, in one Python step: a second step would have each task hold a
    second worker with a vocabulary of its own. Null and empty texts have no ids, and the digests of nothing; ids of rows, repeated
    or null, go through as they are; an empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for ids in bpe.encode(batch[text_col]):
                n.append(len(ids))
                a.append(hashlib.sha256(bpe.ids_text(ids)).hexdigest())
                b.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch[id_col], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    base = docs.select(id_col, text_col)
    return base.mapInArrow(tidy_task(run), extended(base.select(id_col), n_tokens="long", ids_sha256="string", decoded_sha256="string"))
