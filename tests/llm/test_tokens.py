"""Byte-level BPE against tiktoken; grammar files and their ids."""

import base64
import hashlib
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenbox.llm import bpe, repair

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "\n\n", "a", " a", "  a", "a  b", "it's we'LL don't", "x.\n\n\ny", "été à  la page", "a  b 　c", "1234 5,6", "😀😀 😀", "á̧", "İstanbul İI", "=" * 300, " " * 300 + "z", "ａｂ", "\x1c\x1d a", "\x85b c", "<|endoftext|>", "aaaa " * 50, "ΣΑΣ ς", "１２ ３"]
text = st.one_of(st.text(max_size=60), st.text(alphabet="ab' \n\té.,1 s", max_size=80), st.sampled_from(ODD))


def _tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ENC, OURS = _tiktoken(), bpe.codec(RANKS, P.PATTERN)
WHOLE, WORDS = Tokenizer.from_file(P.path("word_bpe_49k.json")), repair.codec(P.path("word_bpe_49k.json"))


@given(st.lists(text, max_size=6))
@settings(max_examples=400, deadline=None)
def test_same_as_tiktoken(texts):
    got = list(OURS.encode(pa.array(texts, pa.string())))
    assert [g.tolist() for g in got] == [ENC.encode_ordinary(t) for t in texts]
    assert [OURS.decode_bytes(g) for g in got] == [t.encode() for t in texts]
    assert [OURS.ids_text(g) for g in got] == [",".join(map(str, ENC.encode_ordinary(t))).encode() for t in texts]


@given(st.lists(text, max_size=6))
@settings(max_examples=400, deadline=None)
def test_words_same_as_tokenizers(texts):
    got = [g.tolist() for g in WORDS.encode(pa.array(texts, pa.string()))]
    assert got == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]


def test_offsets_and_characters_cut_apart():
    t = "é 😀x"
    (ids,) = OURS.encode(pa.array([t]))
    a, b = OURS.offsets(ids)
    assert a[0] == 0 and b[-1] == len(t) and all(x < y for x, y in zip(a, b, strict=True))
    pieces = [i for i in range(len(ids)) if t[a[i] : b[i]].strip() == "😀"]
    assert pieces and OURS.decode(ids) == t
    if len(pieces) > 1:
        assert "�" in OURS.decode(ids[: pieces[0] + 1])


def test_encode_table(spark):
    docs = spark.createDataFrame([(1, "a b", "q"), (None, None, "q"), (1, "a b", None), (2, "wörter " * 40_000, "q")], "doc_id long, text string, ids string")
    got = bpe.encode(docs, RANKS, P.PATTERN, with_offsets=True)
    assert got.columns == ["doc_id", "n_tokens", "ids", "char_start", "char_end"]
    rows = {(r.doc_id, r.n_tokens): r for r in bpe.decode(got, RANKS, P.PATTERN).collect()}
    assert rows[None, 0].text == "" and max(rows, key=lambda x: x[1])[0] == 2
    assert next(r for k, r in rows.items() if k[0] == 2).text == "wörter " * 40_000
    assert bpe.encode(docs.limit(0), RANKS, P.PATTERN).count() == 0
    for r in bpe.round_trip(docs, RANKS, P.PATTERN).collect():
        ids = ENC.encode_ordinary(rows[r.doc_id, r.n_tokens].text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id, r.n_tokens].text.encode()).hexdigest()


@given(st.lists(st.lists(st.integers(0, 6), max_size=40), min_size=1, max_size=8), st.integers(2, 5))
@settings(max_examples=200, deadline=None)
def test_grammar(docs, least):
    ids = np.array([x for d in docs for x in d], np.int32)
    ends = np.cumsum([len(d) for d in docs])
    symbols, bounds, g = repair.compress(ids, ends, 7, rounds=4, a_round=3, least=least)
    flat, start, length = g.tables()
    at = 0
    for d, b in zip(docs, bounds, strict=True):
        s = symbols[at:b].astype(np.int64)
        assert [x for k in s for x in flat[start[k] : start[k] + length[k]]] == d
        at = b


@given(st.lists(st.lists(st.integers(0, 3), max_size=60), min_size=1, max_size=6), st.integers(2, 4))
@settings(max_examples=100, deadline=None)
def test_grammar_is_whole(docs, least):
    ids = np.array([x for d in docs for x in d], np.int32)
    symbols, bounds, g = repair.compress(ids, np.cumsum([len(d) for d in docs]), 4, a_round=2, least=least)
    flat, start, length = g.tables()
    at, pairs = 0, {}
    for d, b in zip(docs, bounds.tolist(), strict=True):
        s = symbols[at:b].astype(np.int64).tolist()
        assert [x for k in s for x in flat[start[k] : start[k] + length[k]]] == d
        for p in zip(s, s[1:]):
            pairs[p] = pairs.get(p, 0) + 1
        at = b
    assert max(pairs.values(), default=0) < least  # no pair is left


def test_grammar_of_copies():
    rng = np.random.default_rng(8)
    text = rng.integers(0, 40_000, 2000).astype(np.int32)
    symbols, bounds, g = repair.compress(np.tile(text, 200), np.arange(1, 201) * 2000, 40_000)
    assert len(symbols) <= 3 * 200  # three rounds left 250 symbols or more a copy


def test_grammar_takes_the_most_frequent_pair():
    docs = [(874, 922)] * 20 + [(773, 47)] * 20 + [(1, 2)] * 30  # the first two once shared a bucket of 40
    _, _, g = repair.compress(np.array(docs, np.int32).ravel(), np.arange(2, 141, 2), 1000, rounds=1, a_round=1)
    assert g.rules.tolist() == [[1, 2]]


def _cpu(f):
    times = []
    for _ in range(5):
        t = time.process_time()
        f()
        times.append(time.process_time() - t)
    return min(times)


def test_a_round_over_few_symbols_costs_little():
    ids, ends, many = np.tile(np.arange(1024, dtype=np.int32), 20), np.arange(1, 21) * 1024, np.arange(1 << 20)
    symbols, _, g = repair.compress(ids, ends, 1024)  # 10 rounds
    assert len(symbols) == 20 and g.lengths.max() == 1024
    # by passes over a million numbers: 1.5 measured; 20 when each round went over as many buckets
    assert _cpu(lambda: repair.compress(ids, ends, 1024)) < 6 * _cpu(lambda: np.bincount(np.minimum(many, 4095)))


def test_shard_random_access():
    rng = np.random.default_rng(3)
    docs = [np.tile(rng.integers(0, 30, 12), 40).astype(np.int32), np.zeros(0, np.int32), np.full(1000, 5, np.int32), rng.integers(0, 30, 3000).astype(np.int32)]
    data = repair.pack([4, None, 9, 11], np.concatenate(docs), np.cumsum([len(d) for d in docs]), 30)
    shard = repair.Shard(data)
    assert shard.doc_ids == [4, None, 9, 11] and len(shard.symbols) < sum(map(len, docs)) * 0.8
    for i, d in enumerate(docs):
        assert (shard.read(i) == d).all()
        for a, b in ((0, len(d)), (3, 17), (len(d) - 5, len(d)), (7, 8)):
            if 0 <= a < b <= len(d):
                assert (shard.slice(i, a, b) == d[a:b]).all()
    try:
        repair.Shard(data[:-1])
        raise AssertionError("a cut file was read")
    except ValueError:
        pass


def test_id_files(spark):
    rows = [(5, "b c"), (2, None), (9, "word " * 30_000), (2, "again"), (None, "nobody"), (7, "")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    manifest = repair.write_ids(docs, P.path("word_bpe_49k.json"))
    got = sorted(repair.read_ids(manifest).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = np.array(WHOLE.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    assert repair.read_ids(repair.write_ids(docs.limit(0), P.path("word_bpe_49k.json"))).count() == 0
