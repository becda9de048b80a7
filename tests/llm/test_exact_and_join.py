"""Exact dedup and the n-gram join against plain versions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lumenbox.llm import exact_dedup, ngram_join
from lumenbox.llm.components import components

SCHEMA = "doc_id long, text string, owner string, n string, digest string, token string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", None, "z") for i, t in rows], SCHEMA)


def _shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def _brute(rows, k, num, den):
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, _shingles(t, k)) for i, t in rows]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


@given(st.lists(st.tuples(st.binary(max_size=6), st.one_of(st.none(), st.integers(0, 99))), max_size=60), st.booleans())
def test_trie(entries, largest):
    trie, want = exact_dedup.PatriciaTrie(largest), {}
    for key, owner in entries:
        trie.insert(key, owner)
        want.setdefault(key, []).append(owner)
    best = lambda v: (max if largest else min)([x for x in v if x is not None], default=None)
    assert {k: (o, n) for k, o, n, _ in trie.items()} == {k: (best(v), len(v)) for k, v in want.items()}
    assert trie.strings == len(want)


@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 99)), max_size=60), st.integers(1, 9))
def test_trie_hands_over_complete_subtrees(entries, every):
    """In byte order, what is handed over early is what a trie of everything holds, and only the last string stays."""
    entries = sorted(entries)
    trie, whole, got = exact_dedup.PatriciaTrie(), exact_dedup.PatriciaTrie(), []
    for i, (key, owner) in enumerate(entries):
        trie.insert(key, owner)
        whole.insert(key, owner)
        if i % every == 0:
            got += trie.complete(key)
            assert trie.strings == 1 and not trie.forks
    assert sorted(x[:3] for x in [*got, *trie.items()]) == sorted(x[:3] for x in whole.items())


def test_tries_hold_many_strings(spark, monkeypatch):
    """A partition's strings share one trie, and a small bound on its bytes changes nothing."""
    held = []
    own = exact_dedup._own(False, False, 1 << 20)
    body = sorted([f"a common beginning of many texts, then {i:03d}".encode() for i in range(300)])
    batch = pa.RecordBatch.from_pydict({"body": pa.array(body, pa.binary()), "owner": pa.array(range(300), pa.int64()), "n": pa.array([1] * 300, pa.int64())})
    monkeypatch.setattr(exact_dedup.PatriciaTrie, "items", lambda self, items=exact_dedup.PatriciaTrie.items: held.append((self.strings, self.forks)) or items(self))
    assert sum(len(b) for b in own(iter([batch]))) == 300
    assert held[-1][0] == 300 and held[-1][1] > 20
    monkeypatch.undo()
    docs = _docs(spark, [(i, f"text {i % 70}" + "x" * (i % 7)) for i in range(400)])
    whole = {tuple(r) for r in exact_dedup.owners(docs).collect()}
    assert whole == {tuple(r) for r in exact_dedup.owners(docs, trie_bytes=500).collect()} and len(whole) == 70
    stay = {tuple(r) for r in exact_dedup.drop_exact_duplicates(docs).collect()}
    assert stay == {tuple(r) for r in docs.where("doc_id < 70").collect()} == {tuple(r) for r in exact_dedup.drop_exact_duplicates(docs, trie_bytes=500).collect()}


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_duplicates(spark, keep):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (None, "only"), (5, "x" * 500_000), (6, "x" * 500_000), (7, "x" * 499_999 + "y")]
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_duplicates(_docs(spark, rows), keep=keep).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert (got[1, sha("a")].keep_id, got[1, sha("a")].group_size) == ((1 if keep == "min" else 2), 4)
    assert got[3, sha("")].keep_id == (3 if keep == "min" else 4) and got[5, sha("x" * 500_000)].group_size == 2
    assert got[None, sha("only")].kept and not got[None, sha("a")].kept and got[7, sha("x" * 499_999 + "y")].kept
    left = exact_dedup.drop_exact_duplicates(_docs(spark, rows), keep=keep)
    assert left.columns == SCHEMA.replace(",", "").split()[::2] and left.count() == 5
    assert exact_dedup.exact_duplicates(_docs(spark, [])).count() == 0


def _family(rng, base, copies, first, edits):
    out = []
    for i in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append((first + i, " ".join(w)))
    return out


def test_join_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = _family(rng, rng.sample(words, 120), 70, 100, 6) + _family(rng, rng.sample(words, 40), 25, 300, 3) + _family(rng, rng.sample(words, 900), 12, 400, 40)
    passage = rng.sample(words, 60)
    rows += [(500 + i, " ".join(rng.sample(words, 8 + i % 12) + passage)) for i in range(40)]
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two three"), (7, "ONE two\x0bthree"), (8, "École un deux trois quatre"), (9, "école un deux trois quatre"), (10, rows[0][1].upper())]
    rng.shuffle(rows)
    for k, num, den in ((4, 85, 100), (5, 80, 100)):
        want = _brute(rows, k, num, den)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(_docs(spark, rows), k=k, num=num, den=den).collect()}
        assert got == want


def test_families_pass_all_orders():
    """In a block, candidates are the pairs that share prefix tokens in every order, and no linked pair is missed."""
    rng = np.random.default_rng(8)
    base = np.sort(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    parts, df = [], {}
    for i in range(30):
        fresh = rng.integers(0, 1 << 63, int(rng.integers(1, 60))).astype(np.uint64)
        keep = rng.random(400) > rng.choice([0.02, 0.1, 0.5])
        parts.append(np.unique(np.concatenate([base[keep], fresh])))
    for p in parts:
        for t in p.tolist():
            df[t] = df.get(t, 0) + 1
    num, den = 80, 100
    short = lambda p: len(p) - ngram_join._least(len(p), num, den) + 1
    known = [np.array(sorted(p.tolist(), key=lambda t: (df[t], t))[: short(p)], np.uint64).view(np.int64) for p in parts]
    every = np.arange(30)
    candidates, linked = ngram_join.block_pairs(parts, known, every, every, num, den)
    for i in every:
        for j in every[every != i]:
            x, y = set(parts[i].tolist()), set(parts[j].tolist())
            assert linked[i, j] == (den * len(x & y) >= num * len(x | y))
            orders = [set(known[i]) & set(known[j])]
            for f in (lambda t: t, lambda t: int(ngram_join._second(np.array([t], np.uint64))[0])):
                orders.append(set(sorted(x, key=f)[: short(parts[i])]) & set(sorted(y, key=f)[: short(parts[j])]))
            assert candidates[i, j] == (all(orders) and den * min(len(x), len(y)) >= num * max(len(x), len(y)))
    assert (linked & (every[:, None] != every)).sum() > 20 and candidates.sum() < 30 * 30


def test_join_with_repeated_ids(spark):
    """Rows that repeat an id with other texts are compared by each text; ranges and blocks do not change the result."""
    rng = random.Random(3)
    a, b, c = (rng.sample([f"w{i}" for i in range(900)], 60) for _ in range(3))
    near = lambda w: " ".join([*w[:-2], "x"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (5, " ".join(b)), (7, near(a)), (8, near(b)), (9, " ".join(c)), (3, near(c)), (None, " ".join(c))]
    for ranges in (None, 1, 50):
        got = sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.ngram_join(_docs(spark, rows), ranges=ranges).collect())
        assert got == [(0, 0), (3, 3), (5, 5), (5, 5), (5, 5), (7, 5), (8, 5), (9, 3)]


def test_join_edges(spark):
    assert ngram_join.ngram_join(_docs(spark, [])).count() == 0
    rows = [(7, "a b c d e f g"), (7, "a b c d e f g"), (None, "a b c d e f g"), (3, "a b c d e f g"), (9, "p q r s t u"), (9, "v w x y z a")]
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.ngram_join(_docs(spark, rows)).collect()), key=repr)
    assert got == sorted([(7, 3), (7, 3), (None, None), (3, 3), (9, 9), (9, 9)], key=repr)


def test_prefix_bounds():
    for num, den in ((85, 100), (80, 100)):
        for n in range(1, 400):
            least = int(ngram_join._least(n, num, den))
            assert den * least >= num * n > den * (least - 1) and ngram_join._long_prefix(n, num, den) <= n
            for m in range(least, n + 1):  # any partner's long prefix leaves as many tokens as are asked for
                assert ngram_join._extra(m, num, den) >= ngram_join._needed(n, num, den)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(500, 500)] + [(900, 901 + i) for i in range(200)]
    up = {}
    for a, b in edges:
        up.setdefault(a, {a}), up.setdefault(b, {b})
        if up[a] is not up[b]:
            up[a] |= up[b]
            for x in up[b]:
                up[x] = up[a]
    edges += [(20_000 + i, 30_000) for i in range(2500)]  # a hub that is the largest of its star
    want = {x: min(s) for x, s in up.items() if len(s) > 1} | {x: 20_000 for x in (*range(20_000, 22_500), 30_000)}
    for plain in (1_000_000, 0):
        got = {r.node: r.component for r in components(spark.createDataFrame(edges + [(None, 3)], "a long, b long"), plain=plain).collect()}
        assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
