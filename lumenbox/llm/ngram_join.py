"""Similarity join of documents by the Jaccard measure of their word shingles, with several global token orders."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .components import Forest, components, with_names
from .store import bounded_batches, forget, save, spread_join, tidy_group, tidy_task

U64 = np.uint64
FLUSH = 1_000_000
SHARED_HERE = 65535
HUBS = 3
#: A token's list of so many documents is compared pair by pair; those of longer ones in blocks of BLOCK, COLUMNS tokens at a time.
LONG_LIST, BLOCK, COLUMNS = 16, 256, 4096
#: Tokens of the first filter that one task sorts, more or less.
RANGE_TOKENS = 4_000_000


def _least(n, num: int, den: int):
    """The smallest number of shingles that a set of n shares with any set linked to it, and so its size at least."""
    return -((-num * n) // den)


def _extra(n, num: int, den: int):
    """Tokens by which the first filter's prefix is longer than the shortest one; grows with n."""
    return np.maximum(1, _least(n, num, den) * 14 // 100)


def _long_prefix(n, num: int, den: int):
    return np.minimum(n, n - _least(n, num, den) + _extra(n, num, den))


def _needed(n, num: int, den: int):
    """Shared tokens that the long prefixes of n and of any set linked to it have at least: as many as the smallest
    partner's prefix goes beyond its shortest."""
    return _extra(_least(n, num, den), num, den)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal numbers, none of them negative."""
    cuts = np.flatnonzero(np.diff(x, prepend=-1))
    return list(zip(cuts, np.append(cuts[1:], len(x)), strict=True)) if len(cuts) else []


def _second(x: np.ndarray) -> np.ndarray:
    return words.mix(x ^ U64(0xA0761D6478BD642F))


def _profile(k: int, num: int, den: int, ranges_log2: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        ids: list = []
        size: list[int] = []
        digest: list[bytes] = []
        texts: list[int] = []
        prefix: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal serial, held
            batch = (task << 24) | serial
            serial += 1
            n = np.array(size, np.int64)
            token = np.concatenate(prefix) if prefix else np.zeros(0, U64)
            doc = np.repeat(np.arange(len(prefix)), [len(x) for x in prefix])
            spread = _second(token)
            order = np.argsort(spread, kind="stable")
            spread, doc = spread[order], doc[order]
            new = np.ones(len(spread), bool)
            new[1:] = spread[1:] != spread[:-1]
            run_id = np.cumsum(new) - 1
            times = np.bincount(run_id) if len(spread) else np.zeros(0, np.int64)
            again = times[run_id] > 1 if len(spread) else np.zeros(0, bool)
            here = np.bincount(doc[again], minlength=len(n))
            first = np.flatnonzero(new)
            spread, who = spread[first], np.where(times > 1, SHARED_HERE, doc[first]) if len(first) else np.zeros(0, np.int64)
            part = (spread >> U64(64 - ranges_log2)).astype(np.int64) if ranges_log2 else np.zeros(len(spread), np.int64)
            low = ((spread << U64(ranges_log2)) >> U64(32)).astype(np.uint32)
            who = who.astype(np.uint16)
            rows = [(batch, 1, int(part[a]), low[a:b].tobytes(), who[a:b].tobytes(), None) for a, b in _runs(part)]
            head = json.dumps(ids).encode()
            rows.append((batch, 0, None, n.tobytes() + here.astype(np.int64).tobytes() + np.array(texts, np.int64).tobytes(), head, b"".join(digest)))
            ids.clear(), size.clear(), digest.clear(), texts.clear(), prefix.clear()
            held = 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["batch", "kind", "part", "x", "y", "z"])

        for batch in batches:
            for i, th, s in zip(batch["id"].to_pylist(), batch["th"].to_pylist(), words.shingle_sets(batch["text"], k), strict=True):
                ids.append(i)
                texts.append(th)
                size.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                p = s[: int(_long_prefix(len(s), num, den))] if len(s) else s
                prefix.append(p)
                held += len(p)
                if held >= FLUSH or len(ids) >= SHARED_HERE - 1:
                    yield from flush()
        if ids:
            yield from flush()

    return run


def _count(key: tuple, table: pa.Table) -> pa.Table:
    """One range of tokens: which entries' tokens some other batch has, too; counts by batch and document."""
    batches = np.array(table["batch"].to_pylist(), np.int64)
    low = [np.frombuffer(x, np.uint32) for x in table["x"].to_pylist()]
    who = np.concatenate([np.frombuffer(x, np.uint16) for x in table["y"].to_pylist()])
    of = np.repeat(np.arange(len(low)), [len(x) for x in low])
    token = np.concatenate(low)
    order = np.argsort(token, kind="stable")
    token, who, of = token[order], who[order], of[order]
    same = np.zeros(len(token), bool)
    same[1:] = token[1:] == token[:-1]
    same[:-1] |= same[1:]
    got = same & (who != SHARED_HERE)
    both, times = np.unique((of[got].astype(np.int64) << 16) | who[got], return_counts=True)
    b, w = both >> 16, (both & 0xFFFF).astype(np.uint16)
    cuts = _runs(b)
    return pa.table(
        {"batch": pa.array([batches[b[i]] for i, _ in cuts], pa.int64()), "y": pa.array([w[i:j].tobytes() for i, j in cuts], pa.binary()), "z": pa.array([times[i:j].astype(np.uint32).tobytes() for i, j in cuts], pa.binary())}
    )


def _settle(num: int, den: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        n = here = ids = digest = texts = None
        counts = []
        for kind, x, y, z in zip(table["kind"].to_pylist(), table["x"].to_pylist(), table["y"].to_pylist(), table["z"].to_pylist(), strict=True):
            if kind == 0:
                n, here, texts = np.frombuffer(x, np.int64).reshape(3, -1)
                here = here.copy()
                ids, digest = json.loads(y), z
            else:
                counts.append((np.frombuffer(y, np.uint16), np.frombuffer(z, np.uint32)))
        for who, times in counts:
            np.add.at(here, who, times)
        need = np.maximum(1, _needed(n, num, den))
        return pa.table(
            {"doc_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "digest": pa.array([digest[16 * i : 16 * i + 16] for i in range(len(n))], pa.binary()), "th": pa.array(texts, pa.int64()), "alive": pa.array((n > 0) & (here >= need), pa.bool_())}
        )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = [], []
            for i, (s, d) in enumerate(zip(words.shingle_sets(batch["text"], k), batch["digest"].to_pylist(), strict=True)):
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d:
                    keep.append(i)
                    rows.append(s)
            yield pa.RecordBatch.from_arrays(
                [batch["cid"].take(pa.array(keep, pa.int64())), pa.array([len(s) for s in rows], pa.int64()), pa.array([s.tobytes() for s in rows], pa.binary())], ["cid", "n", "s"]
            )

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.frombuffer(x.as_buffer(), np.int64) for x in batch["s"]]
        for a in range(0, len(rows), 64):
            part = rows[a : a + 64]
            sizes = [len(x) for x in part]
            token = np.concatenate(part)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(batch["cid"].to_numpy()[a : a + 64], sizes)), pa.array(np.repeat(np.array(sizes, np.int64), sizes))], ["token", "cid", "n"])


def _prefixes(num: int, den: int, second: bool):
    """(family, token, cid) for the shortest prefix of each set in hash order, or in the second one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_prefix(np.frombuffer(x.as_buffer(), U64), num, den, second) for x in batch["s"]]
            sizes = [len(x) for x in rows]
            token = np.concatenate(rows) if rows else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch["family"].to_numpy(), sizes)), pa.array(token.view(np.int64)), pa.array(np.repeat(batch["cid"].to_numpy(), sizes))], ["family", "token", "cid"])

    return run


def _prefix(s: np.ndarray, num: int, den: int, second: bool) -> np.ndarray:
    return (np.sort(_second(s)) if second else s)[: len(s) - _least(len(s), num, den) + 1]


def _verify(num: int, den: int):
    """Links among pairs: the sets must share a prefix token in hash order and in a second hash order, then enough in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["s"], batch["s2"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if not all(_meet(_prefix(x, num, den, second), _prefix(y, num, den, second)) for second in (False, True)):
                    ok.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    return run


def _meet(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.sort(np.concatenate([x, y]))
    return bool((both[1:] == both[:-1]).any())


def _narrowed(family: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Families (cid, family) cut to those whose documents also share, one with the next, prefix tokens in hash order, and
    then in the second hash order. Linked documents share one in each order, so they stay together."""
    for second in (False, True):
        rows = family.join(sets.select("cid", "s"), "cid").select("cid", "family", "s")
        tokens = rows.mapInArrow(tidy_task(_prefixes(num, den, second)), "family long, token long, cid long").select(F.xxhash64("family", "token").alias("key"), "cid")
        heads = save(tokens.groupBy("key").agg(F.min("cid").alias("head"), F.count("*").alias("k")).where("k > 1"), "heads")
        links = spread_join(tokens, heads, "key", "k", F.xxhash64("cid")).where("cid <> head").select(F.col("head").alias("a"), F.col("cid").alias("b")).distinct()
        kin = components(links)
        before, family = family, save(kin.select(F.col("node").alias("cid"), F.col("component").alias("family")), "families")
        forget(before, heads, kin)
    return family


def _families(sets: DataFrame, lists: DataFrame, family: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) within families, as forests of blocks.

    A family's documents are dealt into classes of size so that linked ones are of the same class or neighbours,
    and each class into blocks of about BLOCK documents; a document goes to the pairs of blocks that may hold
    partners, so the copies made grow with a family's size over BLOCK. ``lists`` has the prefixes in order of document
    frequency: in a block, pairs are compared only if they share prefix tokens in all three orders.
    """
    step = math.log(den / num)
    prefix = lists.join(family.select("cid"), "cid").groupBy("cid").agg(F.collect_list("token").alias("p"))
    rows = family.join(sets, "cid").join(prefix, "cid", "left").select("family", "cid", "n", "s", "p", F.floor(F.log("n") / step).cast("long").alias("size"))
    rows = save(rows, "family-sets")
    blocks = save(rows.groupBy("family", "size").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")), "blocks")
    at = lambda d, name: blocks.select(F.col("family").alias(f"f{name}"), (F.col("size") + d).alias(f"s{name}"), F.col("blocks").alias(name))
    for d, name in ((0, "own"), (-1, "next"), (1, "before")):  # the blocks of this class, the one above and the one below
        other = at(d, name)
        rows = rows.join(other, (rows["family"] == other[f"f{name}"]) & (rows["size"] == other[f"s{name}"]), "left").drop(f"f{name}", f"s{name}")
    block = F.pmod(F.xxhash64("cid"), F.col("own"))
    to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    none = F.array().cast("array<struct<size:bigint,i:bigint,up:boolean,j:bigint,first:boolean>>")
    key = lambda size, i, up, j, first: F.struct(size.alias("size"), i.alias("i"), F.lit(up).alias("up"), j.alias("j"), F.lit(first).alias("first") if isinstance(first, bool) else first.alias("first"))
    own = F.transform(to(F.col("own")), lambda t: key(F.col("size"), F.least(F.col("block"), t), False, F.greatest(F.col("block"), t), F.col("block") <= t))
    above = F.when(F.col("next").isNotNull(), F.transform(to(F.col("next")), lambda t: key(F.col("size"), F.col("block"), True, t, True))).otherwise(none)
    below = F.when(F.col("before").isNotNull(), F.transform(to(F.col("before")), lambda t: key(F.col("size") - 1, t, True, F.col("block"), False))).otherwise(none)
    dealt = rows.withColumn("block", block).withColumn("k", F.explode(F.concat(own, above, below))).select("family", "k.size", "k.i", "k.up", "k.j", "k.first", "cid", "s", "p")
    return dealt.groupBy("family", "size", "i", "up", "j").applyInArrow(tidy_group(_block_links(num, den)), "a long, b long")


def _common(parts: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many numbers each row of ``left`` shares with each of ``right``."""
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    _, col, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    many = times > 1  # a token of one document is in no intersection
    place = np.cumsum(many) - 1
    keep = many[col]
    row, col = row[keep], place[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, int(many.sum()), COLUMNS):
        a, b = np.searchsorted(col, [c, c + COLUMNS])
        m = np.zeros((len(parts), min(COLUMNS, int(many.sum()) - c)), np.float32)
        m[row[a:b], col[a:b] - c] = 1
        common += m[left] @ m[right].T
    return common.astype(np.int64)


def block_pairs(parts: list[np.ndarray], known: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(candidates, linked) as matrices of left by right: candidates share tokens of ``known``, their prefixes by document
    frequency, and prefix tokens in both hash orders; linked ones were compared whole."""
    sizes = np.array([len(p) for p in parts])
    small, large = np.minimum(sizes[left][:, None], sizes[right][None, :]), np.maximum(sizes[left][:, None], sizes[right][None, :])
    candidates = den * small >= num * large
    for order in (known, *([_prefix(p, num, den, second) for p in parts] for second in (False, True))):
        if candidates.any():
            candidates &= _common(order, left, right) > 0
    linked = np.zeros_like(candidates)
    x, y = candidates.any(1), candidates.any(0)
    if x.any():
        common = _common(parts, left[x], right[y])
        linked[np.ix_(x, y)] = den * common >= num * (sizes[left[x]][:, None] + sizes[right[y]][None, :] - common)
    return candidates, linked & candidates


def _block_links(num: int, den: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        within = not key[3].as_py() and key[2].as_py() == key[4].as_py()
        cid = np.array(table["cid"].to_pylist(), np.int64)
        side = np.array(table["first"].to_pylist(), bool)
        left = np.flatnonzero(side) if not within else np.arange(len(cid))
        right = np.flatnonzero(~side) if not within else left
        forest = Forest()
        if len(left) and len(right) and len(cid) > 1:
            parts = [np.frombuffer(x.as_buffer(), U64) for chunk in table["s"].chunks for x in chunk]
            known = [np.array(x or [], np.int64) for x in table["p"].to_pylist()]
            for i, j in np.argwhere(block_pairs(parts, known, left, right, num, den)[1]):
                if left[i] != right[j]:
                    forest.join(int(cid[left[i]]), int(cid[right[j]]))
        edges = [(forest.find(x), x) for x in forest.up]
        edges = [(r, x) for r, x in edges if r != x]
        return pa.table({"a": pa.array([r for r, _ in edges], pa.int64()), "b": pa.array([x for _, x in edges], pa.int64())})

    return run


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, ranges: int | None = None) -> DataFrame:
    """(id, n_shingles, component_id) of every row: documents link when den * common >= num * union of their sets of
    distinct k-word shingles; component_id is the smallest id reachable by links.

    1. Equal sets are one class from the start, so copies cost nothing later. 2. A filter in hash order: linked
    sets share at least so many tokens of their long prefixes; the tokens go to ranges as sorted 32-bit
    remainders, packed, at most one a token and batch, and only counts come back. There are as many ranges as the
    length of all texts asks for. Documents without enough shared tokens link with nothing. 3. For the rest, tokens
    ordered by document frequency: documents are candidates when they share a token of the shortest prefix in that order.
    Each list of documents of a token is first joined to three hubs only; what verification links is merged. The lists that
    still hold several components are gone through whole: short ones pair by pair; the documents of long ones are families,
    which are cut by the prefixes in hash order and in a second hash order and compared in blocks that give forests, so a
    group of thousands of near copies is never expanded, and no pair is skipped. 4. Whichever way a pair came, it is
    compared whole only if it shares prefix tokens in all three orders. Frequent tokens are spread over all tasks.

    The result is exact (64-bit hashes stand for shingles). Null and empty texts have no shingles and link with
    nothing; a null id has a null component and takes no part; repeated rows share their class, and rows that repeat an id
    with other texts are compared by each of their texts. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))
    if ranges is None:
        letters = base.agg(F.sum(F.length("text"))).first()[0] or 0  # some six a word, and a third of the tokens are of prefixes
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), letters // (18 * RANGE_TOKENS))
    log2 = max(0, (ranges - 1).bit_length())
    out = "batch long, kind int, part long, x binary, y binary, z binary"
    profile = save(base.mapInArrow(tidy_task(_profile(k, num, den, log2)), out), "profile")
    counts = profile.where("kind = 1").select("part", "batch", "x", "y").groupBy("part").applyInArrow(tidy_group(_count), "batch long, y binary, z binary")
    heads = profile.where("kind = 0").select("batch", "kind", "x", "y", "z")
    settled = heads.unionByName(counts.select("batch", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("x"), "y", "z"))
    meta = save(settled.groupBy("batch").applyInArrow(tidy_group(_settle(num, den)), "doc_id long, n long, digest binary, th long, alive boolean"), "meta")
    forget(profile)

    classes = meta.where("n > 0 and doc_id is not null").groupBy("n", "digest").agg(F.min(F.struct("doc_id", "th")).alias("one"), F.max("alive").alias("alive"))
    classes = save(classes.select("n", "digest", "alive", F.col("one.doc_id").alias("rid"), F.col("one.th").alias("rth")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    live = classes.where("alive").select("cid", "rid", "rth", "digest")
    sets = base.join(live, (base["id"] == live["rid"]) & (base["th"] == live["rth"])).select("cid", "digest", "text").mapInArrow(tidy_task(_sets(k)), "cid long, n long, s binary")
    sets = save(sets, "sets")
    if not sets.groupBy("cid").count().where("count > 1").isEmpty():  # rows that repeat an id with its text
        before, sets = sets, save(sets.dropDuplicates(["cid"]), "sets")
        forget(before)

    tokens = sets.mapInArrow(tidy_task(_tokens), "token long, cid long, n long")
    common = save(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    known = spread_join(tokens, common, "token", "df", F.xxhash64("cid"))
    least = F.expr(f"-floor(-{num} * n / {den})").cast("long")
    whole = Window.partitionBy("cid")
    ranked = known.withColumn("own", F.count("*").over(whole)).withColumn("at", F.row_number().over(whole.orderBy("df", "token")))
    # tokens that no other set has come first in this order, and count
    lists = ranked.where(F.col("at") <= F.col("n") - least + 1 - (F.col("n") - F.col("own"))).select("token", "cid", "n")
    lists = save(lists, "lists")
    forget(common)

    hubs = lists.groupBy("token").agg(*[F.min(F.struct(F.xxhash64("cid", F.lit(h)), "cid", "n")).alias(f"h{h}") for h in range(HUBS)], F.count("*").alias("c")).where("c > 1")
    hubs = save(hubs.select("token", F.array_distinct(F.array(*[F.struct(f"h{h}.cid", f"h{h}.n") for h in range(HUBS)])).alias("hubs"), "c"), "hubs")
    near = lambda x, y: (F.greatest(x, y) * num <= F.least(x, y) * den)
    met = spread_join(lists, hubs, "token", "c", F.xxhash64("cid")).select("cid", "n", F.explode("hubs").alias("hub"))
    met = met.where((F.col("cid") != F.col("hub.cid")) & near(F.col("n"), F.col("hub.n")))
    pairs = save(met.select(F.least("cid", "hub.cid").alias("a"), F.greatest("cid", "hub.cid").alias("b")).distinct(), "pairs")

    def verified(p: DataFrame, name: str) -> DataFrame:
        left = sets.select(F.col("cid").alias("a"), "s")
        right = sets.select(F.col("cid").alias("b"), F.col("s").alias("s2"))
        return save(p.join(left, "a").join(right, "b").select("a", "b", "s", "s2").mapInArrow(tidy_task(_verify(num, den)), "a long, b long, linked boolean"), name)

    links = verified(pairs, "links1")
    comps = components(links.where("linked").select("a", "b"))
    forget(links, hubs)
    placed = lists.join(comps, lists["cid"] == comps["node"], "left").select("token", "cid", "n", F.coalesce("component", "cid").alias("c"))
    mixed = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k"), F.min("cid").alias("head")).where("lo <> hi").select("token", "k", "head")
    mixed = save(mixed, "mixed")
    rest = save(spread_join(placed, mixed, "token", "k", F.xxhash64("cid")), "rest")
    # documents that share tokens of long lists are families: compared in blocks, no pair leaves its block
    kin = components(rest.where(F.col("k") > LONG_LIST).select(F.col("head").alias("a"), F.col("cid").alias("b")).distinct())
    family = save(kin.select(F.col("node").alias("cid"), F.col("component").alias("family")), "families")
    forget(kin, mixed)
    some = not family.isEmpty()
    if some:
        family = _narrowed(family, sets, num, den)
    in_family = family.select(F.col("cid").alias("fid"), "family")
    short = rest.where(F.col("k") <= LONG_LIST).join(in_family, F.col("cid") == F.col("fid"), "left").select("token", "cid", "n", "c", "family")
    r2 = short.select("token", F.col("cid").alias("cid2"), F.col("n").alias("n2"), F.col("c").alias("c2"), F.col("family").alias("family2"))
    apart = F.col("family").isNull() | F.col("family2").isNull() | (F.col("family") != F.col("family2"))
    more = short.join(r2, "token").where((F.col("cid") < F.col("cid2")) & (F.col("c") != F.col("c2")) & apart & near(F.col("n"), F.col("n2")))
    more = more.select(F.col("cid").alias("a"), F.col("cid2").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    pairwise = verified(more, "links2")
    links2 = pairwise.where("linked").select("a", "b")
    if some:
        links2 = save(links2.union(_families(sets, lists, family, num, den)), "links3")
    nodes = classes.select(F.col("cid").alias("node"), "rid")
    stars = comps.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    if not links2.isEmpty():
        before, comps = comps, components(stars.union(links2))
        forget(before)
    forget(sets, lists, pairs, rest, family, pairwise, links2)
    comps = with_names(comps, nodes, "rid").select("node", F.col("rid").alias("name"))
    of_class = classes.join(comps, classes["cid"] == comps["node"], "left").select(F.col("n").alias("cn"), F.col("digest").alias("cd"), F.coalesce("name", "rid").alias("component"))
    own = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component"))
    return meta.join(of_class, (meta["n"] == of_class["cn"]) & (meta["digest"] == of_class["cd"]), "left").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
