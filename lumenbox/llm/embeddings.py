"""Near-duplicate vectors: random-hyperplane sign hashes, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .components import Forest, components, with_names
from .store import bounded_batches, forget, save, spread_join
from .words import mix

#: A pair at the threshold is missed with at most this probability.
MISS = 1e-6
#: Classes of one bucket that are compared as one block.
BLOCK = 512


def table_plan(rows: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """(bits a table, tables): buckets of one row or so if they spread evenly, and tables enough that a pair at the
    threshold agrees in none with probability ``miss`` at most. Holds at every size; only the cost changes."""
    bits = min(30, max(6, math.ceil(math.log2(max(rows, 1)))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


@lru_cache(maxsize=8)
def _planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.rint(np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables)) * 1024)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which brings the largest component to 1/2 or more, below 1: exact, and squares stay finite."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def _keys(labels: list[str], v: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """For each row and table the bucket, as a hash of label, dimensions, table and signs. The signs are those of whole
    numbers, of which no sum is rounded, so they are the same in whatever batch a row comes."""
    dim = v.shape[1]
    on = (np.rint(v * (1 << 20)) @ _planes(dim, bits, tables, seed) > 0).reshape(len(v), tables, bits)
    sig = (on * (1 << np.arange(bits, dtype=np.uint64))).sum(2).astype(np.uint64)
    own = np.array([xxhash.xxh3_64_intdigest(f"{dim}:{x}") for x in labels], np.uint64)
    return mix(own[:, None] ^ mix((np.arange(tables, dtype=np.uint64) << np.uint64(32)) | sig)).view(np.int64)


def _vectors(column: pa.Array) -> np.ndarray:
    return _scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def _spread(bits: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch["dim"].to_pylist(), np.int64)
            for d in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                keys = _keys(part["label"].to_pylist(), _vectors(part["v"]), bits, tables, seed)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(part["cid"].to_numpy(), tables))], ["key", "cid"])

    return run


def _compare(cosine: float, bits: int, tables: int, seed: int):
    """Rows sorted by bucket and block: all pairs of a block, each in the first table only in which they share a bucket.

    Gives sums of links by class and, of the linked pairs, a forest; not the pairs.
    """

    def block(rows: pa.Table, run_of: np.ndarray) -> Iterator[pa.RecordBatch]:
        cid, m, key = rows["cid"].to_numpy(), rows["m"].to_numpy(), rows["key"].to_numpy()
        two, side = rows["two"].to_numpy(zero_copy_only=False), rows["side"].to_numpy()
        names = rows["label"].to_pylist()
        code = {x: i for i, x in enumerate(dict.fromkeys(names))}
        label = np.array([code[x] for x in names])
        dims = rows["dim"].to_numpy()
        column = rows["v"].combine_chunks()
        v, keys = np.zeros((len(rows), int(dims.max()))), np.zeros((len(rows), tables), np.int64)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            part = _vectors(column.take(pa.array(at)))
            v[at, :d] = part
            keys[at] = _keys([names[i] for i in at], part, bits, tables, seed)
        norm = np.sqrt((v * v).sum(1))
        links, forest = np.zeros(len(rows), np.int64), Forest()
        most = int(np.bincount(run_of).max())
        for d in range(1, most):
            i = np.flatnonzero(run_of[:-d] == run_of[d:])
            i = i[(~two[i] | (side[i] != side[i + d])) & (label[i] == label[i + d]) & (dims[i] == dims[i + d])]
            for a in range(0, len(i), 20_000):
                x = i[a : a + 20_000]
                y = x + d
                first = (keys[x] == keys[y]).argmax(1)
                here = keys[x, first] == key[x]
                x, y = x[here], y[here]
                near = (v[x] * v[y]).sum(1) / (norm[x] * norm[y]) >= cosine
                x, y = x[near], y[near]
                np.add.at(links, x, m[y])
                np.add.at(links, y, m[x])
                for p, q in zip(cid[x].tolist(), cid[y].tolist(), strict=True):
                    forest.join(p, q)
        got = np.flatnonzero(links)
        who, at = np.unique(cid[got], return_inverse=True)
        total = np.bincount(at, links[got]).astype(np.int64) if len(got) else np.zeros(0, np.int64)
        edges = [(forest.find(x), x) for x in forest.up]
        edges = [(r, x) for r, x in edges if r != x]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([who, [r for r, _ in edges]]).astype(np.int64)), pa.array([*[None] * len(who), *[x for _, x in edges]], pa.int64()), pa.array([*total.tolist(), *[None] * len(edges)], pa.int64())], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def keys(rows: pa.Table) -> np.ndarray:
            return np.stack([rows[k].to_numpy() for k in ("key", "i", "j")], 1)

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < 4000:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            k = keys(rows)
            new = (k[1:] != k[:-1]).any(1)
            cut = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            if cut:
                yield from block(rows.slice(0, cut), np.concatenate([[0], np.cumsum(new[: cut - 1])]))
            rest = rows.slice(cut)
            held, n = rest.to_batches(), len(rest)
        if n:
            rows = pa.Table.from_batches(held).combine_chunks()
            k = keys(rows)
            yield from block(rows, np.concatenate([[0], np.cumsum((k[1:] != k[:-1]).any(1))]))

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, seed: int = 1) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: vectors of equal label link at a cosine of at least ``cosine``,
    taken in double precision, whatever their length and however large or small their components.

    Equal vectors of a label are one class from the start and count as links of one another. Classes are hashed
    by the signs of random projections in several tables. Of the tables only (bucket, class) is shuffled; vectors are
    fetched for buckets of two classes or more. A bucket is compared in blocks of about 512 classes,
    a large one block against block, so none is gathered in one task, and no pair leaves its block: blocks give
    counts and forests. Each pair found has been verified; a pair at the threshold is missed with probability
    1e-6 at most, a closer one with less.

    A null label, or a vector that is null, empty, zero, or holds null or non-finite numbers links with nothing:
    n_links 0, its own id. Labels of any type are compared as they are written. Vectors of different lengths do not link.
    Rows of null id take part as members without a name: they count as links and join others; component_id is the
    smallest id reached, null if there is none, and kept is false. Rows repeated with their id are links of one another.
    An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = getattr(vectors.schema[vector_col].dataType, "elementType", None)
    v = F.col(vector_col).cast("array<float>" if isinstance(kind, FloatType) else "array<double>")  # as they came; all sums are of doubles
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"), F.coalesce(fine & F.col(label_col).isNotNull(), F.lit(False)).alias("fine"))
    classes = rows.where("fine").groupBy("label", "v").agg(F.min("id").alias("rid"), F.count("*").alias("m"))
    classes = save(classes.withColumn("dim", F.size("v").cast("long")).withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    n = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = table_plan(n, cosine)
    keyed = save(classes.select("cid", "label", "dim", "v").mapInArrow(_spread(bits, tables, seed), "key long, cid long"), "vector-keys")
    shared = save(keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "vector-buckets")
    placed = spread_join(keyed, shared, "key", "c", F.xxhash64("cid")).withColumn("c", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("side", F.pmod(F.xxhash64("cid"), F.col("c")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    placed = placed.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).withColumn("two", F.col("i") != F.col("j")).drop("c", "other")
    placed = placed.join(classes.select("cid", "label", "dim", "v", "m"), "cid").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = save(placed.mapInArrow(_compare(cosine, bits, tables, seed), "a long, b long, links long"), "vector-links")
    forget(keyed, shared)
    links = found.where("b is null").groupBy(F.col("a").alias("lid")).agg(F.sum("links").alias("links"))
    comps = with_names(components(found.where("b is not null").select("a", "b")), classes.select(F.col("cid").alias("node"), "rid"), "rid").select("node", "component", F.col("rid").alias("name"))
    named = classes.join(links, classes["cid"] == links["lid"], "left").join(comps, classes["cid"] == comps["node"], "left")
    own = F.when(F.col("component").isNotNull(), F.col("name")).otherwise(F.col("rid"))
    named = named.select(F.xxhash64("label", "v").alias("ck"), F.col("label").alias("cl"), F.col("v").alias("cv"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), own.alias("component"))
    whole = rows.withColumn("jk", F.when(F.col("fine"), F.xxhash64("label", "v")).otherwise(F.monotonically_increasing_id())).withColumn("jl", F.when(F.col("fine"), F.col("label"))).withColumn("jv", F.when(F.col("fine"), F.col("v")))
    out = whole.join(named, (whole["jk"] == named["ck"]) & (whole["jl"] == named["cl"]) & (whole["jv"] == named["cv"]), "left")
    component = F.when(F.col("fine"), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
