"""Connected components of links, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, save, spread_join

EDGE = "a long, b long"


class Forest:
    """Union-find in which the smallest member names a set."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if y < x:
            x, y = y, x
        self.up[y] = x
        self.up.setdefault(x, x)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of links becomes stars, of one link a node at most; state is kept for one batch only."""
    for batch in batches:
        f = Forest()
        for x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            f.join(x, y)
        stars = [(f.find(x), x) for x in f.up]
        stars = [(r, x) for r, x in stars if r != x]
        yield pa.RecordBatch.from_pydict({"a": pa.array([r for r, _ in stars], pa.int64()), "b": pa.array([x for _, x in stars], pa.int64())})


#: Links up to which no node can have more than one task takes.
PLAIN_LINKS = 1_000_000


def _with_least(rows: DataFrame, few: bool) -> DataFrame:
    """Rows (x, y) with m, the least y of their x. A node that many rows have is spread over all tasks."""
    if few:
        return rows.join(rows.groupBy("x").agg(F.min("y").alias("m")), "x")
    least = save(rows.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")), "least")
    return spread_join(rows, least, "x", "n", F.xxhash64("y")).drop("n")


def components(links: DataFrame, rounds: int = 60, plain: int = PLAIN_LINKS) -> DataFrame:
    """(node, component) of all nodes in ``links`` (a, b): the smallest node reachable, itself included.

    Loops, repeated links and either direction are allowed; a link with a null end is no link. Each round is
    two map-side-combined minima and two joins; its result is written to the shared folder. Beyond ``plain`` links a node
    may have more than a task should take: the rows of such nodes, as the centre of a large star, go to all tasks.
    Links never reach the driver, only a count and a checksum.
    """
    edges = links.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a < b")
    edges = save(edges.mapInArrow(_contract, EDGE).distinct(), "links")
    check = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = check(edges)
    for _ in range(rounds):
        few = seen[0] <= plain
        both = edges.select(F.col("b").alias("x"), F.col("a").alias("y")).union(edges.select(F.col("a").alias("x"), F.col("b").alias("y")))
        large = _with_least(both, few).where("y > x").select(F.col("y").alias("x"), F.least("x", "m").alias("y")).where("x <> y").distinct()
        if not few:
            large = save(large, "large-stars")
        small = _with_least(large, few).select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("b"), F.col("m").alias("a"))
        before, edges = edges, save(small.where("a < b").select("a", "b").distinct(), "stars")
        forget(before, *([] if few else [large]))
        now = check(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    out = edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    out._tables = edges._tables
    return out


def with_names(comps: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(node, component, ``name``) of the result of ``components``, where ``nodes`` has (node, ``name``): the smallest name in
    the component, or null where none of its nodes has one."""
    stars, comps = comps, save(comps, "components")
    forget(stars)
    names = comps.join(nodes, "node").groupBy("component").agg(F.min(name).alias(name), F.count("*").alias("__nodes"))
    return spread_join(comps, save(names, "component-names"), "component", "__nodes", F.xxhash64("node")).select("node", "component", name)
