"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import forget, save

WORD = r"[^\x20\x09-\x0D]+"
#: A rank key has this many bits, looked through in rounds of STEP bits.
KEY_BITS, STEP = 48, 12


def _ahead(rows: DataFrame, order: list[Column], **sums: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with, by new name, the sum of a column over all rows before a row in ``order``; and the saved table behind them.

    Rows are put in order by ranges; sums run within a range, and those of the ranges before, of which there are as many as
    partitions, are added. No task sees more than a range.
    """
    placed = save(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    whole = placed.groupBy("__range").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select(F.col("__range").alias("__r"), *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items()])
    out = out.join(starts, out["__range"] == starts["__r"]).select(*rows.columns, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums])
    return out, placed


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat over the sources by code point,
    null last; all words are shared by weight, a target stops at ``most`` times its source's size and the excess
    is shared anew by weight until none is above.

    Sources sorted by size over weight reach their caps in that order, so the first that stays below its cap at
    the level of what is left over gives the level for all after it. Sources may be many, such as hosts: they are
    ordered by ranges, and one row reaches the driver. All sums are integers, a target is one division.
    """
    ranked, a = _ahead(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], at="one")
    w = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("at") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("w", w).withColumn("ratio", F.col("source_size") / F.col("w")).withColumn("cap", F.col("source_size") * most).drop("one", "at")
    # nulls last among equals, as a pair that can be compared
    ranked = ranked.withColumn("none", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))
    place = ["ratio", "w", "none", "name"]
    t, b = _ahead(ranked, [F.col(c).asc() for c in place], caps="cap", ws="w")
    words, all_w = (x or 0 for x in ranked.agg(F.sum("source_size"), F.sum("w")).first())
    t = save(t.withColumn("rest", F.lit(words) - F.col("caps")).withColumn("w_rest", F.lit(all_w) - F.col("ws")), "levels")
    forget(a, b)
    first = t.where(F.col("rest") * F.col("w") <= F.col("cap") * F.col("w_rest")).agg(F.min(F.struct(*place, "rest", "w_rest"))).first()[0]
    target = F.col("cap").cast("double")
    if first is not None:
        under = F.struct(*place) >= F.struct(*[F.lit(first[c]).cast(t.schema[c].dataType).alias(c) for c in place])
        target = F.when(under, (F.col("w") * F.lit(first["rest"])).cast("double") / F.lit(float(first["w_rest"]))).otherwise(target)
    out = t.select("source", "source_size", target.alias("target"))
    out._tables = t._tables
    return out


def _random(id_col: str, text_col: str, seed: str):
    """Uniform in (0, 1), from the row's id (of a null id, from its text): reruns agree."""
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")))
    return (F.conv(F.substring(F.md5(F.encode(F.concat(F.lit(seed), name), "UTF-8")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def _measured(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _rank_key():
    """A row's place by random odds over inclusion odds, as an integer; null for rows that may not be drawn or must be."""
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("pi") / (1 - F.col("pi")))
    key = F.least(F.floor(odds / (1 + odds) * F.lit(float(1 << KEY_BITS))), F.lit((1 << KEY_BITS) - 1)).cast("long")
    return F.when((F.col("pi") > 0) & (F.col("pi") < 1), key)


def _copies():
    drawn = (F.col("key") < F.col("edge")) | ((F.col("key") == F.col("edge")) & F.col("edge_in"))
    return F.col("whole") + F.coalesce(drawn, F.lit(False)).cast("long")


def _length_class(size):
    """The measure of a document's inclusion: the binary digits of its words, at least 1, and 63 at most."""
    return F.length(F.bin(F.greatest(size, F.lit(1))))


def _expected(classes: DataFrame, most: int) -> DataFrame:
    """(source, source_size, target, v, words, lam): the copies that a document of each length class is to have.

    They are in proportion to v, up to ``most``, so that a source's come to its target. The longest class reaches the
    cap first; the first that stays below it at the level of what is left over gives the level for all after it. A
    source has 63 classes at most. Sums are integers, and a level is one product and one division.
    """
    of = Window.partitionBy("source")
    order = of.orderBy(F.desc("v"))
    ahead = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = classes.withColumn("rest", F.col("target") - ahead * most).withColumn("need", F.sum(F.col("v") * F.col("words")).over(order.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("first", F.max(F.when(F.col("rest") * F.col("v") <= F.col("need") * most, F.struct("v", "rest", "need"))).over(of))
    level = F.when(F.col("first.need") > 0, F.col("first.rest") * F.col("v") / F.col("first.need").cast("double")).otherwise(0.0)
    return t.withColumn("lam", F.when(F.col("v") <= F.col("first.v"), level).otherwise(F.lit(float(most)))).select("source", "source_size", "target", "v", "words", "lam")


def _decisions(each: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(s, c, source_size, target, whole, pi, left, edge, edge_in): one row a source and length class c, from
    (source, size, v, u) of all rows."""
    classes = save(each.groupBy("source", "v").agg(F.sum("size").alias("words")), "classes")
    each_target = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    targets = each_target.withColumnRenamed("source", "t")
    plan = _expected(classes.join(targets, classes["source"].eqNullSafe(targets["t"])).drop("t"), most)
    plan = plan.withColumn("whole", F.least(F.floor("lam"), F.lit(most)).cast("long")).withColumn("pi", F.col("lam") - F.col("whole"))
    plan = plan.withColumn("left", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source"))).drop("words", "lam")
    plan = save(plan, "plan")

    p = plan.where("pi > 0 and pi < 1").select(F.col("source").alias("s"), F.col("v").alias("c"), "pi", "left")
    ranked = each.join(p, each["source"].eqNullSafe(p["s"]) & (each["v"] == p["c"])).select("source", "size", "left", _rank_key().alias("key"))
    # (source, at: the bits found so far, before: words ranked ahead of them)
    found, ranks = None, []
    for done in range(0, KEY_BITS, STEP):
        shift = KEY_BITS - STEP - done
        here = ranked
        if found is not None:
            f = found.select(F.col("source").alias("s"), "at", "before")
            here = ranked.join(f, ranked["source"].eqNullSafe(f["s"]) & (F.shiftright("key", shift + STEP) == f["at"])).drop("s")
        else:
            here = here.withColumn("before", F.lit(0).cast("long"))
        bins = here.groupBy("source", "left", "before", F.shiftright("key", shift).alias("at")).agg(F.sum("size").alias("words"))
        w = Window.partitionBy("source").orderBy("at")  # 4,096 rows a source at most
        bins = bins.withColumn("upto", F.col("before") + F.sum("words").over(w))
        last = F.row_number().over(Window.partitionBy("source").orderBy((F.col("upto") < F.col("left")).cast("int"), F.when(F.col("upto") >= F.col("left"), F.col("at")).otherwise(-F.col("at"))))
        found = bins.withColumn("r", last).where("r = 1").select("source", "at", (F.col("upto") - F.col("words")).alias("before"), "upto", "left")
        found = save(found, f"rank{done}")
        ranks.append(found)
    include = F.abs(F.col("upto") - F.col("left")) <= F.abs(F.col("left") - F.col("before"))
    edge = found.select(F.col("source").alias("e_source"), F.col("at").alias("edge"), include.alias("edge_in"))
    out = save(plan.join(edge, plan["source"].eqNullSafe(edge["e_source"]), "left").drop("e_source").withColumnRenamed("source", "s").withColumnRenamed("v", "c"), "decisions")
    forget(classes, each_target, plan, *ranks)
    return out


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix:",
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each row of ``docs``.

    The expected copies of a source's documents are in proportion to the binary digits of their length, up to
    ``most``, and come to its target: a longer document is likelier, one of 1,000 words (10 digits) twice as likely as
    one of 20 (5 digits). The whole part is certain; for the remainder, a source's documents are ranked by their random
    odds over their inclusion odds (Pareto order sampling) and taken in that order up to the words that are left, the
    last one if that comes nearer, so a sample's size is fixed. The last rank taken is found by histograms over the
    bits of the rank, one map-side-combined aggregate of at most 4,096 bins a source each, so no source is ever sorted
    or gathered in a task.

    size is the number of runs of other than ASCII white space in the text, 0 for null. Sources are grouped by
    equal string, null being one of its own. Rows that repeat an id share one fate if their source is the same.
    Without words every target is 0. An empty table gives no rows; other columns are ignored. Reruns agree:
    chance comes from the id.
    """
    each = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), _measured(text_col).alias("size"), _random(id_col, text_col, seed).alias("u"))
    each = save(each.withColumn("v", _length_class(F.col("size"))), "mix")
    d = _decisions(each, weights, most)
    out = each.join(d, each["source"].eqNullSafe(d["s"]) & (each["v"] == d["c"])).withColumn("key", _rank_key()).withColumn("copies", _copies())
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix:",
) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it, with the same rules for nulls, empties, repeated rows and
    empty tables. A row's own chance and its source's decision are all that is needed, so texts are not shuffled."""
    each = docs.select(F.col(source_col).cast("string").alias("source"), _measured(text_col).alias("size"), _random(id_col, text_col, seed).alias("u"))
    each = save(each.withColumn("v", _length_class(F.col("size"))), "mix")
    d = _decisions(each, weights, most).select("s", "c", "whole", "pi", "edge", "edge_in")
    forget(each)
    d = d.select(*[F.col(c).alias(f"__{c}") for c in d.columns])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(row, F.col(source_col).cast("string").alias("__source"), _length_class(_measured(text_col)).alias("__v"), _random(id_col, text_col, seed).alias("__u"))
    with_all = rows.join(d, rows["__source"].eqNullSafe(d["__s"]) & (rows["__v"] == d["__c"]))
    named = with_all.select("__row", *[F.col(f"__{c}").alias(c) for c in ("u", "whole", "pi", "edge", "edge_in")]).withColumn("key", _rank_key())
    return named.where(_copies() > 0).select("__row", F.explode(F.sequence(F.lit(1), _copies().cast("int"))).alias("__n")).select("__row.*")
