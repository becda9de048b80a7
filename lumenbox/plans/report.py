"""Statistics and checks over a corpus: what verification and sweeps report, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits

SIZE_CLASSES = ((256, "<256"), (1024, "<1K"), (4096, "<4K"), (16384, "<16K"), (65536, "<64K"))
COUNT_CLASSES = ((1, "1"), (4, "2-4"), (16, "5-16"))


def size_class(size: Column) -> Column:
    out = F.lit(">=64K")
    for most, name in reversed(SIZE_CLASSES):
        out = F.when(size < most, name).otherwise(out)
    return out


def count_class(n: Column) -> Column:
    """Files without tiles are counted with those of one."""
    out = F.lit(">16")
    for most, name in reversed(COUNT_CLASSES):
        out = F.when(n <= most, name).otherwise(out)
    return out


def tile_size_range(tiles: DataFrame) -> DataFrame:
    at = F.struct("size", "path", "tg_index", "tile_num")
    return tiles.agg(F.count("*").alias("tiles"), F.sum("size").alias("total"), F.min("size").alias("smallest"), F.min(at)["path"].alias("smallest_path"), F.max("size").alias("largest"))


def tile_size_histogram(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy(size_class(F.col("size")).alias("size_class")).agg(F.count("*").alias("tiles"))


def tiles_per_file(files: DataFrame, tiles: DataFrame) -> DataFrame:
    each = tiles.groupBy("path").agg(F.count("*").alias("n"))
    return files.select("path").join(each, "path", "left").groupBy(count_class(F.coalesce("n", F.lit(0))).alias("count_class")).agg(F.count("*").alias("files"))


def obu_type_counts(obus: DataFrame) -> DataFrame:
    return obus.groupBy("path", "obu_type", "obu_type_name").agg(F.count("*").alias("n"), F.min(F.struct("obu_no", "payload_off", "payload_size")).alias("first"))


def corpus(status: DataFrame) -> DataFrame:
    """Counters over (path, extract_status, stage_status): a file whose payload wasn't extracted is skipped by the stage."""
    ok = F.col("extract_status") == "OK"
    stage = F.col("stage_status") == "OK"
    return status.agg(F.count("*").alias("total"), F.count_if(ok).alias("extract_ok"), F.count_if(~ok).alias("extract_fail"), F.count_if(ok & stage).alias("stage_ok"), F.count_if(ok & ~stage).alias("stage_fail"), F.count_if(~ok).alias("stage_skip"))


def top_reasons(rows: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent reasons; ties by text."""
    return rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(n)


def by_status(rows: DataFrame) -> DataFrame:
    """Subtotals by stage, severity and message (an extension)."""
    return rows.rollup("stage", "severity", "message").agg(F.count("*").alias("n"))


def check_failures(checks: DataFrame) -> DataFrame:
    return checks.groupBy("check").agg(F.count_if(~F.col("ok")).alias("tiles_failed"), F.count_distinct(F.when(~F.col("ok"), F.col("path"))).alias("files_failed"))


def primary_properties(tables, carry: tuple[str, ...] = ()) -> DataFrame:
    """(path, the columns to ``carry``, ispe, pixi, av1c) of primary items: the first of each that the item names, by place
    in the file's own row. Files without a primary item give no row."""
    item = F.try_element_at(F.filter("items", lambda i: i["item_id"] == F.col("meta.primary_item_id")), F.lit(1))
    at = lambda a: F.when((a["prop_index"] > 0) & (a["prop_index"] <= F.size("properties")), F.try_element_at("properties", a["prop_index"]))
    named = tables.nested.withColumn("item", item).where("item is not null").withColumn("named", F.transform("item.props", at))
    first = lambda c: F.try_element_at(F.filter(F.transform("named", lambda p: p[c]), lambda x: x.isNotNull()), F.lit(1)).alias(c)
    return named.select("path", *carry, first("ispe"), first("pixi"), first("av1c"))


def pixi_check(primary: DataFrame, strict: bool = True) -> DataFrame:
    """(path, ok, reason): channels and depths stated twice must agree. ``strict``: both must be there; otherwise a
    missing pixi is fine, and as many depths as channels are needed."""
    depth, channels = bits.av1c_bit_depth(F.col("av1c")), bits.av1c_channels(F.col("av1c"))
    missing = F.when(F.col("av1c").isNull(), "missing av1C").when(F.col("pixi").isNull(), "missing pixi") if strict else F.when(F.col("pixi").isNull(), F.lit(None).cast("string")).when(F.col("av1c").isNull(), "missing av1C")
    rest = F.when(F.col("pixi").isNull(), F.lit(None).cast("string")).when(F.col("pixi.channels") != channels, "pixi channels != av1C channels")
    if not strict:
        rest = rest.when(F.size("pixi.depths") < channels, "too few pixi depths")
    rest = rest.when(~F.forall("pixi.depths", lambda d: d == depth), "pixi depth != av1C bit depth")
    return primary.withColumn("reason", F.coalesce(missing, rest)).select("path", F.col("reason").isNull().alias("ok"), "reason")


def same_payload(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, ok): two ways to extract agree byte for byte; compared by digests, so no payload is shuffled."""
    d = lambda x, n: x.select("path", F.sha2("payload", 256).alias(n))
    return d(a, "a").join(d(b, "b"), "path", "full").select("path", F.col("a").eqNullSafe(F.col("b")).alias("ok"))


def dims_check(headers: DataFrame, manifest: DataFrame, base: Column, preset: Column) -> DataFrame:
    size = bits.shown_size(F.col("upscaled_width"), F.col("coded_width"), F.col("coded_height"))
    shown = headers.select(base.alias("base"), preset.alias("preset"), size["width"].alias("w"), size["height"].alias("h"))
    return manifest.join(shown, ["base", "preset"], "left").select("base", "preset", ((F.col("w") == F.col("width")) & (F.col("h") == F.col("height"))).alias("ok"))


def totals(checks: DataFrame) -> DataFrame:
    """(check, passed, failed, total) of a table (check, ok), and a row of all checks whose name is null; no answer is a failure."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return checks.rollup("check").agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.count("*").alias("total"))


def offset_check(tiles: DataFrame, starts: DataFrame, size_bytes: Column | int) -> DataFrame:
    """(path, tg_index, tile_num, ok): a tile begins where the one before it ended and its size field is over. ``starts``:
    (path, tg_index, first) with the offset after the group's flags."""
    group = Window.partitionBy("path", "tg_index").orderBy("tile_num")
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    fields = F.row_number().over(group) - F.when(F.lead(F.lit(1)).over(group).isNull(), 1).otherwise(0)
    ran = tiles.withColumn("ahead", F.coalesce(F.sum("size").over(before), F.lit(0)) + fields * size_bytes)
    return ran.join(starts, ["path", "tg_index"]).select("path", "tg_index", "tile_num", (F.col("offset") == F.col("first") + F.col("ahead")).alias("ok"))


def offset_checks(streams: DataFrame, size_bytes: int) -> DataFrame:
    """``offset_check`` of streams of one tile group each, (path, tiles, first): the tiles of a stream are in one row, in the order
    of their numbers, so nothing is shuffled."""
    ends = F.aggregate("tiles", F.array("first"), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t["size"] + size_bytes)))
    at = lambda t, i: F.col("ends")[i] + F.when(i == F.size("tiles") - 1, 0).otherwise(size_bytes)
    each = streams.withColumn("ends", ends).select("path", F.explode(F.transform("tiles", lambda t, i: F.struct(t["tg_index"].alias("tg_index"), t["tile_num"].alias("tile_num"), (t["offset"] == at(t, i)).alias("ok")))).alias("t"))
    return each.select("path", "t.*")


def expected_tiles(tiles: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, ok) of each path in either table of (path, tile_num, size): whether both have the same tiles."""
    a = tiles.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("tile_num", "size"))).alias("got"))
    b = expected.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("tile_num", "size"))).alias("want"))
    return a.join(b, "path", "full").select("path", F.col("got").cast("string").eqNullSafe(F.col("want").cast("string")).alias("ok"))


def milestones(tables: dict[str, DataFrame]) -> DataFrame:
    """Whether each column of each table was seen with a value at least once."""
    out = None
    for name, t in tables.items():
        one = t.agg(*[F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)).alias(c) for c in t.columns])
        one = one.select(F.lit(name).alias("table"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("seen")) for c in t.columns])).alias("x")).select("table", "x.*")
        out = one if out is None else out.unionAll(one)
    return out


def timings(runs: DataFrame) -> DataFrame:
    """(stage, files, total_ms, mean_ms) of a table (path, stage, ms): means are over runs."""
    return runs.groupBy("stage").agg(F.count_distinct("path").alias("files"), F.sum("ms").alias("total_ms"), F.avg("ms").alias("mean_ms"))
