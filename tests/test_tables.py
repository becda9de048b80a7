"""The tables, functions and reports on a session, and every query against its oracle."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from lumenbox import fixtures as fx
from lumenbox import sql
from lumenbox.functions import bits
from lumenbox.operators import containers, streams, tables
from lumenbox.plans import queries, report, sinks, views
from lumenbox.sources import files
from lumenbox.streaming import front

DATA = "/root/testdata/sf0.001"
STREAM = queries._GOOD


def _files(spark, *contents):
    return spark.createDataFrame([(f"/f{i}.avif", c) for i, c in enumerate(contents)], "path string, content binary")


def _same(a, b):
    cols = sorted(a.column_names)
    assert cols == sorted(b.column_names)
    show = lambda v: None if v is None or v != v else (float(v) if isinstance(v, (int, float)) else v)
    rows = lambda t: sorted(([show(r[c]) for c in cols] for r in t.to_pylist()), key=repr)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    _same(queries.QUERIES[name](spark, DATA).toArrow(), con.sql(queries.ORACLES[name]).to_arrow_table())


@pytest.mark.parametrize("data,reason", queries.MUTATIONS[:11])
def test_reasons(spark, data, reason):
    (row,) = tables.payloads(_files(spark, data)).collect()
    assert row.reason == reason and (row.status == "OK") == (reason is None)
    assert row.payload == (STREAM if reason is None else None)


@pytest.mark.parametrize(
    "how,reason",
    [
        ({"method": 3}, "iloc construction_method=3 unsupported"), ({"index_size": 4}, "extent_index present (unsupported in m1)"), ({"idat": True, "extents": [(999, 1)]}, "idat extent offset out of range"),
        ({"idat": True, "extents": [(1, 999)]}, "idat extent overruns idat payload"), ({"idat": True, "pieces": 4}, None), ({"iloc_version": 2, "pieces": 3}, None), ({"iloc_version": 0}, None),
    ],
)
def test_more_reasons(spark, how, reason):
    (row,) = tables.payloads(_files(spark, fx.still(STREAM, **how))).collect()
    assert row.reason == reason and row.payload == (STREAM if reason is None else None)


def test_m2_takes_indexed_extents(spark):
    f = _files(spark, fx.still(STREAM, index_size=4))
    assert tables.payloads(f, "m2").first().payload == STREAM
    assert report.same_payload(tables.payloads(_files(spark, fx.still(STREAM))), tables.payloads(_files(spark, fx.still(STREAM)), "m2")).first().ok


def test_modes_and_nulls(spark):
    f = _files(spark, fx.still(STREAM), b"\0\0\0\7free", None, b"")
    assert tables.boxes(f, mode=tables.DROPMALFORMED).select("path").distinct().count() == 1
    assert ("/f1.avif", "invalid box size=7 < header_size=8") in [(r.path, r.message) for r in tables.box_diagnostics(f).collect()]
    with pytest.raises(Exception, match="invalid box size=7"):
        tables.boxes(f, mode=tables.FAILFAST).collect()
    assert {r.path: r.reason for r in tables.payloads(f).collect()}["/f2.avif"] == "no top-level 'meta' box found"
    assert tables.MetaTables(f.limit(0)).items.count() == 0


def test_meta_tables(spark):
    m = tables.MetaTables(_files(spark, fx.still(STREAM, pieces=2)))
    assert m.items.select("item_id", "is_primary", "extent_count", "prop_count").first() == (1, True, 2, 3)
    assert m.properties.count() == 3 and m.item_props.count() == 3 and m.extents.count() == 2 and m.diagnostics.count() == 0
    assert [r.type for r in m.resolved.orderBy("assoc_no").collect()] == ["ispe", "pixi", "av1C"]
    gone = tables.MetaTables(_files(spark, fx.full(b"meta", 0, 0, fx.box(b"iprp", fx.box(b"ipco"), fx.ipma([(1, [(0, False), (5, False)])])))))
    assert [r.type for r in gone.resolved.collect()] == [None, None]


def test_stream_tables_and_reports(spark):
    s = tables.StreamTables(queries._golden(spark), keep_content=True)
    t = s.tiles
    assert t.where("path = '2x2_alltiles_flag0'").orderBy("tile_num").select("mi_col_start", "mi_col_end", "mi_row_start", "mi_row_end").collect() == [(0, 16, 0, 16), (16, 32, 0, 16), (0, 16, 16, 32), (16, 32, 16, 32)]
    assert s.tile_groups.where("tg_index = 1").count() == 9 and s.frame_headers.where("base_q_idx is null").count() == 9
    checks = tables.tile_checks(t, "trailing").unionAll(tables.tile_checks(t, "exit"))
    failed = {r.check: (r.tiles_failed, r.files_failed) for r in report.check_failures(checks).collect()}
    assert failed["trailing"][1] <= failed["exit"][1]
    assert {r["table"] + "." + r.column: r.seen for r in report.milestones({"f": s.frame_headers}).collect()}["f.coded_width"]
    assert report.obu_type_counts(s.obus).where("obu_type = 1 and n = 1").count() == 9
    named = sinks.tile_file_names(t).where("path = '1tile'").first()
    assert named.file_name == "tg1_tile0_r0_c0.bin" and bytes(named.payload) == bytes.fromhex("11223344")
    assert "coded_width=64" in sinks.header_text(s.frame_headers).where("path = '1tile'").first().line
    assert sinks.tile_text(t).where("path = '1tile'").first().line.endswith("[13+4]")


def test_text_views(spark, tmp_path):
    f = _files(spark, fx.still(STREAM, pieces=9))
    assert sinks.box_text(tables.boxes(f)).orderBy("box_seq").first().line == "[0+24] ftyp"
    m = tables.MetaTables(f)
    assert "more)" in sinks.extents_text(m).first().line and "coded 'av01'" in sinks.meta_text(m).first().line
    p = tables.payloads(f)
    assert sinks.ivf_files(p, p.selectExpr("path", "64 width", "64 height")).first().ivf[44:] == STREAM
    assert tables.payload_checks(p).first().sequence_headers == 1
    (written,) = sinks.write_payloads(p, str(tmp_path / "out")).collect()
    assert open(written.file, "rb").read() == STREAM and written.bytes == len(STREAM)


def test_scan_manifest_and_sql(spark, tmp_path):
    for name in ("a.avif", "sub/b.avif", "generated/c.avif", "d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(fx.still(STREAM))
    assert files.scan(spark, str(tmp_path)).count() == 2 and files.scan(spark, str(tmp_path), include_generated=True).count() == 3
    assert files.scan(spark, str(tmp_path), limit=1).first().path.endswith("a.avif")
    (tmp_path / "m.txt").write_text("# c\nx q90 3 4 a b c\nshort\n")
    assert files.manifest(spark, str(tmp_path / "m.txt")).select("base", "width").collect() == [("x", 3)]
    plan = files.scan(spark, str(tmp_path)).where("length > 5").select("path", "length")._jdf.queryExecution().toString()
    assert "content" not in plan.split("Physical Plan")[1]
    sql.register(spark)
    files.scan(spark, str(tmp_path)).createOrReplaceTempView("scanned")
    assert spark.sql("SELECT count(*) n FROM scanned, LATERAL media_boxes(content) b WHERE b.type = 'av1C'").first().n == 2
    spark.createDataFrame([(STREAM,)], "payload binary").createOrReplaceTempView("one_stream")
    assert spark.sql("SELECT t.size, av1_tile_ok(X'80', 0) ok FROM one_stream, LATERAL av1_tiles(payload) t").first() == (1, True)
    one = lambda name, view="scanned", column="content": spark.sql(f"SELECT t.* FROM {view}, LATERAL {name}({column}) t")
    want = {"media_meta": 2, "media_items": 2, "media_extents": 2, "media_item_props": 6, "media_properties": 6, "media_diagnostics": 0}
    want |= dict.fromkeys(("av1_sequence_header", "av1_frame_header", "av1_tile_info", "av1_tile_groups", "av1_tiles", "av1_tile_probe"), 1) | {"av1_obus": 3}
    for name, n in want.items():
        got = one(name) if name.startswith("media") else one(name, "one_stream", "payload")
        assert got.count() == n and got.columns == [f.name for f in _parse_datatype_string(sql.FUNCTIONS[name][0])], name
    assert one("media_properties").where("type = 'ispe'").first().ispe.width == 64 and one("media_items").first().props[2].essential
    assert one("media_extents").first().length == len(STREAM) and one("av1_tile_probe", "one_stream", "payload").first().status == "UNSUPPORTED"
    sql.payload_view(spark, "scanned", "taken")
    assert spark.sql("SELECT DISTINCT payload, status FROM taken").collect() == [(STREAM, "OK")]


def test_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.avif").write_bytes(fx.still(STREAM))
    q = front.write(tables.boxes(front.arriving(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).where("type = 'ispe'").count() == 1


def test_functions(spark):
    one = spark.createDataFrame([(bytes.fromhex("E58E26"), b"\x00\x01\x02\x03\x04\x05\x06\x07\x08")], "a binary, b binary")
    r = one.select(
        bits.leb128(F.col("a")).alias("leb"), bits.be_n(F.col("b"), 1, 8).alias("be8"), bits.be_n(F.col("b"), 0, 0).alias("none"), bits.bit_field(F.col("b"), 12, 9).alias("bits"), bits.tile_log2(F.lit(1), F.lit(5)).alias("tl"),
        bits.clip3(0, 255, F.lit(300)).alias("clip"), bits.ceil_div(F.lit(17), 16).alias("ceil"), bits.obu_type_name(F.lit(6)).alias("o6"), bits.obu_type_name(F.lit(12)).alias("o12"), bits.tx_size_name(F.lit(18)).alias("t18"),
        bits.tx_size_name(F.lit(19)).alias("t19"), bits.superres_width(F.lit(100), F.lit(16)).alias("sr"), bits.mi_size(F.lit(9)).alias("mi"), bits.sb_count(F.lit(33), F.lit(1)).alias("sb"), bits.q_context(F.lit(61)).alias("qc"),
    ).first()
    assert r.leb == 624485 and int(r.be8) == 0x0102030405060708 and r.none == 0 and r.bits == 32
    assert (r.tl, r.clip, r.ceil, r.o6, r.o12, r.t18, r.t19, r.sr, r.mi, r.sb, r.qc) == (3, 255, 2, "frame", "reserved", "TX_64X16", "TX_INVALID", 50, 4, 2, 2)


def test_rollup_and_timings(spark):
    d = spark.createDataFrame([("m0", "ERROR", "x"), ("m1", "ERROR", "y")], "stage string, severity string, message string")
    assert report.by_status(d).where("stage is null").first().n == 2
    t = report.timings(spark.createDataFrame([("a", "m2", 1.0), ("a", "m2", 3.0)], "path string, stage string, ms double")).first()
    assert (t.files, t.total_ms, t.mean_ms) == (1, 4.0, 2.0)
    head = spark.createDataFrame([("a", "q", 3, 3, 4)], "b string, p string, upscaled_width long, coded_width long, coded_height long")
    m = spark.createDataFrame([("a", "q", 3, 4), ("z", "q", 1, 1)], "base string, preset string, width int, height int")
    assert {r.base: r.ok for r in report.dims_check(head, m, F.col("b"), F.col("p")).collect()} == {"a": True, "z": None}
    assert containers.av1c(bytes.fromhex("81000c1f"))["ipd_minus_one"] == 15


def test_all_rows_are_tiled(spark):
    """Whole lineitem, of every number of lines; files of no tile and of many; all classes."""
    lines, parts = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("lineitem", "part"))
    assert queries.tiles(spark, DATA).count() == lines.count()
    n = {r.count_class: r.files for r in queries.tiles_per_file(spark, DATA).collect()}
    assert sum(n.values()) == parts.count() and set(n) == {"1", "2-4", "5-16", ">16"}
    sizes = {r.size_class: r.tiles for r in queries.tile_size_histogram(spark, DATA).collect()}
    assert sum(sizes.values()) == lines.count() and len(sizes) == 6


def test_layouts_of_any_count():
    for n in range(18):
        tiles = [bytes([i + 1]) * (i + 1) for i in range(n)]
        s = streams.stream(fx.layout_stream(tiles))
        assert [t["size"] for t in s["tiles"]] == [len(t) for t in tiles]
        assert s["tile_info"]["tile_cols"] * s["tile_info"]["tile_rows"] == max(n, 1)
