"""What keeps the media queries bounded on large tables: batches, tasks, remembered headers, checks without a shuffle."""

import duckdb
import pyarrow as pa
import pytest

from lumenbox import batches
from lumenbox import fixtures as fx
from lumenbox.operators import coefficients, streams, tables
from lumenbox.plans import queries, report, views  # noqa: F401  views registers its queries
from lumenbox.sources import files

DATA = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _partitions(df):
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def test_offsets_need_no_window(spark):
    assert "Window" not in _plan(queries.tile_offsets(spark, DATA))


def test_offset_checks(spark):
    s = tables.StreamTables(spark.createDataFrame([("a", fx.layout_stream([b"xy", b"z", b"uvw", b"t"]))], "path string, payload binary")).nested
    first = s.first().tiles[0].offset - 1
    assert [(r.tile_num, r.ok) for r in report.offset_checks(s.selectExpr("path", "tiles", f"{first}L AS first"), 1).collect()] == [(i, True) for i in range(4)]
    off = s.selectExpr("path", f"transform(tiles, t -> if(t.tile_num = 1, struct(t.tg_index, t.tile_num, t.tile_row, t.tile_col, t.offset, t.size + 5 AS size), t)) AS tiles", f"{first}L AS first")
    assert [r.ok for r in report.offset_checks(off, 1).collect()] == [True, True, False, False]
    wrong = s.select("path", "tiles").selectExpr("path", "tiles", f"{first + 1}L AS first")
    assert not any(r.ok for r in report.offset_checks(wrong, 1).collect())


@pytest.mark.parametrize("name", ["tile_offsets", "tile_size_histogram", "tile_names", "tile_size_range", "tiles", "item_graph"])
def test_tasks_follow_lines(spark, monkeypatch, name):
    monkeypatch.setitem(queries.TASK_ROWS, "lineitem", 250)
    made = []
    monkeypatch.setattr(fx, "build", lambda rows, *a, build=fx.build, **k: made.append(rows) or build(rows, *a, **k))
    queries.QUERIES[name](spark, DATA)
    assert _partitions(made[0]) == 24  # of 6,000 lines


@pytest.mark.parametrize("name", ["tile_syntax", "tile_colour", "tile_counters"])
def test_tasks_follow_parts(spark, monkeypatch, name):
    monkeypatch.setitem(queries.TASK_ROWS, "part", 20)
    assert _partitions(queries.QUERIES[name](spark, DATA)) == 10  # of 200 parts


def test_headers_are_remembered_with_other_tiles():
    a, b = fx.syntax_stream(b"\x80"), fx.syntax_stream(b"\x12\x34\x80")
    first, again, other = streams.stream(a), streams.stream(a), streams.stream(b)
    assert first == again and other["frame_header"] is not first["frame_header"] and other["tile_info"] is first["tile_info"]
    assert [t["size"] for t in other["tiles"]] == [3] and other["frame_header"] == first["frame_header"]
    wide = streams.stream(fx.grid_stream([b"\x80"] * 4))
    assert wide["sequence_header"]["max_frame_width"] == 128 and len(wide["tiles"]) == 4


def test_scan_orders_are_made_once():
    assert coefficients._scan(5, 5, "2D") is coefficients._scan(5, 5, "2D") and coefficients._scan(3, 4, "VERT") == coefficients.scan(3, 4, "VERT")


def test_slices_are_bounded():
    batch = pa.RecordBatch.from_pydict({"x": pa.array([bytes(1000)] * 5000)})
    got = list(batches.slices([batch, batch.slice(0, 0)]))
    assert max(b.num_rows for b in got) * 1000 <= batches.BYTES and pa.Table.from_batches(got) == pa.Table.from_batches([batch])
    assert max(b.num_rows for b in batches.slices([pa.RecordBatch.from_pydict({"x": list(range(50_000))})])) <= batches.ROWS


def test_rows_at_a_time(spark):
    """However large a batch is, few rows of it are records at one time."""
    def parse(data):
        return {"n": len(data)}

    rows = spark.range(9000, numPartitions=1).selectExpr("cast(id AS string) AS path", "repeat('x', 2000) AS t").selectExpr("path", "encode(t, 'UTF-8') AS content")
    out = tables.per_file(rows, parse, "n long")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "2000"
    assert out.where("n = 2000").count() == 9000


def test_parts_of_streams(spark):
    s = tables.StreamTables(queries._golden(spark))
    assert s.part("tile_info", tiles="size").dtypes[0] == ("path", "string") and s.part(tiles="size tile_num").dtypes[1] == ("tiles", "array<struct<tile_num:bigint,size:bigint>>")
    assert sorted(s.tiles_of("tile_num size").collect()) == sorted(s.tiles.select("path", "tile_num", "size").collect())
    strict = tables.StreamTables(queries._golden(spark), mode=tables.DROPMALFORMED)
    assert sorted(strict.tiles_of("size").collect()) == sorted(s.tiles_of("size").collect())


def test_file_scan_finds_empty_and_repeated_files(spark, tmp_path):
    """Documents without text, and documents that repeat an id, in one task and in several."""
    con = duckdb.connect()
    con.sql(f"CREATE TABLE documents AS SELECT * FROM '{DATA}/documents.parquet' UNION ALL SELECT doc_id, '', lang, source, 0 FROM '{DATA}/documents.parquet' WHERE doc_id < 3")
    con.sql("INSERT INTO documents SELECT doc_id, text || '!', lang, source, n_chars FROM documents WHERE doc_id BETWEEN 2 AND 5")
    con.sql(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    want = sorted(con.sql(queries.ORACLES["file_scan"]).fetchall())
    assert sum(length == 0 for _, length, _ in want) == 3 and len(want) == 208
    assert sorted(tuple(r) for r in queries.QUERIES["file_scan"](spark, str(tmp_path)).collect()) == want


def test_scan_of_empty_files_with_odd_names(spark, tmp_path):
    for name in ("a b+c%41é.avif", "sub/x.avif", "generated/y.avif", "z.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).touch()
    (tmp_path / "full +%.avif").write_bytes(b"x")
    got = files.scan(spark, str(tmp_path)).collect()
    assert sorted((r.path.rpartition("/")[2], r.length, bytes(r.content)) for r in got) == [("a b+c%41é.avif", 0, b""), ("full +%.avif", 1, b"x"), ("x.avif", 0, b"")]
