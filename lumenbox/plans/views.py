"""Queries over text views, files that are written and scanned again, manifests, and the reports of a corpus."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import bits
from ..operators import tables
from ..sources import files
from . import report, sinks
from .queries import _framed, _key, _nested, _sequence, _table, query


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or a local one for a local master."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lumenbox-")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return f"{whole}/lumenbox/{name}-{uuid.uuid4().hex}"


@query("""WITH b AS (SELECT page_id, 1 + page_id % 5 AS n, CAST(octet_length(encode(coalesce(url, ''))) AS BIGINT) + 8 AS leaf FROM pages), d AS (
            SELECT page_id, n, leaf, unnest(range(n + 1)) AS depth FROM b), e AS (
            SELECT *, list_sum([CASE WHEN j % 2 = 1 THEN 16 ELSE 8 END FOR j IN range(5) IF j < n AND j > n - 1 - depth]) AS outside, list_sum([CASE WHEN j % 2 = 1 THEN 16 ELSE 8 END FOR j IN range(5) IF j <= n - 1 - depth]) AS inside FROM d)
          SELECT page_id, depth AS box_seq, repeat('  ', CAST(depth AS INTEGER)) || '[' || CAST(coalesce(outside, 0) AS BIGINT) || '+' || CAST(leaf + coalesce(inside, 0) AS BIGINT) || '] ' || CASE WHEN depth = n THEN 'free' ELSE ['moov', 'trak', 'mdia', 'minf', 'stbl'][n - depth] END AS line FROM e""")
def box_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of each file as lines of text."""
    b = tables.boxes(fx.build(_table(spark, sf_dir, "pages").select("page_id", "url"), _nested, "page_id"))
    return sinks.box_text(b).select(_key("page_id"), "box_seq", "line")


_PRIMARIES = ({}, {"pitm": None}, {"pitm": 9}, {"kind": b"grid"}, {"kind": b"Exif", "pieces": 3})


def _primaries(spark: SparkSession, sf_dir: str) -> tables.MetaTables:
    def make(doc_id: int, n_chars: int) -> bytes:
        return fx.still(b"\x80" * 7, 1 + doc_id % 4096, 1 + n_chars % 4096, **_PRIMARIES[doc_id % 5])

    return tables.MetaTables(fx.build(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), make, "doc_id"))


@query("""SELECT doc_id, 'meta.hdlr: pict' || chr(10) || 'items: 1' || chr(10) || 'properties: 3' || chr(10) || CASE doc_id % 5 WHEN 0 THEN 'primary item: coded ''av01'' (simple still path candidate)' WHEN 1 THEN 'meta.pitm: (missing primary item)'
                 WHEN 2 THEN 'primary item: not found in item table (unexpected)' WHEN 3 THEN 'primary item: not a coded ''av01'' item (type=''grid'')' ELSE 'primary item: not a coded ''av01'' item (type=''Exif'')' END AS line FROM documents""")
def meta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a file's metadata says of its primary item."""
    return sinks.meta_text(_primaries(spark, sf_dir)).select(_key("doc_id"), "line")


@query("""SELECT doc_id, CAST(0 AS INTEGER) AS item_no, 'item 1 ' || CASE doc_id % 5 WHEN 3 THEN 'grid' WHEN 4 THEN 'Exif' ELSE 'av01' END || ' method=0 extents=' || CASE WHEN doc_id % 5 = 4 THEN 3 ELSE 1 END || ' properties=3' AS line FROM documents""")
def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.item_text(_primaries(spark, sf_dir)).select(_key("doc_id"), "item_no", "line")


@query("""SELECT doc_id, 'ispe ' || (1 + doc_id % 4096) || 'x' || (1 + n_chars % 4096) || '; pixi 8,8,8; av1C YUV420 8 bits' AS line FROM documents WHERE doc_id % 5 NOT IN (1, 2)""")
def primary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of primary items; files without one have no line."""
    return sinks.primary_text(_primaries(spark, sf_dir)).select(_key("doc_id"), "line")


@query("""SELECT doc_id, CAST(44 + octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, 'DKIF' AS magic, 1 + doc_id % 4096 AS width, 1 + n_chars % 4096 AS height, CAST(1 AS BIGINT) AS frames,
                 CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS frame_bytes, sha256(coalesce(text, '')) AS sha256 FROM documents""")
def ivf_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text as the one frame of an IVF file, whose fields are read back as expressions."""
    rows = _table(spark, sf_dir, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    out = sinks.ivf_files(rows.select(path, body.alias("payload")), rows.select(path, (1 + F.col("doc_id") % 4096).cast("int").alias("width"), (1 + F.col("n_chars") % 4096).cast("int").alias("height")))
    b = F.col("ivf")
    frame = F.expr("substring(ivf, 45)")
    return out.select(_key("doc_id"), F.length(b).cast("long").alias("n_bytes"), bits.fourcc(F.substring(b, 1, 4)).alias("magic"), bits.le_n(b, 12, 2).alias("width"), bits.le_n(b, 14, 2).alias("height"), bits.le_n(b, 24, 4).alias("frames"), bits.le_n(b, 32, 4).alias("frame_bytes"), F.sha2(frame, 256).alias("sha256"))


@query("""SELECT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 32) || '.avif' AS file, CAST(octet_length(encode(text)) AS BIGINT) AS length, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL""")
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text as a file; a scan of the folder by suffix finds them, and not the ones with another suffix."""
    folder = scratch(spark, "files")
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("payload"))
    sinks.write_payloads(rows, folder, ".avif", apart=True).count()
    sinks.write_payloads(rows.limit(3), folder + "/other", ".av1").count()
    sinks.write_payloads(rows.limit(3), folder + "/generated", ".avif").count()
    found = files.scan(spark, folder, ".avif")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


@query("""SELECT substr(sha256(CAST(s_suppkey AS VARCHAR)), 1, 32) || '.obu' AS file, CAST(octet_length(encode(s_name)) AS BIGINT) AS length FROM supplier WHERE octet_length(encode(s_name)) <= 18 ORDER BY 1 LIMIT 20""")
def first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty files by path that are not longer than eighteen bytes."""
    folder = scratch(spark, "names")
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.encode("s_name", "UTF-8").alias("payload"))
    sinks.write_payloads(rows, folder, ".obu").count()
    return files.scan(spark, folder, ".obu", limit=20, max_length=18).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


@query("""SELECT 'p' || p_partkey AS base, 'q' || (p_partkey % 4) AS preset, p_size % 9 > 0 AS ok FROM part""")
def manifest_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest read from text; its sizes are held against those of the frames, and a ninth of the lines is wrong."""
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey")
    name = F.format_string("p%d\tq%d  %d %d a b c", k, k % 4, 16 + k % 48 + F.when(F.col("p_size") % 9 == 0, 1).otherwise(0), 16 + k % 31)
    folder = scratch(spark, "manifest")
    part.select(name.alias("value")).unionAll(part.limit(1).selectExpr("'# comment of seven or more fields in all' AS value")).unionAll(part.limit(1).selectExpr("'too few' AS value")).write.text(folder)
    h = tables.StreamTables(fx.build(part.select(k.alias("doc_id")), _framed, "doc_id", "payload")).frame_headers
    path = F.col("path").cast("long")
    return report.dims_check(h, files.manifest(spark, folder), F.concat(F.lit("p"), path.cast("string")), F.concat(F.lit("q"), (path % 4).cast("string")))


@query("""SELECT doc_id, doc_id % 3 AS seq_profile, 1 + doc_id % 5000 AS max_frame_width, 1 + doc_id % 777 AS max_frame_height, CAST(doc_id % 11 = 0 AS BIGINT) AS use_128x128_superblock FROM documents""")
def header_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence headers as lines of text, and the values that are read back from them."""
    s = tables.StreamTables(fx.build(_table(spark, sf_dir, "documents").select("doc_id"), _sequence, "doc_id", "payload")).sequence_headers
    names = ("seq_profile", "max_frame_width", "max_frame_height", "use_128x128_superblock")
    return files.header_lines(sinks.header_text(s), names).select(_key("doc_id"), *names)


_HEAD = fx.obu(1, fx.sequence(128, 128))
_FOUR_TILES = fx.frame(tile_bits=((1, 1), (1, 1), (1, 1), (0, 2), (0, 2))).bytes()
#: A stream for each remainder of an id by nine, and what is wrong with it.
STREAMS = (
    (fx.grid_stream([b"\x80"] * 4), None),
    (b"\x8a" + _HEAD[1:], "OBU forbidden bit set"),
    (b"\x08" + _HEAD[1:], "OBU has_size_field=0 (unsupported)"),
    (b"\x0a\xff\xff", "failed to read OBU size LEB128"),
    (b"\x0a\x7f\x01", "OBU payload overruns buffer"),
    (fx.obu(3, _FOUR_TILES), "no Sequence Header OBU found"),
    (_HEAD, "no Frame Header OBU found"),
    (_HEAD + fx.obu(3, _FOUR_TILES) + fx.obu(4, fx.BitWriter().f(1, 1).f(3, 2).f(1, 2).bytes()), "invalid tg_start/tg_end"),
    (_HEAD + fx.obu(3, _FOUR_TILES) + fx.obu(4, b"\x00\x09\x01"), "tileSize exceeds remaining tile_group payload"),
)
_WRONG = " ".join(f"WHEN {i} THEN '{r}'" for i, (_, r) in enumerate(STREAMS) if r)


@query(f"SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'OK' ELSE 'ERROR' END AS status, CASE doc_id % 9 {_WRONG} END AS reason FROM documents")
def stream_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framing of units, missing headers and bounds of tile groups."""
    s = tables.StreamTables(fx.build(_table(spark, sf_dir, "documents").select("doc_id"), lambda doc_id: STREAMS[doc_id % 9][0], "doc_id", "payload")).nested
    return s.select(_key("doc_id"), "status", "reason")


@query(f"""WITH d AS (SELECT CASE WHEN doc_id % 9 IN (5, 6) THEN CASE WHEN doc_id % 9 = 6 THEN 'm3b' ELSE 'm3a' END WHEN doc_id % 9 < 5 THEN 'm3a' ELSE 'm3b' END AS stage, 'ERROR' AS severity, CASE doc_id % 9 {_WRONG} END AS message FROM documents WHERE doc_id % 9 > 0)
           SELECT stage, severity, message, count(*) AS n FROM d GROUP BY ROLLUP (stage, severity, message)""")
def diagnostic_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics by stage, severity and message, with subtotals."""
    s = tables.StreamTables(fx.build(_table(spark, sf_dir, "documents").select("doc_id"), lambda doc_id: STREAMS[doc_id % 9][0], "doc_id", "payload"))
    return report.by_status(s.diagnostics)


@query("""SELECT event_type AS stage, count(DISTINCT user_id) AS files, CAST(sum(event_id % 1000) AS BIGINT) AS total_ms, CAST(sum(event_id % 1000) AS DOUBLE) / count(*) AS mean_ms FROM events GROUP BY 1""")
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.timings(_table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("stage"), (F.col("event_id") % 1000).alias("ms")))


@query("""SELECT n_nationkey, CAST(n_nationkey % 3 = 1 AS BIGINT) AS warnings, CASE WHEN n_nationkey % 3 = 1 THEN CAST(0 AS BIGINT) ELSE 1 END AS items, CASE n_nationkey % 3 WHEN 1 THEN 'unsupported_infe_version' END AS code FROM nation""")
def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item entries of versions that are not known are warned of and left out."""

    def make(n_nationkey: int) -> bytes:
        return fx.FTYP + fx.full(b"meta", 0, 0, fx.hdlr(), fx.pitm(1), fx.iinf(fx.infe(1, version=(2, 5, 3)[n_nationkey % 3])))

    m = tables.MetaTables(fx.build(_table(spark, sf_dir, "nation").select("n_nationkey"), make, "n_nationkey")).nested
    return m.select(F.col("path").cast("int").alias("n_nationkey"), F.col("meta.warning_count").alias("warnings"), F.col("meta.item_count").alias("items"), F.try_element_at("diagnostics", F.lit(1))["code"].alias("code"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'extent_index present (unsupported in m1)' END AS m1, CAST(NULL AS VARCHAR) AS m2, doc_id % 2 = 0 AS same FROM documents""")
def extent_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents with an index are refused, or taken by the other way to extract; where both take them the payloads agree."""
    made = fx.build(_table(spark, sf_dir, "documents").select("doc_id"), lambda doc_id: fx.still(b"\x80" * (1 + doc_id % 50), pieces=2, index_size=4 * (doc_id % 2)), "doc_id")
    one, two = tables.payloads(made), tables.payloads(made, "m2")
    both = one.select("path", F.col("reason").alias("m1")).join(two.select("path", F.col("reason").alias("m2")), "path").join(report.same_payload(one, two), "path")
    return both.select(_key("doc_id"), "m1", "m2", F.col("ok").alias("same"))


@query("""SELECT * FROM (VALUES ('frame', 'coded_lossless', true), ('frame', 'superres_denom', true), ('frame', 'cdef_bits', true), ('frame', 'alt_q', true), ('bare', 'coded_lossless', false), ('bare', 'superres_denom', true), ('bare', 'cdef_bits', false), ('bare', 'alt_q', false)) AS t("table", "column", seen)""")
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fields of a header are seen: with a whole header, and with one that ends after its tile layout."""
    rows = _table(spark, sf_dir, "documents").select("doc_id")
    names = ("coded_lossless", "superres_denom", "cdef_bits", "alt_q")
    whole = tables.StreamTables(fx.build(rows, _framed, "doc_id", "payload")).frame_headers.select(*names)
    bare = tables.StreamTables(fx.build(rows, lambda doc_id: fx.grid_stream([b"\x80"] * 4), "doc_id", "payload")).frame_headers.select(*names)
    return report.milestones({"frame": whole, "bare": bare})


@query("""SELECT p_partkey, p_partkey % 4 <> 3 AS ok FROM part""")
def expected_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles against the set that is expected; a fourth of the expectations is wrong."""
    part = _table(spark, sf_dir, "part").select("p_partkey")
    made = fx.build(part, lambda p_partkey: fx.layout_stream([b"t" * (1 + i) for i in range(1 + p_partkey % 6)]), "p_partkey", "payload")
    k = F.col("p_partkey")
    want = part.select(k.cast("string").alias("path"), k, F.explode(F.sequence(F.lit(0).cast("long"), k % 6)).alias("tile_num"))
    want = want.select("path", "tile_num", (1 + F.col("tile_num") + F.when(k % 4 == 3, 1).otherwise(0)).alias("size"))
    return report.expected_tiles(tables.StreamTables(made).tiles.select("path", "tile_num", "size"), want).select(_key("p_partkey"), "ok")


@query("""SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 8 WHEN s_suppkey % 4 >= 2 THEN 12 ELSE 10 END AS INTEGER) AS by_flag, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 8 WHEN s_suppkey % 3 = 2 AND s_suppkey % 4 >= 2 THEN 12 ELSE 10 END AS INTEGER) AS by_profile FROM supplier""")
def bit_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The depth that a configuration states, with and without a look at its profile."""
    k = F.col("s_suppkey")
    c = F.struct((k % 2).cast("int").alias("high_bitdepth"), F.when(k % 4 >= 2, 1).otherwise(0).alias("twelve_bit"), (k % 3).cast("int").alias("profile"))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", c.alias("c")).select("s_suppkey", bits.av1c_bit_depth(F.col("c"), by_profile=False).alias("by_flag"), bits.av1c_bit_depth(F.col("c")).alias("by_profile"))
