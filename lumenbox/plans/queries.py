"""Queries over the test tables: rows are written as containers or streams, parsed again, and held against the rows.

Media files cannot come with the repository, so the oracle of a query is plain SQL over the columns it was built from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import bits
from ..operators import entropy, probe, streams, tables
from ..sources import files as source_files
from ..sources.files import from_table
from . import report, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that comes in fewer splits than there are cores, as a small file does, is dealt to all of them. Of a
    large table the splits stay as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


#: Rows of a table that a task takes where what is made of them costs Python much.
TASK_ROWS = {"lineitem": 50_000, "orders": 25_000, "events": 25_000, "part": 2_000}


def _tasks(df: DataFrame, name: str) -> int:
    """As many tasks as there are cores, and more where the table is large. Their number is given, as adaptive execution goes
    by bytes and would put rows this short into a few tasks that grow with the table."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS[name]))


def _dealt(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A table dealt to ``_tasks``, by keys if there are some: what is grouped or joined by these stays where it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(_tasks(df, name), *keys)


def _key(name: str):
    return F.col("path").cast("long").alias(name)


def _carrier(doc_id: int, text: str | None) -> bytes:
    stream = fx.obu(1, fx.sequence()) + fx.obu(5, (text or "").encode())
    return fx.still(stream, pieces=1 + doc_id % 4, idat=doc_id % 2 == 1)


@query("SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS sha256 FROM documents")
def payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text, in up to four extents of a file or its idat, inside a metadata unit."""
    files = fx.build(_table(spark, sf_dir, "documents").select("doc_id", "text"), _carrier, "doc_id")
    payload = tables.payloads(from_table(files)).where("status = 'OK'")
    units = tables.StreamTables(payload, keep_content=True).nested.withColumn("u", F.element_at(F.filter("obus", lambda u: u["obu_type"] == 5), 1))
    body = F.substring(F.col("payload"), F.col("u.payload_off").cast("int") + 1, F.col("u.payload_size").cast("int"))
    return units.select(_key("doc_id"), F.length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha256"))


@query("SELECT doc_id, 1 + doc_id % 4096 AS width, 1 + n_chars % 4096 AS height FROM documents")
def primary_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    files = fx.build(rows, lambda doc_id, n_chars: fx.still(b"\x80", 1 + doc_id % 4096, 1 + n_chars % 4096), "doc_id")
    p = report.primary_properties(tables.MetaTables(files))
    return p.select(_key("doc_id"), "ispe.width", "ispe.height")


def _nested(page_id: int, url: str | None) -> bytes:
    body = fx.box(b"free", (url or "").encode())
    for i in range(1 + page_id % 5):
        body = fx.box((b"moov", b"trak", b"mdia", b"minf", b"stbl")[i], body, large=i % 2 == 1)
    return body


@query("SELECT page_id, 2 + page_id % 5 AS n_boxes, 1 + page_id % 5 AS deepest, CAST(octet_length(encode(coalesce(url, ''))) AS BIGINT) AS leaf_bytes FROM pages")
def box_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(fx.build(_table(spark, sf_dir, "pages").select("page_id", "url"), _nested, "page_id"))
    return b.groupBy("path").agg(F.count("*").alias("n_boxes"), F.max("depth").cast("long").alias("deepest"), F.max(F.when(F.col("type") == "free", F.col("payload_len"))).alias("leaf_bytes")).select(_key("page_id"), "n_boxes", "deepest", "leaf_bytes")


def _order_file(l_orderkey: int, lines: list[dict]) -> bytes:
    shared = sorted({(int(x["q"]), x["s"]) for x in lines})
    props = [fx.ispe(*p) for p in shared]
    where = {p: i + 1 for i, p in enumerate(shared)}
    ordered = sorted(lines, key=lambda x: (x["n"], x["q"], x["s"]))
    entries = [(i, [(where[int(x["q"]), x["s"]], False)]) for i, x in enumerate(ordered, 1)]
    meta = fx.full(b"meta", 0, 0, fx.hdlr(), fx.pitm(1), fx.iinf(*[fx.infe(i) for i, _ in entries]), fx.box(b"iprp", fx.box(b"ipco", *props), fx.ipma(entries, wide=l_orderkey % 2 == 1)))
    return fx.FTYP + meta


@query("""SELECT l_orderkey, row_number() OVER w AS item_id, row_number() OVER w - 1 AS item_no, CAST(l_quantity AS BIGINT) AS width, l_suppkey AS height
           FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_suppkey)""")
def item_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file an order, an item a line, properties shared through their associations."""
    lines = _dealt(spark, sf_dir, "lineitem", "l_orderkey").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_suppkey").alias("s"))).alias("lines"))
    r = tables.MetaTables(fx.build(lines, _order_file, "l_orderkey")).resolved
    return r.select(_key("l_orderkey"), "item_id", F.col("item_no").cast("long").alias("item_no"), "ispe.width", "ispe.height")


@query("""SELECT user_id, CAST(CASE length(event_type) % 3 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 15 END AS INTEGER) AS obu_type, count(*) AS n,
                 CAST(sum(length(event_type)) AS BIGINT) AS payload_bytes FROM events GROUP BY 1, 2""")
def obu_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir, "events", "user_id").groupBy("user_id").agg(F.collect_list("event_type").alias("kinds"))
    streams_ = fx.build(rows, lambda user_id, kinds: b"".join(fx.obu((2, 5, 15)[len(k) % 3], k.encode()) for k in kinds), "user_id", "payload")
    o = tables.obus(streams_).groupBy("path", "obu_type").agg(F.count("*").alias("n"), F.sum("payload_size").alias("payload_bytes"))
    return o.select(_key("user_id"), "obu_type", "n", "payload_bytes")


def _coded(spark: SparkSession, sf_dir: str, make, decode) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    coded = fx.build(rows.select("id", "l_orderkey", "l_partkey", "l_suppkey"), make, "id")
    id_ = F.col("path").cast("long")
    return coded.select(F.shiftright(id_, 3).alias("l_orderkey"), (id_ % 8).cast("int").alias("l_linenumber"), decode(F.col("content")).cast("long").alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_orderkey * 1000 + l_partkey AS value FROM lineitem")
def leb128(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir, lambda id, l_orderkey, l_partkey, l_suppkey: fx.leb128(l_orderkey * 1000 + l_partkey), bits.leb128)


@query("SELECT l_orderkey, l_linenumber, l_partkey AS value FROM lineitem")
def uvlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir, lambda id, l_orderkey, l_partkey, l_suppkey: fx.BitWriter().uvlc(l_partkey).bytes(), bits.uvlc)


@query("SELECT l_orderkey, l_linenumber, l_partkey % 128 - 64 AS value FROM lineitem")
def signed_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir, lambda id, l_orderkey, l_partkey, l_suppkey: fx.BitWriter().f(5, 3).f(l_partkey % 128 - 64, 7).bytes(), lambda b: bits.su(bits.bit_field(b, 3, 7), 7))


@query("SELECT l_orderkey, l_linenumber, l_partkey % 37 AS value FROM lineitem")
def nonsymmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir, lambda id, l_orderkey, l_partkey, l_suppkey: fx.BitWriter().ns(l_partkey % 37, 37).bytes(), lambda b: bits.ns(b, F.lit(37)))


def _hex(c: str, width: int):
    return F.lpad(F.hex(F.col(c)), width, "0")


@query("""SELECT p_partkey, p_partkey AS be32, CAST(p_size AS BIGINT) AS be16, p_partkey % 256 * 256 + p_size % 256 + 1 AS tile_size, p_partkey % 8 AS low3,
                 CAST(floor(log2(greatest(p_partkey, 1))) AS INTEGER) AS log2 FROM part""")
def be_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    packed = F.unhex(F.concat(_hex("p_partkey", 8), _hex("p_size", 4), F.lpad(F.hex(F.col("p_size") % 256), 2, "0"), F.lpad(F.hex(F.col("p_partkey") % 256), 2, "0")))
    b = F.col("b")
    return p.select("p_partkey", packed.alias("b")).select("p_partkey", bits.be_n(b, 0, 4).alias("be32"), bits.be_n(b, 4, 2).alias("be16"), (bits.le_n(b, 6, 2) + 1).alias("tile_size"), bits.bit_field(b, 29, 3).alias("low3"), bits.floor_log2(bits.be_n(b, 0, 4)).alias("log2"))


@query("""SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 8 WHEN s_suppkey % 3 = 2 AND s_suppkey % 4 >= 2 THEN 12 ELSE 10 END AS INTEGER) AS bit_depth,
                 CAST(CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 3 END AS INTEGER) AS channels,
                 CASE WHEN s_suppkey % 5 = 0 THEN 'YUV400' WHEN s_suppkey % 7 = 0 THEN 'YUV444' WHEN s_suppkey % 7 < 4 THEN 'YUV422' ELSE 'YUV420' END AS format,
                 CAST(s_suppkey % 32 AS INTEGER) AS level FROM supplier""")
def av1_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    x = F.when(k % 7 == 0, 0).otherwise(1)
    y = F.when(k % 7 >= 4, 1).otherwise(0)
    second = (k % 3) * 32 + k % 32
    third = (k % 2) * 64 + F.when(k % 4 >= 2, 32).otherwise(0) + F.when(k % 5 == 0, 16).otherwise(0) + x * 8 + y * 4
    b = F.unhex(F.concat(F.lit("81"), F.lpad(F.hex(second.cast("long")), 2, "0"), F.lpad(F.hex(third.cast("long")), 2, "0"), F.lit("00")))
    c = F.col("c")
    return s.select("s_suppkey", bits.av1c_struct(b).alias("c")).select("s_suppkey", bits.av1c_bit_depth(c).alias("bit_depth"), bits.av1c_channels(c).alias("channels"), bits.chroma_format(c).alias("format"), F.col("c.level_idx_0").alias("level"))


@query(r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), b AS (
             SELECT doc_id, [CAST(('0x' || h[2*i+1:2*i+2]) AS INTEGER) FOR i IN range(least(4, length(h) // 2))] AS v FROM d)
           SELECT doc_id, array_to_string([CASE WHEN x BETWEEN 32 AND 126 THEN chr(x) ELSE '.' END FOR x IN v], '') AS code FROM b""")
def fourcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return _table(spark, sf_dir, "documents").select("doc_id", bits.fourcc(F.substring(body, 1, 4)).alias("code"))


@query("""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)
          SELECT doc_id, CASE WHEN length(h) >= 4 THEN (CAST('0x' || right(h, 4) AS INTEGER) & 32767) <> 0 WHEN length(h) = 2 THEN h <> '00' ELSE false END AS ok FROM d""")
def trailing_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", bits.trailing_bits_ok(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("ok"))


def _sequence(doc_id: int) -> bytes:
    profile = doc_id % 3
    return fx.obu(1, fx.sequence(1 + doc_id % 5000, 1 + doc_id % 777, profile, reduced=doc_id % 2 == 0, high=int(doc_id % 4 >= 2), twelve=int(doc_id % 8 >= 4), mono=int(profile != 1 and doc_id % 5 == 0), sx=1, sy=int(doc_id % 7 < 3), use_128=int(doc_id % 11 == 0)))


@query("""WITH d AS (SELECT doc_id, doc_id % 3 AS p, doc_id % 4 >= 2 AS high, doc_id % 8 >= 4 AS twelve FROM documents), e AS (
            SELECT *, CASE WHEN NOT high THEN 8 WHEN p = 2 AND twelve THEN 12 ELSE 10 END AS depth, p <> 1 AND doc_id % 5 = 0 AS mono FROM d)
          SELECT doc_id, p AS seq_profile, CAST(doc_id % 2 = 0 AS BIGINT) AS reduced, CAST(depth AS BIGINT) AS bit_depth, CAST(mono AS BIGINT) AS monochrome, 1 + doc_id % 5000 AS width, 1 + doc_id % 777 AS height,
                 CAST(CASE WHEN mono OR p = 0 THEN 1 WHEN p = 1 THEN 0 ELSE 1 END AS BIGINT) AS subsampling_x,
                 CAST(CASE WHEN mono OR p = 0 THEN 1 WHEN p = 1 THEN 0 WHEN depth = 12 AND doc_id % 7 < 3 THEN 1 ELSE 0 END AS BIGINT) AS subsampling_y,
                 CAST(doc_id % 11 = 0 AS BIGINT) AS use_128 FROM e""")
def sequence_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.StreamTables(fx.build(_table(spark, sf_dir, "documents").select("doc_id"), _sequence, "doc_id", "payload")).sequence_headers
    return s.select(_key("doc_id"), "seq_profile", F.col("reduced_still_picture_header").alias("reduced"), "bit_depth", "monochrome", F.col("max_frame_width").alias("width"), F.col("max_frame_height").alias("height"), "subsampling_x", "subsampling_y", F.col("use_128x128_superblock").alias("use_128"))


def _framed(doc_id: int) -> bytes:
    w, h = 16 + doc_id % 48, 16 + doc_id % 31
    reduced = doc_id % 2 == 0
    superres = doc_id % 3 == 0
    head = fx.frame(reduced, override=None if reduced else (w, h), superres=superres, denom=9 + doc_id % 8 if superres and doc_id % 6 == 0 else None, render=(1 + doc_id % 100, 1 + doc_id % 50) if doc_id % 5 == 0 else None, tail=True)
    return fx.obu(1, fx.sequence(w, h, reduced=reduced, superres=int(superres))) + fx.obu(6, head.bytes() + b"\x80")


@query("""WITH d AS (SELECT doc_id, 16 + doc_id % 48 AS w, 16 + doc_id % 31 AS h, CASE WHEN doc_id % 6 = 0 THEN 9 + doc_id % 8 ELSE 8 END AS denom FROM documents), e AS (
            SELECT *, (w * 8 + denom // 2) // denom AS coded FROM d)
          SELECT doc_id, w AS upscaled_width, coded AS coded_width, h AS coded_height, denom AS superres_denom, 2 * ((coded + 7) // 8) AS mi_cols, 2 * ((h + 7) // 8) AS mi_rows,
                 CASE WHEN doc_id % 5 = 0 THEN 1 + doc_id % 100 ELSE w END AS render_width, CASE WHEN doc_id % 5 = 0 THEN 1 + doc_id % 50 ELSE h END AS render_height,
                 CAST(100 AS BIGINT) AS base_q_idx, CAST(2 AS BIGINT) AS tx_mode, CAST(1 AS BIGINT) AS tiles FROM e""")
def frame_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.StreamTables(fx.build(_table(spark, sf_dir, "documents").select("doc_id"), _framed, "doc_id", "payload")).nested
    f = [F.col(f"frame_header.{c}") for c in ("upscaled_width", "coded_width", "coded_height", "superres_denom", "mi_cols", "mi_rows", "render_width", "render_height", "base_q_idx", "tx_mode")]
    return n.select(_key("doc_id"), *f, F.size("tiles").cast("long").alias("tiles"))


_ALL = "(SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS size FROM lineitem)"


def _layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream an order, whatever its lines, with tiles as long as their quantities; orders without lines have no tiles."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tasks = _tasks(rows, "lineitem")
    lines = rows.repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("lines"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey")).repartition(tasks, "l_orderkey").distinct()
    return fx.build(orders.join(lines, "l_orderkey", "full"), lambda l_orderkey, lines: fx.layout_stream([bytes([x["q"] % 256]) * x["q"] for x in lines or ()]), "l_orderkey", "payload")


_GRID = f"""t AS (SELECT *, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY l_orderkey) AS c,
                    coalesce(sum(size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
             FROM {_ALL} WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, size)), g AS (
           SELECT *, list_min([x FOR x IN range(1, c + 1) IF c % x = 0 AND x * x >= c]) AS cols FROM t)"""


@query(f"""WITH {_GRID}
           SELECT l_orderkey, n AS tile_num, n // cols AS tile_row, n % cols AS tile_col, size, CAST(ahead + least(n + 1, c - 1) AS BIGINT) AS after_first,
                  CAST(16 * (n % cols) AS INTEGER) AS mi_col_start, CAST(16 * (n // cols) + 16 AS INTEGER) AS mi_row_end FROM g""")
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of all orders, in grids of as many tiles as lines; offsets count from the byte after the group's flags, which one tile has not."""
    t = tables.StreamTables(_layouts(spark, sf_dir)).part("tile_info", obus="obu_type payload_off", tiles="tile_num tile_row tile_col offset size").select("path", "tile_info", "obus", F.when(F.size("tiles") > 1, 1).otherwise(0).alias("flags"), F.explode("tiles").alias("t"))
    at = F.element_at(F.filter("obus", lambda u: u["obu_type"] == 4), 1)["payload_off"]
    return t.select(_key("l_orderkey"), "t.tile_num", "t.tile_row", "t.tile_col", "t.size", (F.col("t.offset") - at - F.col("flags")).alias("after_first"), F.element_at("tile_info.mi_col_starts", (F.col("t.tile_col") + 1).cast("int")).alias("mi_col_start"), F.element_at("tile_info.mi_row_starts", (F.col("t.tile_row") + 2).cast("int")).alias("mi_row_end"))


@query(f"SELECT 'offset' AS check, count(*) AS passed, CAST(0 AS BIGINT) AS failed, count(*) AS total FROM {_ALL} UNION ALL SELECT NULL, count(*), 0, count(*) FROM {_ALL}")
def tile_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each tile begins where the one before it ended, as totals."""
    s = tables.StreamTables(_layouts(spark, sf_dir)).part(obus="obu_type payload_off", tiles="tg_index tile_num offset size").where("size(tiles) > 0")
    at = F.element_at(F.filter("obus", lambda u: u["obu_type"] == 4), 1)["payload_off"] + F.when(F.size("tiles") > 1, 1).otherwise(0)
    checked = report.offset_checks(s.select("path", "tiles", at.alias("first")), 1)
    return report.totals(checked.select(F.lit("offset").alias("check"), "ok"))


@query(f"""WITH {_GRID}
           SELECT l_orderkey, n AS tile_num, 'tg1_tile' || n || '_r' || (n // cols) || '_c' || (n % cols) || '.bin' AS file_name, n // cols AS tile_row, n % cols AS tile_col, size FROM g""")
def tile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of tiles; rows, columns and sizes as they are read back from the lines of text."""
    t = tables.StreamTables(_layouts(spark, sf_dir)).tiles_of("tg_index tile_num tile_row tile_col offset size")
    text = sinks.tile_file_names(t).select("path", "file_name", F.format_string("tg%d tile %d r%d c%d @ [%d+%d]", "tg_index", "tile_num", "tile_row", "tile_col", "offset", "size").alias("line"))
    return source_files.tile_lines(text).select(_key("l_orderkey"), "tile_num", "file_name", "tile_row", "tile_col", "size")


#: Sizes of tiles that reach every class, from the part and the quantity of a line.
_SIZED = """(SELECT l_orderkey, l_linenumber, CASE l_partkey % 1000 WHEN 0 THEN 65536 WHEN 1 THEN 16384 WHEN 2 THEN 4096 WHEN 3 THEN 1024 WHEN 4 THEN 256 ELSE 0 END + CAST(l_quantity AS BIGINT) AS size FROM lineitem)"""


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = {0: 65536, 1: 16384, 2: 4096, 3: 1024, 4: 256}
    lines = _dealt(spark, sf_dir, "lineitem", "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.col("l_partkey").cast("long").alias("p")))).alias("lines"))
    return fx.build(lines, lambda l_orderkey, lines: fx.layout_stream([b"t" * (x["q"] + step.get(x["p"] % 1000, 0)) for x in lines], 3), "l_orderkey", "payload")


@query(f"""SELECT CASE WHEN size < 256 THEN '<256' WHEN size < 1024 THEN '<1K' WHEN size < 4096 THEN '<4K' WHEN size < 16384 THEN '<16K' WHEN size < 65536 THEN '<64K' ELSE '>=64K' END AS size_class, count(*) AS tiles
           FROM {_SIZED} GROUP BY 1""")
def tile_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.tile_size_histogram(tables.StreamTables(_sized(spark, sf_dir)).tiles_of("size"))


@query("""SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 4 THEN '2-4' WHEN n <= 16 THEN '5-16' ELSE '>16' END AS count_class, count(*) AS files FROM (SELECT p_partkey % 30 AS n FROM part) GROUP BY 1""")
def tiles_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of no tile to 29 tiles."""
    g = fx.build(_dealt(spark, sf_dir, "part").select("p_partkey"), lambda p_partkey: fx.layout_stream([b"t"] * (p_partkey % 30)), "p_partkey", "payload")
    return report.tiles_per_file(g, tables.StreamTables(g).tiles)


@query(f"SELECT count(*) AS tiles, CAST(sum(size) AS BIGINT) AS total, min(size) AS smallest, CAST(arg_min(l_orderkey, [size, l_orderkey]) AS VARCHAR) AS smallest_path, max(size) AS largest FROM (SELECT size, l_orderkey FROM {_SIZED}) WHERE true".replace("arg_min(l_orderkey, [size, l_orderkey])", "arg_min(CAST(l_orderkey AS VARCHAR), struct_pack(s := size, k := CAST(l_orderkey AS VARCHAR)))"))
def tile_size_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest tile names its file: of equal ones the first by path."""
    return report.tile_size_range(tables.StreamTables(_sized(spark, sf_dir)).tiles_of("tg_index tile_num size"))


@query("""SELECT s_suppkey, i AS tile_num, CAST(16 * (CASE i WHEN 0 THEN 0 WHEN 1 THEN a WHEN 2 THEN a + b END) AS INTEGER) AS mi_col_start, CAST(16 * (CASE i WHEN 0 THEN a WHEN 1 THEN a + b WHEN 2 THEN a + b + c END) AS INTEGER) AS mi_col_end
           FROM (SELECT s_suppkey, 1 + s_suppkey % 5 AS a, 1 + s_suppkey % 7 AS b, 1 + s_suppkey % 3 AS c FROM supplier), unnest(range(3)) AS u(i)""")
def uneven_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of tiles whose widths are listed in the header."""
    g = fx.build(_table(spark, sf_dir, "supplier").select("s_suppkey"), lambda s_suppkey: fx.uneven_stream([1 + s_suppkey % 5, 1 + s_suppkey % 7, 1 + s_suppkey % 3]), "s_suppkey", "payload")
    return tables.StreamTables(g).tiles.select(_key("s_suppkey"), "tile_num", "mi_col_start", "mi_col_end")


def _tail(p_partkey: int) -> bytes:
    k = p_partkey
    q = k % 256 if k % 5 else 0
    return fx.tail_stream(
        q, ((k % 7) - 3, 0, (k % 5) - 2, 0, 0) if k % 3 else (0,) * 5, {i: (k % 41) - 20 + i for i in range(k % 4)}, k % 2 == 1, k % 4 if k % 3 == 0 else None, (k % 4, k // 4 % 2) if k % 2 else None, k % 2 == 0, k % 11 == 0,
        (k % 4, k // 4 % 2, k % 4) if k % 13 else None,
    )


@query("""WITH k AS (SELECT p_partkey, p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey % 256 END AS q FROM part), s AS (
            SELECT *, k % 4 AS n, CASE WHEN k % 3 > 0 THEN k % 7 - 3 ELSE 0 END AS y, CASE WHEN k % 3 > 0 THEN k % 5 - 2 ELSE 0 END AS u FROM k), l AS (
            SELECT *, y = 0 AND u = 0 AND len([i FOR i IN range(8) IF least(255, greatest(0, q + CASE WHEN i < n THEN k % 41 - 20 + i ELSE 0 END)) > 0]) = 0 AS lossless, q > 0 AND k % 3 = 0 AS dq FROM s)
          SELECT p_partkey, q AS base_q_idx, y AS delta_q_y_dc, u AS delta_q_u_ac, CAST(n > 0 AS BIGINT) AS segmentation_enabled, CAST(n > 0 AND k % 2 = 1 AS BIGINT) AS seg_id_pre_skip,
                 CASE WHEN n = 0 THEN 0 WHEN k % 2 = 1 THEN 7 ELSE n - 1 END AS last_active_seg_id, CAST(CASE WHEN n > 0 THEN k % 41 - 20 ELSE 0 END AS INTEGER) AS alt_q_0, CAST(lossless AS BIGINT) AS coded_lossless,
                 CAST(dq AS BIGINT) AS delta_q_present, CASE WHEN dq THEN k % 4 ELSE 0 END AS delta_q_res, CAST(dq AND k % 2 = 1 AS BIGINT) AS delta_lf_present,
                 CASE WHEN dq AND k % 2 = 1 THEN k // 4 % 2 ELSE 0 END AS delta_lf_multi, CAST(CASE WHEN lossless THEN 0 WHEN k % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS tx_mode, CAST(k % 11 = 0 AS BIGINT) AS reduced_tx_set, 'OK' AS status FROM l""")
def frame_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantizer, segments, changes, filters, transform mode and film grain: a header is read to its end, and a tile follows."""
    n = tables.StreamTables(fx.build(_dealt(spark, sf_dir, "part").select("p_partkey"), _tail, "p_partkey", "payload")).nested
    names = ("base_q_idx", "delta_q_y_dc", "delta_q_u_ac", "segmentation_enabled", "seg_id_pre_skip", "last_active_seg_id", "coded_lossless", "delta_q_present", "delta_q_res", "delta_lf_present", "delta_lf_multi", "tx_mode", "reduced_tx_set")
    return n.select(_key("p_partkey"), *[f"frame_header.{c}" for c in names], F.col("frame_header.alt_q")[0]["value"].alias("alt_q_0"), F.when(F.size("tiles") == 1, F.col("status")).alias("status"))


def _quarters(p_partkey: int, p_size: int) -> bytes:
    blocks = [{"skip": p_partkey >> i & 1, "y_mode": (7 * p_partkey + 5 * i + p_size) % 13, "angle": (p_size + i) % 7 - 3, "dc": (p_partkey + 31 * i) % 121 - 60, "q": 2} for i in range(4)]
    return fx.syntax_stream(fx.quarters_tile(blocks))


@query("""SELECT p_partkey, CAST(i AS INTEGER) AS block_no, CAST(8 * (i // 2) AS INTEGER) AS r, CAST(8 * (i % 2) AS INTEGER) AS c, CAST(skip AS INTEGER) AS skip, CAST(y_mode AS INTEGER) AS y_mode,
                 CAST(CASE WHEN skip = 0 AND y_mode BETWEEN 1 AND 8 THEN (p_size + i) % 7 - 3 END AS INTEGER) AS angle_delta_y, CAST(CASE WHEN skip = 0 THEN dc = 0 END AS INTEGER) AS all_zero,
                 CAST(CASE WHEN skip = 0 AND dc <> 0 THEN dc END AS INTEGER) AS dc, CAST(CASE WHEN skip = 0 AND dc <> 0 THEN abs(dc) END AS INTEGER) AS cul_level, 'OK' AS status
           FROM (SELECT p_partkey, p_size, i, (p_partkey >> i) & 1 AS skip, (7 * p_partkey + 5 * i + p_size) % 13 AS y_mode, (p_partkey + 31 * i) % 121 - 60 AS dc FROM part, unnest(range(4)) AS u(i))""")
def tile_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tiles of four blocks: flags, modes, angles and a coefficient of each, with contexts from the blocks around, to the exit."""
    s = tables.StreamTables(fx.build(_dealt(spark, sf_dir, "part").select("p_partkey", "p_size"), _quarters, "p_partkey", "payload"), keep_content=True)
    b = probe.tile_probe(s, fx.distributions(), whole=True, blocks=True).select("path", "status", F.posexplode("blocks").alias("block_no", "b"))
    t = F.try_element_at("b.tx", F.lit(1))
    return b.select(_key("p_partkey"), "block_no", "b.r", "b.c", "b.skip", "b.y_mode", "b.angle_delta_y", t["all_zero"].alias("all_zero"), t["dc"].alias("dc"), t["cul_level"].alias("cul_level"), "status")


def _colour(p_partkey: int, p_size: int) -> bytes:
    k, n = p_partkey, p_size
    blocks = [{"skip": int((k + i) % 3 == 0), "segment": (k // 2 + 3 * i) % 8, "cdef": k % 4, "y_mode": (k + 4 * i + n) % 13, "uv_mode": (3 * k + i + n) % 14, "signs": (k + i) % 8, "alpha": (n + i) % 16, "y": (k + i) % 5 - 2, "u": (k // 5 + i) % 5 - 2} for i in range(4)]
    return fx.colour_stream(fx.colour_tile(blocks, k % 41 - 20, n % 9 - 4))


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS n FROM part), f AS (
            SELECT k, n, [CAST((k + i) % 3 = 0 AS INTEGER) FOR i IN range(4)] AS s, [(k // 2 + 3 * i) % 8 FOR i IN range(4)] AS w FROM p), a AS (
            SELECT *, CASE WHEN s[1] = 1 THEN 0 ELSE w[1] END AS s0 FROM f), b AS (
            SELECT *, CASE WHEN s[2] = 1 THEN s0 ELSE w[2] END AS s1, CASE WHEN s[3] = 1 THEN s0 ELSE w[3] END AS s2 FROM a), c AS (
            SELECT *, [s0, s1, s2, CASE WHEN s[4] = 0 THEN w[4] WHEN s0 = s1 THEN s1 ELSE s2 END] AS seg FROM b), e AS (
            SELECT k, n, i, s[i + 1] AS skip, seg[i + 1] AS segment, list_position(s, 0) = i + 1 AS first_coded, (k + 4 * i + n) % 13 AS y, (3 * k + i + n) % 14 AS uv, (k + i) % 8 + 1 AS joint FROM c, unnest(range(4)) AS u(i))
          SELECT k AS p_partkey, 'OK' AS status, CAST(i AS INTEGER) AS block_no, CAST(skip AS INTEGER) AS skip, CAST(segment AS INTEGER) AS segment_id, CAST(100 + 2 * segment AS INTEGER) AS qindex, CAST(CASE WHEN first_coded THEN k % 4 END AS INTEGER) AS cdef,
                 CAST(CASE WHEN i = 0 THEN 100 + 2 * (k % 41 - 20) END AS INTEGER) AS current_qindex, CAST(CASE WHEN i = 0 THEN n % 9 - 4 END AS INTEGER) AS filter, CAST(y AS INTEGER) AS y_mode, CAST(CASE WHEN skip = 0 THEN uv END AS INTEGER) AS uv_mode,
                 CAST(CASE WHEN skip = 0 AND uv = 13 THEN CASE joint // 3 WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE 1 END * ((n + i) % 16 + 1) END AS INTEGER) AS cfl_alpha_u, CAST(CASE WHEN skip = 0 AND uv = 13 THEN CASE joint % 3 WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE 1 END * ((n + i) % 16 + 1) END AS INTEGER) AS cfl_alpha_v,
                 CAST(CASE WHEN skip = 0 AND (k + i) % 5 <> 2 THEN (k + i) % 5 - 2 END AS INTEGER) AS luma, CAST(CASE WHEN skip = 0 AND (k // 5 + i) % 5 <> 2 THEN (k // 5 + i) % 5 - 2 END AS INTEGER) AS chroma, CAST(CASE WHEN skip = 0 THEN 3 ELSE 0 END AS INTEGER) AS transforms FROM e""")
def tile_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tiles with chroma, segments, filter indexes, changes of quantizer and filter, and chroma from luma."""
    s = tables.StreamTables(fx.build(_dealt(spark, sf_dir, "part").select("p_partkey", "p_size"), _colour, "p_partkey", "payload"), keep_content=True)
    b = probe.tile_probe(s, fx.distributions(), whole=True, blocks=True).select("path", "status", F.posexplode("blocks").alias("block_no", "b"))
    level = lambda i: F.try_element_at("b.tx", F.lit(i))["dc"]
    names = ("skip", "segment_id", "qindex", "cdef", "current_qindex", "y_mode", "uv_mode", "cfl_alpha_u", "cfl_alpha_v")
    return b.select(_key("p_partkey"), "status", "block_no", *[F.col(f"b.{c}") for c in names], F.try_element_at("b.filter", F.lit(1)).alias("filter"), level(1).alias("luma"), level(2).alias("chroma"), F.size("b.tx").alias("transforms"))


def _divided(spark: SparkSession, sf_dir: str) -> tables.StreamTables:
    make = lambda p_partkey, p_size: fx.syntax_stream(fx.divided_tile([p_partkey % 9, p_size % 9, p_partkey // 9 % 9, p_size // 9 % 9], p_partkey))
    return tables.StreamTables(fx.build(_dealt(spark, sf_dir, "part").select("p_partkey", "p_size"), make, "p_partkey", "payload"), keep_content=True)


_LEAVES = "[" + ", ".join(str(len(b)) for _, b in fx.DIVISIONS) + "]"


@query(f"""SELECT p_partkey, 'OK' AS status, 'SPLIT' AS partition, CAST(5 AS BIGINT) AS partition_symbols, CAST(0 AS BIGINT) AS forced_splits, CAST(leaves AS BIGINT) AS leaf_blocks, CAST(leaves AS BIGINT) AS blocks_decoded,
                  CAST((p_partkey + leaves - 1) % 13 AS INTEGER) AS last_mode
           FROM (SELECT p_partkey, list_sum([({_LEAVES})[x + 1] FOR x IN [p_partkey % 9, p_size % 9, p_partkey // 9 % 9, p_size // 9 % 9]]) AS leaves FROM part)""")
def tile_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles whose quarters are divided in each way there is: partition symbols, leaves and blocks to the end of the tile."""
    t = probe.tile_probe(_divided(spark, sf_dir), fx.distributions(), whole=True, blocks=True)
    return t.select(_key("p_partkey"), "status", "partition", "partition_symbols", "forced_splits", "leaf_blocks", "blocks_decoded", F.element_at("blocks", -1)["y_mode"].alias("last_mode"))


@query("""SELECT p_partkey, 'UNSUPPORTED' AS status, CAST(2 AS BIGINT) AS blocks_decoded, CAST(p_partkey % 13 AS INTEGER) AS y_mode, CAST(1 AS INTEGER) AS skip, CAST(1 AS INTEGER) AS depth,
                 CAST(CASE WHEN p_partkey % 9 IN (2, 6) THEN 2 WHEN p_partkey % 9 = 8 THEN 1 WHEN p_partkey % 9 IN (3, 5) THEN 2 ELSE 3 END AS INTEGER) AS wlog2, CAST((p_partkey + 1) % 13 AS INTEGER) AS second_mode FROM part""")
def tile_first_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two blocks only: of a quarter that is divided the first, then that of the next quarter."""
    t = probe.tile_probe(_firsts(spark, sf_dir), fx.distributions(), blocks=True)
    return t.select(_key("p_partkey"), "status", "blocks_decoded", "y_mode", "skip", "depth", "wlog2", F.element_at("blocks", 2)["y_mode"].alias("second_mode"))


def _firsts(spark: SparkSession, sf_dir: str) -> tables.StreamTables:
    def make(p_partkey: int) -> bytes:
        return fx.syntax_stream(fx.divided_tile([p_partkey % 9, 0, 0, 0], p_partkey, first_only=True))

    return tables.StreamTables(fx.build(_dealt(spark, sf_dir, "part").select("p_partkey"), make, "p_partkey", "payload"), keep_content=True)


@query("""SELECT p_partkey, CASE WHEN p_size % 16 IN (1, 2, 3, 4, 5, 6, 7, 8) THEN ['sequence_header', 'temporal_delimiter', 'frame_header', 'tile_group', 'metadata', 'frame', 'redundant_frame_header', 'tile_list'][p_size % 16] WHEN p_size % 16 = 9 THEN 'padding' ELSE 'reserved' END AS obu_name,
                 CAST(CASE WHEN p_partkey = 0 THEN 0 ELSE list_min([k FOR k IN range(33) IF (1 + p_size % 5) * (1::BIGINT << k) >= p_partkey]) END AS INTEGER) AS log2, least(200, greatest(10, p_partkey)) AS clipped, (p_partkey + 6) // 7 AS seventh,
                 CAST(2 * ((p_partkey + 7) // 8) AS BIGINT) AS mi, CASE WHEN p_size % 2 = 1 THEN (2 * ((p_partkey + 7) // 8) + 31) // 32 ELSE (2 * ((p_partkey + 7) // 8) + 15) // 16 END AS superblocks,
                 CAST(CASE WHEN p_size % 3 = 0 THEN p_partkey ELSE p_size END AS BIGINT) AS shown_width, CAST(CASE WHEN p_size <= 20 THEN 0 WHEN p_size <= 60 THEN 1 ELSE 2 END AS INTEGER) AS q_context FROM part""")
def layout_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and sizes as expressions, without Python."""
    p = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size"))
    k, n = F.col("p_partkey").cast("long"), F.col("p_size")
    mi = bits.mi_size(k)
    shown = bits.shown_size(F.when(n % 3 == 0, k), n, n)
    return p.select("p_partkey", bits.obu_type_name((n % 16).cast("int")).alias("obu_name"), bits.tile_log2(1 + n % 5, k).alias("log2"), bits.clip3(10, 200, k).alias("clipped"), bits.ceil_div(k, 7).alias("seventh"), mi.alias("mi"), bits.sb_count(mi, n % 2).alias("superblocks"), shown["width"].alias("shown_width"), bits.q_context(n).alias("q_context"))


@query("""SELECT doc_id, doc_id % 4 = 0 OR doc_id % 4 = 3 AS ok, CASE doc_id % 4 WHEN 1 THEN 'pixi channels != av1C channels' WHEN 2 THEN 'pixi depth != av1C bit depth' END AS reason FROM documents""")
def pixi_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    depths = ((8, 8, 8), (8,), (8, 10, 8), (10, 10, 10))
    files = fx.build(_table(spark, sf_dir, "documents").select("doc_id"), lambda doc_id: fx.still(b"\x80", props=[fx.ispe(64, 64), fx.pixi(*depths[doc_id % 4]), fx.av1c(high=int(doc_id % 4 == 3))]), "doc_id")
    return report.pixi_check(report.primary_properties(tables.MetaTables(files))).select(_key("doc_id"), "ok", "reason")


_GOOD = fx.obu(1, fx.sequence()) + fx.obu(3, fx.frame().bytes()) + fx.obu(4, fx.tile_group([b"\x80"], many=False))
#: A file for each remainder of an id by 13, and the reason why it is rejected.
MUTATIONS = (
    (fx.still(_GOOD), None),
    (fx.still(_GOOD, no_meta=True), "no top-level 'meta' box found"),
    (fx.still(_GOOD, pitm=None), "no primary item"),
    (fx.still(_GOOD, pitm=9), "primary item not found"),
    (fx.still(_GOOD, kind=b"grid"), "primary item is not a coded 'av01' item"),
    (fx.still(_GOOD, no_iloc=True), "primary item has no iloc extents"),
    (fx.still(_GOOD, dref=1), "primary item uses external data_reference_index=1 (unsupported)"),
    (fx.still(_GOOD, method=2), "iloc construction_method=2 (item-based construction) unsupported"),
    (fx.still(_GOOD, extents=[(0, 0)]), "extent length=0 (unsupported in m1)"),
    (fx.still(_GOOD, idat=True, no_idat=True), "construction_method=1 but no idat box found"),
    (fx.still(_GOOD, extents=[(0, 100000)]), "extent overruns file"),
    (fx.still(_GOOD) + b"\x00\x00\x00\x07free", "invalid box size=7 < header_size=8"),
    (fx.still(fx.obu(1, fx.sequence()) + _GOOD), "expected exactly 1 Sequence Header OBU, got 2"),
)


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, extract_status, stage_status, reason): boxes, extraction, sequence headers, headers, in that order; each step
    carries what the one before found, so nothing is joined."""
    whole = [m for m, _ in MUTATIONS]
    files = fx.build(_table(spark, sf_dir, "documents").select("doc_id"), lambda doc_id: whole[doc_id % len(whole)], "doc_id")
    trees = tables.box_trees(files, keep_content=True).select("path", "content", F.try_element_at("diagnostics", F.lit(1))["message"].alias("box_reason"))
    p = tables.payloads(trees, carry=("box_reason",))
    all_ = tables.per_file(p, _seen, "one string, stream_status string, stream_reason string", content="payload", carry=("status", "reason", "box_reason"))
    reason = F.coalesce(F.when(F.col("status") != "OK", F.col("reason")), "box_reason", "one", "stream_reason")
    extracted = F.when(F.col("box_reason").isNotNull() | F.col("one").isNotNull(), "ERROR").otherwise(F.col("status"))
    return all_.select("path", extracted.alias("extract_status"), F.col("stream_status").alias("stage_status"), reason.alias("reason"))


def _seen(data: bytes) -> dict:
    if not data:
        return {"stream_status": "SKIP"}
    s = streams.stream(data)
    return {"one": tables._one_header(s["obus"], []), "stream_status": s["status"], "stream_reason": s["reason"]}


_CASES = " ".join(f"WHEN {i} THEN '{r.replace(chr(39), chr(39) * 2)}'" for i, (_, r) in enumerate(MUTATIONS) if r)


@query(f"""SELECT reason, count(*) AS n FROM (SELECT CASE doc_id % {len(MUTATIONS)} {_CASES} END AS reason FROM documents) WHERE reason IS NOT NULL
           GROUP BY 1 ORDER BY n DESC, reason LIMIT 10""")
def reasons_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_reasons(_verdicts(spark, sf_dir))


@query(f"""SELECT count(*) AS total, count(*) FILTER (doc_id % {len(MUTATIONS)} = 0) AS extract_ok, count(*) FILTER (doc_id % {len(MUTATIONS)} <> 0) AS extract_fail,
                  count(*) FILTER (doc_id % {len(MUTATIONS)} = 0) AS stage_ok, CAST(0 AS BIGINT) AS stage_fail, count(*) FILTER (doc_id % {len(MUTATIONS)} <> 0) AS stage_skip FROM documents""")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.corpus(_verdicts(spark, sf_dir))


#: Streams of known layout: name, bytes in hexadecimal.
GOLDEN = (
    ("1tile", "0a0618157ffc00001a0190220411223344"),
    ("1tile_trailingonly", "0a0618157ffc00001a0190220180"),
    ("1tile_exit1bool", "0a0618157ffc00001a019022022000"),
    ("1tile_exit8bool", "0a0618157ffc00001a019022020080"),
    ("2x2_alltiles_flag0", "0a061819bfff00001a029c00220e0002aaabac01babb00cadadbdcdd"),
    ("2x2_alltiles_flag0_trailingonly", "0a061819bfff00001a029c00220b0000800180000280000080"),
    ("2x2_alltiles_flag0_exit8bool", "0a061819bfff00001a029c00220c000100800100800100800080"),
    ("2x2_subset_flag1", "0a061819bfff00001a029c002209b00121223132333435"),
    ("2x2_subset_flag1_trailingonly", "0a061819bfff00001a029c002208b001800080000000"),
)


def _golden(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, bytes.fromhex(h)) for n, h in GOLDEN], "path string, payload binary")


_GOLDEN_TILES = {"1tile": "0:4", "1tile_trailingonly": "0:1", "1tile_exit1bool": "0:2", "1tile_exit8bool": "0:2", "2x2_alltiles_flag0": "0:3 1:2 2:1 3:4", "2x2_alltiles_flag0_trailingonly": "0:1 1:2 2:3 3:1", "2x2_alltiles_flag0_exit8bool": "0:2 1:2 2:2 3:2", "2x2_subset_flag1": "1:2 2:5", "2x2_subset_flag1_trailingonly": "1:2 2:4"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({2 if n[0] == '2' else 1} AS BIGINT), '{t}')" for n, t in _GOLDEN_TILES.items()) + ") AS t(name, tile_cols, tiles)")
def golden_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.StreamTables(_golden(spark)).nested
    each = F.transform("tiles", lambda t: F.concat_ws(":", t["tile_num"].cast("string"), t["size"].cast("string")))
    return n.select(F.col("path").alias("name"), "tile_info.tile_cols", F.array_join(each, " ").alias("tiles"))


_EXITS = (("1tile_trailingonly", 0, 1), ("1tile_exit1bool", 1, 1), ("1tile_exit8bool", 8, 1), ("2x2_alltiles_flag0_trailingonly", 0, 4), ("2x2_alltiles_flag0_exit8bool", 8, 4), ("2x2_subset_flag1_trailingonly", 0, 2))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {b}, CAST({t} AS BIGINT), CAST({t} AS BIGINT))" for n, b, t in _EXITS) + ") AS t(name, bools, tiles, ok)")
def exit_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.StreamTables(_golden(spark), keep_content=True).tiles
    out = None
    for bools in (0, 1, 8):
        names = [n for n, b, _ in _EXITS if b == bools]
        one = tables.tile_checks(t.where(F.col("path").isin(names)), bools=bools).groupBy(F.col("path").alias("name")).agg(F.lit(bools).alias("bools"), F.count("*").alias("tiles"), F.count_if("ok").alias("ok"))
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT * FROM (VALUES ('0000', 0, '17408,25088,32768,1'), ('b1de', 1, '15360,25088,32768,1'), ('d8ee', 2, '15360,23040,32768,1')) AS t(data, symbol, cdf)")
def symbol_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("0000",), ("b1de",), ("d8ee",)], "path string").withColumn("content", F.unhex("path"))

    def one(data: bytes) -> dict:
        cdf = [16384, 24576, 32768, 0]
        return {"symbol": entropy.Symbols(data).symbol(cdf), "cdf": ",".join(map(str, cdf))}

    return tables.per_file(rows, one, "symbol int, cdf string").withColumnRenamed("path", "data")
