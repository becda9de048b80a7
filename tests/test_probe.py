"""The tile probe: symbols come as often as their distributions say, at every edge, and never break."""

import json
import random
from collections import Counter

import pytest

from lumenbox import fixtures as fx
from lumenbox.operators import coefficients, probe, syntax, tables
from lumenbox.operators.entropy import Symbols
from lumenbox.plans import queries

BASE = {"mi_rows": 16, "mi_cols": 16, "use_128x128_superblock": 0, "disable_cdf_update": 1, "monochrome": 0, "subsampling_x": 1, "subsampling_y": 1, "coded_lossless": 0}


def _even(rows, symbols):
    return [[32768 * (i + 1) // symbols for i in range(symbols)] for _ in range(rows)]


TABLES = probe.load_tables(json.dumps({k: _even(*v) for k, v in syntax.MODE_TABLES.items()}))
TILES = [x.to_bytes(2, "big") + b"\x5a\xa5\x3c\xc3" * 4 for x in range(0, 65536, 16)]


def test_distributions():
    for table in (*syntax.PARTITION_CDFS, syntax.SKIP_CDFS):
        for cdf in table:
            assert cdf[-1] == 32768 and sorted(cdf) == list(cdf)
    assert [len(t[0]) for t in syntax.PARTITION_CDFS] == [4, 10, 10, 10, 8]


@pytest.mark.parametrize("use_128", [0, 1])
def test_partitions_come_as_often_as_stated(use_128):
    p = BASE | {"use_128x128_superblock": use_128, "mi_rows": 32, "mi_cols": 32}
    n = Counter(syntax.probe(t, p)["partition"] for t in TILES)
    cdf = syntax.PARTITION_CDFS[4 if use_128 else 3][0]
    for name, mass in zip(syntax.PARTITIONS, (b - a for a, b in zip((0, *cdf), cdf, strict=False)), strict=False):
        assert abs(n[name] / len(TILES) - mass / 32768) < 0.01


def test_edges():
    out = syntax.probe(TILES[9], BASE | {"mi_rows": 2, "mi_cols": 2})
    assert out["forced"] and out["partition"] == "SPLIT" and out["depth"] >= 3
    kinds = {syntax.probe(t, BASE | {"mi_rows": 4})["partition"] for t in TILES}
    assert kinds == {"HORZ", "SPLIT"} and {syntax.probe(t, BASE | {"mi_cols": 4})["partition"] for t in TILES} == {"VERT", "SPLIT"}
    cdf = syntax.PARTITION_CDFS[3][0]
    mass = dict(zip(syntax.PARTITIONS, (b - a for a, b in zip((0, *cdf), cdf, strict=False)), strict=False))
    assert syntax.edge_cdf(cdf, syntax.SPLITS_DOWN, len(cdf))[0] == mass["NONE"] + mass["HORZ"] + mass["HORZ_B"] + mass["HORZ_4"]
    assert syntax.probe(b"", BASE)["reason"] == "empty tile" and syntax.probe(b"\0", BASE | {"mi_rows": 0})["status"] == "ERROR"
    assert "unsupported: an 8x8 block across the lower edge" in {syntax.probe(t, BASE | {"mi_rows": 1, "mi_cols": 16})["reason"] for t in TILES}


def test_modes():
    seen = Counter()
    for t in TILES:
        out = syntax.probe(t, BASE, TABLES)
        assert out["status"] == "UNSUPPORTED" and 0 <= out["y_mode"] < 13
        assert ("angle_delta_y" in out) == (not out["skip"] and 1 <= out["y_mode"] <= 8)
        assert ("uv_mode" in out) == (not out["skip"])
        if "cfl_signs" in out:
            seen["cfl"] += 1
            assert max(out["wlog2"], out["hlog2"]) <= 3 and -16 <= out["cfl_alpha_u"] <= 16 and (out["cfl_alpha_u"], out["cfl_alpha_v"]) != (0, 0)
        seen["all"] += 1
    assert syntax.probe(TILES[0], BASE | {"monochrome": 1}, TABLES).get("uv_mode") is None
    assert "were not given" in syntax.probe(TILES[0], BASE)["reason"]
    assert TABLES["y_mode"][0] == _even(4, 13)[0]  # a tile's changes stay its own


def test_tables_are_checked():
    with pytest.raises(ValueError, match="y_mode"):
        probe.load_tables("{}")


def test_table(spark):
    s = tables.StreamTables(queries._golden(spark), keep_content=True)
    got = probe.tile_probe(s, TABLES).collect()
    assert len(got) == s.tiles.count() and {r.status for r in got} == {"UNSUPPORTED"} and all(r.partition for r in got)


def _nest(dims, symbols):
    return [_nest(dims[1:], symbols) for _ in range(dims[0])] if dims else _even(1, symbols)[0]


ALL = probe.load_tables(json.dumps({k: _even(*v) for k, v in syntax.MODE_TABLES.items()} | {k: _nest(*v) for k, v in (coefficients.BLOCK_TABLES | coefficients.COEFF_TABLES).items()}))


def test_blocks_to_the_coefficients():
    seen = Counter()
    p = BASE | {"base_q_idx": 100, "tx_mode": 2, "reduced_tx_set": 0, "enable_filter_intra": 1, "allow_screen_content_tools": 1}
    for t in TILES:
        out = syntax.probe(t, p, ALL)
        assert out["status"] == "UNSUPPORTED" or out["reason"] == "Exp-Golomb length too long", out
        if "tx_type" in out:
            seen[out["tx_type"]] += 1
            w, h = (4 << out["wlog2"]), (4 << out["hlog2"])
            assert out["tx_width"] <= min(w, 64) and out["tx_height"] <= min(h, 64)
        if out.get("all_zero") == 0 and "eob" in out:
            assert 1 <= out["eob"] <= min(out["tx_width"], 32) * min(out["tx_height"], 32) and 1 <= out["cul_level"] <= 63
            seen["coded"] += 1
        seen["filter"] += out.get("use_filter_intra", 0)
    assert seen["coded"] > 100 and seen["DCT_DCT"] and seen["V_DCT"] and seen["IDTX"] and seen["filter"]
    with pytest.raises(ValueError, match="txb_skip"):
        coefficients.check({k: v for k, v in ALL.items() if k != "txb_skip"})
    flat = syntax.probe(TILES[5], p | {"coded_lossless": 1}, ALL)
    assert flat.get("tx_width", 4) == 4


def test_geometry():
    assert [coefficients.block_index(*b) for b in ((0, 0), (1, 1), (5, 5), (0, 2), (4, 2))] == [0, 3, 15, 16, 21]
    assert coefficients.largest_transform(5, 4) == (6, 6) and coefficients.split_transform(4, 6) == (4, 5) and coefficients.split_transform(3, 3) == (2, 2)
    assert coefficients.max_depth(0, 0) == 0 and coefficients.max_depth(1, 1) == 1 and coefficients.max_depth(4, 4) == 4
    for kind in ("2D", "HORIZ", "VERT"):
        for w, h in ((2, 2), (2, 3), (4, 2), (5, 5)):
            assert sorted(coefficients.scan(w, h, kind)) == list(range(1 << (w + h)))
    assert coefficients.scan(2, 2, "2D")[:6] == [0, 1, 4, 8, 5, 2]
    assert [[coefficients.base_offset(r, c, 2, 2) for c in range(4)] for r in range(4)] == [[0, 1, 6, 6], [1, 6, 6, 21], [6, 6, 21, 21], [6, 21, 21, 21]]
    assert coefficients.base_offset(1, 3, 2, 3) == 11 and coefficients.base_offset(3, 1, 3, 2) == 16


def test_small_readers():
    assert [coefficients.q_context(q) for q in (0, 20, 21, 60, 61, 120, 121)] == [0, 0, 1, 1, 2, 2, 3]
    for count in range(1, 9):
        for ref in range(count):
            got = [coefficients.neg_deinterleave(d, ref, count) for d in range(count)]
            assert sorted(got) == list(range(count)) and got[0] == (ref if ref < count - 1 or count == 1 else count - 1)
    assert coefficients.segment_q(100, [{"enabled": True, "value": -200}], 0) == 0
    values = {coefficients.delta(Symbols(t), [8192, 16384, 24576, 32768, 0], 1) for t in TILES}
    assert min(values) < -10 and max(values) > 10 and 0 in values and all(v % 2 == 0 for v in values)


def test_symbol_writer():
    rng = random.Random(1)
    for _ in range(200):
        w, seq = fx.SymbolWriter(), []
        for _ in range(rng.randrange(80)):
            n = rng.randrange(2, 15)
            seq.append((rng.randrange(n), fx.distribution("x", (rng.randrange(99),), n)))
            w.symbol(*seq[-1])
        s = Symbols(w.bytes(), adapt=False)
        assert [s.symbol([*c, 0]) for _, c in seq] == [v for v, _ in seq]
        s.exit()


FLAT = {"mi_rows": 16, "mi_cols": 16, "disable_cdf_update": 1, "monochrome": 1, "base_q_idx": 100, "tx_mode": 2}


def test_whole_tiles_as_written():
    rng = random.Random(2)
    for _ in range(300):
        blocks = [{"skip": rng.randrange(2), "y_mode": rng.randrange(13), "angle": rng.randrange(7) - 3, "dc": rng.randrange(-80, 81), "q": 2} for _ in range(4)]
        out = syntax.probe(fx.quarters_tile(blocks), FLAT, fx.distributions(), whole=True)
        assert out["status"] == "OK" and out["partition"] == "SPLIT" and out["blocks_decoded"] == 4
        for b, g in zip(blocks, out["blocks"], strict=True):
            assert (g["skip"], g["y_mode"]) == (b["skip"], b["y_mode"]) and g.get("angle_delta_y") == (b["angle"] if 1 <= b["y_mode"] <= 8 and not b["skip"] else None)
            assert [t.get("dc", 0) for t in g["tx"]] == ([] if b["skip"] else [b["dc"]])
        first = syntax.probe(fx.quarters_tile(blocks), FLAT, fx.distributions())
        assert first["status"] == "UNSUPPORTED" and first["blocks_decoded"] == 2 and [b["y_mode"] for b in first["blocks"]] == [b["y_mode"] for b in blocks[:2]]
        kinds = [rng.randrange(9) for _ in range(4)]
        out = syntax.probe(fx.divided_tile(kinds, 5), FLAT, fx.distributions(), whole=True)
        n = sum(len(fx.DIVISIONS[x][1]) for x in kinds)
        assert (out["status"], out["leaf_blocks"], out["partition_symbols"]) == ("OK", n, 5) and [b["y_mode"] for b in out["blocks"]] == [(5 + i) % 13 for i in range(n)]
    cut = fx.divided_tile([8] * 4, 0)
    assert syntax.probe(cut + b"\x01", FLAT, fx.distributions(), whole=True)["status"] == "ERROR"


def test_any_tile_ends():
    """Whole tiles of noise, with everything a header can switch on: each comes to an end with a status."""
    rng = random.Random(3)
    seen, fields = Counter(), Counter()
    for i in range(400):
        p = {
            "mi_rows": rng.randrange(1, 40), "mi_cols": 2 * rng.randrange(1, 20), "use_128x128_superblock": i % 2, "disable_cdf_update": i // 2 % 2, "monochrome": int(i % 5 == 0), "subsampling_x": int(i % 3 > 0), "subsampling_y": int(i % 3 > 1),
            "base_q_idx": (0, 30, 100, 200)[i % 4], "tx_mode": i % 3, "reduced_tx_set": i // 3 % 2, "enable_filter_intra": 1, "allow_screen_content_tools": int(i % 7 == 0), "allow_intrabc": int(i % 50 == 0),
            "segmentation_enabled": int(i % 4 < 2), "seg_id_pre_skip": i % 2, "last_active_seg_id": i % 8, "alt_q": [{"enabled": x % 2 == 1, "value": 10 * x - 40} for x in range(8)],
            "enable_cdef": 1, "cdef_bits": i % 4, "delta_q_present": int(i % 4 > 0), "delta_q_res": i % 4, "delta_lf_present": 1, "delta_lf_res": 1, "delta_lf_multi": i % 2, "coded_lossless": None,
        }
        out = syntax.probe(rng.randbytes(rng.randrange(1, 900)), p, fx.distributions(), whole=True)
        assert out["status"] in ("OK", "ERROR", "UNSUPPORTED") and (out["reason"] is None) == (out["status"] == "OK")
        seen[out["status"]] += 1
        for b in out["blocks"]:
            fields.update(f for f in b if b[f] is not None)
            assert 0 <= b.get("segment_id", 0) < 8 and 1 <= b.get("current_qindex", 1) <= 255 and all(-63 <= x <= 63 for x in b.get("filter", ()))
            fields.update(f"plane{t['plane']}" for t in b["tx"] if "dc" in t)
    assert seen["ERROR"] > 50 and all(fields[f] for f in ("segment_id", "cdef", "current_qindex", "filter", "uv_mode", "cfl_signs", "has_palette_y", "use_filter_intra", "tx_depth", "plane0", "plane1", "plane2"))


def test_contexts():
    g = syntax.Grid(4, 4)
    g.fill(0, 0, 1, 1, skip=1, segment=3)
    assert (g.above("skip", 2, 1), g.left("skip", 1, 2), g.corner("segment", 2, 2), g.above("skip", 0, 0), g.left("skip", 4, 2)) == (1, 1, 3, None, None)
    t = syntax.Tile(b"\x80" * 4, BASE | {"mi_rows": 16, "mi_cols": 16}, ALL, True)
    size = (3, 3)
    assert t.skip_context(0, 2, 2, (3, 3), size) == 0 and t.skip_context(0, 2, 2, (4, 4), size) == 1 and t.skip_context(1, 2, 2, (3, 3), size) == 7
    for level, want in (((1, 0), 2), ((5, 0), 3), ((2, 3), 4), ((2, 9), 5), ((9, 9), 6)):
        t.planes[0].level = ([level[0]] * 16, [level[1]] * 16)
        assert t.skip_context(0, 2, 2, (4, 4), size) == want
    t.planes[1].sign = ([1] * 8, [0] * 8)
    assert t.skip_context(1, 2, 2, (4, 4), size) == 11 and t.sign_context(1, 2, 2, size) == 1
    t.planes[1].sign = ([1] * 8, [2] * 8)
    assert t.skip_context(1, 2, 2, (3, 3), size) == 9 and t.sign_context(1, 2, 2, size) == 0


def test_block_tables(spark):
    rows = spark.range(30).select("id")
    tiles = fx.build(rows, lambda id: fx.syntax_stream(fx.divided_tile([id % 9, id % 4, 0, 8], id)), "id", "payload")
    got = probe.tile_probe(tables.StreamTables(tiles, keep_content=True), fx.distributions(), whole=True, blocks=True)
    assert "Join" not in got._jdf.queryExecution().toString() and {r.status for r in got.collect()} == {"OK"}
    blocks = probe.mi_blocks(got)
    assert blocks.where("path = '11'").orderBy("block_no").first().y_mode == 11 and blocks.count() == got.agg({"leaf_blocks": "sum"}).first()[0]
    assert probe.transforms(got).count() == 0  # all blocks are skipped
