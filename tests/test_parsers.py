"""The parsers without Spark: known answers, written and read again, cut off anywhere."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenbox import fixtures as fx
from lumenbox.bitio import Bits, Malformed, floor_log2, leb128, tile_log2
from lumenbox.operators import containers, entropy, streams
from lumenbox.plans.queries import _GOLDEN_TILES, GOLDEN, MUTATIONS

METHOD_0 = bytes.fromhex(
    "00000018667479706176696600000000617669666d696631000000e06d657461000000000000002168646c72000000000000000070696374000000000000000000000000000000000e7069746d0000000000010000002369696e660000000000010000"
    "0015696e6665020000000001000061763031000000002c696c6f6301000000444000010001000000000000010000020000000000000007000000070000000a0000005669707270000000386970636f00000014697370650000000000000040000000"
    "40000000107069786900000000030808080000000c6176314381000c000000001669706d610000000000000001000103010283000000196d6461740a0618157ffc00001a0190220411223344"
)


def test_golden_boxes():
    rows, notes = containers.boxes(METHOD_0)
    assert not notes
    assert [(r["depth"], r["offset"], r["size"], r["header_size"], r["type"]) for r in rows] == [
        (0, 0, 24, 8, "ftyp"), (0, 24, 224, 12, "meta"), (1, 36, 33, 8, "hdlr"), (1, 69, 14, 8, "pitm"), (1, 83, 35, 8, "iinf"), (1, 118, 44, 8, "iloc"), (1, 162, 86, 8, "iprp"),
        (2, 170, 56, 8, "ipco"), (3, 178, 20, 8, "ispe"), (3, 198, 16, 8, "pixi"), (3, 214, 12, 8, "av1C"), (2, 226, 22, 8, "ipma"), (0, 248, 25, 8, "mdat"),
    ]
    assert [r["parent_seq"] for r in rows] == [None, None, 1, 1, 1, 1, 1, 6, 7, 7, 7, 6, None]
    assert len(containers.boxes(METHOD_0, max_depth=0)[0]) == 3


def test_golden_meta():
    m = containers.meta(METHOD_0)
    (item,) = m["items"]
    assert [(e["offset"], e["length"]) for e in item["extents"]] == [(256, 7), (263, 10)]
    assert [(p["prop_index"], p["essential"]) for p in item["props"]] == [(1, False), (2, False), (3, True)]
    assert m["properties"][0]["ispe"] == {"width": 64, "height": 64} and m["properties"][1]["pixi"] == {"channels": 3, "depths": [8, 8, 8]}
    assert m["properties"][2]["av1c"]["subsampling_x"] == 1 and m["meta"]["primary_item_id"] == 1


@pytest.mark.parametrize("version", [0, 1, 2])
def test_iloc_versions_and_wide_associations(version):
    loc = fx.iloc([{"id": 7, "method": 1, "base": 5, "extents": [(2, 3), (9, 4)]}], version, index_size=4 if version else 0)
    data = fx.full(b"meta", 0, 0, loc, fx.box(b"iprp", fx.box(b"ipco", fx.ispe(3, 4)), fx.ipma([(7, [(1, True), (300, False)])], wide=True)))
    (item,) = containers.meta(data)["items"]
    assert [(e["offset"], e["length"], e["ext_index"]) for e in item["extents"]] == [(7, 3, 0 if version else None), (14, 4, 0 if version else None)]
    assert item["construction_method"] == (1 if version else 0)
    assert [(p["prop_index"], p["essential"]) for p in item["props"]] == [(1, True), (300, False)]


def test_infe_versions():
    odd = fx.full(b"infe", 9, 0, bytes(12))
    m = containers.meta(fx.full(b"meta", 0, 0, fx.iinf(fx.infe(1, version=0), fx.infe(70000, version=3), odd)))
    assert [(i["item_id"], i["item_type"]) for i in m["items"]] == [(1, None), (70000, "av01")]
    assert m["meta"]["warning_count"] == 1 and m["diagnostics"][0]["message"].startswith("unsupported infe version=9")


@pytest.mark.parametrize("kind", [b"pitm", b"iinf", b"iloc"])
def test_unknown_versions(kind):
    m = containers.meta(fx.full(b"meta", 0, 0, fx.full(kind, 9, 0, bytes(20))))
    assert m["meta"]["reason"] == f"unsupported {kind.decode()} version=9" and m["meta"]["status"] == "ERROR"


def test_sizes_do_not_wrap():
    data = fx.u(1, 4) + b"free" + fx.u(2**64 - 1, 8)
    assert containers.boxes(data)[1][0]["message"] == "box overruns parent/file"
    assert containers.boxes(fx.u(0, 4) + b"mdat" + b"xyz")[0][0]["size"] == 11
    assert containers.boxes(fx.u(28, 4) + b"uuid" + bytes(range(20)))[0][0]["uuid"] == bytes(range(16)).hex()


@pytest.mark.parametrize("name,stream", GOLDEN)
def test_golden_streams(name, stream):
    r = streams.stream(bytes.fromhex(stream))
    assert r["status"] == "OK" and " ".join(f"{t['tile_num']}:{t['size']}" for t in r["tiles"]) == _GOLDEN_TILES[name]
    assert r["sequence_header"]["monochrome"] == 0 and "base_q_idx" not in r["frame_header"]


@pytest.mark.parametrize("data", [METHOD_0, *(m for m, _ in MUTATIONS)])
def test_containers_cut_anywhere(data):
    for n in range(len(data)):
        rows, notes = containers.boxes(data[:n])
        assert notes or sum(r["size"] for r in rows if r["depth"] == 0) == n
        containers.meta(data[:n])


@pytest.mark.parametrize("name,stream", GOLDEN)
def test_streams_cut_anywhere(name, stream):
    data = bytes.fromhex(stream)
    for n in range(len(data)):
        r = streams.stream(data[:n])
        assert r["status"] != "OK" or not r["tiles"], n
        assert r["status"] == "OK" or r["diagnostics"]


@given(st.binary(max_size=300))
@settings(max_examples=300, deadline=None)
def test_any_bytes(data):
    containers.boxes(data), containers.meta(data), streams.stream(data), streams.obus(data)
    streams.stream(fx.obu(1, fx.sequence()) + fx.obu(6, data))
    streams.stream(fx.obu(1, data) + fx.obu(3, fx.frame().bytes()))


def test_obu_errors():
    for data, text in ((b"\x92\x00", "OBU forbidden bit set"), (b"\x10\x00", "OBU has_size_field=0 (unsupported)"), (b"\x0a\x05\x00", "OBU payload overruns buffer"), (b"\x0a\xff", "failed to read OBU size LEB128"), (b"\x0e", "truncated OBU extension header")):
        assert streams.obus(data)[1][0]["message"] == text
    assert streams.obus(b"") == ([], []) and streams.obus(bytes(9)) == ([], [])
    two = streams.obus(fx.obu(2, b"") + fx.obu(5, b"ab") + fx.obu(5, b"c"), types=(5,), first_only=True)[0]
    assert [u["obu_no"] for u in two] == [1]


def test_headers_that_are_not_read():
    seq = fx.obu(1, fx.sequence(reduced=False))
    hidden = fx.BitWriter().f(0, 1).f(0, 2).f(0, 1).bytes()
    assert streams.stream(seq + fx.obu(3, hidden))["reason"] == "unsupported: expected KEY_FRAME with show_frame=1"
    assert streams.stream(seq + fx.obu(3, b"\x80"))["reason"] == "unsupported: show_existing_frame=1"
    r = streams.stream(fx.obu(1, fx.sequence()))
    assert r["reason"] == "no Frame Header OBU found" and r["sequence_header"]["max_frame_width"] == 64
    bent = fx.obu(1, fx.sequence(128, 128)) + fx.obu(3, fx.frame(tile_bits=((1, 1), (1, 1), (1, 1), (0, 2), (0, 2))).bytes())
    assert streams.stream(bent + fx.obu(4, b"\x7f"))["reason"] == "nonzero alignment bit"
    assert streams.stream(bent + fx.obu(4, fx.tile_group([b"a", b"b"], subset=(2, 1, 2))))["reason"] == "invalid tg_start/tg_end"
    assert streams.stream(bent + fx.obu(4, b"\x00\x09a"))["reason"] == "tileSize exceeds remaining tile_group payload"


def test_tiles_that_are_not_uniform():
    # 192x64: three superblocks of 64; columns of one and two, rows of one
    bits = fx.BitWriter().f(0, 1).ns(0, 3).ns(1, 2)
    head = fx.frame(tile_bits=((0, 1),))
    head.ns(0, 3).ns(1, 2).f(1, 1).f(0, 2)
    r = streams.stream(fx.obu(1, fx.sequence(192, 64)) + fx.obu(3, head.bytes()) + fx.obu(4, fx.tile_group([b"ab", b"c"])))
    assert bits and r["tile_info"]["mi_col_starts"] == [0, 16, 48] and r["tile_info"]["context_update_tile_id"] == 1
    assert [t["size"] for t in r["tiles"]] == [2, 1]


def test_segmentation_and_128():
    head = fx.frame(tile_bits=((1, 1),))
    head.f(50, 8).f(0, 1).f(0, 2).f(0, 1)
    head.f(1, 1)
    for i in range(8):
        for j in range(8):
            head.f(int((i, j) in ((2, 0), (3, 6))), 1)
            if (i, j) == (2, 0):
                head.f(-50, 9)
    r = streams.stream(fx.obu(1, fx.sequence(128, 128, use_128=1)) + fx.obu(3, head.bytes()))
    f = r["frame_header"]
    assert f["base_q_idx"] == 50 and f["alt_q"][2] == {"enabled": True, "value": -50} and (f["last_active_seg_id"], f["seg_id_pre_skip"], f["coded_lossless"]) == (3, 1, 0)
    assert r["tile_info"]["tile_cols"] == 1


SYMBOLS = [("0000", 0, [17408, 25088, 32768, 1]), ("b1de", 1, [15360, 25088, 32768, 1]), ("d8ee", 2, [15360, 23040, 32768, 1])]


@pytest.mark.parametrize("data,symbol,after", SYMBOLS)
def test_symbols(data, symbol, after):
    cdf = [16384, 24576, 32768, 0]
    assert entropy.Symbols(bytes.fromhex(data)).symbol(cdf) == symbol and cdf == after
    cdf = [16384, 24576, 32768, 7]
    assert entropy.Symbols(bytes.fromhex(data), adapt=False).symbol(cdf) == symbol and cdf == [16384, 24576, 32768, 7]


def test_symbol_state():
    cdf, s = [16384, 32768, 0], entropy.Symbols(b"\0")
    for _ in range(100):
        s.symbol(cdf)
    assert cdf[-1] == 32
    assert entropy.Symbols(bytes.fromhex("0000")).symbol([16384, 32768, 0]) == 0 and entropy.Symbols(bytes.fromhex("fffe")).symbol([16384, 32768, 0]) == 1
    s = entropy.Symbols(bytes(2))
    assert (s.bool(), s.literal(4)) == (0, 0)
    s = entropy.Symbols(b"\xff\xff")
    assert (s.bool(), s.literal(1)) == (1, 1)
    with pytest.raises(Malformed):
        entropy.Symbols(bytes(2)).symbol([100, 200, 300, 0])


def test_tile_ends():
    check = lambda h, *a: entropy.tile_check(bytes.fromhex(h), *a)
    assert check("8000", "exit") is None and check("0000", "exit") == "trailing bit not 1"
    assert check("80", "trailing") is None and check("0001", "trailing") is None and check("80000000", "trailing") and check("", "trailing") == "invalid args"
    assert check("2000", "exit", 1) is None and check("0080", "exit", 8) is None
    assert check("8001", "exit") == "nonzero trailing padding bit"


@given(st.integers(0, 2**63 - 1))
def test_leb128(x):
    assert leb128(fx.leb128(x) + b"\0", 0) == (x, len(fx.leb128(x)))
    assert leb128(fx.leb128(x)[:-1], 0) is None


@given(st.integers(0, 2**31 - 2), st.integers(1, 5000).flatmap(lambda n: st.tuples(st.integers(0, n - 1), st.just(n))), st.integers(-64, 63))
def test_codes(x, pair, signed):
    v, n = pair
    b = Bits(fx.BitWriter().uvlc(x).ns(v, n).f(signed, 7).bytes())
    assert (b.uvlc("u"), b.ns(n, "n"), b.su(7, "s")) == (x, v, signed)


def test_small_functions():
    assert [floor_log2(x) for x in (0, 1, 2, 3, 255, 256)] == [0, 0, 1, 1, 7, 8]
    assert [tile_log2(1, x) for x in (1, 2, 3, 64)] == [0, 1, 2, 6] and tile_log2(64, 1) == 0
    assert containers.fourcc(b"a\x00\x7fZ") == "a..Z"
    out = streams.ivf(b"abc", 5, 6)
    assert out[:8] == b"DKIF\0\0 \0" and out[32:36] == (3).to_bytes(4, "little") and out[44:] == b"abc"
