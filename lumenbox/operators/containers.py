"""ISO-BMFF boxes and HEIF item metadata of one file's bytes, as plain records."""

from __future__ import annotations

from functools import lru_cache
from typing import Any

from ..bitio import Cursor, Malformed
from . import reasons as why

CONTAINERS = frozenset(b"moov trak mdia minf stbl edts udta moof traf meta iprp ipco".split())
MAX_DEPTH = 64


@lru_cache(maxsize=4096)
def fourcc(raw: bytes) -> str:
    """Printable ASCII as it is, anything else as a dot."""
    return "".join(chr(b) if 32 <= b <= 126 else "." for b in raw)


def box_header(data: bytes, at: int, end: int) -> dict[str, Any]:
    """The box at ``at`` within a parent that ends at ``end``; sizes are checked without wrapping."""
    if end - at < 8:
        raise Malformed(why.BOX_HEADER_CUT)
    size, raw, header, uuid = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8, None
    if size == 1:
        if end - at < 16:
            raise Malformed(why.LARGE_SIZE_CUT)
        size, header = int.from_bytes(data[at + 8 : at + 16], "big"), 16
    elif size == 0:
        size = end - at
    if raw == b"uuid":
        if end - at < header + 16:
            raise Malformed(why.UUID_CUT)
        uuid, header = data[at + header : at + header + 16].hex(), header + 16
    if size < header:
        raise Malformed(why.BOX_SIZE.format(size=size, header=header))
    if size > end - at:
        raise Malformed(why.BOX_OVERRUNS)
    return {"offset": at, "size": size, "header_size": header, "type_raw": raw, "type": fourcc(raw), "uuid": uuid}


def boxes(data: bytes, max_depth: int = MAX_DEPTH) -> tuple[list[dict[str, Any]], list[dict[str, Any]]]:
    """All boxes depth first, and diagnostics: rows up to an error stay."""
    out: list[dict[str, Any]] = []
    stack: list[tuple[int, int, int, int | None]] = [(0, len(data), 0, None)]  # what is left of the open parents
    try:
        while stack:
            at, end, depth, parent = stack.pop()
            if at >= end:
                continue
            box = box_header(data, at, end)
            box |= {"box_seq": len(out), "parent_seq": parent, "depth": depth, "is_fullbox": False, "version": None, "flags": None, "is_container": box["type_raw"] in CONTAINERS}
            stack.append((at + box["size"], end, depth, parent))
            if box["type_raw"] == b"meta":
                if box["size"] < box["header_size"] + 4:
                    raise Malformed(why.META_TOO_SMALL)
                word = int.from_bytes(data[at + box["header_size"] : at + box["header_size"] + 4], "big")
                box |= {"is_fullbox": True, "version": word >> 24, "flags": word & 0xFFFFFF, "header_size": box["header_size"] + 4}
            box |= {"payload_off": at + box["header_size"], "payload_len": box["size"] - box["header_size"]}
            out.append(box)
            if box["is_container"] and depth < max_depth:
                stack.append((box["payload_off"], at + box["size"], depth + 1, box["box_seq"]))
    except Malformed as e:
        return out, [problem("m0", e, at)]
    return out, []


def problem(stage: str, error: Malformed | str, at: int | None = None, severity: str | None = None) -> dict[str, Any]:
    text = str(error)
    return {"stage": stage, "severity": severity or getattr(error, "severity", "ERROR"), "code": text.split(":")[0].split("=")[0].strip().replace(" ", "_")[:60], "message": text, "byte_offset": at}


def _children(data: bytes, at: int, end: int):
    while at < end:
        box = box_header(data, at, end)
        yield box, Cursor(data, at + box["header_size"], at + box["size"], box["type"])
        at += box["size"]


class Meta:
    """What one ``meta`` box says; items are listed as they are first mentioned, scalars are those mentioned last."""

    def __init__(self) -> None:
        self.meta: dict[str, Any] = {k: None for k in ("handler_type", "primary_item_id", "idat_off", "idat_len", "status", "reason")}
        self.items: dict[int, dict[str, Any]] = {}
        self.properties: list[dict[str, Any]] = []
        self.notes: list[dict[str, Any]] = []

    def item(self, item_id: int) -> dict[str, Any]:
        if item_id not in self.items:
            self.items[item_id] = {
                "item_no": len(self.items), "item_id": item_id, "item_type": None, "has_iloc": False, "iloc_version": None, "construction_method": None,
                "data_reference_index": None, "base_offset": None, "extents": [], "props": [],
            }
        return self.items[item_id]

    def warn(self, text: str, at: int) -> None:
        self.notes.append(problem("m1", text, at, "WARNING"))

    # children of meta

    def hdlr(self, c: Cursor) -> None:
        c.fullbox()
        c.take(4, "pre_defined")
        self.meta["handler_type"] = fourcc(c.take(4, "handler_type"))

    def pitm(self, c: Cursor) -> None:
        version, _ = c.fullbox()
        if version > 1:
            raise Malformed(why.PITM_VERSION.format(version=version))
        self.meta["primary_item_id"] = c.be(4 if version else 2, f"item_ID(v{version})")

    def iinf(self, c: Cursor) -> None:
        version, _ = c.fullbox()
        if version > 1:
            raise Malformed(why.IINF_VERSION.format(version=version))
        count = c.be(4 if version else 2, f"entry_count(v{version})")
        for i in range(count):
            if c.at >= c.end:
                raise Malformed(why.IINF_CUT.format(i=i, count=count))
            box = box_header(c.data, c.at, c.end)
            if box["type_raw"] != b"infe":
                raise Malformed(why.IINF_CHILD.format(type=box['type']))
            self.infe(Cursor(c.data, c.at + box["header_size"], c.at + box["size"], "infe"))
            c.at += box["size"]

    def infe(self, c: Cursor) -> None:
        version, _ = c.fullbox()
        if version > 3:
            self.warn(why.INFE_VERSION.format(version=version), c.at)
            return
        item = c.be(4 if version == 3 else 2, f"item_ID(v{version})")
        c.take(2, "item_protection_index")
        row = self.item(item)
        if version >= 2:
            row["item_type"] = fourcc(c.take(4, "item_type"))

    def iloc(self, c: Cursor) -> None:
        version, _ = c.fullbox()
        sizes = c.be(2, "size fields")
        offset_size, length_size, base_size, index_size = (sizes >> s & 15 for s in (12, 8, 4, 0))
        if version > 2:
            raise Malformed(why.ILOC_VERSION.format(version=version))
        wide, v = (4, "v2") if version == 2 else (2, "v0/v1")

        def sized(n: int, what: str) -> int:
            if n > 8:
                raise Malformed(why.ILOC_CUT.format(what=what))
            return c.be(n, what)

        for _ in range(c.be(wide, f"item_count({v})")):
            row = self.item(c.be(wide, f"item_ID({v})"))
            method = c.be(2, "construction_method") & 15 if version else 0
            dref = c.be(2, "data_reference_index")
            base = sized(base_size, "base_offset")
            count = c.be(2, "extent_count")
            row |= {"has_iloc": True, "iloc_version": version, "construction_method": method, "data_reference_index": dref, "base_offset": base}
            for _ in range(count):
                index = sized(index_size, "extent_index") if version and index_size else None
                offset = base + sized(offset_size, "extent_offset")
                length = sized(length_size, "extent_length")
                row["extents"].append({"extent_no": len(row["extents"]), "offset": offset, "length": length, "ext_index": index})

    def iprp(self, c: Cursor) -> None:
        for box, inner in _children(c.data, c.at, c.end):
            if box["type_raw"] == b"ipco":
                for prop, body in _children(inner.data, inner.at, inner.end):
                    self.property(prop, body)
            elif box["type_raw"] == b"ipma":
                self.ipma(inner)

    def property(self, box: dict[str, Any], c: Cursor) -> None:
        row: dict[str, Any] = {"prop_index": len(self.properties) + 1, "type": box["type"], "box_offset": box["offset"], "box_size": box["size"], "ispe": None, "pixi": None, "av1c": None}
        self.properties.append(row)
        if row["type"] == "ispe":
            if not c.fullbox()[0]:
                row["ispe"] = {"width": c.be(4, "width/height"), "height": c.be(4, "width/height")}
        elif row["type"] == "pixi":
            if not c.fullbox()[0]:
                n = c.be(1, "num_channels")
                row["pixi"] = {"channels": n, "depths": [c.be(1, "bit_depth") for _ in range(n)][:16]}
        elif row["type"] == "av1C":
            row["av1c"] = av1c(c.take(4, "bytes"))

    def ipma(self, c: Cursor) -> None:
        version, flags = c.fullbox()
        count = c.be(4, "entry_count")
        for _ in range(count):
            if version > 1:
                raise Malformed(why.IPMA_VERSION.format(version=version))
            row = self.item(c.be(4 if version else 2, f"item_ID(v{version})"))
            for _ in range(c.be(1, "association_count")):
                bits = 15 if flags & 1 else 7
                word = c.be(2 if flags & 1 else 1, "assoc16" if flags & 1 else "assoc8")
                row["props"].append({"assoc_no": len(row["props"]), "prop_index": word & ((1 << bits) - 1), "essential": bool(word >> bits)})

    def idat(self, c: Cursor) -> None:
        self.meta |= {"idat_off": c.at, "idat_len": c.end - c.at}

    CHILDREN = ("hdlr", "pitm", "iinf", "iloc", "iprp", "idat")


def av1c(raw: bytes) -> dict[str, Any]:
    """The four bytes of an AV1 configuration."""
    _, b1, b2, b3 = raw
    delay = bool(b3 >> 4 & 1)
    return {
        "version": raw[0] & 0x7F, "profile": b1 >> 5, "level_idx_0": b1 & 31, "tier_0": b2 >> 7, "high_bitdepth": b2 >> 6 & 1, "twelve_bit": b2 >> 5 & 1, "monochrome": b2 >> 4 & 1,
        "subsampling_x": b2 >> 3 & 1, "subsampling_y": b2 >> 2 & 1, "chroma_sample_position": b2 & 3, "ipd_present": int(delay), "ipd_minus_one": b3 & 15 if delay else None,
    }


def meta(data: bytes) -> dict[str, Any]:
    """{meta, items (with extents and props), properties, diagnostics} of the first ``meta`` at the top."""
    m, at = Meta(), 0
    try:
        found = None
        while at < len(data) and found is None:
            box = box_header(data, at, len(data))
            if box["type_raw"] == b"meta":
                found = box
            else:
                at += box["size"]
        if found is None:
            raise Malformed(why.NO_META)
        if found["size"] < found["header_size"] + 4:
            raise Malformed(why.META_TOO_SMALL)
        for box, c in _children(data, at + found["header_size"] + 4, at + found["size"]):
            at = box["offset"]
            if box["type"] in m.CHILDREN:
                getattr(m, box["type"])(c)
        m.meta["status"] = "OK"
    except Malformed as e:
        m.meta |= {"status": e.severity, "reason": str(e)}
        m.notes.append(problem("m1", e, at))
    m.meta |= {"item_count": len(m.items), "property_count": len(m.properties), "warning_count": sum(n["severity"] == "WARNING" for n in m.notes)}
    return {"meta": m.meta, "items": list(m.items.values()), "properties": m.properties, "diagnostics": m.notes}
