"""Bits and bytes of media records, read with bounds."""

from __future__ import annotations


class Malformed(ValueError):
    """Input that breaks its format."""

    severity = "ERROR"


class Unsupported(Malformed):
    """Input that is fine and goes beyond what this engine reads."""

    severity = "UNSUPPORTED"


class Bits:
    """Most significant bit first over ``data``."""

    def __init__(self, data: bytes) -> None:
        self.data, self.pos, self.end = data, 0, 8 * len(data)

    def f(self, n: int, what: str) -> int:
        if n == 0:
            return 0
        if self.pos + n > self.end:
            raise Malformed(f"truncated {what}")
        first, last = self.pos >> 3, (self.pos + n + 7) >> 3
        word = int.from_bytes(self.data[first:last], "big")
        self.pos += n
        return (word >> (8 * last - self.pos)) & ((1 << n) - 1)

    def su(self, n: int, what: str) -> int:
        value = self.f(n, what)
        return value - (1 << n) if value >> (n - 1) else value

    def ns(self, n: int, what: str) -> int:
        """One of n values: short codes for the first ones when n is no power of two."""
        w = n.bit_length()
        short = (1 << w) - n
        v = self.f(w - 1, what)
        return v if v < short else (v << 1) - short + self.f(1, what)

    def uvlc(self, what: str) -> int:
        zeros = 0
        while not self.f(1, what):
            zeros += 1
            if zeros > 31:
                raise Malformed("uvlc too long")
        return (1 << zeros) - 1 + self.f(zeros, what)

    def align(self, strict: bool = False) -> None:
        while self.pos & 7:
            if self.f(1, "byte_alignment") and strict:
                raise Malformed("nonzero alignment bit")

    def fork(self) -> Bits:
        other = Bits(self.data)
        other.pos = self.pos
        return other


class Cursor:
    """Big-endian fields of data[at:end]; ``box`` names the box in messages."""

    def __init__(self, data: bytes, at: int, end: int, box: str) -> None:
        self.data, self.at, self.end, self.box = data, at, end, box

    def be(self, n: int, what: str) -> int:
        at, self.at = self.at, self.at + n
        if self.at > self.end:
            self.at = at
            raise Malformed(f"read {self.box} {what} failed")
        return int.from_bytes(self.data[at : self.at], "big")

    def take(self, n: int, what: str) -> bytes:
        if n > self.end - self.at:
            raise Malformed(f"read {self.box} {what} failed")
        self.at += n
        return self.data[self.at - n : self.at]

    def fullbox(self) -> tuple[int, int]:
        word = self.be(4, "FullBox")
        return word >> 24, word & 0xFFFFFF


def leb128(data: bytes, at: int) -> tuple[int, int] | None:
    """(value, position after it), or None where it is cut off or longer than ten bytes."""
    value = 0
    for i in range(10):
        if at + i >= len(data):
            return None
        value |= (data[at + i] & 0x7F) << (7 * i)
        if not data[at + i] & 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at + i + 1
    return None


def floor_log2(x: int) -> int:
    return max(1, x).bit_length() - 1


def tile_log2(block: int, target: int) -> int:
    """The smallest k for which block << k reaches target."""
    k = 0
    while block << k < target and k < 32:
        k += 1
    return k
