"""The arithmetic decoder for AV1 symbols, and checks of a tile's last bits."""

from __future__ import annotations

from ..bitio import Malformed, floor_log2


class Symbols:
    """State of one tile. A distribution is a list of N cumulative values, the last of them 32768, and a count."""

    def __init__(self, data: bytes, adapt: bool = True) -> None:
        if not data:
            raise Malformed("invalid args")
        self.data, self.adapt = data, adapt
        n = min(8 * len(data), 15)
        self.pos = 0
        self.value = 0x7FFF ^ (self._take(n) << (15 - n))
        self.range, self.left = 1 << 15, 8 * len(data) - 15

    def _take(self, n: int) -> int:
        if not n:
            return 0
        last = (self.pos + n + 7) >> 3
        word = int.from_bytes(self.data[self.pos >> 3 : last], "big")
        self.pos += n
        return (word >> (8 * last - self.pos)) & ((1 << n) - 1)

    def symbol(self, cdf: list[int]) -> int:
        n = len(cdf) - 1
        if n < 2 or cdf[n - 1] != 32768:
            raise Malformed("cdf[n-1] must equal 1<<15")
        value, low, scale, more, s = self.value, self.range, self.range >> 8, 4 * (n - 1), 0
        while True:
            high, low = low, ((scale * ((32768 - cdf[s]) >> 6)) >> 1) + more
            if value >= low:
                break
            s, more = s + 1, more - 4
        value -= low
        span = high - low
        bits = 16 - (span.bit_length() or 1)
        if bits:
            span <<= bits
            real = min(bits, max(0, self.left))
            value = (self._take(real) << (bits - real)) ^ (((value + 1) << bits) - 1)
            self.left -= bits
        self.value, self.range = value, span
        if self.adapt:
            rate = 3 + (cdf[n] > 15) + (cdf[n] > 31) + min(floor_log2(n), 2)
            for i in range(n - 1):
                if i < s:
                    cdf[i] -= cdf[i] >> rate
                else:
                    cdf[i] += (32768 - cdf[i]) >> rate
            cdf[n] = min(32, cdf[n] + 1)
        return s

    def bool(self) -> int:
        keep, self.adapt = self.adapt, False
        try:
            return self.symbol([16384, 32768, 0])
        finally:
            self.adapt = keep

    def literal(self, n: int) -> int:
        x = 0
        for _ in range(n):
            x = 2 * x + self.bool()
        return x

    def exit(self) -> None:
        """The padding after the last symbol: a one, then zeros to the end of the tile."""
        if self.left < -14:
            raise Malformed(f"SymbolMaxBits < -14 at exit ({self.left})")
        at = self.pos - min(15, self.left + 15)
        rest = 8 * len(self.data) - at
        tail = int.from_bytes(self.data[at >> 3 :], "big") & ((1 << rest) - 1)
        if tail != 1 << (rest - 1):
            raise Malformed("trailing bit not 1" if not tail >> (rest - 1) else "nonzero trailing padding bit")


def trailing_bits(data: bytes) -> None:
    """A one must be among the last 15 bits (the last 8 of a single byte)."""
    if not data:
        raise Malformed("invalid args")
    if not int.from_bytes(data[-2:], "big") & (0x7FFF if len(data) > 1 else 0xFF):
        raise Malformed("missing trailing '1' bit in last 15 bits")


def exit_probe(data: bytes, bools: int = 0) -> None:
    s = Symbols(data)
    for _ in range(min(bools, 1_000_000)):
        s.bool()
    s.exit()


def tile_check(data: bytes, check: str, bools: int = 0) -> str | None:
    """The reason why the check ("exit" or "trailing") fails, or None."""
    try:
        trailing_bits(data) if check == "trailing" else exit_probe(data, bools)
    except Malformed as e:
        return str(e)
    return None
