"""COD-11: LZARI: matches in a ring of 4 KiB, symbols and places under an adaptive arithmetic code."""

from __future__ import annotations

# The sizes of the ring, the longest match and the coder's range.
RING, LONGEST, SHORTEST = 4096, 60, 3
BITS = 15
Q1, Q2, Q3, Q4 = 1 << BITS, 2 << BITS, 3 << BITS, 4 << BITS
MOST = Q1 - 1
SYMBOLS = 256 - (SHORTEST - 1) + LONGEST


class Corrupt(ValueError):
    pass


class _Model:
    """Symbols by falling frequency: cumulative counts, and which symbol stands where."""

    def __init__(self) -> None:
        n = SYMBOLS
        self.symbol = [0, *range(n)]  # place -> symbol
        self.place = list(range(1, n + 1))
        self.count = [0] + [1] * n
        self.above = list(range(n, -1, -1))  # of all places behind

    def used(self, place: int) -> None:
        if self.above[0] >= MOST:
            total = 0
            for k in range(SYMBOLS, 0, -1):
                self.above[k] = total
                self.count[k] = (self.count[k] + 1) >> 1
                total += self.count[k]
            self.above[0] = total
        first = place
        while first > 1 and self.count[first - 1] == self.count[place]:
            first -= 1
        if first < place:
            a, b = self.symbol[first], self.symbol[place]
            self.symbol[first], self.symbol[place] = b, a
            self.place[a], self.place[b] = place, first
        self.count[first] += 1
        for k in range(first):
            self.above[k] += 1


def _places() -> list[int]:
    """Cumulative weights of distances: the nearer, the likelier."""
    out = [0] * (RING + 1)
    for k in range(RING, 0, -1):
        out[k - 1] = out[k] + 10000 // (k + 200)
    return out


_FAR = _places()


def _find(table: list[int], x: int, n: int) -> int:
    """The first place whose cumulative count isn't above x."""
    low, high = 1, n
    while low < high:
        middle = (low + high) // 2
        if table[middle] > x:
            low = middle + 1
        else:
            high = middle
    return low


def decompress(data: bytes, most: int) -> bytes:
    """The stream behind its four bytes of size. Raises Corrupt."""
    size = int.from_bytes(data[:4], "little")
    if len(data) < 4 or size > most:
        raise Corrupt("size")
    bits, at, limit = int.from_bytes(data[4:], "big"), 0, 8 * (len(data) - 4)
    take = lambda: (bits >> (limit - at - 1)) & 1 if at < limit else 0
    if limit > 1 << 20:  # a large number is slow to shift: read from the bytes instead
        take = lambda: (data[4 + (at >> 3)] >> (7 - (at & 7))) & 1 if at < limit else 0
    value, low, high = 0, 0, Q4
    for _ in range(BITS + 2):
        value, at = value << 1 | take(), at + 1
    model, out, ring, where = _Model(), bytearray(), bytearray(b" " * (RING - LONGEST)) + bytearray(LONGEST), RING - LONGEST

    def narrow(lower: int, upper: int, total: int) -> None:
        nonlocal low, high, value, at
        span = high - low
        high = low + span * upper // total
        low += span * lower // total
        while True:
            if low >= Q2:
                value, low, high = value - Q2, low - Q2, high - Q2
            elif low >= Q1 and high <= Q3:
                value, low, high = value - Q1, low - Q1, high - Q1
            elif high > Q2:
                return
            low, high, value = low << 1, high << 1, value << 1 | take()
            at += 1

    while len(out) < size:
        if at > limit + 64:
            raise Corrupt("truncated")
        span, total = high - low, model.above[0]
        place = _find(model.above, ((value - low + 1) * total - 1) // span, SYMBOLS)
        narrow(model.above[place], model.above[place - 1], total)
        symbol = model.symbol[place]
        model.used(place)
        if symbol < 256:
            out.append(symbol)
            ring[where] = symbol
            where = (where + 1) % RING
            continue
        span = high - low
        far = _find(_FAR, ((value - low + 1) * _FAR[0] - 1) // span, RING) - 1
        narrow(_FAR[far + 1], _FAR[far], _FAR[0])
        start = (where - far - 1) % RING
        for k in range(symbol - 255 + SHORTEST - 1):
            c = ring[(start + k) % RING]
            out.append(c)
            ring[where] = c
            where = (where + 1) % RING
    return bytes(out[:size])
