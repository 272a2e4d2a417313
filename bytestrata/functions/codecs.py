"""Codecs of embedded formats that no library has: bit streams of literals and matches."""

from __future__ import annotations

from collections.abc import Callable


class Corrupt(ValueError):
    pass


class Bits:
    """Bits of little-endian units, from the top of a unit or from its foot; whole bytes are taken from behind the units read so far.

    A unit that the data can't fill has zeros for the rest.
    """

    def __init__(self, data: bytes, unit: int = 1, from_foot: bool = False, patience: int = 8):
        self.data, self.unit, self.at, self.left, self.word, self.from_foot, self.patience = data, unit, 0, 0, 0, from_foot, patience

    def bit(self) -> int:
        if not self.left:
            if self.at > len(self.data) + self.patience:
                raise Corrupt("truncated")
            self.word = int.from_bytes(self.data[self.at : self.at + self.unit], "little")
            self.at, self.left = self.at + self.unit, 8 * self.unit
        self.left -= 1
        return self.word >> (8 * self.unit - 1 - self.left if self.from_foot else self.left) & 1

    def number(self, n: int) -> int:
        """The next n bits, the first on top."""
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise Corrupt("truncated")
        self.at += 1
        return self.data[self.at - 1]


def _copy(out: bytearray, back: int, n: int) -> None:
    """Append n bytes from so far back; they may overlap what is appended."""
    if not 0 < back <= len(out):
        raise Corrupt("distance")
    if back >= n:
        out += out[len(out) - back : len(out) - back + n]
    else:
        run = bytes(out[-back:])
        out += (run * (n // back + 1))[:n]


def _turned(value: int, n: int) -> int:
    return int(f"{value:0{n}b}"[::-1], 2) if n else 0


def jzlzma(data: bytes, size: int) -> bytes:
    """COD-12: the matches of LZMA without its range coder: plain bits, from the foot of each byte. Raises Corrupt if size bytes don't come."""
    bits, out, recent = Bits(data, from_foot=True, patience=0), bytearray(), [0, 0, 0, 0]

    def length() -> int:
        if not bits.bit():
            return 2 + bits.number(3)
        return 10 + bits.number(3) if not bits.bit() else 18 + bits.number(8)

    def distance() -> int:
        slot = bits.number(6)
        if slot < 4:
            return slot
        n = (slot >> 1) - 1
        base = (2 | slot & 1) << n
        if slot < 14:
            return base + _turned(bits.number(n), n)
        high = bits.number(n - 4) << 4
        return base + high + _turned(bits.number(4), 4)

    while len(out) < size:
        if bits.at >= len(data) and not bits.left:
            raise Corrupt("truncated")
        if not bits.bit():
            out.append(bits.number(8))
            continue
        n = 0
        if not bits.bit():
            n = length()
            recent = [distance(), *recent[:3]]
        elif not bits.bit():
            n = 0 if bits.bit() else 1
        else:
            k = 1 if not bits.bit() else 2 + bits.bit()
            recent.insert(0, recent.pop(k))
        _copy(out, recent[0] + 1, min(n or length(), size - len(out)))
    return bytes(out)


def lzss(data: bytes, most: int) -> bytes:
    """COD-13: a bit before each literal or match; matches of 2 to 17 bytes in a ring of 1024, place 0 is the end."""
    bits, out, ring = Bits(data, patience=0), bytearray(), bytearray(b" " * 1024)
    try:
        while True:
            if bits.bit():
                piece = bytes([bits.number(8)])
            else:
                place = bits.number(10)
                if not place:
                    return bytes(out)
                piece = None
                n = bits.number(4) + 2
            for k in range(1 if piece else n):
                if len(out) >= most:
                    return bytes(out)
                c = piece[0] if piece else ring[(place - 1 + k) % 1024]
                ring[len(out) % 1024] = c
                out.append(c)
    except Corrupt:  # the stream may end without its mark
        return bytes(out)


#: The farthest that a match's code may reach before its last byte.
_FAR = (1 << 24) + 2


def nrv(method: int, data: bytes, size: int) -> bytes:
    """COD-15: methods 2 to 4, 5 to 7 and 8 to 10 are three codes of matches; each with units of 4, 1 and 2 bytes."""
    if not 2 <= method <= 10:
        raise Corrupt("method")
    code, bits, out, last = (method - 2) // 3, Bits(data, (4, 1, 2)[(method - 2) % 3], patience=64), bytearray(), 1

    def grow(n: int) -> int:
        """Double and add a bit, until a bit says that it is enough."""
        while True:
            n = 2 * n + bits.bit()
            if n > 1 << 30:
                raise Corrupt("length")
            if bits.bit():
                return n

    while len(out) < size:
        if bits.bit():
            out.append(bits.byte())
            continue
        far = 1
        while True:
            far = 2 * far + bits.bit()
            if far > _FAR:
                raise Corrupt("distance")
            if bits.bit():
                break
            if code:
                far = 2 * (far - 1) + bits.bit()
        low = None  # the length's first bit, where the distance's code gives it
        if far == 2:
            far = last
        else:
            far = (far - 3) * 256 + bits.byte()
            if far == 0xFFFFFFFF:
                break
            if code:
                low, far = ~far & 1, far >> 1
            last = far = far + 1
        if low is None:
            low = bits.bit()
        if code < 2:
            n = 2 * low + bits.bit() or grow(1) + 2
        elif low:
            n = 1 + bits.bit()
        else:
            n = 3 + bits.bit() if bits.bit() else grow(1) + 3
        n += 1 + (far > (0x500 if code else 0xD00))
        if n > size - len(out):
            raise Corrupt("overrun")
        _copy(out, far, n)
    if len(out) != size:
        raise Corrupt("short")
    return bytes(out)


def _x86(code: bytearray, kind: int, mark: int) -> None:
    """Calls and jumps whose operand begins with the mark hold a place from the start on, on end: make it a distance again."""
    plain = {0x24: (0xE8,), 0x25: (0xE9,)}.get(kind, (0xE8, 0xE9))
    at, since = 0, 0
    while at < len(code) - 5:
        op = code[at]
        jump = op in plain or (kind == 0x49 and at and since != at and code[at - 1] == 0x0F and 0x80 <= op <= 0x8F)
        if jump and code[at + 1] == mark:
            place = int.from_bytes(code[at + 1 : at + 5], "big")
            code[at + 1 : at + 5] = ((place - at - 1 - (mark << 24)) & 0xFFFFFFFF).to_bytes(4, "little")
            at = since = at + 5
        else:
            at += 1


def _words(order: str, is_call: Callable[[int], bool], width: int) -> Callable[[bytearray, int, int], None]:
    """Instructions of four bytes whose low bits hold a place in words: subtract their own."""
    low = (1 << width) - 1

    def undo(code: bytearray, kind: int, mark: int) -> None:
        for at in range(0, len(code) - 4, 4):
            word = int.from_bytes(code[at : at + 4], order)
            if is_call(word):
                code[at : at + 4] = (word & ~low | (word - at // 4) & low).to_bytes(4, order)

    return undo


_ARM = lambda w: w >> 24 & 0x0F == 0x0B
#: COD-16: filters by their number.
FILTERS: dict[int, Callable[[bytearray, int, int], None]] = {
    0x00: lambda code, kind, mark: None, **dict.fromkeys((0x24, 0x25, 0x26, 0x36, 0x46, 0x49), _x86),
    0x50: _words("little", _ARM, 24), 0x51: _words("big", _ARM, 24), 0x52: _words("little", lambda w: w >> 26 & 0x1F == 0x05, 26),
}


def unfilter(code: bytes, kind: int, mark: int) -> bytes:
    """What a filter made of a program, undone. Raises Corrupt for one that isn't known."""
    if kind not in FILTERS:
        raise Corrupt("filter")
    out = bytearray(code)
    FILTERS[kind](out, kind, mark)
    return bytes(out)


# places' slots by the size of the window, and the bytes of a frame.
LZX_SLOTS = {15: 30, 16: 32, 17: 34, 18: 36, 19: 38, 20: 42, 21: 50}
LZX_FRAME = 1 << 15


class _Code:
    """A canonical prefix code: symbols of each length get the next codes in order."""

    def __init__(self, lengths: list[int]):
        self.symbols: dict[tuple[int, int], int] = {}
        code = 0
        for n in range(1, max(lengths, default=0) + 1):
            for symbol, own in enumerate(lengths):
                if own == n:
                    self.symbols[n, code] = symbol
                    code += 1
            code <<= 1

    def read(self, bits: Bits) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | bits.bit()
            if (found := self.symbols.get((n, code))) is not None:
                return found
        raise Corrupt("code")


def _lengths(bits: Bits, before: list[int], first: int, end: int) -> None:
    """Lengths of a code's symbols, as changes from those of the block before, under a small code of their own."""
    small, k = _Code([bits.number(4) for _ in range(20)]), first
    while k < end:
        z = small.read(bits)
        n, value = 1, 0
        if z == 17:
            n = 4 + bits.number(4)
        elif z == 18:
            n = 20 + bits.number(5)
        elif z == 19:
            n = 4 + bits.number(1)
            value = (before[k] - small.read(bits)) % 17
        else:
            value = (before[k] - z) % 17
        for _ in range(min(n, end - k)):
            before[k] = value
            k += 1


def lzx(data: bytes, window: int, size: int) -> bytes:
    """COD-14: the bytes of a cabinet's folder. data: its blocks one behind the other; window: the power of two."""
    if window not in LZX_SLOTS:
        raise Corrupt("window")
    slots = LZX_SLOTS[window]
    extra = [min(max(0, (k >> 1) - 1), 17) for k in range(slots)]
    base = [0]
    for n in extra:
        base.append(base[-1] + (1 << n))
    bits, out, recent = Bits(data, 2, patience=4), bytearray(), [1, 1, 1]
    main, tail, left, kind, frame = [0] * (256 + 8 * slots), [0] * 249, 0, 0, LZX_FRAME
    translated = bits.number(32) if bits.bit() else 0
    symbols = lengths = aligned = None
    while len(out) < size:
        if not left:
            kind, left = bits.number(3), bits.number(24)
            if kind == 2:
                aligned = _Code([bits.number(3) for _ in range(8)])
            if kind in (1, 2):
                _lengths(bits, main, 0, 256)
                _lengths(bits, main, 256, len(main))
                symbols = _Code(main)
                _lengths(bits, tail, 0, 249)
                lengths = _Code(tail)
            elif kind == 3:
                if not bits.left:
                    bits.bit()
                bits.left = 0
                recent = [int.from_bytes(data[bits.at + 4 * k : bits.at + 4 * k + 4], "little") for k in range(3)]
                bits.at += 12
            else:
                raise Corrupt("block")
            odd = left & 1
        stop = min(size, len(out) + left, frame)
        begun = len(out)
        if kind == 3:
            n = stop - begun
            if bits.at + n > len(data):
                raise Corrupt("truncated")
            out += data[bits.at : bits.at + n]
            bits.at += n
        else:
            while len(out) < stop:
                symbol = symbols.read(bits)
                if symbol < 256:
                    out.append(symbol)
                    continue
                slot, n = divmod(symbol - 256, 8)
                if n == 7:
                    n += lengths.read(bits)
                if slot < 3:
                    recent[0], recent[slot] = recent[slot], recent[0]
                else:
                    own = extra[slot]
                    if kind == 2 and own >= 3:
                        low = (bits.number(own - 3) << 3) + aligned.read(bits)
                    else:
                        low = bits.number(own)
                    recent = [base[slot] + low - 2, *recent[:2]]
                _copy(out, recent[0], n + 2)
            if len(out) > stop:
                raise Corrupt("overrun")
        left -= len(out) - begun
        if not left and kind == 3:
            bits.at += odd
        if len(out) == frame:
            frame += LZX_FRAME
            if kind != 3 or left == 0:
                bits.left = 0  # frames begin with a word
    return _calls(out, translated) if translated else bytes(out)


def _calls(out: bytearray, size: int) -> bytes:
    """Calls hold places in the whole; make them distances again, frame by frame but for each one's last ten bytes."""
    for start in range(0, min(len(out), LZX_FRAME << 15), LZX_FRAME):
        end, at = min(start + LZX_FRAME, len(out)) - 10, start
        while 0 <= (at := out.find(b"\xe8", at)) < end:
            place = int.from_bytes(out[at + 1 : at + 5], "little", signed=True)
            if -at <= place < size:
                out[at + 1 : at + 5] = ((place - at if place >= 0 else place + size) & 0xFFFFFFFF).to_bytes(4, "little")
            at += 5
    return bytes(out)
