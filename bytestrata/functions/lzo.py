"""COD-10: LZO1X, by the published description of its instruction stream."""

from __future__ import annotations


class Corrupt(ValueError):
    """A stream that can't be followed, or gives more than the caller allows."""


def decompress(data: bytes, most: int) -> bytes:
    """What the stream gives up to its end mark."""
    out, at, state = bytearray(), 0, 0

    def byte() -> int:
        nonlocal at
        if at >= len(data):
            raise Corrupt("truncated")
        at += 1
        return data[at - 1]

    def extended(short: int, base: int) -> int:
        """A length whose short form is 0 goes on: 255 for each zero byte, then the first other one."""
        if short:
            return short
        n = base
        while not (b := byte()):
            n += 255
            if n > most:
                raise Corrupt("too large")
        return n + b

    def literals(n: int) -> None:
        nonlocal at
        if at + n > len(data) or len(out) + n > most:
            raise Corrupt("truncated")
        out.extend(data[at : at + n])
        at += n

    def match(distance: int, n: int) -> None:
        if distance > len(out) or len(out) + n > most:
            raise Corrupt("distance")
        start = len(out) - distance
        if distance >= n:
            out.extend(out[start : start + n])
        else:
            for k in range(n):
                out.append(out[start + k])

    if data and data[0] > 17:
        n = byte() - 17
        literals(n)
        state = 4 if n >= 4 else n
    while True:
        t = byte()
        if t < 16 and not state:
            literals(3 + extended(t, 15))
            state = 4
            continue
        if t < 16:
            distance, n, state_ = (byte() << 2) + (t >> 2), (3 if state == 4 else 2), t & 3
            match(distance + (2049 if state == 4 else 1), n)
        elif t < 64:
            n = 2 + (extended(t & 7, 7) if t < 32 else extended(t & 31, 31))
            word = byte() | byte() << 8
            distance, state_ = word >> 2, word & 3
            if t < 32:
                distance += 16384 + ((t & 8) << 11)
                if distance == 16384:
                    return bytes(out)
            else:
                distance += 1
            match(distance, n)
        else:
            state_ = t & 3
            match((byte() << 3) + (t >> 2 & 7) + 1, 3 + (t >> 5 & 1) if t < 128 else 5 + (t >> 5 & 3))
        literals(state_)
        state = state_
