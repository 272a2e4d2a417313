import struct

import pytest

from bytestrata.functions import lzo
from bytestrata.operators import extract

END = b"\x11\0\0"


def test_lzo():
    assert lzo.decompress(b"\x14abc" + END, 99) == b"abc"
    assert lzo.decompress(bytes([17 + 8]) + b"abcdefgh" + bytes([0b01111100, 0]) + END, 99) == b"abcdefghabcd"
    assert lzo.decompress(bytes([0, 5]) + b"q" * 23 + END, 99) == b"q" * 23
    # a length of 2 + 31 + 29 at a distance of 4, then one literal
    assert lzo.decompress(bytes([17 + 4]) + b"wxyz" + bytes([0b00100000, 29]) + struct.pack("<H", 3 << 2 | 1) + b"!" + END, 99) == (b"wxyz" * 17)[:66] + b"!"
    for bad in (b"", b"\x14ab", bytes([17 + 4]) + b"wxyz" + bytes([0b01111100, 9]) + END):
        with pytest.raises(lzo.Corrupt):
            lzo.decompress(bad, 99)
    with pytest.raises(lzo.Corrupt):
        lzo.decompress(bytes([17 + 8]) + b"abcdefgh" + END, 5)


def test_lz4():
    assert extract.lz4_block(bytes([0xF0, 255, 5]) + b"q" * 275) == b"q" * 275
    assert extract.lz4_block(bytes([0x1F]) + b"a" + bytes([1, 0, 255, 1])) == b"a" * (1 + 4 + 15 + 255 + 1)
    block = bytes([0x33]) + b"abc" + bytes([3, 0]) + bytes([0x10]) + b"z"
    frame = b"\x04\x22\x4d\x18\x60\x40\x82" + struct.pack("<I", len(block)) + block + struct.pack("<I", 0x80000003) + b"raw" + bytes(4)
    assert extract.unpack(frame, "lz4") == ([("data", "file", b"abcabcabcaz" + b"raw")], "ok")
