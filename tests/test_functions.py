import pytest
from hypothesis import given
from hypothesis import strategies as st

from bytestrata.functions import checksums, expr, layout
from bytestrata.operators.summaries import entropy, max_fraction
from bytestrata.sources import catalog


@pytest.mark.parametrize(
    ("rule", "value"),
    [("1+2*3", 7), ("(1+2)*3", 9), ("1/0", 0), ("5%0", 0), ("1<<99", 0), ("1>>64", 0), ("~0", 2**64 - 1), ("-1", 2**64 - 1), ("7 in 3..9", 1), ("2 in 3..9", 0), ("2 | 1 == 3", 1), ("6 & 3 == 2", 1), ("0x10 >> 2", 4), ("!0 && 2", 1), ("0 || 0", 0), ("1 << 4 + 1", 32), ("10 - 3 - 2", 5), ("0 - 1 > 5", 1)],
)
def test_rules(rule, value):
    assert expr.evaluate(rule) == value


def test_names_and_errors():
    rule, names = expr.compile_rule("size > 0 && size <= _avail")
    assert names == {"size", "_avail"} and rule({"size": 4, "_avail": 4}) == 1
    for bad in ("", "1 +", "1 2", "(1", "a in 1", "$", "in"):
        with pytest.raises(ValueError):
            expr.compile_rule(bad)


@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_arithmetic_wraps(a, b):
    f = {"a": a, "b": b}
    for op, want in (("+", a + b), ("-", a - b), ("*", a * b), ("&", a & b), ("|", a | b), ("^", a ^ b)):
        assert expr.evaluate(f"a {op} b", f) == want % 2**64


def test_layout():
    made = layout.parse("u32 a; u16 b; bytes[4] c; u8 d; i8 s;")
    data = bytes([1, 0, 0, 0, 0, 2, 9, 9, 9, 9, 3, 255])
    assert made.span == 12 and made.read(data, 0, "little") == {"a": 1, "b": 512, "d": 3, "s": 2**64 - 1}
    assert made.read(data, 0, "big")["b"] == 2 and made.read(data, 1, "big") is None and made.read(data, -1, "big") is None
    with pytest.raises(ValueError):
        layout.parse("u24 a")


def test_checksums():
    data = b"123456789"
    assert (checksums.crc32(data), checksums.crc32_jffs2(data), checksums.crc32_ubi(data), checksums.crc16_ccitt(data)) == (0xCBF43926, 0x2DFD2D88, 0x340BC6D9, 0x29B1)


def test_entropy():
    assert [entropy(x) for x in (bytes(256), bytes(range(256)), b"ab" * 9, b"")] == [0, 8, 1, 0]
    assert max_fraction(b"") == 1 and max_fraction(b"aab") == 2 / 3


def test_catalog():
    first, errors = catalog.load_text((catalog.HERE / "curated.toml").read_text())
    assert (len(first), errors, sum(len(s.magics) for s in first)) == (84, [], 134)
    assert len(catalog.default()) == 209
    found, errors = catalog.load_text('[[signature]]\nname = "a"\nmagic = [{ hex = "0" }]\n[[signature]]\nname = "b"\nmagic = [{ ascii = "B" }]\nconstraints = ["x > 1"]\n[[signature]]\nname = "c"\nmagic = [{ ascii = "C" }]')
    assert [s.name for s in found] == ["c"] and len(errors) == 2 and found[0].tier == 25
