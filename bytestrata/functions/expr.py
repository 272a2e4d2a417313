"""The rule language of signatures: unsigned 64-bit integer expressions.

From the loosest: ``||``; ``&&``; the comparisons and ``in LOW..HIGH``; ``|``; ``^``; ``&``; the shifts; ``+ -``; ``* / %``; the
prefixes ``! - ~``; numbers, names and parentheses. Results wrap at 2**64, division by zero and shifts of 64 or more give 0.
Rules are compiled once into Python closures over a dictionary of fields.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

MASK = (1 << 64) - 1
Rule = Callable[[Mapping[str, int]], int]

_LEX = re.compile(r"\s*(?:(0[xX][0-9a-fA-F]+|\d+)|([A-Za-z_]\w*)|(\.\.|\|\||&&|==|!=|<=|>=|<<|>>|[-+*/%&|^~!<>()]))")
#: Infix operators from the loosest level to the tightest.
_LEVELS = (("||",), ("&&",), ("==", "!=", "<=", ">=", "<", ">", "in"), ("|",), ("^",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))
_INFIX: dict[str, Callable[[int, int], int]] = {
    "==": lambda a, b: int(a == b), "!=": lambda a, b: int(a != b), "<=": lambda a, b: int(a <= b), ">=": lambda a, b: int(a >= b), "<": lambda a, b: int(a < b), ">": lambda a, b: int(a > b),
    "|": lambda a, b: a | b, "^": lambda a, b: a ^ b, "&": lambda a, b: a & b, "<<": lambda a, b: a << b & MASK if b < 64 else 0, ">>": lambda a, b: a >> b if b < 64 else 0,
    "+": lambda a, b: a + b & MASK, "-": lambda a, b: a - b & MASK, "*": lambda a, b: a * b & MASK, "/": lambda a, b: a // b if b else 0, "%": lambda a, b: a % b if b else 0,
}


def tokens(source: str) -> list[str]:
    found, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _LEX.match(source, at)
        if not m:
            raise ValueError(f"unexpected {source[at:].strip()[:1]!r} in {source!r}")
        found.append(m[1] or m[2] or m[3])
        at = m.end()
    return found


class _Parser:
    def __init__(self, source: str):
        self.left, self.names, self.source = tokens(source)[::-1], set(), source

    def peek(self) -> str:
        return self.left[-1] if self.left else ""

    def take(self, what: str = "") -> str:
        if not self.left or what and self.left[-1] != what:
            raise ValueError(f"expected {what or 'more'} in {self.source!r}")
        return self.left.pop()

    def level(self, k: int) -> Rule:
        if k == len(_LEVELS):
            return self.prefix()
        a = self.level(k + 1)
        while (op := self.peek()) in _LEVELS[k]:
            self.take()
            b = self.level(k + 1)
            if op == "in":
                self.take("..")
                a = self.between(a, b, self.level(k + 1))
                break
            a = self.infix(op, a, b)
        return a

    @staticmethod
    def between(a: Rule, low: Rule, high: Rule) -> Rule:
        return lambda f: int(low(f) <= a(f) <= high(f))

    @staticmethod
    def infix(op: str, a: Rule, b: Rule) -> Rule:
        if op == "||":
            return lambda f: int(bool(a(f)) or bool(b(f)))
        if op == "&&":
            return lambda f: int(bool(a(f)) and bool(b(f)))
        do = _INFIX[op]
        return lambda f: do(a(f), b(f))

    def prefix(self) -> Rule:
        op = self.take()
        if op in "!-~":
            a = self.prefix()
            return {"!": lambda f: int(not a(f)), "-": lambda f: -a(f) & MASK, "~": lambda f: ~a(f) & MASK}[op]
        if op == "(":
            a = self.level(0)
            self.take(")")
            return a
        if op[0].isdigit():
            n = int(op, 0) & MASK if op[:2].lower() == "0x" else int(op) & MASK
            return lambda f: n
        if re.match(r"[A-Za-z_]", op) and op != "in":
            self.names.add(op)
            return lambda f: f[op]
        raise ValueError(f"unexpected {op!r} in {self.source!r}")


def compile_rule(source: str) -> tuple[Rule, set[str]]:
    """The rule and the names that it reads. Raises ValueError for what isn't one expression."""
    p = _Parser(source)
    rule = p.level(0)
    if p.left:
        raise ValueError(f"unexpected {p.peek()!r} in {source!r}")
    return rule, p.names


def evaluate(source: str, fields: Mapping[str, int] | None = None) -> int:
    return compile_rule(source)[0](fields or {})
