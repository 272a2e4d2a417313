"""Signatures: what is looked for, loaded from TOML.

A document holds one signature or several under ``[[signature]]``. A signature that can't be read is left out with a
message and never stops the others.
"""

from __future__ import annotations

import os
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from ..functions import expr, layout

TIERS = {"reject": 0, "magic": 25, "structural": 60, "consistent": 85, "verified": 99}
HERE = Path(__file__).parent / "signatures"


@dataclass
class Signature:
    name: str
    category: str
    magics: list[tuple[bytes, str]]
    magic_offset: int = 0
    short: bool = False
    layout: layout.Layout | None = None
    constraints: list[expr.Rule] = field(default_factory=list)
    soft: list[expr.Rule] = field(default_factory=list)
    soft_evidence: str = ""
    size: expr.Rule | None = None
    size_clamp: bool = False
    coalesce: bool = False
    tier: int = 25
    validator: str = ""
    description: str = ""
    vendor: str = ""
    references: list[tuple[str, str]] = field(default_factory=list)  # title, address
    limitations: list[str] = field(default_factory=list)
    priority: int = 0


def _rules(sources: Iterable[str], known: set[str]) -> list[expr.Rule]:
    out = []
    for source in sources:
        rule, names = expr.compile_rule(source)
        if names - known:
            raise ValueError(f"unknown {sorted(names - known)} in {source!r}")
        out.append(rule)
    return out


def signature(doc: dict, priority: int = 0) -> Signature:
    magics = []
    for m in doc.get("magic", ()):
        raw = bytes.fromhex(m["hex"]) if "hex" in m else m["ascii"].encode("latin-1")
        magics.append((raw, "big" if m.get("endian") in ("big", "be") else "little"))
    if not magics or not all(raw for raw, _ in magics):
        raise ValueError("no magic")
    header = layout.parse(doc["struct"]) if doc.get("struct") else None
    known = {"_avail", "_offset"} | {f.name for f in (header.fields if header else ())}
    constraints = _rules(doc.get("constraints", ()), known)
    tier = doc.get("confidence", "structural" if constraints or header else "magic")
    if tier not in TIERS:
        raise ValueError(f"no tier: {tier}")
    size = _rules([doc["size"]], known)[0] if doc.get("size") else None
    about = doc.get("doc", {})
    return Signature(
        doc["name"], doc.get("category", "generic"), magics, int(doc.get("magic_offset", 0)), bool(doc.get("short")), header, constraints, _rules(doc.get("soft_constraints", ()), known),
        doc.get("soft_evidence", ""), size, bool(doc.get("size_clamp")), bool(doc.get("coalesce")), TIERS[tier], doc.get("validator", ""), about.get("description", ""), about.get("vendor", ""), [(r.get("title", ""), r.get("url", "")) for r in about.get("reference", ())], list(about.get("limitations", ())), priority,
    )


def load_text(text: str, name: str = "text", priority: int = 0) -> tuple[list[Signature], list[str]]:
    """SRC-4 to SRC-6: the signatures of a document and the messages about those left out."""
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        return [], [f"{name}: {e}"]
    found, errors = [], []
    for one in doc.get("signature") or [doc]:
        try:
            found.append(signature(one, priority))
        except (KeyError, TypeError, ValueError) as e:
            errors.append(f"{name}: {one.get('name', '?')}: {e}")
    return found, errors


def load_dir(folder: str | Path, priority: int = 0) -> tuple[list[Signature], list[str]]:
    """SRC-3: all TOML files of a folder in the order of their names."""
    found, errors = [], []
    for path in sorted(Path(folder).glob("*.toml")):
        got, bad = load_text(path.read_text(), path.name, priority)
        found, errors = found + got, errors + bad
    return found, errors


def without_redundant(signatures: list[Signature]) -> list[Signature]:
    """SRC-7: drop later sets' bare magics when validated signatures of the first claim each of their patterns."""
    claimed = {(s.magic_offset, raw) for s in signatures if s.priority == 0 and s.validator for raw, _ in s.magics}
    return [s for s in signatures if s.priority == 0 or s.validator or s.constraints or not all((s.magic_offset, raw) in claimed for raw, _ in s.magics)]


def default(folder: str | Path | None = None) -> list[Signature]:
    """SRC-8: the packaged sets, or those of a folder instead of the first."""
    first = load_dir(folder)[0] if folder else load_text((HERE / "curated.toml").read_text())[0]
    second = load_text((HERE / "vendor.toml").read_text(), priority=1)[0]
    return without_redundant(first + second)


def find_root(named: str | None = None, name: str = "bytestrata/signatures") -> Path | None:
    """SRC-9: the first folder of signatures: one that is named, the environment's, the user's, the system's; none if there is none."""
    user = Path(os.environ.get("XDG_DATA_HOME") or Path.home() / ".local/share")
    places = [named, os.environ.get("BYTESTRATA_SIGNATURES"), user / name, Path("/usr/local/share") / name, Path("/usr/share") / name]
    return next((Path(p) for p in places if p and Path(p).is_dir()), None)
