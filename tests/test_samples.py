"""Broken images: nothing raises, whatever is cut off or flipped."""

import random

import pytest

from bytestrata.operators import extract, listing
from bytestrata.operators import identify as ident
from bytestrata.samples import images, packs, stores, volumes
from bytestrata.sources import catalog

SAMPLES = {k: f for k, f in {**images.SAMPLES, **stores.SAMPLES, **packs.SAMPLES, **volumes.SAMPLES}.items() if k != "fat16.bin"}


@pytest.fixture(scope="module")
def matcher():
    return ident.matcher_of(tuple((catalog.HERE / n).read_text() for n in ("curated.toml", "vendor.toml")))


@pytest.mark.parametrize("name", sorted(SAMPLES))
def test_broken_images(matcher, name):
    data, rng = SAMPLES[name](), random.Random(name)
    for k in range(6):
        bad = bytearray(data[: rng.randrange(len(data) + 1)] if k % 3 == 0 else data)
        for _ in range(rng.choice((1, 4, 30)) if bad else 0):
            at = rng.randrange(min(len(bad), rng.choice((64, 512, 1 << 20))))
            bad[at] = rng.choice((0, 0xFF, bad[at] ^ 1 << rng.randrange(8), rng.randrange(256)))
        bad = bytes(bad)
        found = ident.findings(bad, matcher)
        for f, files, status in extract.unpacked(bad, found):
            assert status and all(kind in ("file", "symlink") and not path.startswith("/") for path, kind, _ in files)
            if f.type in listing.KNOWN:
                listing.members(bad, f.type, f.offset)
    for type_ in extract.KNOWN:  # by the wrong extractor too
        if name.startswith(("blob", "archive", "tree")):
            extract.unpack(data[:4096], type_)
