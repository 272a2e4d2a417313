import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from bytestrata.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as f:
        return bpe.Codec(f.read(), public_tokenizers.PATTERN)


_CODEC = bpe.Codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN)  # noqa: SIM115


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1! \n\t'  é🙂s")), max_size=200), st.integers(1, 40))
def test_cut_texts_have_the_same_ids(text, long):
    assert _CODEC.encode(text, long) == _CODEC.encoding.encode_ordinary(text)
    assert _CODEC.decode(_CODEC.encode(text, long)) == text.encode()


def test_endless_runs(codec):
    for text in ("a" * 200_000, " " * 2_000_000 + "x", "\n" * 300_000, "ab " * 100_000):
        assert codec.decode(codec.encode(text)) == text.encode()
    assert codec.encode("é" * 150_000) == codec.encoding.encode_ordinary("é" * 150_000)


def test_matches_the_library(odd_docs, no_docs):
    table = _CODEC.encoding
    got = {}
    for r in bpe.encode(odd_docs, RANKS, public_tokenizers.PATTERN).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d in odd_docs.select("doc_id", "text").collect():
        ids = table.encode_ordinary(d.text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (len(ids), digest, hashlib.sha256((d.text or "").encode()).hexdigest(), ids) in [tuple(r)[1:] for r in got[d.doc_id]]
    assert isinstance(table, tiktoken.Encoding)
    assert bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_decode_frame(odd_docs):
    encoded = bpe.encode(odd_docs.where("doc_id in (7, 11)"), RANKS, public_tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {d.doc_id: d.text.encode() for d in odd_docs.where("doc_id in (7, 11)").collect()}
