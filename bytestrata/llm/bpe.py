"""Byte-level BPE with the tiktoken library and a local rank file.

The library splits a text by the vocabulary's pattern and merges each match separately. Texts of more than ``LONG``
characters are first cut at safe boundaries: before a space or a line feed that follows a letter, a digit or printable
ASCII. No alternative of the pattern holds a white space character after another character, so every match ends there
anyway, and the ids of the parts put together are the ids of the whole. What such cuts leave over ``LONG`` (one endless
word or run of white space) is matched by the ``regex`` library and merged match by match, as the library's own matcher
backtracks without bound there.

Decoding joins the ids' raw bytes, so ids that end inside a character are no problem.

The rank file is read on the driver and sent as a broadcast of its fixed size, below a megabyte for 50,256 ranks, so
executors need no file of their own. Workers build one encoder each and keep it.

Defined results: a null text is the empty one, with no ids; further columns of the input play no part.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial
from hashlib import sha256

import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of more characters are cut at safe boundaries into parts of about this length.
LONG = 1 << 16
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}!-~])[ \n]")


class Codec:
    """Encodes and decodes by the ranks of a tiktoken file and a pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.decimal = {i: str(i) for i in table.values()}

    def parts(self, text: str, long: int = LONG) -> Iterator[str]:
        """The text in parts that no match crosses."""
        start = 0
        while len(text) - start > long:
            cut = _SAFE.search(text, start + long)
            if not cut:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def encode(self, text: str, long: int = LONG) -> list[int]:
        if len(text) <= long:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for part in self.parts(text, long):
            if len(part) <= 2 * long:
                ids += self.encoding.encode_ordinary(part)
            else:
                for match in self.pattern.finditer(part):
                    ids += self.encoding._encode_single_piece(match[0])
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


@lru_cache(maxsize=2)
def _codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def _encoded(batches: Iterator[pa.RecordBatch], ranks: Broadcast, pattern: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    codec = _codec(ranks.value, pattern)
    name = codec.decimal
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            some = batch.slice(at, 512)
            count, digest, back, kept = [], [], [], []
            for text in some.column("text"):
                ids = codec.encode(text.as_py() or "")
                count.append(len(ids))
                digest.append(sha256(",".join([name[i] for i in ids]).encode()).hexdigest())
                back.append(sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(pa.array(ids, pa.int32()))
            columns = [some.column("doc_id"), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = [0]
                for x in kept:
                    offsets.append(offsets[-1] + len(x))
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(kept) if kept else pa.array([], pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)


def encode(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, the ids.

    rank_file: a path on the driver.
    """
    with open(rank_file, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return texts.mapInArrow(partial(_encoded, ranks=ranks, pattern=pattern, with_ids=with_ids), schema)


def _decoded(batches: Iterator[pa.RecordBatch], ranks: Broadcast, pattern: str) -> Iterator[pa.RecordBatch]:
    codec = _codec(ranks.value, pattern)
    for batch in batches:
        back = [codec.decode(x.as_py() or []) for x in batch.column("ids")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(back, pa.binary())], ["doc_id", "bytes"])


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and the raw bytes of a frame's ids."""
    with open(rank_file, "rb") as f:
        ranks = encoded.sparkSession.sparkContext.broadcast(f.read())
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decoded, ranks=ranks, pattern=pattern), "doc_id long, bytes binary")
