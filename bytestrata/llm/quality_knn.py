"""Quality classifier: similarity-weighted votes of labelled neighbours in a latent-semantic space.

Terms are the text's byte trigrams, hashed into ``TERMS`` buckets, and two of its form: the percentages of words that
repeat the word before them and of words in capitals, the first of either not counted. Their weights are log(1 + count) times an inverse document frequency. A
truncated singular value decomposition of the labelled texts gives ``DIMS`` latent directions. Each text, whole, is
projected and compared with every labelled vector by exact cosine products, a block of texts at a time; the ``NEIGHBOURS``
nearest vote with the weight cosine ** ``SHARPNESS``.

The classifier is fitted on at most ``SAMPLE`` labelled texts a class, those whose ids have the smallest hashes, and never
on held-out ones (crc32 of the id as text divisible by 5). That documented bound is also the bound of what is gathered on
the driver, 16 KB of counts for each such text and 67 MB in all, and of what is broadcast: labelled vectors and directions,
some 2 MB whatever the corpus. Only a text's characters enter its score. Scoring has no shuffle.

Defined results: neighbours as near as the last one vote too; of an id that stands in several labelled rows the text with
the smallest hash is learnt from; an empty table gives no rows; a null text is empty; a text without terms has no neighbours and scores 0; null ids are not held out and
have no label; an id with several labels is of class 1 only if all say so; without labelled texts every score is 0;
rows that repeat score alike; further columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMS = 4096
DIMS = 64
#: The most labelled texts of each class that the classifier is fitted on.
SAMPLE = 2048
NEIGHBOURS = 32
SHARPNESS = 4
SEED = 11
#: How much the two terms of a text's form weigh against one trigram.
FORM = 10
#: Texts that are scored at once.
BLOCK = 256
CUT = 0.3
#: Bytes of a text that are counted at once; it bounds memory, not what is read.
STEP = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def counts(text: str) -> np.ndarray:
    """How often each term stands in the whole text, and the percentages of its form."""
    found = np.zeros(TERMS + 2, np.float32)
    raw = np.frombuffer(text.encode(), np.uint8)
    for at in range(0, max(len(raw) - 2, 0), STEP):
        b = raw[at : at + STEP + 2].astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found[:TERMS] += np.bincount(h >> np.uint32(20), minlength=TERMS)
    words = text.split()
    if words:
        found[TERMS] = 100 * max(0, sum(map(eq, words, words[1:])) - 1) / len(words)
        found[TERMS + 1] = 100 * max(0, sum(map(str.isupper, words)) - 1) / len(words)
    return found


@dataclass
class Model:
    basis: np.ndarray  # terms x dims, with the inverse document frequencies
    vectors: np.ndarray  # dims x labelled texts
    labels: np.ndarray

    def embed(self, found: np.ndarray) -> np.ndarray:
        """Unit vectors of texts from their terms' counts; zeros for a text without terms."""
        v = np.log1p(found) @ self.basis
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(norm > 0, norm, 1)

    def score(self, found: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.zeros(len(found))
        cosine = self.embed(found) @ self.vectors
        k = min(NEIGHBOURS, cosine.shape[1])
        last = np.partition(cosine, -k, axis=1)[:, -k, None]  # neighbours that tie with the last one vote too
        weight = np.where(cosine >= last, np.maximum(cosine, 0), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(1)
        return np.where(total > 0, weight @ self.labels / np.where(total > 0, total, 1), 0.0)


def fit(found: np.ndarray, labels: np.ndarray) -> Model:
    """The latent directions of the labelled texts, by randomised subspace iteration."""
    if not len(labels):
        return Model(np.zeros((TERMS + 2, 1), np.float32), np.zeros((1, 0), np.float32), labels.astype(np.float64))
    idf = np.log((1 + len(found)) / (1 + (found > 0).sum(0))).astype(np.float32) + 1
    idf[TERMS:] *= FORM
    x = np.log1p(found) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    dims = min(DIMS, *x.shape)
    q = np.random.default_rng(SEED).standard_normal((x.shape[1], min(dims + 16, x.shape[1]))).astype(np.float32)
    for _ in range(5):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    turn = np.linalg.svd(x @ q, full_matrices=False)[2]
    model = Model((idf[:, None] * (q @ turn[:dims].T)).astype(np.float32), np.zeros((dims, 0), np.float32), labels.astype(np.float64))
    model.vectors = np.ascontiguousarray(model.embed(found).T)
    return model


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counts(x.as_py() or "").tobytes() for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.binary())], ["doc_id", "quality", "terms"])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of at most SAMPLE labelled texts a class that aren't held out. docs: doc_id, text."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("quality"))
    one = one.where(~held_out(F.col("id")))
    some = [one.where(F.col("quality") == k).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for k in (0, 1)]
    picked = some[0].unionByName(some[1])
    hits = docs.join(F.broadcast(picked), docs["doc_id"] == picked["id"]).select("doc_id", "quality", "text")
    one_text = hits.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "quality", "t.text")
    rows = one_text.mapInArrow(_term_rows, "doc_id long, quality int, terms binary").toPandas()  # a row an id, so at most SAMPLE a class
    rows = rows.sort_values("doc_id", kind="stable")
    found = np.frombuffer(b"".join(rows["terms"]), np.float32).reshape(-1, TERMS + 2)
    return fit(found, rows["quality"].to_numpy())


def _scored(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    fitted: Model = model.value
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            some = batch.slice(at, BLOCK)
            found = np.stack([counts(x.as_py() or "") for x in some.column("text")])
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(np.clip(np.round(fitted.score(found), 6), 0, 1), pa.float64())], ["doc_id", "score"])


def annotate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(learn(slim, labels))
    scored = slim.mapInArrow(partial(_scored, model=model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
