"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Documents are sets of five-word shingles; words are what ``[\\x20\\x09-\\x0D]`` separates, as they stand. Two documents are
linked when the Jaccard similarity of their sets is 0.8 or more.

1. *Copies*: documents with the same words are one node, named by their smallest doc_id; the rest works on nodes.
2. *Forest*: a node has a label in each of ``TREES`` trees: ``DEPTH`` MinHash values of a byte each, the first in the top
   byte, so sorted labels are a prefix trie and the nodes below a trie node share the label's first bytes. ``forest``
   keeps, sorted, all labels below the shortest prefix that may be needed and that two nodes share.
3. *Descent*: matching begins with whole labels. Each prefix ties its nodes to the smallest of them, one edge a node, not
   one a pair; connected components of the edges are clusters outside of which no candidate pair exists. Clusters that a
   level formed or enlarged are verified. A found pair of similarity s has met at this level with the probability
   1 - (1 - s ** depth) ** trees; its inverse says for how many pairs it stands, and so the share of a document's links
   that is found is measured over all documents with links. While the mean is below ``RECALL`` the prefixes are shortened
   by a byte. ``prefix_length`` is the last level: there even pairs right at the similarity asked for reach the recall.
4. *Verification*: the shingle sets of a cluster are compared exactly by counting shared shingles in matrix products and,
   for rare shingles, pair by pair. A cluster of more than ``TILE_DOCS`` documents or ``TILE_WORDS`` words is cut into
   blocks, a smaller one into up to ``SPREAD``; nodes that share a whole label stand in the same block as far as it holds
   them. Two blocks are compared, as a task of their own, if some prefix stands in both, so a long chain of clusters costs
   what it has candidates, not its square. A tile returns how many links each node has in it and the tile's components,
   never the pairs.
5. *Classes*: components of the verified links.

Shingles are told apart by 64-bit hashes; nodes by doc_id, or, where doc_ids repeat or are null, by the SHA-256 of their
words. Defined results: a null text is empty; documents of one to four words have one shingle, of all their words;
documents without words have no links, and copies of them share a class like any copies; rows without doc_id are compared
like any, and a class that has no doc_id is null; rows that share a doc_id and words are copies, those with different
words are different documents; an empty table gives no rows; further columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, SPACE_CHARS, cut_lineage, meet, text_or_empty, words_of
from .components import connected

WORDS = 5
SIMILARITY = Fraction(4, 5)
TREES = 32
#: Values of a label, a byte each.
DEPTH = 8
#: The share of links that must be found, as measured at a level, or as computed for the weakest pairs at the last.
RECALL = 0.999
TILE_DOCS = 2048
TILE_WORDS = 1_500_000
#: Blocks that a cluster of less than a tile is cut into at most, for tasks of like size.
SPREAD = 8
SEED = 5

_MIX = [np.uint64(x) for x in np.random.default_rng(SEED).integers(1, 2**63, WORDS, np.int64) * 2 + 1]


def prefix_length(similarity: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix under which a pair of this similarity meets in some tree with the probability asked for."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles and where each text's begin; a text of 1 to 4 words has one, without words none."""
    n = np.diff(offsets)
    w = words.view(np.uint64)
    counts = np.where(n >= WORDS, n - (WORDS - 1), np.minimum(n, 1))
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(starts[-1], np.uint64)
    if len(w) >= WORDS:
        size = len(w) - WORDS + 1
        h = np.zeros(size, np.uint64)
        for k in range(WORDS):
            h += w[k : k + size] * _MIX[k]
        h = _finish(h)
        full = n >= WORDS
        # the places in w where a full shingle of one text starts
        ahead = np.repeat(offsets[:-1][full] - np.concatenate([[0], np.cumsum(counts[full])])[:-1], counts[full])
        out[np.repeat(full, counts)] = h[np.arange(counts[full].sum()) + ahead]
    for k in np.flatnonzero((n > 0) & (n < WORDS)):
        short = np.array([n[k]], np.uint64)
        for x in w[offsets[k] : offsets[k + 1]]:
            short = _finish(short * _MIX[0] + x)
        out[starts[k]] = short[0]
    return out, starts


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _labels(batches: Iterator[pa.RecordBatch], trees: int, depth: int) -> Iterator[pa.RecordBatch]:
    """Each tree's label: the low bytes of its MinHash values, the first on top."""
    odd = (np.random.default_rng(SEED + 1).integers(0, 2**31, (trees, depth), np.int64) * 2 + 1).astype(np.uint32)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            some = batch.slice(at, 512)
            hashes, starts = shingles(*_lists(some.column("words")))
            some_has = np.diff(starts) > 0
            labels = np.zeros((some.num_rows, trees), np.int64)
            if len(hashes):
                low, begin = (hashes >> np.uint64(32)).astype(np.uint32), starts[:-1][some_has]
                for tree in range(trees):
                    label = np.zeros(len(begin), np.uint64)
                    for a in odd[tree]:
                        least = np.minimum.reduceat(low * a, begin) * np.uint32(0x9E3779B1)
                        label = label << np.uint64(8) | (least >> np.uint32(24))
                    labels[some_has, tree] = label.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some_has * trees)]), pa.int32()), pa.array(labels[some_has].ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("th"), some.column("digest"), pa.array(np.diff(_lists(some.column("words"))[1]), pa.int64()), lists], ["doc_id", "th", "digest", "n_words", "labels"])


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share."""
    n = len(sets)
    all_, first = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(all_, kind="stable")
    all_, first = all_[order], first[order]
    edges = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1], [True]]))
    count = np.diff(edges)
    found = np.zeros((n, n), np.float32)
    rare = max(3, n // 64)
    for m in np.unique(count[(count > 1) & (count <= rare)]):
        who = first[edges[:-1][count == m][:, None] + np.arange(m)]  # one row a shingle, the documents ascending
        for lo in range(0, len(who), 1 << 16):
            part = who[lo : lo + (1 << 16)]
            for a in range(m - 1):
                pair = (part[:, a : a + 1] * n + part[:, a + 1 :]).ravel()
                where, times = np.unique(pair, return_counts=True)
                found.ravel()[where] += times
    found += found.T
    often = np.flatnonzero(count > rare)
    for lo in range(0, len(often), 4096):
        cols = often[lo : lo + 4096]
        dense = np.zeros((n, len(cols)), np.float32)
        dense[np.concatenate([first[edges[c] : edges[c + 1]] for c in cols]), np.repeat(np.arange(len(cols)), count[cols])] = 1
        found += dense @ dense.T
    return found


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place of each place's component."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _verify(table: pa.Table, similarity: Fraction, trees: int, levels: range) -> pa.Table:
    """cluster, node, links, root and found of the nodes of a tile that have links in it.

    found: for each level, for how many links the links stand, by the probability that a pair meets there.
    """
    table = table.combine_chunks()
    names = table.column("node").combine_chunks()
    first = np.unique(names.dictionary_encode().indices.to_numpy(), return_index=True)[1]
    first = first[np.argsort(np.array(names.take(pa.array(first)).to_pylist(), object), kind="stable")]  # nodes ascending
    names, block = names.take(pa.array(first)), table.column("block").to_numpy()[first]
    hashes, starts = shingles(*_lists(table.column("words").combine_chunks().take(pa.array(first))))
    sets = [np.unique(hashes[a:b]) for a, b in zip(starts, starts[1:])]
    size = np.array([len(s) for s in sets], np.float64)
    found = _shared(sets).astype(np.float64)
    num, den = similarity.numerator, similarity.denominator
    linked = (found * (num + den) >= num * (size[:, None] + size[None, :])) & (found > 0)
    np.fill_diagonal(linked, False)
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    if i != j:  # pairs inside a block belong to that block's own tile
        linked &= block[:, None] != block[None, :]
    a, b = np.nonzero(linked)
    links, root = linked.sum(1), _roots(len(sets), a, b)
    near = found[a, b] / (size[a] + size[b] - found[a, b])
    stands = np.stack([np.bincount(a, 1 / -np.expm1(trees * np.log1p(-np.minimum(near, 1 - 1e-9) ** d)), len(sets)) for d in levels], 1)
    has = np.flatnonzero(links)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * len(levels), pa.int32()), pa.array(stands[has].ravel(), pa.float64()))
    cluster = pa.concat_arrays([table.column("cluster").combine_chunks().slice(0, 1)] * max(len(has), 1)).slice(0, len(has))
    return pa.table({"cluster": cluster, "node": names.take(pa.array(has)), "links": pa.array(links[has], pa.int64()), "root": names.take(pa.array(root[has])), "found": lists})


def _prefix(d: int, depth: int) -> Column:
    return F.shiftrightunsigned("label", 8 * (depth - d)).alias("prefix")


def forest(named: DataFrame, shortest: int, depth: int) -> DataFrame:
    """node, tree and label below each prefix of the shortest length that nodes share, sorted by tree and label."""
    below = named.select("node", F.posexplode("labels").alias("tree", "label")).withColumn("prefix", _prefix(shortest, depth))
    shared = cut_lineage(below.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return cut_lineage(meet(below, shared, ["tree", "prefix"], "left_semi").select("node", "tree", "label").sortWithinPartitions("tree", "label", "node"))


def _clusters(trie: DataFrame, d: int, depth: int) -> DataFrame:
    """node and cluster of each node that shares a prefix of d bytes with another."""
    at = trie.select("node", "tree", _prefix(d, depth))
    heads = cut_lineage(at.groupBy("tree", "prefix").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    tied = connected(meet(at, heads, ["tree", "prefix"]).where("node > head").select(F.col("node").alias("u"), F.col("head").alias("v")))
    roots = tied.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct()
    return tied.select("node", F.col("root").alias("cluster")).unionByName(roots)


def _tiles(trie: DataFrame, members: DataFrame, d: int, depth: int, tile_docs: int) -> DataFrame:
    """cluster, node, block, i, j: the nodes of each tile. members: node, cluster, n_words."""
    n = F.count(F.lit(1))
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(n / tile_docs), F.least(F.ceil(8 * n / tile_docs), F.lit(SPREAD)), F.ceil(F.sum("n_words") / TILE_WORDS)).cast("int").alias("blocks"))
    sized = members.join(sizes, "cluster").select("cluster", "node", "blocks")
    if not sizes.where("blocks > 1").limit(1).count():
        return sized.select("cluster", "node", F.lit(0).alias("block"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    single = sized.where("blocks = 1").select("cluster", "node", F.lit(0).alias("block"), F.lit(0).alias("i"), F.lit(0).alias("j"))

    several = trie.join(sized.where("blocks > 1"), "node")
    heads = several.groupBy("tree", "label").agg(F.min("node").alias("head"))
    kin = several.join(heads, ["tree", "label"]).groupBy("cluster", "node", "blocks").agg(F.min("head").alias("head"))
    crowd = kin.groupBy("head").agg(n.alias("n"))
    home = F.when(F.col("n") * 4 <= tile_docs, F.col("head")).otherwise(F.col("node"))  # a crowd larger than a part of a tile is spread
    placed = cut_lineage(kin.join(crowd, "head").select("cluster", "node", F.pmod(F.xxhash64(home), "blocks").cast("int").alias("block")))
    meets = trie.select("node", "tree", _prefix(d, depth)).join(placed, "node").select("cluster", "tree", "prefix", "block").distinct()
    other = meets.select("cluster", "tree", "prefix", F.col("block").alias("j"))
    pairs = meets.join(other, ["cluster", "tree", "prefix"]).where("block < j").select("cluster", F.col("block").alias("i"), "j").distinct()
    of = pairs.select("cluster", "i", "j", F.explode(F.array("i", "j")).alias("block"))
    own = placed.select("cluster", "node", "block", F.col("block").alias("i"), F.col("block").alias("j"))
    return single.unionByName(own).unionByName(placed.join(of, ["cluster", "block"]).select("cluster", "node", "block", "i", "j"))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: Fraction = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, tile_docs: int = TILE_DOCS) -> DataFrame:
    """Per row of docs: doc_id, class_id, n_links and n_copies.

    class_id: the smallest doc_id that links lead to. n_links: how many other documents with different words are similar
    enough. n_copies: how many rows have the same words.
    """
    return _annotate(docs, id_col, text_col, similarity, trees, depth, recall, tile_docs).select("doc_id", "class_id", "n_links", "n_copies")


def _annotate(docs: DataFrame, id_col: str, text_col: str, similarity: Fraction, trees: int, depth: int, recall: float, tile_docs: int) -> DataFrame:
    """The columns of annotate, th (the hash of id and text) and whether the row stands for its class."""
    shortest = prefix_length(float(similarity), trees, depth, recall)
    levels = range(shortest, depth + 1)
    texts = keyed(docs, id_col, text_col)
    plain = F.regexp_replace(F.btrim("text", F.lit(SPACE_CHARS)), SPACE + "+", " ")
    digest, words = F.unhex(F.sha2(plain, 256)), F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))
    hashed = texts.select("doc_id", "th", digest.alias("digest"), words.alias("words"))
    labelled = cut_lineage(hashed.mapInArrow(partial(_labels, trees=trees, depth=depth), "doc_id long, th long, digest binary, n_words long, labels array<long>"))

    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th"))
    copies = cut_lineage(labelled.groupBy("digest").agg(least.alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("labels").alias("labels"), F.first("n_words").alias("n_words")))
    by_id = not copies.groupBy("rep.doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    nodes = copies.withColumn("node", F.col("rep.doc_id") if by_id else F.col("digest"))
    kind = "long" if by_id else "binary"

    trie = forest(nodes.select("node", "labels"), shortest, depth)
    near = trie.select("node").distinct().join(nodes.select("node", "n_words", "rep.doc_id", "rep.th"), "node")
    near = cut_lineage(near)
    # texts travel as they are; only those of the forest are hashed again, one for each node
    met = near.select("node", F.col("doc_id").alias("rep_id"), "th").join(texts, "th").where(F.col("rep_id").eqNullSafe(F.col("doc_id"))).dropDuplicates(["th", "rep_id"])
    bags = cut_lineage(met.select("node", words.alias("words")))

    verified = members = None
    for d in reversed(levels):
        before, members = members, cut_lineage(_clusters(trie, d, depth).join(near.select("node", "n_words"), "node"))
        fresh = members
        if before is not None:  # a cluster of the same root and number has the same nodes, as prefixes nest
            sizes = [x.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")) for x in (members, before)]
            same = cut_lineage(sizes[0].join(sizes[1], ["cluster", "n"], "left_semi").select("cluster"))
            fresh, verified = cut_lineage(members.join(same, "cluster", "left_anti")), verified.join(same, "cluster", "left_semi")
        tiles = _tiles(trie, fresh, d, depth, tile_docs)
        made = tiles.join(bags, "node").groupBy("cluster", "i", "j").applyInArrow(lambda tile: _verify(tile, similarity, trees, levels), f"cluster {kind}, node {kind}, links long, root {kind}, found array<double>")
        verified = cut_lineage(made if verified is None else verified.unionByName(made))
        share = verified.groupBy("node").agg((F.sum("links") / F.sum(F.get("found", F.lit(d - shortest)))).alias("share"))
        measured = share.agg(F.avg("share")).first()[0]
        if measured is not None and measured >= recall:
            break
    links = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = connected(verified.where("node > root").select(F.col("node").alias("u"), F.col("root").alias("v")))

    known = nodes.select("digest", "node", "rep", "n_copies").join(links, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if not by_id:  # a class is named by its smallest doc_id, not by its smallest node
        known = cut_lineage(known)
        names = known.groupBy("root").agg(F.min("rep").alias("head"))
        known = known.join(names, "root").withColumn("root", F.col("head.doc_id")).withColumn("stands", F.col("rep") == F.col("head"))
    else:
        known = known.withColumn("stands", F.col("node") == F.col("root"))
    found = cut_lineage(known.select("digest", F.col("root").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", F.col("n_copies").alias("n"), F.when(F.col("stands"), F.col("rep")).alias("rep")))
    this = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")
    return meet(labelled.select("doc_id", "th", "digest"), found, ["digest"]).withColumn("stays", F.coalesce(this.eqNullSafe(F.col("rep")), F.lit(False)))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and th, the hash of both."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return texts.withColumn("th", F.xxhash64("doc_id", "text"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each class, with docs' own columns: that of the smallest doc_id, rows without one last.

    Of rows that repeat the doc_id and the text one stays, whichever.
    """
    found = _annotate(docs, id_col, text_col, SIMILARITY, TREES, DEPTH, RECALL, TILE_DOCS)
    stay = cut_lineage(found.where("stays").groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__stay")).agg(F.count(F.lit(1)).alias("__n")))
    own = docs.withColumn("__th", F.xxhash64(F.col(f"`{id_col}`").cast("long"), text_or_empty(text_col)))
    kept = own.join(stay, (F.col("__th") == F.col("__stay")) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")), "left_semi")
    if stay.where("__n > 1").limit(1).count():
        kept = kept.withColumn("__id", F.col(f"`{id_col}`").cast("long")).dropDuplicates(["__th", "__id"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
