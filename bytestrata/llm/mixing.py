"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over blocks of documents.

1. A document's size is its number of words. Sources in the order of their code points, null last, weigh 3, 1, 2 and so
   on; they share ``SHARE`` of all words. A source's target stops at ``MOST`` times its own words; what it can't take is
   shared again by weight among those that can, until no target is above.
2. A hash of the document deals each source's documents into blocks, which are therefore random subsets. The number of
   blocks is bounded by ``BLOCKS`` in all, so their totals fit on the driver whatever the corpus.
3. A source's draws are its blocks in a seeded permutation, then once more in another, as far as the target goes. The
   last block of the draws is taken in part: its documents from the largest to the smallest as they still fit.
4. The tree splits the output shards in halves; a node's draws are dealt to its halves by a multivariate hypergeometric
   draw over the sources' quotas, so each shard's total is exact and its composition is that of a random deal. Each leaf
   takes the next blocks of each source's permutation: disjoint ones.
5. ``mixed`` deals the rows to their shards, a partition or more each, and shuffles each locally: rows are sorted by place, a
   hash of shard, draw and document.

All randomness comes from ``seed`` and hashes, so reruns agree. Texts don't travel: only ids, sources and sizes are
shuffled, in a partial aggregation.

Defined results: a null text has size 0, and is taken by no partial draw; a null source is a source of its own; documents
without words have taken 0; an empty table, or one without words, gives targets of 0; rows that repeat (the same id and
text) are dealt alike, all of them or none; ties of size go by hash and id; further columns of the input play no part. The
totals of sources, one row each, are gathered on the driver: some 200 bytes a source there and 60 broadcast, so sources are
thought of as thousands, not as millions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut_lineage, text_or_empty, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SHARDS = 16
SEED = 20
#: Blocks of all sources together, besides one per source, and documents that a block has at least on average.
BLOCKS = 1 << 15
BLOCK_DOCS = 32


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Each source's target: the shared total by weight, no more than most times its size, the excess reshared."""
    total, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        by_weight = sum(weights[i] for i in open_)
        want = {i: rest * weights[i] / by_weight for i in open_}
        full = {i for i in open_ if want[i] >= most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = want[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
        open_ -= full
    return out


def split_tree(quotas: list[int], shards: int, rng: np.random.Generator) -> np.ndarray:
    """How many draws of each source each shard takes (shards x sources): a random deal with equal shard totals."""
    quota = np.asarray(quotas, np.int64)
    if shards == 1:
        return quota[None, :]
    left = shards // 2
    n_left = int(quota.sum()) * left // shards
    dealt = rng.multivariate_hypergeometric(quota, n_left, method="marginals") if len(quota) else quota
    return np.concatenate([split_tree(dealt, left, rng), split_tree(quota - dealt, shards - left, rng)])


@dataclass
class Plan:
    """draws: (source, block, draw, shard, budget) with a budget of words for the one partial draw of a source, else -1."""

    sources: pd.DataFrame  # rank, source, size, blocks, target
    draws: pd.DataFrame


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """doc_id, source, size and the hash that deals; written out, as several steps read it."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), text_or_empty(text_col).alias("text"))
    slim = slim.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    return cut_lineage(slim)


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, shards: int = SHARDS, seed: int = SEED) -> tuple[Plan, DataFrame]:
    """The plan, and rows with their source's rank and their block."""
    totals = [tuple(r) for r in rows.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect()]  # one row per source
    totals.sort(key=lambda r: (r[0] is None, r[0] or ""))
    docs_in_all = sum(r[2] for r in totals) or 1
    sources = pd.DataFrame({"rank": np.arange(len(totals)), "source": [r[0] for r in totals], "size": [r[1] for r in totals]})
    sources["blocks"] = [int(max(1, min(-(-r[2] // BLOCK_DOCS), BLOCKS * r[2] // docs_in_all))) for r in totals]
    sources["target"] = targets([r[1] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], share, most)

    spark = rows.sparkSession
    dim = spark.createDataFrame([(int(r.rank), r.source, int(r.blocks)) for r in sources.itertuples(index=False)], "rank int, source string, blocks int")
    blocked = rows.join(F.broadcast(dim), rows["source"].eqNullSafe(dim["source"])).select("doc_id", "rank", "size", "h", F.pmod("h", "blocks").cast("int").alias("block"))
    sizes = blocked.groupBy("rank", "block").agg(F.sum("size").alias("size")).toPandas()  # at most BLOCKS and one per source

    lists, quotas = [], []
    for rank, target in zip(sources["rank"], sources["target"], strict=True):
        own = sizes[sizes["rank"] == rank].sort_values("block")
        order = np.random.default_rng([seed, int(rank)])
        seq = pd.concat([own.iloc[order.permutation(len(own))].assign(draw=k) for k in range(most)]) if len(own) else own.assign(draw=0)
        ends = seq["size"].to_numpy().cumsum()
        whole = int(np.searchsorted(ends, target + 1e-6, side="right"))
        seq = seq.iloc[: min(whole + 1, len(seq))].assign(budget=-1)
        rest = target - (ends[whole - 1] if whole else 0)
        if len(seq) > whole:
            seq = seq.assign(budget=np.where(np.arange(len(seq)) == whole, int(round(rest)), -1))
        lists.append(seq)
        quotas.append(len(seq))
    dealt = split_tree(quotas, shards, np.random.default_rng([seed, len(quotas)])) if quotas else np.zeros((shards, 0), np.int64)
    for k, seq in enumerate(lists):
        lists[k] = seq.assign(shard=np.repeat(np.arange(shards), dealt[:, k]))
    draws = pd.concat(lists)[["rank", "block", "draw", "shard", "budget"]] if lists else pd.DataFrame(columns=["rank", "block", "draw", "shard", "budget"], dtype=np.int64)
    return Plan(sources, draws.astype(np.int64)), blocked


def _fill(budgets: dict[int, int]):
    """Of one block's documents, those that a partial draw takes: from the largest, while they fit.

    The last that doesn't fit is taken too if the draw then misses its words by less.
    """

    def fill(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "h", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        words = (block["size"] * block["times"]).to_numpy()
        left, taken = budgets[int(block["rank"].iloc[0])], np.zeros(len(block), bool)
        for k, size in enumerate(words):
            if 0 < size <= left:
                taken[k], left = True, left - size
        over = np.flatnonzero(~taken & (words > 0))
        if len(over) and words[over[-1]] - left < left:
            taken[over[-1]] = True
        return block[taken][["rank", "block", "doc_id", "h", "size"]]

    return fill


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, pd.DataFrame]:
    """One row per document of docs: doc_id, size, rank, h and uses, an array of (shard, draw, place) for each time it is taken.

    The second result is the sources' table. place orders a shard's rows.
    """
    rows = sized(docs, id_col, text_col, source_col, seed)
    made, blocked = plan(rows, weights, share, most, shards, seed)
    spark = docs.sparkSession
    # at most MOST draws of BLOCKS blocks and of one more per source
    dealt = made.draws.assign(use=list(zip(made.draws["shard"].tolist(), made.draws["draw"].tolist(), made.draws["budget"].tolist(), strict=True))).groupby(["rank", "block"])["use"].agg(list).reset_index() if len(made.draws) else None
    per_block = spark.createDataFrame([(int(r), int(b), u) for r, b, u in dealt.itertuples(index=False)] if dealt is not None else [], "rank int, block int, uses array<struct<shard:int,draw:int,budget:long>>")
    joined = blocked.join(F.broadcast(per_block), ["rank", "block"], "left")

    part = made.draws[made.draws["budget"] >= 0]
    budgets = {int(r): int(b) for r, b in zip(part["rank"], part["budget"], strict=True)}
    cuts = spark.createDataFrame([(int(r), int(b)) for r, b in zip(part["rank"], part["block"], strict=True)], "rank int, block int")
    # one block per source; rows that repeat are one row of it
    last = blocked.join(F.broadcast(cuts), ["rank", "block"], "left_semi").groupBy("rank", "block", "doc_id", "h", "size").agg(F.count(F.lit(1)).alias("times"))
    fits = last.groupBy("rank", "block").applyInPandas(_fill(budgets), "rank int, block int, doc_id long, h long, size long").select("rank", "doc_id", "h").distinct().withColumn("fits", F.lit(True))
    # only a cut's own documents need the second join; the others pass without a shuffle
    is_cut = F.exists(F.coalesce("uses", F.array().cast("array<struct<shard:int,draw:int,budget:long>>")), lambda u: u["budget"] >= 0)
    plain, cut = joined.where(~is_cut).withColumn("fits", F.lit(False)), joined.where(is_cut)
    cut = cut.join(fits, (cut["rank"] == fits["rank"]) & (cut["h"] == fits["h"]) & cut["doc_id"].eqNullSafe(fits["doc_id"]), "left").select(*[cut[c] for c in cut.columns], F.coalesce(fits["fits"], F.lit(False)).alias("fits"))
    every = plain.unionByName(cut)
    uses = F.transform(
        F.filter(F.coalesce("uses", F.array().cast("array<struct<shard:int,draw:int,budget:long>>")), lambda u: (F.col("size") > 0) & ((u["budget"] < 0) | F.col("fits"))),
        lambda u: F.struct(u["shard"].alias("shard"), u["draw"].alias("draw"), F.xxhash64(F.lit(seed + 1), u["shard"], u["draw"], F.col("h")).alias("place")),
    )
    return every.select("doc_id", "size", "rank", "h", uses.alias("uses")), made.sources


def annotate(docs: DataFrame, **how) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken (words the mix takes), and the shards that take it with its places there."""
    rows, sources = mix(docs, **how)
    dim = docs.sparkSession.createDataFrame([(int(r.rank), int(r.size), float(r.target)) for r in sources[["rank", "size", "target"]].itertuples(index=False, name="S")], "rank int, source_size long, target double")
    out = rows.join(F.broadcast(dim), "rank")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("uses")).cast("long").alias("taken"), F.transform("uses", lambda u: u["shard"]).alias("shards"), F.transform("uses", lambda u: u["place"]).alias("places"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, shards: int = SHARDS, partitions: int | None = None, **how) -> DataFrame:
    """The mix: docs' rows, each as often as it is taken, with docs' own columns, dealt to their shards and shuffled there.

    Each partition holds rows of one shard, in the order of their places; a shard has partitions / shards of them (by
    default as many as the session's shuffles have partitions), cut by place, so a written part file is a run of its shard.
    """
    rows, _ = mix(docs, id_col, text_col, source_col, seed=seed, shards=shards, **how)
    taken = rows.where(F.size("uses") > 0).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("uses").alias("__uses")).dropDuplicates(["__id", "__h"])
    own = docs.withColumn("__h", F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("long"), text_or_empty(text_col)))
    hit = own.alias("a").join(taken.alias("b"), F.col("a.__h") == F.col("b.__h")).where(F.col(f"a.`{id_col}`").cast("long").eqNullSafe(F.col("b.__id")))
    each = hit.select(*[F.col(f"a.`{c}`") for c in docs.columns], F.explode("b.__uses").alias("__use"))
    parts = max(1, -(-(partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) // shards))
    # places are uniform over the 64-bit numbers, so equal ranges of them are equal parts of a shard
    part = F.least(F.floor((F.col("__use.place").cast("double") / 2.0**64 + 0.5) * parts), F.lit(parts - 1)).cast("int")
    dealt = each.repartitionById(shards * parts, F.col("__use.shard") * parts + part)
    return dealt.sortWithinPartitions("__use.place").select(*[F.col(f"`{c}`") for c in docs.columns])
