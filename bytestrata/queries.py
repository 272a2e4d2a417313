"""The registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import intervals, summaries
from .plans import candidates as plan
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    from . import blob_queries, sample_queries  # noqa: F401  register their own

    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    from . import blob_queries, sample_queries  # noqa: F401

    return {k: sql for k, (_, sql) in _FOUND.items() if sql}


_ORDER = "offset_, confidence DESC, size_, type_, (endian = 'big'), category"
_C = f"c AS ({plan.SQL}), o AS (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY {_ORDER}) AS place FROM c)"

#: Blobs, some of which have no candidates or can't be opened, and the candidates of the others.
_B = f"b AS ({plan.BLOBS_SQL}), c AS (SELECT r.* FROM ({plan.SQL}) r JOIN b ON b.blob_id = r.blob_id WHERE length IS NOT NULL AND {plan.FEW}), o AS (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY {_ORDER}) AS place FROM c)"


def _fold(rescue: str) -> str:
    """Greedy ownership row by row: state is the owner, its end, and the last kept row."""
    owns = "(o.confidence >= 60 AND o.size_ > 0)"
    inside = f"(o.offset_ = f.last OR (o.offset_ < f.end_ AND NOT ({rescue})))"
    return f"""{_C},
    f AS (
        SELECT o.*, true AS kept, CASE WHEN {owns} THEN offset_ + size_ ELSE -1 END AS end_, CASE WHEN {owns} THEN place ELSE -1 END AS owner, offset_ AS last, place AS last_place, CAST(-1 AS BIGINT) AS lost_to
        FROM o WHERE place = 1
        UNION ALL
        SELECT o.*, NOT {inside}, CASE WHEN NOT {inside} AND {owns} THEN o.offset_ + o.size_ ELSE f.end_ END, CASE WHEN NOT {inside} AND {owns} THEN o.place ELSE f.owner END,
               CASE WHEN {inside} THEN f.last ELSE o.offset_ END, CASE WHEN {inside} THEN f.last_place ELSE o.place END,
               CASE WHEN o.offset_ = f.last THEN f.last_place WHEN {inside} THEN f.owner ELSE -1 END
        FROM f JOIN o ON o.blob_id = f.blob_id AND o.place = f.place + 1
    ),
    k AS (
        SELECT f.blob_id, f.place, f.offset_, f.size_, f.type_, f.category, f.confidence, f.endian, (SELECT count(*) FROM f g WHERE g.blob_id = f.blob_id AND g.lost_to = f.place) AS also
        FROM f WHERE kept
    )"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.candidates(spark, sf_dir)


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.sized(intervals.owned(_candidates(spark, sf_dir)), F.lit(plan.LENGTH))


_FINDINGS = f"""{_fold('false')},
    s AS (SELECT blob_id, offset_, CASE WHEN size_ = 0 THEN coalesce(lead(offset_) OVER (PARTITION BY blob_id ORDER BY place), {plan.LENGTH}) - offset_ ELSE size_ END AS size_, type_, category, confidence, endian, also FROM k),
    r AS (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY {_ORDER}) AS place FROM s)"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_findings(spark, sf_dir)


@_query(f"WITH {_C} SELECT blob_id, offset_, size_, type_, confidence, endian, place FROM o")
def finding_total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = intervals.Window.partitionBy("blob_id").orderBy(*intervals.total_order(), "category")
    return _candidates(spark, sf_dir).withColumn("place", F.row_number().over(w)).select("blob_id", "offset_", "size_", "type_", "confidence", "endian", "place")


@_query(f"""WITH {_C}, n AS (SELECT *, row_number() OVER (PARTITION BY blob_id, offset_ ORDER BY place) AS nth, count(*) OVER (PARTITION BY blob_id, offset_) - 1 AS also FROM o)
    SELECT blob_id, offset_, size_, type_, confidence, also FROM n WHERE nth = 1""")
def same_offset_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.same_offset_winners(_candidates(spark, sf_dir)).select("blob_id", "offset_", "size_", "type_", "confidence", "also")


@_query(f"WITH RECURSIVE {_fold('false')} SELECT blob_id, offset_, size_, type_, confidence, endian, also FROM k")
def greedy_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.owned(_candidates(spark, sf_dir)).select("blob_id", "offset_", "size_", "type_", "confidence", "endian", "also")


@_query(f"WITH RECURSIVE {_fold('o.offset_ % 256 = 0')} SELECT blob_id, offset_, size_, type_, confidence, endian, also FROM k")
def partition_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at a multiple of 256 stand for partition starts."""
    return intervals.owned(_candidates(spark, sf_dir), F.col("offset_") % 256 == 0).select("blob_id", "offset_", "size_", "type_", "confidence", "endian", "also")


@_query(f"WITH RECURSIVE {_fold('false')} SELECT blob_id, CAST(sum(also) AS BIGINT) AS also_matched, count(*) AS kept FROM k GROUP BY blob_id")
def also_matched_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.owned(_candidates(spark, sf_dir)).groupBy("blob_id").agg(F.sum("also").alias("also_matched"), F.count(F.lit(1)).alias("kept"))


@_query(f"WITH RECURSIVE {_FINDINGS} SELECT blob_id, offset_, size_, type_, category, confidence, endian, also FROM r")
def resolve_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolved findings with inferred sizes."""
    return _findings(spark, sf_dir).select("blob_id", "offset_", "size_", "type_", "category", "confidence", "endian", "also")


def _islands_sql(table: str, gap: int) -> str:
    return f"""w AS (SELECT *, max(offset_ + size_) OVER (PARTITION BY blob_id ORDER BY offset_, size_, type_, confidence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {table}),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR offset_ > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY blob_id ORDER BY offset_, size_, type_, confidence) AS isle FROM w),
    g AS (SELECT blob_id, min(offset_) AS offset_, max(offset_ + size_) - min(offset_) AS size_, count(*) AS merged FROM i GROUP BY blob_id, isle)"""


@_query(f"WITH {_C}, t AS (SELECT * FROM c WHERE type_ IN ('t0', 't1', 't2', 't3')), {_islands_sql('t', 64)} SELECT * FROM g")
def coalesce_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.islands(_candidates(spark, sf_dir).where(F.col("type_").isin("t0", "t1", "t2", "t3")), 64)


@_query(f"WITH {_C}, t AS (SELECT * FROM c WHERE category IN ('filesystem', 'container')), {_islands_sql('t', 128)} SELECT * FROM g")
def container_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.islands(_candidates(spark, sf_dir).where(F.col("category").isin(*intervals.CONTAINERS)), 128)


@_query(f"""WITH {_B}, t AS (SELECT * FROM c WHERE category IN ('filesystem', 'container') AND size_ > 0), {_islands_sql('t', 128)},
    s AS (SELECT blob_id, offset_, size_ FROM c WHERE size_ > 0 UNION ALL SELECT blob_id, offset_, size_ FROM g),
    y AS (SELECT b.blob_id, b.length, s.offset_, s.size_ FROM b LEFT JOIN s ON s.blob_id = b.blob_id WHERE length IS NOT NULL),
    x AS (SELECT blob_id, offset_, max(offset_ + size_) OVER (PARTITION BY blob_id ORDER BY offset_, size_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM y WHERE offset_ IS NOT NULL),
    z AS (SELECT blob_id, coalesce(reach, 0) AS gap_offset, offset_ - coalesce(reach, 0) AS gap_size FROM x
          UNION ALL SELECT blob_id, coalesce(max(offset_ + size_), 0), any_value(length) - coalesce(max(offset_ + size_), 0) FROM y GROUP BY blob_id)
    SELECT blob_id, CAST(gap_offset AS BIGINT) AS gap_offset, CAST(gap_size AS BIGINT) AS gap_size FROM z WHERE gap_size >= 64""")
def unidentified_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every blob that can be opened, also those without findings."""
    return intervals.gaps(plan.blobs(spark, sf_dir), plan.few(spark, sf_dir), 64, bridge=128)


@_query(f"""WITH RECURSIVE {_FINDINGS} SELECT blob_id, offset_, size_, type_, category FROM r f WHERE NOT EXISTS (
    SELECT 1 FROM r g WHERE g.blob_id = f.blob_id AND g.category IN ('filesystem', 'container', 'archive') AND g.size_ > 0
    AND g.offset_ <= f.offset_ AND f.offset_ + greatest(f.size_, 1) <= g.offset_ + g.size_ AND (g.offset_ < f.offset_ OR f.offset_ + greatest(f.size_, 1) < g.offset_ + g.size_))""")
def suppress_interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.suppressed(_findings(spark, sf_dir)).select("blob_id", "offset_", "size_", "type_", "category")


_PARENT = """p AS (SELECT a.blob_id, a.place, arg_min(b.place, (b.size_, b.place)) AS parent_place, arg_min(b.type_, (b.size_, b.place)) AS parent_type
    FROM o a JOIN o b ON a.blob_id = b.blob_id AND b.category IN ('filesystem', 'container') AND b.size_ > 0 AND b.offset_ <= a.offset_ AND a.offset_ + a.size_ <= b.offset_ + b.size_ AND b.size_ > a.size_ GROUP BY 1, 2)"""


@_query(f"WITH {_C}, {_PARENT} SELECT o.blob_id, o.offset_, o.size_, o.type_, o.place, parent_place, parent_type FROM o LEFT JOIN p ON p.blob_id = o.blob_id AND p.place = o.place")
def tightest_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.parents(_placed(spark, sf_dir)).select("blob_id", "offset_", "size_", "type_", "place", "parent_place", "parent_type")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = intervals.Window.partitionBy("blob_id").orderBy(*intervals.total_order(), "category")
    return _candidates(spark, sf_dir).withColumn("place", F.row_number().over(w))


@_query(f"""WITH {_C}, {_PARENT} SELECT o.blob_id, parent_place, o.type_, count(*) AS n, CAST(sum(size_) AS BIGINT) AS bytes FROM o LEFT JOIN p ON p.blob_id = o.blob_id AND p.place = o.place
    WHERE o.type_ <> 'private_key' AND o.category NOT IN ('container', 'filesystem', 'bootloader', 'executable') GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def swarm_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings of one type under one parent, folded from two on, as an order's lines are few."""
    return intervals.swarms(intervals.parents(_placed(spark, sf_dir)), 1)


def _few(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = intervals.Window.partitionBy("blob_id").orderBy(*intervals.total_order(), "category")
    return plan.few(spark, sf_dir).withColumn("place", F.row_number().over(w))


_PRIMARY = """t AS (SELECT blob_id, arg_min(type_, (offset_ <> 0, -confidence, place)) AS type_ FROM o GROUP BY blob_id),
    p AS (SELECT b.blob_id, coalesce(t.type_, CASE WHEN length IS NULL THEN 'unreadable' ELSE 'unknown' END) AS primary_type FROM b LEFT JOIN t ON t.blob_id = b.blob_id)"""


@_query(f"WITH {_B}, {_PRIMARY} SELECT * FROM p")
def primary_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.primary_types(plan.blobs(spark, sf_dir), _few(spark, sf_dir))


@_query(f"WITH {_B}, {_PRIMARY}, n AS (SELECT primary_type, count(*) AS files FROM p GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY files DESC, primary_type) AS INT) AS place FROM n")
def by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.by_type(primary_type(spark, sf_dir))


@_query(f"""WITH {_B} SELECT (SELECT count(*) FROM b) AS file_count, (SELECT CAST(sum(length) AS BIGINT) FROM b) AS bytes, count(*) AS finding_count, CAST(sum(CASE WHEN category = 'crypto' THEN 1 ELSE 0 END) AS BIGINT) AS crypto_count FROM c""")
def tree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.totals(plan.blobs(spark, sf_dir), plan.few(spark, sf_dir))


@_query(f"WITH {_C} SELECT blob_id, offset_, type_, category FROM c WHERE category IN ('filesystem', 'container', 'executable', 'bootloader', 'dtb', 'crypto', 'encrypted')")
def notable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).where(F.col("category").isin(*summaries.NOTABLE)).select("blob_id", "offset_", "type_", "category")


@_query(f"""WITH {_B}, t AS (SELECT blob_id, type_, min(place) AS first, count(*) AS n FROM o GROUP BY 1, 2),
    l AS (SELECT blob_id, string_agg(CASE WHEN n > 1 THEN type_ || ' x' || n ELSE type_ END, ', ' ORDER BY first) AS summary FROM t GROUP BY 1)
    SELECT b.blob_id, coalesce(summary, 'no known signatures identified') AS summary FROM b LEFT JOIN l ON l.blob_id = b.blob_id""")
def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.summary(plan.blobs(spark, sf_dir), _few(spark, sf_dir))


@_query(f"""WITH {_B}, {_PRIMARY}, n AS (SELECT primary_type, count(*) AS files FROM p GROUP BY 1), q AS (SELECT * FROM n WHERE primary_type NOT IN ('unknown', 'unreadable') ORDER BY files DESC, primary_type LIMIT 5)
    SELECT (SELECT sum(files) FROM n) || ' files: ' || string_agg(files || ' ' || primary_type, ', ' ORDER BY files DESC, primary_type) || '; ' || (SELECT count(*) FROM c WHERE category = 'crypto') || ' key/cert' AS assessment FROM q""")
def assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.tree_assessment(primary_type(spark, sf_dir), plan.few(spark, sf_dir))


@_query("SELECT '0 files' AS assessment")
def assessment_of_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.tree_assessment(primary_type(spark, sf_dir).where("primary_type = ''"), plan.few(spark, sf_dir).where("type_ = ''"))


@_query(f"WITH {_C} SELECT blob_id, CAST(sum(size_) AS BIGINT) AS covered FROM c GROUP BY 1")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).groupBy("blob_id").agg(F.sum("size_").alias("covered"))


@_query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def newest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.newest(tables.read(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "ts")


@_query("""WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) > 3 AS members_truncated FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, members_truncated FROM n WHERE k <= 3""")
def member_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return summaries.truncated(rows, "l_orderkey", [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")], 3).select("l_orderkey", "l_linenumber", "l_partkey", "members_truncated")


_TYPES = """t AS (SELECT blob_id, type_, min(place) AS first, sum(size_) AS bytes, sum(CASE WHEN category = 'crypto' THEN 1 ELSE 0 END) AS n FROM o GROUP BY 1, 2),
    l AS (SELECT blob_id, string_agg(type_, ' + ' ORDER BY first) AS types, sum(bytes) AS covered, CAST(sum(n) AS INT) AS keys FROM t GROUP BY 1)"""


@_query(f"""WITH {_B}, {_TYPES}
    SELECT b.blob_id, coalesce(types, 'no known structures identified') || CASE WHEN keys > 0 THEN '; ' || keys || ' key/cert' ELSE '' END AS assessment FROM b LEFT JOIN l ON l.blob_id = b.blob_id""")
def file_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.assessments(plan.blobs(spark, sf_dir), _few(spark, sf_dir))


#: Entropies as a rule over ids, since candidates have no bytes: of a blob, and of a range without findings.
_ENTROPY, _DENSE = "CAST((blob_id % 32) / 4.0 AS DOUBLE)", "CAST(((blob_id + gap_offset) % 32) / 4.0 AS DOUBLE)"


@_query(f"""WITH {_B}, {_TYPES}, s AS (SELECT blob_id, offset_, size_ FROM c WHERE size_ > 0 UNION ALL SELECT blob_id, 4096, 0 FROM b WHERE length IS NOT NULL),
    m AS (SELECT blob_id, min(offset_) AS lo, max(offset_ + size_) AS hi FROM c WHERE category IN ('filesystem', 'container') AND size_ > 0 GROUP BY 1),
    u AS (SELECT * FROM s UNION ALL SELECT blob_id, lo, hi - lo FROM m),
    x AS (SELECT blob_id, offset_, coalesce(max(offset_ + size_) OVER (PARTITION BY blob_id ORDER BY offset_, size_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap_offset FROM u),
    d AS (SELECT DISTINCT blob_id FROM x WHERE (offset_ - gap_offset) * 4 >= 4096 AND {_DENSE} >= 7.2)
    SELECT b.blob_id, CASE WHEN types IS NULL THEN 'no known structures; whole-file entropy ' || printf('%.1f', {_ENTROPY.replace('blob_id', 'b.blob_id')}) || CASE WHEN {_ENTROPY.replace('blob_id', 'b.blob_id')} >= 7.2 THEN ' - likely encrypted or compressed' ELSE '' END
        ELSE types || CASE WHEN d.blob_id IS NOT NULL AND covered < length THEN '; high-entropy unidentified region(s) - possible encryption' ELSE '' END END
        || CASE WHEN keys > 0 THEN '; ' || keys || ' key/cert' ELSE '' END AS assessment
    FROM b LEFT JOIN l ON l.blob_id = b.blob_id LEFT JOIN d ON d.blob_id = b.blob_id""")
def entropy_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line with entropies; a range counts four times its bytes here, as the blobs are short."""
    blobs, rows = plan.blobs(spark, sf_dir), plan.few(spark, sf_dir)
    regions = intervals.gaps(blobs, rows, 1).selectExpr("blob_id", "gap_size * 4 AS size_", f"{_DENSE} AS entropy")
    return summaries.assessments(blobs.withColumn("entropy", F.expr(_ENTROPY)), _few(spark, sf_dir), regions)


@_query(f"WITH {_C} SELECT blob_id, count(*) AS rows_, CAST(sum(CASE WHEN confidence >= 85 THEN 1 ELSE 0 END) AS BIGINT) AS sure, max(confidence) AS best FROM c GROUP BY blob_id")
def confidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    return rows.groupBy("blob_id").agg(F.count(F.lit(1)).alias("rows_"), F.sum((F.col("confidence") >= 85).cast("long")).alias("sure"), F.max("confidence").alias("best"))


@_query(f"""WITH {_C}, w AS (SELECT blob_id, offset_, min(offset_) OVER (PARTITION BY blob_id ORDER BY offset_ RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_start FROM c WHERE category = 'container')
    SELECT DISTINCT * FROM w""")
def next_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-8: the smallest container start behind each container: a forward as-of join as a window."""
    rows = _candidates(spark, sf_dir).where("category = 'container'")
    w = intervals.Window.partitionBy("blob_id").orderBy("offset_").rangeBetween(1, intervals.Window.unboundedFollowing)
    return rows.select("blob_id", "offset_", F.min("offset_").over(w).alias("next_start")).distinct()


@_query(f"""WITH {_C}, e AS (SELECT blob_id, offset_ AS start, offset_ + size_ AS end_, place FROM o WHERE category = 'filesystem' OR (category = 'container' AND size_ > 0))
    SELECT o.blob_id, o.place, min(e.place) AS extent FROM o JOIN e ON e.blob_id = o.blob_id AND e.start <= o.offset_ AND o.offset_ < e.end_ GROUP BY 1, 2""")
def extent_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-4: each row with the first extent that holds its offset."""
    rows = _placed(spark, sf_dir)
    extents = rows.where("category = 'filesystem' or (category = 'container' and size_ > 0)").select("blob_id", F.col("offset_").alias("start"), (F.col("offset_") + F.col("size_")).alias("end_"), "place")
    return intervals.first_extents(rows, extents)
