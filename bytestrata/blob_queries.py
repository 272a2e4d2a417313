"""Queries over the bytes of blobs: matching, decoding, digests, statistics, identification."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import layout, texts
from .operators import identify as ident
from .operators import match, summaries
from .plans import candidates as plan
from .queries import _C, _FINDINGS, _findings, _query
from .sources import blobs, catalog, tables

#: What text tables hold instead of firmware: patterns and signatures that occur in them.
PATTERNS = [b"License", b"License,", b"the", b"he", b"R!!", b"e***", b"All rights reserved.", "é".encode()]
TEXT_SIGNATURES = """
[[signature]]
name = "html"
category = "container"
short = true
magic = [{ ascii = "<!DOCTYPE html>" }]
confidence = "structural"

[[signature]]
name = "license"
category = "document"
magic = [{ ascii = "Licensed under" }, { ascii = "Released under" }, { ascii = "All rights reserved." }]
confidence = "structural"

[[signature]]
name = "title"
category = "document"
magic = [{ ascii = "<title>" }]
struct = "bytes[7] tag; u8 first"
constraints = ["first >= 0x20", "first != 0x3c"]
size = "8"
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.from_text(tables.read(spark, sf_dir, "documents"), "doc_id", "text")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.from_text(tables.read(spark, sf_dir, "pages"), "page_id", "html")


@_query("SELECT page_id AS blob_id, starts_with(html, '<!DOCTYPE html>') AS found FROM pages")
def scan_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("blob_id", match.anchored(None, b"<!DOCTYPE html>").alias("found"))


# none of the patterns overlaps itself, so the pieces between its matches give their places
_HITS = "p(pattern) AS (VALUES " + ", ".join(f"('{p.decode()}')" for p in PATTERNS) + """),
    r AS (SELECT doc_id, pattern, string_split(text, pattern) AS pieces FROM documents, p WHERE contains(text, pattern)),
    u AS (SELECT doc_id, pattern, len(pieces) AS n, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM r),
    s AS (SELECT doc_id, lower(hex(encode(pattern))) AS pattern, start FROM (SELECT *, CAST(sum(strlen(piece) + strlen(pattern)) OVER (PARTITION BY doc_id, pattern ORDER BY k) AS BIGINT) - strlen(pattern) AS start FROM u) WHERE k < n)"""


@_query(f"WITH {_HITS} SELECT doc_id AS blob_id, pattern, start FROM s")
def scan_multi_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.hits(_documents(spark, sf_dir), PATTERNS)
    return found.select("blob_id", F.lower(F.hex("pattern")).alias("pattern"), "start")


@_query(f"WITH {_HITS} SELECT doc_id AS blob_id, pattern, start - 2 AS base FROM s WHERE start >= 2")
def match_rebase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAT-5 with a magic two bytes into its structure."""
    found = match.hits(_documents(spark, sf_dir), PATTERNS).withColumn("base", F.col("start") - 2)
    return found.where("base >= 0").select("blob_id", F.lower(F.hex("pattern")).alias("pattern"), "base")


@_query(f"WITH {_HITS}, d(pattern, name, category) AS (VALUES ('{PATTERNS[0].hex()}', 'license', 'document'), ('{PATTERNS[4].hex()}', 'shout', 'noise')) SELECT doc_id AS blob_id, name, category, count(*) AS hits FROM s JOIN d ON d.pattern = s.pattern GROUP BY ALL")
def signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-1: hits with the small table of signatures, whose size the code fixes."""
    dim = spark.createDataFrame([(bytearray(PATTERNS[0]), "license", "document"), (bytearray(PATTERNS[4]), "shout", "noise")], "pattern binary, name string, category string")
    return match.hits(_documents(spark, sf_dir), PATTERNS).join(F.broadcast(dim), "pattern").groupBy("blob_id", "name", "category").agg(F.count(F.lit(1)).alias("hits"))


_SIGS = """g(name, pri, validator, magic, place) AS (VALUES ('tar', 0, 'tar', 'ustar', 257), ('zip', 0, 'zip', 'PK', 0), ('zip', 0, 'zip', 'PZ', 0), ('pdf', 0, '', '%PDF', 0), ('v_zip', 1, '', 'PK', 0), ('v_both', 1, '', 'PK', 0), ('v_both', 1, '', 'QQ', 0), ('v_pdf', 1, '', '%PDF', 0), ('v_tar', 1, '', 'ustar', 0))"""


@_query(f"""WITH {_SIGS} SELECT name, count(*) AS magics FROM g a WHERE pri = 0 OR validator <> '' OR EXISTS (SELECT 1 FROM g b WHERE b.name = a.name AND NOT EXISTS
    (SELECT 1 FROM g c WHERE c.pri = 0 AND c.validator <> '' AND c.magic = b.magic AND c.place = b.place)) GROUP BY name""")
def redundant_signature_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7 as relational division."""
    rows = [("tar", 0, "tar", "ustar", 257), ("zip", 0, "zip", "PK", 0), ("zip", 0, "zip", "PZ", 0), ("pdf", 0, "", "%PDF", 0), ("v_zip", 1, "", "PK", 0), ("v_both", 1, "", "PK", 0), ("v_both", 1, "", "QQ", 0), ("v_pdf", 1, "", "%PDF", 0), ("v_tar", 1, "", "ustar", 0)]
    g = spark.createDataFrame(rows, "name string, pri int, validator string, magic string, place int")
    claimed = g.where("pri = 0 and validator <> ''").select("magic", "place")
    unclaimed = g.join(claimed, ["magic", "place"], "left_anti").select("name").distinct().withColumn("open", F.lit(True))
    kept = g.join(unclaimed, "name", "left").where("pri = 0 or validator <> '' or open")
    return kept.groupBy("name").agg(F.count(F.lit(1)).alias("magics"))


@_query("""SELECT o_orderkey AS blob_id, CAST(o_custkey AS BIGINT) AS ih_time, CAST(strlen(o_orderpriority) AS BIGINT) AS ih_size, CAST(o_orderkey % 65536 AS BIGINT) AS ih_load, CAST(5 AS BIGINT) AS ih_os, CAST(517 AS BIGINT) AS arch_type_le FROM orders""")
def layout_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-2: integers of either byte order out of packed headers."""
    c = F.col("content")
    fields = {"ih_time": (8, 4, "big"), "ih_size": (12, 4, "big"), "ih_load": (16, 4, "big"), "ih_os": (28, 1, "big"), "arch_type_le": (29, 2, "little")}
    return blobs.packed_orders(spark, sf_dir).select("blob_id", *[layout.column(c, *spec).alias(name) for name, spec in fields.items()])


@_query("SELECT o_orderkey AS blob_id, strlen(o_orderpriority) + 64 AS size_, CASE WHEN o_orderstatus = 'F' THEN 99 ELSE 60 END AS confidence, CASE WHEN o_orderstatus = 'F' THEN 'verified' ELSE 'structural' END AS tier, 'order ' || o_orderkey AS label FROM orders")
def identify_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole identification over one packed boot image an order, with the packaged signatures."""
    found = ident.identify(blobs.packed_orders(spark, sf_dir), _packaged())
    return found.where("offset_ = 0 and type_ = 'uimage'").select("blob_id", "size_", "confidence", "tier", "label")


@cache
def _packaged() -> list[str]:
    return [(catalog.HERE / name).read_text() for name in ("curated.toml", "vendor.toml")]


@_query()
def identify_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ident.identify(_pages(spark, sf_dir), [TEXT_SIGNATURES])
    return found.select("blob_id", "offset_", "size_", "type_", "category", "confidence", "tier", F.size("also_matched").alias("also"))


@_query("SELECT doc_id AS blob_id, sha256(coalesce(text, '')) AS sha256, md5(coalesce(text, '')) AS md5, sha1(coalesce(text, '')) AS sha1 FROM documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-5."""
    c = F.col("content")
    return _documents(spark, sf_dir).select("blob_id", F.sha2(c, 256).alias("sha256"), F.md5(c).alias("md5"), F.sha1(c).alias("sha1"))


_BYTES = """b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents WHERE text <> ''),
    n AS (SELECT doc_id, x, count(*) AS c FROM b GROUP BY ALL), t AS (SELECT doc_id, sum(c) AS total FROM n GROUP BY ALL)"""


def _with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' bytes, and an empty blob."""
    return _documents(spark, sf_dir).unionByName(spark.createDataFrame([(-1, bytearray())], "blob_id long, content binary"))


@_query(f"""WITH {_BYTES}, e AS (SELECT doc_id, round(-sum(c / total * log2(c / total)), 6) AS entropy FROM n JOIN t USING (doc_id) GROUP BY doc_id)
    SELECT d.doc_id AS blob_id, coalesce(entropy, 0.0) AS entropy FROM documents d LEFT JOIN e USING (doc_id) UNION ALL SELECT -1, 0.0""")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.byte_stats(_with_empty(spark, sf_dir)).select("blob_id", F.round("entropy", 6).alias("entropy"))


@_query(f"""WITH {_BYTES}, e AS (SELECT doc_id, round(max(c / total), 6) AS max_fraction FROM n JOIN t USING (doc_id) GROUP BY doc_id)
    SELECT d.doc_id AS blob_id, coalesce(max_fraction, 1.0) AS max_fraction FROM documents d LEFT JOIN e USING (doc_id) UNION ALL SELECT -1, 1.0""")
def max_byte_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.byte_stats(_with_empty(spark, sf_dir)).select("blob_id", F.round("max_fraction", 6).alias("max_fraction"))


# written out here, not taken from the code
_MIME = """m(p_type, mime) AS (VALUES ('gzip', 'application/gzip'), ('xz', 'application/x-xz'), ('lz4_legacy', 'application/x-lz4'), ('zip', 'application/zip'), ('7z', 'application/x-7z-compressed'), ('rar', 'application/vnd.rar'),
    ('png', 'image/png'), ('jpeg', 'image/jpeg'), ('pdf', 'application/pdf'), ('elf', 'application/x-executable'), ('upx', 'application/x-upx'), ('ihex', 'text/x-hex'), ('iso9660', 'application/x-iso9660-image'),
    ('certificate', 'application/x-x509-ca-cert'), ('private_key', 'application/x-pem-file'), ('verity', 'application/x-verity-hash'), ('rpi_eeprom', 'application/x-raspberry-eeprom'), ('squashfs_legacy', 'application/x-squashfs'),
    ('ext', 'application/x-ext'), ('fat32', 'application/x-fat'), ('minix', 'application/x-minix-fs'), ('android_boot', 'application/x-android-bootimg'), ('fit', 'application/x-flat-image-tree'), ('uboot_env', 'application/x-uboot-env'),
    ('vbmeta', 'application/x-avb-vbmeta'), ('uefi_fv', 'application/x-uefi-firmware-volume'), ('lk', 'application/x-lk-bootloader'), ('mtk_lk', 'application/x-mediatek-lk-bootloader'), ('esp32_partition_table', 'application/x-esp32-partition-table'),
    ('luks1', 'application/x-luks'), ('luks2', 'application/x-luks'), ('cab', 'application/octet-stream'), ('yaffs2', 'application/x-yaffs2'), ('no such type', 'application/octet-stream'))"""
_MIME_TYPES = ["gzip", "xz", "lz4_legacy", "zip", "7z", "rar", "png", "jpeg", "pdf", "elf", "upx", "ihex", "iso9660", "certificate", "private_key", "verity", "rpi_eeprom", "squashfs_legacy", "ext", "fat32", "minix", "android_boot", "fit", "uboot_env", "vbmeta", "uefi_fv", "lk", "mtk_lk", "esp32_partition_table", "luks1", "luks2", "cab", "yaffs2", "no such type"]


@_query(f"WITH {_MIME}, k AS (SELECT *, row_number() OVER () - 1 AS k FROM m) SELECT p_partkey, k.p_type, mime FROM part JOIN k ON k.k = p_partkey % 34")
def mime_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in _MIME_TYPES])
    rows = tables.read(spark, sf_dir, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % len(_MIME_TYPES)).cast("int")).alias("p_type"))
    return rows.withColumn("mime", texts.mime(F.col("p_type")))


@_query(f"""WITH RECURSIVE {_FINDINGS} SELECT blob_id, '0x' || lpad(lower(to_hex(offset_)), 8, '0') || '-' || type_ || '.bin' AS name, size_, CASE confidence WHEN 99 THEN 'verified' WHEN 85 THEN 'consistent' WHEN 60 THEN 'structural' ELSE 'magic' END AS tier FROM r""")
def carve_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-6: the names and sizes of what would be carved."""
    return _findings(spark, sf_dir).select("blob_id", texts.blob_name(F.col("offset_"), F.col("type_")).alias("name"), "size_", texts.tier_name(F.col("confidence")).alias("tier"))


@_query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem)
    SELECT l_orderkey, count(*) AS kept, CAST(sum(CASE WHEN l_quantity * 100 > 3000 THEN 3000 ELSE l_quantity * 100 END) AS BIGINT) AS bytes FROM f WHERE l_quantity BETWEEN 5 AND 45 AND CAST(floor(l_extendedprice) AS BIGINT) & 3 <> 0 GROUP BY l_orderkey""")
def constraint_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-5, FIL-7: hard rules as pushed-down filters, then sizes clamped to what is there."""
    rows = tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    kept = rows.where("l_quantity between 5 and 45 and (cast(floor(l_extendedprice) as bigint) & 3) <> 0")
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.least(F.col("l_quantity") * 100, F.lit(3000.0))).cast("long").alias("bytes"))


@_query(f"WITH {_C} SELECT blob_id, offset_, type_, CASE WHEN size_ <= 400 THEN confidence ELSE 25 END AS confidence, CASE WHEN size_ <= 400 THEN size_ ELSE 0 END AS size_ FROM c")
def soft_constraint_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-6: a broken soft rule keeps the candidate at the lowest tier, without its size."""
    ok = F.col("size_") <= 400
    return plan.candidates(spark, sf_dir).select("blob_id", "offset_", "type_", F.when(ok, F.col("confidence")).otherwise(25).alias("confidence"), F.when(ok, F.col("size_")).otherwise(0).alias("size_"))
