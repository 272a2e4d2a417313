"""What people read: trees of findings and of unpacked files, tags, notable findings, and one JSON document of many files."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import hex_offset, human_size
from . import intervals, sinks, summaries

#: LIM-2: notable findings that are shown; documents have all.
SHOWN = 40


def tags(findings: DataFrame) -> DataFrame:
    """AGG-16: a finding's diagnostics as short tags in the order of their first, equal ones with their number: blob_id, offset_, type_, tags."""
    each = findings.select("blob_id", "offset_", "type_", F.posexplode("diagnostics").alias("k", "d"))
    prefix = F.concat("type_", F.lit("-"))
    code = F.when(F.startswith(F.col("d.code"), prefix), F.substr(F.col("d.code"), F.length(prefix) + 1)).otherwise(F.col("d.code"))
    per = each.groupBy("blob_id", "offset_", "type_", F.col("d.severity").alias("severity"), code.alias("code")).agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("n"))
    short = F.when(F.col("severity") == "error", "err").when(F.col("severity") == "warning", "warn").otherwise("info")
    tag = F.concat(F.lit("["), short, F.lit(": "), "code", F.when(F.col("n") > 1, F.concat(F.lit(" ×"), F.col("n").cast("string"))).otherwise(F.lit("")), F.lit("]"))
    listed = per.groupBy("blob_id", "offset_", "type_").agg(F.array_sort(F.collect_list(F.struct("k", tag.alias("tag")))).alias("all"))
    return listed.select("blob_id", "offset_", "type_", F.array_join(F.transform("all", lambda x: x["tag"]), " ").alias("tags"))


def notable(blobs: DataFrame, findings: DataFrame, most: int = SHOWN) -> DataFrame:
    """LIM-2: the first notable findings by path and offset, and a last row that says how many more there are.

    blobs: blob_id and path. Two small results: a top-k and a count.
    """
    rows = findings.where(F.col("category").isin(*summaries.NOTABLE)).join(blobs.select("blob_id", "path"), "blob_id").select("path", "offset_", "type_")
    first = rows.orderBy("path", "offset_", "type_").limit(most)
    more = rows.agg((F.count(F.lit(1)) - most).alias("n")).where("n > 0").select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("offset_"), F.concat(F.lit("… and "), F.col("n").cast("string"), F.lit(" more")).alias("type_"))
    return first.unionByName(more)


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lines = [], []
        for row in batch.to_pylist():
            children: dict[int | None, list[dict]] = {}
            for f in row["findings"]:
                children.setdefault(f["parent_place"], []).append(f)
            todo = [("", "", None, x) for x in reversed(_folded(children.get(None, [])))]
            while todo:
                lead, turn, _, f = todo.pop()
                ids.append(row["blob_id"])
                lines.append(f"{lead}{turn}{f['line']}")
                below = _folded(children.get(f["place"], [])) if f["place"] is not None else []
                lead += {"": "", "├─ ": "│  ", "└─ ": "   "}[turn]
                todo += [(lead, "└─ " if k == len(below) - 1 else "├─ ", f["place"], x) for k, x in reversed(list(enumerate(below)))]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(range(len(ids)), pa.int64()), pa.array(lines, pa.string())], ["blob_id", "nth", "line"])


def _folded(siblings: list[dict], more_than: int = 4) -> list[dict]:
    """INT-10: siblings in order, those of one type as one line if they are many and don't stay expanded."""
    by_type: dict[str, list[dict]] = {}
    for f in siblings:
        if not f["stays"]:
            by_type.setdefault(f["type_"], []).append(f)
    many = {t: x for t, x in by_type.items() if len(x) > more_than}
    out, told = [], set()
    for f in siblings:
        if f["stays"] or f["type_"] not in many:
            out.append(f)
        elif f["type_"] not in told:
            told.add(f["type_"])
            group = many[f["type_"]]
            out.append({"place": None, "line": f"{f['type_']} ×{len(group)}, {sum(x['size_'] for x in group)} bytes"})
    return out


def tree(findings: DataFrame) -> DataFrame:
    """SNK-3: blob_id, nth and line: a blob's findings below the containers around them, with size, tier, label and tags."""
    w = Window.partitionBy("blob_id").orderBy(*intervals.total_order(), "category")
    placed = findings.select("blob_id", "offset_", "size_", "type_", "category", "confidence", "endian", "tier", "label").withColumn("place", F.row_number().over(w))
    nested = intervals.parents(placed).join(tags(findings), ["blob_id", "offset_", "type_"], "left")
    label = F.when(F.col("label") != "", F.concat(F.lit('  "'), "label", F.lit('"'))).otherwise(F.lit(""))
    line = F.concat(hex_offset(F.col("offset_")), F.lit("  "), human_size(F.col("size_")), F.lit("  "), "type_", F.lit("  "), "tier", label, F.coalesce(F.concat(F.lit("  "), "tags"), F.lit("")))
    stays = intervals.keep_expanded(F.col("type_"), F.col("category"))
    drawn = nested.groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct("place", "parent_place", "type_", "size_", stays.alias("stays"), line.alias("line")))).alias("findings"))
    return drawn.mapInArrow(_draw, "blob_id long, nth long, line string")


def extraction_tree(rows: DataFrame) -> DataFrame:
    """SNK-4: root_id, depth and line for each finding that was unpacked, in the order of levels: what came out, or why nothing did."""
    made = rows.where("type_ is not null").groupBy("root_id", "depth", "parent_id", "offset_", "type_", "status").agg(F.count_if(F.col("kind") == "file").alias("files"), F.sum(F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")).alias("bytes"))
    what = F.when(F.col("status") == "ok", F.concat(F.col("files").cast("string"), F.lit(" files, "), human_size(F.col("bytes")))).otherwise(F.col("status"))
    return made.select("root_id", "depth", F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), hex_offset(F.col("offset_")), F.lit("-"), "type_", F.lit(": "), what).alias("line"))


def tree_json(blobs: DataFrame, findings: DataFrame, root: str) -> DataFrame:
    """SNK-2: the lines of one JSON document: a head, a line a file in the order of paths, and a tail of totals: part, path, json.

    blobs: blob_id, path and content. Sorted by (part, path) and written one below the other they are the document.
    """
    docs = sinks.documents(blobs, findings).join(blobs.select("blob_id", "path"), "blob_id")
    least = blobs.orderBy("path").limit(1).select(F.col("path").alias("least"))
    files = docs.join(F.broadcast(least), docs["path"] == least["least"], "left").select(F.lit(1).alias("part"), "path", F.concat(F.when(F.col("least").isNull(), ",").otherwise(""), "json").alias("json"))
    known = blobs.select("blob_id", F.octet_length("content").cast("long").alias("length"))
    w = Window.partitionBy("blob_id").orderBy(*intervals.total_order(), "category")
    placed = findings.withColumn("place", F.row_number().over(w))
    primary = summaries.primary_types(known, placed)
    types = summaries.by_type(primary).agg(F.array_sort(F.collect_list(F.struct("place", "primary_type", "files"))).alias("t")).select(F.map_from_entries(F.transform("t", lambda x: F.struct(x["primary_type"], x["files"]))).alias("by_type"))
    hits = findings.where(F.col("category").isin(*summaries.NOTABLE)).join(blobs.select("blob_id", "path"), "blob_id")
    notes = hits.agg(F.array_sort(F.collect_list(F.struct("path", F.col("offset_").alias("offset"), F.col("type_").alias("type")))).alias("notable"))
    totals = summaries.totals(known, placed)
    one = F.lit(1).alias("one")
    tail = totals.select("*", one).join(summaries.tree_assessment(primary, placed).select("*", one), "one").join(types.select("*", one), "one").join(notes.select("*", one), "one")
    end = tail.select(F.lit(2).alias("part"), F.lit("").alias("path"), F.concat(F.lit("],"), F.substr(F.to_json(F.struct("file_count", "assessment", "by_type", "notable")), F.lit(2))).alias("json"))
    begin = json.dumps({"schema_version": sinks.SCHEMA_VERSION, "root": root})[:-1] + ', "files": ['
    head = blobs.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("").alias("path"), F.lit(begin).alias("json"))
    return head.unionByName(files).unionByName(end)


def write_files(rows: DataFrame, folder: str) -> int:
    """SNK-7: write unpacked files below a folder of the driver, root by root and level by level, as they stream in; how many.

    No part of a path is followed if it is a link, nothing outside the folder is touched, and links aren't made but written
    as text beside, with the ending ``.symlink``.
    """
    os.makedirs(folder, exist_ok=True)
    n = 0
    for r in rows.where("kind in ('file', 'symlink')").select("root_id", "depth", "offset_", "type_", "path", "kind", "content", "parent_id").toLocalIterator():
        name = r.path + (".symlink" if r.kind == "symlink" else "")
        parts = PurePosixPath(f"{r.root_id}/{r.depth}-{r.parent_id & 0xFFFFFFFF:08x}-0x{r.offset_:x}-{r.type_}/{name}").parts
        at = os.open(folder, os.O_RDONLY | os.O_DIRECTORY)
        try:
            for p in parts[:-1]:
                try:
                    os.mkdir(p, 0o755, dir_fd=at)
                except FileExistsError:
                    pass
                below = os.open(p, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=at)
                os.close(at)
                at = below
            with os.fdopen(os.open(parts[-1], os.O_WRONLY | os.O_CREAT | os.O_TRUNC | os.O_NOFOLLOW, 0o644, dir_fd=at), "wb") as f:
                f.write(r.content or b"")
            n += 1
        finally:
            os.close(at)
    return n
