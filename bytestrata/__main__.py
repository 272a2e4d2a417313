"""``python -m bytestrata [--json] [--all] [--extract FOLDER] PATH``: identify a file or folder on a local session.

Exits with 0 if something was found, 1 if nothing was, 2 if the path can't be read (SNK-8).
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import extract, identify, reports
from .sources import blobs, catalog


def documents() -> list[str]:
    """The texts of the signatures: those of a folder that was set up, or the packaged ones."""
    root = catalog.find_root()
    files = sorted(root.glob("*.toml")) if root else [catalog.HERE / n for n in ("curated.toml", "vendor.toml")]
    return [f.read_text() for f in files]


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="bytestrata")
    parser.add_argument("path")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--all", action="store_true")
    parser.add_argument("--extract", metavar="FOLDER")
    try:
        asked = parser.parse_args(arguments)
    except SystemExit as e:
        return 2 if e.code else 0
    if not os.access(asked.path, os.R_OK):
        print(f"can't read {asked.path}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    files, texts = blobs.from_files(spark, asked.path), documents()
    found = identify.identify(files, texts, asked.all)
    n = found.count()
    if asked.json:
        rows = reports.tree_json(files, found, asked.path).orderBy("part", "path").select("json")
    else:
        rows = reports.tree(found).join(files.select("blob_id", "path"), "blob_id").orderBy("path", "nth").select(F.concat("path", F.lit("  "), "line"))
    for (line,) in rows.toLocalIterator():
        print(line)
    if asked.extract:
        print(f"{reports.write_files(extract.extract(files, texts), asked.extract)} files in {asked.extract}")
    return 0 if n else 1


if __name__ == "__main__":
    sys.exit(main())
