"""Filesystem inventories: a metadata-only walk, one task for each folder of the second level."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import fold, raw_display, raw_key

FOUND = "source_root string, relative_path_bytes binary, size_bytes long, mtime_ns long, issue_path binary, issue_type string"


def walk(root: bytes, below: bytes) -> Iterator[tuple]:
    """(relative, size, mtime, issue path, issue) in a fixed order; dot names, links and special files are left out, links and specials as issues."""
    todo = [below]
    while todo:
        folder = todo.pop()
        try:
            with os.scandir(os.path.join(root, folder) if folder else root) as found:
                items = sorted(found, key=lambda e: e.name)
        except OSError as e:
            yield None, None, None, folder, f"directory_read_error:{e.__class__.__name__}"
            continue
        inner = []
        for e in items:
            rel = os.path.join(folder, e.name) if folder else e.name
            if e.name.startswith(b"."):
                continue
            try:
                s = e.stat(follow_symlinks=False)
            except OSError as x:
                yield None, None, None, rel, f"file_stat_error:{x.__class__.__name__}"
                continue
            if stat.S_ISLNK(s.st_mode):
                yield None, None, None, rel, "symlink_skipped"
            elif stat.S_ISDIR(s.st_mode):
                inner.append(rel)
            elif stat.S_ISREG(s.st_mode):
                yield rel, s.st_size, s.st_mtime_ns, None, None
            else:
                yield None, None, None, rel, "special_file_skipped"
        todo += reversed(inner)


CHUNK = 5_000  # files that a task holds before it hands them on
COLUMNS = ["source_root", "relative_path_bytes", "size_bytes", "mtime_ns", "issue_path", "issue_type"]


def first_levels(root: bytes, below: bytes, levels: int) -> Iterator[tuple]:
    """Like ``walk``, but folders ``levels`` down are not entered: they come as rows whose issue is None and whose size is None."""
    folder = os.path.join(root, below) if below else root
    try:
        with os.scandir(folder) as found:
            items = sorted(found, key=lambda e: e.name)
    except OSError as e:
        yield None, None, None, below, f"directory_read_error:{e.__class__.__name__}"
        return
    for e in items:
        if e.name.startswith(b"."):
            continue
        rel = os.path.join(below, e.name) if below else e.name
        try:
            s = e.stat(follow_symlinks=False)
        except OSError as x:
            yield None, None, None, rel, f"file_stat_error:{x.__class__.__name__}"
            continue
        if stat.S_ISDIR(s.st_mode):
            if levels > 1:
                yield from first_levels(root, rel, levels - 1)
            else:
                yield rel, None, None, None, None
        elif stat.S_ISREG(s.st_mode):
            yield rel, s.st_size, s.st_mtime_ns, None, None
        else:
            yield None, None, None, rel, "symlink_skipped" if stat.S_ISLNK(s.st_mode) else "special_file_skipped"


def scan(spark: SparkSession, roots: list[str], below: dict[str, list[bytes]] | None = None) -> DataFrame:
    """Found files and issues of roots that every executor mounts.

    ``below`` restricts a root to some of its top folders. The driver lists two levels; each
    folder there is a task, so one large top folder spreads. Rows leave a task in chunks.
    """
    starts = [(root, top) for root in roots for top in ((below or {}).get(root) or [b""])]
    tasks, near = [], []
    for root, top in starts:
        for row in first_levels(os.fsencode(root), top, 1 if top else 2):
            if row[0] is not None and row[1] is None:
                tasks.append((root, row[0]))
            else:
                near.append((root, *row))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for root, folder in zip(pdf["root"], pdf["folder"], strict=True):
                rows = walk(os.fsencode(root), bytes(folder))
                while chunk := list(islice(rows, CHUNK)):
                    yield pd.DataFrame([(root, *r) for r in chunk], columns=COLUMNS).astype({"size_bytes": "Int64", "mtime_ns": "Int64"})

    first = spark.createDataFrame(near, FOUND)
    if not tasks:
        return first
    far = spark.createDataFrame(tasks, "root string, folder binary").repartition(len(tasks)).mapInPandas(run, FOUND)
    return first.unionByName(far)


def inventory(found: DataFrame, logical_tops: dict[tuple[str, bytes], str] | None = None, ascii_only: bool = False) -> DataFrame:
    """Storage rows of found files. ``logical_tops`` renames top folders, by (root, raw name), in the keys, never in the raw bytes."""
    raw = F.col("relative_path_bytes")
    text, valid = raw.cast("string"), F.is_valid_utf8(raw.cast("string"))
    key = raw_key(raw, ascii_only)
    if logical_tops:  # the driver's own list, a row for each mapped folder
        names = [(root, top, logical) for (root, top), logical in logical_tops.items()]
        names = found.sparkSession.createDataFrame(names, "source_root string, _top binary, _logical string")
        found = found.withColumn("_top", F.substring_index(text, "/", 1).cast("binary")).join(F.broadcast(names), ["source_root", "_top"], "left")
        renamed = F.concat(F.col("_logical"), F.substring(text, F.length(F.substring_index(text, "/", 1)) + 1, F.length(text)))
        key = raw_key(F.when(valid & F.col("_logical").isNotNull(), renamed.cast("binary")).otherwise(raw), ascii_only)
    rows = found.where("relative_path_bytes is not null").withColumns({"norm_path": key, "relative_path": raw_display(raw), "path_encoding_valid": valid.cast("int")})
    top, name = F.substring_index("relative_path", "/", 1), F.substring_index("relative_path", "/", -1)
    return rows.select(
        "source_root", F.concat_ws("/", "source_root", "relative_path").alias("absolute_path"), "relative_path", "relative_path_bytes", "norm_path", top.alias("top_folder"), F.substring_index("norm_path", "/", 1).alias("norm_top_folder"),
        name.alias("filename"), fold(name, ascii_only).alias("norm_filename"), "path_encoding_valid", "size_bytes", "mtime_ns",
    )


def issues(found: DataFrame) -> DataFrame:
    """Scan issues, with one for each name that is not UTF-8."""
    shown = raw_display(F.col("issue_path"))
    own = found.where("issue_type is not null").select("source_root", F.concat_ws("/", "source_root", shown).alias("path"), "issue_type", F.lit("").alias("details"))
    raw = F.col("relative_path_bytes")
    odd = found.where(raw.isNotNull() & ~F.is_valid_utf8(raw.cast("string"))).select("source_root", F.concat_ws("/", "source_root", raw_display(raw)).alias("path"), F.lit("non_utf8_filesystem_name").alias("issue_type"), F.lit("").alias("details"))
    return own.unionByName(odd)
