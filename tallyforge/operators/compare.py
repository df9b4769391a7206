"""Comparison reports: one row for each path, manifest-only paths, zero-size records, duplicates, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import human_bytes, within
from .classify import Reconciled, move_sources

MOVED = ("POSSIBLE_MOVED_WITHIN_TOP_FOLDER", "AMBIGUOUS_POSSIBLE_MOVE")

#: The report that a status goes to; others go to 'ambiguous'.
ROUTES = {
    "MATCH": ("matches",),
    "MATCH_PATH_ONLY_SIZE_UNKNOWN": ("matches", "ambiguous"),
    "AMBIGUOUS_LTO_SIZE_UNKNOWN": ("matches", "ambiguous"),
    "SIZE_MISMATCH": ("size_mismatches",),
    "MISSING_ON_LTO": ("missing_on_lto",),
    "POSSIBLE_MOVED_WITHIN_TOP_FOLDER": ("possible_moved",),
    "ZERO_SIZE_STORAGE": ("zero_size",),
    "ZERO_SIZE_STORAGE_ONLY": ("zero_size",),
    "ZERO_SIZE_LTO_RECORD": ("zero_size",),
    "ZERO_SIZE_LTO_ONLY": (),
    "MISSING_ON_STORAGE": ("missing_on_storage",),
}


def missing_on_storage(done: Reconciled) -> DataFrame:
    """Manifest-only groups that no move accounts for, with status."""
    left = done.only.where("not consumed")
    return left.withColumn("status", F.when(F.col("zero_entries") == F.col("entries"), "ZERO_SIZE_LTO_ONLY").otherwise("MISSING_ON_STORAGE"))


def zero_records(done: Reconciled) -> DataFrame:
    """Extra rows for paths with zero-size manifest records, moved ones left out."""
    on = done.firsts.where("zero_entries > 0").select("norm_path", "zero_entries", F.lit(1).alias("on_storage"))
    off = missing_on_storage(done).where("zero_entries > 0").select("norm_path", "zero_entries", F.lit(0).alias("on_storage"))
    return on.unionByName(off)


def all_results(done: Reconciled) -> DataFrame:
    """status, relative_path, storage_root, storage_size_bytes, storage_size_human, lto_tapes, lto_reported_sizes of every path.

    ``done`` has texts.
    """
    # what a possible move refers to: all its compatible manifest paths, in path order
    first = done.firsts.withColumn("is_move", F.col("status").isin(*MOVED))
    sources = move_sources(done.only).select(
        F.col("norm_path").alias("from_path"), F.col("first.norm_top_folder").alias("norm_top_folder"), F.col("first.norm_filename").alias("norm_filename"),
        F.col("lo").alias("from_lo"), F.col("hi").alias("from_hi"), F.col("tapes").alias("from_tapes"), F.col("sizes").alias("from_sizes"),
    )
    moved = first.where("is_move").select("norm_path", "norm_top_folder", "norm_filename", "size_bytes", "status", "relative_path", "source_root")
    pairs = moved.join(sources, ["norm_top_folder", "norm_filename"]).where(within(F.col("size_bytes"), F.col("from_lo"), F.col("from_hi")))
    listed = F.array_sort(F.collect_list(F.struct("from_path", "from_tapes", "from_sizes")))
    pairs = pairs.groupBy("norm_path", "status", "relative_path", "source_root", "size_bytes").agg(listed.alias("f"))
    pairs = pairs.select("status", "relative_path", "source_root", "size_bytes", F.array_sort(F.array_distinct(F.flatten("f.from_tapes"))).alias("tapes"), F.flatten("f.from_sizes").alias("sizes"))
    direct = first.where("not is_move").select("status", "relative_path", "source_root", "size_bytes", "tapes", "sizes")
    rest = missing_on_storage(done).select("status", F.col("first.relative_path").alias("relative_path"), F.lit("").alias("source_root"), F.lit(None).cast("long").alias("size_bytes"), "tapes", "sizes")
    text = lambda c: F.coalesce(F.array_join(c, " | "), F.lit(""))
    return direct.unionByName(pairs).unionByName(rest).select(
        "status", "relative_path", F.col("source_root").alias("storage_root"), F.col("size_bytes").alias("storage_size_bytes"), F.coalesce(human_bytes(F.col("size_bytes")), F.lit("")).alias("storage_size_human"),
        text("tapes").alias("lto_tapes"), text("sizes").alias("lto_reported_sizes"),
    )


def copy_list(done: Reconciled) -> DataFrame:
    """Files to copy: first rows that are missing on tape, by root and path."""
    return done.firsts.where(F.col("status") == "MISSING_ON_LTO").select("source_root", "norm_path", "relative_path", "relative_path_bytes", "absolute_path", "size_bytes")


def summary(done: Reconciled, manifest: DataFrame) -> DataFrame:
    """(metric, value): paths by status and totals."""
    one = done.meeting.where("is_first or stored is null")
    count = lambda c: F.count_if(c)
    totals = one.agg(
        F.coalesce(F.sum("entries"), F.lit(0)).alias("LTO_MANIFEST_RECORDS"), count(F.col("entries") > 0).alias("LTO_UNIQUE_PATHS"), count(F.col("entries") > 1).alias("LTO_DUPLICATE_PATH_GROUPS"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("STORAGE_FILES"), F.count("stored").alias("STORAGE_UNIQUE_PATHS"), count(F.col("copies") > 1).alias("STORAGE_DUPLICATE_PATH_GROUPS"),
    )
    encoding = done.rows.agg(count(F.col("path_encoding_valid") == 0).alias("NON_UTF8_STORAGE_PATHS"))
    places = manifest.groupBy("tape", "norm_path").agg(F.count("*").alias("n")).agg(count(F.col("n") > 1).alias("DUPLICATE_MANIFEST_LOCATION_GROUPS"))
    missing = done.firsts.agg(count(F.col("status") == "MISSING_ON_LTO").alias("COPY_LIST_FILES"))
    zero = zero_records(done).select(F.lit("ZERO_SIZE_LTO_RECORD").alias("status"))
    status = done.firsts.select("status").unionByName(missing_on_storage(done).select("status")).unionByName(zero)
    out = status.groupBy(F.col("status").alias("metric")).agg(F.count("*").alias("value"))
    for part in (totals, encoding, places, missing):
        out = out.unionByName(part.unpivot([], part.columns, "metric", "value"))
    return out


def duplicate_paths(manifest: DataFrame) -> DataFrame:
    """Paths with several records. Records of one (path, interval) are summed first, so the counts of distinct values need no Expand."""
    spans = manifest.groupBy("norm_path", "size_min_bytes", "size_max_bytes").agg(F.count("*").alias("n"), F.min("relative_path").alias("p"), F.collect_set("tape").alias("t"))
    tapes = F.array_sort(F.array_distinct(F.flatten(F.collect_list("t"))))
    g = spans.groupBy("norm_path").agg(F.min("p").alias("example_relative_path"), F.sum("n").alias("manifest_records"), tapes.alias("t"), F.count("*").alias("distinct_size_ranges")).where("manifest_records > 1")
    return g.select("norm_path", "example_relative_path", "manifest_records", F.size("t").cast("long").alias("tape_count"), F.array_join(F.array_remove("t", ""), " | ").alias("tapes"), "distinct_size_ranges")


def duplicate_locations(manifest: DataFrame) -> DataFrame:
    key = ["tape", "norm_path"]
    spans = manifest.groupBy(*key, "size_min_bytes", "size_max_bytes").agg(F.count("*").alias("n"), F.min("relative_path").alias("p"), F.collect_set("source_pdf").alias("s"))
    pdfs = F.array_join(F.array_sort(F.array_distinct(F.array_remove(F.flatten(F.collect_list("s")), ""))), " | ")
    return spans.groupBy(*key).agg(F.min("p").alias("example_relative_path"), F.sum("n").alias("records"), pdfs.alias("source_pdfs"), F.count("*").alias("distinct_size_ranges")).where("records > 1")


def duplicate_storage(storage: DataFrame) -> DataFrame:
    sizes = storage.groupBy("norm_path", "size_bytes").agg(F.count("*").alias("n"), F.min("relative_path").alias("p"), F.collect_set("source_root").alias("r"), F.collect_list("absolute_path").alias("a"))
    joined = lambda c: F.array_join(F.array_sort(c), " | ")
    roots, paths = joined(F.array_distinct(F.flatten(F.collect_list("r")))), joined(F.flatten(F.collect_list("a")))
    g = sizes.groupBy("norm_path").agg(F.min("p").alias("example_relative_path"), F.sum("n").alias("copies"), roots.alias("source_roots"), paths.alias("absolute_paths"), F.count("size_bytes").alias("distinct_sizes"))
    return g.where("copies > 1")
