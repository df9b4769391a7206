"""Comparison of a historical catalog with one report, by folder."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import sorted_join


def ancestors(path: Column) -> Column:
    """All proper folder prefixes of a path: an equi-join on them replaces a prefix join."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def default_folders(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.element_at(F.split("path", "/"), 1).alias("folder")).distinct()


def select_folders(catalog: DataFrame, folders: list[str]) -> DataFrame:
    """The named folders, or all first parts of catalog paths; a name that is empty, climbs, or has no catalog path is an error."""
    if not folders:
        return default_folders(catalog)
    names = sorted({"/".join(p for p in f.replace("\\", "/").split("/") if p not in ("", ".")) for f in folders})
    names = sorted({unicodedata.normalize("NFC", f).casefold() for f in names})
    wrong = [f for f in names if not f or ".." in f.split("/")]
    if wrong:
        raise ValueError("a folder must be a relative catalog prefix without '..'")
    chosen = catalog.sparkSession.createDataFrame([(f,) for f in names], "folder string")
    below = catalog.select(F.explode(ancestors(F.col("path"))).alias("folder")).distinct()
    unknown = chosen.join(below, "folder", "left_anti").orderBy("folder").limit(1).collect()
    if unknown:
        raise ValueError(f"folder not found in the catalog: {unknown[0]['folder']}")
    return chosen


#: Notes of a folder's summary.
UNKNOWN_NOTE = "Presence only; unknown sizes require review"
REPORT_NOTE = "Report diagnostics are global informational metadata; not localized to this folder"


def with_report(summary: DataFrame, stats: DataFrame) -> DataFrame:
    """Folder summaries with report_parse_issues, report_count_mismatches and notes of the one report whose stats these are."""
    counts = stats.agg(F.coalesce(F.sum("issues"), F.lit(0)).alias("report_parse_issues"), F.count_if(F.coalesce("difference", F.lit(0)) != 0).alias("report_count_mismatches"))
    df = summary.join(F.broadcast(counts), F.lit(True))  # one row
    odd = (F.col("report_parse_issues") > 0) | (F.col("report_count_mismatches") > 0)
    notes = F.array(F.when(F.col("size_unknown") > 0, UNKNOWN_NOTE), F.when(odd, REPORT_NOTE))
    return df.withColumn("notes", F.array_join(F.array_compact(notes), "; "))


def path_status(catalog: DataFrame, observed: DataFrame) -> DataFrame:
    """(path, status, notes) for each catalog path.

    catalog: (path, cassette_norm, size_bytes, filename_raw, path_norm, ...); observed: one
    report's entries with ``tape_norm``. Both sides are grouped by path before they meet.
    """
    has_tape = F.col("cassette_norm").isNotNull() & (F.col("cassette_norm") != "")
    unsafe = F.col("filename_raw").isNull() | (F.col("filename_raw") == "") | ~has_tape | F.array_contains(F.split("path_norm", "/"), "..")
    want = catalog.groupBy("path").agg(F.countDistinct("size_bytes").alias("sizes"), F.min("size_bytes").alias("size"), F.count_if(F.col("size_bytes").isNull()).alias("no_size"), F.count_if(unsafe).alias("unsafe"))
    known = F.col("size_known") == 1
    seen = observed.groupBy("norm_path").agg(
        F.count("*").alias("seen"), F.countDistinct(F.when(known, F.struct("size_min_bytes", "size_max_bytes"))).alias("ranges"), F.max(F.when(known, F.col("size_min_bytes"))).alias("lo"), F.min(F.when(known, F.col("size_max_bytes"))).alias("hi"),
    )
    tapes = catalog.where(has_tape).select("path", F.col("cassette_norm").alias("tape_norm")).distinct()
    hits = observed.join(tapes, (observed["norm_path"] == tapes["path"]) & (observed["tape_norm"] == tapes["tape_norm"]), "left_semi").groupBy(F.col("norm_path").alias("path")).agg(F.count("*").alias("matches"), F.count_if(F.col("size_known") == 0).alias("unsized"))
    df = want.join(seen.withColumnRenamed("norm_path", "path"), "path", "left").join(hits, "path", "left")
    c = F.col
    status = (
        F.when((c("sizes") > 1) | (c("ranges") > 1), "SIZE_CONFLICT").when(c("unsafe") > 0, "CONFLICT").when(c("seen").isNull(), "MISSING_ON_REPORT").when(c("matches").isNull(), "CASSETTE_CONFLICT")
        .when((c("sizes") > 0) & (c("ranges") > 0) & ~c("size").between(c("lo"), c("hi")), "SIZE_CONFLICT").when((c("sizes") == 0) | (c("no_size") > 0) | (c("unsized") > 0), "PATH_MATCH_SIZE_UNKNOWN").otherwise("EXACT")
    )
    #: Notes of a file's status.
    notes = F.when((c("sizes") > 1) | (c("ranges") > 1), "Conflicting duplicate sizes/intervals; manual review").when(c("status") == "CONFLICT", "Incomplete or unsafe catalog identity; manual review").when(c("status") == "CASSETTE_CONFLICT", "Same full path only on unexpected cassette").otherwise("")
    return df.withColumn("status", status).select("path", "status", notes.alias("notes"))


def unexpected(catalog: DataFrame, observed: DataFrame, folders: DataFrame) -> DataFrame:
    """Observed entries below a folder, on one of its tapes, that its catalog does not list; with folder."""
    below = observed.withColumn("folder", F.explode(ancestors(F.col("norm_path")))).join(folders, "folder", "left_semi")
    listed = catalog.select("path").distinct().withColumnRenamed("path", "norm_path")
    tapes = catalog.where("cassette_norm <> ''").withColumn("folder", F.explode(ancestors(F.col("path")))).select("folder", F.col("cassette_norm").alias("tape_norm")).distinct()
    return below.join(listed, "norm_path", "left_anti").join(tapes, ["folder", "tape_norm"], "left_semi")


def file_details(catalog: DataFrame, observed: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """A row for each folder, catalog row and observed copy, and one for each unexpected entry."""
    folders = default_folders(catalog) if folders is None else folders
    inside = catalog.withColumn("folder", F.explode(ancestors(F.col("path")))).join(folders, "folder", "left_semi")
    copies = observed.select(F.col("norm_path").alias("path"), F.col("tape").alias("observed_cassette"), "size_min_bytes", "size_max_bytes", "entry_id")
    cols = ("status", "folder", "catalog_cassette", "observed_cassette", "path", "catalog_size", "size_min_bytes", "size_max_bytes", "notes", "entry_id")
    rows = inside.join(path_status(catalog, observed), "path").join(copies, "path", "left").withColumns({"catalog_cassette": F.col("cassette_raw"), "catalog_size": F.col("size_bytes"), "observed_cassette": F.coalesce("observed_cassette", F.lit(""))}).select(*cols)
    more = unexpected(catalog, observed, folders).select(
        F.lit("UNEXPECTED_ON_REPORT").alias("status"), "folder", F.lit("").alias("catalog_cassette"), F.col("tape").alias("observed_cassette"), F.col("norm_path").alias("path"), F.lit(None).cast("long").alias("catalog_size"),
        "size_min_bytes", "size_max_bytes", F.lit("Within exact folder prefix and expected cassette scope").alias("notes"), "entry_id",
    )
    return rows.unionByName(more)


def folder_summary(catalog: DataFrame, observed: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Counts of paths by status, presence and size status of each folder."""
    folders = default_folders(catalog) if folders is None else folders
    inside = catalog.withColumn("folder", F.explode(ancestors(F.col("path")))).join(folders, "folder", "left_semi")
    status = inside.select("folder", "path").distinct().join(path_status(catalog, observed), "path")
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    counts = status.groupBy("folder").agg(
        F.count("*").alias("expected"), is_("EXACT", "PATH_MATCH_SIZE_UNKNOWN").alias("found"), is_("MISSING_ON_REPORT").alias("missing"), is_("SIZE_CONFLICT", "CONFLICT", "CASSETTE_CONFLICT").alias("conflicts"),
        is_("PATH_MATCH_SIZE_UNKNOWN").alias("size_unknown"), is_("EXACT").alias("size_verified"), is_("SIZE_CONFLICT").alias("size_conflicts"),
    )
    extra = unexpected(catalog, observed, folders)
    odd = extra.groupBy("folder").agg(F.countDistinct("norm_path").alias("unexpected"))
    seen = inside.select("folder", "path").distinct().join(observed.select(F.col("norm_path").alias("path"), "tape"), "path").select("folder", "tape").unionByName(extra.select("folder", "tape"))
    seen = seen.groupBy("folder").agg(sorted_join(F.col("tape")).alias("observed_labels"))
    labels = inside.groupBy("folder").agg(sorted_join(F.col("cassette_raw")).alias("expected_labels"))
    df = counts.join(odd, "folder", "left").join(seen, "folder", "left").join(labels, "folder").withColumns({"unexpected": F.coalesce("unexpected", F.lit(0)), "observed_labels": F.coalesce("observed_labels", F.lit(""))})
    c = F.col
    presence = F.when(c("conflicts") > 0, "CONFLICT").when(c("observed_labels") == "", "NOT_FOUND").when((c("missing") > 0) | (c("unexpected") > 0), "INCOMPLETE").otherwise("COMPLETE")
    size = F.when(c("size_conflicts") > 0, "CONFLICT").when(c("size_verified") > 0, F.when(c("size_unknown") > 0, "PARTIAL").otherwise("VERIFIED")).otherwise("UNKNOWN")
    return df.select("folder", "expected", "found", "missing", "conflicts", "unexpected", "size_unknown", "size_verified", "expected_labels", "observed_labels", presence.alias("presence_status"), size.alias("size_status"))
