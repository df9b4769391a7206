"""Classification of storage rows against a manifest.

Both sides meet once, in a full outer join on ``norm_path`` whose manifest side has one row for
each path and cannot fan out; its result is kept, and statuses, moves, manifest-only paths,
reports and folder roll-ups are read from it. Possible moves are counted between distinct sizes
and distinct intervals of a (top folder, file name), not between files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import within
from ..lineage import saved

PENDING = "PENDING"
KEY = ["norm_top_folder", "norm_filename"]


def range_text() -> Column:
    shown = F.concat(F.col("tape"), F.lit(":"), F.col("reported_size"), F.lit("["), F.col("size_min_bytes").cast("string"), F.lit("-"), F.col("size_max_bytes").cast("string"), F.lit("]"))
    return F.when(F.col("size_known") == 1, shown).otherwise(F.concat(F.col("tape"), F.lit(":SIZE_UNKNOWN")))


def all_tapes(lists: str) -> Column:
    """Aggregate: the distinct tapes of several lists, sorted. Labels are a closed list, so few lists differ."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(lists))))


def manifest_groups(manifest: DataFrame, texts: bool = False) -> DataFrame:
    """One row for each manifest path.

    Counts, the single known interval (lo, hi), duplicate kind, additional identical tape copies,
    the sorted tapes and the first entry's keys; with ``texts`` also the shown intervals in entry
    order. Entries of one path and interval are first summed by themselves, so no count
    of distinct values multiplies the rows.
    """
    interval = ["norm_path", "size_known", "size_min_bytes", "size_max_bytes"]
    keys = F.struct("norm_top_folder", "norm_filename", "top_folder", "relative_path")
    more = [F.collect_list(F.struct("entry_id", range_text().alias("t"))).alias("shown")] if texts else []
    spans = manifest.groupBy(*interval).agg(
        F.count("*").alias("n"), F.min("entry_id").alias("id"), F.min_by(keys, "entry_id").alias("keys"),
        F.collect_set("tape").alias("tapes"), *more,  # tapes: a closed list of labels
    )
    known = F.col("size_known") == 1
    zero = known & (F.col("size_min_bytes") == 0) & (F.col("size_max_bytes") == 0)
    total = lambda c, v: F.sum(F.when(c, v).otherwise(0)).cast("long")
    more = [F.transform(F.array_sort(F.flatten(F.collect_list("shown"))), lambda x: x["t"]).alias("sizes")] if texts else []
    g = spans.groupBy("norm_path").agg(
        F.sum("n").alias("entries"),
        total(known, F.col("n")).alias("known"),
        total(~known, F.col("n")).alias("unknown"),
        F.count_if(known).alias("ranges"),
        F.min(F.when(known, F.col("size_min_bytes"))).alias("lo"),
        F.max(F.when(known, F.col("size_max_bytes"))).alias("hi"),
        total(zero, F.col("n")).alias("zero_entries"),
        total(known, F.size("tapes") - 1).alias("extra"),
        F.min_by("keys", "id").alias("first"),
        all_tapes("tapes").alias("tapes"),
        *more,
    )
    kind = F.when(F.col("entries") <= 1, "none").when(F.col("ranges") > 1, "conflicting_known_intervals").when(F.col("unknown") > 0, "contains_unknown_size").otherwise("identical")
    return g.withColumn("lto_duplicate_kind", kind)


def _storage_kind(copies: Column, one_size: Column) -> Column:
    return F.when(copies <= 1, "none").when(one_size, "identical").otherwise("different_sizes")


def storage_groups(storage: DataFrame) -> DataFrame:
    g = storage.groupBy("norm_path", "size_bytes").agg(F.count("*").alias("n")).groupBy("norm_path").agg(F.sum("n").alias("copies"), F.count("size_bytes").alias("sizes"))
    return g.withColumn("storage_duplicate_kind", _storage_kind(F.col("copies"), F.col("sizes") == 1))


def with_copies(storage: DataFrame) -> DataFrame:
    """Storage rows with copies, storage_duplicate_kind and is_first of their path.

    The first row is that of the smallest lower-cased root, then raw path. A path has at most
    one row for each root, and the join on the path needs the same partitioning.
    """
    own = Window.partitionBy("norm_path")
    order = own.orderBy(F.lower("source_root"), "relative_path_bytes", "source_root")
    one_size = F.min("size_bytes").over(own) == F.max("size_bytes").over(own)
    rows = storage.withColumns({"copies": F.count("*").over(own), "is_first": F.row_number().over(order) == 1})
    return rows.withColumn("storage_duplicate_kind", _storage_kind(F.col("copies"), one_size))


def _direct_status() -> Column:
    c = F.col
    return (
        F.when(c("path_encoding_valid") == 0, "INVALID_FILESYSTEM_ENCODING")
        .when(c("storage_duplicate_kind") == "different_sizes", "AMBIGUOUS_STORAGE_DUPLICATE_SIZES")
        .when(c("size_bytes") == 0, F.when(c("entries") > 0, "ZERO_SIZE_STORAGE").otherwise("ZERO_SIZE_STORAGE_ONLY"))
        .when(c("entries") == 0, PENDING)
        .when(c("ranges") > 1, "CONFLICTING_LTO_ENTRIES")
        .when((c("known") > 0) & (c("unknown") > 0), "AMBIGUOUS_LTO_SIZE_UNKNOWN")
        .when(c("known") == 0, "MATCH_PATH_ONLY_SIZE_UNKNOWN")
        .when(within(c("size_bytes"), c("lo"), c("hi")), "MATCH")
        .otherwise("SIZE_MISMATCH")
    )


def size_matches(manifest: DataFrame, storage: DataFrame) -> DataFrame:
    """(norm_path, size_bytes, tape, lo, hi): every storage row with every entry of its path whose interval holds its size."""
    entries = manifest.select("norm_path", "tape", F.col("size_min_bytes").alias("lo"), F.col("size_max_bytes").alias("hi"))
    return storage.select("norm_path", "size_bytes").join(entries, "norm_path").where(within(F.col("size_bytes"), F.col("lo"), F.col("hi")))


@dataclass
class Reconciled:
    """What a manifest and an inventory say of each other.

    rows: every storage row with status, verified, duplicate kinds, moved_from and its path's
    manifest counts; only: manifest paths that storage lacks, with consumed (a possible move of
    a first row accounts for them); meeting: the full outer join that both come from.
    """

    rows: DataFrame
    only: DataFrame
    meeting: DataFrame

    @property
    def firsts(self) -> DataFrame:
        """The first storage row of each path."""
        return self.rows.where("is_first")


COUNTS = ("entries", "known", "unknown", "ranges", "zero_entries", "extra")


def move_pairs(pending: DataFrame, candidates: DataFrame) -> DataFrame:
    """(top folder, file name, size, interval) with the counts of both sides, for sizes within the interval.

    pending: storage rows without a manifest path; candidates: manifest-only groups with one
    known interval. Pairs are made between distinct sizes and intervals only.
    """
    paths = pending.groupBy(*KEY, "size_bytes", "norm_path").agg(F.max("is_first").alias("is_first"))
    sizes = paths.groupBy(*KEY, "size_bytes").agg(F.count("*").alias("paths"), F.max("is_first").alias("has_first"))
    spans = candidates.groupBy(F.col("first.norm_top_folder").alias(KEY[0]), F.col("first.norm_filename").alias(KEY[1]), "lo", "hi")
    spans = spans.agg(F.count("*").alias("n"), F.sum("entries").alias("e"), F.min("norm_path").alias("one_path"), all_tapes("tapes").alias("tapes"))
    pairs = sizes.join(spans, KEY).where(within(F.col("size_bytes"), F.col("lo"), F.col("hi")))
    return pairs.withColumn("claimed", F.sum("paths").over(Window.partitionBy(*KEY, "lo", "hi")))


def move_sources(only: DataFrame) -> DataFrame:
    return only.where((F.col("ranges") == 1) & (F.col("unknown") == 0))


def reconcile(manifest: DataFrame, storage: DataFrame, moved_check: bool = True, texts: bool = False) -> Reconciled:
    """Storage rows classified against the manifest, and the manifest paths that storage lacks.

    matched_entries and matched_tapes are those of the row's path, or of the paths that it may
    have moved from. With ``texts`` rows and manifest-only paths also carry the shown intervals.
    """
    both = with_copies(storage).withColumn("stored", F.lit(True)).join(manifest_groups(manifest, texts), "norm_path", "full")
    both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in COUNTS})
    both = both.withColumn("lto_duplicate_kind", F.coalesce("lto_duplicate_kind", F.lit("none")))
    meeting = saved(both.withColumn("status", F.when(F.col("stored"), _direct_status())))
    rows = meeting.where("stored").drop("stored")
    rows = rows.withColumns({"matched_entries": F.col("entries"), "matched_tapes": F.col("tapes")})
    only = meeting.where("stored is null").select("norm_path", *COUNTS, "lo", "hi", "first", "lto_duplicate_kind", "tapes", *(("sizes",) if texts else ()))
    direct, pending = rows.where(F.col("status") != PENDING), rows.where(F.col("status") == PENDING)
    if moved_check:
        pairs = saved(move_pairs(pending, move_sources(only)))
        by_size = pairs.groupBy(*KEY, "size_bytes").agg(
            F.sum("n").alias("move_candidates"), F.sum("e").alias("move_entries"), F.count("*").alias("move_ranges"),
            (F.max("claimed") > 1).alias("many_to_one"), F.min("one_path").alias("from_path"), all_tapes("tapes").alias("move_tapes"),
        )
        pending = pending.join(by_size, [*KEY, "size_bytes"], "left")
        found, one = F.col("move_candidates"), (F.col("move_candidates") == 1) & ~F.col("many_to_one")
        status = F.when(found.isNull(), "MISSING_ON_LTO").when(one, "POSSIBLE_MOVED_WITHIN_TOP_FOLDER").otherwise("AMBIGUOUS_POSSIBLE_MOVE")
        # a moved row's entries are those of its candidates
        kind = F.when(found.isNull(), F.col("lto_duplicate_kind")).when(F.col("move_entries") <= 1, "none").when(F.col("move_ranges") > 1, "conflicting_known_intervals").otherwise("identical")
        pending = pending.withColumns({"status": status, "lto_duplicate_kind": kind, "moved_from": F.when(one, F.col("from_path"))})
        pending = pending.withColumns({"matched_entries": F.coalesce("move_entries", "matched_entries"), "matched_tapes": F.coalesce("move_tapes", "matched_tapes")})
        pending = pending.drop("move_candidates", "move_entries", "move_ranges", "many_to_one", "from_path", "move_tapes")
        spans = pairs.where("has_first").select(F.col(KEY[0]).alias("t"), F.col(KEY[1]).alias("f"), F.col("lo").alias("l"), F.col("hi").alias("h"), F.lit(True).alias("consumed")).distinct()
        single = (F.col("ranges") == 1) & (F.col("unknown") == 0)
        same = single & (F.col("first.norm_top_folder") == F.col("t")) & (F.col("first.norm_filename") == F.col("f")) & (F.col("lo") == F.col("l")) & (F.col("hi") == F.col("h"))
        only = only.join(spans, same, "left").drop("t", "f", "l", "h").withColumn("consumed", F.coalesce("consumed", F.lit(False)))
    else:
        pending = pending.withColumns({"status": F.lit("MISSING_ON_LTO"), "moved_from": F.lit(None).cast("string")})
        only = only.withColumn("consumed", F.lit(False))
    rows = direct.withColumn("moved_from", F.lit(None).cast("string")).unionByName(pending)
    verified = (F.col("status") == "MATCH") & (F.col("size_bytes") > 0) & (F.col("path_encoding_valid") == 1)
    return Reconciled(rows.withColumn("verified", verified), only, meeting)


def classify(manifest: DataFrame, storage: DataFrame, moved_check: bool = True) -> DataFrame:
    """Every storage row with status, verified, duplicate kinds, moved_from, lo and hi."""
    return reconcile(manifest, storage, moved_check).rows


#: The reason that a status gives for not deleting.
STATUS_REASON = {
    "MISSING_ON_LTO": "MISSING_ON_LTO",
    "SIZE_MISMATCH": "SIZE_MISMATCH",
    "ZERO_SIZE_STORAGE": "ZERO_SIZE",
    "ZERO_SIZE_STORAGE_ONLY": "ZERO_SIZE",
    "MATCH_PATH_ONLY_SIZE_UNKNOWN": "UNKNOWN_LTO_SIZE",
    "AMBIGUOUS_LTO_SIZE_UNKNOWN": "UNKNOWN_LTO_SIZE",
    "POSSIBLE_MOVED_WITHIN_TOP_FOLDER": "POSSIBLE_MOVED",
    "AMBIGUOUS_POSSIBLE_MOVE": "AMBIGUOUS_MATCH",
    "INVALID_FILESYSTEM_ENCODING": "INVALID_FILESYSTEM_ENCODING",
    "CONFLICTING_LTO_ENTRIES": "CONFLICTING_LTO_ENTRIES",
    "AMBIGUOUS_STORAGE_DUPLICATE_SIZES": "DUPLICATE_ON_STORAGE_DIFFERENT_SIZES",
    "ZERO_SIZE_LTO_RECORD": "ZERO_SIZE_LTO_RECORD",
}


def blocking_reasons() -> Column:
    """Ordered distinct reasons of a classified row: the status's first, then those of its facts."""
    by_status = F.lit(None).cast("string")
    for status, reason in STATUS_REASON.items():
        by_status = F.when(F.col("status") == status, reason).otherwise(by_status)
    facts = [
        F.when(F.col("size_bytes") == 0, "ZERO_SIZE"),
        F.when((F.col("lto_duplicate_kind") == "conflicting_known_intervals"), "CONFLICTING_LTO_ENTRIES"),
        F.when((F.col("lto_duplicate_kind") == "contains_unknown_size"), "UNKNOWN_LTO_SIZE"),
        F.when(F.col("storage_duplicate_kind") == "different_sizes", "DUPLICATE_ON_STORAGE_DIFFERENT_SIZES"),
    ]
    return F.array_distinct(F.array_compact(F.array(by_status, *facts)))
