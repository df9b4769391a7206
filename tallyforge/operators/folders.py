"""Folder roll-ups: size totals, the strict decision and the operator verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import human_bytes, signed_human_bytes, tolerant
from ..lineage import saved
from .classify import STATUS_REASON, Reconciled, all_tapes, blocking_reasons

FOLDER = ["source_root", "top_raw"]
TOTALS = ("path_count", "known_size_count", "unknown_size_count", "conflicting_size_path_count", "additional_identical_tape_copy_count", "total_min_bytes", "total_max_bytes")
#: The order in which the operator verdict lists reasons.
REASON_ORDER = ("NO_LTO_FOLDER", "UNKNOWN_LTO_SIZE", "CONFLICTING_LTO_ENTRIES", "STORAGE_ONLY_PATH", "LTO_ONLY_PATH", "SIZE_MISMATCH", "AMBIGUOUS_PATH", "FILE_COUNT_MISMATCH", "SIZE_OUTSIDE_TOLERANCE", "ZERO_SIZE_FILE", "SCAN_INCOMPLETE", "INVALID_FILESYSTEM_ENCODING")
AMBIGUOUS = ("POSSIBLE_MOVED_WITHIN_TOP_FOLDER", "AMBIGUOUS_POSSIBLE_MOVE", "AMBIGUOUS_LTO_SIZE_UNKNOWN", "AMBIGUOUS_STORAGE_DUPLICATE_SIZES")
VERDICTS = ("YES", "YES_WITH_UNKNOWN_SIZE", "YES_WITH_FILE_WARNINGS", "NO")


def top_raw(path_bytes: Column) -> Column:
    """Raw bytes before the first '/'."""
    return F.substring_index(path_bytes.cast("string"), "/", 1).cast("binary")


def path_totals(groups: DataFrame) -> DataFrame:
    """One contribution for each manifest path: identical intervals once, conflicts and unknown sizes without bytes.

    ``groups`` has the columns of ``manifest_groups``, on one row for each path or on storage rows.
    """
    one = F.col("ranges") == 1
    return groups.withColumns({
        "t_known": one.cast("long"), "t_unknown": (F.col("unknown") > 0).cast("long"), "t_conflict": (F.col("ranges") > 1).cast("long"), "t_extra": F.col("extra"),
        "t_lo": F.when(one, F.col("lo")).otherwise(0), "t_hi": F.when(one, F.col("hi")).otherwise(0),
    })


PARTS = ("t_known", "t_unknown", "t_conflict", "t_extra", "t_lo", "t_hi")


def manifest_totals(groups: DataFrame) -> DataFrame:
    """Sums of all manifest paths by top folder."""
    sums = [F.count("*"), *[F.sum(c) for c in PARTS]]
    return path_totals(groups).groupBy(F.col("first.norm_top_folder").alias("norm_top_folder")).agg(*[c.cast("long").alias(n) for c, n in zip(sums, TOTALS, strict=True)])


def interval_result(size: Column, prefix: str, empty: str) -> Column:
    c = lambda n: F.col(f"{prefix}{n}")
    return F.when(c("path_count") == 0, empty).when((c("unknown_size_count") > 0) | (c("conflicting_size_path_count") > 0), "UNKNOWN_LTO_SIZES").when(size.between(c("total_min_bytes"), c("total_max_bytes")), "WITHIN_INTERVAL").otherwise("OUTSIDE_INTERVAL")


def localize_issues(issues: DataFrame) -> DataFrame:
    """(source_root, top_raw or null, issue_type): an issue below a folder belongs to it, any other to the whole root."""
    root = F.when(F.col("source_root") == "/", "/").otherwise(F.concat(F.regexp_replace("source_root", "/+$", ""), F.lit("/")))
    below = F.when(F.col("path").startswith(root), F.substring(F.col("path"), F.length(root) + 1, F.length("path")))
    top = F.substring_index(below, "/", 1)
    rows = issues.where(F.col("issue_type") != "non_utf8_filesystem_name")
    return rows.select("source_root", F.when((top != "") & ~top.contains("\\x"), top.cast("binary")).alias("top_raw"), "issue_type")


def folder_issues(folders: DataFrame, issues: DataFrame) -> DataFrame:
    """(folder, scan_issue_types as a list): own issues and those of the whole root; an issue alone makes a folder."""
    local = localize_issues(issues)
    own = local.where("top_raw is not null")
    every = folders.select(*FOLDER).unionByName(own.select(*FOLDER)).distinct()
    wide = local.where("top_raw is null").groupBy("source_root", "issue_type").agg(F.count("*").alias("n"))
    counted = own.groupBy(*FOLDER, "issue_type").agg(F.count("*").alias("n")).unionByName(every.join(wide, "source_root").select(*FOLDER, "issue_type", "n"))
    return every.join(counted.groupBy(*FOLDER).agg(F.array_sort(F.collect_set("issue_type")).alias("issue_types"), F.sum("n").alias("issue_count")), FOLDER, "left")


#: What can keep files of a folder from being deleted.
FILE_REASONS = tuple(sorted({*STATUS_REASON.values()}))


STATUSES = tuple(sorted({"MATCH", *STATUS_REASON} - {"ZERO_SIZE_LTO_RECORD"}))


def _counts_json() -> Column:
    """Aggregate of the status columns: {"MATCH": 2, ...} with the statuses that occur, sorted."""
    shown = [F.when(F.sum(f"s_{s}") > 0, F.concat(F.lit(f'"{s}": '), F.sum(f"s_{s}").cast("string"))) for s in STATUSES]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*shown)), ", "), F.lit("}"))


def folder_facts(done: Reconciled, issues: DataFrame | None = None, expected: DataFrame | None = None) -> DataFrame:
    """One row for each folder with all counts that both verdicts need.

    issues: scan issues; expected: (source_root, files) that the scans counted. A root whose
    rows are not as many as expected makes all its folders incomplete. Rows are summed by
    (folder, path) first, so one huge folder spreads over tasks and a path counts once.
    """
    rows = path_totals(done.rows).withColumns({"top_raw": top_raw(F.col("relative_path_bytes")), "reasons": blocking_reasons()})
    is_ = lambda s: F.col("status") == s
    odd = (~F.col("verified") & (F.size("reasons") == 0)) | (F.length("top_raw") == 0)
    counted = {
        "verified_count": F.col("verified"), "matches": is_("MATCH"), "unknown_matches": is_("MATCH_PATH_ONLY_SIZE_UNKNOWN"), "size_mismatches": is_("SIZE_MISMATCH"), "ambiguous": F.col("status").isin(*AMBIGUOUS),
        "zero_files": F.col("size_bytes") == 0, "invalid_encoding": F.col("path_encoding_valid") == 0, "odd": odd,
    }
    listed = F.col("entries") > 0
    own_top = F.col("first.norm_top_folder") == F.col("norm_top_folder")
    paths = rows.groupBy(*FOLDER, "norm_path").agg(
        F.min("norm_top_folder").alias("norm_top_folder"), F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_size"), *[F.count_if(c).alias(n) for n, c in counted.items()],
        *[F.max(F.array_contains("reasons", r)).alias(f"r_{r}") for r in FILE_REASONS], *[F.count_if(is_(s)).alias(f"s_{s}") for s in STATUSES], F.sum("matched_entries").alias("lto_copy_count"), F.first("matched_tapes").alias("tapes"),
        F.max(F.when(listed, 1).otherwise(0)).alias("listed"), F.max(F.when(listed & own_top, 1).otherwise(0)).alias("in_top"), *[F.max(F.when(listed, F.col(c))).alias(c) for c in PARTS],
    )
    matched = [F.sum("listed"), *[F.sum(c) for c in PARTS]]
    facts = paths.groupBy(*FOLDER).agg(
        F.min("norm_top_folder").alias("norm_top_folder"), *[F.sum(c).alias(c) for c in ("file_count", "total_size", *counted)],
        F.array_compact(F.array(*[F.when(F.max(f"r_{r}"), r) for r in FILE_REASONS])).alias("file_reasons"),
        F.sum("lto_copy_count").alias("lto_copy_count"), F.array_join(all_tapes("tapes"), " | ").alias("lto_tapes"), _counts_json().alias("classification_counts"),
        *[c.cast("long").alias(f"matched_{n}") for c, n in zip(matched, TOTALS, strict=True)], F.count("*").alias("storage_paths"), F.sum("in_top").cast("long").alias("covered"),
    )
    none = F.array().cast("array<string>")
    if expected is not None:
        facts = saved(facts)
        actual = facts.groupBy("source_root").agg(F.sum("file_count").alias("actual"))
        short = short_roots(expected, actual).select("source_root", "short")
    if issues is None:
        facts = facts.withColumns({"issue_types": none, "issue_count": F.lit(0).cast("long")})
    else:
        facts = facts.join(folder_issues(facts, issues), FOLDER, "right")
        facts = facts.withColumn("norm_top_folder", F.coalesce("norm_top_folder", F.lower(F.col("top_raw").cast("string"))))
    if expected is None:
        facts = facts.withColumn("short", F.lit(False))
    else:
        facts = facts.join(short, "source_root", "left").withColumn("short", F.coalesce("short", F.lit(False)))
    groups = done.meeting.where("entries > 0 and (is_first or stored is null)")
    w = manifest_totals(groups).select("norm_top_folder", *[F.col(n).alias(f"manifest_{n}") for n in TOTALS])
    facts = facts.join(w, "norm_top_folder", "left")
    numbers = [c for c, t in facts.dtypes if t == "bigint"]
    facts = facts.withColumns({"lto_tapes": F.coalesce("lto_tapes", F.lit("")), "classification_counts": F.coalesce("classification_counts", F.lit("{}"))})
    facts = facts.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers} | {"file_reasons": F.coalesce("file_reasons", none), "issue_types": F.coalesce("issue_types", none)})
    return facts.withColumns({"storage_only": F.col("storage_paths") - F.col("covered"), "lto_only": F.col("manifest_path_count") - F.col("covered")})


def short_roots(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(source_root, expected, actual, short) of (source_root, files) that scans counted and (source_root, actual) rows."""
    rows = expected.join(actual, "source_root", "left").select("source_root", F.col("files").alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return rows.withColumn("short", F.col("actual") != F.col("expected"))


def strict_decision(facts: DataFrame) -> DataFrame:
    """SAFE_TO_DELETE only if every file is verified and nothing at all speaks against it."""
    incomplete = F.when((F.col("odd") > 0) | F.col("short"), F.array(F.lit("INCOMPLETE_CLASSIFICATION"))).otherwise(F.array().cast("array<string>"))
    reasons = F.array_sort(F.array_distinct(F.concat("file_reasons", F.transform("issue_types", F.upper), incomplete)))
    safe = (F.col("file_count") > 0) & (F.size("_reasons") == 0) & (F.col("verified_count") == F.col("file_count"))
    df = facts.withColumn("_reasons", reasons).withColumn("safe", safe)
    df = df.withColumn("blocking_reasons", F.when(~F.col("safe") & (F.size("_reasons") == 0), "INCOMPLETE_CLASSIFICATION").otherwise(F.array_join("_reasons", " | ")))
    return df.withColumn("decision", F.when(F.col("safe"), "SAFE_TO_DELETE").otherwise("BLOCKED")).drop("_reasons", "safe")


def absolute_path() -> Column:
    return F.concat(F.regexp_replace("source_root", "/+$", ""), F.lit("/"), F.col("top_raw").cast("string"))


def _mid(kind: str) -> Column:
    return F.expr(f"({kind}_total_min_bytes + {kind}_total_max_bytes) div 2")


def folder_report(facts: DataFrame) -> DataFrame:
    """The strict report, one row for each folder: decision, reasons, totals, midpoints, signed differences."""
    df, size, c = strict_decision(facts), F.col("total_size"), F.col
    shown: dict[str, tuple[Column, bool]] = {}  # name -> (bytes, with sign)
    mid, result = _mid("matched"), interval_result(size, "matched_", "NO_MATCHED_LTO_PATHS")
    out = {
        "source_root": c("source_root"), "folder_name": c("top_raw").cast("string"), "absolute_path": absolute_path(),
        "decision": c("decision"), "blocking_reasons": c("blocking_reasons"),
        "storage_file_count": c("file_count"), "storage_total_size_bytes": size, "storage_total_size_human": None,
        "lto_matched_path_count": c("matched_path_count"), "lto_known_size_file_count": c("matched_known_size_count"), "lto_unknown_size_file_count": c("matched_unknown_size_count"),
        "lto_conflicting_size_path_count": c("matched_conflicting_size_path_count"), "lto_additional_identical_tape_copy_count": c("matched_additional_identical_tape_copy_count"),
    }
    for name, value in (("min", c("matched_total_min_bytes")), ("max", c("matched_total_max_bytes")), ("midpoint", mid)):
        out[f"lto_total_size_{name}_bytes"] = value
    for name, value in (("min", c("matched_total_min_bytes")), ("max", c("matched_total_max_bytes")), ("midpoint", mid)):
        out[f"lto_total_size_{name}_human"] = None
        shown[f"lto_total_size_{name}_human"] = (value, False)
    out["lto_folder_manifest_file_count"] = c("manifest_path_count")
    for name in ("known_size_count", "unknown_size_count", "conflicting_size_path_count", "additional_identical_tape_copy_count", "total_min_bytes", "total_max_bytes"):
        out[f"lto_folder_manifest_{name}"] = c(f"manifest_{name}")
    for name in ("min", "max"):
        out[f"lto_folder_manifest_total_{name}_human"] = None
        shown[f"lto_folder_manifest_total_{name}_human"] = (c(f"manifest_total_{name}_bytes"), False)
    for prefix, ends in (("", {"min": c("matched_total_min_bytes"), "max": c("matched_total_max_bytes"), "midpoint": mid}), ("manifest_", {"min": c("manifest_total_min_bytes"), "max": c("manifest_total_max_bytes")})):
        for form in ("bytes", "human"):
            for name, value in ends.items():
                field = f"storage_minus_lto_{prefix}{name}_{form}"
                out[field] = size - value if form == "bytes" else None
                if form == "human":
                    shown[field] = (size - value, True)
        if not prefix:
            out["storage_size_within_lto_folder_interval"] = F.when(result == "WITHIN_INTERVAL", "YES").when(result == "OUTSIDE_INTERVAL", "NO").otherwise("")
            out["folder_size_interval_result"] = result
    out["manifest_folder_size_interval_result"] = interval_result(size, "manifest_", "NO_LTO_FOLDER")
    # names of earlier reports
    out |= {"status": c("decision"), "top_folder": c("top_raw").cast("string"), "absolute_folder": absolute_path(), "file_count": c("file_count"), "verified_file_count": c("verified_count"), "total_size_bytes": size}
    out |= {n: c(n) for n in ("lto_copy_count", "lto_tapes", "classification_counts")}
    out["scan_issue_types"] = F.array_join("issue_types", " | ")
    shown["storage_total_size_human"] = (size, False)
    # all texts by one expression each way: written out for every column they would pass the size that the JVM compiles
    place: dict[str, Column] = {}
    for text, with_sign in ((human_bytes, False), (signed_human_bytes, True)):
        names = [n for n, (_, sign) in shown.items() if sign == with_sign]
        df = df.withColumn(f"_text{int(with_sign)}", F.transform(F.array(*[shown[n][0] for n in names]), text))
        place |= {n: F.col(f"_text{int(with_sign)}")[i] for i, n in enumerate(names)}
    return df.select(*[(place[n] if v is None else v).alias(n) for n, v in out.items()])


def simple_verdict(facts: DataFrame, percent: float = 0.1, most_bytes: int = 10_485_760) -> DataFrame:
    """The operator verdict with its reasons; adds result, reason, aggregate_size_result, scan_issues."""
    c = F.col
    df = facts.withColumn("scan_issues", F.when((c("issue_count") == 0) & ((c("odd") > 0) | c("short")), 1).otherwise(c("issue_count")))
    usable = (c("manifest_path_count") > 0) & (c("manifest_known_size_count") > 0) & (c("manifest_conflicting_size_path_count") == 0)
    df = df.withColumn("usable", usable)
    df = df.withColumn("size_ok", c("usable") & tolerant(c("total_size"), c("manifest_total_min_bytes"), c("manifest_total_max_bytes"), percent, most_bytes))
    n, m, u, x = c("file_count"), c("matches"), c("unknown_matches"), c("size_mismatches")
    count_ok = n == c("manifest_path_count")
    clean = (c("manifest_conflicting_size_path_count") == 0) & (c("ambiguous") == 0) & (c("zero_files") == 0) & (c("scan_issues") == 0) & (c("invalid_encoding") == 0) & (n > 0)
    base = count_ok & (c("storage_only") == 0) & (c("lto_only") == 0) & clean & c("size_ok")
    yes = base & (m == n) & (x == 0) & (c("manifest_unknown_size_count") == 0)
    unknown = base & (u > 0) & (m + u == n) & (x == 0) & (c("manifest_unknown_size_count") > 0)
    warn = base & (x > 0) & (m + u + x == n)
    result = F.when(yes, VERDICTS[0]).when(unknown, VERDICTS[1]).when(warn, VERDICTS[2]).otherwise(VERDICTS[3])
    other = (n - m - u != 0) & ~((x > 0) | (c("ambiguous") > 0) | (c("storage_only") > 0) | (c("zero_files") > 0) | (c("invalid_encoding") > 0))
    present = {
        "NO_LTO_FOLDER": c("manifest_path_count") == 0, "UNKNOWN_LTO_SIZE": c("manifest_unknown_size_count") > 0, "CONFLICTING_LTO_ENTRIES": c("manifest_conflicting_size_path_count") > 0, "STORAGE_ONLY_PATH": c("storage_only") > 0,
        "LTO_ONLY_PATH": c("lto_only") > 0, "SIZE_MISMATCH": x > 0, "AMBIGUOUS_PATH": (c("ambiguous") > 0) | other, "FILE_COUNT_MISMATCH": ~count_ok, "SIZE_OUTSIDE_TOLERANCE": c("usable") & ~c("size_ok"),
        "ZERO_SIZE_FILE": c("zero_files") > 0, "SCAN_INCOMPLETE": (c("scan_issues") > 0) | (n == 0), "INVALID_FILESYSTEM_ENCODING": c("invalid_encoding") > 0,
    }
    why = F.array_join(F.array_compact(F.array(*[F.when(present[r], r) for r in REASON_ORDER])), " | ")
    reason = (
        F.when(yes, "OK").when(unknown, "INDIVIDUAL_LTO_SIZE_UNKNOWN_AGGREGATE_MATCH")
        .when(warn, F.concat(F.lit("INDIVIDUAL_SIZE_MISMATCH_AGGREGATE_MATCH"), F.when(u > 0, " | INDIVIDUAL_LTO_SIZE_UNKNOWN_AGGREGATE_MATCH").otherwise("")))
        .otherwise(F.when(why == "", "AMBIGUOUS_PATH").otherwise(why))
    )
    size_result = F.when(c("size_ok"), "WITHIN_TOLERANCE").when(c("usable"), "OUTSIDE_TOLERANCE").otherwise("UNKNOWN")
    return df.withColumns({"result": result, "reason": reason, "aggregate_size_result": size_result})


def simple_report(facts: DataFrame, percent: float = 0.1, most_bytes: int = 10_485_760, units: str = "DECIMAL") -> DataFrame:
    """The operator report, one row for each folder."""
    df = simple_verdict(facts, percent, most_bytes)
    c, null = F.col, F.lit(None).cast("long")
    mid = _mid("manifest")
    off = c("total_size") - mid
    # |off| / size in 10^-4 percent, ties to even, in whole numbers
    scaled, size = F.abs(off).cast("decimal(38,0)") * 1_000_000, F.greatest(c("total_size"), F.lit(1)).cast("decimal(38,0)")
    q = F.call_function("div", scaled, size).cast("long")
    twice = 2 * (scaled - q * size)
    q = q + F.when((twice > size) | ((twice == size) & (q % 2 == 1)), 1).otherwise(0)
    share = F.concat(F.call_function("div", q, F.lit(10_000)).cast("string"), F.lit("."), F.lpad((q % 10_000).cast("string"), 4, "0"))
    when = lambda v, d: F.when(c("usable"), v).otherwise(d)
    out = {
        "folder_name": c("top_raw").cast("string"), "storage_size": human_bytes(c("total_size")), "lto_size": when(human_bytes(mid), "UNKNOWN"),
        "storage_file_count": c("file_count"), "lto_file_count": c("manifest_path_count"), "result": c("result"),
        "source_root": c("source_root"), "absolute_path": absolute_path(), "storage_size_bytes": c("total_size"),
        "lto_size_min_bytes": when(c("manifest_total_min_bytes"), null), "lto_size_max_bytes": when(c("manifest_total_max_bytes"), null), "lto_size_midpoint_bytes": when(mid, null),
        "size_difference_bytes": when(off, null), "size_difference_percent": when(share, ""), "size_result": c("aggregate_size_result"),
        "file_count_result": F.when(c("file_count") == c("manifest_path_count"), "MATCH").otherwise("MISMATCH"),
        "known_size_match_count": c("matches"), "unknown_size_path_match_count": c("unknown_matches"), "storage_only_path_count": c("storage_only"), "lto_only_path_count": c("lto_only"),
        "size_mismatch_count": c("size_mismatches"), "conflicting_lto_path_count": c("manifest_conflicting_size_path_count"), "ambiguous_path_count": c("ambiguous"), "zero_size_file_count": c("zero_files"),
        "scan_issue_count": c("scan_issues").cast("long"), "invalid_encoding_count": c("invalid_encoding"),
        "aggregate_size_result": c("aggregate_size_result"), "reason": c("reason"), "pdf_size_units": F.lit(units),
    }
    return df.select(*[v.alias(n) for n, v in out.items()])


def verdict_totals(report: DataFrame) -> DataFrame:
    """(result, folders, bytes) for all verdicts, zero-filled."""
    spark = report.sparkSession
    every = spark.createDataFrame([(v,) for v in VERDICTS], "result string")
    sums = report.groupBy("result").agg(F.count("*").alias("folders"), F.sum("storage_size_bytes").alias("bytes"))
    return every.join(sums, "result", "left").select("result", F.coalesce("folders", F.lit(0)).alias("folders"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
