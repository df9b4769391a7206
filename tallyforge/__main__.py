"""Command line: imports, scans and reports over a store of Parquet tables."""

from __future__ import annotations

import argparse
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from .functions.paths import cassette_label
from .functions.sizes import human_bytes
from .operators import archive, classify, compare, discovery, folders
from .sources import filesystem, lines, registry, roots, sinks, snapshot


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyforge")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        return c

    def units(c: argparse.ArgumentParser) -> None:
        c.add_argument("--units", choices=("decimal", "binary"), default="decimal")

    def scanned(c: argparse.ArgumentParser) -> None:
        c.add_argument("--mapping", help="scan the MATCHED folders of a discovery mapping")
        c.add_argument("--allow-rw-source", action="store_true")
        for n in ("--server", "--server-ip", "--volume"):
            c.add_argument(n, default="")

    def verdict(c: argparse.ArgumentParser) -> None:
        c.add_argument("--tolerance-percent", type=float, default=0.1)
        c.add_argument("--tolerance-bytes", type=int, default=10_485_760)

    command("init-store", "store")
    c = command("import-report", "store", "path")
    units(c)
    c.add_argument("--replace", action="store_true", help="in place of all earlier reports")
    c = command("scan", "snapshot")
    c.add_argument("roots", nargs="*")
    scanned(c)
    command("import-scan", "store", "snapshot")
    command("volumes", "store")
    command("reports", "store")
    c = command("import-catalog", "store", "workbook")
    for n in ("project", "cassette", "path", "filename", "size"):
        c.add_argument(f"--{n}-column", default=n)
    command("import-cassette-map", "store", "workbook")
    command("compare", "store", "out").add_argument("--no-moved-check", action="store_true")
    verdict(command("deletable-folders", "store", "out"))
    c = command("discover", "store", "out")
    c.add_argument("roots", nargs="*", help="search these for source folders; without them the imported scans are used")
    c.add_argument("--max-source-depth", type=int, default=2)
    c.add_argument("--anchors-per-folder", type=int, default=5)
    c.add_argument("--min-anchor-matches", type=int, default=2)
    c = command("compare-catalog", "store", "project", "out")
    c.add_argument("--report", help="report id; may be left out if there is one report")
    c.add_argument("--folder", action="append", default=[])
    c = command("all", "store", "report", "out")
    c.add_argument("roots", nargs="*")
    c.add_argument("--no-moved-check", action="store_true")
    units(c)
    scanned(c)
    verdict(c)
    return p


def _rows_sha(rows) -> str:
    """The same for the same rows in any order."""
    n, x = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    return f"{n}_{x}"


def _scans(spark: SparkSession, store: str):
    """(scan issues, (source_root, files) that the scans counted) of all imported scans."""
    reg = registry.registry(spark, store)
    bare = reg.where("kind = 'storage'").join(reg.where("kind = 'scan_stats'").select("content_sha256"), "content_sha256", "left_anti").limit(1).collect()
    if bare:
        raise ValueError(f"scan imported without its issues, import it again: {bare[0]['source']}")
    expected = registry.imported(spark, store, "scan_stats").groupBy("source_root").agg(F.sum("files").alias("files"))
    return registry.imported(spark, store, "scan_issue").select("source_root", "path", "issue_type", "details").distinct(), expected


def _manifest(spark: SparkSession, store: str):
    m = registry.imported(spark, store, "manifest")
    # insertion order: by import, then by place in the report
    entries = registry.registry(spark, store).where("kind = 'manifest'")  # one row for each report
    place = F.row_number().over(Window.orderBy("seq", "content_sha256"))
    order = entries.select("content_sha256", place.alias("place"))
    m = m.join(F.broadcast(order) if entries.count() < 10_000 else order, "content_sha256")
    return m.withColumn("entry_id", F.col("place").cast("long") * (1 << 32) + F.col("ord"))


def _inputs(spark: SparkSession, store: str):
    return _manifest(spark, store), registry.imported(spark, store, "storage")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tallyforge").getOrCreate()
    done = COMMANDS[a.command](spark, a)
    print(done)
    return done


def _init_store(spark, a):
    return registry.init_store(spark, a.store)


def _import_report(spark, a):
    return registry.import_report(spark, a.store, a.path, a.units, a.replace)


def _scan(spark, a):
    mapped = roots.matched_roots(a.mapping) if a.mapping else []
    if bool(mapped) == bool(a.roots):
        raise ValueError("give roots or a mapping")
    below: dict[str, list[bytes]] = {}
    for m in mapped:
        below.setdefault(m.source, []).append(os.fsencode(os.path.basename(m.physical)))
    places = [os.path.realpath(r) for r in a.roots] or list(below)
    for r in places:
        roots.require_local(r)
    for warning in roots.require_read_only(places, a.allow_rw_source):
        print(f"WARNING: {warning}")
    sinks.refuse(a.snapshot, places)
    started = datetime.now(timezone.utc).isoformat()
    found = filesystem.scan(spark, places, below).persist()
    counted = found.groupBy("source_root").agg(F.count("relative_path_bytes").alias("files")).collect()
    files = dict.fromkeys(places, 0) | {r["source_root"]: r["files"] for r in counted}
    logical = {(m.source, os.fsencode(os.path.basename(m.physical))): m.logical_top for m in mapped}
    identity = {
        "snapshot_id": uuid.uuid4().hex, "server": a.server, "server_ip": a.server_ip, "volume": a.volume, "volume_root": os.path.commonpath(places),
        "started_at": started, "roots": places, "root_files": files,
    }
    meta = snapshot.write_snapshot(filesystem.inventory(found, logical), a.snapshot, identity, filesystem.issues(found))
    found.unpersist()
    return f"COMPLETE:{meta['files']}"


def _import_scan(spark, a):
    files, meta = snapshot.read_snapshot(spark, a.snapshot)
    issues, expected = snapshot.read_issues(spark, a.snapshot, meta)
    sha = _rows_sha(files)
    scan = {"snapshot_id": meta.get("snapshot_id") or sha, **{n: meta.get(n) or "" for n in ("server", "server_ip", "volume", "volume_root")}, "files": meta["files"], "bytes": meta["bytes"], "issues": meta["issues"]}
    registry.check_identity(spark, a.store, scan)
    parts = {"storage": files, "scan_issue": issues, "scan_stats": expected, "storage_scan": spark.createDataFrame([scan], registry.SCAN)}
    known = registry.registry(spark, a.store).where((F.col("content_sha256") == sha) & F.col("kind").isin(*parts)).count()
    if known == len(parts):
        kept = registry.imported(spark, a.store, "scan_issue").where(F.col("content_sha256") == sha).drop("content_sha256")
        if snapshot.snapshot_difference(kept, issues.select(*kept.columns)).isEmpty():
            return "ALREADY_IMPORTED"
        raise ValueError(f"the same files with other issues: {a.snapshot}")
    registry.check_source(spark, a.store, "storage", a.snapshot, sha, "")
    counts = [(kind, registry.stage(spark, a.store, kind, rows, sha), sha) for kind, rows in parts.items()]
    registry.register(spark, a.store, counts, a.snapshot)
    return f"IMPORTED:{meta['files']}"


def _volumes(spark, a):
    rows = registry.volumes(registry.imported(spark, a.store, "storage_scan")).orderBy("server", "volume").collect()
    return sinks.text_table(["Server", "Address", "Volume", "Root", "Scans", "Files", "Bytes"], [list(r) for r in rows])


def _reports(spark, a):
    cols = ["report_id", "source_pdf", "project", "units", "rows", "expected_files", "issues"]
    rows = registry.reports(spark, a.store).orderBy("imported_at", "report_id").select(*cols).collect()
    return sinks.text_table(cols, [list(r) for r in rows], widest=64)


def _import_catalog(spark, a):
    from .sources import xlsx

    names = {n: getattr(a, f"{n}_column").lower() for n in ("project", "cassette", "path", "filename", "size")}
    return registry.commit(spark, a.store, "catalog", xlsx.catalog(xlsx.cells(spark, a.workbook), names), a.workbook, registry.content_sha(spark, a.workbook))


def _import_cassette_map(spark, a):
    from .sources import xlsx

    return registry.commit(spark, a.store, "cassette_map", xlsx.cassette_map(xlsx.cells(spark, a.workbook)), a.workbook, registry.content_sha(spark, a.workbook))


def _compare(spark, a):
    m, s = _inputs(spark, a.store)
    sinks.new_folder(a.out, registry.source_roots(spark, a.store))
    done = classify.reconcile(m, s, not a.no_moved_check, texts=True)
    results = compare.all_results(done).persist()
    sinks.write_csv(results, f"{a.out}/all_results.csv", ["relative_path", "status"])
    for name in sorted({r for routes in compare.ROUTES.values() for r in routes} | {"ambiguous"}):
        own = [st for st, routes in compare.ROUTES.items() if name in routes]
        rows = results.where(F.col("status").isin(*own) | (F.lit(name == "ambiguous") & ~F.col("status").isin(*compare.ROUTES)))
        sinks.write_csv(rows, f"{a.out}/{name}.csv", ["relative_path", "status"])
    sinks.write_csv(compare.duplicate_paths(m), f"{a.out}/lto_duplicate_paths.csv", ["norm_path"])
    sinks.write_csv(compare.duplicate_locations(m), f"{a.out}/duplicate_manifest_locations.csv", ["tape", "norm_path"])
    sinks.write_csv(compare.duplicate_storage(s), f"{a.out}/storage_duplicate_paths.csv", ["norm_path"])
    issues, _ = _scans(spark, a.store)
    sinks.write_csv(issues, f"{a.out}/scan_issues.csv", ["source_root", "path", "issue_type", "details"])
    sinks.write_csv(registry.imported(spark, a.store, "parse_issue").drop("content_sha256"), f"{a.out}/parse_issues.csv", ["source_pdf", "page", "issue_type"])
    sinks.write_csv(registry.imported(spark, a.store, "report_stats").drop("content_sha256"), f"{a.out}/report_stats.csv", ["source_pdf", "project"])
    missing = compare.copy_list(done).persist()
    absolute = missing.select("absolute_path", F.concat(F.regexp_replace("source_root", "/+$", "").cast("binary"), F.lit(b"/"), "relative_path_bytes").alias("raw"))
    sinks.write_text_list(absolute, "absolute_path", f"{a.out}/missing_on_lto_absolute_paths.txt")
    sinks.write_nul_list(absolute, "raw", f"{a.out}/missing_on_lto_absolute_paths.nul")
    sinks.write_shell_list(absolute, "absolute_path", f"{a.out}/missing_on_lto_shell_quoted.txt")
    sinks.write_root_lists(missing, f"{a.out}/copy_lists_by_root")
    missing.unpersist()
    totals = {r["metric"]: r["value"] for r in compare.summary(done, m).collect()}
    sinks.write_json(totals, f"{a.out}/summary.json")
    results.unpersist()
    return f"PATHS:{totals.get('STORAGE_UNIQUE_PATHS', 0)}"


def _deletable(spark, a):
    m, s = _inputs(spark, a.store)
    sinks.new_folder(a.out, registry.source_roots(spark, a.store))
    facts = folders.folder_facts(classify.reconcile(m, s), *_scans(spark, a.store)).persist()
    report, order = folders.folder_report(facts), ["source_root", "folder_name"]
    sinks.write_csv(report, f"{a.out}/folder_size_comparison.csv", order)
    sinks.write_csv(report.where("decision = 'SAFE_TO_DELETE'"), f"{a.out}/deletable_folders.csv", order)
    sinks.write_csv(report.where("decision = 'BLOCKED'"), f"{a.out}/blocked_folders.csv", order)
    units = registry.reports(spark, a.store).agg(F.min(F.upper("units"))).first()[0] or "DECIMAL"
    simple = folders.simple_report(facts, a.tolerance_percent, a.tolerance_bytes, units).persist()
    sinks.write_csv(simple, f"{a.out}/simple_folder_check.csv", order)
    safe = folders.strict_decision(facts).where("decision = 'SAFE_TO_DELETE'")
    safe = safe.select(folders.absolute_path().alias("text"), F.concat(F.regexp_replace("source_root", "/+$", "").cast("binary"), F.lit(b"/"), "top_raw").alias("raw"))
    sinks.write_text_list(safe, "text", f"{a.out}/deletable_folders.txt")
    sinks.write_nul_list(safe, "raw", f"{a.out}/deletable_folders.nul")
    # one row for each top folder, for people
    rows = simple.orderBy("folder_name", "source_root").select("source_root", "folder_name", "storage_size", "lto_size", "storage_file_count", "lto_file_count", "result").collect()
    labels = sinks.folder_labels([(r[0], r[1]) for r in rows])
    print(sinks.text_table(["Folder", "Disk", "LTO", "Disk files", "LTO files", "Result"], [[label, *r[2:]] for label, r in zip(labels, rows, strict=True)]))
    totals = folders.verdict_totals(simple).select("result", "folders", human_bytes(F.col("bytes")).alias("size")).collect()
    print(sinks.text_table(["Result", "Folders", "Total storage size"], [list(r) for r in sorted(totals, key=lambda r: folders.VERDICTS.index(r["result"]))]))
    n = safe.count()
    for df in (simple, facts):
        df.unpersist()
    return f"SAFE:{n}"


def _discover(spark, a):
    m = _manifest(spark, a.store)
    sources, issues = roots.find_sources(a.roots, a.max_source_depth) if a.roots else ([], [])
    if a.roots:
        s = filesystem.inventory(filesystem.scan(spark, [x.path for x in sources])) if sources else None
    else:
        s = registry.imported(spark, a.store, "storage")
    sinks.new_folder(a.out, [x.path for x in sources] or (registry.source_roots(spark, a.store) if not a.roots else []))
    if s is None:
        raise ValueError("no source folder was found")
    inv = s.select(
        F.concat_ws("/", "source_root", "top_folder").alias("folder"), F.col("norm_top_folder").alias("norm_name"), F.regexp_extract("norm_path", "^[^/]+/(.*)$", 1).alias("norm_below"), "size_bytes",
        (F.col("path_encoding_valid") == 1).alias("readable"), "source_root",
    )
    found = discovery.mapping(m, inv.drop("source_root"), a.anchors_per_folder, a.min_anchor_matches)
    # a row for each source folder, listed by the driver
    names = spark.createDataFrame([(x.path, x.root, x.project) for x in sources], "source_directory string, raid_root string, project_name string")
    parent = F.regexp_extract("physical_folder", "^(.*)/[^/]*$", 1)
    found = found.withColumn("source_directory", parent).join(F.broadcast(names), "source_directory", "left").withColumn("source_root", F.col("source_directory"))
    found = found.withColumns({c: F.coalesce(c, F.lit("")) for c in ("raid_root", "project_name")})
    columns = ["lto_top_folder", "normalized_lto_top_folder", "status", "raid_root", "source_root", "project_name", "source_directory", "physical_folder", "candidate_count", "anchors_tested", *discovery.METRIC_NAMES, "confidence_reason"]
    found = found.select(*columns).persist()
    order = ["normalized_lto_top_folder"]
    n = sinks.write_csv(found, f"{a.out}/discovery_mapping.csv", order)
    sinks.write_csv(found.where(F.col("status").isin("AMBIGUOUS", "NAME_MATCH_UNVERIFIED")), f"{a.out}/discovery_ambiguous.csv", order)
    sinks.write_csv(found.where("status = 'NOT_FOUND'"), f"{a.out}/discovery_not_found.csv", order)
    shown = found.orderBy(*order).select("lto_top_folder", "project_name", "physical_folder", "status").collect()
    print(sinks.text_table(["LTO folder", "Project", "Physical folder", "Status"], [[r[0], r[1] or "?", r[2] or "-", r[3]] for r in shown]))
    for issue in issues:
        print(f"WARNING: {issue}")
    found.unpersist()
    return f"FOLDERS:{n}"


def _compare_catalog(spark, a):
    known = [r["report_id"] for r in registry.reports(spark, a.store).select("report_id").distinct().orderBy("report_id").collect()]
    report = a.report or (known[0] if len(known) == 1 else None)
    if report not in known:
        raise ValueError(f"unknown report: {a.report}; reports are {', '.join(known) or 'none'}")
    every = registry.imported(spark, a.store, "catalog")
    cat = every.where(F.col("project_norm") == lines.key(a.project))
    if cat.isEmpty():
        names = [r[0] for r in every.select("project_norm").distinct().orderBy("project_norm").collect()]
        raise ValueError(f"no imported project: {a.project}; projects are {', '.join(names) or 'none'}")
    chosen = archive.select_folders(cat, a.folder)
    own = lambda kind: registry.imported(spark, a.store, kind).where(F.col("content_sha256") == report)
    seen = _manifest(spark, a.store).where(F.col("content_sha256") == report).withColumn("tape_norm", cassette_label(F.col("tape")))
    sinks.new_folder(a.out, registry.source_roots(spark, a.store))
    details = archive.file_details(cat, seen, chosen).withColumns({"archive_project": F.lit(a.project), "report_id": F.lit(report)})
    sinks.write_csv(details, f"{a.out}/details.csv", ["folder", "path", "status", "entry_id"])
    summary = archive.with_report(archive.folder_summary(cat, seen, chosen), own("report_stats")).withColumns({"archive_project": F.lit(a.project), "report_id": F.lit(report)})
    return f"FOLDERS:{sinks.write_csv(summary, f'{a.out}/summary.csv', ['folder'])}"


def _all(spark, a):
    """A report and a scan into a new store, then both kinds of reports."""
    a.path, a.replace, a.snapshot = a.report, False, f"{a.store}_snapshot"
    done = [_init_store(spark, a), _import_report(spark, a), _scan(spark, a), _import_scan(spark, a)]
    out = a.out
    a.out = f"{out}/compare"
    done.append(_compare(spark, a))
    a.out = f"{out}/folders"
    return " ".join([*done, _deletable(spark, a)])


COMMANDS = {
    "init-store": _init_store, "import-report": _import_report, "scan": _scan, "import-scan": _import_scan, "volumes": _volumes, "reports": _reports, "import-catalog": _import_catalog,
    "import-cassette-map": _import_cassette_map, "compare": _compare, "deletable-folders": _deletable, "discover": _discover, "compare-catalog": _compare_catalog, "all": _all,
}

if __name__ == "__main__":
    main()
