import pytest
from builders import manifest, storage
from pyspark.sql import functions as F

from tallyforge.operators import archive, classify, compare, discovery, folders

P = "Project/file.mov"
CASES = [
    ([("a", P, 100)], [(P, 100, 100, "T1"), (P, 100, 100, "T2")], [("MATCH", "identical", "none", True)]),
    ([("a", P, 100)], [(P, 100, 100, "T1"), (P, 200, 200, "T2")], [("CONFLICTING_LTO_ENTRIES", "conflicting_known_intervals", "none", False)]),
    ([("a", P, 100), ("b", P, 100)], [(P, 100, 100, "T1")], [("MATCH", "none", "identical", True)] * 2),
    ([("a", P, 100), ("b", P, 200)], [(P, 100, 100, "T1")], [("AMBIGUOUS_STORAGE_DUPLICATE_SIZES", "none", "different_sizes", False)] * 2),
    ([("a", "Project/new/file.mov", 100)], [("Project/old/file.mov", None, None, "T1")], [("MISSING_ON_LTO", "none", "none", False)]),
    ([("a", "Project/new/file.mov", 100)], [("Project/old/file.mov", 90, 110, "T1")], [("POSSIBLE_MOVED_WITHIN_TOP_FOLDER", "none", "none", False)]),
    ([("a", "P/one/file.mov", 100), ("a", "P/two/file.mov", 100)], [("P/old/file.mov", 100, 100, "T1")], [("AMBIGUOUS_POSSIBLE_MOVE", "none", "none", False)] * 2),
    ([("a", "P/one/file.mov", 100), ("b", "P/one/file.mov", 100)], [("P/old/file.mov", 100, 100, "T1")], [("POSSIBLE_MOVED_WITHIN_TOP_FOLDER", "none", "identical", False)] * 2),
    ([("a", "P/one/file.mov", 100)], [("P/x/file.mov", 90, 110, "T1"), ("P/y/file.mov", 95, 105, "T2")], [("AMBIGUOUS_POSSIBLE_MOVE", "conflicting_known_intervals", "none", False)]),
    ([("a", P, 100)], [(P, 100, 100, "T1"), (P, None, None, "T2")], [("AMBIGUOUS_LTO_SIZE_UNKNOWN", "contains_unknown_size", "none", False)]),
    ([("a", P, 100)], [(P, None, None, "T1")], [("MATCH_PATH_ONLY_SIZE_UNKNOWN", "none", "none", False)]),
    ([("a", P, 0)], [(P, 0, 0, "T1")], [("ZERO_SIZE_STORAGE", "none", "none", False)]),
    ([("a", P, 0)], [], [("ZERO_SIZE_STORAGE_ONLY", "none", "none", False)]),
    ([("a", P, 7)], [(P, 8, 9, "T1")], [("SIZE_MISMATCH", "none", "none", False)]),
    ([("a", P, 7, 0)], [(P, 7, 7, "T1")], [("INVALID_FILESYSTEM_ENCODING", "none", "none", False)]),
]


def test_classification(spark):
    """All cases at once, each under a folder of its own."""
    s = [(r[0], f"c{i}{r[1]}", *r[2:]) for i, (rows, _, _) in enumerate(CASES) for r in rows]
    m = [(f"c{i}{p}", lo, hi, t) for i, (_, rows, _) in enumerate(CASES) for p, lo, hi, t in rows]
    got = classify.classify(manifest(spark, m), storage(spark, s)).collect()
    for i, (_, _, want) in enumerate(CASES):
        own = sorted((r.status, r.lto_duplicate_kind, r.storage_duplicate_kind, r.verified) for r in got if r.relative_path.startswith((f"c{i}P", f"c{i}p")))
        assert own == sorted(want), i
    assert len(got) == len(s)
    none = classify.classify(manifest(spark, m), storage(spark, s), moved_check=False)
    assert none.where("status like '%MOVE%'").count() == 0
    reasons = classify.classify(manifest(spark, m), storage(spark, s)).select(classify.blocking_reasons().alias("r"), "verified").collect()
    assert all((not r.r) == r.verified for r in reasons)


def test_comparison_consumes_moves(spark):
    s = storage(spark, [("b", "P/new/f.mov", 100), ("a", "P/x", 5), ("b", "P/x", 5), ("a", "P/gone", 1)])
    m = manifest(spark, [("P/old/f.mov", 100, 100, "T1"), ("P/x", 5, 5, "T1"), ("P/x", 5, 5, "T1"), ("P/left", 9, 9, "T2"), ("P/zero", 0, 0, "T2")])
    done = classify.reconcile(m, s, texts=True)
    got = {r.relative_path: r for r in compare.all_results(done).collect()}
    assert {p: r.status for p, r in got.items()} == {"P/new/f.mov": "POSSIBLE_MOVED_WITHIN_TOP_FOLDER", "P/x": "MATCH", "P/gone": "MISSING_ON_LTO", "P/left": "MISSING_ON_STORAGE", "P/zero": "ZERO_SIZE_LTO_ONLY"}
    assert got["P/x"].storage_root == "a" and got["P/x"].lto_reported_sizes == "T1:5 B[5-5] | T1:5 B[5-5]" and got["P/x"].lto_tapes == "T1"
    totals = {r.metric: r.value for r in compare.summary(done, m).collect()}
    assert totals["MATCH"] == 1 and totals["STORAGE_FILES"] == 4 and totals["ZERO_SIZE_LTO_RECORD"] == 1 and totals["DUPLICATE_MANIFEST_LOCATION_GROUPS"] == 1
    assert [r.relative_path for r in compare.copy_list(done).collect()] == ["P/gone"]


FOLDERS = [
    # (name, storage sizes, manifest intervals by file, percent, bytes, decision, result, reason)
    ("exact", [1536], [(1536, 1536)], 0.1, 10_485_760, "SAFE_TO_DELETE", "YES", "OK"),
    ("percent", [1_000_000], [(1_000_500, 1_000_500)], 0.1, 0, "BLOCKED", "YES_WITH_FILE_WARNINGS", "INDIVIDUAL_SIZE_MISMATCH_AGGREGATE_MATCH"),
    ("bytes", [1_000_000], [(1_000_005, 1_000_005)], 0.0, 5, "BLOCKED", "YES_WITH_FILE_WARNINGS", "INDIVIDUAL_SIZE_MISMATCH_AGGREGATE_MATCH"),
    ("unknown", [100, 5], [(100, 100), None], 0.0, 5, "BLOCKED", "YES_WITH_UNKNOWN_SIZE", "INDIVIDUAL_LTO_SIZE_UNKNOWN_AGGREGATE_MATCH"),
    ("both", [110, 5], [(100, 100), None], 0.0, 20, "BLOCKED", "YES_WITH_FILE_WARNINGS", "INDIVIDUAL_SIZE_MISMATCH_AGGREGATE_MATCH | INDIVIDUAL_LTO_SIZE_UNKNOWN_AGGREGATE_MATCH"),
    ("outside", [1_000_000], [(1_020_000, 1_020_000)], 0.1, 10_000, "BLOCKED", "NO", "SIZE_MISMATCH | SIZE_OUTSIDE_TOLERANCE"),
]


@pytest.mark.parametrize(("name", "sizes", "spans", "percent", "most", "decision", "result", "reason"), FOLDERS)
def test_folder_verdicts(spark, name, sizes, spans, percent, most, decision, result, reason):
    s = storage(spark, [("/r", f"{name}/f{i}", x) for i, x in enumerate(sizes)])
    m = manifest(spark, [(f"{name}/f{i}", *(x or (None, None)), "T1") for i, x in enumerate(spans)])
    facts = folders.folder_facts(classify.reconcile(m, s))
    assert [r.decision for r in folders.strict_decision(facts).collect()] == [decision]
    r = folders.simple_report(facts, percent, most).first()
    assert (r.result, r.reason) == (result, reason)
    if name == "percent":
        assert r.size_difference_percent == "0.0500"


def test_folder_totals_and_issues(spark):
    s = storage(spark, [("/r", "A/x", 105), ("/r", "A/y", 205), ("/r", "B/z", 1)])
    m = manifest(spark, [("A/x", 100, 110, "T1"), ("A/x", 100, 110, "T2"), ("A/y", 200, 210, "T1"), ("A/q", 1, 1, "T1"), ("A/q", 2, 2, "T1"), ("A/u", 5, 5, "T1"), ("A/u", None, None, "T2")])
    issues = spark.createDataFrame([("/r", "/r/A/sub", "symlink_skipped", ""), ("/r", "/r", "directory_read_error", ""), ("/r", "/r/C", "special", ""), ("/r", "/r/A/n", "non_utf8_filesystem_name", "")], "source_root string, path string, issue_type string, details string")
    expected = spark.createDataFrame([("/r", 4)], "source_root string, files long")
    facts = folders.folder_facts(classify.reconcile(m, s), issues, expected)
    got = {r.folder_name: r for r in folders.folder_report(facts).collect()}
    a = got["A"]
    assert (a.lto_total_size_min_bytes, a.lto_total_size_max_bytes, a.lto_total_size_midpoint_bytes, a.storage_minus_lto_min_human, a.storage_minus_lto_max_human) == (300, 320, 310, "+10 B", "-10 B")
    assert (a.lto_folder_manifest_file_count, a.lto_folder_manifest_known_size_count, a.lto_folder_manifest_unknown_size_count, a.lto_folder_manifest_conflicting_size_path_count, a.lto_additional_identical_tape_copy_count) == (4, 3, 1, 1, 1)
    assert (a.lto_copy_count, a.lto_tapes, a.classification_counts, a.absolute_path) == (3, "T1 | T2", '{"MATCH": 2}', "/r/A") and len(a) == 51
    assert a.folder_size_interval_result == "WITHIN_INTERVAL" and a.manifest_folder_size_interval_result == "UNKNOWN_LTO_SIZES"
    assert a.blocking_reasons == "DIRECTORY_READ_ERROR | INCOMPLETE_CLASSIFICATION | SYMLINK_SKIPPED"
    assert got["C"].storage_file_count == 0 and got["C"].decision == "BLOCKED" and got["B"].scan_issue_types == "directory_read_error"
    simple = {r.folder_name: r for r in folders.simple_report(facts).collect()}
    assert len(simple["A"]) == 29
    assert "SCAN_INCOMPLETE" in simple["C"].reason and simple["A"].scan_issue_count == 2
    assert {r.result: r.folders for r in folders.verdict_totals(folders.simple_report(facts)).collect()} == {"YES": 0, "YES_WITH_UNKNOWN_SIZE": 0, "YES_WITH_FILE_WARNINGS": 0, "NO": 3}


ARCHIVE = [
    ("unknown", [None], [10], 0, "COMPLETE", "UNKNOWN"), ("partial", [10, None], [10, 10], 0, "COMPLETE", "PARTIAL"), ("verified", [10], [10], 0, "COMPLETE", "VERIFIED"), ("missing", [10, 10], [10], 0, "INCOMPLETE", "VERIFIED"),
    ("unexpected", [10], [10], 1, "INCOMPLETE", "VERIFIED"), ("only_unexpected", [10], [], 1, "INCOMPLETE", "UNKNOWN"), ("absent", [10], [], 0, "NOT_FOUND", "UNKNOWN"), ("mismatch", [10], [20], 0, "CONFLICT", "CONFLICT"),
]


def test_catalog_comparison(spark):
    cat = [(f"{n}/f{i}", "CXZ305L7", "cxz305", x, f"f{i}", n) for n, sizes, *_ in ARCHIVE for i, x in enumerate(sizes)]
    seen = [(f"{n}/f{i}", x, x, "CXZ305") for n, _, sizes, *_ in ARCHIVE for i, x in enumerate(sizes)] + [(f"{n}/extra", 1, 1, "CXZ305") for n, _, _, k, *_ in ARCHIVE if k] + [("verified/other", 1, 1, "ZZ1")]
    c = spark.createDataFrame(cat, "path string, cassette_raw string, cassette_norm string, size_bytes long, filename_raw string, path_norm string")
    o = manifest(spark, seen).withColumn("tape_norm", F.lower("tape"))
    got = {r.folder: (r.presence_status, r.size_status) for r in archive.folder_summary(c, o).collect()}
    assert got == {n: (p, z) for n, _, _, _, p, z in ARCHIVE}
    details = archive.file_details(c, o)
    assert details.where("status = 'UNEXPECTED_ON_REPORT'").count() == 2 and details.count() == len(cat) + 2


def test_discovery(spark):
    m = manifest(spark, [("one/a/x.mov", 10, 10, "T1"), ("one/b/y.mov", 20, 20, "T1"), ("one/b/y.mov", 20, 20, "T2"), ("two/a/p.mov", 1, 1, "T1"), ("two/a/q.mov", 2, 2, "T1"), ("far/k/only.mov", 7, 7, "T1"), ("far/k/more.mov", 8, 8, "T1"), ("none/z/z.mov", 3, 3, "T1"), ("soft/u/u.mov", None, None, "T1")])
    inv = [("/s/one", "one", "a/x.mov", 10), ("/s/one", "one", "b/y.mov", 20), ("/s/two", "two", "a/p.mov", 1), ("/t/two", "two", "a/q.mov", 2), ("/s/renamed", "renamed", "k/only.mov", 7), ("/s/renamed", "renamed", "k/more.mov", 8), ("/s/soft", "soft", "u/u.mov", 5)]
    i = spark.createDataFrame([(*r, True) for r in inv], "folder string, norm_name string, norm_below string, size_bytes long, readable boolean")
    got = {r.lto_top_folder: r for r in discovery.mapping(m, i).collect()}
    assert {k: r.status for k, r in got.items()} == {"one": "MATCHED", "two": "AMBIGUOUS", "far": "MATCHED", "none": "NOT_FOUND", "soft": "NAME_MATCH_UNVERIFIED"}
    assert got["far"].physical_folder == "/s/renamed" and "fallback=yes" in got["far"].confidence_reason
    chosen = discovery.anchors(m, 1).where("norm_top_folder = 'one'").collect()
    assert [r.norm_path for r in chosen] == ["one/a/x.mov"]
