import io
import json
import os
import zipfile
from datetime import datetime
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import paths, sizes
from tallyforge.sources import filesystem, lines, registry, roots, sinks, snapshot, xlsx
from tallyforge.streaming import incremental


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_paths(spark):
    d = column(spark, ["Straße\\Ärger//./x.MOV", "/Volumes/CTH348/16-12/a.mov", "STRASSE", "ﬁ/..", "", None])
    got = [r[0] for r in d.select(paths.normal_path(F.col("v"))).collect()]
    assert got == ["strasse/ärger/x.mov", "volumes/cth348/16-12/a.mov", "strasse", "fi/..", "", None]
    v = d.select(*[c.alias(n) for c, n in zip(paths.volume_path(F.col("v")), ("t", "p"), strict=True)]).collect()
    assert (v[1].t, v[1].p, v[0].t) == ("CTH348", "16-12/a.mov", None)
    labels = column(spark, ["FF7480L7", " CTH342L7 ", "OV6319L7", "CXZ305", "OV63118", "KANSK05", "ABCL7"])
    assert [r[0] for r in labels.select(paths.cassette_label(F.col("v"))).collect()] == ["ff7480", "cth342", "ov6319", "cxz305", "ov63118", "kansk05", "abcl7"]
    raw = column(spark, [b"a/\xff.mov", "É/b".encode()], "binary").select(paths.raw_key(F.col("v")), paths.raw_display(F.col("v"))).collect()
    assert [tuple(r) for r in raw] == [("__NON_UTF8_RAW_BYTES__/612fff2e6d6f76", "a/\\xff.mov"), ("é/b", "É/b")]


def test_size_intervals_cover_what_rounds_to_them(spark):
    shown = ["1.22 GB", "0 KB", "0.00 MB", "15 B", "999.9 TB", "1 KB", "2.500 MB", "1.5 B", "x", None, "7.0 B"]
    for mode, base in (("decimal", 1000), ("binary", 1024)):
        got = [r.i for r in column(spark, shown).select(sizes.size_interval(F.col("v"), mode).alias("i")).collect()]
        for text, i in zip(shown, got, strict=True):
            if text in ("1.5 B", "x", None):
                assert i is None
                continue
            number, unit = text.split()
            assert (i.lo, i.hi) == lines.interval(number, unit, mode)[1:]
            m, half = base ** sizes.UNITS.index(unit), Decimal(1).scaleb(Decimal(number).as_tuple().exponent) / 2
            if unit != "B":
                edge = max(Decimal(0), Decimal(number) - half) * m
                assert i.lo - 1 < edge <= i.lo and (i.hi < (Decimal(number) + half) * m <= i.hi + 1 or i.lo == i.hi)


def test_human_bytes(spark):
    def python(v):
        for i, u in enumerate(sizes.DISPLAY):
            if v < 1024 ** (i + 1) or i == 5:
                return f"{v} B" if i == 0 else f"{v / 1024**i:.2f} {u}"

    values = [0, 1, 1023, 1024, 1152, 1536, 2**20 - 1, 2**20, 123456789, 5 * 2**30 + 7, 2**50, 3 * 2**50 + 5] + [1024 * k + 5 * k * k for k in range(1, 300)]
    got = [r[0] for r in column(spark, values, "long").select(sizes.human_bytes(F.col("v"))).collect()]
    assert got == [python(v) for v in values]
    assert [r[0] for r in column(spark, [0, 512, -1024], "long").select(sizes.signed_human_bytes(F.col("v"))).collect()] == ["0 B", "+512 B", "-1.00 KiB"]


@given(st.integers(0, 9999), st.integers(1, 30), st.integers(1, 6))
def test_sequence_names(first, frames, width):
    a, b = f"clip_{first:0{width}d}.png", f"clip_{first + frames - 1:0{width}d}.png"
    names = lines.expand_names(a, b, frames)
    assert names[0].endswith(".png") and len(names) == frames and lines.expand_names(a, b, frames + 1) is None


REPORT = """Project : Film   Collection : X
Total Files : 5
Name : a.mov   Size : 1.22 GB
Created : today
Path : /Volumes/CXZ305/prj/
day1/a.mov
Name : long_name.mpSi4ze : 1.22 GB
Path : /Volumes/CXZ305/prj/long_name.mp4
Frames : 3
First : card1.png  Size : 2 KB
Last : card3.png  Size : 3 KB
Path : /Volumes/CXZ305/prj/card1.png"""


def test_report_parser(spark):
    rows = [("r.pdf", i, 1, t) for i, t in enumerate(REPORT.split("\n"))] + [("bad.pdf", 0, 1, "Name : x  Size : 1 B"), ("bad.pdf", 1, 1, "Name : trunc  Size : 1 B"), ("bad.pdf", 2, 2, "Path : /Volumes/T/truncated.mov"), ("bad.pdf", 3, 2, "First : q1  Size : 1 B")]
    parsed = lines.parse_lines(spark.createDataFrame(rows, "pdf string, line_no long, page int, line string")).cache()
    e = lines.entries(parsed).where("source_pdf = 'r.pdf'").orderBy("ord").collect()
    assert [(r.relative_path, r.entry_kind, r.size_known) for r in e] == [("prj/day1/a.mov", "regular", 1), ("prj/long_name.mp4", "regular", 1), ("prj/card1.png", "sequence_first", 1), ("prj/card2.png", "sequence_middle_size_unknown", 0), ("prj/card3.png", "sequence_last", 1)]
    assert e[0].project == "Film" and (e[0].size_min_bytes, e[0].size_max_bytes) == (1_215_000_000, 1_224_999_999)
    kinds = {(r.pdf, r.issue_type) for r in parsed.where("kind = 'issue'").collect()}
    assert kinds == {("r.pdf", "entry_line_layout_recovered"), ("r.pdf", "sequence_file_size_unknown"), ("bad.pdf", "record_without_path"), ("bad.pdf", "name_path_disagreement"), ("bad.pdf", "incomplete_sequence_record")}
    stats = {r.source_pdf: r for r in lines.report_stats(parsed).collect()}
    assert (stats["r.pdf"].extracted_files, stats["r.pdf"].difference, stats["bad.pdf"].issues) == (5, 0, 3)


def workbook(sheets):
    """sheets: {name: {cell: text}}; one shared string, the rest inline."""
    out, ns = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Project</t></si></sst>")
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, cells in enumerate(sheets.values()):
            rows = {}
            for ref, text in cells.items():
                c = f'<c r="{ref}" t="s"><v>0</v></c>' if text == "Project" else f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'
                rows.setdefault(int(ref.lstrip("ABCDEFG")), []).append(c)
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{r}">{"".join(c)}</row>' for r, c in rows.items()) + "</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    heads = dict(zip("ABCDE", ["Project", "Cassette", "Path", "Filename", "Size"], strict=True))
    sheet = {"A1": "Project", "B1": "decoy"} | {f"{c}2": t for c, t in heads.items()} | {"A3": "VU2", "B3": "FF7480L7", "C3": "D\\x", "D3": "A.mov", "E3": "12"} | {"A4": "VU2", "B4": "T", "C4": "d", "D4": "b.mov", "E4": "n/a"}
    maps = {"A1": "CXZ305", "B1": "FF7480L7", "A2": "KANSK05", "B2": "20240611\\", "A3": "20240612/"}
    (tmp_path / "c.xlsx").write_bytes(workbook({"list": sheet}))
    (tmp_path / "m.xlsx").write_bytes(workbook({"VU2": maps}))
    names = {"project": "project", "cassette": "cassette", "path": "path", "filename": "filename", "size": "size"}
    got = xlsx.catalog(xlsx.cells(spark, str(tmp_path / "c.xlsx")), names).orderBy("row").collect()
    assert [(r.row, r.cassette_norm, r.path, r.size_bytes) for r in got] == [(3, "ff7480", "d/x/a.mov", 12), (4, "t", "d/b.mov", None)]
    got = xlsx.cassette_map(xlsx.cells(spark, str(tmp_path / "m.xlsx"))).orderBy("row", "col").collect()
    assert [(r.col, r.cassette_norm, r.note, r.folder_norm) for r in got] == [("B", "ff7480", "", "20240611"), ("A", "cxz305", "KANSK05", "20240612")]


def test_scan_snapshot_and_sinks(spark, tmp_path):
    root = tmp_path / "src"
    (root / "Prj" / "sub").mkdir(parents=True)
    (root / "Prj" / "sub" / "a.MOV").write_bytes(b"12345")
    (root / "Prj" / ".hidden").write_bytes(b"x")
    (root / "top.txt").write_bytes(b"1")
    os.symlink("top.txt", root / "Prj" / "link")
    with open(os.fsencode(root) + b"/Prj/\xff.bin", "wb") as f:
        f.write(b"123")
    found = filesystem.scan(spark, [str(root)]).cache()
    inv = filesystem.inventory(found, {(str(root), b"Prj"): "Logical"})
    got = {r.norm_path: r for r in inv.collect()}
    assert set(got) == {"logical/sub/a.mov", "top.txt", "__NON_UTF8_RAW_BYTES__/5072" + "6a2fff2e62696e"}
    assert got["logical/sub/a.mov"].size_bytes == 5 and got["logical/sub/a.mov"].top_folder == "Prj"
    assert sorted(r.issue_type for r in filesystem.issues(found).collect()) == ["non_utf8_filesystem_name", "symlink_skipped"]
    out = str(tmp_path / "snap")
    assert snapshot.write_snapshot(inv, out, {"server": "s"})["files"] == 3
    files, meta = snapshot.read_snapshot(spark, out)
    assert snapshot.snapshot_difference(files, inv).count() == 0 and meta["bytes"] == 9
    with pytest.raises(FileExistsError):
        snapshot.write_snapshot(inv, out, {})
    os.remove(f"{out}/{snapshot.MARKER}")
    with pytest.raises(ValueError):
        snapshot.read_snapshot(spark, out)
    sinks.write_csv(inv.select("norm_path", "size_bytes"), str(tmp_path / "o.csv"), ["norm_path"])
    assert (tmp_path / "o.csv").read_bytes().startswith(b"\xef\xbb\xbfnorm_path,size_bytes\r\n")
    sinks.write_nul_list(inv, "relative_path_bytes", str(tmp_path / "o.nul"))
    assert (tmp_path / "o.nul").read_bytes().split(b"\0")[1] == b"Prj/\xff.bin"
    with pytest.raises(ValueError):
        sinks.refuse(str(root / "x.csv"), [str(root)])


def test_import_once_by_batch_and_stream(spark, tmp_path):
    land, store = tmp_path / "land", str(tmp_path / "store")
    land.mkdir()
    (land / "one.txt").write_text(REPORT)
    assert registry.import_report(spark, store, str(land / "one.txt")) == "IMPORTED:5"
    assert registry.import_report(spark, store, str(land / "one.txt")) == "ALREADY_IMPORTED"
    (land / "copy.txt").write_text(REPORT)
    (land / "two.txt").write_text(REPORT.replace("a.mov", "b.mov"))
    with pytest.raises(ValueError):
        registry.import_report(spark, store, str(land / "two.txt"), "binary")
    for _ in range(2):
        incremental.start_import(spark, str(land), store).awaitTermination(120)
    assert registry.imported(spark, store, "manifest").count() == 10
    (land / "two.txt").write_text("changed")
    with pytest.raises(ValueError):
        registry.new_sources(spark, store, spark.createDataFrame([(next(r.source for r in registry.registry(spark, store).collect() if "two" in r.source), "other")], "source string, content_sha256 string"), "manifest")


def test_command_line(spark, tmp_path, capsys):
    from tallyforge.__main__ import main

    root, store = tmp_path / "src", str(tmp_path / "store")
    (root / "prj").mkdir(parents=True)
    (root / "prj" / "card1.png").write_bytes(b"x" * 2000)
    (root / "prj" / "new.bin").write_bytes(b"y")
    (tmp_path / "r.txt").write_text(REPORT)

    def run(*args):
        return main([str(a) for a in args], spark)

    assert run("init-store", store) == "CREATED" and run("init-store", store) == "CURRENT"
    assert run("import-report", store, tmp_path / "r.txt") == "IMPORTED:5"
    with pytest.raises(ValueError, match="read-only"):
        run("scan", tmp_path / "snap", root)
    named = ("--allow-rw-source", "--server", "s1", "--server-ip", "10.0.0.1", "--volume", "v1")
    assert run("scan", tmp_path / "snap", root, *named) == "COMPLETE:2"
    with pytest.raises(ValueError, match="inside a source root"):
        run("scan", root / "snap", root, *named)
    assert run("import-scan", store, tmp_path / "snap") == "IMPORTED:2"
    assert run("import-scan", store, tmp_path / "snap") == "ALREADY_IMPORTED"
    assert "s1" in run("volumes", store) and registry.reports(spark, store).first().report_id in run("reports", store)
    out = tmp_path / "out"
    assert run("compare", store, out) == "PATHS:2"
    totals = json.loads((out / "summary.json").read_text())
    assert totals["MATCH"] == 1 and totals["COPY_LIST_FILES"] == 1
    assert (out / "missing_on_lto_absolute_paths.nul").read_bytes() == os.fsencode(root) + b"/prj/new.bin\0"
    assert (out / "copy_lists_by_root" / "root_01_relative_paths.nul").read_bytes() == b"prj/new.bin\0"
    assert (out / "copy_lists_by_root" / "roots.csv").read_text("utf-8-sig").splitlines()[1] == f"root_01,{root},root_01_relative_paths.txt,root_01_relative_paths.nul"
    assert (out / "parse_issues.csv").exists() and (out / "scan_issues.csv").exists()
    with pytest.raises(ValueError, match="inside a source root"):
        run("deletable-folders", store, root / "del")
    assert run("deletable-folders", store, tmp_path / "del") == "SAFE:0"
    assert "BLOCKED" in (tmp_path / "del" / "blocked_folders.csv").read_text() and "prj  " in capsys.readouterr().out
    assert run("discover", store, tmp_path / "map") == "FOLDERS:1"
    # another address of a known server
    assert run("scan", tmp_path / "snap2", root, "--allow-rw-source", "--server", "s1", "--server-ip", "10.0.0.2", "--volume", "v1") == "COMPLETE:2"
    with pytest.raises(ValueError, match="server conflict"):
        run("import-scan", store, tmp_path / "snap2")
    # a report changed in place, and one in place of all earlier ones
    (tmp_path / "r.txt").write_text(REPORT.replace("a.mov", "z.mov"))
    with pytest.raises(ValueError, match="changed"):
        run("import-report", store, tmp_path / "r.txt")
    assert run("import-report", store, tmp_path / "r.txt", "--replace", "--units", "binary") == "IMPORTED:5"
    assert registry.imported(spark, store, "manifest").count() == 5 and registry.reports(spark, store).first().units == "binary"
    with pytest.raises(ValueError, match="unknown report"):
        run("compare-catalog", store, "P", tmp_path / "cat", "--report", "none")


def test_everything_in_one_command(spark, tmp_path):
    from tallyforge.__main__ import main

    (tmp_path / "src" / "prj").mkdir(parents=True)
    (tmp_path / "src" / "prj" / "card1.png").write_bytes(b"x" * 2000)
    (tmp_path / "r.txt").write_text(REPORT)
    done = main(["all", str(tmp_path / "store"), str(tmp_path / "r.txt"), str(tmp_path / "out"), str(tmp_path / "src"), "--allow-rw-source"], spark)
    assert done == "CREATED IMPORTED:5 COMPLETE:1 IMPORTED:1 PATHS:1 SAFE:1"
    assert (tmp_path / "out" / "folders" / "deletable_folders.nul").read_bytes() == os.fsencode(tmp_path / "src") + b"/prj\0"


def test_older_stores_are_read_and_migrated(spark, tmp_path):
    store = str(tmp_path)
    cols = "content_sha256 string, source string, kind string, units string, rows long, imported_at timestamp, schema_version int"
    rows = [("b", "two", "catalog", None, 1, datetime(2024, 1, 2), 3), ("a", "one", "catalog", "", 1, datetime(2024, 1, 1), 2)]
    spark.createDataFrame(rows, cols).write.parquet(f"{store}/registry")
    assert {(r.source, r.units, r.seq) for r in registry.registry(spark, store).collect()} == {("one", "", 0), ("two", "", 0)}
    assert registry.init_store(spark, store) == "MIGRATED" and registry.init_store(spark, store) == "CURRENT"
    assert {(r.source, r.seq, r.schema_version) for r in registry.registry(spark, store).collect()} == {("one", 1, 4), ("two", 2, 4)}
    registry.register(spark, store, [("catalog", 1, "c")], "three", replace=True)
    assert [r.source for r in registry.registry(spark, store).collect()] == ["three"]
    spark.createDataFrame([("d", "x", "catalog", "", 1, datetime(2024, 1, 1), 99, 1)], registry.REGISTRY).write.mode("append").parquet(f"{store}/registry")
    with pytest.raises(ValueError, match="version 99"):
        registry.registry(spark, store)


def test_source_folders_and_mappings(spark, tmp_path):
    raid = tmp_path / "raid"
    for p in ("Show/SOURCE/DayOne", "Show/SOURCE/.hidden", "Show/source2", "Deep/a/Source/x", "SOURCE/SOURCE/y"):
        (raid / p).mkdir(parents=True)
    (raid / "Show" / "SOURCE" / "DayOne" / "clip.mov").write_bytes(b"123")
    os.symlink(raid / "Show", raid / "link")
    found, issues = roots.find_sources([str(raid)], 2)
    assert [(s.project, s.path) for s in found] == [("Show", str(raid / "Show/SOURCE")), ("raid", str(raid / "SOURCE"))] and not issues
    assert [s.project for s in roots.find_sources([str(raid)], 3)[0]] == ["a", "Show", "raid"]
    assert [p for _, p in roots.top_folders(found)[0]] == [str(raid / "Show/SOURCE/DayOne"), str(raid / "SOURCE/SOURCE")]
    assert roots.find_sources([str(tmp_path / "none")], 1)[1]
    with pytest.raises(ValueError):
        roots.find_sources([str(raid)], 0)

    def mapping(*rows, columns=roots.MAPPING):
        path = tmp_path / "m.csv"
        path.write_text("\n".join([",".join(columns), *(",".join(r) for r in rows)]), encoding="utf-8-sig")
        return str(path)

    src, day = str(raid / "Show/SOURCE"), str(raid / "Show/SOURCE/DayOne")
    good = ("Shoot 1", "shoot 1", "MATCHED", src, day)
    assert roots.matched_roots(mapping(good, ("x", "x", "NOT_FOUND", "", ""))) == [roots.MappedRoot(src, day, "Shoot 1")]
    for bad in (
        [("a/b", "a/b", "MATCHED", src, day)], [("Shoot", "Shoot", "MATCHED", src, day)], [("s", "s", "MATCHED", "rel", day)], [("s", "s", "MATCHED", str(raid / "link/SOURCE/.."), day)], [("s", "s", "MATCHED", str(raid / "link"), day)],
        [("s", "s", "MATCHED", src, "rel")], [("s", "s", "MATCHED", src, str(raid / "gone"))], [("s", "s", "MATCHED", str(raid), day)], [good, ("other", "other", "MATCHED", src, day)], [("x", "x", "AMBIGUOUS", src, day)],
    ):
        with pytest.raises((ValueError, NotADirectoryError)):
            roots.matched_roots(mapping(*bad))
    with pytest.raises(ValueError, match="physical_folder"):
        roots.matched_roots(mapping(columns=roots.MAPPING[:-1]))
    # a mapped scan: logical names in the keys, physical bytes as they are
    from tallyforge.__main__ import main

    assert main(["scan", str(tmp_path / "snap"), "--mapping", mapping(good), "--allow-rw-source"], spark) == "COMPLETE:1"
    row = snapshot.read_snapshot(spark, str(tmp_path / "snap"))[0].first()
    assert (row.source_root, bytes(row.relative_path_bytes), row.norm_path) == (src, b"DayOne/clip.mov", "shoot 1/clip.mov")


def test_mounts(tmp_path):
    table = tmp_path / "mounts"
    table.write_text("none / ext4 rw 0 0\nd /mnt/my\\040disk xfs ro,noatime 0 0\ns /mnt/far nfs4 ro 0 0\n")
    assert roots.mount_of("/mnt/my disk/a", str(table)) == ("xfs", {"ro", "noatime"})
    assert roots.mount_of("/mnt/mine", str(table))[0] == "ext4"
    roots.require_local("/mnt/my disk", str(table))
    for path in ("/mnt/far/x",):
        with pytest.raises(ValueError, match="nfs4"):
            roots.require_local(path, str(table))
    assert roots.require_read_only(["/mnt/my disk"], table=str(table)) == []
    with pytest.raises(ValueError, match="read-only"):
        roots.require_read_only(["/home"], table=str(table))
    assert len(roots.require_read_only(["/home"], True, str(table))) == 1
    assert roots.mount_of("/x", str(tmp_path / "none")) is None


def test_tables_for_people():
    assert sinks.text_table(["A", "B"], [["x" * 50, 1], ["y", None]]).splitlines() == ["A" + " " * 41 + "B", "-" * 40 + "  -", "x" * 37 + "...  1", "y"]
    assert sinks.folder_labels([("/a/r", "p"), ("/b/r", "p"), ("/a/r", "q")]) == ["p [root_01]", "p [root_02]", "q"]
    assert sinks.folder_labels([("/a", "p"), ("/b", "p")]) == ["p [a]", "p [b]"]


def test_scans_spread_and_go_on_after_errors(spark, tmp_path, monkeypatch):
    for i in range(3):
        (tmp_path / "top" / f"d{i}").mkdir(parents=True)
        for k in range(7):
            (tmp_path / "top" / f"d{i}" / f"f{k}").write_bytes(b"1")
    (tmp_path / "near").write_bytes(b"22")
    monkeypatch.setattr(filesystem, "CHUNK", 3)
    found = filesystem.scan(spark, [str(tmp_path)])
    assert found.count() == 22 and filesystem.scan(spark, [str(tmp_path)], {str(tmp_path): [b"top"]}).count() == 21
    assert filesystem.scan(spark, [str(tmp_path / "none")]).first().issue_type == "directory_read_error:FileNotFoundError"


def test_unread_folders_are_never_safe(spark, tmp_path, monkeypatch):
    from tallyforge import __main__ as cli

    def run(name, read_error, lost=0):
        root, store, snap = tmp_path / name / "src", str(tmp_path / name / "store"), str(tmp_path / name / "snap")
        (root / "prj").mkdir(parents=True)
        (root / "prj" / "card1.png").write_bytes(b"x" * 2000)
        report = tmp_path / name / "r.txt"
        report.write_text(REPORT)
        found = filesystem.scan(spark, [str(root)])
        if read_error:
            found = found.unionByName(spark.createDataFrame([(str(root), None, None, None, b"prj/sub", "directory_read_error:PermissionError")], filesystem.FOUND))
        monkeypatch.setattr(filesystem, "scan", lambda *_, **__: found)
        cli.main(["import-report", store, str(report)], spark)
        cli.main(["scan", snap, str(root), "--allow-rw-source"], spark)
        if lost:
            read = snapshot.read_issues
            monkeypatch.setattr(snapshot, "read_issues", lambda *a: (lambda i, e: (i, e.withColumn("files", F.col("files") + lost)))(*read(*a)))
        cli.main(["import-scan", store, snap], spark)
        monkeypatch.undo()
        done = cli.main(["deletable-folders", store, str(tmp_path / name / "del")], spark)
        return store, done, (tmp_path / name / "del" / "folder_size_comparison.csv").read_text(), (tmp_path / name / "del" / "deletable_folders.nul").read_bytes()

    assert run("clean", False)[1] == "SAFE:1"
    for name, args, reason in (("error", (True,), "DIRECTORY_READ_ERROR"), ("short", (False, 1), "INCOMPLETE_CLASSIFICATION")):
        store, done, report, safe = run(name, *args)
        assert done == "SAFE:0" and safe == b"" and "BLOCKED" in report and reason in report
    stats = registry.imported(spark, store, "report_stats").first()
    issues = registry.imported(spark, store, "parse_issue")
    assert stats.extracted_files == 5 and stats.issues == issues.count() > 0
    assert issues.where("source_pdf is null or issue_type is null").isEmpty()


def test_issues_query_blocks_safe_folders(spark):
    from tallyforge.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    safe = {(r.source_root, r.folder_name) for r in QUERIES["folder_strict_decision"](spark, sf).where("decision = 'SAFE_TO_DELETE'").collect()}
    got = {(r.source_root, r.folder_name): r for r in QUERIES["folder_decision_with_issues"](spark, sf).collect()}
    assert all((got[k].decision == "SAFE_TO_DELETE") == (k[0].endswith("VIDEO0/SOURCE") and not k[1].startswith("prj_1")) for k in safe)
    assert {"", "DIRECTORY_READ_ERROR", "INCOMPLETE_CLASSIFICATION"} <= {got[k].blocking_reasons for k in safe}
