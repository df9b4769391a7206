"""Report lines to manifest entries.

The record grammar is sequential (a record may swallow the lines of the next), so each report
is one group of ``applyInPandas``; reports spread over the cluster. Header fields, wrapped
paths and frame counts also exist as native expressions for use on line tables.
"""

from __future__ import annotations

import json
import re
from decimal import ROUND_CEILING, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import fold, normal_path

#: Fixed values of the report format: units, field patterns, and fields that end a wrapped path.
UNIT = r"([0-9]+(?:\.[0-9]+)?)\s*(B|KB|MB|GB|TB)\s*$"
RECORD = re.compile(r"^(Name|First)\s*:\s*(.*?)\s+Size\s*:\s*" + UNIT)
COLLIDED = re.compile(r"^(Name)\s*:\s*(.*?(?:Size|Si\d+ze))\s*:\s*" + UNIT)
LAST = re.compile(r"^Last\s*:\s*(.*?)\s+Size\s*:\s*" + UNIT)
PATH = re.compile(r"^Path\s*:\s*(/Volumes/.*)$")
TOTAL = re.compile(r"Total\s+Files\s*:\s*(\d+)", re.IGNORECASE)
PROJECT = re.compile(r"Project\s*:\s*(.*?)\s{2,}(?:Collection\s*:|$)", re.IGNORECASE)
FRAMES = re.compile(r"Frames\s*:\s*(\d+)", re.IGNORECASE)
FIELDS = ("Page ", "Name :", "First :", "Last :", "Created :", "Modified :", "Modiﬁed :", "Path :", "Timecode :", "Duration :", "Rate :", "Frames :")
HEADER_LINES, LOOKBACK, NAME_AHEAD, SEQUENCE_AHEAD = 100, 24, 13, 17

PARSED = (
    "pdf string, kind string, page int, ord long, project string, tape string, relative_path string, reported_size string, size_min_bytes long, size_max_bytes long, "
    "size_known int, entry_kind string, sequence_id string, issue_type string, details string, expected_files long"
)


def interval(number: str, unit: str, mode: str) -> tuple[str, int, int]:
    base = {"decimal": 1000, "binary": 1024}[mode]
    value, shown = Decimal(number), f"{number} {unit}"
    if unit == "B":
        if value != int(value):
            raise ValueError(f"fraction of a byte: {shown}")
        return shown, int(value), int(value)
    m, half = base ** ("B", "KB", "MB", "GB", "TB").index(unit), Decimal(1).scaleb(value.as_tuple().exponent) / 2
    low, high = (int((x * m).to_integral_value(ROUND_CEILING)) for x in (max(Decimal(0), value - half), value + half))
    return shown, low, max(low, high - 1)


def expand_names(first: str, last: str, frames: int) -> list[str] | None:
    """Names between two that differ in exactly one number; None unless they are ``frames``."""
    a, b = list(re.finditer(r"\d+", first)), list(re.finditer(r"\d+", last))
    fits = [
        (x, int(x[0]), int(y[0]), max(len(x[0]), len(y[0])))
        for x, y in zip(a, b, strict=False)
        if len(a) == len(b) and first[: x.start()] == last[: y.start()] and first[x.end() :] == last[y.end() :] and int(y[0]) - int(x[0]) + 1 == frames and int(y[0]) >= int(x[0])
    ]
    if len(fits) != 1:
        return None
    x, lo, hi, width = fits[0]
    return [f"{first[: x.start()]}{n:0{width}d}{first[x.end() :]}" for n in range(lo, hi + 1)]


class Reader:
    """One report: a cursor over its lines that collects entries and issues."""

    def __init__(self, pdf: str, pages: list[int], lines: list[str], mode: str):
        self.pdf, self.pages, self.lines, self.mode = pdf, pages, lines, mode
        self.project, self.expected = self._header()
        self.entries: list[dict] = []
        self.issues: list[dict] = []
        self.sequences = 0

    def _header(self) -> tuple[str, int | None]:
        head = self.lines[:HEADER_LINES]
        project = re.sub(r"\.[^.]*$", "", self.pdf.rsplit("/", 1)[-1])
        for line in head:
            m = PROJECT.search(line)
            found = m[1].strip() if m else ""
            if not found and line.startswith("Project :"):
                found = re.split(r"\s{2,}Collection\s*:", line[9:].strip())[0].strip()
            if found:
                project = found
                break
        totals = (TOTAL.search(line) for line in head)
        return project, next((int(m[1]) for m in totals if m), None)

    def issue(self, kind: str, page: int, details: object) -> None:
        self.issues.append({"issue_type": kind, "page": page, "details": details if isinstance(details, str) else json.dumps(details, ensure_ascii=False)})

    @staticmethod
    def record(line: str) -> tuple | None:
        m = RECORD.match(line)
        if m:
            return (*m.groups(), False)
        m = COLLIDED.match(line)
        return (*m.groups(), True) if m else None

    def unwrapped(self, at: int, path: str) -> tuple[str, int]:
        """(path, next line): a path that ends in '/' goes on in the next line unless that starts a field."""
        more = self.lines[at + 1].strip() if path.endswith("/") and at + 1 < len(self.lines) else ""
        if not more or more.startswith(FIELDS):
            return path, at + 1
        return path + more.lstrip("/"), at + 2

    @staticmethod
    def volume(path: str) -> tuple[str, str]:
        parts = [p for p in path.split("/") if p not in ("", ".")]
        if not path.startswith("/") or len(parts) < 3 or parts[0] != "Volumes":
            raise ValueError(f"unexpected path: {path!r}")
        return parts[1], "/".join(parts[2:])

    def add(self, page: int, path: tuple[str, str], size: tuple | None, kind: str, sequence: str = "") -> None:
        shown, lo, hi = size or ("", None, None)
        self.entries.append({"page": page, "tape": path[0], "relative_path": path[1], "reported_size": shown, "size_min_bytes": lo, "size_max_bytes": hi, "size_known": int(size is not None), "entry_kind": kind, "sequence_id": sequence})

    def run(self) -> None:
        at = 0
        while at < len(self.lines):
            found = self.record(self.lines[at])
            at = at + 1 if found is None else (self.single if found[0] == "Name" else self.sequence)(at, found)

    def single(self, at: int, found: tuple) -> int:
        _, name, number, unit, collided = found
        page, line = self.pages[at], self.lines[at]
        for probe in range(at + 1, min(at + 1 + NAME_AHEAD, len(self.lines))):
            m = PATH.match(self.lines[probe])
            if m or self.record(self.lines[probe]):
                break
        else:
            m = None
        if not m:
            self.issue("record_without_path", page, line)
            return at + 1
        path, after = self.unwrapped(probe, m[1])
        try:
            place = self.volume(path)
            size = interval(number, unit, self.mode)
            file = place[1].rsplit("/", 1)[-1]
            if collided:
                self.issue("entry_line_layout_recovered", page, {"entry_line": line, "recovered_path": path, "path_filename": file})
            elif key(name) != key(file):
                self.issue("name_path_disagreement", page, {"name": name, "path_filename": file, "path": path})
            self.add(page, place, size, "regular")
        except ValueError as e:
            self.issue("record_parse_error", page, f"{line} | {e}")
        return after

    def sequence(self, at: int, found: tuple) -> int:
        _, first, number, unit, _ = found
        page, line, last, path, place = self.pages[at], self.lines[at], None, None, at
        for probe in range(at + 1, min(at + 1 + SEQUENCE_AHEAD, len(self.lines))):
            last = m.groups() if (m := LAST.match(self.lines[probe])) else last
            if m := PATH.match(self.lines[probe]):
                path, place = m[1], probe
                break
        before = (FRAMES.search(self.lines[i]) for i in range(at - 1, max(-1, at - LOOKBACK - 1), -1))
        frames = next((int(m[1]) for m in before if m), None)
        if last is None or path is None or frames is None:
            self.issue("incomplete_sequence_record", page, {"first_line": line, "last": last, "path": path, "frames": frames})
            return at + 1
        names = expand_names(first, last[0], frames)
        if not names:
            self.issue("sequence_not_expandable", page, {"first": first, "last": last[0], "frames": frames, "path": path})
            return place + 1
        path, after = self.unwrapped(place, path)
        try:
            tape, relative = self.volume(path)
            sizes = interval(number, unit, self.mode), interval(last[1], last[2], self.mode)
            self.sequences += 1
            ident = f"{self.pdf.rsplit('/', 1)[-1]}:p{page}:seq{self.sequences}"
            parent = relative.rsplit("/", 1)[0] + "/" if "/" in relative else ""
            for i, name in enumerate(names):
                if 0 < i < len(names) - 1:
                    self.issue("sequence_file_size_unknown", page, {"path": parent + name, "sequence_id": ident, "first": first, "last": last[0], "frames": frames})
                kind = "sequence_first" if i == 0 else "sequence_last" if i == len(names) - 1 else "sequence_middle_size_unknown"
                self.add(page, (tape, parent + name), {"sequence_first": sizes[0], "sequence_last": sizes[1]}.get(kind), kind, ident)
        except ValueError as e:
            self.issue("sequence_parse_error", page, f"{line} | {e}")
        return after


def key(text: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFC", text).casefold()


def _parse(pdf: pd.DataFrame, mode: str) -> pd.DataFrame:
    pdf = pdf.sort_values("line_no", kind="stable")
    r = Reader(str(pdf["pdf"].iloc[0]), pdf["page"].tolist(), pdf["line"].fillna("").tolist(), mode)
    r.run()
    if r.expected is not None and r.expected != len(r.entries):
        unknown, seq = sum(not e["size_known"] for e in r.entries), sum(bool(e["sequence_id"]) for e in r.entries)
        r.issue("total_files_mismatch", 0, {"source_pdf": r.pdf, "project": r.project, "expected_files": r.expected, "extracted_files": len(r.entries), "difference": len(r.entries) - r.expected, "sequence_files": seq, "size_unknown_files": unknown, "issues": len(r.issues)})
    rows = [{"kind": "entry", "ord": i, **e} for i, e in enumerate(r.entries)] + [{"kind": "issue", "ord": i, **e} for i, e in enumerate(r.issues)] + [{"kind": "report", "ord": 0, "expected_files": r.expected}]
    names = [c.split()[0] for c in PARSED.split(", ")]
    out = pd.DataFrame(rows).reindex(columns=names).assign(pdf=r.pdf, project=r.project)
    whole = {"size_min_bytes", "size_max_bytes", "size_known", "expected_files", "page", "ord"}
    return out.astype({c: "Int64" for c in whole}).astype({c: object for c in names if c not in whole}).where(lambda d: d.notna(), None)


def parse_lines(lines: DataFrame, units: str = "decimal") -> DataFrame:
    """Of (pdf, line_no, page, line): rows of kind 'entry', 'issue' and 'report' (one for each report)."""

    def parse(pdf: pd.DataFrame) -> pd.DataFrame:
        return _parse(pdf, units)

    return lines.groupBy("pdf").applyInPandas(parse, PARSED)


def entries(parsed: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Manifest rows with keys; the order within a report is kept in ``ord``."""
    e = parsed.where("kind = 'entry'")
    name, top = F.element_at(F.split("relative_path", "/"), -1), F.element_at(F.split("relative_path", "/"), 1)
    return e.select(
        F.col("pdf").alias("source_pdf"), F.col("page").alias("source_page"), "ord", "project", "tape", "relative_path", normal_path(F.col("relative_path"), ascii_only).alias("norm_path"), top.alias("top_folder"), fold(top, ascii_only).alias("norm_top_folder"),
        name.alias("filename"), fold(name, ascii_only).alias("norm_filename"), "reported_size", "size_min_bytes", "size_max_bytes", "size_known", "entry_kind", "sequence_id",
    )


def parse_issues(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'issue'").select(F.col("pdf").alias("source_pdf"), "page", "issue_type", "details")


def report_stats(parsed: DataFrame) -> DataFrame:
    """One row for each report, also for one without entries."""
    is_entry = F.col("kind") == "entry"
    s = parsed.groupBy(F.col("pdf").alias("source_pdf"), "project").agg(
        F.max("expected_files").alias("expected_files"), F.count_if(is_entry).alias("extracted_files"), F.count_if(is_entry & (F.col("sequence_id") != "")).alias("sequence_files"),
        F.count_if(is_entry & (F.col("size_known") == 0)).alias("size_unknown_files"), F.count_if(F.col("kind") == "issue").alias("issues"),
    )
    return s.withColumn("difference", F.col("extracted_files") - F.col("expected_files"))


# --- native forms over line tables ------------------------------------------------------------


def wrapped_paths(lines: DataFrame) -> DataFrame:
    """(pdf, line_no, path, wrapped): Path lines, joined with the next line where they end in '/'."""
    w = Window.partitionBy("pdf").orderBy("line_no")
    rows = lines.withColumn("next", F.trim(F.coalesce(F.lead("line").over(w), F.lit(""))))
    path = F.regexp_extract("line", r"^Path\s*:\s*(/Volumes/.*)$", 1)
    field = F.lit(False)
    for f in FIELDS:
        field = field | F.col("next").startswith(f)
    wrapped = path.endswith("/") & (F.col("next") != "") & ~field
    return rows.where(path != "").select("pdf", "line_no", F.when(wrapped, F.concat(path, F.regexp_replace("next", "^/+", ""))).otherwise(path).alias("path"), wrapped.alias("wrapped"))


def preceding_frames() -> Column:
    """The nearest frame count within the LOOKBACK lines before, as a window column."""
    text = F.regexp_extract("line", r"(?i)Frames\s*:\s*(\d+)", 1)
    w = Window.partitionBy("pdf").orderBy("line_no").rowsBetween(-LOOKBACK, -1)
    return F.last(F.when(text != "", text.cast("long")), ignorenulls=True).over(w)


def expanded_names(first: Column, last: Column, frames: Column, width: Column | None = None) -> Column:
    """Native form for names whose only number differs: array of names, or null.

    Numbers have ``width`` digits at least; by default as many as the longer of the two.
    """
    rx = r"^(\D*)(\d{1,18})(\D*)$"
    a, b = F.regexp_extract(first, rx, 2), F.regexp_extract(last, rx, 2)
    ok = first.rlike(rx) & last.rlike(rx) & (F.regexp_extract(first, rx, 1) == F.regexp_extract(last, rx, 1)) & (F.regexp_extract(first, rx, 3) == F.regexp_extract(last, rx, 3))
    lo, hi = a.try_cast("long"), b.try_cast("long")
    ok = ok & (hi - lo + 1 == frames) & (hi >= lo)
    width = F.greatest(F.length(a), F.length(b)) if width is None else width
    pad = lambda n: F.when(F.length(n.cast("string")) >= width, n.cast("string")).otherwise(F.lpad(n.cast("string"), width, F.lit("0")))
    return F.when(ok, F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda n: F.concat(F.regexp_extract(first, rx, 1), pad(n), F.regexp_extract(first, rx, 3))))
