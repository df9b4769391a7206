"""Small ordered files for people and tools: CSV with a byte-order mark, NUL lists, JSON."""

from __future__ import annotations

import csv
import json
import os
import shlex

from pyspark.sql import DataFrame


def refuse(path: str, roots: list[str]) -> None:
    """Outputs must be new, no link, and outside every source root."""
    real = os.path.realpath(path)
    if os.path.lexists(path):
        raise FileExistsError(path)
    for r in map(os.path.realpath, roots):
        if real == r or real.startswith(r.rstrip("/") + "/"):
            raise ValueError(f"output inside a source root: {path}")


def new_folder(path: str, roots: list[str]) -> None:
    refuse(path, roots)
    os.makedirs(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> int:
    """One UTF-8 CSV with a byte-order mark; rows are sorted by Spark and streamed a partition at a time."""
    n = 0
    with open(path, "x", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.orderBy(*order).toLocalIterator(prefetchPartitions=True):
            out.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def write_nul_list(df: DataFrame, column: str, path: str) -> None:
    """Raw path bytes, each ended by NUL, sorted."""
    with open(path, "xb") as f:
        for (raw,) in df.select(column).orderBy(column).toLocalIterator():
            f.write(bytes(raw) + b"\0")


def write_shell_list(df: DataFrame, column: str, path: str) -> None:
    with open(path, "x", encoding="utf-8") as f:
        for (text,) in df.select(column).orderBy(column).toLocalIterator():
            f.write(shlex.quote(text) + "\n")


def write_text_list(df: DataFrame, column: str, path: str) -> None:
    with open(path, "x", encoding="utf-8", errors="backslashreplace", newline="\n") as f:
        for (text,) in df.select(column).orderBy(column).toLocalIterator():
            f.write(f"{text}\n")


def write_root_lists(df: DataFrame, folder: str) -> int:
    """Of (source_root, norm_path, relative_path, relative_path_bytes): a text and a NUL list for each root, and roots.csv.

    Rows are sorted by Spark and streamed a partition at a time; one pair of files is open.
    """
    os.makedirs(folder)
    roots, text, raw = [], None, None
    try:
        for r in df.orderBy("source_root", "norm_path", "relative_path_bytes").toLocalIterator(prefetchPartitions=True):
            if not roots or roots[-1] != r["source_root"]:
                roots.append(r["source_root"])
                for f in (text, raw):
                    if f:
                        f.close()
                base = os.path.join(folder, f"root_{len(roots):02d}_relative_paths")
                text, raw = open(f"{base}.txt", "x", encoding="utf-8", errors="backslashreplace", newline="\n"), open(f"{base}.nul", "xb")
            text.write(r["relative_path"] + "\n")
            raw.write(bytes(r["relative_path_bytes"]) + b"\0")
    finally:
        for f in (text, raw):
            if f:
                f.close()
    with open(os.path.join(folder, "roots.csv"), "x", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(["list_id", "source_root", "text_file", "nul_file"])
        for i, root in enumerate(roots, 1):
            out.writerow([f"root_{i:02d}", root, f"root_{i:02d}_relative_paths.txt", f"root_{i:02d}_relative_paths.nul"])
    return len(roots)


WIDEST = 40


def text_table(headings: list[str], rows: list[list], widest: int = WIDEST) -> str:
    """Columns as wide as their longest text; the first column is cut at ``widest``."""
    cells = [["" if v is None else str(v) for v in r] for r in rows]
    for r in cells:
        if len(r[0]) > widest:
            r[0] = r[0][: widest - 3] + "..."
    widths = [max(len(x) for x in column) for column in zip(headings, *cells, strict=True)]
    shown = [headings, ["-" * w for w in widths], *cells]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in shown)


def folder_labels(folders: list[tuple[str, str]]) -> list[str]:
    """Names of (root, folder): a name that several roots have gets its root's last part, or a number where those agree too."""
    roots: dict[str, list[str]] = {}
    for root, name in folders:
        roots.setdefault(name, []).append(root)
    out = []
    for root, name in folders:
        own = sorted(set(roots[name]))
        if len(own) > 1:
            ends = [os.path.basename(r.rstrip("/")) or r for r in own]
            place = own.index(root)
            name += f" [{ends[place] if len(set(ends)) == len(ends) else f'root_{place + 1:02d}'}]"
        out.append(name)
    return out


def write_json(values: dict, path: str) -> None:
    with open(path, "x", encoding="utf-8") as f:
        json.dump(values, f, ensure_ascii=False, indent=2, sort_keys=True)
