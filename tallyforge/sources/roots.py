"""Source folders on the driver's mounts: finding them, mapping them to report folders, guarding them.

Only folder names are listed here; files are walked by tasks (``filesystem.scan``).
"""

from __future__ import annotations

import csv
import os
from dataclasses import dataclass

from .lines import key

SOURCE = "source"  # folded name of a source folder
#: Columns that a mapping must have.
MAPPING = ("lto_top_folder", "normalized_lto_top_folder", "status", "source_directory", "physical_folder")
#: File systems that are served over a network.
REMOTE = ("cifs", "smb3", "nfs", "nfs4", "sshfs", "fuse.sshfs")


@dataclass(frozen=True)
class Source:
    root: str
    project: str  # name of the folder that holds the source folder
    path: str


def shown(path: str) -> str:
    """Text for people; bytes that are no UTF-8 are shown as \\xNN."""
    return os.fsencode(path).decode("utf-8", "backslashreplace")


def _subfolders(folder: str, issues: list[str]) -> list[os.DirEntry]:
    """Folders right below, without dot names and links, by folded name; what can't be read becomes an issue."""
    try:
        with os.scandir(folder) as found:
            entries = [e for e in found if not e.name.startswith(".")]
    except OSError as e:
        issues.append(f"directory_read_error:{shown(folder)}:{e!r}")
        return []
    out = []
    for e in sorted(entries, key=lambda x: (key(x.name), x.name)):
        try:
            if e.is_dir(follow_symlinks=False):
                out.append(e)
        except OSError as x:
            issues.append(f"directory_stat_error:{shown(e.path)}:{x!r}")
    return out


def find_sources(roots: list[str], max_depth: int) -> tuple[list[Source], list[str]]:
    """Folders named SOURCE at most ``max_depth`` levels below the roots, and issues; nothing is searched below a hit."""
    if max_depth < 1:
        raise ValueError("the search depth must be at least 1")
    found, issues = [], []
    for root in roots:
        level = [root]
        for _ in range(max_depth):
            below = [(folder, e) for folder in level for e in _subfolders(folder, issues)]
            found += [Source(root, shown(os.path.basename(folder)), e.path) for folder, e in below if key(e.name) == SOURCE]
            level = [e.path for _, e in below if key(e.name) != SOURCE]
    return sorted(found, key=lambda s: (key(s.root), key(s.path), s.path)), issues


def top_folders(sources: list[Source]) -> tuple[list[tuple[Source, str]], list[str]]:
    """(source, path) of the folders right below each source folder, and issues."""
    issues: list[str] = []
    return [(s, e.path) for s in sources for e in _subfolders(s.path, issues)], issues


@dataclass(frozen=True)
class MappedRoot:
    source: str
    physical: str
    logical_top: str


def _folder(path: str, what: str) -> str:
    if not os.path.isabs(path):
        raise ValueError(f"{what} must be absolute: {path}")
    if os.path.islink(path):
        raise ValueError(f"{what} must not be a link: {path}")
    real = os.path.realpath(path)
    if not os.path.isdir(real):
        raise NotADirectoryError(f"{what} is not available: {path}")
    return real


def matched_roots(mapping: str) -> list[MappedRoot]:
    """The MATCHED rows of a discovery mapping, every one checked; sorted by source, then report folder."""
    with open(mapping, encoding="utf-8-sig", newline="") as f:
        reader = csv.DictReader(f)
        missing = sorted(set(MAPPING) - set(reader.fieldnames or ()))
        if missing:
            raise ValueError(f"mapping lacks columns: {', '.join(missing)}")
        rows = [r for r in reader if r["status"] == "MATCHED"]
    out: list[MappedRoot] = []
    for r in rows:
        logical = r["lto_top_folder"]
        if not logical or set(logical) & {"/", "\\"}:
            raise ValueError(f"not the name of a report folder: {logical!r}")
        if key(logical) != r["normalized_lto_top_folder"]:
            raise ValueError(f"normalised name differs: {logical!r}")
        source, physical = _folder(r["source_directory"], "source folder"), _folder(r["physical_folder"], "physical folder")
        if os.path.dirname(physical) != source:
            raise ValueError(f"not right below its source folder: {physical}")
        out.append(MappedRoot(source, physical, logical))
    for what, values in (("physical folder", [m.physical for m in out]), ("report folder", [key(m.logical_top) for m in out])):
        twice = sorted({v for v in values if values.count(v) > 1})
        if twice:
            raise ValueError(f"{what} mapped more than once: {twice[0]}")
    if not out:
        raise ValueError("mapping has no MATCHED folder")
    return sorted(out, key=lambda m: (key(m.source), key(m.logical_top), m.physical))


def mount_of(path: str, table: str = "/proc/mounts") -> tuple[str, set[str]] | None:
    """(file system, options) of the mount that holds the path; None where that can't be told."""
    real, best = os.path.realpath(path), None
    try:
        with open(table, encoding="utf-8", errors="surrogateescape") as f:
            mounts = [line.split() for line in f]
    except OSError:
        return None
    for fields in mounts:
        if len(fields) < 4:
            continue
        point = fields[1].replace("\\040", " ").replace("\\011", "\t").replace("\\134", "\\")
        inside = real == point or real.startswith(point.rstrip("/") + "/")
        if inside and (best is None or len(point) >= len(best[0])):  # the last of equal ones is on top
            best = (point, fields[2].lower(), set(fields[3].split(",")))
    return best and best[1:]


def require_local(root: str, table: str = "/proc/mounts") -> None:
    found = mount_of(root, table)
    if found is None:
        raise ValueError(f"file system can't be told: {root}")
    if found[0] in REMOTE:
        raise ValueError(f"not a local volume but {found[0]}: {root}")


def require_read_only(roots: list[str], allow_writable: bool = False, table: str = "/proc/mounts") -> list[str]:
    """Warnings; a root that is writable, or can't be told, is an error unless allowed."""
    warnings = []
    for root in roots:
        found = mount_of(root, table)
        if found is not None and "ro" in found[1]:
            continue
        text = f"mount can't be told: {root}" if found is None else f"not mounted read-only: {root}"
        if not allow_writable:
            raise ValueError(text)
        warnings.append(text)
    return warnings
