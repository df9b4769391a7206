"""SQL twins of the reconciliation queries: the derived manifests and inventories as common table expressions."""

from __future__ import annotations

DERIVED = """
o AS (SELECT o_orderkey AS k, o_custkey % 97 AS g, CAST(round(o_totalprice * 100) AS BIGINT) AS sz FROM orders),
oc AS (SELECT *, CASE WHEN g < 40 AND k % 16 <> 5 THEN 99 WHEN g >= 40 AND g < 50 AND k % 16 <> 2 THEN 99 WHEN g >= 50 AND g < 60 AND k % 16 <> 3 THEN 99 ELSE k % 16 END AS c FROM o),
sr AS (
  SELECT k, g, 0 AS root, 'new0' AS dir, CASE WHEN c IN (8, 14) THEN 0 ELSE sz END AS size, CASE WHEN c = 11 THEN 0 ELSE 1 END AS valid FROM oc WHERE c <> 7
  UNION ALL SELECT k, g, 1, 'new0', sz + 7, 1 FROM oc WHERE c = 12
  UNION ALL SELECT k, g, 1, 'new0', sz, 1 FROM oc WHERE c = 13
  UNION ALL SELECT k, g, 0, 'alt0', sz, 1 FROM oc WHERE c = 15),
st AS (SELECT '/mnt/VIDEO' || root || '/SOURCE' AS source_root, 'prj_' || g || '/' || dir || '/clip_' || k || '.mov' AS path, 'prj_' || g AS top, 'clip_' || k || '.mov' AS file, valid, CAST(size AS BIGINT) AS size FROM sr),
mr AS (
  SELECT k, g, 0 AS i, 'T1' AS tape, CASE WHEN c IN (1, 10, 15) THEN 'old0' ELSE 'new0' END AS dir,
         CASE WHEN c = 2 THEN NULL WHEN c = 9 OR (c = 7 AND k % 3 = 0) THEN 0 WHEN c = 3 THEN sz + 850 ELSE sz - 50 END AS lo,
         CASE WHEN c = 2 THEN NULL WHEN c = 9 OR (c = 7 AND k % 3 = 0) THEN 0 WHEN c = 3 THEN sz + 949 ELSE sz + 49 END AS hi FROM oc WHERE c NOT IN (0, 14)
  UNION ALL SELECT k, g, 1, 'T2', CASE WHEN c = 10 THEN 'older0' ELSE 'new0' END, CASE WHEN c = 6 THEN NULL WHEN c = 4 THEN sz + 4950 ELSE sz - 50 END, CASE WHEN c = 6 THEN NULL WHEN c = 4 THEN sz + 5049 ELSE sz + 49 END FROM oc WHERE c IN (4, 5, 6, 10)),
mf AS (SELECT k * 2 + i AS id, tape, 'prj_' || g || '/' || dir || '/clip_' || k || '.mov' AS path, 'prj_' || g AS top, 'clip_' || k || '.mov' AS file, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, lo IS NOT NULL AS known,
         CASE WHEN lo IS NULL THEN '' ELSE lo || ' B' END AS shown FROM mr),
mg AS (SELECT path, count(*) AS n, count(*) FILTER (known) AS nk, count(*) FILTER (NOT known) AS nu, count(DISTINCT CASE WHEN known THEN lo || ':' || hi END) AS nr, min(lo) AS lo, max(hi) AS hi,
         count(*) FILTER (lo = 0 AND hi = 0) AS nz, min_by(top, id) AS top, min_by(file, id) AS file FROM mf GROUP BY path),
mk AS (SELECT *, CASE WHEN n <= 1 THEN 'none' WHEN nr > 1 THEN 'conflicting_known_intervals' WHEN nu > 0 THEN 'contains_unknown_size' ELSE 'identical' END AS kind FROM mg),
sg AS (SELECT path, count(*) AS copies, count(DISTINCT size) AS sizes FROM st GROUP BY path),
sk AS (SELECT *, CASE WHEN copies <= 1 THEN 'none' WHEN sizes = 1 THEN 'identical' ELSE 'different_sizes' END AS kind FROM sg)"""

CLASSIFIED = (
    DERIVED
    + """,
d AS (SELECT st.*, sk.kind AS storage_kind, coalesce(mk.kind, 'none') AS path_kind, coalesce(mk.n, 0) AS n, CASE WHEN valid = 0 THEN 'INVALID_FILESYSTEM_ENCODING' WHEN sk.kind = 'different_sizes' THEN 'AMBIGUOUS_STORAGE_DUPLICATE_SIZES'
        WHEN size = 0 THEN CASE WHEN mk.n > 0 THEN 'ZERO_SIZE_STORAGE' ELSE 'ZERO_SIZE_STORAGE_ONLY' END WHEN mk.n IS NULL THEN 'PENDING' WHEN nr > 1 THEN 'CONFLICTING_LTO_ENTRIES'
        WHEN nk > 0 AND nu > 0 THEN 'AMBIGUOUS_LTO_SIZE_UNKNOWN' WHEN nk = 0 THEN 'MATCH_PATH_ONLY_SIZE_UNKNOWN' WHEN size BETWEEN lo AND hi THEN 'MATCH' ELSE 'SIZE_MISMATCH' END AS direct
      FROM st JOIN sk USING (path) LEFT JOIN mk USING (path)),
mo AS (SELECT * FROM mk WHERE path NOT IN (SELECT path FROM st)),
ms AS (SELECT * FROM mo WHERE nr = 1 AND nu = 0),
mp AS (SELECT DISTINCT d.path, d.size, ms.path AS from_path, ms.lo, ms.hi, ms.n FROM d JOIN ms ON d.top = ms.top AND d.file = ms.file AND d.size BETWEEN ms.lo AND ms.hi WHERE direct = 'PENDING'),
mc AS (SELECT from_path, count(DISTINCT path) AS claimed FROM mp GROUP BY from_path),
mv AS (SELECT path, size, count(*) AS cands, max(claimed) > 1 AS many, min(from_path) AS from_path, sum(n) AS entries, count(DISTINCT lo || ':' || hi) AS ranges FROM mp JOIN mc USING (from_path) GROUP BY path, size),
cl0 AS (SELECT d.*, mv.from_path, mv.entries, mv.ranges, CASE WHEN direct <> 'PENDING' THEN direct WHEN {moved} AND cands = 1 AND NOT many THEN 'POSSIBLE_MOVED_WITHIN_TOP_FOLDER' WHEN {moved} AND cands >= 1 THEN 'AMBIGUOUS_POSSIBLE_MOVE' ELSE 'MISSING_ON_LTO' END AS status
       FROM d LEFT JOIN mv ON d.path = mv.path AND d.size = mv.size),
cl AS (SELECT *, CASE WHEN status IN ('POSSIBLE_MOVED_WITHIN_TOP_FOLDER', 'AMBIGUOUS_POSSIBLE_MOVE') THEN CASE WHEN entries <= 1 THEN 'none' WHEN ranges > 1 THEN 'conflicting_known_intervals' ELSE 'identical' END ELSE path_kind END AS lto_kind,
         status = 'MATCH' AND size > 0 AND valid = 1 AS verified FROM cl0),
rp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY lower(source_root), path) AS rn FROM cl) WHERE rn = 1),
used AS (SELECT DISTINCT mp.from_path AS path FROM mp JOIN rp USING (path, size) WHERE rp.status IN ('POSSIBLE_MOVED_WITHIN_TOP_FOLDER', 'AMBIGUOUS_POSSIBLE_MOVE')),
ml AS (SELECT *, CASE WHEN nz = n THEN 'ZERO_SIZE_LTO_ONLY' ELSE 'MISSING_ON_STORAGE' END AS status FROM mo WHERE path NOT IN (SELECT path FROM used)),
zr AS (SELECT path, nz, CASE WHEN path IN (SELECT path FROM st) THEN 1 ELSE 0 END AS on_storage FROM mk WHERE nz > 0 AND (path IN (SELECT path FROM st) OR path IN (SELECT path FROM ml)))"""
)


def derived(tail: str) -> str:
    return f"WITH {DERIVED}\n{tail}"


def classified(tail: str, moved: bool = True) -> str:
    return f"WITH {CLASSIFIED.replace('{moved}', 'TRUE' if moved else 'FALSE')}\n{tail}"


FOLDERS = """,
bl AS (SELECT *, list_filter([
   CASE status WHEN 'MISSING_ON_LTO' THEN 'MISSING_ON_LTO' WHEN 'SIZE_MISMATCH' THEN 'SIZE_MISMATCH' WHEN 'ZERO_SIZE_STORAGE' THEN 'ZERO_SIZE' WHEN 'ZERO_SIZE_STORAGE_ONLY' THEN 'ZERO_SIZE' WHEN 'MATCH_PATH_ONLY_SIZE_UNKNOWN' THEN 'UNKNOWN_LTO_SIZE'
     WHEN 'AMBIGUOUS_LTO_SIZE_UNKNOWN' THEN 'UNKNOWN_LTO_SIZE' WHEN 'POSSIBLE_MOVED_WITHIN_TOP_FOLDER' THEN 'POSSIBLE_MOVED' WHEN 'AMBIGUOUS_POSSIBLE_MOVE' THEN 'AMBIGUOUS_MATCH' WHEN 'INVALID_FILESYSTEM_ENCODING' THEN 'INVALID_FILESYSTEM_ENCODING'
     WHEN 'CONFLICTING_LTO_ENTRIES' THEN 'CONFLICTING_LTO_ENTRIES' WHEN 'AMBIGUOUS_STORAGE_DUPLICATE_SIZES' THEN 'DUPLICATE_ON_STORAGE_DIFFERENT_SIZES' END,
   CASE WHEN size = 0 AND status NOT LIKE 'ZERO_SIZE%' THEN 'ZERO_SIZE' END,
   CASE WHEN lto_kind = 'conflicting_known_intervals' AND status <> 'CONFLICTING_LTO_ENTRIES' THEN 'CONFLICTING_LTO_ENTRIES' END,
   CASE WHEN lto_kind = 'contains_unknown_size' AND status NOT IN ('MATCH_PATH_ONLY_SIZE_UNKNOWN', 'AMBIGUOUS_LTO_SIZE_UNKNOWN') THEN 'UNKNOWN_LTO_SIZE' END,
   CASE WHEN storage_kind = 'different_sizes' AND status <> 'AMBIGUOUS_STORAGE_DUPLICATE_SIZES' THEN 'DUPLICATE_ON_STORAGE_DIFFERENT_SIZES' END], lambda x: x IS NOT NULL) AS reasons FROM cl),
ex AS (SELECT path, sum(t - 1) AS extra FROM (SELECT path, lo, hi, count(DISTINCT tape) AS t FROM mf WHERE known GROUP BY ALL) GROUP BY path),
pt AS (SELECT mk.path, top, CASE WHEN nr = 1 THEN 1 ELSE 0 END AS known, CASE WHEN nu > 0 THEN 1 ELSE 0 END AS unk, CASE WHEN nr > 1 THEN 1 ELSE 0 END AS conf, coalesce(extra, 0) AS extra, CASE WHEN nr = 1 THEN lo ELSE 0 END AS lo, CASE WHEN nr = 1 THEN hi ELSE 0 END AS hi FROM mk LEFT JOIN ex USING (path)),
fp AS (SELECT DISTINCT source_root, top, path FROM cl),
mt AS (SELECT fp.source_root, fp.top, count(*) AS pc, sum(known) AS kc, sum(unk) AS uc, sum(conf) AS cc, sum(extra) AS xc, sum(lo) AS lo, sum(hi) AS hi FROM fp JOIN pt USING (path) GROUP BY ALL),
wt AS (SELECT top, count(*) AS pc, sum(known) AS kc, sum(unk) AS uc, sum(conf) AS cc, sum(extra) AS xc, sum(lo) AS lo, sum(hi) AS hi FROM pt GROUP BY ALL),
cv AS (SELECT fp.source_root, fp.top, count(*) AS sp, count(*) FILTER (pt.top = fp.top) AS cov FROM fp LEFT JOIN pt USING (path) GROUP BY ALL),
fr AS (SELECT source_root, top, list_sort(list_distinct(flatten(list(reasons)))) AS reasons, count(*) FILTER (NOT verified AND len(reasons) = 0) AS odd FROM bl GROUP BY ALL),
ff AS (SELECT source_root, top, count(*) AS files, CAST(sum(size) AS BIGINT) AS size, count(*) FILTER (verified) AS ver, count(*) FILTER (status = 'MATCH') AS m, count(*) FILTER (status = 'MATCH_PATH_ONLY_SIZE_UNKNOWN') AS u, count(*) FILTER (status = 'SIZE_MISMATCH') AS x,
         count(*) FILTER (status IN ('POSSIBLE_MOVED_WITHIN_TOP_FOLDER', 'AMBIGUOUS_POSSIBLE_MOVE', 'AMBIGUOUS_LTO_SIZE_UNKNOWN', 'AMBIGUOUS_STORAGE_DUPLICATE_SIZES')) AS amb, count(*) FILTER (size = 0) AS z, count(*) FILTER (valid = 0) AS inv FROM cl GROUP BY ALL),
fo AS (SELECT ff.*, fr.reasons, fr.odd, CAST(coalesce(mt.pc, 0) AS BIGINT) AS mpc, CAST(coalesce(mt.kc, 0) AS BIGINT) AS mkc, CAST(coalesce(mt.uc, 0) AS BIGINT) AS muc, CAST(coalesce(mt.cc, 0) AS BIGINT) AS mcc, CAST(coalesce(mt.xc, 0) AS BIGINT) AS mxc, CAST(coalesce(mt.lo, 0) AS BIGINT) AS mlo, CAST(coalesce(mt.hi, 0) AS BIGINT) AS mhi,
         CAST(coalesce(wt.pc, 0) AS BIGINT) AS wpc, CAST(coalesce(wt.kc, 0) AS BIGINT) AS wkc, CAST(coalesce(wt.uc, 0) AS BIGINT) AS wuc, CAST(coalesce(wt.cc, 0) AS BIGINT) AS wcc, CAST(coalesce(wt.xc, 0) AS BIGINT) AS wxc, CAST(coalesce(wt.lo, 0) AS BIGINT) AS wlo, CAST(coalesce(wt.hi, 0) AS BIGINT) AS whi,
         cv.sp - cv.cov AS so, coalesce(wt.pc, 0) - cv.cov AS lo_only
       FROM ff JOIN fr USING (source_root, top) LEFT JOIN mt USING (source_root, top) LEFT JOIN wt USING (top) JOIN cv USING (source_root, top)),
sv AS (SELECT *, wpc > 0 AND wkc > 0 AND wcc = 0 AS usable, CASE WHEN odd > 0 THEN 1 ELSE 0 END AS si FROM fo),
so AS (SELECT *, usable AND ((CAST(wlo - size AS HUGEINT) * 100000000 <= CAST(size AS HUGEINT) * 100000 AND CAST(size - whi AS HUGEINT) * 100000000 <= CAST(size AS HUGEINT) * 100000) OR greatest(wlo - size, size - whi, 0) <= 10485760) AS ok FROM sv),
vb AS (SELECT *, files = wpc AND so = 0 AND lo_only = 0 AND wcc = 0 AND amb = 0 AND z = 0 AND si = 0 AND inv = 0 AND files > 0 AND ok AS base FROM so),
vd AS (SELECT *, CASE WHEN base AND m = files AND x = 0 AND wuc = 0 THEN 'YES' WHEN base AND u > 0 AND m + u = files AND x = 0 AND wuc > 0 THEN 'YES_WITH_UNKNOWN_SIZE' WHEN base AND x > 0 AND m + u + x = files THEN 'YES_WITH_FILE_WARNINGS' ELSE 'NO' END AS result,
         array_to_string(list_filter([CASE WHEN wpc = 0 THEN 'NO_LTO_FOLDER' END, CASE WHEN wuc > 0 THEN 'UNKNOWN_LTO_SIZE' END, CASE WHEN wcc > 0 THEN 'CONFLICTING_LTO_ENTRIES' END, CASE WHEN so > 0 THEN 'STORAGE_ONLY_PATH' END, CASE WHEN lo_only > 0 THEN 'LTO_ONLY_PATH' END, CASE WHEN x > 0 THEN 'SIZE_MISMATCH' END,
           CASE WHEN amb > 0 OR (files - m - u <> 0 AND NOT (x > 0 OR amb > 0 OR so > 0 OR z > 0 OR inv > 0)) THEN 'AMBIGUOUS_PATH' END, CASE WHEN files <> wpc THEN 'FILE_COUNT_MISMATCH' END, CASE WHEN usable AND NOT ok THEN 'SIZE_OUTSIDE_TOLERANCE' END, CASE WHEN z > 0 THEN 'ZERO_SIZE_FILE' END,
           CASE WHEN si > 0 OR files = 0 THEN 'SCAN_INCOMPLETE' END, CASE WHEN inv > 0 THEN 'INVALID_FILESYSTEM_ENCODING' END], lambda x: x IS NOT NULL), ' | ') AS why FROM vb)"""


def folders(tail: str) -> str:
    return classified("", True).rstrip() + FOLDERS + "\n" + tail


def human(v: str) -> str:
    """SQL of human_bytes for a whole number below 2^53."""
    out = f"CASE WHEN {v} < 1024 THEN {v} || ' B'"
    for i, u in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB"), (5, "PiB")):
        p = 1 << (10 * i)
        last = f"WHEN {v} < {p << 10}" if i < 5 else "ELSE"
        q = f"({v} * 100 // {p} + CASE WHEN 2 * ({v} * 100 % {p}) > {p} OR (2 * ({v} * 100 % {p}) = {p} AND ({v} * 100 // {p}) % 2 = 1) THEN 1 ELSE 0 END)"
        out += f" {last}{' THEN' if i < 5 else ''} {q} // 100 || '.' || lpad(CAST({q} % 100 AS VARCHAR), 2, '0') || ' {u}'"
    return f"({out} END)"


def signed(v: str) -> str:
    return f"(CASE WHEN {v} > 0 THEN '+' WHEN {v} < 0 THEN '-' ELSE '' END || {human(f'abs({v})')})"
