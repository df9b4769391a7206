"""Named queries over the driver's tables and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, sizes
from ..operators import archive, classify, compare, discovery, folders
from ..sources import derived, lines, registry
from . import reconcile_sql as sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = text
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return derived.manifest(spark, sf_dir), derived.storage(spark, sf_dir)


# --- functions ---------------------------------------------------------------------------------


def _interval_query(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")
        unit = F.element_at(F.array(*[F.lit(u) for u in ("KB", "MB", "GB", "TB")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
        shown = F.concat(F.call_function("div", cents, F.lit(100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" "), unit)
        rows = _table(spark, sf_dir, "lineitem").select(shown.alias("display")).distinct()
        return rows.select("display", sizes.size_interval(F.col("display"), mode).alias("i")).select("display", "i.lo", "i.hi")

    base = {"decimal": 1000, "binary": 1024}[mode]
    text = f"""
    WITH l AS (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS n, l_linenumber % 4 AS u FROM lineitem),
    d AS (SELECT DISTINCT n, u FROM l),
    m AS (SELECT *, CAST({base} AS HUGEINT) * CASE u WHEN 0 THEN 1 WHEN 1 THEN {base} WHEN 2 THEN {base**2} ELSE {base**3} END AS f FROM d)
    SELECT n // 100 || '.' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') || ' ' || ['KB', 'MB', 'GB', 'TB'][u + 1] AS display,
           CAST((greatest((2 * n - 1) * f, 0) + 199) // 200 AS BIGINT) AS lo, CAST(greatest((greatest((2 * n - 1) * f, 0) + 199) // 200, ((2 * n + 1) * f + 199) // 200 - 1) AS BIGINT) AS hi FROM m"""
    query(f"size_interval_{mode}", text)(run)


_interval_query("decimal")
_interval_query("binary")


@query("human_bytes", f"SELECT o_orderkey, {sql.human('v')} AS human FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * (o_orderkey % 1000 + 1) AS v FROM orders)")
def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.round(F.col("o_totalprice") * 100).cast("long") * (F.col("o_orderkey") % 1000 + 1)
    return _table(spark, sf_dir, "orders").select("o_orderkey", sizes.human_bytes(v).alias("human"))


@query("signed_human_bytes", f"SELECT o_orderkey, {sql.signed('v')} AS human FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) - 20000000 AS v FROM orders)")
def signed_human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", sizes.signed_human_bytes(F.round(F.col("o_totalprice") * 100).cast("long") - 20_000_000).alias("human"))


@query(
    "path_parts_normalized",
    """SELECT page_id, array_to_string(p, '/') AS norm_path, p[1] AS top, p[-1] AS filename FROM (
       SELECT page_id, list_filter(string_split(lower(replace(url, '\\', '/')), '/'), lambda x: x <> '' AND x <> '.') AS p FROM pages)""",
)
def path_parts_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages").select("page_id", paths.normal_path(F.col("url"), ascii_only=True).alias("norm_path"))
    return p.select("page_id", "norm_path", paths.top_part(F.col("norm_path")).alias("top"), paths.last_part(F.col("norm_path")).alias("filename"))


@query(
    "cassette_normalize",
    """SELECT s_suppkey, lower(regexp_replace(upper(trim(v)), '^([A-Z]{2,5}[0-9]{3,7})L[5-9]$', '\\1')) AS label FROM (
       SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN ' cxz' || s_suppkey || '00L7 ' WHEN 1 THEN 'FF' || s_suppkey || '12L4' WHEN 2 THEN 'KANSK0' || s_suppkey || 'L5' ELSE 'ov' || s_suppkey || '345l8' END AS v FROM supplier)""",
)
def cassette_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    v = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit(" cxz"), k, F.lit("00L7 "))).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("FF"), k, F.lit("12L4"))).when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("KANSK0"), k, F.lit("L5"))).otherwise(F.concat(F.lit("ov"), k, F.lit("345l8")))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", paths.cassette_label(v, ascii_only=True).alias("label"))


@query("catalog_size_parse", "SELECT p_partkey, CASE WHEN regexp_full_match(v, '[0-9]+') THEN TRY_CAST(v AS BIGINT) END AS size_bytes FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_partkey * 1000 AS VARCHAR) WHEN 1 THEN p_brand ELSE p_size || ' KB' END AS v FROM part)")
def catalog_size_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("p_partkey") % 3 == 0, (F.col("p_partkey") * 1000).cast("string")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" KB")))
    return _table(spark, sf_dir, "part").select("p_partkey", sizes.catalog_size(v).alias("size_bytes"))


@query(
    "sequence_expand",
    """SELECT p_partkey, 'shot_' || CASE WHEN length(CAST(n AS VARCHAR)) >= 4 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 4, '0') END || '.png' AS name FROM (SELECT p_partkey, unnest(range(p_partkey, p_partkey + p_size % 5 + 1)) AS n FROM part WHERE p_partkey % 3 <> 1)""",
)
def sequence_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = (F.col("p_size") % 5 + 1).cast("long")
    name = lambda n: F.concat(F.lit("shot_"), F.when(F.length(n.cast("string")) >= 4, n.cast("string")).otherwise(F.lpad(n.cast("string"), 4, "0")), F.lit(".png"))
    # every third pair has one frame too many and cannot be expanded
    wrong = F.when(F.col("p_partkey") % 3 == 1, 1).otherwise(0)
    # shot_9999 to shot_10001 are three names as written, not shot_09999 and so on
    names = lines.expanded_names(name(F.col("p_partkey")), name(F.col("p_partkey") + frames - 1), frames + wrong, F.lit(4))
    return _table(spark, sf_dir, "part").select("p_partkey", F.explode(names).alias("name"))


def _line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report lines made of conversations: a path that wraps, a frame count or other text for each turn."""
    c = _table(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Path : /Volumes/T1/prj/c"), F.col("conv_id").cast("string"), F.lit("/"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("clip_"), F.col("turn").cast("string"), F.lit(".mov"))).otherwise(F.concat(F.lit("Frames : "), (F.col("turn") + 1).cast("string")))
    return c.select(F.col("conv_id").cast("string").alias("pdf"), F.col("turn").alias("line_no"), F.lit(1).alias("page"), text.alias("line"))


_LINES = """l AS (SELECT CAST(conv_id AS VARCHAR) AS pdf, turn AS line_no, CASE turn % 3 WHEN 0 THEN 'Path : /Volumes/T1/prj/c' || conv_id || '/' WHEN 1 THEN 'clip_' || turn || '.mov' ELSE 'Frames : ' || (turn + 1) END AS line FROM conversations)"""


@query("wrapped_line_lead", f"WITH {_LINES}, n AS (SELECT *, coalesce(lead(line) OVER (PARTITION BY pdf ORDER BY line_no), '') AS nx FROM l) SELECT pdf, line_no, substr(line, 8) || CASE WHEN starts_with(nx, 'clip_') THEN nx ELSE '' END AS path, starts_with(nx, 'clip_') AS wrapped FROM n WHERE starts_with(line, 'Path : ')")
def wrapped_line_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.wrapped_paths(_line_table(spark, sf_dir))


@query("frames_lookback", f"WITH {_LINES} SELECT pdf, line_no, last_value(CASE WHEN starts_with(line, 'Frames') THEN CAST(substr(line, 10) AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY pdf ORDER BY line_no ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS frames FROM l")
def frames_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_table(spark, sf_dir).select("pdf", "line_no", lines.preceding_frames().alias("frames"))


_CLEAN = "array_to_string(list_filter(string_split(replace({v}, '\\', '/'), '/'), lambda x: x <> '' AND x <> '.'), '/')"


# of the letters of these tables only the sharp s folds to something else than its lower case
@query("casefold_nfc_keys", f"SELECT doc_id, sha256(replace(lower(nfc_normalize({_CLEAN.format(v='text')})), 'ß', 'ss')) AS key FROM documents")
def casefold_nfc_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(paths.normal_path(F.col("text")), 256).alias("key"))


@query("non_utf8_keys", f"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '__NON_UTF8_RAW_BYTES__/' || lower(hex(url)) || 'ff' ELSE lower({_CLEAN.format(v='url')}) END AS key, CASE WHEN page_id % 5 = 0 THEN url || '\\xff' ELSE url END AS display FROM pages")
def non_utf8_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("url").cast("binary"), F.when(F.col("page_id") % 5 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    return _table(spark, sf_dir, "pages").select("page_id", paths.raw_key(raw).alias("key"), paths.raw_display(raw).alias("display"))


@query(
    "parse_lines",
    """WITH li AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
    q AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p) AS seq FROM li WHERE p % 5 = 0),
    e AS (SELECT s, 'clip_' || p || '.mov' AS f, '1.22 GB' AS shown, 1215000000 AS lo, 1224999999 AS hi, 'regular' AS kind, '' AS ident FROM li WHERE p % 5 <> 0
      UNION ALL SELECT s, 'clip_' || p || '_0' || i || '.png', shown, lo, hi, kind, s || ':p1:seq' || seq FROM q, (VALUES (1, '2.5 MB', 2450000, 2549999, 'sequence_first'), (2, '', NULL, NULL, 'sequence_middle_size_unknown'), (3, '2.6 MB', 2550000, 2649999, 'sequence_last')) x(i, shown, lo, hi, kind))
    SELECT CAST(s AS VARCHAR) AS source_pdf, CAST(1 AS INTEGER) AS source_page, CAST(s AS VARCHAR) AS project, 'T1' AS tape, 'prj/' || f AS relative_path, 'prj/' || f AS norm_path, 'prj' AS top_folder, 'prj' AS norm_top_folder, f AS filename, f AS norm_filename, shown AS reported_size,
      CAST(lo AS BIGINT) AS size_min_bytes, CAST(hi AS BIGINT) AS size_max_bytes, CAST(CASE WHEN lo IS NULL THEN 0 ELSE 1 END AS INTEGER) AS size_known, kind AS entry_kind, ident AS sequence_id FROM e""",
)
def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each supplier: its parts as records, every fifth of them a sequence."""
    li = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_linenumber").alias("n"))
    name = F.concat(F.lit("clip_"), F.col("l_partkey").cast("string"))
    single = F.array(F.concat(F.lit("Name : "), name, F.lit(".mov   Size : 1.22 GB")), F.concat(F.lit("Path : /Volumes/T1/prj/"), name, F.lit(".mov")))
    seq = F.array(F.lit("Frames : 3"), F.concat(F.lit("First : "), name, F.lit("_01.png  Size : 2.5 MB")), F.concat(F.lit("Last : "), name, F.lit("_03.png  Size : 2.6 MB")), F.concat(F.lit("Path : /Volumes/T1/prj/"), name, F.lit("_01.png")))
    rows = li.select(F.col("l_suppkey").cast("string").alias("pdf"), "l_partkey", F.posexplode(F.when(F.col("l_partkey") % 5 == 0, seq).otherwise(single)).alias("i", "line"))
    rows = rows.select("pdf", (F.col("l_partkey") * 10 + F.col("i")).cast("long").alias("line_no"), F.lit(1).alias("page"), "line")
    return lines.entries(lines.parse_lines(rows), ascii_only=True).drop("ord")


# --- joins and classification --------------------------------------------------------------------


@query("size_match_residual_join", sql.derived("SELECT st.path AS norm_path, st.size AS size_bytes, mf.tape, mf.lo, mf.hi FROM st JOIN mf USING (path) WHERE st.size BETWEEN mf.lo AND mf.hi"))
def size_match_residual_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.size_matches(*_both(spark, sf_dir))


_ROWS = "SELECT source_root, path AS norm_path, size AS size_bytes, status, verified, lto_kind AS lto_duplicate_kind, storage_kind AS storage_duplicate_kind, CASE WHEN status = 'POSSIBLE_MOVED_WITHIN_TOP_FOLDER' THEN from_path END AS moved_from FROM cl"


def _rows(df: DataFrame) -> DataFrame:
    return df.select("source_root", "norm_path", "size_bytes", "status", "verified", "lto_duplicate_kind", "storage_duplicate_kind", "moved_from")


@query("classify_rows", sql.classified(_ROWS))
def classify_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(classify.classify(*_both(spark, sf_dir)))


@query("classify_no_moved_check", sql.classified(_ROWS, moved=False))
def classify_no_moved_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(classify.classify(*_both(spark, sf_dir), moved_check=False))


@query("classify_status_summary", sql.classified("SELECT status, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM cl GROUP BY status"))
def classify_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(*_both(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@query("blocking_reasons", sql.classified("").rstrip() + sql.FOLDERS + " SELECT source_root, path AS norm_path, array_to_string(reasons, ' | ') AS reasons FROM bl")
def blocking_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.classify(*_both(spark, sf_dir))
    return rows.select("source_root", "norm_path", F.array_join(classify.blocking_reasons(), " | ").alias("reasons"))


@query("manifest_duplicate_kind", sql.derived("SELECT path AS norm_path, n AS entries, nr AS ranges, kind AS lto_duplicate_kind FROM mk"))
def manifest_duplicate_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.manifest_groups(derived.manifest(spark, sf_dir)).select("norm_path", "entries", "ranges", "lto_duplicate_kind")


@query("storage_duplicate_kind", sql.derived("SELECT path AS norm_path, copies, sizes, kind AS storage_duplicate_kind FROM sk"))
def storage_duplicate_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.storage_groups(derived.storage(spark, sf_dir))


# --- comparison ------------------------------------------------------------------------------------


_TEXTS = """,
tx AS (SELECT path, list(CASE WHEN known THEN tape || ':' || shown || '[' || lo || '-' || hi || ']' ELSE tape || ':SIZE_UNKNOWN' END ORDER BY id) AS sizes, list_sort(list(DISTINCT tape)) AS tapes FROM mf GROUP BY path),
pr AS (SELECT rp.path, array_to_string(list_sort(list_distinct(flatten(list(tx.tapes)))), ' | ') AS tapes, array_to_string(flatten(list(tx.sizes ORDER BY mp.from_path)), ' | ') AS sizes FROM rp JOIN mp USING (path, size) JOIN tx ON tx.path = mp.from_path WHERE rp.status IN ('POSSIBLE_MOVED_WITHIN_TOP_FOLDER', 'AMBIGUOUS_POSSIBLE_MOVE') GROUP BY rp.path)
SELECT rp.status, rp.path AS relative_path, rp.source_root AS storage_root, rp.size AS storage_size_bytes, """ + sql.human("rp.size") + """ AS storage_size_human,
  coalesce(pr.tapes, CASE WHEN rp.status <> 'MISSING_ON_LTO' THEN array_to_string(tx.tapes, ' | ') END, '') AS lto_tapes, coalesce(pr.sizes, CASE WHEN rp.status <> 'MISSING_ON_LTO' THEN array_to_string(tx.sizes, ' | ') END, '') AS lto_reported_sizes
FROM rp LEFT JOIN pr USING (path) LEFT JOIN tx USING (path)
UNION ALL SELECT ml.status, ml.path, '', NULL, '', array_to_string(tx.tapes, ' | '), array_to_string(tx.sizes, ' | ') FROM ml JOIN tx USING (path)"""


@query("compare_all_results", sql.classified("").rstrip() + _TEXTS)
def compare_all_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.all_results(classify.reconcile(*_both(spark, sf_dir), texts=True))


@query("missing_on_storage", sql.classified("SELECT path AS norm_path, status, n AS entries FROM ml"))
def missing_on_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.missing_on_storage(classify.reconcile(*_both(spark, sf_dir))).select("norm_path", "status", "entries")


@query("zero_size_records", sql.classified("SELECT path AS norm_path, nz AS zero_entries, on_storage FROM zr"))
def zero_size_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.zero_records(classify.reconcile(*_both(spark, sf_dir)))


@query("copy_list", sql.classified("SELECT source_root, path AS relative_path, source_root || '/' || path AS absolute_path, size AS size_bytes FROM rp WHERE status = 'MISSING_ON_LTO'"))
def copy_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.copy_list(classify.reconcile(*_both(spark, sf_dir))).drop("norm_path", "relative_path_bytes")


_SUMMARY = """
SELECT status AS metric, count(*) AS value FROM (SELECT status FROM rp UNION ALL SELECT status FROM ml UNION ALL SELECT 'ZERO_SIZE_LTO_RECORD' FROM zr) GROUP BY status
UNION ALL SELECT 'LTO_MANIFEST_RECORDS', count(*) FROM mf UNION ALL SELECT 'LTO_UNIQUE_PATHS', count(*) FROM mg UNION ALL SELECT 'STORAGE_FILES', count(*) FROM st UNION ALL SELECT 'STORAGE_UNIQUE_PATHS', count(*) FROM sg
UNION ALL SELECT 'NON_UTF8_STORAGE_PATHS', count(*) FROM st WHERE valid = 0 UNION ALL SELECT 'LTO_DUPLICATE_PATH_GROUPS', count(*) FROM mg WHERE n > 1
UNION ALL SELECT 'DUPLICATE_MANIFEST_LOCATION_GROUPS', count(*) FROM (SELECT 1 FROM mf GROUP BY tape, path HAVING count(*) > 1) UNION ALL SELECT 'STORAGE_DUPLICATE_PATH_GROUPS', count(*) FROM sg WHERE copies > 1
UNION ALL SELECT 'COPY_LIST_FILES', count(*) FROM rp WHERE status = 'MISSING_ON_LTO'"""


@query("compare_summary", sql.classified(_SUMMARY))
def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s = _both(spark, sf_dir)
    return compare.summary(classify.reconcile(m, s), m)


def _line_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows from lineitem, whose (order, line) keys repeat."""
    l, q = _table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long")
    path = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("/l"), F.col("l_linenumber").cast("string"))
    tape = F.concat(F.lit("T"), (F.col("l_suppkey") % 3).cast("string"))
    known = F.col("l_returnflag") != "A"
    return l.select(path.alias("norm_path"), F.concat(path, F.lit("_"), F.col("l_linestatus")).alias("relative_path"), tape.alias("tape"), F.concat(tape, F.lit("_"), F.col("l_linestatus"), F.lit(".pdf")).alias("source_pdf"), F.when(known, q).alias("size_min_bytes"), F.when(known, q + 1).alias("size_max_bytes"))


_LM = """WITH lm AS (SELECT 'o' || l_orderkey || '/l' || l_linenumber AS norm_path, 'o' || l_orderkey || '/l' || l_linenumber || '_' || l_linestatus AS relative_path, 'T' || (l_suppkey % 3) AS tape, 'T' || (l_suppkey % 3) || '_' || l_linestatus || '.pdf' AS source_pdf,
  CASE WHEN l_returnflag <> 'A' THEN CAST(l_quantity AS BIGINT) END AS lo FROM lineitem)"""
_RANGES = "count(DISTINCT coalesce(CAST(lo AS VARCHAR), 'UNKNOWN') || ':' || coalesce(CAST(lo + 1 AS VARCHAR), 'UNKNOWN'))"


@query("lto_duplicate_paths", f"{_LM} SELECT norm_path, min(relative_path) AS example_relative_path, count(*) AS manifest_records, count(DISTINCT tape) AS tape_count, string_agg(DISTINCT tape, ' | ' ORDER BY tape) AS tapes, {_RANGES} AS distinct_size_ranges FROM lm GROUP BY norm_path HAVING count(*) > 1")
def lto_duplicate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.duplicate_paths(_line_manifest(spark, sf_dir))


@query("duplicate_manifest_locations", f"{_LM} SELECT tape, norm_path, min(relative_path) AS example_relative_path, count(*) AS records, string_agg(DISTINCT source_pdf, ' | ' ORDER BY source_pdf) AS source_pdfs, {_RANGES} AS distinct_size_ranges FROM lm GROUP BY tape, norm_path HAVING count(*) > 1")
def duplicate_manifest_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.duplicate_locations(_line_manifest(spark, sf_dir))


@query("storage_duplicate_paths", sql.derived("SELECT path AS norm_path, min(path) AS example_relative_path, count(*) AS copies, string_agg(DISTINCT source_root, ' | ' ORDER BY source_root) AS source_roots, string_agg(source_root || '/' || path, ' | ' ORDER BY source_root || '/' || path) AS absolute_paths, count(DISTINCT size) AS distinct_sizes FROM st GROUP BY path HAVING count(*) > 1"))
def storage_duplicate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.duplicate_storage(derived.storage(spark, sf_dir))


# --- folders ---------------------------------------------------------------------------------------


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.folder_facts(classify.reconcile(*_both(spark, sf_dir)))


@query("folder_size_totals", sql.folders("SELECT top AS norm_top_folder, pc AS path_count, CAST(kc AS BIGINT) AS known_size_count, CAST(uc AS BIGINT) AS unknown_size_count, CAST(cc AS BIGINT) AS conflicting_size_path_count, CAST(xc AS BIGINT) AS additional_identical_tape_copy_count, CAST(lo AS BIGINT) AS total_min_bytes, CAST(hi AS BIGINT) AS total_max_bytes FROM wt"))
def folder_size_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.manifest_totals(classify.manifest_groups(derived.manifest(spark, sf_dir)))


_WHY = "CASE WHEN odd > 0 THEN list_sort(list_distinct(list_append(reasons, 'INCOMPLETE_CLASSIFICATION'))) ELSE reasons END"


@query("folder_strict_decision", sql.folders(f"SELECT source_root, top AS folder_name, files AS file_count, ver AS verified_count, CASE WHEN len({_WHY}) = 0 AND ver = files THEN 'SAFE_TO_DELETE' ELSE 'BLOCKED' END AS decision, array_to_string({_WHY}, ' | ') AS blocking_reasons FROM fo"))
def folder_strict_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.strict_decision(_facts(spark, sf_dir)).select("source_root", F.col("top_raw").cast("string").alias("folder_name"), "file_count", "verified_count", "decision", "blocking_reasons")


@query(
    "folder_decision_with_issues",
    sql.folders("""
, wi AS (SELECT fo.*, starts_with(top, 'prj_1') AS broken, source_root LIKE '%VIDEO1/SOURCE' AS short FROM fo),
wr AS (SELECT *, list_sort(list_distinct(list_concat(reasons, CASE WHEN odd > 0 OR short THEN ['INCOMPLETE_CLASSIFICATION'] ELSE [] END, CASE WHEN broken THEN ['DIRECTORY_READ_ERROR'] ELSE [] END))) AS why FROM wi)
SELECT source_root, top AS folder_name, CASE WHEN len(why) = 0 AND ver = files THEN 'SAFE_TO_DELETE' ELSE 'BLOCKED' END AS decision, array_to_string(why, ' | ') AS blocking_reasons, CASE WHEN broken THEN 'directory_read_error' ELSE '' END AS scan_issue_types FROM wr"""),
)
def folder_decision_with_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that could not read a part of the folders prj_1, prj_10 and so on, and lost a file of VIDEO1."""
    m, s = _both(spark, sf_dir)
    issues = s.where(F.col("top_folder").startswith("prj_1")).select("source_root", F.concat_ws("/", "source_root", "top_folder", F.lit("new0")).alias("path"), F.lit("directory_read_error").alias("issue_type"), F.lit("").alias("details"))
    expected = s.groupBy("source_root").agg((F.count("*") + F.when(F.col("source_root").endswith("VIDEO1/SOURCE"), 1).otherwise(0)).alias("files"))
    facts = folders.folder_facts(classify.reconcile(m, s), issues, expected)
    return folders.folder_report(facts).select("source_root", "folder_name", "decision", "blocking_reasons", "scan_issue_types")


def _result(p: str, empty: str) -> str:
    return f"CASE WHEN {p}pc = 0 THEN '{empty}' WHEN {p}uc > 0 OR {p}cc > 0 THEN 'UNKNOWN_LTO_SIZES' WHEN size BETWEEN {p}lo AND {p}hi THEN 'WITHIN_INTERVAL' ELSE 'OUTSIDE_INTERVAL' END"


_MID = "((mlo + mhi) // 2)"


def _diffs(prefix: str, ends: dict[str, str]) -> str:
    return ", ".join(f"size - {v} AS storage_minus_lto_{prefix}{n}_bytes, {sql.signed(f'(size - {v})')} AS storage_minus_lto_{prefix}{n}_human" for n, v in ends.items())


_MOVED = "status IN ('POSSIBLE_MOVED_WITHIN_TOP_FOLDER', 'AMBIGUOUS_POSSIBLE_MOVE')"


@query(
    "folder_report",
    sql.folders(f"""
, tp AS (SELECT cl.source_root, cl.top, mf.tape FROM cl JOIN mf USING (path) UNION SELECT cl.source_root, cl.top, mf.tape FROM cl JOIN mp ON mp.path = cl.path AND mp.size = cl.size JOIN mf ON mf.path = mp.from_path WHERE {_MOVED}),
tl AS (SELECT source_root, top, string_agg(tape, ' | ' ORDER BY tape) AS tapes FROM tp GROUP BY ALL),
tc AS (SELECT source_root, top, CAST(sum(CASE WHEN {_MOVED} THEN entries ELSE n END) AS BIGINT) AS copies FROM cl GROUP BY ALL),
ss AS (SELECT source_root, top, status, count(*) AS n FROM cl GROUP BY ALL),
sj AS (SELECT source_root, top, '{{' || string_agg('"' || status || '": ' || n, ', ' ORDER BY status) || '}}' AS counts FROM ss GROUP BY ALL),
wy AS (SELECT *, {_WHY} AS why FROM fo),
w2 AS (SELECT *, CASE WHEN len(why) = 0 AND ver = files THEN 'SAFE_TO_DELETE' ELSE 'BLOCKED' END AS decision, {_result('m', 'NO_MATCHED_LTO_PATHS')} AS mres, {_result('w', 'NO_LTO_FOLDER')} AS wres FROM wy)
SELECT source_root, top AS folder_name, source_root || '/' || top AS absolute_path, decision, array_to_string(why, ' | ') AS blocking_reasons, files AS storage_file_count, size AS storage_total_size_bytes, {sql.human('size')} AS storage_total_size_human,
  mpc AS lto_matched_path_count, mkc AS lto_known_size_file_count, muc AS lto_unknown_size_file_count, mcc AS lto_conflicting_size_path_count, mxc AS lto_additional_identical_tape_copy_count,
  mlo AS lto_total_size_min_bytes, mhi AS lto_total_size_max_bytes, {_MID} AS lto_total_size_midpoint_bytes, {sql.human('mlo')} AS lto_total_size_min_human, {sql.human('mhi')} AS lto_total_size_max_human, {sql.human(_MID)} AS lto_total_size_midpoint_human,
  wpc AS lto_folder_manifest_file_count, wkc AS lto_folder_manifest_known_size_count, wuc AS lto_folder_manifest_unknown_size_count, wcc AS lto_folder_manifest_conflicting_size_path_count, wxc AS lto_folder_manifest_additional_identical_tape_copy_count,
  wlo AS lto_folder_manifest_total_min_bytes, whi AS lto_folder_manifest_total_max_bytes, {sql.human('wlo')} AS lto_folder_manifest_total_min_human, {sql.human('whi')} AS lto_folder_manifest_total_max_human,
  {_diffs('', {'min': 'mlo', 'max': 'mhi', 'midpoint': _MID})}, {_diffs('manifest_', {'min': 'wlo', 'max': 'whi'})},
  CASE mres WHEN 'WITHIN_INTERVAL' THEN 'YES' WHEN 'OUTSIDE_INTERVAL' THEN 'NO' ELSE '' END AS storage_size_within_lto_folder_interval, mres AS folder_size_interval_result, wres AS manifest_folder_size_interval_result,
  decision AS status, top AS top_folder, source_root || '/' || top AS absolute_folder, files AS file_count, ver AS verified_file_count, size AS total_size_bytes, copies AS lto_copy_count, coalesce(tapes, '') AS lto_tapes, counts AS classification_counts, '' AS scan_issue_types
FROM w2 JOIN tc USING (source_root, top) JOIN sj USING (source_root, top) LEFT JOIN tl USING (source_root, top)"""),
)
def folder_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.folder_report(_facts(spark, sf_dir))


@query("folder_interval_result", sql.folders(f"SELECT source_root, top AS folder_name, size AS storage_total_size_bytes, mlo AS lto_total_size_min_bytes, mhi AS lto_total_size_max_bytes, {_result('m', 'NO_MATCHED_LTO_PATHS')} AS folder_size_interval_result, {_result('w', 'NO_LTO_FOLDER')} AS manifest_folder_size_interval_result FROM fo"))
def folder_interval_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("source_root", "folder_name", "storage_total_size_bytes", "lto_total_size_min_bytes", "lto_total_size_max_bytes", "folder_size_interval_result", "manifest_folder_size_interval_result")
    return folders.folder_report(_facts(spark, sf_dir)).select(*cols)


@query(
    "simple_folder_report",
    sql.folders(f"""
, v2 AS (SELECT *, (wlo + whi) // 2 AS mid FROM vd),
v3 AS (SELECT *, CAST(abs(size - mid) AS HUGEINT) * 1000000 AS sc, CAST(greatest(size, 1) AS HUGEINT) AS sz1 FROM v2),
v4 AS (SELECT *, CAST(sc // sz1 + CASE WHEN 2 * (sc % sz1) > sz1 OR (2 * (sc % sz1) = sz1 AND (sc // sz1) % 2 = 1) THEN 1 ELSE 0 END AS BIGINT) AS q FROM v3),
v5 AS (SELECT *, CASE WHEN ok THEN 'WITHIN_TOLERANCE' WHEN usable THEN 'OUTSIDE_TOLERANCE' ELSE 'UNKNOWN' END AS size_result FROM v4)
SELECT top AS folder_name, {sql.human('size')} AS storage_size, CASE WHEN usable THEN {sql.human('mid')} ELSE 'UNKNOWN' END AS lto_size, files AS storage_file_count, wpc AS lto_file_count, result, source_root, source_root || '/' || top AS absolute_path,
  size AS storage_size_bytes, CASE WHEN usable THEN wlo END AS lto_size_min_bytes, CASE WHEN usable THEN whi END AS lto_size_max_bytes, CASE WHEN usable THEN mid END AS lto_size_midpoint_bytes, CASE WHEN usable THEN size - mid END AS size_difference_bytes,
  CASE WHEN usable THEN q // 10000 || '.' || lpad(CAST(q % 10000 AS VARCHAR), 4, '0') ELSE '' END AS size_difference_percent, size_result, size_result AS aggregate_size_result, CASE WHEN files = wpc THEN 'MATCH' ELSE 'MISMATCH' END AS file_count_result,
  m AS known_size_match_count, u AS unknown_size_path_match_count, so AS storage_only_path_count, lo_only AS lto_only_path_count, x AS size_mismatch_count, wcc AS conflicting_lto_path_count, amb AS ambiguous_path_count, z AS zero_size_file_count, CAST(si AS BIGINT) AS scan_issue_count, inv AS invalid_encoding_count,
  CASE WHEN result = 'YES' THEN 'OK' WHEN result = 'YES_WITH_UNKNOWN_SIZE' THEN 'INDIVIDUAL_LTO_SIZE_UNKNOWN_AGGREGATE_MATCH' WHEN result = 'YES_WITH_FILE_WARNINGS' THEN 'INDIVIDUAL_SIZE_MISMATCH_AGGREGATE_MATCH' || CASE WHEN u > 0 THEN ' | INDIVIDUAL_LTO_SIZE_UNKNOWN_AGGREGATE_MATCH' ELSE '' END WHEN why = '' THEN 'AMBIGUOUS_PATH' ELSE why END AS reason,
  'DECIMAL' AS pdf_size_units FROM v5"""),
)
def simple_folder_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.simple_report(_facts(spark, sf_dir))


@query(
    "folder_simple_verdict",
    sql.folders("""SELECT source_root, top AS folder_name, result, CASE WHEN result = 'YES' THEN 'OK' WHEN result = 'YES_WITH_UNKNOWN_SIZE' THEN 'INDIVIDUAL_LTO_SIZE_UNKNOWN_AGGREGATE_MATCH' WHEN result = 'YES_WITH_FILE_WARNINGS' THEN 'INDIVIDUAL_SIZE_MISMATCH_AGGREGATE_MATCH' || CASE WHEN u > 0 THEN ' | INDIVIDUAL_LTO_SIZE_UNKNOWN_AGGREGATE_MATCH' ELSE '' END
    WHEN why = '' THEN 'AMBIGUOUS_PATH' ELSE why END AS reason, CASE WHEN ok THEN 'WITHIN_TOLERANCE' WHEN usable THEN 'OUTSIDE_TOLERANCE' ELSE 'UNKNOWN' END AS aggregate_size_result, CASE WHEN usable THEN size - (wlo + whi) // 2 END AS size_difference_bytes, so AS storage_only_path_count, lo_only AS lto_only_path_count FROM vd"""),
)
def folder_simple_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.simple_report(_facts(spark, sf_dir)).select("source_root", "folder_name", "result", "reason", "aggregate_size_result", "size_difference_bytes", "storage_only_path_count", "lto_only_path_count")


@query("verdict_totals", sql.folders("SELECT v AS result, count(vd.result) AS folders, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM (SELECT unnest(['YES', 'YES_WITH_UNKNOWN_SIZE', 'YES_WITH_FILE_WARNINGS', 'NO']) AS v) LEFT JOIN vd ON vd.result = v GROUP BY v"))
def verdict_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.verdict_totals(folders.simple_report(_facts(spark, sf_dir)))


@query(
    "issue_localization",
    """WITH e AS (SELECT 'R' || (user_id % 3) AS root, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'f' || (user_id % 20) END AS top, event_type AS kind FROM events),
    f AS (SELECT DISTINCT root, top FROM e WHERE top IS NOT NULL UNION SELECT 'R' || (c_custkey % 3), 'g' || (c_custkey % 7) FROM customer),
    a AS (SELECT root, top, kind FROM e WHERE top IS NOT NULL UNION ALL SELECT f.root, f.top, e.kind FROM f JOIN e ON e.root = f.root AND e.top IS NULL),
    n AS (SELECT root, top, string_agg(DISTINCT kind, ' | ' ORDER BY kind) AS issue_types, count(*) AS issue_count FROM a GROUP BY ALL)
    SELECT '/mnt/' || f.root AS source_root, f.top AS folder, issue_types, issue_count FROM f LEFT JOIN n ON n.root = f.root AND n.top = f.top""",
)
def issue_localization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as issues of three roots; folders of customers have no issue of their own."""
    root = F.concat(F.lit("/mnt/R"), (F.col("user_id") % 3).cast("string"))
    path = F.when(F.col("event_id") % 4 == 0, root).otherwise(F.concat(root, F.lit("/f"), (F.col("user_id") % 20).cast("string"), F.lit("/x.mov")))
    issues = _table(spark, sf_dir, "events").select(root.alias("source_root"), path.alias("path"), F.col("event_type").alias("issue_type"), F.lit("").alias("details"))
    key = F.col("c_custkey")
    own = _table(spark, sf_dir, "customer").select(F.concat(F.lit("/mnt/R"), (key % 3).cast("string")).alias("source_root"), F.concat(F.lit("g"), (key % 7).cast("string")).cast("binary").alias("top_raw")).distinct()
    out = folders.folder_issues(own, issues)
    return out.select("source_root", F.col("top_raw").cast("string").alias("folder"), F.array_join("issue_types", " | ").alias("issue_types"), "issue_count")


# --- imports and inventories -------------------------------------------------------------------------


@query("scan_count_integrity", "SELECT 'R' || c_nationkey AS source_root, count(*) + CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE 0 END AS expected, count(*) AS actual, c_nationkey % 3 = 0 AS short FROM customer GROUP BY c_nationkey UNION ALL SELECT 'lost', 5, 0, true")
def scan_count_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of customers by nation; scans counted one more for every third nation, and a root whose files are all gone."""
    root = F.concat(F.lit("R"), F.col("c_nationkey").cast("string")).alias("source_root")
    actual = _table(spark, sf_dir, "customer").groupBy(root, "c_nationkey").agg(F.count("*").alias("actual"))
    expected = actual.select("source_root", (F.col("actual") + F.when(F.col("c_nationkey") % 3 == 0, 1).otherwise(0)).alias("files"))
    lost = spark.createDataFrame([("lost", 5)], "source_root string, files long")
    return folders.short_roots(expected.unionByName(lost), actual.select("source_root", "actual"))


@query("snapshot_diff", "WITH a AS (SELECT c_custkey AS k, c_name AS n FROM customer), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN c_name || '*' ELSE c_name END AS n FROM customer WHERE c_custkey % 11 <> 0) SELECT k, n, 'only_old' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT k, n, 'only_new' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.snapshot import snapshot_difference

    a = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"))
    b = a.where("k % 11 <> 0").withColumn("n", F.when(F.col("k") % 7 == 0, F.concat("n", F.lit("*"))).otherwise(F.col("n")))
    return snapshot_difference(a, b)


@query("legacy_source_union", "SELECT 'R' || n_nationkey AS source_root FROM nation UNION SELECT 'R' || c_nationkey FROM customer UNION SELECT 'S' || s_nationkey FROM supplier")
def legacy_source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (("nation", "R", "n_nationkey"), ("customer", "R", "c_nationkey"), ("supplier", "S", "s_nationkey"))
    return registry.union_roots([_table(spark, sf_dir, t).select(F.concat(F.lit(r), F.col(c).cast("string")).alias("source_root")) for t, r, c in parts])


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan for each supplier, of its nation's volume on its region's server."""
    s, n, r = (_table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 nations, 5 regions
    return rows.select(
        F.col("s_suppkey").cast("string").alias("snapshot_id"), F.col("r_name").alias("server"), F.concat(F.lit("10.0.0."), F.col("r_regionkey").cast("string")).alias("server_ip"), F.col("n_name").alias("volume"),
        F.concat(F.lit("/mnt/"), "n_name").alias("volume_root"), (F.col("s_suppkey") % 100).cast("long").alias("files"), F.round(F.col("s_acctbal") * 100).cast("long").alias("bytes"), F.lit(0).cast("long").alias("issues"),
    )


@query("server_volume_inventory", "SELECT r_name AS server, '10.0.0.' || r_regionkey AS server_ip, n_name AS volume, '/mnt/' || n_name AS volume_root, count(*) AS scans, CAST(sum(s_suppkey % 100) AS BIGINT) AS files, CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS BIGINT) AS bytes FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def server_volume_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.volumes(_scans(spark, sf_dir))


@query(
    "scan_identity_conflicts",
    """SELECT 'server' AS conflict, r_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 = 0 GROUP BY ALL
    UNION ALL SELECT 'volume', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 5 = 0 GROUP BY ALL
    UNION ALL SELECT 'snapshot', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey % 4 = 0 OR s_nationkey % 5 = 0 OR s_suppkey % 9 = 0""",
)
def scan_identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scans again, some from a server of another address, from a moved volume, or with another count."""
    known = _scans(spark, sf_dir)
    nation = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("volume"), "n_nationkey")
    again = known.join(F.broadcast(nation), "volume")  # 25 nations
    again = again.withColumns({
        "server_ip": F.when(F.col("n_nationkey") % 4 == 0, "other").otherwise(F.col("server_ip")), "volume_root": F.when(F.col("n_nationkey") % 5 == 0, "/other").otherwise(F.col("volume_root")),
        "files": F.col("files") + F.when(F.col("snapshot_id").cast("long") % 9 == 0, 1).otherwise(0),
    })
    return registry.conflicts(known, again.drop("n_nationkey"))


@query("report_with_stats", "SELECT CAST(o_orderkey AS VARCHAR) AS report_id, CASE WHEN o_orderkey % 3 = 0 THEN 'binary' ELSE 'decimal' END AS units, s.extracted_files, s.difference FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS extracted_files, count(*) - max(l_linenumber) AS difference FROM lineitem GROUP BY l_orderkey) s ON l_orderkey = o_orderkey")
def report_with_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each order, without units unless they are binary; its counts are of its lines."""
    stats = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("content_sha256")).agg(F.count("*").alias("extracted_files"), (F.count("*") - F.max("l_linenumber")).alias("difference"))
    entries = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("content_sha256"), F.when(F.col("o_orderkey") % 3 == 0, "binary").alias("units"))
    return registry.with_stats(entries, stats).select(F.col("content_sha256").alias("report_id"), "units", "extracted_files", "difference")


@query("content_identity_dedup", "SELECT sha256(text) AS content_sha256, min(CAST(doc_id AS VARCHAR)) AS source, count(*) AS copies FROM documents GROUP BY ALL")
def content_identity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.distinct_contents(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.col("text").alias("content")))


@query("metadata_latest", "WITH v AS (SELECT CASE user_id % 4 WHEN 0 THEN 'server_ip' WHEN 1 THEN 'pdf_size_units' ELSE 'k' || (user_id % 50) END AS key, event_id AS ev FROM events), m AS (SELECT key, max(ev) AS ev FROM v GROUP BY key) SELECT key, 'v' || ev AS value FROM m UNION ALL SELECT k, d FROM (VALUES ('pdf_size_units', 'decimal'), ('server_hostname', ''), ('server_ip', ''), ('volume_name', ''), ('volume_root', '')) x(k, d) WHERE k NOT IN (SELECT key FROM m)")
def metadata_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata writes made of events; keys that nobody wrote have their legacy default."""
    u = F.col("user_id") % 4
    key = F.when(u == 0, "server_ip").when(u == 1, "pdf_size_units").otherwise(F.concat(F.lit("k"), (F.col("user_id") % 50).cast("string")))
    values = _table(spark, sf_dir, "events").select(key.alias("key"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"), F.col("event_id").alias("at"))
    return registry.latest(values)


# --- discovery -----------------------------------------------------------------------------------------


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate folders: the storage of VIDEO0; every fifth project has another folder name."""
    s = derived.storage(spark, sf_dir).where(F.col("source_root").endswith("VIDEO0/SOURCE"))
    name = F.when(F.substring("top_folder", 5, 9).cast("int") % 5 == 0, F.concat(F.lit("renamed_"), F.col("top_folder"))).otherwise(F.col("top_folder"))
    return s.select(F.concat("source_root", F.lit("/"), name).alias("folder"), name.alias("norm_name"), paths.below_top(F.col("norm_path")).alias("norm_below"), "size_bytes", F.lit(True).alias("readable"))


_DISC = """,
fn AS (SELECT file, count(DISTINCT path) AS pc FROM mf GROUP BY file),
bt AS (SELECT split_part(path, '/', 2) || '/' || split_part(path, '/', 3) AS below, count(DISTINCT top) AS tc FROM mf GROUP BY 1),
ap AS (SELECT top, path, split_part(path, '/', 2) || '/' || split_part(path, '/', 3) AS below, split_part(path, '/', 2) AS parent, any_value(file) AS file, count(DISTINCT CASE WHEN known THEN lo || ':' || hi END) = 1 AND count(*) FILTER (NOT known) = 0 AS sized, min(lo) AS lo, max(hi) AS hi FROM mf GROUP BY ALL),
ar AS (SELECT ap.*, pc, tc = 1 AS distinctive, row_number() OVER (PARTITION BY top, sized, parent ORDER BY pc, parent, path) AS r FROM ap JOIN fn USING (file) JOIN bt USING (below)),
ti AS (SELECT *, CASE WHEN NOT sized THEN 2 WHEN r = 1 THEN 0 ELSE 1 END AS tier FROM ar),
an AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY top ORDER BY tier, pc, parent, path) AS place FROM ti) WHERE place <= 5),
iv AS (SELECT source_root || '/' || CASE WHEN CAST(substr(top, 5) AS INT) % 5 = 0 THEN 'renamed_' || top ELSE top END AS folder, CASE WHEN CAST(substr(top, 5) AS INT) % 5 = 0 THEN 'renamed_' || top ELSE top END AS name, split_part(path, '/', 2) || '/' || split_part(path, '/', 3) AS below, size FROM st WHERE source_root LIKE '%VIDEO0/SOURCE'),
fl AS (SELECT folder, below, min(size) AS size FROM iv GROUP BY ALL HAVING count(*) = 1),
nm AS (SELECT DISTINCT an.top, iv.folder FROM (SELECT DISTINCT top FROM mf) an JOIN iv ON iv.name = an.top),
hi AS (SELECT nm.top, nm.folder, false AS fallback, an.sized, an.lo, an.hi, fl.size FROM nm JOIN an USING (top) LEFT JOIN fl ON fl.folder = nm.folder AND fl.below = an.below
  UNION ALL SELECT an.top, fl.folder, true, an.sized, an.lo, an.hi, fl.size FROM an JOIN fl USING (below) WHERE distinctive AND top NOT IN (SELECT top FROM nm)),
sc0 AS (SELECT top, folder, fallback, count(size) AS path_matched, count(*) FILTER (sized AND size BETWEEN lo AND hi) AS size_matched, count(*) FILTER (sized AND NOT (size BETWEEN lo AND hi)) AS size_mismatched, count(*) FILTER (NOT sized AND size IS NOT NULL) AS unknown_matched FROM hi GROUP BY ALL),
sc AS (SELECT *, row_number() OVER (PARTITION BY top ORDER BY size_matched DESC, path_matched DESC, size_mismatched, folder) AS rank FROM sc0)"""


@query("anchor_topk", sql.derived("").rstrip() + _DISC + " SELECT top AS norm_top_folder, path AS norm_path, sized, CASE WHEN sized THEN lo END AS lo, CASE WHEN sized THEN hi END AS hi, distinctive, CAST(place AS INTEGER) AS place FROM an")
def anchor_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.anchors(derived.manifest(spark, sf_dir)).drop("norm_below")


@query("anchor_frequencies", sql.derived("").rstrip() + _DISC + " SELECT file AS norm_filename, pc AS path_count FROM fn")
def anchor_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.frequencies(derived.manifest(spark, sf_dir))[0]


@query("discover_scores", sql.derived("").rstrip() + _DISC + " SELECT top AS norm_top_folder, folder, fallback, path_matched, size_matched, size_mismatched, unknown_matched, CAST(rank AS INTEGER) AS rank FROM sc")
def discover_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = derived.manifest(spark, sf_dir)
    return discovery.scores(m, _inventory(spark, sf_dir), discovery.anchors(m)).drop("readable")


@query(
    "discover_mapping",
    sql.derived("").rstrip() + _DISC + """,
pm AS (SELECT top, count(*) AS c, count(*) FILTER (size_matched >= 2 AND size_mismatched = 0) AS s, count(*) FILTER (path_matched > 0 AND size_mismatched = 0) AS p, min(rank) FILTER (size_matched >= 2 AND size_mismatched = 0) AS sr FROM sc GROUP BY top),
tested AS (SELECT top, count(*) AS n, count(*) FILTER (distinctive) AS far FROM an GROUP BY top)
SELECT t.top AS lto_top_folder, t.top AS normalized_lto_top_folder, CASE WHEN c IS NULL THEN 'NOT_FOUND' WHEN s = 1 THEN 'MATCHED' WHEN s > 1 OR p > 1 THEN 'AMBIGUOUS' ELSE 'NAME_MATCH_UNVERIFIED' END AS status, CASE WHEN s = 1 OR c = 1 THEN folder ELSE '' END AS physical_folder, coalesce(c, 0) AS candidate_count,
  coalesce(CASE WHEN t.top IN (SELECT top FROM nm) THEN n ELSE far END, 0) AS anchors_tested, path_matched AS anchors_path_matched, size_matched AS anchors_size_matched, size_mismatched AS anchors_size_mismatched, unknown_matched AS unknown_size_paths_matched
FROM (SELECT DISTINCT top FROM mf) t LEFT JOIN pm USING (top) LEFT JOIN tested USING (top) LEFT JOIN sc ON sc.top = t.top AND sc.rank = CASE WHEN s = 1 THEN sr ELSE 1 END""",
)
def discover_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.mapping(derived.manifest(spark, sf_dir), _inventory(spark, sf_dir)).drop("confidence_reason")


# --- catalog comparison ----------------------------------------------------------------------------------


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows from the storage side: without size for every seventh order, without tape for every 31st."""
    s = derived.storage(spark, sf_dir).where(F.col("source_root").endswith("VIDEO0/SOURCE"))
    k = F.regexp_extract("filename", "([0-9]+)", 1).cast("long")
    return s.select(
        F.col("norm_path").alias("path"), F.when(k % 31 == 0, "").otherwise("T1").alias("cassette_raw"), F.when(k % 31 == 0, "").otherwise("t1").alias("cassette_norm"), F.when(k % 7 != 0, F.col("size_bytes")).alias("size_bytes"),
        F.col("filename").alias("filename_raw"), F.regexp_extract("norm_path", "^(.*)/[^/]*$", 1).alias("path_norm"),
    )


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.manifest(spark, sf_dir).withColumn("tape_norm", F.lower("tape"))


_ARCH = """,
ct AS (SELECT path, split_part(path, '/', 1) AS folder, CASE WHEN CAST(regexp_extract(file, '([0-9]+)', 1) AS BIGINT) % 31 = 0 THEN '' ELSE 'T1' END AS cas, CASE WHEN CAST(regexp_extract(file, '([0-9]+)', 1) AS BIGINT) % 7 <> 0 THEN size END AS size FROM st WHERE source_root LIKE '%VIDEO0/SOURCE'),
cp AS (SELECT path, any_value(folder) AS folder, count(DISTINCT size) AS sizes, min(size) AS size, count(*) FILTER (size IS NULL) AS ns, count(*) FILTER (cas = '') AS unsafe, bool_or(cas = 'T1') AS t1 FROM ct GROUP BY path),
ob AS (SELECT path, count(*) AS seen, count(DISTINCT CASE WHEN known THEN lo || ':' || hi END) AS nr, max(lo) AS lo, min(hi) AS hi, count(*) FILTER (tape = 'T1') AS hit, count(*) FILTER (tape = 'T1' AND NOT known) AS uns FROM mf GROUP BY path),
ps AS (SELECT cp.path, cp.folder, CASE WHEN sizes > 1 OR nr > 1 THEN 'SIZE_CONFLICT' WHEN unsafe > 0 THEN 'CONFLICT' WHEN seen IS NULL THEN 'MISSING_ON_REPORT' WHEN hit = 0 OR NOT t1 THEN 'CASSETTE_CONFLICT' WHEN sizes > 0 AND nr > 0 AND NOT (size BETWEEN lo AND hi) THEN 'SIZE_CONFLICT' WHEN sizes = 0 OR ns > 0 OR uns > 0 THEN 'PATH_MATCH_SIZE_UNKNOWN' ELSE 'EXACT' END AS status, sizes > 1 OR nr > 1 AS dup FROM cp LEFT JOIN ob USING (path)),
ux AS (SELECT mf.*, split_part(mf.path, '/', 1) AS folder FROM mf WHERE tape = 'T1' AND path NOT IN (SELECT path FROM cp) AND split_part(path, '/', 1) IN (SELECT folder FROM ct WHERE cas = 'T1'))"""


@query(
    "archive_file_details",
    sql.derived("").rstrip() + _ARCH + """
SELECT ps.status, ps.folder, ct.cas AS catalog_cassette, coalesce(mf.tape, '') AS observed_cassette, ps.path, ct.size AS catalog_size, mf.lo AS size_min_bytes, mf.hi AS size_max_bytes, CASE WHEN dup THEN 'Conflicting duplicate sizes/intervals; manual review' WHEN ps.status = 'CONFLICT' THEN 'Incomplete or unsafe catalog identity; manual review' WHEN ps.status = 'CASSETTE_CONFLICT' THEN 'Same full path only on unexpected cassette' ELSE '' END AS notes, mf.id AS entry_id FROM ct JOIN ps USING (path) LEFT JOIN mf USING (path)
UNION ALL SELECT 'UNEXPECTED_ON_REPORT', folder, '', tape, path, NULL, lo, hi, 'Within exact folder prefix and expected cassette scope', id FROM ux""",
)
def archive_file_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.file_details(_catalog(spark, sf_dir), _observed(spark, sf_dir))


@query(
    "archive_folder_summary",
    sql.derived("").rstrip() + _ARCH + """,
ac AS (SELECT folder, count(*) AS expected, count(*) FILTER (status IN ('EXACT', 'PATH_MATCH_SIZE_UNKNOWN')) AS found, count(*) FILTER (status = 'MISSING_ON_REPORT') AS missing, count(*) FILTER (status LIKE '%CONFLICT') AS conflicts, count(*) FILTER (status = 'PATH_MATCH_SIZE_UNKNOWN') AS size_unknown, count(*) FILTER (status = 'EXACT') AS size_verified, count(*) FILTER (status = 'SIZE_CONFLICT') AS sc FROM ps GROUP BY folder),
au AS (SELECT folder, count(DISTINCT path) AS unexpected FROM ux GROUP BY folder),
al AS (SELECT folder, string_agg(DISTINCT tape, ' | ' ORDER BY tape) AS obs FROM (SELECT folder, tape FROM cp JOIN mf USING (path) UNION ALL SELECT folder, tape FROM ux) GROUP BY folder),
ae AS (SELECT folder, coalesce(string_agg(DISTINCT CASE WHEN cas <> '' THEN cas END, ' | '), '') AS lab FROM ct GROUP BY folder)
SELECT ac.folder, expected, found, missing, conflicts, coalesce(unexpected, 0) AS unexpected, size_unknown, size_verified, lab AS expected_labels, coalesce(obs, '') AS observed_labels,
  CASE WHEN conflicts > 0 THEN 'CONFLICT' WHEN obs IS NULL THEN 'NOT_FOUND' WHEN missing > 0 OR coalesce(unexpected, 0) > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS presence_status, CASE WHEN sc > 0 THEN 'CONFLICT' WHEN size_verified > 0 THEN CASE WHEN size_unknown > 0 THEN 'PARTIAL' ELSE 'VERIFIED' END ELSE 'UNKNOWN' END AS size_status
FROM ac LEFT JOIN au USING (folder) LEFT JOIN al USING (folder) JOIN ae USING (folder)""",
)
def archive_folder_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.folder_summary(_catalog(spark, sf_dir), _observed(spark, sf_dir))


# --- workbook cells ------------------------------------------------------------------------------------------


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells made of conversations: a workbook for each 40 of them, a sheet for each role, a column for each turn."""
    c = _table(spark, sf_dir, "conversations")
    book, col = F.call_function("div", F.col("conv_id"), F.lit(40)).cast("string").alias("workbook"), F.concat(F.lit("C"), F.col("turn").cast("string")).alias("col")
    row = (F.col("conv_id") % 40 + 2).cast("long").alias("row")
    value = F.when((F.col("conv_id") % 40 == 0) & (F.col("turn") % 2 == 0), F.concat(F.lit("VU"), F.col("turn").cast("string"))).otherwise(F.concat(F.lit("f"), F.col("conv_id").cast("string"), F.lit("/")))
    rows = c.groupBy(book, F.col("role").alias("sheet"), row, col).agg(F.min(value).alias("value"))
    label = F.concat(F.lit("CXZ"), F.lpad((F.col("turn") + 100).cast("string"), 3, "0"), F.lit("L7"))
    heads = c.where("turn % 5 <> 4").select(book, F.col("role").alias("sheet"), F.lit(1).cast("long").alias("row"), col, label.alias("value")).distinct()  # every fifth column has no tape
    return rows.unionByName(heads)


_CELLS = """WITH b AS (SELECT CAST(conv_id // 40 AS VARCHAR) AS workbook, role AS sheet, conv_id % 40 + 2 AS row, 'C' || turn AS col, min(CASE WHEN conv_id % 40 = 0 AND turn % 2 = 0 THEN 'VU' || turn ELSE 'f' || conv_id || '/' END) AS value FROM conversations GROUP BY ALL),
h AS (SELECT DISTINCT CAST(conv_id // 40 AS VARCHAR) AS workbook, role AS sheet, 'C' || turn AS col, 'CXZ' || (turn + 100) || 'L7' AS cassette, 'cxz' || (turn + 100) AS norm FROM conversations WHERE turn % 5 <> 4)"""


@query("manual_map_unpivot", _CELLS + " SELECT b.workbook, b.sheet, b.row, b.col, cassette, norm AS cassette_norm, coalesce(n.value, '') AS note, b.value AS folder, trim(lower(b.value), '/') AS folder_norm FROM b JOIN h USING (workbook, sheet, col) LEFT JOIN b n ON n.workbook = b.workbook AND n.sheet = b.sheet AND n.col = b.col AND n.row = 2 AND regexp_full_match(rtrim(n.value, '/'), '[A-Za-z_ -]+[0-9]+') WHERE NOT (b.row = 2 AND regexp_full_match(rtrim(b.value, '/'), '[A-Za-z_ -]+[0-9]+'))")
def manual_map_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.xlsx import cassette_map

    return cassette_map(_cells(spark, sf_dir), ascii_only=True)


@query("catalog_header_discovery", "WITH c AS (SELECT conv_id % 50 AS book, turn AS row, role AS value FROM conversations), f AS (SELECT book, row FROM c WHERE value IN ('user', 'assistant') GROUP BY ALL HAVING count(DISTINCT value) = 2) SELECT CAST(book AS VARCHAR) AS workbook, min(row) AS header_row FROM f GROUP BY book")
def catalog_header_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.xlsx import header_rows

    c = _table(spark, sf_dir, "conversations").select((F.col("conv_id") % 50).cast("string").alias("workbook"), F.lit("s").alias("sheet"), F.col("turn").alias("row"), F.col("conv_id").cast("string").alias("col"), F.col("role").alias("value"))
    return header_rows(c, ("user", "assistant")).select("workbook", "header_row").distinct()
