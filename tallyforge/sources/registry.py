"""Idempotent imports into a folder of Parquet tables.

Rows are staged under the content hash of their source and become visible by the registry
entries that are written last, in one file; an import that died leaves an unregistered folder
that the next one replaces. A single writer is assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lines as report_lines
from .snapshot import _path

SCHEMA_VERSION = 4
REGISTRY = "content_sha256 string, source string, kind string, units string, rows long, imported_at timestamp, schema_version int, seq long"
ALL = "*"  # as content_sha256: everything of the kind that was imported before is replaced

REPORT_KINDS = ("parse_issue", "report_stats", "manifest")
#: Legacy defaults of metadata that an import may lack.
DEFAULTS = {"pdf_size_units": "decimal", "server_hostname": "", "server_ip": "", "volume_name": "", "volume_root": ""}


def _entries(spark: SparkSession, store: str) -> DataFrame:
    """All entries ever written; those of older versions have no ``seq`` and come first, by time."""
    p, fs = _path(spark, f"{store}/registry")
    df = spark.read.schema(REGISTRY).parquet(str(p)) if fs.exists(p) else spark.createDataFrame([], REGISTRY)
    newest = df.agg(F.max("schema_version")).first()[0]
    if newest and newest > SCHEMA_VERSION:
        raise ValueError(f"store has schema version {newest}, this code knows {SCHEMA_VERSION}")
    return df.withColumn("seq", F.coalesce("seq", F.lit(0))).withColumn("units", F.coalesce("units", F.lit("")))


def registry(spark: SparkSession, store: str) -> DataFrame:
    """Entries that hold: those of a kind that no later replacement took away."""
    df = _entries(spark, store)
    gone = df.where(F.col("content_sha256") == ALL).groupBy("kind").agg(F.max("seq").alias("replaced"))
    return df.where(F.col("content_sha256") != ALL).join(gone, "kind", "left").where(F.col("seq") >= F.coalesce("replaced", F.lit(0))).select(*[c.split()[0] for c in REGISTRY.split(", ")])


def init_store(spark: SparkSession, store: str) -> str:
    """An empty store of the current version, or one of an older version rewritten as such."""
    p, fs = _path(spark, f"{store}/registry")
    if not fs.exists(p):
        spark.createDataFrame([], REGISTRY).write.parquet(str(p))
        return "CREATED"
    old = _entries(spark, store)
    if old.where(F.col("schema_version") < SCHEMA_VERSION).isEmpty():
        return "CURRENT"
    # numbered by time: what was imported later stays later
    rows = sorted(old.collect(), key=lambda r: (r["seq"], r["imported_at"]))  # one entry for each imported source
    rows = [(*r[:6], SCHEMA_VERSION, i + 1) for i, r in enumerate(rows)]
    fresh, before = _path(spark, f"{store}/registry_new")[0], _path(spark, f"{store}/registry_v{rows[0][6] - 1}")[0]
    spark.createDataFrame(rows, REGISTRY).coalesce(1).write.mode("overwrite").parquet(str(fresh))
    if not fs.rename(p, before) or not fs.rename(fresh, p):
        raise ValueError(f"registry can't be renamed: {store}")
    return "MIGRATED"


def new_sources(spark: SparkSession, store: str, sources: DataFrame, kind: str) -> DataFrame:
    """Of (source, content_sha256): those not imported yet; a known source with other content is an error."""
    known = registry(spark, store).where(F.col("kind") == kind)
    changed = sources.join(known.select("source", F.col("content_sha256").alias("old")), "source").where("old <> content_sha256").limit(1).collect()
    if changed:
        raise ValueError(f"source changed since its import: {changed[0]['source']}")
    return sources.join(known.select("content_sha256"), "content_sha256", "left_anti")


def stage(spark: SparkSession, store: str, kind: str, rows: DataFrame, sha: str) -> int:
    """Writes one source's rows where no reader looks before they are registered; their count."""
    path = f"{store}/{kind}/content_sha256={sha}"
    rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).count()


def register(spark: SparkSession, store: str, entries: list[tuple[str, int, str]], source: str, units: str = "", replace: bool = False) -> None:
    """Makes staged (kind, rows, content_sha256) visible together, in place of all earlier ones of their kinds if ``replace``: one file is written."""
    seq = (_entries(spark, store).agg(F.max("seq")).first()[0] or 0) + 1
    rows = [(sha, source, kind, units, n, SCHEMA_VERSION, seq) for kind, n, sha in entries]
    if replace:
        rows += [(ALL, source, kind, units, 0, SCHEMA_VERSION, seq) for kind, _, _ in entries]
    df = spark.createDataFrame(rows, "content_sha256 string, source string, kind string, units string, rows long, schema_version int, seq long").withColumn("imported_at", F.current_timestamp())
    df.select(*[c.split()[0] for c in REGISTRY.split(", ")]).coalesce(1).write.mode("append").parquet(f"{store}/registry")


def check_source(spark: SparkSession, store: str, kind: str, source: str, sha: str, units: str) -> bool:
    """Whether the source is new to the kind. One that changed in place, or has other units than the rest, is an error."""
    reg = registry(spark, store).where(F.col("kind") == kind)
    own = spark.createDataFrame([(source, sha)], "source string, content_sha256 string")
    if new_sources(spark, store, own, kind).isEmpty():
        return False
    other = reg.where(F.col("units") != units).limit(1).collect() if units else []
    if other:
        raise ValueError(f"units differ from earlier imports: {other[0]['units']}")
    return True


def commit(spark: SparkSession, store: str, kind: str, rows: DataFrame, source: str, sha: str, units: str = "") -> str:
    """Appends one source's rows; ALREADY_IMPORTED or IMPORTED:<rows>."""
    if not check_source(spark, store, kind, source, sha, units):
        return "ALREADY_IMPORTED"
    n = stage(spark, store, kind, rows, sha)
    register(spark, store, [(kind, n, sha)], source, units)
    return f"IMPORTED:{n}"


def imported(spark: SparkSession, store: str, kind: str) -> DataFrame:
    """Rows of registered imports only."""
    known = registry(spark, store).where(F.col("kind") == kind).select("content_sha256")
    return spark.read.parquet(f"{store}/{kind}").join(known, "content_sha256", "left_semi")


def import_report(spark: SparkSession, store: str, path: str, units: str = "decimal", replace: bool = False) -> str:
    """A text report: hashed first, parsed only if new. ``replace``: in place of all earlier reports, whatever their units."""
    sha = content_sha(spark, path)
    if not replace and not check_source(spark, store, "manifest", path, sha, units):
        return "ALREADY_IMPORTED"
    done = commit_report(spark, store, report_lines.parse_lines(text_lines(spark, path), units), path, sha, units, replace)
    if content_sha(spark, path) != sha:
        raise ValueError(f"report changed while it was read: {path}")
    return done


def content_sha(spark: SparkSession, path: str) -> str:
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def commit_report(spark: SparkSession, store: str, parsed: DataFrame, source: str, sha: str, units: str, replace: bool = False) -> str:
    """Entries, parse issues and counts of a report become visible together."""
    parsed = parsed.persist()
    try:
        parts = {"parse_issue": report_lines.parse_issues(parsed), "report_stats": report_lines.report_stats(parsed), "manifest": report_lines.entries(parsed)}
        counts = {kind: stage(spark, store, kind, rows, sha) for kind, rows in parts.items()}
    finally:
        parsed.unpersist()
    register(spark, store, [(kind, n, sha) for kind, n in counts.items()], source, units, replace)
    return f"IMPORTED:{counts['manifest']}"


def reports(spark: SparkSession, store: str) -> DataFrame:
    """One row for each imported report with its counts: report_id, source_pdf, project, units, expected and extracted files, issues, difference."""
    reg = registry(spark, store).where("kind = 'manifest'").select("content_sha256", "units", "rows", "imported_at")
    stats = imported(spark, store, "report_stats")
    return with_stats(reg, stats).withColumnRenamed("content_sha256", "report_id")


def with_stats(entries: DataFrame, stats: DataFrame) -> DataFrame:
    """Registered reports with the counts of their parser; a report of an older version has none."""
    return entries.join(stats, "content_sha256", "left").withColumn("units", F.when(F.coalesce("units", F.lit("")) == "", DEFAULTS["pdf_size_units"]).otherwise(F.col("units")))


def union_roots(parts: list[DataFrame]) -> DataFrame:
    """The distinct source_root of several tables."""
    out = parts[0].select("source_root")
    for p in parts[1:]:
        out = out.union(p.select("source_root"))
    return out.distinct()


def source_roots(spark: SparkSession, store: str) -> list[str]:
    """Roots of all imported scans, from their counts, and from their files where an older import has none."""
    kinds = {r["kind"] for r in registry(spark, store).select("kind").distinct().collect()}
    parts = [imported(spark, store, kind) for kind in ("scan_stats", "storage") if kind in kinds]
    return sorted(r[0] for r in union_roots(parts).collect()) if parts else []


def distinct_contents(sources: DataFrame) -> DataFrame:
    """Of (source, content): (content_sha256, source, copies), one row for each content, with its lowest source."""
    return sources.groupBy(F.sha2("content", 256).alias("content_sha256")).agg(F.min("source").alias("source"), F.count("*").alias("copies"))


def check_identity(spark: SparkSession, store: str, scan: dict) -> None:
    """A scan must not contradict earlier ones: a server has one address, a volume of a server one root, a snapshot one content."""
    if registry(spark, store).where("kind = 'storage_scan'").isEmpty():
        return
    wrong = conflicts(imported(spark, store, "storage_scan"), spark.createDataFrame([scan], SCAN)).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['conflict']} conflict for {wrong[0]['name']}")


SCAN = "snapshot_id string, server string, server_ip string, volume string, volume_root string, files long, bytes long, issues long"


def conflicts(known: DataFrame, new: DataFrame) -> DataFrame:
    """(conflict, name) of (SCAN) rows that contradict known ones."""
    k = lambda c: F.col(f"k.{c}")
    n = lambda c: F.col(f"n.{c}")
    parts = (
        ("server", known.select("server", "server_ip").distinct(), [k("server") == n("server")], ["server_ip"], n("server")),
        ("volume", known.select("server", "volume", "volume_root").distinct(), [k("server") == n("server"), k("volume") == n("volume")], ["volume_root"], n("volume")),
        ("snapshot", known.select(*[c.split()[0] for c in SCAN.split(", ")]).distinct(), [k("snapshot_id") == n("snapshot_id")], [c.split()[0] for c in SCAN.split(", ")[1:]], n("snapshot_id")),
    )
    out = None
    for what, old, keys, values, name in parts:
        other = F.lit(False)
        for v in values:
            other = other | ~k(v).eqNullSafe(n(v))
        rows = old.alias("k").join(new.alias("n"), keys).where(other).select(F.lit(what).alias("conflict"), name.alias("name")).distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def volumes(scans: DataFrame) -> DataFrame:
    """(server, server_ip, volume, volume_root, scans, files, bytes) of imported scans."""
    return scans.groupBy("server", "server_ip", "volume", "volume_root").agg(F.count("*").alias("scans"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pdf, line_no, page, line) of text reports; form feeds start pages, blank lines go."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("pdf"), F.posexplode(F.split("value", "\f")).alias("p", "page_text"))
    rows = whole.select("pdf", (F.col("p") + 1).alias("page"), F.posexplode(F.split("page_text", "\r?\n")).alias("i", "line"))
    return rows.select("pdf", (F.col("page").cast("long") * (1 << 32) + F.col("i")).alias("line_no"), F.col("page").cast("int").alias("page"), F.trim("line").alias("line")).where("line <> ''")


def latest(values: DataFrame) -> DataFrame:
    """Key-value metadata: the last value of each key by ``at``; keys without one have their legacy default."""
    spark = values.sparkSession
    found = values.groupBy("key").agg(F.max_by("value", "at").alias("value"))
    usual = spark.createDataFrame(sorted(DEFAULTS.items()), "key string, value string")
    return found.unionByName(usual.join(found, "key", "left_anti"))
