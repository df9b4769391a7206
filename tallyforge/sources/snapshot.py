"""Snapshots: written once with a commit marker, verified and compared as tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "_COMPLETE.json"


def snapshot_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (with repeats) that only one side has; none means that a snapshot was not changed."""
    return old.exceptAll(new).withColumn("side", F.lit("only_old")).unionByName(new.exceptAll(old).withColumn("side", F.lit("only_new")))


def _path(spark: SparkSession, name: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(name)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_snapshot(files: DataFrame, path: str, metadata: dict, issues: DataFrame | None = None) -> dict:
    """Parquet files and issues, then the marker with counts: a snapshot without marker is incomplete. An existing path is refused."""
    spark = files.sparkSession
    p, fs = _path(spark, path)
    if fs.exists(p):
        raise FileExistsError(path)
    files.write.parquet(f"{path}/files")
    got = spark.read.parquet(f"{path}/files").agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b")).first()
    metadata = {**metadata, "files": got["n"], "bytes": got["b"]}
    if issues is not None:
        issues.write.parquet(f"{path}/issues")
        metadata["issues"] = spark.read.parquet(f"{path}/issues").count()
    marker, _ = _path(spark, f"{path}/{MARKER}")
    out = fs.create(marker, False)
    out.write(bytearray(json.dumps(metadata, sort_keys=True).encode()))
    out.close()
    return metadata


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(files, metadata) of a complete snapshot whose counts and unique paths still hold."""
    marker, fs = _path(spark, f"{path}/{MARKER}")
    if not fs.exists(marker):
        raise ValueError(f"snapshot is not complete: {path}")
    stream = fs.open(marker)  # Spark's readers skip names that begin with '_'
    metadata = json.loads(bytes(stream.readAllBytes()))
    stream.close()
    files = spark.read.parquet(f"{path}/files")
    n, b, distinct = files.agg(F.count("*"), F.coalesce(F.sum("size_bytes"), F.lit(0)), F.countDistinct("relative_path_bytes")).first()
    if (n, b) != (metadata["files"], metadata["bytes"]) or distinct != n:
        raise ValueError(f"snapshot does not match its metadata: {path}")
    return files, metadata


def read_issues(spark: SparkSession, path: str, metadata: dict) -> tuple[DataFrame, DataFrame]:
    """(scan issues, (source_root, files) that the scan counted) of a snapshot that ``read_snapshot`` gave."""
    if "issues" not in metadata or "root_files" not in metadata:
        raise ValueError(f"snapshot without issues or counts by root, scan again: {path}")
    issues = spark.read.parquet(f"{path}/issues")
    if issues.count() != metadata["issues"]:
        raise ValueError(f"snapshot does not match its metadata: {path}")
    return issues, spark.createDataFrame(sorted(metadata["root_files"].items()), "source_root string, files long")
