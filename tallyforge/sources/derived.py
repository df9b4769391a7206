"""Manifests and inventories derived from the orders table: every reconciliation case occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOTS = ("/mnt/VIDEO0/SOURCE", "/mnt/VIDEO1/SOURCE")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, g = F.col("o_orderkey"), F.col("o_custkey") % 97
    case = F.when((g < 40) & (k % 16 != 5), 99).when((g >= 40) & (g < 50) & (k % 16 != 2), 99).when((g >= 50) & (g < 60) & (k % 16 != 3), 99).otherwise(k % 16)
    return o.select(k.alias("k"), g.alias("g"), F.round(F.col("o_totalprice") * 100).cast("long").alias("sz"), case.cast("int").alias("c"))


def _copy(root: int, folder: str, size: Column, valid: int = 1) -> Column:
    return F.struct(F.lit(root).alias("root"), F.lit(folder).alias("dir"), size.cast("long").alias("size"), F.lit(valid).alias("valid"))


def storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, sz = F.col("c"), F.col("sz")
    copies = (
        F.when(c == 7, F.array().cast("array<struct<root:int,dir:string,size:bigint,valid:int>>"))
        .when(c.isin(8, 14), F.array(_copy(0, "new0", F.lit(0))))
        .when(c == 11, F.array(_copy(0, "new0", sz, 0)))
        .when(c == 12, F.array(_copy(0, "new0", sz), _copy(1, "new0", sz + 7)))
        .when(c == 13, F.array(_copy(0, "new0", sz), _copy(1, "new0", sz)))
        .when(c == 15, F.array(_copy(0, "new0", sz), _copy(0, "alt0", sz)))
        .otherwise(F.array(_copy(0, "new0", sz)))
    )
    rows = _orders(spark, sf_dir).select("k", "g", F.explode(copies).alias("x"))
    top, name = F.concat(F.lit("prj_"), F.col("g").cast("string")), F.concat(F.lit("clip_"), F.col("k").cast("string"), F.lit(".mov"))
    root = F.when(F.col("x.root") == 0, ROOTS[0]).otherwise(ROOTS[1])
    rows = rows.select(root.alias("source_root"), F.concat_ws("/", top, "x.dir", name).alias("relative_path"), top.alias("top_folder"), name.alias("filename"), F.col("x.valid").alias("path_encoding_valid"), F.col("x.size").alias("size_bytes"))
    return rows.select("*", F.concat_ws("/", "source_root", "relative_path").alias("absolute_path"), F.col("relative_path").alias("norm_path"), F.col("top_folder").alias("norm_top_folder"), F.col("filename").alias("norm_filename"), F.col("relative_path").cast("binary").alias("relative_path_bytes"))


def _entry(tape: str, folder: str, lo: Column | None, hi: Column | None) -> Column:
    null = F.lit(None).cast("long")
    return F.struct(F.lit(tape).alias("tape"), F.lit(folder).alias("dir"), (null if lo is None else lo.cast("long")).alias("lo"), (null if hi is None else hi.cast("long")).alias("hi"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k, lo, hi = F.col("c"), F.col("k"), F.col("sz") - 50, F.col("sz") + 49
    zero = F.lit(0)
    entries = (
        F.when(c.isin(0, 14), F.array().cast("array<struct<tape:string,dir:string,lo:bigint,hi:bigint>>"))
        .when(c.isin(1, 15), F.array(_entry("T1", "old0", lo, hi)))
        .when(c == 2, F.array(_entry("T1", "new0", None, None)))
        .when(c == 3, F.array(_entry("T1", "new0", lo + 900, hi + 900)))
        .when(c == 4, F.array(_entry("T1", "new0", lo, hi), _entry("T2", "new0", lo + 5000, hi + 5000)))
        .when(c == 5, F.array(_entry("T1", "new0", lo, hi), _entry("T2", "new0", lo, hi)))
        .when(c == 6, F.array(_entry("T1", "new0", lo, hi), _entry("T2", "new0", None, None)))
        .when((c == 9) | ((c == 7) & (k % 3 == 0)), F.array(_entry("T1", "new0", zero, zero)))
        .when(c == 10, F.array(_entry("T1", "old0", lo, hi), _entry("T2", "older0", lo, hi)))
        .otherwise(F.array(_entry("T1", "new0", lo, hi)))
    )
    rows = _orders(spark, sf_dir).select("k", "g", F.posexplode(entries).alias("i", "e"))
    top, name = F.concat(F.lit("prj_"), F.col("g").cast("string")), F.concat(F.lit("clip_"), F.col("k").cast("string"), F.lit(".mov"))
    known = F.col("e.lo").isNotNull()
    rows = rows.select(
        (F.col("k") * 2 + F.col("i")).alias("entry_id"), F.col("e.tape").alias("tape"), F.concat("e.tape", F.lit(".pdf")).alias("source_pdf"), (F.col("k") % 50 + 1).cast("int").alias("source_page"),
        F.concat_ws("/", top, "e.dir", name).alias("relative_path"), top.alias("top_folder"), name.alias("filename"),
        F.col("e.lo").alias("size_min_bytes"), F.col("e.hi").alias("size_max_bytes"), known.cast("int").alias("size_known"), F.when(known, F.concat(F.col("e.lo").cast("string"), F.lit(" B"))).otherwise("").alias("reported_size"),
    )
    return rows.select("*", F.col("relative_path").alias("norm_path"), F.col("top_folder").alias("norm_top_folder"), F.col("filename").alias("norm_filename"))
