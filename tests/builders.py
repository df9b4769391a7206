"""Small manifests and inventories for tests."""

from pyspark.sql import functions as F

M = "entry_id long, tape string, relative_path string, size_min_bytes long, size_max_bytes long"
S = "source_root string, relative_path string, size_bytes long, path_encoding_valid int"


def manifest(spark, rows):
    """rows: (path, lo or None, hi, tape)."""
    df = spark.createDataFrame([(i, t, p, lo, hi) for i, (p, lo, hi, t) in enumerate(rows)], M)
    top, name = F.substring_index("relative_path", "/", 1), F.substring_index("relative_path", "/", -1)
    shown = F.coalesce(F.concat(F.col("size_min_bytes").cast("string"), F.lit(" B")), F.lit(""))
    return df.select("*", F.lower("relative_path").alias("norm_path"), top.alias("top_folder"), F.lower(top).alias("norm_top_folder"), name.alias("filename"), F.lower(name).alias("norm_filename"), F.col("size_min_bytes").isNotNull().cast("int").alias("size_known"), shown.alias("reported_size"), F.concat("tape", F.lit(".pdf")).alias("source_pdf"), F.lit(1).alias("source_page"))


def storage(spark, rows):
    """rows: (root, path, size) or (root, path, size, valid)."""
    df = spark.createDataFrame([(*r, 1)[:4] for r in rows], S)
    top, name = F.substring_index("relative_path", "/", 1), F.substring_index("relative_path", "/", -1)
    return df.select("*", F.lower("relative_path").alias("norm_path"), top.alias("top_folder"), F.lower(top).alias("norm_top_folder"), name.alias("filename"), F.lower(name).alias("norm_filename"), F.concat_ws("/", "source_root", "relative_path").alias("absolute_path"), F.col("relative_path").cast("binary").alias("relative_path_bytes"))
