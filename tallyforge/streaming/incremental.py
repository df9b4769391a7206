"""Incremental import as a stream: reports that land in a folder are parsed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import lines, registry

LANDED = "path string, modificationTime timestamp, length long, content binary"


def report_lines(batch: DataFrame) -> DataFrame:
    """Line table of landed files (path, content)."""
    pages = batch.select(F.col("path").alias("pdf"), F.posexplode(F.split(F.col("content").cast("string"), "\f")).alias("p", "text"))
    rows = pages.select("pdf", "p", F.posexplode(F.split("text", "\r?\n")).alias("i", "line"))
    return rows.select("pdf", (F.col("p").cast("long") * (1 << 32) + F.col("i")).alias("line_no"), (F.col("p") + 1).cast("int").alias("page"), F.trim("line").alias("line")).where("line <> ''")


def import_batch(store: str, units: str):
    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        landed = batch.withColumn("content_sha256", F.sha2("content", 256))
        fresh = registry.new_sources(spark, store, landed.select(F.col("path").alias("source"), "content_sha256"), "manifest")
        # one source a commit: the registry entry makes each visible; a batch has few files
        for r in fresh.dropDuplicates(["content_sha256"]).collect():
            one = landed.where(F.col("path") == r["source"])
            registry.commit_report(spark, store, lines.parse_lines(report_lines(one), units), r["source"], r["content_sha256"], units)

    return run


def start_import(spark: SparkSession, landing: str, store: str, units: str = "decimal", available_now: bool = True) -> StreamingQuery:
    """Reads new files of ``landing``; a file seen twice, or the same content under two names, is imported once."""
    stream = spark.readStream.format("binaryFile").schema(LANDED).option("maxFilesPerTrigger", 64).load(landing)
    writer = stream.writeStream.foreachBatch(import_batch(store, units)).option("checkpointLocation", f"{store}/_stream")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
