"""Sharding by extendible hashing: a directory of hash-prefix bits under a byte limit.

Every document has 60 bits of a hash of its id and text. A bucket is a prefix of those bits;
starting from the empty prefix only buckets above the byte limit split on one more bit. A
bucket stops splitting when it fits or when all its rows have one hash. The bytes of fine
cells (a bounded number of prefix bits) are summed in one shuffle; a task folds these at most
2^FINE_BITS sums pairwise into all coarser levels and reads the directory off. Cells that are
still too large become directories of their own on the next bits, one group each. Rows that
agree in id and text share all bits; if such copies alone exceed the limit, they are dealt
over numbered overflow pages. A single row above the limit has a shard for itself.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hinted, saved, table

BITS = 60
FINE_BITS = 16  # a directory's task folds at most 65,536 sums
LIMIT = 8 << 20


def hash_bits(doc_id, text):
    """60 bits as a long, from the hex digits of md5."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def split_cells(sums: np.ndarray, keys: np.ndarray, limit: int) -> np.ndarray:
    """Depth at which each fine cell's bucket stops, or -1 where it must be refined.

    sums: bytes by cell, 2^d of them; keys: distinct hashes by cell (2 stands for more).
    """
    d = int(math.log2(len(sums)))
    depth = np.full(len(sums), -1, dtype=np.int64)
    s, k = sums, keys
    for level in range(d, -1, -1):  # coarser buckets overwrite finer ones
        ok = (s <= limit) | (k <= 1)
        depth[np.repeat(ok, 1 << (d - level))] = level
        if level:
            s, k = s.reshape(-1, 2).sum(axis=1), np.minimum(k.reshape(-1, 2).sum(axis=1), 2)
    return depth


def leaf_depths(cells: DataFrame, limit: int, upto: int, bits: int) -> DataFrame:
    """(cell, depth) of (base, cell, b, k): one directory below each base, of at most 2^bits cells; depth -1 where a cell must be refined."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b, k = np.zeros(1 << bits, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)
        at = pdf["cell"].to_numpy() - (int(pdf["base"].iloc[0]) << bits)
        b[at], k[at] = pdf["b"].to_numpy(), pdf["k"].to_numpy()
        depth = split_cells(b, k, limit)[at]
        return pd.DataFrame({"cell": pdf["cell"], "depth": np.where(depth < 0, -1, depth + upto - bits)})

    return cells.groupBy("base").applyInPandas(run, "cell long, depth int")


def shard_by_hash(df: DataFrame, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, depth, prefix, page): ``prefix`` is the bucket's bits as a 0/1 string of length ``depth``.

    A null text has 0 bytes; repeated rows are all placed; an empty table gives no rows; other
    columns are ignored.
    """
    slim = saved(df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(F.col(doc_id), F.col(text)).alias("h")))
    total = slim.agg(F.sum("n_bytes")).first()[0] or 0
    open_rows, leaves, done = slim, [], 0
    while done < BITS:
        # four bits more than an even spread needs, so that a second round is rare
        bits = min(FINE_BITS, BITS - done, max(4, math.ceil(math.log2(total / limit / (1 << done) + 1)) + 4))
        upto = done + bits
        cell = F.shiftright("h", BITS - upto)
        cells = open_rows.groupBy(F.shiftright("h", BITS - done).alias("base"), cell.alias("cell")).agg(F.sum("n_bytes").alias("b"), F.when(F.min("h") == F.max("h"), 1).otherwise(2).alias("k"))
        directory = saved(leaf_depths(cells, limit, upto, bits))
        placed = open_rows.withColumn("cell", cell).join(hinted(directory, 1 << FINE_BITS), "cell")
        leaves.append(placed.where("depth >= 0").select("doc_id", "n_bytes", "h", "depth"))
        if directory.where("depth < 0").isEmpty():
            break
        open_rows, done = saved(placed.where("depth < 0").select("doc_id", "n_bytes", "h")), upto
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    out = out.withColumn("prefix", F.when(F.col("depth") == 0, "").otherwise(F.substring(F.lpad(F.bin("h"), BITS, "0"), F.lit(1), F.col("depth"))))
    return overflow_pages(out, limit)


def overflow_pages(out: DataFrame, limit: int) -> DataFrame:
    """Pages for the copies of one row that alone exceed the limit; page 0 for all others.

    The copies are numbered by (task, hash): each task counts its own, a small table of those
    counts gives the offsets.
    """
    big = saved(out.groupBy("h").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.max("n_bytes").alias("one")).where((F.col("b") > limit) & (F.col("n") > 1)).select("h", "one"))
    cols = ("doc_id", "n_bytes", "depth", "prefix")
    if big.isEmpty():
        return out.select(*cols, F.lit(0).cast("long").alias("page"))
    rest = out.join(hinted(big), "h", "left_anti").select(*cols, F.lit(0).cast("long").alias("page"))
    hot = saved(out.join(hinted(big), "h").withColumn("task", F.spark_partition_id()))
    counts = hot.groupBy("h", "task").agg(F.count("*").alias("n"))
    run = Window.partitionBy("h").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(counts.select("h", "task", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("start")))
    own = F.row_number().over(Window.partitionBy("h", "task").orderBy("doc_id")) - 1
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("one"))).cast("long")
    hot = hot.withColumn("own", own).join(hinted(offsets), ["h", "task"]).withColumn("page", F.expr("(start + own)").cast("long"))
    return rest.unionByName(hot.select(*cols, F.floor(F.col("page") / each).cast("long").alias("page")))


def op7_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_hash(table(spark, sf_dir, "documents"))


OP7_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
         lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT)), {BITS}, '0') AS bits
  FROM documents),
b(depth, prefix) AS (
  SELECT 0, ''
  UNION ALL
  SELECT x.depth + 1, substr(x.bits, 1, x.depth + 1) FROM (
    SELECT DISTINCT b.depth, d.bits FROM b JOIN (
      SELECT b.prefix AS p FROM b JOIN d ON starts_with(d.bits, b.prefix) GROUP BY b.prefix
      HAVING sum(n_bytes) > {LIMIT} AND count(DISTINCT bits) > 1) o ON o.p = b.prefix
    JOIN d ON starts_with(d.bits, b.prefix)) x
  WHERE x.depth < {BITS}),
leaf AS (SELECT d.doc_id, d.n_bytes, max(b.depth) AS depth, d.bits FROM d JOIN b ON starts_with(d.bits, b.prefix) GROUP BY d.doc_id, d.n_bytes, d.bits)
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth, substr(bits, 1, depth) AS prefix, CAST(0 AS BIGINT) AS page FROM leaf
"""
