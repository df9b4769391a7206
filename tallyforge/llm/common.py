"""Helpers that all training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import saved

__all__ = ["saved", "table", "hinted", "skew_join", "fresh", "n_words", "lower_ascii", "slices", "trim", "WORD", "HOT", "SALTS"]

#: White space of the word definition: blank and U+0009 to U+000D; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hinted(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """A broadcast hint if the (already saved) ``df`` has at most ``max_rows`` rows; else a plain join side."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


HOT = 256  # keys that ``skew_join`` may salt: no other has more than a 257th of the rows
SALTS = 64


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], least: int = 1_000) -> DataFrame:
    """Inner join with a ``right`` of one row for each key, whose column ``n`` counts the key's rows in ``left``.

    The (at most ``HOT``) most frequent keys of ``least`` rows or more are dealt over ``SALTS``
    parts by a hash of the columns ``spread``, so that no key lands in one task. ``right``
    should be saved. Columns ``_hot`` and ``_salt`` are used.
    """
    hot = F.broadcast(right.where(F.col("n") >= least).orderBy(F.desc("n"), *keys).limit(HOT).select(*keys, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = left.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    right = right.join(hot, keys, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores until ``df`` has no such column (Spark ignores case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``size`` bytes of a text column each; one text is never cut."""
    if not len(batch):
        return
    upto = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    part = np.concatenate([[0], upto[:-1]]) // size
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield batch.slice(a, b - a)


_LIBC = ctypes.CDLL(None)


def trim() -> None:
    """Hands memory that a task no longer uses back to the system; Python workers outlive tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)
