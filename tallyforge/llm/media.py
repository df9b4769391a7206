"""Media columns: payloads as progressive JPEG files, read back into coefficients and RGB tensors.

A payload fills the quantised coefficients of a 4:2:0 image, one byte less 128 for each, 64 to
a block: four luma blocks, then one of each chroma for an MCU. The format's unit is thus a
coefficient, which progressive scans carry without loss. Reading accumulates all scans into
coefficient arrays, takes the payload from them, transforms them into samples, upsamples
chroma and gives the full-resolution RGB tensor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg
from .common import table

BATCH = 400_000  # payload bytes that are coded together; one payload is never cut


def mcu_grid(blocks: int) -> tuple[int, int]:
    mcus = max(1, -(-blocks // 6))
    w = math.isqrt(mcus - 1) + 1
    return w, -(-mcus // w)


def encode(payloads: list[bytes]) -> list[bytes]:
    """Progressive JPEG files; payloads are positive multiples of 64 bytes. The comment has the payload's length."""
    grids = [mcu_grid(len(p) // 64) for p in payloads]
    n = sum(w * h for w, h in grids)
    cells = np.zeros((n, 6, 64), np.int32)
    at = 0
    for p, (w, h) in zip(payloads, grids, strict=True):
        own = cells[at : at + w * h].reshape(-1, 64)
        own[: len(p) // 64] = np.frombuffer(p, np.uint8).reshape(-1, 64).astype(np.int32) - 128
        at += w * h
    return jpeg.write_all(cells[:, :4].reshape(-1, 64), cells[:, 4], cells[:, 5], grids, [len(p).to_bytes(8, "big") for p in payloads])


def decode(files: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(payload, RGB tensor) of each file of ``encode``."""
    images, coef = jpeg.read_all(files)
    out = []
    for im, rgb in zip(images, jpeg.rgb_tensors(images, coef), strict=True):
        y, cb, cr = im.components
        luma = coef[y.base : y.base + y.rows * y.cols].reshape(y.rows // 2, 2, y.cols // 2, 2, 64).swapaxes(1, 2).reshape(-1, 4, 64)
        cells = np.concatenate([luma, coef[cb.base :][: cb.rows * cb.cols, None], coef[cr.base :][: cr.rows * cr.cols, None]], axis=1)
        payload = (cells.reshape(-1)[: int.from_bytes(im.comment, "big")] + 128).astype(np.uint8).tobytes()
        out.append((payload, rgb))
    return out


def media_columns(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media, payload, height, width, rgb) of every row.

    media: the JPEG file; payload: read back from it; rgb: the tensor's bytes, height x width x
    3. A null text is an empty one, whose payload is 64 zero bytes. Every row of repeated rows
    is stored; an empty table gives no rows; other columns are ignored.
    """
    names = ("doc_id", "n_bytes", "media", "payload", "height", "width", "rgb")
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary())

    def flush(held: list[tuple]) -> pa.RecordBatch:
        distinct = list(dict.fromkeys(p for _, _, p in held))  # copies within a batch are coded once
        files = encode(distinct)
        known = {p: (f, back, *rgb.shape[:2], rgb.tobytes()) for p, f, (back, rgb) in zip(distinct, files, decode(files), strict=True)}
        rows = [(d, n, *known[p]) for d, n, p in held]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for d, t in zip(b.column(0), b.column(1), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                held.append((d.as_py(), len(raw), raw + bytes(-len(raw) % 64 if raw else 64)))
                size += len(held[-1][2])
                if size >= BATCH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return df.select(doc_id, text).mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, height int, width int, rgb binary")


def image_features(rgb: Column) -> Column:
    """A 32-bit check sum of the tensor as 8 hex digits."""
    return F.lpad(F.lower(F.hex(F.crc32(rgb))), 8, "0")


def op4_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media_columns(table(spark, sf_dir, "documents"))
    size = F.octet_length("payload")
    return m.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"), image_features(F.col("rgb"))).alias("feature"),
    )
