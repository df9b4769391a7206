"""Workbook cells as a long table, and the catalog and cassette-map rows in them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import cassette_label, fold, normal_path
from ..functions.sizes import catalog_size

#: Fixed values of the workbook format: XML name spaces and the catalog's header names.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
NOTE = r"^[A-Za-zА-Яа-я_ -]+[0-9]+$"


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def read_cells(content: bytes) -> Iterator[tuple[str, int, str, str]]:
    """(sheet, row, column letters, value) of all cells that are not empty; rows are freed as they are read."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            target = targets[sheet.get(f"{REL}id")].lstrip("/")
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
                for _, row in ElementTree.iterparse(f):
                    if row.tag != f"{MAIN}row":
                        continue
                    for c in row.iter(f"{MAIN}c"):
                        kind, v = c.get("t"), c.find(f"{MAIN}v")
                        value = _text(c) if kind == "inlineStr" else shared[int(v.text)] if kind == "s" and v is not None else (v.text or "") if v is not None else ""
                        if value != "":
                            yield sheet.get("name"), int(row.get("r")), re.match("[A-Z]+", c.get("r"))[0], value
                    row.clear()


def cells(spark: SparkSession, path: str) -> DataFrame:
    """(workbook, sheet, row, col, value) of the workbooks at a path; one task for each workbook."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(p.rsplit("/", 1)[-1], *c) for c in read_cells(bytes(content))]
                yield pd.DataFrame(rows, columns=["workbook", "sheet", "row", "col", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "workbook string, sheet string, row long, col string, value string")


def header_rows(table: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(workbook, sheet, header_row, name, col): the first row of a sheet that has all names."""
    wanted = table.where(F.lower(F.trim("value")).isin(*names))
    full = wanted.groupBy("workbook", "sheet", "row").agg(F.countDistinct(F.lower(F.trim("value"))).alias("n")).where(F.col("n") == len(names))
    first = full.groupBy("workbook", "sheet").agg(F.min("row").alias("row"))
    cols = wanted.join(first, ["workbook", "sheet", "row"]).groupBy("workbook", "sheet", "row", F.lower(F.trim("value")).alias("name")).agg(F.min("col").alias("col"))
    return cols.withColumnRenamed("row", "header_row")


def records(table: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(workbook, sheet, row, <names>): rows below each sheet's header with any named cell."""
    heads = header_rows(table, names)
    data = table.join(heads, ["workbook", "sheet", "col"]).where(F.col("row") > F.col("header_row"))
    return data.groupBy("workbook", "sheet", "row").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def catalog(table: DataFrame, names: dict[str, str], ascii_only: bool = False) -> DataFrame:
    """Catalog files; ``names`` gives the header of project, cassette, path, filename and size."""
    r = records(table, tuple(names.values()))
    c = {k: F.coalesce(F.col(f"`{v}`"), F.lit("")) for k, v in names.items()}
    return r.select(
        "workbook", "sheet", "row", c["project"].alias("project_raw"), fold(c["project"], ascii_only).alias("project_norm"), c["cassette"].alias("cassette_raw"), cassette_label(c["cassette"], ascii_only).alias("cassette_norm"), c["path"].alias("path_raw"),
        normal_path(c["path"], ascii_only).alias("path_norm"), c["filename"].alias("filename_raw"), fold(c["filename"], ascii_only).alias("filename_norm"), c["size"].alias("size_raw"), catalog_size(c["size"]).alias("size_bytes"), normal_path(F.concat(c["path"], F.lit("/"), c["filename"]), ascii_only).alias("path"),
    )


def cassette_map(table: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Cells below row 1, which names a cassette for each column; a cell of row 2 that looks like a note is the note of its column."""
    key = ["workbook", "sheet", "col"]
    table = table.withColumn("value", F.trim("value")).where("value <> ''")
    heads = table.where("row = 1").select(*key, F.col("value").alias("cassette"))
    is_note = (F.col("row") == 2) & F.regexp_replace("value", r"[\\/]+$", "").rlike(NOTE)
    notes = table.where(is_note).select(*key, F.col("value").alias("note"))
    body = table.where((F.col("row") > 1) & ~is_note)
    out = body.join(heads, key).join(notes, key, "left")
    return out.select("workbook", "sheet", "row", "col", "cassette", cassette_label(F.col("cassette"), ascii_only).alias("cassette_norm"), F.coalesce("note", F.lit("")).alias("note"), F.col("value").alias("folder"), normal_path(F.col("value"), ascii_only).alias("folder_norm"))
