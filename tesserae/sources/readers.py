"""Readers of formats that Spark has no source for, over ``binaryFile`` rows.

Each file is read by one task from the bytes Spark hands over, so that any store works.
"""

from __future__ import annotations

import base64
import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _column(reference: str) -> int:
    """0-based column of a cell reference such as AB12."""
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return max(n - 1, 0)


#: The attribute of a sheet that names its file's relationship.
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook_rows(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """``(sheet, row, cells)`` of a workbook's stored values; formulas give their last result."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in root.findall("m:si", _NS)]
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS)
        targets: dict[str | None, str] = {}
        if "xl/_rels/workbook.xml.rels" in names:
            for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
                target = r.get("Target", "")
                targets[r.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        for k, found in enumerate(sheets, 1):
            sheet, file = found.get("name"), targets.get(found.get(_REL_ID), f"xl/worksheets/sheet{k}.xml")
            if file not in names:
                continue
            for row in ElementTree.fromstring(z.read(file)).iter(f"{{{_NS['m']}}}row"):
                cells: list[str | None] = []
                for c in row.findall("m:c", _NS):
                    at = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    value = c.find("m:v", _NS)
                    text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if c.get("t") == "inlineStr" else value.text if value is not None else None
                    cells.append(shared[int(text)] if c.get("t") == "s" and text is not None else text)
                yield sheet, int(row.get("r", 0)), cells


def read_workbooks(files: DataFrame) -> DataFrame:
    """``path, sheet, row_no, cells`` of ``path, content`` rows; a file that isn't a workbook gives none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(path, *r) for r in workbook_rows(data)]
                except (zipfile.BadZipFile, KeyError):
                    continue
            kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["path", "sheet", "row_no", "cells"])

    return files.select("path", "content").mapInArrow(read, "path string, sheet string, row_no long, cells array<string>")


def page_images(files: DataFrame, render: Callable[[bytes], Iterable[bytes | None]]) -> DataFrame:
    """``path, page_number, image_b64`` by a given rasterizer of a file's bytes to its pages' PNGs.

    A page that fails keeps its row with a null image; a file that fails gives no rows.
    """

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(path, i, base64.b64encode(x).decode() if x is not None else None) for i, x in enumerate(render(data), 1)]
                except Exception as e:  # the renderer is the caller's: what it raises isn't known
                    print(f"{path}: {e}")
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["path", "page_number", "image_b64"])

    return files.select("path", "content").mapInArrow(pages, "path string, page_number int, image_b64 string")


def latest_results(spark: SparkSession, folder: str, n: int = 1) -> DataFrame:
    """Rows of the ``n`` newest result files (JSON lines) by the time stamp in their names."""
    rows = spark.read.json(folder).withColumn("run", F.regexp_extract(F.input_file_name(), r"(\d{8}_?\d{6})", 1))
    newest = rows.select("run").distinct().orderBy(F.desc("run")).limit(n)
    return rows.join(F.broadcast(newest), "run", "left_semi")


def export_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV: booleans and nulls as text, nested columns as JSON."""
    for name, df in tables.items():
        kinds = dict(df.dtypes)
        nested = lambda t: t.startswith(("array", "map", "struct"))
        text = [(F.to_json(c) if nested(kinds[c]) else F.initcap(F.col(c).cast("string")) if kinds[c] == "boolean" else F.col(c).cast("string")).alias(c) for c in df.columns]
        df.select(*text).fillna("").write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def page_markdown(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """``key, content`` for each row of ``keys`` (one column): the text of ``<key>.md`` in a folder without white
    space around it, and an empty one where there is no such file."""
    key = keys.columns[0]
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    name = F.regexp_extract(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"^(.*)\.md$", 1)
    found = files.select(name.alias("_key"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("_text"))
    return keys.join(found, F.col(key) == F.col("_key"), "left").select(F.col(key).alias("key"), F.coalesce("_text", F.lit("")).alias("content"))
