"""Loading flat tables (CSV, Excel, Parquet) with distinct errors for what cannot be one."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterable
from xml.etree import ElementTree

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.scratch import scratch_path

KINDS = (".csv", ".xlsx", ".parquet")
MOST_BYTES = 200 * 1024 * 1024
DATASET_ID = re.compile(r"[0-9a-f]{32}")


class LoadError(ValueError):
    """What was given is no usable table; the message says why."""


class TooLarge(LoadError):
    """More bytes than an upload may have."""


def unique_names(names: Iterable[str | None]) -> list[str]:
    """Blank names become column_1, column_2, ...; repeated ones get _2, _3, ... without meeting another name."""
    out: list[str] = []
    given = [(n or "").strip() for n in names]
    taken = {n for n in given if n}
    for i, n in enumerate(given, 1):
        base = n or f"column_{i}"
        name, k = base, 2
        while name in out or (name in taken and name != n):
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, types inferred; bytes that are not UTF-8 become replacement characters.

    A file whose every line has its quotes in pairs holds no record over several
    lines and is read in splits; else its records are read by one task a file.
    """
    head = spark.read.option("header", False).option("inferSchema", False).csv(path).limit(1).first()
    if head is None:
        raise LoadError("the file is empty")
    lines = spark.read.text(path)
    broken = not lines.filter(F.regexp_count("value", F.lit('"')) % 2 == 1).isEmpty()
    df = spark.read.option("header", True).option("inferSchema", True).option("enforceSchema", True).option("multiLine", broken).option("escape", '"').csv(path)
    df = df.toDF(*unique_names(head))
    if df.isEmpty():
        raise LoadError("the file has a header but no rows")
    return df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    try:
        df = spark.read.parquet(path)
    except (PySparkException, Py4JJavaError) as e:
        raise LoadError(f"not a readable Parquet file: {path}") from e
    if not df.columns:
        raise LoadError("the file has no columns")
    if df.isEmpty():
        raise LoadError("the file has no rows")
    return df


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes) -> list[list]:
    """The cells of a workbook's first sheet: text, numbers, booleans and None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        first = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        if not first:
            raise LoadError("the workbook has no sheet")
        root = ElementTree.fromstring(z.read(first[0]))
    rows = []
    for row in root.iter(f"{{{_NS['m']}}}row"):
        cells: dict[int, object] = {}
        for i, c in enumerate(row.findall("m:c", _NS)):
            kind, v = c.get("t"), c.findtext("m:v", None, _NS)
            value: object = None
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif v is not None:
                value = shared[int(v)] if kind == "s" else v == "1" if kind == "b" else v if kind in ("str", "e") else float(v)
            cells[_column(c.get("r")) if c.get("r") else i] = value
        rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return rows


def read_xlsx(spark: SparkSession, data: bytes) -> DataFrame:
    """The first sheet, its first row as header.  A workbook is a bounded upload and is read on the driver."""
    try:
        rows = sheet_rows(data)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, TypeError) as e:
        raise LoadError(f"not a readable workbook: {e}") from e
    if not rows or not any(rows[0]):
        raise LoadError("the file is empty")
    names = unique_names(str(x) if x is not None else None for x in rows[0])
    body = [(r + [None] * len(names))[: len(names)] for r in rows[1:] if any(x is not None for x in r)]
    if not body:
        raise LoadError("the file has a header but no rows")
    kinds = []
    for i in range(len(names)):
        found = [r[i] for r in body if r[i] is not None]
        if found and all(isinstance(x, bool) for x in found):
            kinds.append("boolean")
        elif found and all(isinstance(x, float) for x in found):
            kinds.append("bigint" if all(x.is_integer() for x in found) else "double")
        else:
            kinds.append("string")
    make = {"bigint": int, "double": float, "boolean": bool, "string": lambda x: str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)}
    data_rows = [tuple(None if x is None else make[k](x) for x, k in zip(r, kinds)) for r in body]
    return spark.createDataFrame(data_rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table by its extension, whatever its case."""
    kind = os.path.splitext(path)[1].lower()
    if kind not in KINDS:
        raise LoadError(f"unsupported file type {kind or path!r}; expected one of {', '.join(KINDS)}")
    if kind == ".parquet":
        return read_parquet(spark, path)
    if kind == ".csv":
        return read_csv(spark, path)
    row = spark.read.format("binaryFile").load(path).filter(F.col("length") <= MOST_BYTES).first()
    if row is None:
        raise TooLarge(f"larger than {MOST_BYTES} bytes")
    return read_xlsx(spark, bytes(row["content"]))


def round_trip(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to the shared folder as ``kind`` and loaded again."""
    path = scratch_path(df.sparkSession, f"table.{kind}")
    (df.write.option("header", True).csv if kind == "csv" else df.write.parquet)(path)
    return load(df.sparkSession, path)
