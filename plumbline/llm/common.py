"""Helpers the operators share: text expressions, scratch tables, batch bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.joins import lookup
from plumbline.sources.scratch import app_dir, file_system, materialize, scratch_path

__all__ = ["ascii_lower", "drop_scratch", "let", "lookup", "materialize", "partitions", "read", "scratch_path", "settled", "strip", "words"]

#: White space of every contract: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself where it is a narrow pass over its source, else written: a task that runs again sees the same rows in the same order."""
    return materialize(df, name) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def drop_scratch(spark: SparkSession) -> None:
    """Deletes at once what :func:`materialize` wrote for this application; results that still read it end with it."""
    fs, at = file_system(spark, app_dir(spark))
    fs.delete(at, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else.

    ``lower`` is much the faster and the same for pure ASCII; other text takes
    ``translate``, since ``lower`` would fold accented letters too.
    """
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
