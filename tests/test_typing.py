import pytest
from pyspark.sql import functions as F
from tables import dirty, hourly, sales

from plumbline.operators import typing


@pytest.mark.parametrize(
    "text, number",
    [("1,234.5", 1234.5), ("$1,234.50", 1234.5), ("NT$ 5", 5.0), (" 99 ", 99.0), ("-3", -3.0), ("+.5", 0.5), ("5.", 5.0), ("2.5E-3", 0.0025), ("12%", 12.0)]
    + [(t, None) for t in ("1.234,56", "12,50", "12kg", "inf", "nan", "N/A", "", "--", "1,23,4", "A1", None)],
)
def test_numeric_cast(spark, text, number):
    row = spark.createDataFrame([(text,)], "v string").select(typing.numeric_cast(F.col("v"))).first()
    assert row[0] == number


def test_dirty_columns(spark):
    found = typing.infer(spark.createDataFrame(dirty()).withColumn("empty", F.lit(None).cast("string")))
    assert {c: t.semantic for c, t in found.items()} == {"id": "id", "price": "numeric", "quantity": "categorical", "pct": "numeric", "order_date": "datetime", "code": "categorical", "level": "categorical", "month": "categorical", "empty": "unknown", "note": "text", "ok": "boolean"}
    assert found["price"].cast == typing.Cast("numeric", None, True, True, False)
    assert found["order_date"].cast.datetime_format == "dd/MM/yyyy" and found["code"].nominal


def test_numbers_and_identifiers(spark):
    found = typing.infer(spark.createDataFrame(sales()))
    assert [found[c].semantic for c in ("order_id", "order_date", "region", "unit_price", "quantity", "discount")] == ["id", "datetime", "categorical", "numeric", "categorical", "numeric"]
    found = typing.infer(spark.createDataFrame(hourly(10)))
    assert found["instant"].semantic == "id" and found["hr"].semantic == "numeric" and found["weathersit"].semantic == "categorical"


@pytest.mark.parametrize("name, kind", [("userId", True), ("paid", False), ("user_id", True), ("index", True), ("valid", False), ("uuid", True)])
def test_id_names(name, kind):
    assert typing.looks_like_id(name) is kind


@pytest.mark.parametrize("name, kind", [("zip_code", True), ("number_of_orders", False), ("productCode", True), ("phone", True), ("num", False), ("quantity", False)])
def test_code_names(name, kind):
    assert typing.looks_like_code(name) is kind


def test_casts_replay_and_leave_cast_columns_alone(spark):
    df = spark.createDataFrame([("1,000", 5.0), ("x", 6.0)], "a string, b double")
    casts = {"a": typing.Cast("numeric", None, True), "b": typing.Cast("numeric"), "gone": typing.Cast("numeric")}
    out = typing.apply_casts(df, casts)
    assert [r.a for r in out.collect()] == [1000.0, None] and out.schema["b"] == df.schema["b"]


def test_iso_times(spark):
    df = spark.createDataFrame([("2024-01-31",), ("2024-01-31T10:20:30",), ("2024-01-31 10:20:30.5",), ("2024-02-31",), ("12",)], "v string")
    out = [r[0] for r in df.select(typing.datetime_cast(F.col("v"), typing.Cast("datetime", "infer")).cast("string")).collect()]
    assert out == ["2024-01-31 00:00:00", "2024-01-31 10:20:30", "2024-01-31 10:20:30.5", None, None]


def test_empty_table(spark):
    assert {t.semantic for t in typing.infer(spark.createDataFrame([], "a string, b int, c timestamp")).values()} == {"unknown"}
