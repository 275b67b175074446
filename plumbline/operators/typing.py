"""Semantic types of columns and the casts that go with them.

One aggregation per table gathers what all columns need to be told apart; the
decisions are made on the driver, over one row, and come with cast parameters
that are replayed later and never inferred again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.exprs import FRACTIONS, TIMES
from plumbline.operators.sampling import exact_sample

# What counts as missing, as a number, as a date, as the name of an identifier.
MISSING_TOKENS = ("", "na", "n/a", "n.a.", "#n/a", "#na", "nan", "null", "none", "nil", "-", "--", "?", "missing", "unknown")
NUMERIC_GATE = r"^[+-]?(NT\$|[$¥€£])?\s*[+-]?((\d{1,3}(,\d{3})+|\d+)(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*%?$"
CURRENCY = r"NT\$|[$¥€£]"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
ID_NAME = re.compile(r"^(id|.*_id|uuid|guid|索引|index)$", re.IGNORECASE)
ID_CAMEL = re.compile(r".*Id$")
CODE_NAME = re.compile(r"^(.*[_ ])?(code|zip|zipcode|zip_code|postcode|postal|no|number|phone|tel)$", re.IGNORECASE)
CODE_CAMEL = re.compile(r".*(Code|Zip|No|Number|Phone|Tel)$")

DATE_ROWS, DATE_SHARE = 1000, 0.90
NUMBER_SHARE, NUMBER_OVERALL = 0.95, 0.5
ZERO_SHARE = 0.05
ID_RATIO, CODE_RATIO = 0.95, 0.5
SEQUENCE_ROWS, HINT_UNIQUE = 50, 20
TEXT_LENGTH, CODE_SPAN = 20, 100
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_BLANK = "[\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_EDGES = f"^{_BLANK}+|{_BLANK}+$"


@dataclass(frozen=True)
class Cast:
    """How a text column becomes times or numbers."""

    target: str
    datetime_format: str | None = None
    thousands: bool = False
    currency: bool = False
    percent: bool = False


@dataclass(frozen=True)
class Typed:
    semantic: str
    cast: Cast | None = None
    nominal: bool = False


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, _EDGES, "")


def missing_token(c: Column) -> Column:
    return F.lower(stripped(c)).isin(*MISSING_TOKENS)


def numeric_cast(c: Column, params: Cast = Cast("numeric", thousands=True, currency=True, percent=True)) -> Column:
    """The number a text stands for; null for missing tokens and whatever fails the gate.  Percent signs go without dividing."""
    text = stripped(c)
    clean = text
    for wanted, pattern in ((params.currency, CURRENCY), (params.thousands, ","), (params.percent, "%")):
        clean = F.regexp_replace(clean, pattern, "") if wanted else clean
    return F.when(~missing_token(c) & text.rlike(NUMERIC_GATE), stripped(clean).try_cast("double"))


def datetime_cast(c: Column, params: Cast) -> Column:
    """The time a text stands for; "infer" is ISO 8601, a date alone or with a time after T or a space."""
    if params.datetime_format == "infer":
        return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?$"), c.try_cast("timestamp_ntz"))
    return F.try_to_timestamp(c, F.lit(params.datetime_format)).cast("timestamp_ntz")


def int_limit(n: int) -> int:
    return max(5, min(20, int(0.05 * n)))


def text_limit(n: int) -> int:
    return min(5000, max(50, int(0.05 * n)))


def looks_like_id(name: str) -> bool:
    return bool(ID_NAME.fullmatch(name) or ID_CAMEL.fullmatch(name))


def looks_like_code(name: str) -> bool:
    return bool(CODE_NAME.fullmatch(name) or CODE_CAMEL.fullmatch(name))


def distinct_counts(df: DataFrame, names: list[str]) -> dict[str, int]:
    """Distinct values of many columns of a bounded sample, by 64-bit hashes: one row per column and value, not per set of columns."""
    if not names:
        return {}
    plus = lambda f: F.col(f"`{f.name}`") + F.lit(0.0) if isinstance(f.dataType, FRACTIONS) else F.col(f"`{f.name}`")  # noqa: E731  -0.0 is 0.0
    hashes = [F.struct(F.lit(i).alias("i"), F.when(F.col(f"`{n}`").isNotNull(), F.xxhash64(plus(df.schema[n]))).alias("h")) for i, n in enumerate(names)]
    rows = df.select(F.inline(F.array(*hashes))).filter("h is not null").distinct().groupBy("i").agg(F.count("*").alias("n"))
    found = {r["i"]: r["n"] for r in rows.collect()}
    return {n: found.get(i, 0) for i, n in enumerate(names)}


def _facts(df: DataFrame) -> dict[str, dict]:
    """Per column what :func:`decide` asks for, from one aggregation and one count of distinct values."""
    exprs = []
    for f in df.schema.fields:
        c, x = F.col(f"`{f.name}`"), {}
        x["n"] = F.count(c)
        if isinstance(f.dataType, T.StringType):
            digits = stripped(c).rlike(r"^[+-]?\d+$")
            token = missing_token(c)
            x |= {"integers": F.coalesce(F.bool_and(digits), F.lit(False)), "zeros": F.count_if(stripped(c).rlike(r"^0\d+$")), "length": F.avg(F.length(c)), "tokens": F.count_if(token), "numbers": F.count_if(numeric_cast(c).isNotNull())}
            x |= {"comma": F.bool_or(c.contains(",")), "money": F.bool_or(c.rlike(CURRENCY)), "percent": F.bool_or(c.contains("%"))}
            whole = F.when(digits, stripped(c).try_cast("long"))
            x |= {"lo": F.min(whole), "hi": F.max(whole)}
        elif isinstance(f.dataType, (*INTEGERS, *FRACTIONS, T.DecimalType)):
            x |= {"lo": F.min(c).cast("double"), "hi": F.max(c).cast("double")}
            if isinstance(f.dataType, FRACTIONS):
                real = ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
                x |= {"integers": F.coalesce(F.bool_and(F.when(real, c == F.floor(c))), F.lit(False))}
        exprs.append(F.struct(*(v.alias(k) for k, v in x.items())).alias(f.name))
    row = df.agg(*exprs, F.count("*").alias("_rows")).first()
    unique = distinct_counts(df, [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, *INTEGERS, *FRACTIONS, T.DecimalType))])
    return {f.name: row[f.name].asDict() | {"rows": row["_rows"]} | ({"unique": unique[f.name]} if f.name in unique else {}) for f in df.schema.fields}


def _date_format(df: DataFrame, name: str) -> str | None:
    """The first format that more than nine tenths of a bounded sample have."""
    some = exact_sample(df.select(F.col(f"`{name}`").alias("v")).filter("v is not null"), DATE_ROWS)
    tried = ("infer", *DATE_FORMATS)
    row = some.agg(*(F.avg(datetime_cast(F.col("v"), Cast("datetime", f)).isNotNull().cast("double")).alias(f"f{i}") for i, f in enumerate(tried))).first()
    return next((f for i, f in enumerate(tried) if (row[f"f{i}"] or 0.0) > DATE_SHARE), None)


def identifier(name: str, kind: T.DataType, x: dict) -> str | None:
    """"id", "nominal" (numbers that are labels) or None; only integer-like columns qualify."""
    text, whole = isinstance(kind, T.StringType), isinstance(kind, INTEGERS)
    if not (whole or x.get("integers")):
        return None
    n, unique = x["n"], x["unique"]
    if looks_like_id(name):
        return "id" if unique / n > ID_RATIO or unique > max(int_limit(n), HINT_UNIQUE) else "nominal"
    if looks_like_code(name) or text and x["zeros"] / n >= ZERO_SHARE:
        return "id" if unique / n >= CODE_RATIO or unique > text_limit(n) else "nominal"
    row_index = unique == n >= SEQUENCE_ROWS and not isinstance(kind, FRACTIONS) and x["lo"] in (0, 1) and x["hi"] - x["lo"] + 1 == n
    return "id" if row_index else None


def decide(name: str, kind: T.DataType, x: dict, date_format=None) -> Typed:
    """The semantic type of a column from its facts; ``date_format`` is asked only of texts."""
    n = x["n"]
    if not n:
        return Typed("unknown")
    if isinstance(kind, T.BooleanType):
        return Typed("boolean")
    if isinstance(kind, TIMES):
        return Typed("datetime")
    if isinstance(kind, (*INTEGERS, *FRACTIONS, T.DecimalType)):
        verdict = identifier(name, kind, x)
        if verdict:
            return Typed("id") if verdict == "id" else Typed("categorical", nominal=True)
        few = isinstance(kind, INTEGERS) and x["unique"] <= int_limit(x["rows"]) and x["hi"] - x["lo"] <= CODE_SPAN
        return Typed("categorical" if few else "numeric")
    if not isinstance(kind, T.StringType):
        return Typed("unknown")
    fmt = date_format() if date_format else None
    if fmt:
        return Typed("datetime", Cast("datetime", fmt))
    verdict = identifier(name, kind, x)
    if verdict:
        return Typed("id") if verdict == "id" else Typed("categorical", nominal=True)
    ratio, real = x["unique"] / n, n - x["tokens"]
    named = ratio > ID_RATIO and looks_like_id(name)
    if x["zeros"] / n < ZERO_SHARE and real and x["numbers"] / real >= NUMBER_SHARE and x["numbers"] / n >= NUMBER_OVERALL:
        return Typed("id") if named else Typed("numeric", Cast("numeric", None, bool(x["comma"]), bool(x["money"]), bool(x["percent"])))
    if named:
        return Typed("id")
    if ratio > ID_RATIO and (x["length"] or 0) > TEXT_LENGTH:
        return Typed("text")
    return Typed("categorical" if x["unique"] <= text_limit(x["rows"]) else "text")


def infer(df: DataFrame) -> dict[str, Typed]:
    """The semantic type of every column of ``df``."""
    facts = _facts(df)
    return {f.name: decide(f.name, f.dataType, facts[f.name], lambda f=f: _date_format(df, f.name)) for f in df.schema.fields}


def apply_casts(df: DataFrame, casts: dict[str, Cast | None]) -> DataFrame:
    """Replays casts on text columns; columns that are gone or cast already are left alone."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    made = {n: datetime_cast(F.col(n), c) if c.target == "datetime" else numeric_cast(F.col(n), c) for n, c in casts.items() if c and n in texts}
    return df.withColumns(made) if made else df
