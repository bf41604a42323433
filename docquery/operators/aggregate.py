"""Facets and statistics over matched documents.

Every request is one tidy DataFrame; numeric requests of one call share a single aggregate, each facet is one group-by.
"""

from __future__ import annotations

import decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.functions.text import number
from docquery.plans.binder import Binder

NUMERIC = ("avg", "min", "max", "sum", "stats", "cardinality", "value_count")
BUCKETS = ("terms", "histogram", "date_histogram")
_CALENDAR = {"year": "yyyy", "month": "yyyyMM", "day": "yyyyMMdd", "hour": "yyyyMMddHH"}


def requests(aggs: dict) -> dict[str, tuple[str, dict]]:
    """name -> (kind, options) of ``{name: {kind: options}}`` or ``{kind: options}``."""
    out = {}
    for name, body in aggs.items():
        if name in NUMERIC + BUCKETS and "field" in body:
            out[name] = (name, body)
            continue
        kinds = [k for k in body if k in NUMERIC + BUCKETS]
        if len(kinds) != 1:
            raise ValueError(f"{name}: one of {', '.join(NUMERIC + BUCKETS)} is needed")
        out[name] = (kinds[0], body[kinds[0]])
    return out


def value_of(df: DataFrame, path: str) -> tuple[Column, T.DataType]:
    """The value at a path; arrays are left whole, and so are structs, as JSON."""
    got = Binder(df).steps(path)
    if got is None:
        return F.lit(None).cast("string"), T.StringType()
    f, rest = got
    c, kind = F.col(f"`{f.name}`"), f.dataType
    while rest:
        if isinstance(kind, T.StructType):
            inner = next((x for x in kind.fields if x.name.lower() == str(rest[0]).lower()), None)
            if inner is None:
                return F.lit(None).cast("string"), T.StringType()
            c, kind, rest = c[inner.name], inner.dataType, rest[1:]
        elif isinstance(kind, T.ArrayType) and isinstance(rest[0], int):
            c, kind, rest = F.get(c, F.lit(rest[0])), kind.elementType, rest[1:]
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            inner = next((x for x in kind.elementType.fields if x.name.lower() == str(rest[0]).lower()), None)
            if inner is None:
                return F.lit(None).cast("string"), T.StringType()
            c, kind, rest = c[inner.name], T.ArrayType(inner.dataType), rest[1:]
        else:
            path = "$" + "".join(f"[{s}]" if isinstance(s, int) else f".{s}" for s in rest)
            return F.get_json_object(c.cast("string"), path), T.StringType()
    return (F.to_json(c), T.StringType()) if isinstance(kind, T.StructType) else (c, kind)


def numeric(df: DataFrame, path: str) -> Column:
    """A number that can be compared and divided: whole numbers and decimals stay what they are, other values become doubles."""
    c, kind = value_of(df, path)
    if isinstance(kind, T.IntegralType):
        return c.cast("bigint")
    if isinstance(kind, T.NumericType):
        return c if isinstance(kind, T.DecimalType) else c.cast("double")
    return number(c.cast("string"))


def _sum(df: DataFrame, path: str) -> Column:
    """Exact for whole numbers, beyond 64 bits too."""
    v = numeric(df, path)
    return F.sum(v.cast("decimal(38,0)") if isinstance(value_of(df, path)[1], T.IntegralType) else v)


def plain_number(v: object) -> object:
    """A whole decimal as an int, another as a float, anything else as it is."""
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    return v


def _items(df: DataFrame, path: str) -> DataFrame:
    """One row ``key`` for each value; arrays, and text that is a JSON array, give one for each element."""
    c, kind = value_of(df, path)
    if isinstance(kind, T.ArrayType):
        return df.select(F.explode(c).alias("key")).select(F.col("key").cast("string"))
    if isinstance(kind, T.StringType):
        listed = F.when(F.startswith(c, F.lit("[")) & F.endswith(c, F.lit("]")), F.from_json(c, "array<string>"))
        return df.select(F.explode(F.coalesce(listed, F.array(c))).alias("key"))
    return df.select(c.cast("string").alias("key"))


def terms(df: DataFrame, path: str, size: int = 10) -> DataFrame:
    """key, doc_count of the commonest values; equal counts in order of the key. Blank values don't count."""
    return top(counts(df, path), size)


def counts(df: DataFrame, path: str) -> DataFrame:
    return _items(df, path).where(F.trim("key") != "").groupBy("key").agg(F.count(F.lit(1)).alias("doc_count"))


def top(counted: DataFrame, size: int) -> DataFrame:
    return counted.orderBy(F.desc("doc_count"), "key").limit(size)


def histogram(df: DataFrame, path: str, interval: float) -> DataFrame:
    """key (the bucket's lower end), doc_count."""
    key = (F.floor(numeric(df, path).cast("double") / F.lit(float(interval))) * F.lit(float(interval))).cast("double")
    return df.select(key.alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("doc_count")).orderBy("key")


def date_histogram(df: DataFrame, path: str, interval: str = "day", epoch: bool = False) -> DataFrame:
    """key (YYYY, YYYYMM, YYYYMMDD or YYYYMMDDHH; weeks by their Monday), doc_count."""
    c, kind = value_of(df, path)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        when = c.cast("timestamp_ntz")
    elif epoch:
        seconds = numeric(df, path).cast("double")
        when = F.when((seconds > 0) & (seconds < 4102444800), F.timestamp_seconds(seconds)).cast("timestamp_ntz")
    else:
        plain = F.regexp_replace(c.cast("string"), r"^\s*(\d{2})[-/|.](\d{2})[-/|.](\d{4})", "$3$2$1")
        parts = F.regexp_extract(plain, r"^\s*(\d{4}[-/|.]?\d{2}[-/|.]?\d{2})", 1)
        hour = F.regexp_extract(plain, r"^\s*\d{4}[-/|.]?\d{2}[-/|.]?\d{2}[T ]?(\d{2})", 1)
        when = F.try_to_timestamp(F.concat(F.regexp_replace(parts, "[-/|.]", ""), F.when(hour == "", "00").otherwise(hour)), F.lit("yyyyMMddHH")).cast("timestamp_ntz")
    if interval == "week":
        key = F.date_format(F.date_trunc("week", when), "yyyyMMdd")
    else:
        key = F.date_format(when, _CALENDAR.get(interval, "yyyyMMdd"))
    return df.select(key.alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("doc_count")).orderBy("key")


def numbers(df: DataFrame, wanted: dict[str, tuple[str, dict]]) -> DataFrame:
    """One row with the columns that ``wanted`` numeric requests need, all in one pass."""
    out = []
    for i, (kind, options) in enumerate(wanted.values()):
        v, c = numeric(df, options["field"]), value_of(df, options["field"])[0]
        for part, value in (("count", F.count(v)), ("min", F.min(v)), ("max", F.max(v)), ("avg", F.avg(v)), ("sum", _sum(df, options["field"]))):
            if kind in ("stats", part):
                out.append(value.alias(f"{i}_{part}"))
        if kind == "cardinality":
            precise = options.get("precise", False)
            out.append((F.count_distinct(c.cast("string")) if precise else F.approx_count_distinct(c.cast("string"), options.get("rsd", 0.02))).alias(f"{i}_cardinality"))
        if kind == "value_count":
            out.append(F.count(c).alias(f"{i}_value_count"))
    return df.agg(*out)


def bucketed(df: DataFrame, kind: str, options: dict, size: int = 10) -> DataFrame:
    path = options["field"]
    if kind == "terms":
        return terms(df, path, options.get("size", size))
    if kind == "histogram":
        return histogram(df, path, options.get("interval", 10))
    return date_histogram(df, path, options.get("interval", options.get("calendar_interval", "day")), options.get("ms_to_epoch", options.get("epoch", False)))


def aggregate(df: DataFrame, aggs: dict, size: int = 10) -> dict:
    """The answers by name. Only bounded buckets and single values reach the driver.

    A terms facet is grouped once: its buckets and the number of its other keys come from the same counts.
    """
    wanted = requests(aggs)
    numeric_ones = {n: w for n, w in wanted.items() if w[0] in NUMERIC}
    out: dict = {}
    row = numbers(df, numeric_ones).first().asDict() if numeric_ones else {}
    for i, (name, (kind, _)) in enumerate(numeric_ones.items()):
        own = {k.partition("_")[2]: plain_number(v) for k, v in row.items() if k.startswith(f"{i}_")}
        out[name] = own if kind == "stats" else {"value": next(iter(own.values()))}
    for name, (kind, options) in wanted.items():
        if kind not in BUCKETS:
            continue
        keys = 0
        if kind == "terms":
            counted = counts(df, options["field"]).persist()
            rows = [r.asDict() for r in top(counted, options.get("size", size)).collect()]
            keys = counted.count()
            counted.unpersist()
        else:
            rows = [r.asDict() for r in bucketed(df, kind, options, size).collect()]
        if kind == "date_histogram":
            rows = [{"key": r["key"], "key_as_string": r["key"], "doc_count": r["doc_count"]} for r in rows]
        out[name] = {"buckets": rows}
        if kind == "terms":
            out[name]["sum_other_doc_count"] = max(0, keys - len(rows))
    return {name: out[name] for name in wanted}
