"""From raw columns to a dataset's: canonical names, normal forms, nested values, types that hold for every row, ids."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.functions.text import canonical_key, normal_value, number
from docquery.sources.readers import json_schema


def canonical(df: DataFrame) -> DataFrame:
    """Canonical column names; columns of one name become their first value that isn't blank."""
    by: dict[str, list[str]] = defaultdict(list)
    for c in df.columns:
        by[canonical_key(c)].append(c)
    out = []
    for key, names in by.items():
        parts = [F.col(f"`{n}`") for n in names]
        if len(parts) > 1:
            parts = [F.when(F.trim(p.cast("string")) != "", p.cast("string")) for p in parts]
        out.append((F.coalesce(*parts) if len(parts) > 1 else parts[0]).alias(key))
    return df.select(*out)


def normalise(df: DataFrame) -> DataFrame:
    return df.select(*((normal_value(F.col(f"`{f.name}`"), f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields))


def _typed(c: Column, kind: str) -> Column | None:
    if kind == "INT":
        return F.regexp_replace(F.trim(c), ",", "").try_cast("bigint")
    if kind == "FLOAT":
        return number(c)
    if kind == "ARRAY":
        return F.from_json(c, "array<string>", {"mode": "PERMISSIVE"})
    return None


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns as numbers, arrays and structs where their type says so and every value can be; one pass finds that out."""
    wanted = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType) and kinds.get(f.name) in ("INT", "FLOAT", "ARRAY"):
            wanted[f.name] = _typed(F.col(f"`{f.name}`"), kinds[f.name])
    objects = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and kinds.get(f.name) == "OBJECT"]
    for name in objects:
        texts = df.select(F.col(f"`{name}`").alias("v")).where(F.startswith(F.trim("v"), F.lit("{")))
        schema = json_schema(texts, "v")
        if schema.fields and "_corrupt_record" not in schema.names:
            wanted[name] = F.from_json(F.col(f"`{name}`"), schema)
    if not wanted:
        return df
    lost = df.agg(*(F.count_if((F.trim(F.col(f"`{n}`")) != "") & c.isNull()).alias(str(i)) for i, (n, c) in enumerate(wanted.items()))).first()
    keep = {n: c for i, (n, c) in enumerate(wanted.items()) if not lost[i]}
    return df.withColumns(keep)


def with_ids(df: DataFrame, first: int = 0) -> DataFrame:
    """Dense ids from ``first`` in the order of partitions and rows, without moving a row: one pass counts the partitions.

    The counts become a table of where each partition starts, a row each, which is joined to the rows. ``df`` is evaluated
    twice and must partition alike, as files and tables do.
    """
    numbered = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    starts = counts.select(F.col("_part").alias("_of"), (F.coalesce(before, F.lit(0)) + first).alias("_start"))
    joined = numbered.join(F.broadcast(starts), F.col("_part") == F.col("_of"))
    return joined.withColumn("_id", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_of", "_start")


# one type for a column in all files


def merged_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds the values of both: structs have the fields of both, whole numbers and doubles are doubles, what can't agree is text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        theirs = {f.name: f for f in b.fields}
        fields = [T.StructField(f.name, merged_type(f.dataType, theirs.pop(f.name).dataType) if f.name in theirs else f.dataType) for f in a.fields]
        return T.StructType(fields + [T.StructField(f.name, f.dataType) for f in theirs.values()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged_type(a.elementType, b.elementType))
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(a, whole) and isinstance(b, whole):
        return T.LongType()
    if isinstance(a, (*whole, T.FloatType, T.DoubleType)) and isinstance(b, (*whole, T.FloatType, T.DoubleType)):
        return T.DoubleType()
    return T.StringType()


def merged_schema(a: T.StructType, b: T.StructType) -> T.StructType:
    return merged_type(a, b)


def recast(c: Column, kind: T.DataType, to: T.DataType) -> Column:
    """A value of one type as a merged type of it."""
    if kind == to:
        return c
    if isinstance(to, T.StructType):
        own = {f.name: f.dataType for f in kind.fields}
        parts = [(recast(c[f.name], own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in to.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(to, T.ArrayType):
        return F.transform(c, lambda x: recast(x, kind.elementType, to.elementType))
    if isinstance(to, T.StringType):
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(c)
        if isinstance(kind, (T.FloatType, T.DoubleType)):  # 22.0 is 22 again
            return F.when((c == F.floor(c)) & (F.abs(c) < 2.0**53), F.floor(c).cast("string")).otherwise(c.cast("string"))
    return c.cast(to)


def as_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns and types of ``schema``, into which its own were merged."""
    own = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*((recast(F.col(f"`{f.name}`"), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))


def needs_rewriting(kind: T.DataType, to: T.DataType) -> bool:
    """Whether stored values of ``kind`` can't be read as ``to``: fields that are only added can."""
    if isinstance(kind, T.StructType) and isinstance(to, T.StructType):
        wanted = {f.name: f.dataType for f in to.fields}
        return any(needs_rewriting(f.dataType, wanted[f.name]) for f in kind.fields)
    if isinstance(kind, T.ArrayType) and isinstance(to, T.ArrayType):
        return needs_rewriting(kind.elementType, to.elementType)
    return kind != to


def prepare(df: DataFrame, kinds: dict[str, str], dataset: str, source: str, first: int = 0) -> DataFrame:
    out = typed(normalise(canonical(df)), {canonical_key(k): v for k, v in kinds.items()})
    return with_ids(out.withColumns({"_dataset": F.lit(dataset), "_source": F.lit(source)}), first)
