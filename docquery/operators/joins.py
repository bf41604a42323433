"""Joins of matched documents with one another, and lookups in a second dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.functions.text import canonical_key, tokens
from docquery.operators.aggregate import value_of


def _key(df: DataFrame, path: str) -> Column:
    return F.trim(value_of(df, path)[0].cast("string"))


def _named(df: DataFrame, name: str) -> str:
    return next((c for c in df.columns if canonical_key(c) == canonical_key(name)), name)


def join(a: DataFrame, b: DataFrame, on: str, on_b: str | None = None, how: str = "inner") -> DataFrame:
    """Pairs ``_a``, ``_b`` of documents whose values at ``on`` are equal; blank values match nothing.

    Keys of one type are compared as they are, so Catalyst sees a plain equi-join and picks its strategy by size.
    """
    on_b = on_b or on
    (ka, ta), (kb, tb) = value_of(a, on), value_of(b, on_b)
    if ta != tb or ta.simpleString() == "string":
        ka, kb = ka.cast("string"), kb.cast("string")
    left = a.select(F.struct(*(F.col(f"`{c}`") for c in a.columns)).alias("_a"), ka.alias("_ka"))
    right = b.select(F.struct(*(F.col(f"`{c}`") for c in b.columns)).alias("_b"), kb.alias("_kb"))
    if how == "inner":
        left, right = left.where(F.trim(F.col("_ka").cast("string")) != ""), right.where(F.trim(F.col("_kb").cast("string")) != "")
    out = left.join(right, F.col("_ka") == F.col("_kb"), how)
    return out.select(*(c for c in ("_a", "_b") if c in out.columns))


def cross_lookup(source: DataFrame, target: DataFrame, link: str, target_field: str | None = None, id_column: str = "_id", return_fields: list[str] | None = None, top_n: int | None = None, matches: int | None = 50, strict: bool = False) -> DataFrame:
    """_source, _matches, _match_count: for each key of the source's documents, the target's documents that have it.

    A key is matched as a word of the target's value, or as the whole value if ``strict``. The first document of a key stands
    for it. ``top_n`` takes only the first documents of the source, ``matches`` the first matches of each key (None: all).
    """
    target_field = target_field or link
    first = source.orderBy(id_column).limit(top_n) if top_n is not None else source
    keyed = first.withColumn("_key", F.lower(_key(first, link))).where(F.col("_key") != "")
    one = keyed.withColumn("_at", F.row_number().over(Window.partitionBy("_key").orderBy(id_column))).where("_at = 1")
    one = one.select("_key", F.struct(*(F.col(f"`{c}`") for c in source.columns)).alias("_source"))
    fields = [_named(target, f) for f in return_fields] if return_fields else target.columns
    fields = [id_column, *(f for f in fields if f != id_column)] if id_column in target.columns else fields
    document = F.struct(*(F.col(f"`{c}`") for c in fields))
    value = value_of(target, target_field)[0].cast("string")
    unique = id_column in target.columns
    words = F.array(F.lower(F.trim(value))) if strict else F.array_distinct(F.concat(F.array(F.lower(F.trim(value))), tokens(value)))
    order = [id_column] if id_column in target.columns else target.columns[:1]
    # keys and ids are matched first; only documents that a key has found are copied
    pairs = target.select(F.explode(words).alias("_key"), F.col(f"`{order[0]}`").alias("_order")).distinct().join(one.select("_key"), "_key", "left_semi")
    if matches is not None and unique:
        pairs = pairs.withColumn("_at", F.row_number().over(Window.partitionBy("_key").orderBy("_order"))).where(F.col("_at") <= matches).drop("_at")
    documents = target.select(F.col(f"`{order[0]}`").alias("_of"), words.alias("_words"), document.alias("_match"))
    found = pairs.join(documents, F.col("_order").eqNullSafe(F.col("_of")) & F.array_contains("_words", F.col("_key"))).join(one, "_key")
    if matches is not None:
        found = found.withColumn("_at", F.row_number().over(Window.partitionBy("_key").orderBy("_order"))).where(F.col("_at") <= matches)
    hits = found.groupBy("_key").agg(F.first("_source").alias("_source"), F.sort_array(F.collect_list(F.struct("_order", "_match"))).alias("_hits"))
    return hits.select("_source", F.transform("_hits", lambda h: h["_match"]).alias("_matches"), F.size("_hits").alias("_match_count"))
