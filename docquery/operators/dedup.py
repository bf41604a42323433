"""Duplicate documents: equal in the chosen fields, or in all that don't start with an underscore. One stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.functions.text import canonical_key


def fingerprint(df: DataFrame, fields: list[str] | None = None) -> Column:
    """A digest of the fields in order of their names; null counts as empty text."""
    wanted = {canonical_key(f) for f in fields} if fields else None
    names = sorted(c for c in df.columns if (canonical_key(c) in wanted if wanted is not None else not c.startswith("_")))
    if wanted is not None and len(names) < len(wanted):
        raise ValueError(f"fields that aren't there: {sorted(wanted - {canonical_key(c) for c in names})}")
    parts = [F.coalesce(F.col(f"`{c}`").cast("string") if not df.schema[c].dataType.simpleString().startswith(("struct", "array", "map")) else F.to_json(F.struct(f"`{c}`")), F.lit("")) for c in names]
    return F.md5(F.concat_ws("\x1f", *(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts)))


def deduplicate(df: DataFrame, fields: list[str] | None = None, id_column: str = "_id") -> DataFrame:
    """``df`` with one row of each set of duplicates: the one of the smallest id, null last; of several, the one of the smallest digest.

    Ids need not be unique. The first id and the number of rows that have it are aggregates, so a set of duplicates is
    never one task's; rows whose fingerprint is the only one aren't in that table, which Spark sends or shuffles by its size.
    """
    first, mine, ident, count = _names(df, "_print", "_mine", "_ident", "_count")
    keyed = df.withColumns({mine: fingerprint(df, fields), ident: F.struct(F.col(f"`{id_column}`").isNull().alias("unknown"), F.col(f"`{id_column}`").alias("id"))})
    ids = keyed.groupBy(mine, ident).agg(F.count(F.lit(1)).alias(count))
    sets = ids.groupBy(F.col(mine).alias(first)).agg(F.sum(count).alias("rows"), F.min(F.struct(ident, count)).alias("best")).where("rows > 1")
    best, several = _names(keyed, "_best", "_several")
    sets = sets.select(first, F.col(f"best.{ident}").alias(best), (F.col(f"best.{count}") > 1).alias(several))
    joined = keyed.join(sets, F.col(mine) == F.col(first), "left")
    once = joined.where(F.col(first).isNull() | ((F.col(ident) == F.col(best)) & ~F.col(several)))
    alike = joined.where((F.col(ident) == F.col(best)) & F.col(several))
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    alike = alike.groupBy(mine).agg(F.min_by(row, F.md5(F.to_json(row))).alias(best)).select(f"{best}.*")
    return once.select(*(F.col(f"`{c}`") for c in df.columns)).unionByName(alike)


def _names(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem in taken:
            stem = f"_{stem}"
        taken.add(stem)
        out.append(stem)
    return out


def report(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """total, unique and duplicates, in one row."""
    counts = df.select(fingerprint(df, fields).alias("_print")).groupBy("_print").agg(F.count(F.lit(1)).alias("n"))
    out = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("unique"))
    return out.select("total", "unique", (F.col("total") - F.col("unique")).alias("duplicates"))
