"""Nested values to columns with paths as names, and back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _leaves(c: Column, kind: T.DataType, name: str, longest: int) -> list[tuple[str, Column]]:
    if isinstance(kind, T.StructType):
        return [leaf for f in kind.fields for leaf in _leaves(c[f.name], f.dataType, f"{name}.{f.name}", longest)]
    if isinstance(kind, T.ArrayType):
        own = [(name, F.to_json(c))]
        return own + [leaf for i in range(longest) for leaf in _leaves(F.get(c, F.lit(i)), kind.elementType, f"{name}[{i}]", longest)]
    return [(name, c)]


def expand(df: DataFrame, longest: int | None = None) -> DataFrame:
    """A column for each leaf: ``a.b`` for structs, ``tags[0]`` for elements; an array also stays as JSON text.

    ``longest`` is how many elements get columns; by default as many as the longest array has, which takes a pass.
    """
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if longest is None:
        row = df.agg(*(F.max(F.size(F.col(f"`{a}`"))).alias(a) for a in arrays)).first() if arrays else []
        longest = max([0, *(x for x in row if x)])
    return df.select(*(c.alias(n) for f in df.schema.fields for n, c in _leaves(F.col(f"`{f.name}`"), f.dataType, f.name, longest)))


def collapse(df: DataFrame) -> DataFrame:
    """The opposite of ``expand``: dotted names become structs, numbered ones arrays without their missing elements."""
    tree: dict = {}
    for name in df.columns:
        steps = [s for part in name.split(".") for s in re.findall(r"[^\[\]]+", part)]
        at = tree
        for s in steps[:-1]:
            if not isinstance(at.get(s), dict):
                at[s] = {}  # an array's own JSON text gives way to its elements
            at = at[s]
        if not isinstance(at.get(steps[-1]), dict):
            at[steps[-1]] = F.col(f"`{name}`")

    def built(node: dict | Column) -> Column:
        if not isinstance(node, dict):
            return node
        if all(k.isdigit() for k in node):
            return F.array_compact(F.array(*(built(node[k]) for k in sorted(node, key=int))))
        return F.struct(*(built(v).alias(k) for k, v in node.items()))

    return df.select(*(built(v).alias(k) for k, v in tree.items()))
