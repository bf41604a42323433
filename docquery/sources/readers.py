"""Files to DataFrames: CSV with or without a header, and six shapes of JSON, compressed or not."""

from __future__ import annotations

import csv
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = (".csv", ".tsv", ".json", ".jsonl", ".ndjson")
SKIPPED = {"data", "testdata", "tmp", ".git", "__pycache__"}  # working folders; a root of such a name is still read
ACTIONS = ("index", "create", "update", "delete")


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def discover(spark: SparkSession, folder: str, skipped: set[str] | frozenset[str] = frozenset(SKIPPED)) -> list[str]:
    """Data files under a folder of any Hadoop file system, compressed ones too, in order of their paths. Folders named in ``skipped`` are passed over."""
    found, todo = [], [folder.rstrip("/")]
    while todo:
        at = todo.pop()
        p, fs = _path(spark, at)
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if s.isDirectory():
                if name not in skipped:
                    todo.append(f"{at}/{name}")
            elif name.removesuffix(".gz").removesuffix(".bz2").endswith(FORMATS):
                found.append(f"{at}/{name}")
    return sorted(found)


def json_schema(lines: DataFrame, column: str = "value") -> T.StructType:
    """The schema of JSON objects in a column of text, inferred in the JVM from all rows."""
    spark = lines.sparkSession
    strings = getattr(lines.select(column)._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    found = spark._jsparkSession.read().option("mode", "DROPMALFORMED").json(strings).schema()
    return T.StructType.fromJson(json.loads(found.json()))


def _head(spark: SparkSession, path: str, lines: int = 20) -> list[str]:
    return [r[0] for r in spark.read.text(path).limit(lines).collect()]


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", columns: list[str] | None = None, multiline: bool | None = None) -> DataFrame:
    """All columns as text. Rows of another number of fields are dropped. ``columns`` names those of a file without a header.

    A quoted value may hold line breaks. Unless ``multiline`` says so, one pass over the lines finds out whether any has an
    odd number of quotes; only then is the file read as a whole, since such files can't be split.
    """
    if multiline is None:
        quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
        multiline = not spark.read.text(path).where(quotes % 2 == 1).limit(1).isEmpty()
    names = columns
    if names is None:
        head = _head(spark, path, 1)
        names = next(csv.reader(head, delimiter=delimiter)) if head else []
        names = [n.lstrip("﻿") for n in names]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(schema).options(sep=delimiter, header=columns is None, mode="DROPMALFORMED", quote='"', escape='"', multiLine=multiline, enforceSchema=True, columnPruning=False)
    return reader.csv(path)


def _object(line: str) -> dict | None:
    try:
        found = json.loads(line)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def sniff(lines: list[str]) -> str:
    """array or json (one object in the whole file), jsonl, dump or bulk, from a file's first lines."""
    some = [x.strip() for x in lines if x.strip()]
    if not some or some[0][0] == "[":
        return "array"
    first = _object(some[0])
    if first is None:
        return "json" if not any(_object(x) for x in some[1:]) else "jsonl"
    if len(first) == 1 and next(iter(first)) in ACTIONS and isinstance(next(iter(first.values())), dict):
        return "bulk"
    if isinstance(first.get("_source"), dict):
        return "dump"
    return "jsonl" if len(some) > 1 else "json"


def read_json(spark: SparkSession, path: str, shape: str | None = None) -> DataFrame:
    """Documents of a JSON file of any shape; lines that aren't objects are dropped, and fields are those of all documents."""
    shape = shape or sniff(_head(spark, path))
    if shape == "bulk":
        return _bulk(spark, path)
    df = spark.read.options(multiLine=shape in ("array", "json"), mode="DROPMALFORMED", allowSingleQuotes=True).json(path)
    return unwrap(df, path if shape == "json" else None)


def unwrap(df: DataFrame, path: str | None = None) -> DataFrame:
    """Documents inside ``_source`` or ``hits.hits``; of a file that is one object, those in its first list of objects, if it has any."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    hits = kinds.get("hits")
    if isinstance(hits, T.StructType) and "hits" in hits.names and isinstance(hits["hits"].dataType, T.ArrayType):
        return unwrap(df.select(F.explode("hits.hits").alias("h")).select("h.*"))
    if isinstance(kinds.get("_source"), T.StructType):
        return df.select("_source.*")
    lists = [n for n, k in kinds.items() if isinstance(k, T.ArrayType) and isinstance(k.elementType, T.StructType)]
    if path is None or not lists:
        return df
    if len(lists) > 1:  # the schema is in order of the names; the file's own order decides
        keys = df.sparkSession.read.text(path, wholetext=True).select(F.json_object_keys("value")).first()[0] or lists
        lists.sort(key=lambda n: keys.index(n) if n in keys else len(keys))
    return df.select(F.explode(F.col(f"`{lists[0]}`")).alias("d")).select("d.*")


def _bulk(spark: SparkSession, path: str) -> DataFrame:
    """The documents between action lines."""
    lines = spark.read.text(path).where(F.startswith(F.trim("value"), F.lit("{")))
    keys = F.json_object_keys("value")
    action = (F.size(keys) == 1) & F.get(keys, F.lit(0)).isin(*ACTIONS)
    documents = lines.where(F.coalesce(~action, F.lit(False)))
    return documents.select(F.from_json("value", json_schema(documents)).alias("d")).where("d IS NOT NULL").select("d.*")


def read(spark: SparkSession, path: str, delimiter: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A file by its suffix, without that of its compression."""
    bare = path.removesuffix(".gz").removesuffix(".bz2")
    if bare.endswith((".csv", ".tsv", ".txt")) or columns:
        return read_csv(spark, path, delimiter or ("\t" if bare.endswith(".tsv") else ","), columns)
    if bare.endswith(".parquet"):
        return spark.read.parquet(path)
    return read_json(spark, path)


def select_path(df: DataFrame, source_field: str) -> DataFrame:
    """The rows at a dotted path: the elements of a list, or one row for an object."""
    c, kind = F.col(f"`{source_field.split('.')[0]}`"), df.schema[source_field.split(".")[0]].dataType
    for step in source_field.split(".")[1:]:
        kind = kind[step].dataType
        c = c[step]
    return df.select((F.explode(c) if isinstance(kind, T.ArrayType) else c).alias("d")).select("d.*")


def read_url(spark: SparkSession, url: str, folder: str, source_field: str | None = None, delimiter: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A file behind a URL, downloaded into ``folder``, which all executors share. ``source_field`` is where its rows are."""
    path = fetch(url, folder)
    if source_field is None:
        return read(spark, path, delimiter, columns)
    shape = sniff(_head(spark, path))
    return select_path(spark.read.options(multiLine=shape in ("array", "json"), mode="DROPMALFORMED").json(path), source_field)


def preview(df: DataFrame, page: int = 0, page_size: int = 20) -> dict:
    """A page of rows in the order in which they are read, the columns and whether more follow."""
    rows = df.offset(page * page_size).limit(page_size + 1).collect()
    return {"columns": df.columns, "rows": [r.asDict(recursive=True) for r in rows[:page_size]], "more": len(rows) > page_size}


def fetch(url: str, folder: str) -> str:
    """Download a file for ``read``; the name keeps the suffix."""
    from urllib.parse import urlsplit
    from urllib.request import urlopen

    to = os.path.join(folder, os.path.basename(urlsplit(url).path) or "download.json")
    with urlopen(url, timeout=60) as source, open(to, "wb") as out:  # noqa: S310
        while part := source.read(1 << 20):
            out.write(part)
    return to
