"""The queries of readers and datasets: whole tables are written in the forms that users have, taken in, and compared with SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.engine import Engine
from docquery.operators.search import union_of
from docquery.sources import readers
from docquery.sources.catalog import Catalog

_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder's name in ``spark.checkpoint.dir``, which all executors share; on this machine only where that is unset and the executors are here."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = tempfile.mkdtemp(prefix="docquery-")
            atexit.register(shutil.rmtree, _own[sc.applicationId], ignore_errors=True)
        base = _own[sc.applicationId]
    return f"{base.rstrip('/')}/queries-{sc.applicationId}/{uuid.uuid4().hex}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))


def _through(file: str, write: Callable[[DataFrame, str], None], tables: Callable[[SparkSession, str], DataFrame], **how) -> Callable[[SparkSession, str], DataFrame]:
    """A query that writes a table as ``file`` and reads it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{scratch(spark)}/{file}"
        write(tables(spark, sf_dir), path)
        return readers.read(spark, path, **how)

    return query


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select("c_custkey", F.concat(F.lit('so "x", y\n'), "c_name").alias("note"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")


def _listed(df: DataFrame, path: str, before: str, each: str = "{}", after: str = "") -> None:
    """One JSON text around all rows; for nation, which has the same few rows at every size."""
    opening, closing = each.split("{}") if each != "{}" else ("", "")
    rows = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit(opening), _json(df), F.lit(closing)))), ",\n")
    df.agg(F.concat(F.lit(before), rows, F.lit(after)).alias("value")).coalesce(1).write.text(path)


def _bulk(df: DataFrame, path: str) -> None:
    action = F.concat(F.lit('{"index":{"_id":"'), F.col("c_custkey").cast("string"), F.lit('"}}'))
    df.select(F.explode(F.array(action, _json(df))).alias("value")).write.text(path)


def _dump(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(F.lit("c").alias("_index"), F.struct(*df.columns).alias("_source"))).alias("value")).write.text(path)


_CUSTOMERS = "SELECT c_custkey, c_name, c_acctbal FROM customer"
_NATIONS = "SELECT n_nationkey, n_name FROM nation"


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of CSV files, built in and asked for its numbers; the second build skips all files."""
    place = scratch(spark)
    _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").write.csv(f"{place}/in/a", header=True)
    _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").write.csv(f"{place}/in/b", header=True)
    catalog = Catalog(spark, f"{place}/root")
    catalog.build("d", f"{place}/in")
    again = catalog.build("d", f"{place}/in")
    rows = catalog.open("d")
    return rows.agg(F.count("s_suppkey").alias("suppliers"), F.count("c_custkey").alias("customers"), F.count_distinct("_id").alias("ids"), F.min("_id").alias("first"), F.max("_id").alias("last"), F.lit(len(again["indexed"])).cast("bigint").alias("again"))


def _dataset(steps: Callable[[Catalog, DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        nations = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zq"), F.col("n_name").alias("label"))
        regions = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("zq"), F.col("r_name").alias("label"))
        return steps(Catalog(spark, scratch(spark)), nations, regions).select("zq", "label")

    return query


def _appended(catalog: Catalog, nations: DataFrame, regions: DataFrame) -> DataFrame:
    catalog.append("d", nations)
    catalog.append("d", regions)
    return catalog.open("d")


def _replaced(catalog: Catalog, nations: DataFrame, regions: DataFrame) -> DataFrame:
    catalog.append("d", regions, "one")
    catalog.append("d", nations, "one")
    return catalog.open("d")


def _deduplicated(catalog: Catalog, nations: DataFrame, regions: DataFrame) -> DataFrame:
    for source in ("one", "two"):
        catalog.append("d", nations, source)
    catalog.append("d", regions, "three")
    catalog.deduplicate("d")
    return catalog.open("d")


def _sealed(catalog: Catalog, nations: DataFrame, regions: DataFrame) -> DataFrame:
    catalog.append("d", nations)
    catalog.seal("d", "open sesame")
    return catalog.open("d", "open sesame")


def _unsealed(catalog: Catalog, nations: DataFrame, regions: DataFrame) -> DataFrame:
    catalog.append("d", nations)
    catalog.seal("d", "open sesame")
    catalog.unseal("d", "open sesame")
    catalog.compress("d", "gzip")
    return catalog.open("d")


def _renamed(catalog: Catalog, nations: DataFrame, regions: DataFrame) -> DataFrame:
    catalog.append("d", nations)
    catalog.append("gone", regions)
    catalog.rename("d", "e")
    catalog.delete("gone")
    return union_of({name: catalog.open(name) for name in catalog.names()})


def _widened(catalog: Catalog, nations: DataFrame, regions: DataFrame) -> DataFrame:
    catalog.append("d", nations)
    catalog.append("d", regions.select(F.concat(F.lit("r"), F.col("zq").cast("string")).alias("zq"), "label"))
    return catalog.open("d")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join inside several named tables."""
    named = {"customer": _table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation"), "supplier": _table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "nation")}
    pairs = Engine(named).join("c_acctbal:>9000", "s_acctbal:>9000", "nation")
    return pairs.select(F.col("_a.c_custkey").alias("c_custkey"), F.col("_b.s_suppkey").alias("s_suppkey"))


_LABELS = "SELECT n_nationkey AS zq, n_name AS label FROM nation"
_REGIONS = "SELECT r_regionkey AS zq, r_name AS label FROM region"
_CSV = {"header": True, "quote": '"', "escape": '"'}

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "source_csv": (_through("rows.csv", lambda df, p: df.write.csv(p, **_CSV), _noted), "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 'so \"x\", y' || chr(10) || c_name AS note FROM customer"),
    "source_csv_headerless": (_through("rows.txt", lambda df, p: df.select("c_custkey", "c_name").write.csv(p, sep=";"), _customers, delimiter=";", columns=["id", "who"]), "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS who FROM customer"),
    "source_csv_gz": (_through("rows.csv.gz", lambda df, p: df.select("c_custkey", "c_name").write.csv(p, header=True, compression="gzip"), _customers), "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer"),
    "source_json_lines": (_through("rows.jsonl", lambda df, p: df.write.json(p), _customers), _CUSTOMERS),
    "source_json_lines_bz2": (_through("rows.jsonl.bz2", lambda df, p: df.write.json(p, compression="bzip2"), _customers), _CUSTOMERS),
    "source_json_dump": (_through("rows.json", _dump, _customers), _CUSTOMERS),
    "source_json_bulk": (_through("rows.ndjson", _bulk, _customers), _CUSTOMERS),
    "source_json_array": (_through("rows.json", lambda df, p: _listed(df, p, "[", after="]"), _nations), _NATIONS),
    "source_json_response": (_through("rows.json", lambda df, p: _listed(df, p, '{"took": 1, "hits": {"total": 25, "hits": [\n', '{"_id": "a", "_source": {}}', "]}}"), _nations), _NATIONS),
    "source_json_wrapped": (_through("rows.json", lambda df, p: _listed(df, p, '{"page": 1,\n"total": 25, "ok": true, "by": {"id": 4}, "took": 2, "items": [', after="]}"), _nations), _NATIONS),
    "source_folder_build": (_built, "SELECT s.n AS suppliers, c.n AS customers, s.n + c.n AS ids, 0 AS first, s.n + c.n - 1 AS last, 0 AS again FROM (SELECT count(*) AS n FROM supplier) s, (SELECT count(*) AS n FROM customer) c"),
    "dataset_append": (_dataset(_appended), f"{_LABELS} UNION ALL {_REGIONS}"),
    "dataset_replace": (_dataset(_replaced), _LABELS),
    "dataset_widen": (_dataset(_widened), "SELECT CAST(n_nationkey AS VARCHAR) AS zq, n_name AS label FROM nation UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR), r_name FROM region"),
    "dataset_dedup": (_dataset(_deduplicated), f"SELECT DISTINCT * FROM ({_LABELS} UNION ALL {_REGIONS})"),
    "dataset_sealed": (_dataset(_sealed), _LABELS),
    "dataset_unsealed": (_dataset(_unsealed), _LABELS),
    "dataset_rename": (_dataset(_renamed), _LABELS),
    "join_multi_index": (_joined, "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9000 AND s_acctbal > 9000"),
}
