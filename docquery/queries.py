"""The queries of the search engine over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.engine import Engine
from docquery.functions import text
from docquery.operators import aggregate as agg
from docquery.operators import dedup, joins, search
from docquery.source_queries import QUERIES
from docquery.sources.flatten import collapse, expand

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str]] = {}
IDS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "labels": "doc_id", "nation": "n_nationkey", "region": "r_regionkey", "conversations": "conv_id", "pages": "page_id", "benchmark": "item_id"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, name: str, **options) -> Engine:
    return Engine(read(spark, sf_dir, name), IDS[name], **options)


def add(name: str, query: Query, sql: str) -> None:
    REGISTRY[name] = (query, sql)


def lucene(name: str, table: str, query: str, columns: str, where: str, **options) -> None:
    """A query string over one table against the WHERE clause that says the same."""
    names = [c.strip() for c in columns.split(",")]
    add(name, lambda s, d: engine(s, d, table, **options).match(query).select(*names), f"SELECT {columns} FROM {table} WHERE {where}")


def has(column: str, word: str) -> str:
    """SQL for: the word is one of the column's."""
    return rf"(list_contains(regexp_split_to_array(lower(trim({column})), '[\s_\-,./\\|]+'), '{word}') OR lower(trim({column})) = '{word}')"


# terms
lucene("term_exact", "customer", "c_mktsegment:building", "c_custkey, c_mktsegment", has("c_mktsegment", "building"))
lucene("term_token", "part", "p_name:ring", "p_partkey, p_name", has("p_name", "ring"))
lucene("term_text", "documents", "text:the", "doc_id, lang, n_chars", has("text", "the"))
lucene("term_number", "lineitem", "l_quantity:10", "l_orderkey, l_linenumber", "l_quantity = 10")
DIGITS = "regexp_replace(c_name, '[^0-9]', '', 'g')"
lucene("term_digits", "customer", "c_name:0042", "c_custkey, c_name", f"left({DIGITS}, 4) = '0042' OR right({DIGITS}, 4) = '0042' OR " + has("c_name", "0042"))
lucene("bare_term", "part", "widget", "p_partkey, p_name", " OR ".join(has(c, "widget") for c in ("p_name", "p_brand", "p_type")))
lucene("phrase_quoted", "part", 'p_name:"small ring"', "p_partkey, p_name", "lower(trim(p_name)) = 'small ring'")
lucene("phrase_bare", "part", '"small ring"', "p_partkey, p_name", "lower(trim(p_name)) = 'small ring' OR lower(trim(p_brand)) = 'small ring' OR lower(trim(p_type)) = 'small ring'")
lucene("match_all", "nation", "*", "n_nationkey, n_name", "true")
lucene("match_none", "nation", "n_name:nosuchplace", "n_nationkey, n_name", "false")

# wildcards
lucene("wild_prefix", "part", "p_name:small*", "p_partkey, p_name", "starts_with(lower(p_name), 'small')")
lucene("wild_suffix", "part", "p_name:*bolt", "p_partkey, p_name", "ends_with(lower(p_name), 'bolt')")
lucene("wild_infix", "part", "p_name:*idge*", "p_partkey, p_name", "contains(lower(p_name), 'idge')")
lucene("wild_multi", "part", "p_name:s*l*t", "p_partkey, p_name", "regexp_matches(lower(p_name), '^s.*l.*t$')")
lucene("wild_percent", "part", "p_type:%o%", "p_partkey, p_type", "contains(lower(p_type), 'o')")
lucene("wild_cross", "part", "*econ*", "p_partkey, p_type", "contains(lower(p_name), 'econ') OR contains(lower(p_brand), 'econ') OR contains(lower(p_type), 'econ')")
lucene("wild_short", "part", "p_name:sm*", "p_partkey, p_name", "starts_with(lower(p_name), 'sm')")
lucene("wild_text", "documents", "text:*apache*version*", "doc_id", "regexp_matches(lower(text), 'apache.*version')")

# ranges
lucene("range_between", "orders", "o_totalprice:[1500 TO 150000]", "o_orderkey, o_totalprice", "o_totalprice BETWEEN 1500 AND 150000")
lucene("range_gt", "lineitem", "l_quantity:>45", "l_orderkey, l_linenumber, l_quantity", "l_quantity > 45")
lucene("range_ge", "lineitem", "l_quantity:>=50", "l_orderkey, l_linenumber, l_quantity", "l_quantity >= 50")
lucene("range_lt", "customer", "c_acctbal:<0", "c_custkey, c_acctbal", "c_acctbal < 0")
lucene("range_le", "part", "p_size:<=5", "p_partkey, p_size", "p_size <= 5")
lucene("range_bare", "part", "p_size>45", "p_partkey, p_size", "p_size > 45")
lucene("date_year_range", "orders", "o_orderdate:[19960101 TO 19971231]", "o_orderkey", "year(o_orderdate) BETWEEN 1996 AND 1997")
lucene("date_day_range", "orders", "o_orderdate:[19960110 TO 19960320]", "o_orderkey", "o_orderdate >= TIMESTAMP '1996-01-10' AND o_orderdate < TIMESTAMP '1996-03-21'", precision="day")
lucene("date_after", "orders", "o_orderdate:>19991231", "o_orderkey", "year(o_orderdate) > 1999")
lucene("date_until", "lineitem", "l_shipdate:<=1996-06-30", "l_orderkey, l_linenumber", "l_shipdate < TIMESTAMP '1996-07-01'", precision="day")

# boolean algebra
lucene("bool_and", "lineitem", "l_returnflag:A AND l_quantity:[10 TO 20] AND NOT l_linestatus:O", "l_orderkey, l_linenumber, l_quantity", "lower(l_returnflag) = 'a' AND l_quantity BETWEEN 10 AND 20 AND lower(l_linestatus) <> 'o'")
lucene("bool_or", "orders", "o_orderstatus:F OR o_orderpriority:*urgent", "o_orderkey, o_orderstatus, o_orderpriority", "lower(o_orderstatus) = 'f' OR ends_with(lower(o_orderpriority), 'urgent')")
lucene("bool_not", "events", "* AND NOT event_type:error", "event_id, event_type", "event_type IS NULL OR NOT " + has("event_type", "error"))
lucene("bool_implicit", "part", "p_name:ring p_size:<10", "p_partkey, p_size", has("p_name", "ring") + " AND p_size < 10")
lucene("bool_group", "part", "(p_name:ring OR p_name:bolt) AND p_size:[10 TO 20]", "p_partkey, p_name, p_size", f"({has('p_name', 'ring')} OR {has('p_name', 'bolt')}) AND p_size BETWEEN 10 AND 20")
lucene("bool_minus", "part", "p_name:ring -p_size:>25", "p_partkey, p_size", has("p_name", "ring") + " AND NOT p_size > 25")
lucene("bool_not_first", "customer", "NOT c_mktsegment:building AND c_acctbal:>9000", "c_custkey", "c_acctbal > 9000 AND NOT " + has("c_mktsegment", "building"))

# JSON text and arrays
K = "json_extract_string(props, '$.k')"
lucene("nested_term", "events", "props.k:69", "event_id", f"{K} = '69'")
lucene("nested_range", "events", "props.k:[10 TO 20]", "event_id", f"TRY_CAST({K} AS DOUBLE) BETWEEN 10 AND 20")
lucene("nested_wild", "events", "props.k:6*", "event_id", f"starts_with({K}, '6')")
lucene("array_any", "embeddings", "embedding:>0.45", "vec_id", "len(list_filter(embedding, lambda x: x > 0.45)) > 0")
lucene("array_pos", "embeddings", "embedding[0]:>0.1", "vec_id", "embedding[1] > 0.1")


# pages and counts
add(
    "page",
    lambda s, d: search.page((e := engine(s, d, "orders")).match("o_orderstatus:F"), 2, 50, e.id_column).select("o_orderkey", "o_totalprice"),
    "SELECT o_orderkey, o_totalprice FROM orders WHERE lower(o_orderstatus) = 'f' ORDER BY o_orderkey LIMIT 50 OFFSET 100",
)
add(
    "from_size",
    lambda s, d: search.window((e := engine(s, d, "orders")).match("*"), 37, 25, e.id_column).select("o_orderkey"),
    "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 37",
)
add("count", lambda s, d: engine(s, d, "lineitem").match("l_returnflag:R AND l_discount:>=0.05").agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM lineitem WHERE lower(l_returnflag) = 'r' AND l_discount >= 0.05")
_MANY = ["p_name:ring", "p_size:[1 TO 5]", "p_name:*nut"]

_MANY = {"p_name:ring": has("p_name", "ring"), "p_size:[1 TO 5]": "p_size BETWEEN 1 AND 5", "p_name:*nut": "ends_with(lower(p_name), 'nut')"}


def _multi_search(s: SparkSession, d: str) -> DataFrame:
    pages = engine(s, d, "part").multi_search(list(_MANY))
    return reduce(DataFrame.union, [p.hits.select(F.lit(f"q{i}").alias("q"), F.lit(p.total).cast("bigint").alias("total"), "p_partkey") for i, p in enumerate(pages)])


add("multi_search", _multi_search, " UNION ALL ".join(f"SELECT 'q{i}' AS q, (SELECT count(*) FROM part WHERE {w}) AS total, p_partkey FROM (SELECT p_partkey FROM part WHERE {w} ORDER BY p_partkey LIMIT 10)" for i, w in enumerate(_MANY.values())))
add(
    "search_and",
    lambda s, d: engine(s, d, "part").match_and([("p_name", "ring"), ("p_type", "*o*"), ("p_size", "10")]).select("p_partkey"),
    f"SELECT p_partkey FROM part WHERE {has('p_name', 'ring')} AND contains(lower(p_type), 'o') AND p_size = 10",
)


def _document(s: SparkSession, d: str) -> DataFrame:
    e = engine(s, d, "documents")
    found = e.get(7)
    return s.createDataFrame([found] if found else [], e.df.schema).select("doc_id", "lang", "source", "n_chars")


add("get_document", _document, "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 7")
add(
    "lookup_projection",
    lambda s, d: joins.cross_lookup(read(s, d, "nation"), read(s, d, "supplier"), "n_nationkey", "s_nationkey", id_column="n_nationkey", return_fields=["s_name"], matches=None, strict=True).select(F.col("_source.n_name").alias("n_name"), F.explode("_matches").alias("m")).select("n_name", "m.*"),
    "SELECT n_name, s_name FROM nation JOIN supplier ON n_nationkey = s_nationkey",
)
lucene("fallback_field", "part", "p_n:ring", "p_partkey", has("p_name", "ring"), compat=True)
lucene("fallback_any_column", "part", "p_brand:ring", "p_partkey", " OR ".join(has(c, "ring") for c in ("p_name", "p_brand", "p_type")), compat=True)
lucene("fallback_substring", "part", "p_name:idge", "p_partkey", "contains(lower(p_name), 'idge')", compat=True)
add(
    "age_range",
    lambda s, d: Engine(read(s, d, "orders").withColumn("birthday", F.date_format("o_orderdate", "yyyyMMdd")), "o_orderkey", today=dt.date(2026, 1, 1)).match("age:[27 TO 29]").select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE 2026 - year(o_orderdate) BETWEEN 27 AND 29",
)

# aggregations
add("agg_terms", lambda s, d: agg.terms(read(s, d, "events"), "event_type"), "SELECT event_type AS key, count(*) AS doc_count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
add("agg_terms_top", lambda s, d: agg.terms(read(s, d, "part"), "p_name", 7), "SELECT p_name AS key, count(*) AS doc_count FROM part WHERE trim(p_name) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
add(
    "agg_terms_filtered",
    lambda s, d: agg.terms(engine(s, d, "documents").match("n_chars:>1000"), "lang"),
    "SELECT lang AS key, count(*) AS doc_count FROM documents WHERE n_chars > 1000 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
add(
    "agg_terms_array",
    lambda s, d: agg.terms(read(s, d, "part").withColumn("words", F.split(F.lower("p_name"), " ")), "words", 12),
    "SELECT w AS key, count(*) AS doc_count FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE trim(w) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12",
)
add("agg_terms_nested", lambda s, d: agg.terms(read(s, d, "events"), "props.k", 15), f"SELECT {K} AS key, count(*) AS doc_count FROM events WHERE {K} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")


def _stats(s: SparkSession, d: str) -> DataFrame:
    out = agg.numbers(read(s, d, "lineitem"), {"s": ("stats", {"field": "l_extendedprice"})})
    return out.select(*(F.round(f"0_{p}", 2).alias(p) if p in ("avg", "sum", "min", "max") else F.col(f"0_{p}").alias(p) for p in ("count", "min", "max", "avg", "sum")))


add("agg_stats", _stats, "SELECT count(l_extendedprice) AS count, round(min(l_extendedprice), 2) AS min, round(max(l_extendedprice), 2) AS max, round(avg(l_extendedprice), 2) AS avg, round(sum(l_extendedprice), 2) AS sum FROM lineitem")
for _kind in ("avg", "min", "max", "sum"):
    add(
        f"agg_{_kind}",
        lambda s, d, k=_kind: agg.numbers(engine(s, d, "events").match("event_type:purchase"), {"v": (k, {"field": "value"})}).select(F.round(f"0_{k}", 4).alias("value")),
        f"SELECT round({_kind}(value), 4) AS value FROM events WHERE {has('event_type', 'purchase')}",
    )
add(
    "agg_cardinality",
    lambda s, d: agg.numbers(read(s, d, "events"), {"c": ("cardinality", {"field": "user_id", "precise": True})}).select(F.col("0_cardinality").alias("value")),
    "SELECT count(DISTINCT user_id) AS value FROM events",
)
add(
    "agg_cardinality_approx",
    lambda s, d: agg.numbers(read(s, d, "events"), {"c": ("cardinality", {"field": "user_id"}), "p": ("cardinality", {"field": "user_id", "precise": True})}).select((F.abs(F.col("0_cardinality") - F.col("1_cardinality")) <= 0.1 * F.col("1_cardinality")).alias("close")),
    "SELECT true AS close",
)
add("agg_histogram", lambda s, d: agg.histogram(read(s, d, "lineitem"), "l_quantity", 5), "SELECT CAST(floor(l_quantity / 5.0) * 5.0 AS DOUBLE) AS key, count(*) AS doc_count FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1")
for _interval, _format in (("year", "%Y"), ("month", "%Y%m"), ("day", "%Y%m%d"), ("hour", "%Y%m%d%H")):
    add(
        f"agg_date_histogram_{_interval}",
        lambda s, d, i=_interval: agg.date_histogram(read(s, d, "events"), "ts", i),
        f"SELECT strftime(ts, '{_format}') AS key, count(*) AS doc_count FROM events WHERE ts IS NOT NULL GROUP BY 1",
    )
add("agg_date_histogram_week", lambda s, d: agg.date_histogram(read(s, d, "orders"), "o_orderdate", "week"), "SELECT strftime(date_trunc('week', o_orderdate), '%Y%m%d') AS key, count(*) AS doc_count FROM orders GROUP BY 1")


def _multi(s: SparkSession, d: str) -> DataFrame:
    wanted = {f: {"terms": {"field": f}} for f in ("l_returnflag", "l_linestatus")} | {"max": {"max": {"field": "l_discount"}}, "min": {"min": {"field": "l_tax"}}}
    got = engine(s, d, "lineitem").aggregate("l_quantity:>25", wanted)["aggregations"]
    rows = [(name, b["key"], float(b["doc_count"])) for name, body in got.items() for b in body.get("buckets", [])]
    return s.createDataFrame(rows + [(name, "value", got[name]["value"]) for name in ("max", "min")], "agg string, key string, value double")


add(
    "multi_agg",
    _multi,
    """WITH f AS (SELECT * FROM lineitem WHERE l_quantity > 25)
    SELECT 'l_returnflag' AS agg, l_returnflag AS key, CAST(count(*) AS DOUBLE) AS value FROM f GROUP BY 2
    UNION ALL SELECT 'l_linestatus', l_linestatus, CAST(count(*) AS DOUBLE) FROM f GROUP BY 2
    UNION ALL SELECT 'max', 'value', max(l_discount) FROM f UNION ALL SELECT 'min', 'value', min(l_tax) FROM f""",
)

# joins, lookups, unions
add(
    "join_inner",
    lambda s, d: joins.join(engine(s, d, "orders").match("o_totalprice:>200000"), engine(s, d, "customer").match("c_mktsegment:building"), "o_custkey", "c_custkey").select(F.col("_a.o_orderkey").alias("o_orderkey"), F.col("_b.c_name").alias("c_name")),
    f"SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000 AND {has('c_mktsegment', 'building')}",
)
add(
    "join_self",
    lambda s, d: (lambda e: joins.join(e.match("event_type:purchase AND value:>180"), e.match("event_type:error AND value:>180"), "user_id").select(F.col("_a.event_id").alias("a"), F.col("_b.event_id").alias("b")))(engine(s, d, "events")),
    f"SELECT x.event_id AS a, y.event_id AS b FROM events x JOIN events y ON x.user_id = y.user_id WHERE {has('x.event_type', 'purchase')} AND x.value > 180 AND {has('y.event_type', 'error')} AND y.value > 180",
)
add(
    "cross_lookup",
    lambda s, d: joins.cross_lookup(read(s, d, "nation"), read(s, d, "customer"), "n_nationkey", "c_nationkey", id_column="n_nationkey", matches=None, strict=True).select(F.col("_source.n_name").alias("n_name"), F.col("_match_count").cast("bigint").alias("matches")),
    "SELECT n_name, count(*) AS matches FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1",
)
add(
    "cross_lookup_token",
    lambda s, d: joins.cross_lookup(read(s, d, "part").select(F.col("p_partkey").alias("_id"), F.element_at(F.split("p_name", " "), -1).alias("word")), read(s, d, "part").select(F.col("p_partkey").alias("_id"), "p_name"), "word", "p_name", matches=50).select(F.lower("_source.word").alias("word"), F.col("_match_count").cast("bigint").alias("matches")),
    r"""WITH k AS (SELECT DISTINCT lower(trim(regexp_extract(p_name, '[^ ]*$'))) AS word FROM part),
    t AS (SELECT DISTINCT p_partkey, unnest(list_append(regexp_split_to_array(lower(trim(p_name)), '[\s_\-,./\\|]+'), lower(trim(p_name)))) AS word FROM part)
    SELECT k.word, least(count(*), 50) AS matches FROM k JOIN t ON k.word = t.word WHERE k.word <> '' GROUP BY 1""",
)
add(
    "multi_index",
    lambda s, d: (lambda e: e.match("c_acctbal:>9500 OR s_acctbal:>9500").select("_index", F.coalesce("c_custkey", "s_suppkey").alias("id")))(Engine({"customer": read(s, d, "customer"), "supplier": read(s, d, "supplier")})),
    "SELECT 'customer' AS _index, c_custkey AS id FROM customer WHERE c_acctbal > 9500 UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_acctbal > 9500",
)
add(
    "multi_index_agg",
    lambda s, d: agg.terms(Engine({"customer": read(s, d, "customer").withColumnRenamed("c_nationkey", "nationkey"), "supplier": read(s, d, "supplier").withColumnRenamed("s_nationkey", "nationkey")}).df, "nationkey", 25),
    "SELECT CAST(k AS VARCHAR) AS key, count(*) AS doc_count FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
)

# sets of documents, duplicates
add("set_union", lambda s, d: engine(s, d, "documents").match("lang:de OR lang:fr").select("doc_id"), "SELECT doc_id FROM documents WHERE lang IN ('de', 'fr')")
add("set_intersect", lambda s, d: engine(s, d, "documents").match("lang:en AND source:src1").select("doc_id"), "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'")
add("set_except", lambda s, d: engine(s, d, "documents").match("lang:en AND NOT source:src1").select("doc_id"), "SELECT doc_id FROM documents WHERE lang = 'en' AND source <> 'src1'")
add(
    "dedup_all",
    lambda s, d: dedup.deduplicate(read(s, d, "documents").withColumnRenamed("doc_id", "_id"), None).select(F.col("_id").alias("doc_id")),
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text, lang, source, n_chars ORDER BY doc_id) AS r FROM documents) WHERE r = 1",
)
add(
    "dedup_fields",
    lambda s, d: dedup.deduplicate(read(s, d, "documents"), ["text"], "doc_id").select("doc_id"),
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1",
)
add("dedup_report", lambda s, d: dedup.report(read(s, d, "documents"), ["text"]), "SELECT count(*) AS total, count(DISTINCT text) AS \"unique\", count(*) - count(DISTINCT text) AS duplicates FROM documents")

# normal forms, words, shapes
_DATE = "regexp_replace(regexp_replace(regexp_replace(trim({0}), ' ', '', 'g'), '^(\\d{{4}})[-/|.](\\d{{2}})[-/|.](\\d{{2}})$', '\\1\\2\\3'), '^(\\d{{2}})[-/|.](\\d{{2}})[-/|.](\\d{{4}})$', '\\3\\2\\1')"
add(
    "normalize_date",
    lambda s, d: read(s, d, "orders").select("o_orderkey", text.normal_date(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("a"), text.normal_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("b")),
    f"SELECT o_orderkey, {_DATE.format('strftime(o_orderdate, $$%d/%m/%Y$$)')} AS a, {_DATE.format('strftime(o_orderdate, $$%Y-%m-%d$$)')} AS b FROM orders",
)
add(
    "normalize_phone",
    lambda s, d: read(s, d, "customer").select("c_custkey", text.normal_phone(F.concat(F.lit("+62 8"), F.col("c_custkey").cast("string"), F.lit("-"), F.col("c_nationkey").cast("string"))).alias("phone")),
    "SELECT c_custkey, '08' || CAST(c_custkey AS VARCHAR) || CAST(c_nationkey AS VARCHAR) AS phone FROM customer",
)
add(
    "tokenize",
    lambda s, d: read(s, d, "part").select("p_partkey", F.explode(text.tokens(F.col("p_name"))).alias("token")),
    r"SELECT DISTINCT p_partkey, token FROM (SELECT p_partkey, unnest(list_append(regexp_split_to_array(lower(trim(p_name)), '[\s_\-,./\\|]+'), lower(trim(p_name)))) AS token FROM part) WHERE len(token) >= 2",
)
add(
    "vocabulary",
    lambda s, d: read(s, d, "part").select(F.explode(text.tokens(F.col("p_type"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")),
    r"SELECT token, count(*) AS df FROM (SELECT DISTINCT p_partkey, token FROM (SELECT p_partkey, unnest(list_append(regexp_split_to_array(lower(trim(p_type)), '[\s_\-,./\\|]+'), lower(trim(p_type)))) AS token FROM part)) WHERE len(token) >= 2 GROUP BY 1",
)
add(
    "trigrams",
    lambda s, d: read(s, d, "nation").select("n_nationkey", F.explode(text.trigrams(F.col("n_name"))).alias("gram")),
    "SELECT n_nationkey, substr(lower(n_name), i, 3) AS gram FROM (SELECT n_nationkey, n_name, unnest(range(1, length(n_name) - 1)) AS i FROM nation)",
)
add(
    "flatten",
    lambda s, d: expand(read(s, d, "events").select("event_id", F.from_json("props", "k int").alias("props"), F.array("event_type", F.lit("x")).alias("tags")), longest=2).select("event_id", F.col("`props.k`").alias("k"), F.col("`tags[0]`").alias("t0"), F.col("`tags[1]`").alias("t1")),
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type AS t0, 'x' AS t1 FROM events",
)
add(
    "collapse",
    lambda s, d: collapse(read(s, d, "customer").select("c_custkey", F.col("c_name").alias("who.name"), F.col("c_mktsegment").alias("who.segment"))).select("c_custkey", F.col("who.name").alias("name"), F.col("who.segment").alias("segment")),
    "SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer",
)


REGISTRY.update(QUERIES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "lineitem")
    return search.page(e.match("l_returnflag:A AND l_quantity:[10 TO 20] AND NOT l_linestatus:O"), 0, 100, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
