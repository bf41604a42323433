"""Hits, facets, joins and shapes over ten people, against counts worked out by hand."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from docquery.engine import Engine
from docquery.functions import text
from docquery.operators import aggregate as agg
from docquery.operators import dedup
from docquery.plans.parser import QuerySyntaxError
from docquery.sources.flatten import collapse, expand

CITY = ["Jakarta", "Surabaya", "Bandung", "Semarang", "Yogyakarta", "Jakarta", "Bali", "Medan", "Makassar", "Jakarta Selatan"]
STATUS = ["active", "inactive", "active", "active", "pending", "active", "active", "inactive", "active", "active"]
SCORE = [87.5, 72.0, 95.0, 68.0, 80.5, 91.0, 77.0, 88.5, 84.0, 60.0]
LEVEL = [12, 8, 15, 10, 11, 14, 9, 13, 12, 20]
VALUE = [100, 150, 120, 300, 180, 500, 90, 250, 350, 750]
TAGS = [["graphql", "java"], ["python"], ["ml", "python"], ["java"], ["graphql"], ["golang"], [], None, ["postgres"], ["deep learning"]]


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        {
            "_id": i,
            "name": ["Alice Stone", "Bo Tensor", "Cy Putri", "Di Hart", "Ed Lake", "Fay Moor", "Gus Hill", "Hal Wood", "Ida Rain", "Jo Field"][i],
            "email": f"p{i}@{'dev.io' if i < 2 else 'start-up.id'}",
            "city": CITY[i],
            "status": STATUS[i],
            "enabled": STATUS[i] == "active",
            "score": SCORE[i],
            "level": LEVEL[i],
            "balance": f"{(i + 1) * 500_000:,}",
            "created_at": f"2026-01-{i + 10}T08:30:00",
            "birthday": f"{1990 + i}0322",
            "joined": dt.date(2020 + i % 3, 5, 1 + i),
            "tags": TAGS[i],
            "info": {"a": {"value": VALUE[i], "names": [f"alpha_{i}", "beta"]}, "deep": f"secret {i}"},
            "extra": f'{{"k": {i}, "list": ["x{i}", "y"], "in": {{"z": "Q{i}"}}}}',
        }
        for i in range(10)
    ]
    schema = "_id bigint, name string, email string, city string, status string, enabled boolean, score double, level bigint, balance string, created_at string, birthday string, joined date, tags array<string>, info struct<a: struct<value: bigint, names: array<string>>, deep: string>, extra string"
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def engine(people):
    return Engine(people, today=dt.date(2026, 6, 1))


@pytest.fixture(scope="module")
def lenient(people):
    return Engine(people, compat=True)


CASES = [
    ("city:Jakarta", {0, 5, 9}),
    ("city:jakarta", {0, 5, 9}),
    ('city:"jakarta selatan"', {9}),
    ("city:NonExistent", set()),
    ("nosuchfield:x", set()),
    ("status:active", {0, 2, 3, 5, 6, 8, 9}),
    ("email:dev.io", {0, 1}),
    ("email:p3", {3}),
    ("email:start-up.id", set(range(2, 10))),
    ("email:start", set()),
    ("name:Alice*", {0}),
    ("name:*Putri", {2}),
    ("city:*arta*", {0, 4, 5, 9}),
    ("name:a*e", {0}),
    ("name:a*n%", {0}),
    ("email:*@dev.io", {0, 1}),
    ("*tens*", {1}),
    ("tags:graphql", {0, 4}),
    ("tags[0]:ml", {2}),
    ("tags[1]:python", {2}),
    ("tags[7]:python", set()),
    ("tags:learning", {9}),
    ("golang", {5}),
    ("info.a.value:[100 TO 200]", {0, 1, 2, 4}),
    ("info.a.value:>=500", {5, 9}),
    ("info.a.value:<100", {6}),
    ("info.deep:secret*", set(range(10))),
    ("info.a.names[0]:alpha_3", {3}),
    ("info.a.names:beta", set(range(10))),
    ("info:beta", set(range(10))),
    ("extra.k:7", {7}),
    ("extra.k:[2 TO 4]", {2, 3, 4}),
    ("extra.list[0]:x5", {5}),
    ("extra.list:x5", {5}),
    ("extra.in.z:q8", {8}),
    ("extra.in.z:Q*", set(range(10))),
    ("balance:>1000000", set(range(2, 10))),
    ("balance<1000000", {0}),
    ("balance:[1,000,000 TO 2000000]", {1, 2, 3}),
    ("score:[80 TO 95]", {0, 2, 4, 5, 7, 8}),
    ("level:12", {0, 8}),
    ("level:[13 TO 999]", {2, 5, 7, 9}),
    ("level:>20", set()),
    ("created_at:[20260101 TO 20260131]", set(range(10))),
    ("created_at:[20250101 TO 20251231]", set()),
    ("joined:[20210101 TO 20210601]", {1, 4, 7}),
    ("joined:>20210101", {2, 5, 8}),
    ("joined:<=2020-02-01", {0, 3, 6, 9}),
    ("age:[29 TO 31]", {5, 6, 7}),
    ("age:>=34", {0, 1, 2}),
    ("enabled:true", {0, 2, 3, 5, 6, 8, 9}),
    ("enabled:false", {1, 4, 7}),
    ("city:Jakarta AND status:active AND level:>12", {5, 9}),
    ("tags:python OR tags:golang", {1, 2, 5}),
    ("* AND NOT city:Jakarta", {1, 2, 3, 4, 6, 7, 8}),
    ("* -tags:python", {0, 3, 4, 5, 6, 7, 8, 9}),
    ("NOT status:active level:>8", {4, 7}),
    ("tags:postgres AND (score:[71 TO 999] OR level:1)", {8}),
    ("*", set(range(10))),
    ("%", set(range(10))),
    ("", set()),
    ('name:""', set()),
    (r"created_at:2026\-01\-15T08\:30\:00", {5}),
    ("created_at:20260115", {5}),
]


@pytest.mark.parametrize("query, ids", CASES)
def test_hits(engine, query, ids):
    assert {r["_id"] for r in engine.match(query).select("_id").collect()} == ids


def test_year_and_day(people):
    exact = Engine(people, precision="day")
    assert {r["_id"] for r in exact.match("joined:[20210101 TO 20210503]").collect()} == {1}
    assert {r["_id"] for r in exact.match("created_at:[20260112 TO 20260114]").collect()} == {2, 3, 4}


@pytest.mark.parametrize("query, ids", [("name:tens", {1}), ('name:"tens"', set()), ("cit:bandung", {2}), ("name:bandung", {2}), ("tags:nonexistent", set())])
def test_fallbacks(lenient, query, ids):
    assert {r["_id"] for r in lenient.match(query).collect()} == ids


def test_algebra_against_sets(engine):
    leaves = ["city:jakarta", "level:>11", "tags:python"]
    hits = {q: {r["_id"] for r in engine.match(q).collect()} for q in leaves}
    for a, b, c in itertools.permutations(leaves):
        assert {r["_id"] for r in engine.match(f"({a} OR {b}) AND NOT {c}").collect()} == (hits[a] | hits[b]) - hits[c]


def test_only_excluding_fails(engine):
    for query in ("NOT city:Jakarta", "-city:Jakarta", "NOT a OR b"):
        with pytest.raises(QuerySyntaxError):
            engine.query(query)


def test_pages(engine):
    got = engine.query("*", 1, 4)
    assert got.total == 10 and [r["_id"] for r in got.rows()] == [4, 5, 6, 7]
    assert engine.count("status:active") == 7 and engine.get(3)["city"] == "Semarang" and engine.get(99) is None
    assert engine.search_and([("city", "jakarta"), ("status", "active")]).total == 3
    assert [p.total for p in engine.multi_search(["level:12", "*"])] == [2, 10]
    assert engine.search("Jakart*", "city").total == 3 and engine.summary()["total_docs"] == 10


def test_facets(engine):
    got = engine.aggregate("*", {"by": {"terms": {"field": "status"}}, "s": {"stats": {"field": "score"}}, "top": {"max": {"field": "balance"}}, "tags": {"terms": {"field": "tags", "size": 1}}, "h": {"histogram": {"field": "level", "interval": 5}}, "n": {"cardinality": {"field": "city", "precise": True}}, "d": {"date_histogram": {"field": "created_at", "interval": "month"}}, "v": {"avg": {"field": "info.a.value"}}})
    a = got["aggregations"]
    assert got["hits"]["total"] == 10 and a["by"]["buckets"] == [{"key": "active", "doc_count": 7}, {"key": "inactive", "doc_count": 2}, {"key": "pending", "doc_count": 1}]
    assert a["s"] == {"count": 10, "min": 60.0, "max": 95.0, "avg": pytest.approx(80.35), "sum": pytest.approx(803.5)}
    assert a["top"]["value"] == 5_000_000 and a["tags"] == {"buckets": [{"key": "graphql", "doc_count": 2}], "sum_other_doc_count": 6}
    assert a["h"]["buckets"] == [{"key": 5.0, "doc_count": 2}, {"key": 10.0, "doc_count": 6}, {"key": 15.0, "doc_count": 1}, {"key": 20.0, "doc_count": 1}]
    assert a["n"]["value"] == 9 + 0 and a["d"]["buckets"] == [{"key": "202601", "key_as_string": "202601", "doc_count": 10}] and a["v"]["value"] == sum(VALUE) / 10
    assert engine.aggregate("level:>999", {"avg": {"field": "score"}})["aggregations"]["avg"]["value"] is None
    with pytest.raises(ValueError):
        agg.requests({"x": {"nosuch": {"field": "a"}}})


def test_joins(engine, people):
    pairs = {(r["_a"]["_id"], r["_b"]["_id"]) for r in engine.join("level:12", "status:active", "status").collect()}
    assert pairs == {(a, b) for a in (0, 8) for b in (0, 2, 3, 5, 6, 8, 9)}
    target = Engine(people.selectExpr("_id", "city AS place", "score"))
    found = {r["_source"]["city"]: [m["_id"] for m in r["_matches"]] for r in engine.cross_lookup("status:active", target, "city", "place", return_fields=["score"]).collect()}
    assert found["Jakarta"] == [0, 5, 9] and found["Jakarta Selatan"] == [9] and "Surabaya" not in found
    capped = engine.cross_lookup("*", target, "city", "place", matches=1, top_n=2).collect()
    assert sorted(r["_match_count"] for r in capped) == [1, 1]


def test_several_datasets(people):
    e = Engine({"one": people.select("_id", "city"), "two": people.select("_id", "score")})
    assert {(r["_index"], r["_id"]) for r in e.match("city:bali OR score:<65").collect()} == {("one", 6), ("two", 9)}


def test_duplicates(people):
    twice = people.union(people.withColumn("_id", F.col("_id") + 100))
    assert dedup.report(twice).first().asDict() == {"total": 20, "unique": 10, "duplicates": 10}
    assert {r["_id"] for r in dedup.deduplicate(twice).collect()} == set(range(10))
    assert {r["_id"] for r in dedup.deduplicate(people, ["status"]).collect()} == {0, 1, 4}


def words(v):
    """The words of a value, from their definition."""
    import re

    low, digits = v.strip().lower(), re.sub("[^0-9]", "", v)
    out = {low, *re.split(text.SEPARATORS, low)}
    if "@" in low:
        out |= set(low.split("@", 1))
    if len(digits) >= 4:
        out |= {digits} | {d for n in (4, 6, 8) if len(digits) > n for d in (digits[:n], digits[-n:])}
    return {w for w in out if len(w) >= 2}


def test_duplicates_with_ids_that_repeat(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "d"), (3, "d"), (4, None), (5, None)], "_id int, v string")
    assert sorted(map(repr, map(tuple, dedup.deduplicate(rows).collect()))) == sorted(map(repr, [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, None)]))
    assert dedup.deduplicate(rows.limit(0)).count() == 0


def test_exact_sums(spark):
    rows = spark.createDataFrame([(9007199254740993,), (2,)], "n bigint")
    got = Engine(rows, "n").aggregate("*", {"s": {"sum": {"field": "n"}}, "m": {"max": {"field": "n"}}})["aggregations"]
    assert got["s"]["value"] == 9007199254740995 and got["m"]["value"] == 9007199254740993
    big = spark.createDataFrame([(2**63 - 1,)] * 3, "n bigint")
    assert Engine(big, "n").aggregate("*", {"sum": {"field": "n"}})["aggregations"]["sum"]["value"] == 3 * (2**63 - 1)


def test_protected_wildcards(spark):
    rows = spark.createDataFrame([(0, "a*b"), (1, "aXXb"), (2, "50%"), (3, "50 percent")], "_id int, v string")
    e = Engine(rows)
    for query, ids in ((r"v:a\*b", {0}), ("v:a*b", {0, 1}), (r"v:50\%", {2}), (r"v:a\**", {0}), (r"v:*\%", {2}), (r"v:\*", set())):
        assert {r["_id"] for r in e.match(query).collect()} == ids, query


VALUES = ["Jakarta Selatan", "ann.b@mail.io", "+62 812-3456-789", "2026-01-15T08:20:10", "a", "  x y  ", "['a', 'b']", "C:\\dir|e", "123", "1234", "12345678", "user@a@b.c", "", "ÜBER-größe", "a.b,c"]


def test_words(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    got = {r.v: set(r.t) for r in df.select("v", text.tokens(F.col("v")).alias("t")).collect()}
    assert got == {v: words(v) for v in VALUES}
    every = sorted(set().union(*map(words, VALUES))) + ["zz", "0000", "selatan jakarta"]
    row = df.groupBy().agg(*(F.collect_set(F.when(text.has_token(F.col("v"), w), F.col("v"))).alias(str(i)) for i, w in enumerate(every))).first()
    for i, w in enumerate(every):
        assert set(row[i]) == {v for v in VALUES if w in words(v)}, w


def test_normal_forms(spark):
    df = spark.createDataFrame([("1982-03-28", "+62 812-345"), ("28|03|1982", "62"), (" 28.03.1982 ", "(021) 5"), ("2026-01-15T08:30:00", ""), ("x y", "abc")], "date string, phone string")
    got = df.select(text.normal_value(F.col("date"), "Created At"), text.normal_value(F.col("phone"), "no_hp"), text.normal_value(F.col("date"), "other")).collect()
    assert [r[0] for r in got] == ["19820328", "19820328", "19820328", "2026-01-15T08:30:00", "xy"]
    assert [r[1] for r in got] == ["0812345", "62", "0215", "", ""] and got[0][2] == "1982-03-28"


def test_flatten_and_back(people):
    flat = expand(people.select("_id", "tags", "info"))
    assert {"tags", "tags[0]", "tags[1]", "info.a.value", "info.a.names[1]", "info.deep"} <= set(flat.columns)
    back = {r["_id"]: r for r in collapse(flat).collect()}
    assert back[2]["tags"] == ["ml", "python"] and back[2]["info"]["a"]["value"] == 120 and back[6]["tags"] == []


def test_ranges_reach_the_scan(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = Engine(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderkey").match("o_orderdate:[19960101 TO 19971231] AND o_totalprice:>1000").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in pushed and "LessThan(o_orderdate,1998-01-01" in pushed and "GreaterThan(o_totalprice,1000.0)" in pushed
