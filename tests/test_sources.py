"""Files of every shape, types, datasets, and the command line."""

import bz2
import gzip
import json

import pytest

from docquery import cli
from docquery.engine import Engine
from docquery.sources import readers
from docquery.sources.catalog import Catalog
from docquery.sources.classify import classify, column_map, link_columns, value_type
from docquery.streaming.append import follow

ROWS = [{"id": i, "name": f"n{i}", "tags": ["a", f"t{i}"]} for i in range(3)]


@pytest.mark.parametrize(
    "name, text",
    [
        ("array.json", json.dumps(ROWS)),
        ("pretty.json", json.dumps(ROWS, indent=2)),
        ("lines.jsonl", "\n".join(map(json.dumps, ROWS)) + "\n{broken\n"),
        ("dump.jsonl", "\n".join(json.dumps({"_index": "x", "_source": r}) for r in ROWS)),
        ("bulk.ndjson", "\n".join(json.dumps({"index": {"_id": r["id"]}}) + "\n" + json.dumps(r) for r in ROWS) + "\nnonsense\n"),
        ("response.json", json.dumps({"took": 1, "hits": {"total": 3, "hits": [{"_id": "1", "_source": r} for r in ROWS]}})),
        ("wrapped.json", json.dumps({"data": ROWS}, indent=1)),
    ],
)
@pytest.mark.parametrize("suffix, pack", [("", None), (".gz", gzip.compress), (".bz2", bz2.compress)])
def test_json_shapes(spark, tmp_path, name, text, suffix, pack):
    path = tmp_path / (name + suffix)
    path.write_bytes(pack(text.encode()) if pack else text.encode())
    got = sorted(readers.read(spark, str(path)).select("id", "name", "tags").collect())
    assert [r.asDict() for r in got] == ROWS


def test_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines"\n2,plain\n')
    assert sorted(map(tuple, readers.read(spark, str(tmp_path / "a.csv")).collect())) == [("1", "two\nlines"), ("2", "plain")]


def test_wrapped_lists(spark, tmp_path):
    many = {"page": 1, "total": 3, "ok": True, "took": 2, "server": {"id": 4}, "zeta": ROWS, "alpha": [{"no": 1}]}
    (tmp_path / "w.json").write_text(json.dumps(many))
    assert sorted(r.id for r in readers.read(spark, str(tmp_path / "w.json")).collect()) == [0, 1, 2]
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "items": [{"x": 1}]}]))
    assert [r.id for r in readers.read(spark, str(tmp_path / "a.json")).collect()] == [1]
    (tmp_path / "deep.json").write_text(json.dumps({"result": {"rows": ROWS}}))
    got = readers.read_url(spark, (tmp_path / "deep.json").as_uri(), str(tmp_path / "root"), "result.rows") if (tmp_path / "root").mkdir() is None else None
    assert sorted(r.id for r in got.collect()) == [0, 1, 2]
    page = readers.preview(got.orderBy("id"), 1, 2)
    assert [r["id"] for r in page["rows"]] == [2] and not page["more"] and readers.preview(got, 0, 2)["more"]


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for folder, text in (("a", "name\nann\nbob\n"), ("b", "name\ncy\n")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "part.csv").write_text(text)
    catalog = Catalog(spark, str(tmp_path / "root"))
    catalog.build("d", str(tmp_path / "in"))
    rows = catalog.open("d").collect()
    assert sorted((r.name, r._id, r._source) for r in rows) == [("ann", 0, "part.csv"), ("bob", 1, "part.csv"), ("cy", 2, "part.csv")]


def test_one_type_for_a_column_in_all_files(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "root"))
    files = {"1": 'zq,zqv\n5,1\n7,2\n', "2": 'zq,zqv\nfive,2.5\n', "3": 'zq,extra\n9,x\n'}
    (tmp_path / "in").mkdir()
    for name, text in files.items():
        (tmp_path / "in" / f"{name}.csv").write_text(text)
    catalog.build("d", str(tmp_path / "in"))
    got = sorted((r._id, r.zq, r.zqv, r.extra) for r in catalog.open("d").collect())
    assert got == [(0, "5", 1.0, None), (1, "7", 2.0, None), (2, "five", 2.5, None), (3, "9", None, "x")]
    catalog.append("d", [{"zq": 3, "nested": {"a": 1}}])
    catalog.append("d", [{"zq": 4, "nested": {"a": "x", "b": [1]}}])
    catalog.append("d", [{"nested": {"a": "y", "b": ["q"]}}])
    last = sorted(catalog.open("d").where("_id > 3").collect(), key=lambda r: r._id)
    assert [(r.zq, r.nested.a, r.nested.b) for r in last] == [("3", "1", None), ("4", "x", ["1"]), (None, "y", ["q"])]
    assert Engine(catalog.open("d")).count("nested.a:x") == 1


def test_sealed_datasets_take_no_rows_and_show_no_key(spark, tmp_path):
    (tmp_path / "p.csv").write_text("name\nann\n")
    catalog = Catalog(spark, str(tmp_path / "root"))
    catalog.build("p", str(tmp_path / "p.csv"))
    catalog.seal("p", "secret")
    for act in (lambda: catalog.build("p", str(tmp_path / "p.csv")), lambda: catalog.append("p", [{"name": "bo"}]), lambda: catalog.deduplicate("p"), lambda: catalog.seal("p", "x")):
        with pytest.raises(PermissionError):
            act()
    key = catalog._key("secret", catalog._read("p")["sealed"]["salt"])
    plan = catalog.open("p", "secret")._jdf.queryExecution().toString()
    assert key not in plan and key.upper() not in plan
    e = Engine.open(spark, str(tmp_path / "root" / "p"), passphrase="secret")
    assert e.count("name:ann") == 1
    catalog.compress("p")
    catalog.unseal("p", "secret")
    catalog.append("p", [{"name": "bo"}])
    e.reload_stats()
    assert e.count("*") == 2


def test_names_of_headerless_files_are_kept(spark, tmp_path):
    f = tmp_path / "h.csv"
    f.write_text("ann;1\n")
    catalog = Catalog(spark, str(tmp_path / "root"))
    catalog.build("h", str(f), delimiter=";", columns=["who", "n"])
    f.write_text("ann;1\nbo;2\n")
    catalog.build("h", str(f))
    assert sorted(r.who for r in catalog.open("h").collect()) == ["ann", "bo"]
    assert catalog.estimate(str(tmp_path / "h.csv"))["rows"] >= 1


def test_a_single_object(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"id": 7, "name": "x"}, indent=2))
    assert readers.read(spark, str(tmp_path / "one.json")).collect()[0].id == 7


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Full Name,amount\n"x, y",0012\nshort\nz,5\n')
    (tmp_path / "b.txt").write_text("x;1\ny;2\n")
    assert sorted(map(tuple, readers.read(spark, str(tmp_path / "a.csv")).collect())) == [("x, y", "0012"), ("z", "5")]
    assert sorted(map(tuple, readers.read(spark, str(tmp_path / "b.txt"), ";", ["p", "q"]).collect())) == [("x", "1"), ("y", "2")]
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "hidden.csv").write_text("a\n1\n")
    (tmp_path / "c.jsonl.gz").write_bytes(b"")
    assert [p.rpartition("/")[2] for p in readers.discover(spark, str(tmp_path))] == ["a.csv", "c.jsonl.gz"]


@pytest.mark.parametrize(
    "samples, kind",
    [(["[1]", "[2]"], "ARRAY"), (['{"a":1}'], "OBJECT"), (["2026-01-02", "20260103"], "DATE"), (["yes", "no", "tidak"], "BOOL"), (["12", "1,300"], "INT"), (["1.5", "2"], "FLOAT"), (["012", "13"], "KEYWORD"), (["two words", "x y z"], "TEXT"), (["code"], "KEYWORD"), ([], "KEYWORD"), (["2026-01-15T08:00:00"], "DATE")],
)
def test_value_types(samples, kind):
    assert value_type(samples) == kind


@pytest.mark.parametrize("name, samples, want", [("City", ["x"], ("KEYWORD", 1.0)), ("phone", [], ("KEYWORD", 1.0)), ("my_address_2", [], ("TEXT", 0.8)), ("zzq", [], ("KEYWORD", 0.0)), ("zzq", ["12.5", "3.5"], ("FLOAT", 1.0)), ("zzq", ["male", "female"], ("KEYWORD", 1.0)), ("zzq", ["a@b.co"] * 3, ("KEYWORD", 1.0)), ("zzq", ["some words here"], ("TEXT", 0.5)), ("tags", [], ("ARRAY", 1.0))])
def test_classification(name, samples, want):
    assert classify(name, samples) == want


def test_links():
    got = link_columns([["User Name", "x1"], ["user-name", "username", "qqq"]])
    assert got["user_name"] == [(0, "User Name"), (1, "user-name"), (1, "username")] and "qqq" in got


@pytest.fixture
def people(tmp_path):
    path = tmp_path / "in" / "people.csv"
    path.parent.mkdir()
    path.write_text('Name,City,Score,Birth Date,Tags,zinfo\nAnn Lee,Bali,1.5,1990-01-02,"[""a"",""b""]","{""k"": 5}"\nBob Ray,Bandung,22,03/04/1991,"[""b""]","{""k"": 7, ""m"": ""q""}"\nBob Ray,Bandung,22,03/04/1991,"[""b""]","{""k"": 7, ""m"": ""q""}"\n')
    return path


def test_build_search_and_look_after(spark, tmp_path, people):
    catalog = Catalog(spark, str(tmp_path / "root"))
    assert catalog.build("p", str(people.parent)) == {"indexed": [str(people)], "skipped": []}
    assert catalog.build("p", str(people))["skipped"] == [str(people)]
    e = Engine(catalog.open("p"))
    assert e.columns() | {"score": "double", "tags": "array<string>", "zinfo": "struct<k:bigint,m:string>", "birth_date": "string"} == e.columns()
    assert [r["_id"] for r in e.query("*").rows()] == [0, 1, 2] and e.get(0)["birth_date"] == "19900102"
    assert e.count("tags:b") == 3 and e.count("zinfo.k:>6") == 2 and e.count("score:<2") == 1 and e.count("birth_date:[19910101 TO 19911231]") == 2
    assert catalog.append("p", [{"name": "Cy", "city": "Medan", "tags": ["c"]}]) == 1
    e = Engine(catalog.open("p"))
    assert e.query("city:medan").rows()[0]["_id"] == 3
    people.write_text("Name,City\nOnly One,Bali\n")
    catalog.build("p", str(people))
    assert Engine(catalog.open("p")).count("*") == 2  # a changed file replaces its own rows
    assert catalog.mapping("p")["city"] == "KEYWORD" and catalog.stats("p")["total_docs"] == 2
    catalog.put_mapping("p", {"city": "TEXT"})
    assert catalog.mapping("p")["city"] == "TEXT"
    catalog.compress("p")
    catalog.rename("p", "q")
    assert catalog.names() == ["q"] and catalog.delete("q") and catalog.names() == []


def test_duplicates_and_seals(spark, tmp_path, people):
    catalog = Catalog(spark, str(tmp_path / "root"))
    catalog.build("p", str(people), overrides={"score": "KEYWORD"})
    assert Engine(catalog.open("p")).columns()["score"] == "string"
    assert catalog.deduplicate("p", dry_run=True) == {"total": 3, "unique": 2, "duplicates": 1}
    catalog.deduplicate("p")
    before = sorted(map(repr, catalog.open("p").select("_id", "name", "tags", "zinfo").collect()))
    assert len(before) == 2
    catalog.seal("p", "secret")
    with pytest.raises(PermissionError):
        catalog.open("p", "wrong")
    assert sorted(map(repr, catalog.open("p", "secret").select("_id", "name", "tags", "zinfo").collect())) == before
    catalog.unseal("p", "secret")
    assert sorted(map(repr, catalog.open("p").select("_id", "name", "tags", "zinfo").collect())) == before


def test_stream(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    schema = spark.createDataFrame([(1, "x")], "id bigint, city string").schema
    for i in range(2):
        (folder / f"{i}.json").write_text(json.dumps({"id": i, "city": "Bali"}))
        follow(spark, str(folder), schema, str(tmp_path / "root"), "s", str(tmp_path / "progress")).awaitTermination()
    rows = Engine(Catalog(spark, str(tmp_path / "root")).open("s")).query("city:bali").rows()
    assert [(r["_id"], r["id"]) for r in rows] == [(0, 0), (1, 1)]


def test_command_line(spark, tmp_path, people):
    root = str(tmp_path / "root")
    assert cli.run(spark, ["classify", str(people)])["City"]["semantic_type"] == "KEYWORD"
    assert cli.run(spark, ["build", root, "p", str(people)])["indexed"]
    assert cli.run(spark, ["search", root, "p", "city:bandung"])["total"] == 2
    assert cli.run(spark, ["count", root, "p", "tens OR city:bali"])["count"] == 1
    assert cli.run(spark, ["aggregate", root, "p", '{"c": {"terms": {"field": "city"}}}'])["aggregations"]["c"]["buckets"][0] == {"key": "Bandung", "doc_count": 2}
    assert len(cli.run(spark, ["join", root, "p", "*", "*", "city"])) == 5
    assert cli.run(spark, ["dedup", root, "p", "--dry-run"])["duplicates"] == 1
    assert cli.run(spark, ["list", root]) == ["p"] and cli.run(spark, ["delete", root, "p"]) == {"deleted": True}


def test_overrides_in_both_forms(spark):
    df = spark.createDataFrame([("1",)], "A string")
    assert column_map(df, {"a": "text"})["A"]["semantic_type"] == "TEXT"
    assert column_map(df, {"a": {"semantic_type": "INT"}})["A"]["semantic_type"] == "INT"
