"""The command line: build, search, join and look after datasets."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from docquery.engine import Engine
from docquery.operators.search import page
from docquery.plans.parser import QuerySyntaxError
from docquery.sources import readers
from docquery.sources.catalog import Catalog
from docquery.sources.classify import column_map


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docquery", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options: dict) -> None:
        c = sub.add_parser(name)
        for a in positional:
            c.add_argument(a)
        for flag, how in options.items():
            c.add_argument(f"--{flag.replace('_', '-')}", **how)

    text, flag = {"default": None}, {"action": "store_true"}
    command("classify", "path", delimiter=text)
    command("build", "root", "name", "path", delimiter=text, columns=text, map=text, dedup=flag, fields=text)
    command("search", "root", "name", "query", page={"type": int, "default": 0}, size={"type": int, "default": 20}, column=text, passphrase=text)
    command("count", "root", "name", "query")
    command("aggregate", "root", "name", "aggs", query=text, size={"type": int, "default": 10})
    command("join", "root", "name", "query_a", "query_b", "on", size={"type": int, "default": 20})
    command("stats", "root", "name")
    command("list", "root")
    command("dedup", "root", "name", fields=text, dry_run=flag)
    command("delete", "root", "name")
    command("rename", "root", "name", "new")
    command("compress", "root", "name", codec={"default": "zstd"})
    command("encrypt", "root", "name", "passphrase")
    command("decrypt", "root", "name", "passphrase")
    return p


def run(spark: SparkSession, argv: list[str]) -> object:
    """The answer of a command, ready for JSON."""
    a = parser().parse_args(argv)
    if a.command == "classify":
        return column_map(readers.read(spark, a.path, a.delimiter))
    catalog = Catalog(spark, a.root)
    listed = lambda x: x.split(",") if x else None
    engine = lambda: Engine(catalog.open(a.name, getattr(a, "passphrase", None)), compat=True)
    match a.command:
        case "build":
            overrides = json.loads(a.map) if a.map else None
            return catalog.build(a.name, a.path, a.delimiter, listed(a.columns), overrides, a.dedup, listed(a.fields))
        case "search":
            found = engine().search(a.query, a.column, a.page, a.size) if a.column else engine().query(a.query, a.page, a.size)
            return {"total": found.total, "hits": found.rows()}
        case "count":
            return {"count": engine().count(a.query)}
        case "aggregate":
            return engine().aggregate(a.query, json.loads(a.aggs), a.size)
        case "join":
            pairs = engine().join(a.query_a, a.query_b, a.on)
            return [r.asDict(recursive=True) for r in page(pairs.selectExpr("*", "_a._id AS _id"), 0, a.size).drop("_id").collect()]
        case "stats":
            return catalog.stats(a.name)
        case "list":
            return catalog.names()
        case "dedup":
            return catalog.deduplicate(a.name, listed(a.fields), a.dry_run)
        case "delete":
            return {"deleted": catalog.delete(a.name)}
        case "rename":
            catalog.rename(a.name, a.new)
        case "compress":
            catalog.compress(a.name, a.codec)
        case "encrypt":
            catalog.seal(a.name, a.passphrase)
        case "decrypt":
            catalog.unseal(a.name, a.passphrase)
    return {"done": a.command}


def main() -> int:
    spark = SparkSession.builder.appName("docquery").getOrCreate()
    try:
        print(json.dumps(run(spark, sys.argv[1:]), default=str, indent=1, ensure_ascii=False))
    except (QuerySyntaxError, ValueError, PermissionError) as error:
        print(error, file=sys.stderr)
        return 1
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
