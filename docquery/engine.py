"""The facade: queries, pages, counts, facets, joins and lookups over one dataset or several."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.operators import aggregate as agg
from docquery.operators import dedup, joins, search
from docquery.plans import parser
from docquery.plans.binder import Binder


@dataclass
class Page:
    """A page of hits and how many there are in all."""

    total: int
    hits: DataFrame
    page: int
    page_size: int

    def rows(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.hits.collect()]


class Engine:
    """Queries over a DataFrame, or over several that are named; ``id_column`` gives ids and order."""

    def __init__(self, data: DataFrame | dict[str, DataFrame], id_column: str = "_id", compat: bool = False, precision: str = "year", dates: list[str] | None = None, today: dt.date | None = None):
        self.df = search.union_of(data) if isinstance(data, dict) else data
        self.id_column, self.compat, self.place = id_column, compat, None
        self.options = {"precision": precision, "dates": frozenset(dates or ()), "hidden": frozenset({"_id", "_index"})}
        if today:
            self.options["today"] = today

    @classmethod
    def open(cls, spark: SparkSession, path: str, passphrase: str | None = None, **options) -> Engine:
        """A dataset that ``sources.catalog`` keeps, or a folder of several."""
        from docquery.sources.catalog import Catalog

        out = cls(Catalog.load(spark, path, passphrase), **({"compat": True} | options))
        out.place = spark, path, passphrase
        return out

    def set_key(self, passphrase: str) -> None:
        """Open the dataset anew with its passphrase."""
        self._reopen(passphrase)

    def reload_stats(self) -> None:
        """Take in rows and columns that were added since."""
        self._reopen(self.place[2] if self.place else None)

    def _reopen(self, passphrase: str | None) -> None:
        from docquery.sources.catalog import Catalog

        if self.place is None:
            raise ValueError("only an engine that was opened at a path can be opened anew")
        spark, path, _ = self.place
        data = Catalog.load(spark, path, passphrase)
        self.df = search.union_of(data) if isinstance(data, dict) else data
        self.place = spark, path, passphrase

    def predicate(self, query: str | parser.Node | None) -> Column:
        return Binder(self.df, compat=self.compat, **self.options).predicate(query)

    def match(self, query: str | None) -> DataFrame:
        """All documents that match, unordered: the plan to build on."""
        return self.df.where(self.predicate(query))

    def query(self, query: str, page: int = 0, page_size: int = 20) -> Page:
        found = self.match(query)
        return Page(found.count(), search.page(found, page, page_size, self.id_column), page, page_size)

    def search(self, term: str, column: str | None = None, page: int = 0, page_size: int = 20) -> Page:
        """One term, with wildcards or without, in one column or any."""
        return self._page(self.df.where(self._term(term, column)), page, page_size)

    def _term(self, term: str, column: str | None) -> Column:
        value, quoted = (term[1:-1], True) if len(term) > 1 and term[0] == term[-1] == '"' else (term, False)
        return self.predicate(parser.Term(value, column, quoted))

    def _page(self, found: DataFrame, page: int, page_size: int) -> Page:
        return Page(found.count(), search.page(found, page, page_size, self.id_column), page, page_size)

    def search_and(self, conditions: list[tuple[str | None, str]], page: int = 0, page_size: int = 20) -> Page:
        """A page of the documents that meet every (column, term)."""
        return self._page(self.match_and(conditions), page, page_size)

    def match_and(self, conditions: list[tuple[str | None, str]]) -> DataFrame:
        """All documents that meet every (column, term); none without conditions."""
        test = F.lit(bool(conditions))
        for column, term in conditions:
            test = test & self._term(term, column)
        return self.df.where(test)

    def multi_search(self, queries: list[str], page_size: int = 10) -> list[Page]:
        return [self.query(q, 0, page_size) for q in queries]

    def count(self, query: str = "*") -> int:
        return self.match(query).count()

    def get(self, doc_id: object) -> dict | None:
        row = self.df.where(F.col(self.id_column) == F.lit(doc_id)).limit(1).first()
        return row.asDict(recursive=True) if row else None

    def aggregate(self, query: str | None, aggs: dict, size: int = 10) -> dict:
        """Facets and statistics of the matching documents (of all without a query), by request name."""
        found = self.match(query) if query else self.df
        if len(agg.requests(aggs)) < 2:
            return {"hits": {"total": found.count()}, "aggregations": agg.aggregate(found, aggs, size)}
        steps = [Binder(self.df).steps(options["field"]) for _, options in agg.requests(aggs).values()]
        names = dict.fromkeys(step[0].name for step in steps if step) or {self.df.columns[0]: None}
        found = found.select(*(F.col(f"`{c}`") for c in names)).persist()  # the fields asked for, read and filtered once
        try:
            return {"hits": {"total": found.count()}, "aggregations": agg.aggregate(found, aggs, size)}
        finally:
            found.unpersist()

    def join(self, query_a: str, query_b: str, on: str) -> DataFrame:
        return joins.join(self.match(query_a), self.match(query_b), on)

    def cross_lookup(self, query: str, target: Engine, link: str, target_field: str | None = None, **options) -> DataFrame:
        return joins.cross_lookup(self.match(query), target.df, link, target_field, id_column=self.id_column, **options)

    def deduplicate(self, fields: list[str] | None = None) -> DataFrame:
        return dedup.deduplicate(self.df, fields, self.id_column)

    def columns(self) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in self.df.schema.fields}

    def summary(self) -> dict:
        return {"total_docs": self.df.count(), "columns": self.columns()}

    @staticmethod
    def validate(query: str) -> dict:
        return parser.validate(query)
