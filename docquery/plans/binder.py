"""From a query's tree and a schema to a predicate.

Fields are looked up when the plan is made: columns by canonical key, structs by their fields, array elements by position or
any of them, and text that holds JSON by path. Everything stays inside built-in expressions, so Catalyst pushes down what
Parquet can test. Where a bound and the column's type allow, ranges compare typed columns directly; years become time ranges.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.functions.text import canonical_key, has_token, number
from docquery.plans.parser import ESCAPED, And, AndNot, Node, Not, Or, QuerySyntaxError, Range, Term, check, parse

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")
_AGES = ("age", "umur", "usia")
Leaf = Callable[[Column, T.DataType], Column]


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def day(text: str) -> dt.date | None:
    """The day of a bound like 20260131, 2026-01-31 or 31/01/2026; a year stands for its first day."""
    bare = re.sub(r"[-/|.]", "", text.strip()[:10])
    for pattern, order in ((r"(\d{4})(\d{2})(\d{2})", (1, 2, 3)), (r"(\d{2})(\d{2})(\d{4})", (3, 2, 1))):
        m = re.fullmatch(pattern, bare)
        if m:
            try:
                found = dt.date(*(int(m[i]) for i in order))
            except ValueError:
                continue
            if 1900 <= found.year <= 2100:
                return found
    return dt.date(int(bare), 1, 1) if re.fullmatch(r"(?:19|20)\d\d", bare) else None


def _float(text: str) -> float | None:
    try:
        return float(text.replace(",", ""))
    except ValueError:
        return None


@dataclass
class Binder:
    """Binds trees to the columns of ``df``.

    compat: terms that match no document at all are tried anew on fields whose names start alike, then on any field, then as
    part of a value, each by one probe when the plan is made. precision: ``year`` compares years of dates, ``day`` days.
    dates: names of text columns that hold dates. today: for ages.
    """

    df: DataFrame
    compat: bool = False
    precision: str = "year"
    dates: frozenset[str] = frozenset()
    today: dt.date = field(default_factory=dt.date.today)
    hidden: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.fields = {canonical_key(f.name): f for f in self.df.schema.fields}

    def predicate(self, query: str | Node | None) -> Column:
        node = parse(query) if isinstance(query, str) or query is None else query
        if node is None:
            return F.lit(False)
        check(node)
        return self._bind(node)

    def _bind(self, node: Node) -> Column:
        match node:
            case And(a, b):
                return self._bind(a) & self._bind(b)
            case Or(a, b):
                return self._bind(a) | self._bind(b)
            case AndNot(a, b):
                return self._bind(a) & ~F.coalesce(self._bind(b), F.lit(False))
            case Term():
                return self.term(node)
            case Range():
                return self.range(node)
            case Not():
                raise QuerySyntaxError("a query can't only exclude")
        raise TypeError(node)

    # fields

    def columns(self) -> list[T.StructField]:
        return [f for f in self.df.schema.fields if f.name not in self.hidden]

    def steps(self, path: str) -> tuple[T.StructField, list[str | int]] | None:
        """The column that a path starts with, and the rest of the path."""
        if canonical_key(path) in self.fields:
            return self.fields[canonical_key(path)], []
        found = [int(m[2]) if m[2] else m[1] for m in _STEP.finditer(path)]
        for n in range(len(found), 0, -1):  # names may themselves have dots
            if all(isinstance(s, str) for s in found[:n]) and (f := self.fields.get(canonical_key(".".join(found[:n])))):
                return f, found[n:]
        return None

    def at(self, path: str, leaf: Leaf) -> Column:
        """``leaf`` of the value at a path: of any element of an array, of any field of a struct; false where there is none."""
        got = self.steps(path)
        if got is None:
            return F.lit(False)
        f, rest = got
        return self._walk(F.col(f"`{f.name}`"), f.dataType, rest, leaf)

    def _walk(self, c: Column, kind: T.DataType, rest: list[str | int], leaf: Leaf) -> Column:
        if isinstance(kind, T.ArrayType):
            if rest and isinstance(rest[0], int):
                return self._walk(F.get(c, F.lit(rest[0])), kind.elementType, rest[1:], leaf)
            return F.exists(c, lambda x: F.coalesce(self._walk(x, kind.elementType, rest, leaf), F.lit(False)))
        if isinstance(kind, T.StructType):
            if not rest:
                return any_of([self._walk(c[f.name], f.dataType, [], leaf) for f in kind.fields])
            for f in kind.fields:
                if isinstance(rest[0], str) and canonical_key(f.name) == canonical_key(rest[0]):
                    return self._walk(c[f.name], f.dataType, rest[1:], leaf)
            return F.lit(False)
        if isinstance(kind, T.MapType) and rest and isinstance(rest[0], str):
            return self._walk(F.try_element_at(c, F.lit(rest[0])), kind.valueType, rest[1:], leaf)
        if rest:
            if not isinstance(kind, T.StringType):
                return F.lit(False)
            path = "$" + "".join(f"[{s}]" if isinstance(s, int) else f".{s}" for s in rest)
            got = F.get_json_object(c, path)
            each = F.exists(F.from_json(got, "array<string>"), lambda x: F.coalesce(leaf(x, T.StringType()), F.lit(False)))
            return F.when(F.startswith(got, F.lit("[")), each | leaf(got, T.StringType())).otherwise(leaf(got, T.StringType()))
        return leaf(c, kind)

    # terms

    def term(self, t: Term) -> Column:
        value = t.value.strip()
        hidden = _hidden(value)
        bare = _shown(hidden.strip("%* ")).lower()
        wild = "*" in hidden or "%" in hidden
        if not bare:
            return F.lit(wild)
        if wild:
            return self.wildcard(t.field, value)
        test = self.word(t.field, bare)
        return self._fallback(t, bare, test) if self.compat else test

    def word(self, path: str | None, word: str) -> Column:
        leaf = self._word_leaf(word)
        if path is not None:
            return self.at(path, leaf)
        return any_of([self._walk(F.col(f"`{f.name}`"), f.dataType, [], leaf) for f in self.columns()])

    def _word_leaf(self, word: str) -> Leaf:
        value = _float(word)

        def leaf(c: Column, kind: T.DataType) -> Column:
            if isinstance(kind, _WHOLE) and not self.compat:
                return c == F.lit(int(value)) if value is not None and value == int(value) and abs(value) < 2**63 else F.lit(False)
            if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)) and not self.compat:
                return c == F.lit(value).cast(kind) if value is not None else F.lit(False)
            if isinstance(kind, T.BooleanType):
                return c == F.lit(word == "true") if word in ("true", "false") else F.lit(False)
            return has_token(c if isinstance(kind, T.StringType) else c.cast("string"), word)

        return leaf

    def _some(self, test: Column) -> bool:
        return not self.df.where(test).limit(1).isEmpty()

    def _fallback(self, t: Term, bare: str, test: Column) -> Column:
        if self._some(test):
            return test
        if t.field is not None and " " not in bare:
            key = canonical_key(t.field)
            alike = [f for f in self.columns() if canonical_key(f.name).startswith(key) and canonical_key(f.name) != key]
            test = any_of([self._walk(F.col(f"`{f.name}`"), f.dataType, [], self._word_leaf(bare)) for f in alike])
            if alike and self._some(test):
                return test
        if t.field is not None:
            test = self.word(None, bare)
            if self._some(test):
                return test
        return self.wildcard(t.field, f"*{bare}*") if not t.quoted and len(bare) >= 2 else F.lit(False)

    def wildcard(self, path: str | None, pattern: str) -> Column:
        def leaf(c: Column, kind: T.DataType) -> Column:
            return wild_match(c if isinstance(kind, T.StringType) else c.cast("string"), pattern)

        if path is not None:
            return self.at(path, leaf)
        return any_of([wild_match(F.col(f"`{f.name}`"), pattern) for f in self.columns() if isinstance(f.dataType, T.StringType)])

    # ranges

    def range(self, r: Range) -> Column:
        got = self.steps(r.field)
        if got is None and canonical_key(r.field) in _AGES:
            return self._age(r)
        return self.at(r.field, lambda c, kind: self._compare(c, kind, r, got[0].name if got else r.field))

    def _compare(self, c: Column, kind: T.DataType, r: Range, name: str) -> Column:
        days = day(r.low), day(r.high) if r.high is not None else None
        dated = days[0] is not None and (r.high is None or days[1] is not None)
        if isinstance(kind, _TIMES):
            return self._time(c, kind, r, *days) if dated else F.lit(False)
        if isinstance(kind, T.BooleanType):
            return F.lit(False)
        low, high = _float(r.low), _float(r.high) if r.high is not None else None
        if isinstance(kind, _NUMBERS):
            return _between(c, r.op, low, high)
        whole_day = re.fullmatch(r"\d{8}|\d{4}[-/|.]\d{2}[-/|.]\d{2}|\d{2}[-/|.]\d{2}[-/|.]\d{4}", r.low.strip())
        if dated and (whole_day or canonical_key(name) in self.dates):
            return self._text_date(c, r, *days)
        return _between(number(c), r.op, low, high)

    def _bounds(self, r: Range, low: dt.date, high: dt.date | None) -> tuple[dt.date | None, dt.date | None]:
        """The first day that is in, and the first that no longer is."""
        year = self.precision == "year"
        start = (lambda d: dt.date(d.year, 1, 1)) if year else (lambda d: d)
        after = (lambda d: dt.date(d.year + 1, 1, 1)) if year else (lambda d: d + dt.timedelta(days=1))
        match r.op:
            case "between":
                return start(low), after(high)
            case ">":
                return after(low), None
            case ">=":
                return start(low), None
            case "<":
                return None, start(low)
        return None, after(low)

    def _time(self, c: Column, kind: T.DataType, r: Range, low: dt.date, high: dt.date | None) -> Column:
        first, last = self._bounds(r, low, high)
        tests = [test(F.lit(d.isoformat()).cast(kind)) for d, test in ((first, lambda x: c >= x), (last, lambda x: c < x)) if d]
        return reduce(lambda a, b: a & b, tests)

    def _text_date(self, c: Column, r: Range, low: dt.date, high: dt.date | None) -> Column:
        """Text in YYYYMMDD order compares like its dates."""
        first, last = self._bounds(r, low, high)
        plain = F.regexp_replace(c, r"^\s*(\d{2})[-/|.](\d{2})[-/|.](\d{4})", "$3$2$1")
        digits = F.regexp_extract(plain, r"^\s*(\d{4}[-/|.]?\d{2}[-/|.]?\d{2})", 1)
        number_of = F.regexp_replace(digits, "[-/|.]", "").try_cast("int")
        tests = [test(int(d.strftime("%Y%m%d"))) for d, test in ((first, lambda x: number_of >= x), (last, lambda x: number_of < x)) if d]
        return reduce(lambda a, b: a & b, tests)

    def _age(self, r: Range) -> Column:
        """Ages from years of birth: who is ``n`` was born n years before this one."""
        birth = next((f.name for k, f in self.fields.items() if k in ("birthday", "dob", "birth_date", "birthdate", "date_of_birth")), None)
        low, high = _float(r.low), _float(r.high) if r.high is not None else None
        if birth is None or low is None or (r.high is not None and high is None):
            return F.lit(False)
        flip = {">": "<", ">=": "<=", "<": ">", "<=": ">="}
        year = lambda age: f"{self.today.year - int(age):04d}"
        turned = Range(birth, "between", year(high), year(low)) if r.op == "between" else Range(birth, flip[r.op], year(low))
        old, old_dates = self.precision, self.dates
        self.precision, self.dates = "year", self.dates | {canonical_key(birth)}
        try:
            return self.range(turned)
        finally:
            self.precision, self.dates = old, old_dates


def _between(c: Column, op: str, low: float | None, high: float | None) -> Column:
    if low is None or (op == "between" and high is None):
        return F.lit(False)
    match op:
        case "between":
            return (c >= low) & (c <= high)
        case ">":
            return c > low
        case ">=":
            return c >= low
        case "<":
            return c < low
    return c <= low


_MARKS = {ESCAPED + "*": "\ue001", ESCAPED + "%": "\ue002"}


def _hidden(text: str) -> str:
    """Protected wildcards as signs of their own."""
    for mark, sign in _MARKS.items():
        text = text.replace(mark, sign)
    return text


def _shown(text: str) -> str:
    for mark, sign in _MARKS.items():
        text = text.replace(sign, mark[1])
    return text


def wild_match(c: Column, pattern: str) -> Column:
    """Case aside; ``*`` and ``%`` stand for anything on one line, and the rest is anchored to the whole value."""
    parts = [_shown(p) for p in re.split(r"[*%]+", _hidden(pattern.strip()).lower())]
    low, some = F.lower(c), [p for p in parts if p]
    if len(some) == 1:
        if not parts[0] and not parts[-1]:
            return F.contains(low, F.lit(some[0]))
        if parts[0]:
            return F.startswith(low, F.lit(some[0])) if len(parts) > 1 else low == some[0]
        return F.endswith(low, F.lit(some[0]))
    # no wildcard at either end of the pattern: it would only make the search start over at every character
    body = ".*".join("".join(f"\\{ch}" if re.match(r"[^\w\s]", ch) else ch for ch in p) for p in some)
    match = F.rlike(low, F.lit(("^" if parts[0] else "") + body + ("$" if parts[-1] else "")))
    return reduce(lambda a, b: a & b, [F.contains(low, F.lit(p)) for p in some]) & match
