"""The query language."""

import pytest

from docquery.plans.parser import And, AndNot, Not, Or, QuerySyntaxError, Range, Term, parse, validate

A, B, C = Term("a"), Term("b"), Term("c")


@pytest.mark.parametrize(
    "query, tree",
    [
        ("a", A),
        ("a b", And(A, B)),
        ("a AND b", And(A, B)),
        ("a and b", And(A, B)),
        ("a OR b c", Or(A, And(B, C))),
        ("(a OR b) c", And(Or(A, B), C)),
        ("a NOT b", AndNot(A, B)),
        ("a AND NOT b", AndNot(A, B)),
        ("NOT b a", AndNot(A, B)),
        ("a -b", AndNot(A, B)),
        ("a - b", And(And(A, Term("-")), B)),
        ("a NOT (b OR c)", AndNot(A, Or(B, C))),
        ("NOT a", Not(A)),
        ("city:Jakarta", Term("Jakarta", "city")),
        ('name:"small ring"', Term("small ring", "name", True)),
        ('"small ring"', Term("small ring", None, True)),
        ("time:12:30", Term("12:30", "time")),
        ("x:[1 TO 5]", Range("x", "between", "1", "5")),
        ("x:[1 to 5]", Range("x", "between", "1", "5")),
        ("x:>=5", Range("x", ">=", "5")),
        ("x<5", Range("x", "<", "5")),
        ("a.b.c:<5", Range("a.b.c", "<", "5")),
        ("tags[0]:alpha", Term("alpha", "tags[0]")),
        ("items[0].name:x", Term("x", "items[0].name")),
        (r"a\:b", Term("a:b")),
        (r"f:a\ b", Term("a b", "f")),
        (r"\(a", Term("(a")),
        ("email:*@dev.io", Term("*@dev.io", "email")),
        ('f:""', Term("", "f", True)),
        ("", None),
        ("   ", None),
    ],
)
def test_trees(query, tree):
    assert parse(query) == tree


@pytest.mark.parametrize("query", ["(a", "a)", "AND", "a AND", "a OR", "OR a", "NOT", "NOT a AND NOT b", "()", "a AND AND b"])
def test_errors(query):
    with pytest.raises(QuerySyntaxError):
        parse(query)
    assert validate(query)["valid"] is False


def test_a_query_that_only_excludes_is_no_query():
    assert not validate("NOT a")["valid"] and not validate("NOT a OR b")["valid"]
    assert validate("* AND NOT a")["valid"] and validate("")["valid"]
