"""The query language: words, phrases, ranges, AND, OR, NOT and parentheses.

    or    := and (OR and)*
    and   := not ([AND] not)*
    not   := (NOT | -) primary | primary
    primary := ( or ) | term

``A NOT B`` means A without B. A query that only excludes is an error, as is one side of AND or OR that does.
A backslash takes the next character as it is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class QuerySyntaxError(SyntaxError):
    """The query string can't be read."""


@dataclass(frozen=True)
class Term:
    value: str
    field: str | None = None
    quoted: bool = False


@dataclass(frozen=True)
class Range:
    field: str
    op: str  # between > >= < <=
    low: str
    high: str | None = None


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


@dataclass(frozen=True)
class AndNot:
    left: Node
    right: Node


@dataclass(frozen=True)
class Not:
    child: Node


Node = Term | Range | And | Or | AndNot | Not

_BARE_RANGE = re.compile(r"(\w+)(>=|<=|>|<)(.+)", re.S)
_FIELD_RANGE = re.compile(r"(>=|<=|>|<)(.*)", re.S)
_BETWEEN = re.compile(r"\[\s*(.*?)\s+TO\s+(.*?)\s*\]", re.I | re.S)
_INDEX = re.compile(r"\[\d+\]")
ESCAPED = "\ue000"  # stands before a character that a backslash protects, until a term is made


def lex(query: str) -> list[str]:
    """Words and parentheses; quotes and [low TO high] keep white space inside a word."""
    out: list[str] = []
    i, n = 0, len(query)
    while i < n:
        c = query[i]
        if c.isspace():
            i += 1
        elif c in "()":
            out.append(c)
            i += 1
        elif c == "-" and i + 1 < n and not query[i + 1].isspace():
            out.append("NOT")
            i += 1
        else:
            word = []
            while i < n and not query[i].isspace() and query[i] not in "()":
                c = query[i]
                if c == "\\" and i + 1 < n:
                    word.append(ESCAPED + query[i + 1])
                    i += 2
                elif c in "\"'" and (c == '"' or not word or word[-1] in ":="):
                    to = query.find(c, i + 1)
                    to = n - 1 if to < 0 else to
                    word.append(query[i : to + 1])
                    i = to + 1
                elif c == "[" and not _INDEX.match(query, i):
                    to = query.find("]", i)
                    to = n - 1 if to < 0 else to
                    word.append(query[i : to + 1])
                    i = to + 1
                else:
                    word.append(c)
                    i += 1
            out.append("".join(word))
    return out


def _plain(text: str) -> str:
    """Without the marks of protected characters, but for ``*`` and ``%``, which the mark keeps from being wildcards."""
    return re.sub(f"{ESCAPED}(?![*%])", "", text)


def _unquoted(text: str) -> tuple[str, bool]:
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        return _plain(text[1:-1]), True
    return _plain(text.strip("\"'")), False


def term(word: str) -> Term | Range:
    """The leaf that a word stands for; the first ``:`` outside quotes ends the field."""
    colon = next((i for i, c in enumerate(word) if c == ":" and not word.startswith(ESCAPED, i - 1)), -1)
    if word[:1] in "\"'":
        colon = -1
    if colon > 0:
        field, rest = _plain(word[:colon]), word[colon + 1 :]
        if m := _BETWEEN.fullmatch(rest):
            return Range(field, "between", _unquoted(m[1])[0], _unquoted(m[2])[0])
        if (m := _FIELD_RANGE.fullmatch(rest)) and m[2]:
            return Range(field, m[1], _unquoted(m[2])[0])
        value, quoted = _unquoted(rest)
        return Term(value, field, quoted)
    if m := _BARE_RANGE.fullmatch(word):
        return Range(m[1], m[2], _unquoted(m[3])[0])
    value, quoted = _unquoted(word)
    return Term(value, None, quoted)


class _Reader:
    def __init__(self, words: list[str]):
        self.words, self.at = words, 0

    def peek(self) -> str | None:
        return self.words[self.at] if self.at < len(self.words) else None

    def keyword(self) -> str | None:
        word = self.peek()
        return word.upper() if word and word.upper() in ("AND", "OR", "NOT") else word if word in ("(", ")") else None

    def any_of(self) -> Node:
        node = self.all_of()
        while self.keyword() == "OR":
            self.at += 1
            node = Or(node, self.all_of())
        return node

    def all_of(self) -> Node:
        node = self.maybe_not()
        while (k := self.keyword()) not in ("OR", ")") and self.peek() is not None:
            if k == "AND":
                self.at += 1
            node = self.joined(node, self.maybe_not())
        return node

    @staticmethod
    def joined(left: Node, right: Node) -> Node:
        match left, right:
            case Not(), Not():
                raise QuerySyntaxError("a query can't only exclude")
            case _, Not(child):
                return AndNot(left, child)
            case Not(child), _:
                return AndNot(right, child)
        return And(left, right)

    def maybe_not(self) -> Node:
        if self.keyword() == "NOT":
            self.at += 1
            return Not(self.primary())
        return self.primary()

    def primary(self) -> Node:
        word, kind = self.peek(), self.keyword()
        if word is None:
            raise QuerySyntaxError("the query ends too early")
        self.at += 1
        if kind == "(":
            node = self.any_of()
            if self.peek() != ")":
                raise QuerySyntaxError("a parenthesis isn't closed")
            self.at += 1
            return node
        if kind:
            raise QuerySyntaxError(f"{word!r} isn't expected here")
        return term(word)


def parse(query: str | None) -> Node | None:
    """The query's tree; None for an empty query, which matches nothing."""
    words = lex(query or "")
    if not words:
        return None
    reader = _Reader(words)
    node = reader.any_of()
    if reader.peek() is not None:
        raise QuerySyntaxError(f"{reader.peek()!r} isn't expected here")
    return node


def validate(query: str) -> dict:
    """Whether a query can be read and run, and if not, why."""
    try:
        check(parse(query))
    except QuerySyntaxError as error:
        return {"valid": False, "error": str(error)}
    return {"valid": True, "error": None}


def check(node: Node | None) -> None:
    """Raise if some part of the tree only excludes."""
    match node:
        case Not():
            raise QuerySyntaxError("a query can't only exclude; put * before NOT")
        case And(a, b) | Or(a, b) | AndNot(a, b):
            check(a)
            check(b)
