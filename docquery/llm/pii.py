"""Personal data by weak supervision.

Labelers (format, gazetteer, context, check digits, structure) vote on every candidate span. Expectation-maximisation over
the counts of vote patterns of all candidates estimates how far each labeler is to be trusted for each kind. A logistic span
classifier is then trained on that posterior; besides the votes it sees the span itself (length, share of digits, character
classes, what stands before and after it), so that it can outvote the labelers. It is trained on counts of equal cases of all
candidates; the cases are a bounded number (3 votes of 5 labelers, 768 shapes, 7 kinds), however large the input is, so
only they reach the driver.

Candidates are wide: whatever has the form of a kind, of any length. Each kind has a character without which its form is
impossible (``@``, a digit, ``=`` or ``:``, a key's own prefix), and only texts without that character are passed over. Finding
them takes time in proportion to the text. Contexts are the 32 characters before a span and the 16 after it: labelers and
classifier see no more than these, whatever the length of the span.

In the estimation, a labeler that checks validity (``SURE``) may vote against a true span in at most a share ``SLIP`` of the
cases, typing errors; this is a prior, without which a kind whose candidates all look alike has no anchor.

Defined results: a null or empty text has no spans; a text is searched whole, however long; repeated rows give their
spans once for each row; a null doc_id is kept as null; an empty table gives no spans; other columns are ignored by
``pii_spans`` and passed through by ``redact``, whatever their names. ``start`` and ``end`` count characters from 0, ``end``
exclusive. Where two spans overlap, the longer one wins, then the earlier kind in ``KINDS``, then the earlier start.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.llm.common import fresh, lean, materialise

KINDS = ("secret", "email", "iban", "card", "ip", "ssn", "phone")
LABELERS = ("format", "gazetteer", "context", "check", "structure")
DIGIT = re.compile(r"\d")
#: Kinds of which every candidate has a digit, by form.
FORMS = {
    "iban": re.compile(r"(?<!\w)([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"),
    "card": re.compile(r"(?<![\w.+-])(\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{4}|\d{4}([ -])\d{6}\3\d{5})(?!-?\w)"),
    "ip": re.compile(r"(?<![\w.])(\d{1,3}(?:\.\d{1,3}){3})(?!\.?\w)"),
    "ssn": re.compile(r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])"),
    "phone": re.compile(r"(?<![\w.])((?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4})(?!\w|\.\d)"),
}
TLDS = frozenset("com org net edu gov mil int info biz io dev ai app co de fr es it nl uk us ca au jp cn in br ru ch at be se no dk fi pl pt eu me tv id mx ar".split())
BINS = re.compile(r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|6(?:011|4[4-9]|5)|35(?:2[89]|[3-8])|3(?:0[0-5]|[68])|62")
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 355 356 357 358 359 370 371 372 380 385 386 420 421".split())
IBAN_LENGTH = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "BE": 16, "CH": 21, "AT": 20, "PL": 28, "PT": 25, "SE": 24, "DK": 18, "NO": 15, "FI": 18, "IE": 22, "LU": 20}
FOR = {
    "secret": re.compile(r"(?i)token|secret|passw|key|credential|auth"),
    "email": re.compile(r"(?i)e-?mail|contact|write|correo|courriel|reach|send"),
    "iban": re.compile(r"(?i)iban|bank|account|konto|cuenta|compte"),
    "card": re.compile(r"(?i)card|visa|master|amex|credit|debit|karte|tarjeta|carte|payment|\bpan\b"),
    "ip": re.compile(r"(?i)\bip\b|address|host|server|client|login|from"),
    "ssn": re.compile(r"(?i)ssn|social|security"),
    "phone": re.compile(r"(?i)phone|tel|call|mobile|cell|fax|whatsapp|anruf|ruf"),
}
AGAINST = {
    "ip": re.compile(r"(?i)version|\bv\.?$|release|section|build|chapter"),
    "card": re.compile(r"(?i)order|invoice|isbn|tracking|serial|reference|\bid\b|part no"),
    "phone": re.compile(r"(?i)order|invoice|isbn|serial|reference|part no"),
    "ssn": re.compile(r"(?i)order|invoice|serial|reference|part no"),
    "secret": re.compile(r"(?i)placeholder|dummy"),
}


KEYWORD = re.compile(r"(?i)token|secret|passw(?:or)?d|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|credential")
VALUE = re.compile(r"\s*[\"']?([^\s\"',;]{8,})")
#: Keys that show what they are by a prefix of their own, with no word before them.
PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "k_live_", "k_test_", "AIza", "eyJ")
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----")
PEM_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY-----")
PEM_BODY = re.compile(r"(?:\s*[A-Za-z0-9+/=]{16,})*(?:\s*[A-Za-z0-9+/]*=)?")
DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)+")
NOT_LOCAL = re.compile(r"[^\w.+-]")
NOT_NAME = re.compile(r"[^\w-]")
KNOWN_SSN = frozenset("078-05-1120 219-09-9999 457-55-5462 123-45-6789 987-65-4321 111-11-1111 222-22-2222 333-33-3333 444-44-4444 555-55-5555".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _vote(yes: bool, no: bool) -> int:
    return 1 if yes else -1 if no else 0


def votes(kind: str, span: str, before: str, after: str) -> tuple[int, ...]:
    """One vote of each labeler: 1 for, -1 against, 0 abstains."""
    digits = re.sub(r"\D", "", span)
    against = kind in AGAINST and bool(AGAINST[kind].search(before))
    context = _vote(bool(FOR[kind].search(before) or FOR[kind].search(after)) and not against, against)
    if kind == "email":
        local, _, domain = span.partition("@")
        tld = domain.rpartition(".")[2].lower()
        return (_vote(bool(re.fullmatch(r"[A-Za-z]{2,24}", tld)), True), _vote(tld in TLDS, False), context, _vote(False, ".." in span or local.endswith(".") or len(local) > 64), _vote(bool(re.search(r"[^\W_]", local)), True))
    if kind == "phone":
        plus = span.startswith("+")
        code = any(re.sub(r"\D", " ", span).split()[0].startswith(c) for c in CALLING) if plus else False
        return (_vote(plus or "(" in span, False), _vote(code, plus and not code), context, _vote(10 <= len(digits) <= 15, True), _vote(len(set(digits)) > 2, True))
    if kind == "ip":
        parts = span.split(".")
        plain = all(x == "0" or x[0] != "0" for x in parts)
        special = int(parts[0]) in (0, 127, 255) or span in ("1.1.1.1", "1.2.3.4")
        return (_vote(plain, True), _vote(not special, True), context, _vote(all(int(x) <= 255 for x in parts), True), _vote(max(map(len, parts)) > 1, True))
    if kind == "card":
        grouped = re.fullmatch(r"\d{13,19}|(?:\d{4}[ -]){3}\d{4}|\d{4}[ -]\d{6}[ -]\d{5}", span)
        return (_vote(bool(grouped), True), _vote(bool(BINS.match(digits)), True), context, _vote(luhn(digits), True), _vote(len(set(digits)) > 2, True))
    if kind == "secret":
        known = bool(PREFIXED.match(span) or PEM.match(span))
        named = bool(re.search(r"(?i)(?:token|secret|key|passw(?:or)?d|passphrase)[\"']?\s*[=:]\s*[\"']?$", before))
        kinds = sum(bool(re.search(p, span)) for p in ("[a-z]", "[A-Z]", r"\d", r"[^\w\s]"))
        return (_vote(known or bool(re.fullmatch(r"[A-Za-z0-9+/_=.-]{16,}", span)), len(span) < 12), _vote(known or named, False), context, _vote(_entropy(span) >= 3, _entropy(span) < 2.5), _vote(known or kinds > 1 and bool(re.search(r"\d|[^\w\s]", span)), kinds < 2))
    if kind == "ssn":
        good = span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000"
        alone = not re.search(r"\d\s*$", before) and not re.match(r"\s*\d", after)
        return (_vote(alone, True), _vote(int(span[:3]) <= 772 and span not in KNOWN_SSN, span in KNOWN_SSN), context, _vote(good, True), _vote(len(set(digits)) > 2, True))
    bare = span.replace(" ", "")
    moved = "".join(str(int(ch, 36)) for ch in bare[4:] + bare[:4])
    length = IBAN_LENGTH.get(bare[:2])
    fours = " " not in span or bool(re.fullmatch(r"(?:\w{4} )+\w{1,4}", span))
    return (_vote(fours, True), _vote(length == len(bare), length is not None), context, _vote(int(moved) % 97 == 1, True), _vote(15 <= len(bare) <= 34, True))


#: How many values each part of a shape has: length, share of digits, letters, other characters, before, after.
SHAPE = (4, 4, 3, 2, 4, 2)


def shape(span: str, before: str, after: str) -> int:
    """What the classifier sees of a span besides the votes, as one number."""
    n, digits = len(span), sum(c.isdigit() for c in span)
    letters = 2 if re.search("[a-z]", span) and re.search("[A-Z]", span) else 1 if any(map(str.isalpha, span)) else 0
    last = before.rstrip(" \t\"'")[-1:]
    lead = 0 if not last or last in "\r\n" else 1 if last in ":=" else 2 if last.isalpha() else 3
    parts = (0 if n < 12 else 1 if n < 17 else 2 if n < 33 else 3, min(3, 4 * digits // max(n, 1)), letters, int(any(not c.isalnum() for c in span)), lead, int(bool(after[:1].isalnum())))
    out = 0
    for value, size in zip(parts, SHAPE):
        out = out * size + value
    return out


def _shape_parts(shapes: np.ndarray) -> list[np.ndarray]:
    out, rest = [], shapes.astype(np.int64)
    for size in reversed(SHAPE):
        out.append(rest % size)
        rest = rest // size
    return out[::-1]


def _emails(text: str) -> list[tuple[int, int]]:
    """From each ``@`` to both sides; between two of them each character is looked at a bounded number of times."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        local = NOT_LOCAL.split(text[last:at])[-1].lstrip(".")
        m = DOMAIN.match(text, at + 1) if local else None
        if m:
            found.append((at - len(local), m.end() - (len(m[0]) - len(m[0].rstrip("-")))))
        last = at + 1
        at = text.find("@", last)
    return found


def _secrets(text: str) -> list[tuple[int, int]]:
    """Values that a word for a secret names before ``=`` or ``:``, keys of known prefixes, and private keys."""
    found, last, done = [], 0, 0
    for m in re.finditer("[=:]", text) if "=" in text or ":" in text else ():
        at = m.start()
        if at + 1 >= done:  # what an earlier one inside a value names is part of that value
            words = text[last:at].rstrip().rstrip("\"'").rsplit(None, 1)
            if words and KEYWORD.search(NOT_NAME.split(words[-1])[-1]):
                value = VALUE.match(text, at + 1)
                if value:
                    found.append(value.span(1))
                    done = value.end(1)
        last = at + 1
    if any(p in text for p in PREFIXES):
        found += [m.span() for m in PREFIXED.finditer(text)]
    if "-----BEGIN" in text:
        ends = [m.end() for m in PEM_END.finditer(text)]
        for m in PEM.finditer(text):
            i = bisect_right(ends, m.end())
            if i < len(ends):
                found.append((m.start(), ends[i]))
            else:  # cut off: the lines of the key that are there
                found.append((m.start(), PEM_BODY.match(text, m.end()).end()))
    return sorted(set(found))


def places(text: str) -> list[tuple[str, int, int]]:
    """kind, start and end of every candidate in the whole text."""
    found = [("secret", a, b) for a, b in _secrets(text)]
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        found += [(kind, *m.span(1)) for kind, form in FORMS.items() for m in form.finditer(text)]
    return found


def candidates(text: str) -> list[tuple[str, int, int, tuple[int, ...], int]]:
    """Every candidate of every kind in the whole text, with its votes and shape."""
    out = []
    for kind, a, b in places(text):
        span, before, after = text[a:b], text[max(0, a - 32) : a], text[b : b + 16]
        out.append((kind, a, b, votes(kind, span, before, after), shape(span, before, after)))
    return out


def resolve(spans: list[tuple]) -> list[tuple]:
    """Of overlapping spans (kind, start, end, ...) the longest, then the first kind; the rest in order of start."""
    taken: list[tuple] = []
    for s in sorted(spans, key=lambda s: (s[1] - s[2], KINDS.index(s[0]), s[1])):
        if all(s[2] <= t[1] or t[2] <= s[1] for t in taken):
            taken.append(s)
    return sorted(taken, key=lambda s: s[1])


def _sweep(spans: list[tuple]) -> list[tuple]:
    """resolve() for each run of spans that overlap, so that a text of many spans takes linear time."""
    out, run, to = [], [], -1
    for s in sorted(spans, key=lambda s: (s[1], s[2])):
        if run and s[1] >= to:
            out += resolve(run) if len(run) > 1 else run
            run = []
        to = max(to, s[2]) if run else s[2]
        run.append(s)
    return out + (resolve(run) if len(run) > 1 else run)


#: Labelers whose vote against a kind is proof but for typing errors: true spans hardly ever get it.
SURE = {"card": ("check", "gazetteer"), "secret": (), **{k: ("check",) for k in KINDS if k not in ("card", "secret")}}
SLIP = 0.02


def reliabilities(patterns: np.ndarray, n: np.ndarray, sure: tuple[str, ...] = ("check",), rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for two classes: the posterior of each pattern, and P(vote | class) by labeler.

    It starts from the majority of the votes, and from doubt where one of ``sure`` votes against. Pseudo-counts keep every
    probability off 0 and 1; a true span gets the vote against of one of ``sure`` with a probability of ``SLIP`` at most.
    """
    proofs = [LABELERS.index(x) for x in sure]
    post = np.where((patterns[:, proofs] == -1).any(1) if proofs else False, 0.1, 1 / (1 + np.exp(-1.5 * patterns.sum(1))))
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    table = np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        weight = np.stack([(1 - post) * n, post * n])
        table = np.einsum("cp,plv->clv", weight, onehot) + np.array([[0.5, 0.5, 0.1], [0.1, 0.5, 0.5]])[:, None, :]
        table /= table.sum(2, keepdims=True)
        for i in proofs:
            excess = max(0.0, table[1, i, 0] - SLIP)
            table[1, i] *= np.array([1.0, 1.0, 1.0]) + np.array([0.0, 1.0, 1.0]) * excess / (1 - table[1, i, 0])
            table[1, i, 0] -= excess
        prior = (weight.sum(1) + [0.5, 0.5]) / (n.sum() + 1)
        like = np.log(prior)[:, None] + np.einsum("clv,plv->cp", np.log(table), onehot)
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
        settled = np.abs(new - post).max() < 1e-9
        post = new
        if settled:
            break
    return post, table


def _features(votes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Intercept; for each labeler whether it votes for and whether against; for each part of the shape which value it has."""
    parts = [(part[:, None] == np.arange(1, size)).astype(float) for part, size in zip(_shape_parts(shapes), SHAPE)]
    return np.hstack([np.ones((len(votes), 1)), votes == 1, votes == -1, *parts]).astype(float)


def fit(counts: pd.DataFrame, penalty: float = 0.02, steps: int = 50) -> dict[str, list[float]]:
    """Weights of the span classifier by kind, from the counts of cases (kind, v0..v4, shape, n)."""
    model, names = {}, [f"v{i}" for i in range(len(LABELERS))]
    for kind, part in counts.sort_values(["kind", *names, "shape"]).groupby("kind"):
        cases, n = part[names].to_numpy(), part["n"].to_numpy(float)
        patterns, of = np.unique(cases, axis=0, return_inverse=True)
        post = reliabilities(patterns, np.bincount(of.ravel(), weights=n), SURE[kind])[0][of.ravel()]
        x = _features(cases, part["shape"].to_numpy())
        w, ridge = np.zeros(x.shape[1]), penalty * n.sum() ** 0.5
        for _ in range(steps):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (n * (p - post)) + ridge * w
            hess = (x * (n * p * (1 - p))[:, None]).T @ x + (ridge + 1e-6) * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= step * min(1, 5 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        model[kind] = w.tolist()
    return model


def score(model: dict[str, list[float]], kind: str, v: tuple[int, ...], form: int) -> float:
    """The classifier's probability that a candidate is personal data."""
    w = model.get(kind)
    if w is None:
        return 0.0
    z = w[0] + sum(w[1 + i] for i, x in enumerate(v) if x == 1) + sum(w[1 + len(v) + i] for i, x in enumerate(v) if x == -1)
    at, parts = 1 + 2 * len(v), []
    for size in reversed(SHAPE):
        parts.append(form % size)
        form //= size
    for value, size in zip(reversed(parts), SHAPE):
        z += w[at + value - 1] if value else 0.0
        at += size - 1
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


VOTES = [f"v{i}" for i in range(len(LABELERS))]
SPANS = f"array<struct<kind:string,start:int,end:int,{','.join(f'{v}:tinyint' for v in VOTES)},shape:int>>"


def with_candidates(docs: DataFrame, name: str, *columns: str) -> DataFrame:
    """The columns named and, as ``name``, the candidates of each row's text (empty for null)."""

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [(k, a, b, *v, f) for k, a, b, v, f in candidates(t)] if t else [])

    lean(docs.sparkSession)
    return docs.select(*(F.col(f"`{c}`") for c in columns), find("text").alias(name))


def train(found: DataFrame, name: str) -> dict[str, list[float]]:
    """The classifier, from all candidates in the column ``name``."""
    return fit(found.select(F.inline(name)).groupBy("kind", *VOTES, "shape").agg(F.count(F.lit(1)).alias("n")).toPandas())


def _settled(model: dict[str, list[float]], spans: list[dict], threshold: float) -> list[tuple]:
    scored = [(s["kind"], s["start"], s["end"], round(score(model, s["kind"], tuple(s[v] for v in VOTES), s["shape"]), 6)) for s in spans]
    return _sweep([s for s in scored if s[3] >= threshold])


def pii_spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every span of personal data: doc_id, kind, start, end, span, score."""
    found = with_candidates(docs, "spans", "doc_id", "text").where(F.size("spans") > 0)
    found = materialise(found)  # only texts with a candidate
    model = train(found, "spans")

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,span:string,score:double>>")
    def settle(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([[(k, a, b, t[a:b], p) for k, a, b, p in _settled(model, row, threshold)] for t, row in zip(texts, spans)])

    return found.select("doc_id", settle("text", "spans").alias("spans")).select("doc_id", F.inline("spans"))


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with each span replaced by its kind in brackets, as ``[EMAIL]``; n_chars is set to the new length where the text changed.

    Each document is written once with its candidates; when the classifier is trained on all of them, each row's own decide.
    """
    spans, new = fresh(docs, "spans", "cleaned")
    found = materialise(with_candidates(docs, spans, *docs.columns))
    model = train(found, spans)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t: str | None, row: list[dict] | None) -> str | None:
            if t is None:
                return None
            out, at = [], 0
            for kind, a, b, _ in _settled(model, row, threshold):
                out += [t[at:a], f"[{kind.upper()}]"]
                at = b
            return "".join(out) + t[at:] if out else None

        return pd.Series([one(t, row) for t, row in zip(texts, spans)], dtype=object)

    some = F.size(spans) > 0
    out = found.withColumn(new, cleaned(F.when(some, F.col("text")), F.when(some, F.col(spans))))
    changed = F.col(new).isNotNull()
    columns = {"text": F.when(changed, F.col(new)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(columns).select(*(F.col(f"`{c}`") for c in docs.columns))
