"""Column types from names and sampled values, and columns of several files that mean the same."""

from __future__ import annotations

import difflib
import json
import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame

from docquery.functions.text import DATE_NAMES, PHONE_NAMES, canonical_key

SAMPLE = 300


@dataclass(frozen=True)
class Kind:
    """A semantic type: names that mean it, a fixed set of values, a pattern, and how it is stored."""

    storage: str
    names: frozenset[str] = frozenset()
    values: frozenset[str] = frozenset()
    pattern: str | None = None


def _names(text: str) -> frozenset[str]:
    return frozenset(text.split())


KINDS: dict[str, Kind] = {
    "KEYWORD": Kind(
        "KEYWORD",
        PHONE_NAMES
        | _names("aktif active category city country enabled flag gender handle hash id_number jenis jenis_kelamin keadaan kelamin kondisi kota login")
        | _names("kata_sandi nationality negara negara_asal nick nickname pass passwd password propinsi prov province provinsi pwd region sex state status")
        | _names("tipe town type uname user_name username wilayah"),
        _names("0 1 active aktif approved closed disabled enabled f female inactive l laki m male n no nonaktif open p pending perempuan pria rejected true false wanita y yes"),
    ),
    "TEXT": Kind(
        "TEXT",
        _names("addr address alamat alamat_lengkap alamat_rumah caption catatan coordinates customer_name description deskripsi domisili first_name firstname")
        | _names("full_name fullname jalan keterangan koordinat last_name lastname lat_lon location message nama nama_ayah nama_belakang nama_depan nama_ibu")
        | _names("nama_lengkap name notes street teks tempat_lahir text"),
    ),
    "DATE": Kind("DATE", DATE_NAMES, pattern=r"\d{4}[-/|.]\d{2}[-/|.]\d{2}|\d{8}|\d{2}[-/|.]\d{2}[-/|.]\d{4}"),
    "FLOAT": Kind(
        "FLOAT",
        _names("amount angka count discount diskon harga humidity jumlah kelembaban lat latitude lng lon longitude nilai no nomer nomor price qty quantity")
        | _names("score skor temp temperature total"),
        pattern=r"\d+(\.\d+)?",
    ),
    "BOOL": Kind("BOOL", values=_names("0 1 aktif false n no nonaktif true y yes")),
    "ARRAY": Kind("ARRAY", _names("array categories kategori labels tags")),
    "OBJECT": Kind("OBJECT"),
    "EMAIL": Kind("KEYWORD", _names("e_mail email email_address mail surel"), pattern=r"[\w.+\-]+@[\w\-]+\.[a-z]{2,}"),
    "PHONE": Kind("KEYWORD", PHONE_NAMES, pattern=r"[0+(][\d\s()\-]{6,15}"),
}
STORED = ("BOOL", "INT", "FLOAT", "DATE", "KEYWORD", "TEXT", "ARRAY", "OBJECT")
TRUTHS = _names("1 ada aktif enabled exists t true y yes 0 disabled f false inactive n no none nonaktif tidak")
DATES = re.compile(r"\d{4}([-/])\d{2}\1\d{2}|\d{2}[-/]\d{2}[-/]\d{4}|\d{8}|\d{12}|\d{14}|(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}.*)", re.S)


def value_type(samples: list[str | None]) -> str:
    """The storage type that the values alone suggest."""
    some = [s.strip() for s in samples if s and s.strip()][:200]
    if not some:
        return "KEYWORD"
    share = lambda test: sum(map(bool, map(test, some))) / len(some)
    if share(lambda s: s[0] == "[" and s[-1] == "]") >= 0.7:
        return "ARRAY"
    if share(lambda s: s[0] == "{" and s[-1] == "}") >= 0.7:
        return "OBJECT"
    if share(DATES.fullmatch) >= 0.8:
        return "DATE"
    if share(lambda s: s.lower() in TRUTHS) >= 0.8:
        return "BOOL"
    bare = [s.replace(",", "") for s in some]
    if not any(s.startswith(("0", "+")) for s in bare):  # leading zeros are codes, not numbers
        for kind, parse in (("INT", int), ("FLOAT", float)):
            try:
                for s in bare:
                    parse(s)
                return kind
            except ValueError:
                continue
    return "TEXT" if sum(len(s.split()) for s in some) / len(some) >= 2 else "KEYWORD"


def classify(name: str, samples: list[str | None]) -> tuple[str, float]:
    """(storage type, confidence) of a column: by its name, then by values, patterns and shape."""
    key = canonical_key(name)
    for kind in reversed(KINDS.values()):
        if key in kind.names:
            return kind.storage, 1.0
    for kind in KINDS.values():
        if any(n in key or key in n for n in kind.names):
            return kind.storage, 0.8
    some = [s.strip() for s in samples if s and s.strip()]
    if not some:
        return "KEYWORD", 0.0
    for kind in KINDS.values():
        if kind.values:
            first = some[:50]
            share = sum(s.lower() in kind.values for s in first) / len(first)
            if share >= 0.8:
                return kind.storage, round(share, 2)
    for kind in KINDS.values():
        if kind.pattern:
            first = some[:100]
            share = sum(bool(re.fullmatch(kind.pattern, s, re.I)) for s in first) / len(first)
            if share >= 0.7:
                return kind.storage, round(share, 2)
    return value_type(some), 0.5


def column_map(df: DataFrame, overrides: dict | None = None, rows: int = SAMPLE) -> dict[str, dict]:
    """column -> semantic_type, canonical_key, confidence, from the first rows; overrides as names or as full entries."""
    sampled = [r.asDict(recursive=True) for r in df.limit(rows).collect()]
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v, default=str)
    out = {}
    given = {canonical_key(k): v for k, v in (overrides or {}).items()}
    for f in df.schema.fields:
        kind, confidence = classify(f.name, [text(r[f.name]) for r in sampled])
        entry = {"semantic_type": kind, "canonical_key": canonical_key(f.name), "confidence": confidence}
        if (own := given.get(canonical_key(f.name))) is not None:
            entry |= {"confidence": 1.0} | (own if isinstance(own, dict) else {"semantic_type": str(own).upper()})
        out[f.name] = entry
    return out


def likeness(a: str, b: str) -> float:
    a, b = (canonical_key(x).replace("_", " ") for x in (a, b))
    if a == b:
        return 1.0
    return 0.85 if a in b or b in a else difflib.SequenceMatcher(None, a, b).ratio()


def link_columns(schemas: list[list[str]], least: float = 0.85) -> dict[str, list[tuple[int, str]]]:
    """unified name -> (file, column) of the columns that are the same or alike."""
    linked: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for i, names in enumerate(schemas):
        for name in names:
            key = canonical_key(name)
            if key not in linked:
                best = max(((likeness(name, k), k) for k in linked), default=(0.0, key))
                key = best[1] if best[0] >= least else key
            linked[key].append((i, name))
    return dict(linked)
