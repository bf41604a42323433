"""What counts as a word of a value, and the normal forms of values.

``field:word`` asks whether a word is among those of a value, not whether the value equals it. The words of a value are: the
whole value in lower case; what separators part; the two sides of the first ``@``; and, with four digits or more, all digits
joined, and the first and last 4, 6 and 8 of them. Words of one character don't count, but the whole value always does.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[\s_\-,./\\|]+"
DATE_NAMES = frozenset("birth birth_date birthdate birthday born created_at date date_of_birth dob join_date joined lahir register_date tanggal tanggal_daftar tanggal_lahir tgl_bergabung tgl_buat tgl_daftar tgl_lahir tgl_registrasi tgl_update updated_at".split())
PHONE_NAMES = frozenset("cell cellphone handphone hp mobile no_hp no_telp nohp nomor_hp nomor_telepon phone phone_number telephone telepon telp".split())


def canonical_key(name: str) -> str:
    return re.sub(r"[ -]", "_", name.strip().lower())


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def tokens(c: Column) -> Column:
    """All words of a value, as an array without doubles; null for null."""
    low = F.lower(F.trim(c))
    digits = _digits(c)
    ends = [F.when(F.length(digits) > n, side(digits, n)) for n in (4, 6, 8) for side in (lambda d, n: F.right(d, F.lit(n)), lambda d, n: F.left(d, F.lit(n)))]
    numbers = F.when(F.length(digits) >= 4, F.array(digits, *ends)).otherwise(F.array().cast("array<string>"))
    mail = F.when(F.contains(low, F.lit("@")), F.array(F.substring_index(low, "@", 1), F.substr(low, F.locate("@", low) + 1))).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(low), F.split(low, SEPARATORS), mail, numbers)
    return F.array_distinct(F.filter(every, lambda x: F.length(x) >= 2))


def has_token(c: Column, word: str) -> Column:
    """Whether ``word`` (lower case) is the whole value or one of its words.

    The arrays of ``tokens`` are never built: a search for the substring comes first, and only values that have it are
    matched further. Words of digits alone can span separators, so they have a branch of their own.
    """
    low = F.lower(F.trim(c))
    if not word:
        return F.lit(False)
    test = low == F.lit(word)
    if len(word) >= 2:
        inner = F.lit(False)
        if not re.search(SEPARATORS, word):
            inner = F.rlike(low, F.lit(rf"(?:^|{SEPARATORS[:-1]})\Q{word}\E(?:$|{SEPARATORS[:-1]})"))
        if "\\E" in word:
            inner = F.array_contains(F.split(low, SEPARATORS), word)
        sides = F.contains(low, F.lit("@")) & ((F.substring_index(low, "@", 1) == word) | (F.substr(low, F.locate("@", low) + 1) == word))
        test = F.contains(low, F.lit(word)) & (test | inner | sides)
    if re.fullmatch(r"[0-9]{4,}", word):
        digits, n = _digits(c), len(word)
        by_digits = digits == word
        if n in (4, 6, 8):
            by_digits = by_digits | ((F.length(digits) > n) & (F.startswith(digits, F.lit(word)) | F.endswith(digits, F.lit(word))))
        test = test | by_digits
    return test


def trigrams(c: Column) -> Column:
    low = F.lower(c)
    return F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substr(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def normal_date(c: Column) -> Column:
    """YYYYMMDD for dates written year first or day first; anything else without its spaces."""
    v = F.regexp_replace(F.trim(c), " ", "")
    out = F.regexp_replace(v, r"^(\d{4})[-/|.](\d{2})[-/|.](\d{2})$", "$1$2$3")
    return F.regexp_replace(out, r"^(\d{2})[-/|.](\d{2})[-/|.](\d{4})$", "$3$2$1")


def normal_phone(c: Column) -> Column:
    """Digits only; the country code 62 becomes a leading 0."""
    digits = _digits(c)
    return F.when(F.startswith(digits, F.lit("62")) & (F.length(digits) > 3), F.concat(F.lit("0"), F.substr(digits, F.lit(3)))).otherwise(digits)


def normal_value(c: Column, name: str) -> Column:
    """The normal form that a column's name asks for; blank values stay as they are."""
    key = canonical_key(name)
    if key in DATE_NAMES:
        return F.when(F.trim(c) == "", c).otherwise(normal_date(c))
    if key in PHONE_NAMES:
        return F.when(F.trim(c) == "", c).otherwise(normal_phone(c))
    return c


def number(c: Column) -> Column:
    """A double from text, commas aside; null where it is none."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double")
