"""Scalar functions as column expressions: folding, dates, sets, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
_PLAIN = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"
MISSING = "_"


def lower(c: Column) -> Column:
    """ASCII letters only."""
    return F.translate(c, UPPER, LOWER)


def strip_accents(c: Column) -> Column:
    """Latin-1 letters only; AE ligatures become two letters."""
    return F.translate(F.replace(F.replace(c, F.lit("Æ"), F.lit("AE")), F.lit("æ"), F.lit("ae")), _ACCENTED, _PLAIN)


def folded(c: Column, lower_case: bool, accents: bool) -> Column:
    c = strip_accents(c) if accents else c
    return lower(c) if lower_case else c


def fold_text(text: str, lower_case: bool, accents: bool) -> str:
    if accents:
        text = text.replace("Æ", "AE").replace("æ", "ae").translate(str.maketrans(_ACCENTED, _PLAIN))
    return text.translate(str.maketrans(UPPER, LOWER)) if lower_case else text


def components(c: Column) -> Column:
    """The sorted set of a pipe-joined value's non-empty parts."""
    return F.array_sort(F.array_distinct(F.filter(F.split(c, r"\|"), lambda x: x != "")))


def present(c: Column) -> Column:
    """Neither null, empty nor the sign for a missing value."""
    return c.isNotNull() & (c != "") & (c != MISSING)


def n_values(c: Column, multivalue: bool) -> Column:
    return F.coalesce(F.size(components(c)), F.lit(0)) if multivalue else F.when(present(c), 1).otherwise(0)


def feature(c: Column, key: str) -> Column:
    """Value of a key in ``Key=Value|Key=Value``, the first one; the sign for a missing value without it."""
    hit = F.filter(F.split(c, r"\|"), lambda x: F.startswith(x, F.lit(key + "=")))
    return F.coalesce(F.substring(F.try_element_at(hit, F.lit(1)), len(key) + 2, 2**31 - 1), F.lit(MISSING))


_YEAR = r"^\s*([+-]?[0-9]{4})(?![0-9])"
_PARTS = r"^\s*([0-9]{4})([-/])([0-9]{2})\2([0-9]{2})(?![0-9])"


def year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, _YEAR, 1), F.lit("")).try_cast("long")


def century(c: Column) -> Column:
    y = year(c)
    return F.when(y > 0, F.floor((y - 1) / 100) + 1).cast("long")


def decade(c: Column) -> Column:
    y = year(c)
    return (F.signum(y) * F.floor(F.abs(y) / 10) * 10).cast("long")


def date(c: Column) -> Column:
    parts = [F.regexp_extract(c, _PARTS, k) for k in (1, 3, 4)]
    return F.when(parts[0] != "", F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd"))


def month(c: Column) -> Column:
    return F.month(date(c)).cast("long")


def day(c: Column) -> Column:
    return F.dayofmonth(date(c)).cast("long")


def week(c: Column) -> Column:
    """ISO week."""
    return F.weekofyear(date(c)).cast("long")


DATES = {"year": year, "century": century, "decade": decade, "month": month, "week": week, "day": day}
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number(c: Column) -> Column:
    """A decimal number, or null; only forms that all engines read alike."""
    return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))


_ROMAN = r"^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


def sort_number(c: Column) -> Column:
    """Value of an integer or Roman numeral for ordering, else null."""
    upper = F.translate(c, LOWER, UPPER)
    letters = F.split(upper, "")
    value = lambda x: F.when(x == "M", 1000).when(x == "D", 500).when(x == "C", 100).when(x == "L", 50).when(x == "X", 10).when(x == "V", 5).when(x == "I", 1).otherwise(0)
    total = F.aggregate(letters, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda a, x: F.struct((a["sum"] + value(x) - F.when(value(x) > a["last"], a["last"] * 2).otherwise(0)).alias("sum"), value(x).alias("last")), lambda a: a["sum"])
    return F.when(c.rlike(r"^[+-]?[0-9]{1,18}$"), c.try_cast("long")).when((c != "") & upper.rlike(_ROMAN), total.cast("long"))


def compare(left: Column, op: str, right) -> Column:
    return {"=": lambda: left == right, "!=": lambda: left != right, "<": lambda: left < right, ">": lambda: left > right, "<=": lambda: left <= right, ">=": lambda: left >= right}[op]()
