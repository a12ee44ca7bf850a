"""Normal forms of words and metadata, as built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their bare forms, one for one.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
BARE = "aaaaaaceeeeiiiinooooouuuuyy"
#: A word piece, in the alternation's order, and what lies between.
WORD_PIECE = r"[\p{L}\p{M}\p{N}]+|[&\p{L};]+"
PIECE = WORD_PIECE + r"|[^\p{L}\p{M}\p{N}&;]+"
#: Sorts behind every value that occurs.
MISSING = "ZZZZZ"
_TABLE = str.maketrans(ACCENTED, BARE)


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), ACCENTED, BARE)


def folded(text: str) -> str:
    """fold() of a driver-side string."""
    return text.lower().translate(_TABLE)


def indexed_form(c: Column) -> Column:
    """A word as it is indexed: lower case, without ``&``, ``;``, ``_`` and control characters."""
    return F.regexp_replace(F.lower(c), r"[&;_\p{C}]", "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def rewritten(c: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """A text after regular expressions and their replacements, one after another: what reports put out."""
    for pattern, new in rules:
        c = F.regexp_replace(c, pattern, new)
    return c


def leading_integer(c: Column) -> Column:
    """The signed integer that a value begins with, else null."""
    return F.regexp_extract(c, r"^(-?\d+)", 1).try_cast("int")


def first_integer(c: Column) -> Column:
    """The first number in a value, signed where its minus stands alone; a value with BC is negative."""
    n = F.regexp_extract(c, r"(\d+)", 1).try_cast("int")
    negative = c.rlike(r"(^|[^-\d])-\d") & ~c.rlike(r"^\D*\d+-") | c.rlike(r"\bBC\b|B[.]C[.]")
    return F.when(negative, -n).otherwise(n)


def clamped_date(c: Column) -> Column:
    """A date of YYYY[-MM[-DD]]: bad months and days count as 1, days beyond the month's end as its last (29 in February)."""
    part = lambda k: F.regexp_extract(c, r"^(\d{1,4})(?:-(\d+))?(?:-(\d+))?", k).try_cast("int")
    year, month, day = part(1), F.coalesce(part(2), F.lit(1)), F.coalesce(part(3), F.lit(1))
    month = F.when(month.between(1, 12), month).otherwise(1)
    last = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    day = F.when(day < 1, 1).when(day > 31, 1).otherwise(F.least(day, last))
    return F.coalesce(F.make_date(year, month, day), F.lit("9999-12-31").cast("date"))


def metadata_words(c: Column) -> Column:
    """Distinct folded words of a value."""
    return F.array_distinct(F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def sort_form(c: Column) -> Column:
    """A metadata value as a sort key: folded, missing last."""
    return F.coalesce(F.when(c != "", fold(c)), F.lit(MISSING))


def natural_sort_form(c: Column, width: int = 12) -> Column:
    """A sort key whose numbers compare by size: each run of digits is filled to ``width``."""
    pieces = F.regexp_extract_all(c, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d") & (F.length(p) < width), F.lpad(p, width, "0")).otherwise(p)), "")
