"""Column helpers that pin down the source dialect's semantics.

Each helper is a plain Catalyst expression (no Python at run time), so it
stays inside whole-stage codegen.  The comments name the behaviour that a
literal translation would get wrong.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- integer arithmetic --------------------------------------------------------

def idiv(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Integer division truncating toward zero (``7/2 = 3``, ``-7/2 = -3``).

    Spark's ``/`` always yields a double; the source divides integers.
    ``div`` is exact on 64-bit values, unlike a round trip through double.
    """
    return F.call_function("div", _c(a), _c(b))


def trunc_avg(c: ColumnOrName) -> Column:
    """Mean of an integer column, truncated to an integer (``AVG(int)``).

    NULLs are skipped in both the sum and the count, as in ``AVG``.
    """
    return idiv(F.sum(_c(c)), F.count(_c(c)))


# --- dates -----------------------------------------------------------------------

def year_boundaries(start: ColumnOrName, end: ColumnOrName) -> Column:
    """``DATEDIFF(YEAR, start, end)``: year boundaries crossed, not full years."""
    return F.year(_c(end)) - F.year(_c(start))


def month_boundaries(start: ColumnOrName, end: ColumnOrName) -> Column:
    """``DATEDIFF(MONTH, start, end)``: 31 Jan -> 1 Feb is one month."""
    s, e = _c(start), _c(end)
    return (F.year(e) - F.year(s)) * 12 + (F.month(e) - F.month(s))


def yyyymmdd_to_date(c: ColumnOrName) -> Column:
    """Raw ``YYYYMMDD`` integer to a date.

    0 or a value that is not eight characters long becomes NULL.  An eight
    digit value that is not a calendar date (month 13) also becomes NULL
    instead of failing the whole load.
    """
    x = _c(c)
    text = x.cast("string")
    return F.when((x == 0) | (F.length(text) != 8), F.lit(None).cast("date")).otherwise(
        F.try_to_date(text, "yyyyMMdd")
    )


def as_of_date(as_of: date | str | None) -> Column:
    """The job's reference date; ``None`` means today (the source's ``GETDATE()``)."""
    if as_of is None:
        return F.current_date()
    return F.lit(as_of if isinstance(as_of, str) else as_of.isoformat()).cast("date")


# --- text ------------------------------------------------------------------------

def full_name(first: ColumnOrName, last: ColumnOrName) -> Column:
    """``CONCAT(first, ' ', last)`` where a NULL part counts as an empty string."""
    return F.concat(F.coalesce(_c(first), F.lit("")), F.lit(" "), F.coalesce(_c(last), F.lit("")))


def decode(code: ColumnOrName, mapping: Sequence[tuple[Sequence[str], str]], default: str = "n/a",
           normalize: bool = True) -> Column:
    """Map codes to labels; unknown, blank and NULL codes get ``default``.

    ``mapping`` is an ordered list of (accepted codes, label); with
    ``normalize`` the code is trimmed and upper-cased before matching.
    """
    key = F.upper(F.trim(_c(code))) if normalize else _c(code)
    expr = None
    for codes, label in mapping:
        cond = key.isin(list(codes))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


# The source database's default collation compares case-insensitively and
# ignores trailing blanks; Spark's equivalent collation.
SOURCE_COLLATION = "UTF8_LCASE_RTRIM"


def has_outer_blanks(c: ColumnOrName, source_collation: bool = False) -> Column:
    """True when the value differs from its trimmed form (NULL stays unknown).

    Binary by default, so leading and trailing blanks both count.  With
    ``source_collation`` the comparison ignores trailing blanks and case, as
    the source's checks do -- only leading blanks are then found.
    """
    value = F.collate(_c(c), SOURCE_COLLATION) if source_collation else _c(c)
    return value != F.trim(_c(c))


# --- ordered buckets ----------------------------------------------------------

def first_match(branches: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """CASE ladder where the first true branch wins and ELSE also takes NULL."""
    expr = None
    for cond, label in branches:
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(otherwise))


def sign_label(diff: ColumnOrName, positive: str, negative: str, zero: str) -> Column:
    """Label a difference by its sign; a NULL difference gets the ``zero`` label."""
    d = _c(diff)
    return F.when(d > 0, F.lit(positive)).when(d < 0, F.lit(negative)).otherwise(F.lit(zero))


def guarded_idiv(num: ColumnOrName, den: ColumnOrName, when_zero: Column) -> Column:
    """``CASE WHEN den = 0 THEN when_zero ELSE num / den END`` on integers."""
    return F.when(_c(den) == 0, when_zero).otherwise(idiv(num, den))
