"""Number handling: finite values, text parsing, guarded division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Text accepted as a number. Java's parser also takes "1d" and "1f"; those are rejected here.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"


def _double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def finite_or_null(c: Column | str) -> Column:
    """NULL, NaN and both infinities become NULL (NaN compares greater than infinity)."""
    value = _double(c)
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def finite(c: Column | str, default: float = 0.0) -> Column:
    """NULL, NaN and both infinities become ``default``."""
    value = _double(c)
    return F.when(F.abs(value) < F.lit(float("inf")), value).otherwise(F.lit(float(default)))


def to_number(c: Column | str) -> Column:
    """Text to double; anything that is not a number becomes NULL, blanks are ignored."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """``num / den`` where the denominator is positive, else ``default``."""
    safe = F.when(den > 0, num / den)
    return safe if default is None else safe.otherwise(F.lit(float(default)))


def half_even(x: Column, digits: int) -> Column:
    """``x``, moved to its rounding where text of ``digits`` places would otherwise round a tie up.

    The formatter rounds the shortest text of a double half up; wanted is the exact value, half to even. They differ only
    where the double is the nearest one to a tie; the sign of its exact distance from the tie comes from a split product.
    """
    scale = 10.0 ** digits
    below = F.floor(x * scale)
    twice = below * 2 + 1
    tie = (F.abs(x) < 1e12) & (x == twice / F.lit(2 * scale))
    split = x * 134217729.0
    high = split - (split - x)
    rest = (high * (2 * scale) - twice) + (x - high) * (2 * scale)
    up = (rest > 0) | ((rest == 0) & (F.pmod(below, F.lit(2)) == 1))
    return F.when(tie, (below + up.cast("int")) / F.lit(scale)).otherwise(x)


def divide_or_null(num: Column, den: Column) -> Column:
    """Division where a zero denominator gives NULL (ANSI mode would raise)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def quoted(name: str) -> str:
    """Back-quoted column name, for names with blanks or slashes."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def finite_column(df: DataFrame, name: str) -> Column:
    """:func:`finite_or_null` of a column; whole-number columns need no check."""
    if isinstance(df.schema[name].dataType, T.IntegralType):
        return col(name).cast("double")
    return finite_or_null(col(name))


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters and projections use by reference.

    Catalyst copies an expression into every filter and projection above it;
    for wide CASE trees used many times that makes plans too large to compile.
    A one-row ``inline`` keeps the columns computed in one place. Filters on the
    other columns still move below it to the scan.
    """
    kept = [col(c) for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))
