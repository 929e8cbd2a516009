"""Column expressions shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def real(value: Column | str) -> Column:
    return col(value).cast("double")


def nonzero(value: Column | str) -> Column:
    """NULL instead of zero, for use as a denominator."""
    return F.nullif(col(value), F.lit(0))


def ratio(top: Column | str, bottom: Column | str) -> Column:
    return real(top) / nonzero(real(bottom))


def rounded(value: Column | str, places: int = 2) -> Column:
    """Round on the value's own type (exact for decimals), then report a double."""
    return F.round(col(value), places).cast("double")


def pct(top: Column | str, bottom: Column | str, places: int = 2) -> Column:
    return F.round(ratio(top, bottom) * 100, places)


def line_margin() -> Column:
    """Profit share of one sale; NULL for a sale of zero."""
    return ratio("profit", "sales")


def format_fixed(value: Column | str, places: int) -> Column:
    """Fixed places, half-even, no thousands separators."""
    return F.translate(F.format_number(real(value), places), ",", "")


def format_currency(value: Column | str) -> Column:
    """``$1,234``; the sign of a negative amount follows the dollar mark."""
    return F.concat(F.lit("$"), F.format_number(real(value), 0))


def format_pct(value: Column | str) -> Column:
    """``12.3%`` of a value already in percent."""
    return F.concat(format_fixed(value, 1), F.lit("%"))
