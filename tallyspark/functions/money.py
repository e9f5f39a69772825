"""Money as doubles, compared in whole cents; rounding is half up, towards plus infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.tables import THREE_DECIMAL_CURRENCIES
from tallyspark.functions.text import let


def minor_units(amount: Column) -> Column:
    """Whole cents."""
    return F.floor(amount * F.lit(100.0) + F.lit(0.5)).cast("long")


def round_up(value: Column, places: int) -> Column:
    """Rounded to `places` decimals."""
    return F.floor(value * F.lit(10.0**places) + F.lit(0.5)) / F.lit(10.0**places)


def fixed2(amount: Column) -> Column:
    """Two decimals as text, of the exact binary value, a tie away from zero: 1.005 is a little less and gives 1.00."""

    def text(x: Column) -> Column:
        # the product and its rounding error (Dekker), so that the half is met exactly
        product = x * F.lit(100.0)
        wide = x * F.lit(134217729.0)
        high = wide - (wide - x)
        error = (high * F.lit(100.0) - product) + (x - high) * F.lit(100.0)
        whole = F.floor(product)
        over = product - whole - F.lit(0.5)
        cents = whole + F.when((over > 0) | ((over == 0) & (error >= 0)), 1).otherwise(0)
        return let(cents.cast("long"), lambda n: F.concat((n / 100).cast("long").cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0")))

    return let(F.abs(amount), lambda x: F.concat(F.when(amount < 0, "-").otherwise(""), text(x)))


def number_text(amount: Column) -> Column:
    """Shortest plain text of a number: no trailing .0, no exponent."""
    text = F.format_string("%.6f", amount.cast("double"))
    return F.when(amount.isNotNull(), F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def is_three_decimal(currency: Column) -> Column:
    """Whether the currency's minor unit is a thousandth."""
    return F.coalesce(F.upper(currency).isin(*THREE_DECIMAL_CURRENCIES), F.lit(False))


def parse_amount(raw: Column, three_decimals: Column | bool = False) -> Column:
    """A number in either decimal convention; null where there is none.

    The separator that comes last is the decimal one. One to three digits, a dot and three digits are thousands,
    unless `three_decimals`, where one separator before exactly three digits is the decimal one.
    """
    three = F.lit(three_decimals) if isinstance(three_decimals, bool) else three_decimals
    # most are plain: no thousands, and one or two decimals, or after a dot four and more
    plain = r"^-?\d+(?:\.(?:\d{1,2}|\d{4,})|,\d{1,2})?\z"
    read = lambda x: let(F.regexp_replace(x, r"[^0-9.,\-]", ""), lambda kept: _amount(kept, three))
    return let(raw, lambda x: F.when(x.rlike(plain), F.translate(x, ",", ".").try_cast("double")).otherwise(read(x)))


def _amount(kept: Column, three: Column) -> Column:
    comma, dot = F.length(kept) - F.locate(",", F.reverse(kept)), F.length(kept) - F.locate(".", F.reverse(kept))
    has_comma, has_dot = F.contains(kept, F.lit(",")), F.contains(kept, F.lit("."))
    comma_last = has_comma & (~has_dot | (comma > dot))
    first_comma = F.regexp_replace(F.regexp_replace(kept, r"\.", ""), r"^([^,]*),", "$1.")
    plain = F.when(comma_last, first_comma).otherwise(F.regexp_replace(kept, ",", ""))
    thousands = r"^-?\d{1,3}\.\d{3}\z"
    plain = let(plain, lambda p: F.when(p.rlike(thousands) & ~has_comma, F.regexp_replace(p, r"\.", "")).otherwise(p))
    plain = F.when(three & kept.rlike(r"^-?\d+[.,]\d{3}\z"), F.regexp_replace(kept, ",", ".")).otherwise(plain)
    lead = let(plain, lambda p: F.regexp_extract(p, r"^(-?(?:\d+\.?\d*|\.\d+))", 1))
    return F.when(kept.rlike(r"\d"), lead.try_cast("double"))


def looks_three_decimal(values: Column) -> Column:
    """Two values or more with three decimals, and none with two."""
    three = F.size(F.filter(values, lambda v: v.rlike(r"^-?[0-9 ]*\d[.,]\d{3}\z")))
    two = F.size(F.filter(values, lambda v: v.rlike(r"[.,]\d{2}\z")))
    return (three >= 2) & (two == 0)


def csv_cell(value: Column) -> Column:
    """A CSV cell: null is empty, formulas are disarmed, commas, quotes and line ends quoted."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    formula = text.rlike(r"^[=+@\t\r]") | (text.startswith("-") & ~text.rlike(r"^-?\d+(\.\d+)?\z"))
    safe = F.when(formula, F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(safe.rlike(r'[",\n\r]'), F.concat(F.lit('"'), F.regexp_replace(safe, '"', '""'), F.lit('"'))).otherwise(safe)
