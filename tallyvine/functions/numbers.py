"""Numbers: European decimals, percents, money in minor units, IBAN check."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyvine.functions import patterns as P
from tallyvine.functions.text import WHITESPACE, let, strip

DECIMAL = "decimal(38,10)"
# Unscaled amounts: 38 digits at most, in products too.
UNSCALED = "decimal(38,0)"


def _plain_decimal(c: Column) -> Column:
    """Decimal text with a point: a comma, where present, is the decimal mark and
    points are dropped. White space goes in the same pass."""
    return F.when(
        F.contains(c, F.lit(",")), F.translate(c, ",." + WHITESPACE, ".")
    ).otherwise(F.translate(c, WHITESPACE, ""))


def european_decimal(c: Column) -> Column:
    """``1 319,97`` / ``1.319,97`` / ``10.00`` to decimal, null when unparseable."""
    return _plain_decimal(c).try_cast(DECIMAL)


def written_scale(c: Column) -> Column:
    """Number of decimals written in a number text."""
    return F.length(F.regexp_extract(_plain_decimal(c), r"\.(\d*)$", 1))


def percent_text(c: Column) -> Column:
    """Percent text without its sign."""
    return strip(F.rtrim(strip(c), F.lit("%")))


def exact_number(c: Column) -> tuple[Column, Column, Column]:
    """``(readable, unscaled, scale)`` of a number text; unscaled is null beyond 38 digits."""
    plain = _plain_decimal(c)
    readable = F.coalesce(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), F.lit(False))
    return readable, F.when(readable, F.translate(plain, ".+", "").try_cast(UNSCALED)), written_scale(c)


def power_of_ten(n: Column) -> Column:
    """``10 ** n`` as an unscaled amount, null beyond 37; looked up in a constant array."""
    return F.get(F.array(*[F.lit(Decimal(10**i)).cast(UNSCALED) for i in range(38)]), n)


def digits_of(unscaled: Column) -> Column:
    """The digits without the sign. ``abs`` of a number of 38 digits would round it."""
    return F.translate(unscaled.cast("string"), "-", "")


def magnitude(unscaled: Column) -> Column:
    """The absolute amount, exact to 38 digits; see ``digits_of``."""
    return F.when(unscaled < 0, F.try_multiply(unscaled, F.lit(-1).cast("decimal(1,0)")).cast(UNSCALED)).otherwise(unscaled)


def at_scale(unscaled: Column, scale: Column, shown: Column) -> Column:
    """``unscaled / 10 ** scale`` as text with ``shown`` decimals; the rest are zeros."""
    plain = digits_of(unscaled)
    digits = F.lpad(plain, F.greatest(scale + 1, F.length(plain)), "0")
    whole = F.substr(digits, F.lit(1), F.length(digits) - scale)
    decimals = F.substr(digits, F.length(digits) - scale + 1, shown)
    return F.concat(F.when(unscaled < 0, "-").otherwise(""), whole, F.when(shown > 0, F.concat(F.lit("."), decimals)).otherwise(""))


def percent(c: Column) -> Column:
    """``10 %`` to the number of percent points."""
    return european_decimal(percent_text(c))


def money_to_minor(c: Column) -> Column:
    """Money text to integer minor units; the last separator is the decimal mark."""
    return let(F.regexp_replace(c, "[^0-9.,-]", ""), _kept_to_minor)


def _kept_to_minor(kept: Column) -> Column:
    hundred = F.lit(100).cast("bigint")
    # Amounts that 64 bits do not hold are null, like unreadable ones.
    whole = F.try_multiply(F.when(kept.rlike(r"^-?\d+$"), kept.try_cast("bigint")), hundred)
    # Position of the last separator, counted from the end.
    tail = F.substring_index(F.translate(kept, ",", "."), ".", -1)
    head = F.translate(F.left(kept, F.length(kept) - F.length(tail) - 1), ",.", "")
    digits = F.ltrim(head, F.lit("-"))
    sign = F.when(F.startswith(head, F.lit("-")), F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    units = F.when(digits == "", F.lit(0).cast("bigint")).when(
        digits.rlike(r"^\d+$"), digits.try_cast("bigint")
    )
    cents = F.rpad(F.substring(tail, 1, 2), 2, "0").try_cast("bigint")
    marked = kept.rlike("[.,]")
    return F.when(
        (kept != "") & ~kept.isin(".", ",", "-"),
        F.when(marked, sign * F.try_add(F.try_multiply(units, hundred), cents)).otherwise(whole),
    )


def format_amount(minor: Column, currency: Column) -> Column:
    """Minor units to display text with thousands separators and two decimals."""
    symbol = (
        F.when(currency == "INR", F.lit("₹"))
        .when(F.coalesce(currency, F.lit("")) != "", F.concat(currency, F.lit(" ")))
        .otherwise(F.lit(""))
    )
    major = minor.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")
    return F.when(minor.isNull(), F.lit("—")).otherwise(
        F.concat(symbol, F.format_number(major.cast("decimal(22,2)"), 2))
    )


def iban_is_valid(c: Column) -> Column:
    """Mod-97 check. A running remainder keeps the number small."""
    code = F.upper(F.replace(strip(c), F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(rem: Column, ch: Column) -> Column:
        value = F.ascii(ch)
        return (
            F.when(ch == "", rem)
            .when(value < 58, (rem * 10 + value - 48) % 97)
            .otherwise((rem * 100 + value - 55) % 97)
        )

    remainder = F.aggregate(F.split(turned, ""), F.lit(0), step)
    return F.coalesce(F.when(code.rlike(P.IBAN_CHECKABLE), remainder == 1), F.lit(False))


def itc_estimate(clean_minor: Column) -> Column:
    """Tax credit share of a tax-inclusive amount at 18 %, rounded down."""
    # 18 parts of 118. Floor, so that negative totals round down too.
    scaled = clean_minor * F.lit(18).cast("bigint")
    rate = F.lit(118).cast("bigint")
    return F.call_function("div", scaled - F.pmod(scaled, rate), rate)


__all__ = [
    "DECIMAL", "UNSCALED", "at_scale", "european_decimal", "exact_number", "format_amount", "iban_is_valid",
    "itc_estimate", "money_to_minor", "percent", "percent_text", "power_of_ten", "written_scale",
]
