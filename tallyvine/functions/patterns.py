"""Value patterns of the header fields and of the item table.

The patterns are fixed values. ``find`` turns "no match" into null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header patterns, value in group 1.
INVOICE_NO = r"(?i)invoice\s*n[o0]\s*[.:]*\s*(\d{4,})"
INVOICE_NO_BARE = r"^\s*(\d{6,10})\s*$"
DATE_ANCHORED = (
    r"(?i)(?:date\s*of\s*issue|invoice\s*date|issue\s*date|date)"
    r"\s*[:.]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"
)
DATE_BARE = r"^\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\s*$"
TAX_ID_ANCHORED = r"(?i)tax\s*[IlL1]d\s*[:.]?\s*(\d{3}-\d{2}-\d{4})"
TAX_ID_BARE = r"(\d{3}-\d{2}-\d{4})"
IBAN_ANCHORED = r"(?i)iban\s*[:.]?\s*([A-Z]{2}\d{2}[A-Z0-9]{11,30})"
IBAN_BARE = r"([A-Z]{2}\d{2}[A-Z0-9]{11,30})"

# Item-table patterns, value in group 1.
ITEM_NUMBER = r"^\s*(\d+)\s*\.\s*$"
DECIMAL_COMMA = r"^\s*(\d{1,3}(?:[\s.]?\d{3})*,\d{2})\s*$"
VAT_PERCENT = r"^\s*(\d+(?:[,.]\d+)?\s*%)\s*$"
UNIT_OF_MEASURE = r"(?i)^\s*(each|pcs|pc|unit|kg|g|mtr|m|ml|l)\s*$"

# Shapes of finished values.
INVOICE_NO_SHAPE = r"^\d{6,10}$"
TAX_ID_SHAPE = r"^\d{3}-\d{2}-\d{4}$"
IBAN_SHAPE = r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$"
IBAN_CHECKABLE = r"^[A-Z]{2}\d{2}[A-Z0-9]+$"
GSTIN_SHAPE = r"^\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9]$"
PHONE_SHAPE = r"^\+?[1-9]\d{7,14}$"
OTP_SHAPE = r"^\d{6}$"


# A word that every match of the pattern contains, in either case.
REQUIRED = {INVOICE_NO: "invoice", DATE_ANCHORED: "date", TAX_ID_ANCHORED: "tax", IBAN_ANCHORED: "iban"}

# Characters of the shortest match of a pattern that needs no word.
SHORTEST = {INVOICE_NO_BARE: 6, DATE_BARE: 6, TAX_ID_BARE: 11, IBAN_BARE: 15}


def find(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, null when there is none.

    Few lines hold the word a pattern needs, or are long enough; only those are tried.
    """
    value = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    if pattern in REQUIRED:
        return F.when(may_hold(text, pattern), value)
    least = SHORTEST.get(pattern)
    return value if least is None else F.when(F.length(text) >= least, value)


def may_hold(text: Column, pattern: str) -> Column:
    """Cheap necessary condition of a match: the word every match contains."""
    return F.contains(F.lower(text), F.lit(REQUIRED[pattern]))


def is_gstin(c: Column) -> Column:
    return c.rlike(GSTIN_SHAPE)


def is_phone(c: Column) -> Column:
    return c.rlike(PHONE_SHAPE)


def is_otp(c: Column) -> Column:
    return c.rlike(OTP_SHAPE)


def is_display_name(c: Column) -> Column:
    """1 to 120 characters after trimming."""
    from tallyvine.functions.text import strip

    return F.length(strip(c)).between(1, 120)
