"""The label dictionary and its two predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyvine.functions import text as T

# Spellings of each label, recognition errors included.
LABELS: dict[str, tuple[str, ...]] = {
    "seller": ("Seller", "Seller:", "From", "From:"),
    "client": ("Client", "Client:", "Bill to", "Bill to:", "Billed to:"),
    "invoice_no": (
        "Invoice no", "Invoiceno", "Invoicen0", "Invoice no.", "Invoice no:",
        "Invoice no :", "Invoice #", "Invoice Number",
    ),
    "date": ("Date of issue", "Date of issue:", "Invoice date", "Issue date", "Date:", "Date"),
    "tax_id": (
        "Tax Id", "Tax Id:", "Taxld", "Taxld:", "Tax ld", "Tax ld:", "Tax ID", "TaxId", "Tax No",
    ),
    "iban": ("IBAN", "IBAN:"),
    "items_start": ("ITEMS", "Items", "LINE ITEMS", "Line items"),
    "summary_start": ("SUMMARY", "Summary", "Totals", "Total"),
}


def is_label(text: Column, key: str, **options) -> Column:
    """The line is just the label ``key``; an unknown key matches nothing."""
    if key not in LABELS:
        return F.lit(False)
    return T.matches_any(text, LABELS[key], **options)


def contains_label(text: Column, key: str, **options) -> Column:
    """The line contains the label ``key``; an unknown key matches nothing."""
    if key not in LABELS:
        return F.lit(False)
    return T.contains_any(text, LABELS[key], **options)


def may_be_label(column: str, keys: tuple[str, ...]) -> Column:
    """Cheap necessary condition of the line in ``column`` being just one of the labels."""
    return T.may_match(F.col(column), [v for k in keys for v in LABELS[k]])


def may_contain_label(text: Column, key: str) -> Column:
    """Cheap necessary condition of ``contains_label``."""
    return T.may_contain_any(text, LABELS[key])


def structural_label(text: Column, keys: tuple[str, ...], low: Column | None = None) -> Column:
    """Which of several labels the line is, null for none; ``low`` is its ``line_form`` where that is a column already.

    The labels must be so far apart that no line can be two of them at once.
    """
    return T.which_matches(text, {k: LABELS[k] for k in keys}, low=low)
