"""Operator configuration: keywords, accepted types, bounded integers."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

# Accepted media types and default subject keywords.
CONTENT_TYPES: tuple[str, ...] = (
    "application/pdf", "image/png", "image/jpeg", "image/tiff", "image/webp",
)
KEYWORDS: tuple[str, ...] = (
    "invoice", "bill", "receipt", "gst", "tax invoice", "purchase order", "po", "statement",
    "payment", "rechnung", "factura",
)
# Name -> (default, lowest, highest). Caps hold only where a configuration
# sets them: by default every message and every attachment is taken.
BOUNDS: dict[str, tuple[int | None, int, int]] = {
    "backfill_days": (30, 1, 365),
    "max_attachments_per_message": (None, 1, 100),
    "max_messages_per_poll": (None, 1, 1000),
}


@dataclass(frozen=True)
class MailboxConfig:
    subject_keywords: tuple[str, ...] = KEYWORDS
    supported_content_types: tuple[str, ...] = CONTENT_TYPES
    backfill_days: int = BOUNDS["backfill_days"][0]
    max_attachments_per_message: int | None = None
    max_messages_per_poll: int | None = None

    def keywords(self) -> tuple[str, ...]:
        """Trimmed, lower-cased, blank ones dropped."""
        return tuple(k.strip().lower() for k in self.subject_keywords if k.strip())


def mailbox_config(document: dict[str, Any] | str) -> MailboxConfig:
    """Read the mailbox section of a configuration document; reject bad values early."""
    doc = json.loads(document) if isinstance(document, str) else document
    section = doc.get("email_ingestion")
    if not isinstance(section, dict):
        raise ValueError("section 'email_ingestion' is missing or not an object")
    values: dict[str, Any] = {}
    for name in ("subject_keywords", "supported_content_types"):
        given = section.get(name, [])
        if not isinstance(given, list) or any(not isinstance(x, str) for x in given):
            raise ValueError(f"'{name}' must be a list of strings")
        values[name] = tuple(given)
    for name, (default, low, high) in BOUNDS.items():
        given = section.get(name, default)
        if given is None and name not in section:
            values[name] = None
            continue
        if isinstance(given, bool) or not isinstance(given, int) or not low <= given <= high:
            raise ValueError(f"'{name}' must be an integer in [{low}, {high}]")
        values[name] = given
    return MailboxConfig(**values)
