"""File bytes: type by leading bytes, content hash, storage location, base64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading bytes (hex) of each accepted type.
SIGNATURES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("image/png", ("89504E470D0A1A0A",)),
    ("image/jpeg", ("FFD8FFE0", "FFD8FFE1", "FFD8FFDB", "FFD8FFEE")),
    ("application/pdf", ("255044462D",)),
    ("image/tiff", ("49492A00", "4D4D002A")),
)
# File extension per type.
EXTENSIONS: dict[str, str] = {
    "image/png": ".png",
    "image/jpeg": ".jpg",
    "image/tiff": ".tif",
    "image/webp": ".webp",
    "application/pdf": ".pdf",
}
# Fixed value: upload size limit in bytes.
MAX_UPLOAD_BYTES = 25 * 1024 * 1024


def sniff_content_type(content: Column) -> Column:
    """Accepted media type, or null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    expr = None
    for kind, marks in SIGNATURES:
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.startswith(head, F.lit(mark))
        expr = F.when(hit, F.lit(kind)) if expr is None else expr.when(hit, F.lit(kind))
    riff_webp = F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250")
    return expr.when(riff_webp, F.lit("image/webp"))


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def extension_of(content_type: Column) -> Column:
    """Extension of an accepted type, null for others. Five literals, no join."""
    expr = None
    for kind, ext in EXTENSIONS.items():
        hit = content_type == kind
        expr = F.when(hit, F.lit(ext)) if expr is None else expr.when(hit, F.lit(ext))
    return expr


def storage_key(workspace_id: Column, sha: Column, name: Column, content_type: Column) -> Column:
    """``{workspace}/{first two hash digits}/{name}{extension}``."""
    return F.concat_ws(
        "/", workspace_id, F.substring(sha, 1, 2), F.concat(name, extension_of(content_type))
    )


def decode_base64url(data: Column) -> Column:
    """URL-safe base64 text to bytes."""
    return F.unbase64(F.translate(data, "-_", "+/"))
