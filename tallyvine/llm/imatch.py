"""I-Match fingerprints over several randomised lexicons."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from tallyvine.llm.common import words

#: Terms in at least LEAST_DOCS documents and at most MOST_SHARE of all: the band of inverse document frequency.
LEAST_DOCS, MOST_SHARE = 2, 0.1
#: Each lexicon is a random 1/2, 1/8, 1/32, 1/128 or 1/512 of all terms: large ones tell texts apart, small ones outlast edits.
SHIFTS = [1] * 4 + [3] * 4 + [5] * 8 + [7] * 8 + [9] * 8
_rng = np.random.default_rng(11)
MULTIPLIERS = _rng.integers(1, 1 << 63, len(SHIFTS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Hex digits of a lexicon's hash, and what stands for a lexicon that holds no term of the text.
DIGITS = 8
NONE = "0" * DIGITS


def term_hashes(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, least_docs: int = LEAST_DOCS, most_share: float = MOST_SHARE) -> np.ndarray:
    """Sorted hashes of the terms in the band.

    Documents are counted for every term by its 64-bit hash, over all documents. Eight
    bytes a term in the band reach the driver and every worker; terms of fewer documents,
    which are most of a vocabulary, and those of too many do not.
    """
    terms = F.array_distinct(term_hashes(F.col("text")))
    counts = docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    most = most_share * docs.count()
    chosen = counts.where((F.col("df") >= least_docs) & (F.col("df") <= most)).select("term").toArrow()
    return np.sort(chosen["term"].to_numpy().astype(np.int64).view(np.uint64))


def fingerprint(hashes: np.ndarray, band: np.ndarray) -> str:
    """Distinct terms in the lexicon, sorted; one hash for each of the smaller lexicons."""
    h = np.unique(hashes.astype(np.int64).view(np.uint64))
    at = np.searchsorted(band, h)
    inside = at < len(band)
    inside[inside] = band[at[inside]] == h[inside]
    terms = h[inside]
    if not len(terms):  # nothing in the band: the terms themselves, so that only equal ones match
        return "=" + hashlib.blake2b(h.tobytes(), digest_size=16).hexdigest()
    out = []
    for shift, multiplier in zip(SHIFTS, MULTIPLIERS, strict=True):
        kept = terms[(terms * multiplier) >> np.uint64(64 - shift) == 0]
        out.append(hashlib.blake2b(kept.tobytes(), digest_size=DIGITS // 2).hexdigest() if len(kept) else NONE)
    return "".join(out)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the lexicons that hold a term of either text; 1 for equal fingerprints."""
    parts = [(F.substring(a, 1 + DIGITS * i, DIGITS), F.substring(b, 1 + DIGITS * i, DIGITS)) for i in range(len(SHIFTS))]
    same = sum((F.when((x == y) & (x != NONE), 1).otherwise(0) for x, y in parts), F.lit(0))
    used = sum((F.when((x == NONE) & (y == NONE), 0).otherwise(1) for x, y in parts), F.lit(0))
    whole = a.startswith("=") | b.startswith("=")
    return F.when(a == b, 1.0).when(whole, 0.0).otherwise(F.coalesce(same / F.nullif(used, F.lit(0)), F.lit(0.0))).cast("double")


class Fingerprints:
    """A lexicon taken from a corpus, and fingerprints of any text under it."""

    def __init__(self, spark: SparkSession, docs: DataFrame, **band):
        shared = spark.sparkContext.broadcast(lexicon(docs, **band))  # 8 bytes a term in the band

        @F.pandas_udf("string")
        def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series([fingerprint(np.asarray(h), shared.value) for h in part], dtype=object)

        self._of = of

    def __call__(self, text: Column) -> Column:
        return self._of(term_hashes(text))


@F.pandas_udf(BinaryType())
def packed(texts: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor(level=3).compress
    return texts.map(lambda t: pack(t.encode("utf-8", "surrogatepass")))


@F.pandas_udf(StringType())
def edited_text(own: pd.Series, after: pd.Series) -> pd.Series:
    """The last half of one packed text replaced by as many code points of the other's start."""
    unpack = zstandard.ZstdDecompressor().decompress

    def edit(a: bytes, b: bytes) -> str:
        text = unpack(a).decode("utf-8", "surrogatepass")
        half = len(text) // 2
        return text[: len(text) - half] + unpack(b).decode("utf-8", "surrogatepass")[:half]

    return pd.Series([edit(a, b) for a, b in zip(own, after, strict=True)], dtype=object)


def with_next(rows: DataFrame, columns: list[str], tie: str, most_buckets: int = 20_000, rows_a_bucket: int = 500) -> DataFrame:
    """``columns`` with ``next``, a struct of the same columns of the next document in descending doc_id.

    Order: doc_id descending, null last, then ``tie``; the first follows the last. Documents
    are dealt into ranges of doc_id between quantiles (at most ``most_buckets`` numbers on
    the driver); the head of each range goes to the range before it too.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = rows.select("doc_id").count()
    k = min(most_buckets, max(1, n // rows_a_bucket))
    cut = rows.select(key.alias("key")).agg(
        F.max("key").alias("top"), F.percentile_approx("key", [i / k for i in range(1, k + 1)], max(10_000, 20 * k)).alias("cuts")
    ).first()
    heads = np.asarray(sorted({*(cut["cuts"] or []), *([] if cut["top"] is None else [cut["top"]])}), dtype=np.int64)

    @F.pandas_udf("array<int>")
    def ranges(keys: pd.Series) -> pd.Series:
        at = np.searchsorted(heads, keys.to_numpy(dtype=np.int64))
        head = heads[at] == keys.to_numpy(dtype=np.int64)
        return pd.Series([[a, (a + 1) % len(heads)] if h else [a] for a, h in zip(at, head, strict=True)], dtype=object)

    dealt = rows.withColumn("key", key).withColumn("ranges", ranges("key")).select("key", *columns, F.posexplode("ranges").alias("also", "range"))
    order = Window.partitionBy("range").orderBy("also", F.col("key").desc(), tie)
    after = F.lead(F.struct(*columns)).over(order)
    return dealt.withColumn("next", after).where("also = 0").select(*columns, "next")


def compared(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they are.

    The edited text has its last floor(n/2) code points replaced by the first as many of
    the next document's. Null text is the empty text, whose fingerprint is that of no
    term. Rows with equal ids follow each other by a hash of the text; repeated rows are kept. Other
    columns are not looked at. An empty table gives an empty one.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    mark = Fingerprints(spark, rows)
    # Texts travel compressed: one shuffle by range of doc_id is all that moves them.
    slim = rows.select("doc_id", F.xxhash64("text").alias("tie"), F.length("text").cast("long").alias("n_chars"), packed("text").alias("pack"), mark(F.col("text")).alias("fingerprint"))
    pairs = with_next(slim, ["doc_id", "tie", "n_chars", "pack", "fingerprint"], "tie")
    out = pairs.select("doc_id", "n_chars", "fingerprint", F.col("next.fingerprint").alias("after"), edited_text("pack", "next.pack").alias("edited"))
    out = out.withColumn("edited_fingerprint", mark(F.col("edited")))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("after")).alias("near_next"),
    )
