"""From recognised text detections to positioned lines and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvine.functions.text import SPACE_CLASS
from tallyvine.sources.config import CONTENT_TYPES


def safe_score(score: Column) -> Column:
    """Confidence in [0, 1]; text that is no number, null and NaN give 0."""
    number = score.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))
    )


def bounding_box(polygon: Column) -> dict[str, Column]:
    """Axis-aligned box of a polygon given as ``[[x, y], ...]``."""
    xs = F.transform(polygon, lambda p: p[0])
    ys = F.transform(polygon, lambda p: p[1])
    return {
        "x0": F.array_min(xs), "y0": F.array_min(ys),
        "x1": F.array_max(xs), "y1": F.array_max(ys),
    }


def explode_pages(pages: DataFrame) -> DataFrame:
    """One row per non-empty detection of a page record, densely numbered.

    The recogniser hands over a page as one record, so dropping the empty
    detections inside the array keeps ``line_no`` dense without any shuffle.
    """
    kept = F.filter("detections", lambda d: F.coalesce(F.length(d["text"]), F.lit(0)) > 0)
    return pages.select(
        "doc_id", "page_width", "page_height", F.posexplode(kept).alias("line_no", "d")
    ).select("doc_id", "line_no", "page_width", "page_height", "d.polygon", "d.text", "d.score")


def drop_empty_detections(detections: DataFrame) -> DataFrame:
    """Row form of the same rule: keep detections with text, numeric polygon and score."""
    return (
        detections.where(F.length("text") > 0)
        .withColumn("polygon", F.col("polygon").cast("array<array<double>>"))
        .withColumn("score", F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)))
    )


def shape_lines(detections: DataFrame) -> DataFrame:
    """Detections (row form) to ``ocr_line`` rows."""
    kept = drop_empty_detections(detections)
    return kept.select(
        "doc_id", "line_no", "text",
        *[c.alias(n) for n, c in bounding_box(F.col("polygon")).items()],
        "polygon",
        safe_score(F.col("score")).alias("confidence"),
        "page_width", "page_height",
    )


def split_tokens(lines: DataFrame) -> DataFrame:
    """White-space tokens with a share of the line's width by character count.

    One blank is counted between words. The start of a word is the length of
    the words before it, joined with single blanks.
    """
    words = F.filter(F.split("text", SPACE_CLASS + "+"), lambda w: w != "")
    listed = lines.withColumn("words", words).withColumn(
        "ends",
        F.aggregate(
            "words",
            F.array().cast("array<int>"),
            lambda ends, w: F.concat(
                ends,
                F.array(F.coalesce(F.try_element_at(ends, F.lit(-1)) + 1, F.lit(0)) + F.length(w)),
            ),
        ),
    )
    out = listed.select(
        "doc_id", "line_no", F.posexplode("words").alias("token_no", "token"),
        "ends", "x0", "y0", "x1", "y1", "confidence",
    )
    total = F.element_at("ends", -1).cast("double")
    end = F.get("ends", F.col("token_no")).cast("double")
    start = end - F.length("token")
    width = F.col("x1") - F.col("x0")
    boxed = out.select(
        "doc_id", "line_no", "token_no", F.col("token").alias("text"),
        (F.col("x0") + start / total * width).alias("x0"), "y0",
        (F.col("x0") + end / total * width).alias("x1"), "y1", "confidence",
    )
    return boxed.withColumn(
        "polygon",
        F.array(F.array("x0", "y0"), F.array("x1", "y0"), F.array("x1", "y1"), F.array("x0", "y1")),
    )


def box_is_ordered() -> Column:
    """Data-quality predicate: the box is not turned inside out."""
    return (F.col("x1") >= F.col("x0")) & (F.col("y1") >= F.col("y0"))


def with_box_size(lines: DataFrame) -> DataFrame:
    return lines.select(
        "*", (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height")
    )


def input_defect(
    invoice_id: Column, inline: Column, uri: Column, content_type: Column
) -> Column:
    """Why an input record breaks the contract, null when it is fine."""
    has_bytes = inline.isNotNull()
    has_uri = uri.isNotNull()
    return (
        F.when(F.coalesce(F.length(invoice_id), F.lit(0)) == 0, F.lit("empty id"))
        .when(has_bytes & has_uri, F.lit("both inline bytes and uri"))
        .when(~has_bytes & ~has_uri, F.lit("neither inline bytes nor uri"))
        .when(
            ~F.coalesce(content_type.isin(*CONTENT_TYPES), F.lit(False)),
            F.lit("content type not allowed"),
        )
    )


def document_stats(lines: DataFrame, tokens: DataFrame) -> DataFrame:
    """Lines, tokens and mean confidence per document.

    Each side is reduced to one row per document before they meet.
    """
    per_line = lines.groupBy("doc_id").agg(
        F.count("*").alias("line_count"), F.avg("confidence").alias("avg_confidence")
    )
    per_token = tokens.groupBy("doc_id").agg(F.count("*").alias("token_count"))
    return per_line.join(per_token, "doc_id", "left").select(
        "doc_id", "line_count",
        F.coalesce("token_count", F.lit(0).cast("bigint")).alias("token_count"),
        "avg_confidence",
    )


def corpus_stats(stats: DataFrame) -> DataFrame:
    """Totals and averages over the documents."""
    return stats.agg(
        F.count("*").alias("doc_count"),
        F.sum("line_count").alias("line_count"),
        F.sum("token_count").alias("token_count"),
        F.avg("line_count").alias("avg_lines"),
    )


def index_range(docs: DataFrame, index: str, start: int, count: int) -> DataFrame:
    """Documents whose index lies in ``[start, start + count)``."""
    return docs.where((F.col(index) >= start) & (F.col(index) < start + count))
