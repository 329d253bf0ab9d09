"""Mixing sources to target weights by hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvine.llm.common import broadcast_if_few, hash60, positions, staged, word_count

#: A 60-bit hash is refined by 15 bits a pass, so a source has at most 32,768 buckets in any pass.
BITS, LEVELS = 15, 4


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources in code point order (null last) take the weights in turn. Each gets its share
    of all sizes; none gets more than ``most`` times its own, the excess is shared again.
    The share per weight unit rises until no further source is above its limit; each
    round is one aggregate over the table of sources.
    """
    order = [F.col("source").asc_nulls_last()]
    ranked = positions(sizes, order, "place", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = staged(ranked.select("source", "source_size", weight.alias("weight")), "mix-weights")
    limit = most * F.col("source_size")
    unit, last = 0.0, None
    while unit != last:
        last = unit
        full = F.lit(False) if last == 0.0 else F.col("weight") * last > limit
        row = ranked.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, limit)).alias("fixed"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        unit = ((row["all"] or 0) - (row["fixed"] or 0.0)) / row["open"] if row["open"] else last
    return ranked.select("source", "source_size", F.least(F.col("weight") * unit, limit).alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source the hash at which its budget is met.

    Whole repeats are taken first; the rest of the budget is met by documents with small
    hashes. Sizes are summed by (source, bucket); the bucket in which the running sum
    crosses the rest is the only one that the next pass splits.
    """
    budget = F.round("target").cast("long")
    bounds = targets.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)).alias("repeats"),
        F.when(F.col("source_size") > 0, budget % F.col("source_size")).otherwise(F.lit(0)).cast("long").alias("rest"),
        F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("group_size"), F.lit(0).cast("long").alias("group_rows"),
    )
    bounds = staged(bounds, "mix-bounds")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - level - 1)
        hint = broadcast_if_few(bounds.select(F.col("source").alias("at"), "prefix"))
        inside = rows.join(hint, F.col("source").eqNullSafe(F.col("at")) & (F.shiftright("hash", shift + BITS) == F.col("prefix")))
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
        before = F.sum("s").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.select(F.col("source").alias("at"), "bucket", "s", "n", F.coalesce(before, F.lit(0)).alias("before"))
        crossed = bounds.join(
            sums, F.col("source").eqNullSafe(F.col("at")) & (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("s")), "left"
        )
        bounds = staged(crossed.select(
            "source", "source_size", "target", "repeats", F.coalesce(F.col("rest") - F.col("before"), F.lit(0)).alias("rest"),
            F.coalesce("bucket", F.lit(-1)).alias("prefix"), F.coalesce("s", F.lit(0)).alias("group_size"), F.coalesce("n", F.lit(0)).alias("group_rows"),
        ), "mix-bounds")
    return bounds


def mixture(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, text, lang, source, n_chars`` with ``size, source_size, target, copies, part, taken``.

    A document is taken ``copies`` whole times. Rows that share the hash at the threshold
    (one document as a rule) are taken as well if that comes nearer to the target; if
    they are several rows, each counts with its equal share, ``part`` words, for which
    ``mixed_documents`` takes whole rows.
    ``taken = size * copies + part``. Null text: size 0. Null source: a source of its own,
    last. Null ids: one hash for all of them, so they are taken together. Other columns
    than those of documents are not looked at. An empty table gives an empty one.

    ``options``: ``weights`` of the sources, ``most`` times that a source is taken, ``seed`` of the hashes, ``size`` of a document.
    """
    return _mixture(docs, **options)[0]


def _mixture(docs: DataFrame, weights=(5.0, 2.0, 1.0), most: float = 3.0, seed: str = "mix", size: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``mixture`` and the table of the sources' thresholds."""
    measured = docs.select(
        "doc_id", "text", "lang", "source", "n_chars",
        (word_count(F.col("text")) if size is None else size).alias("size"), hash60(F.col("doc_id"), seed=seed).alias("hash"),
    )
    slim = staged(measured.select("source", "size", "hash"), "mix-rows")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    bounds = thresholds(slim, source_targets(sizes, weights, most))
    hint = broadcast_if_few(bounds).withColumnRenamed("source", "at")
    at = F.col("hash") == F.col("prefix")
    one = F.col("group_rows") == 1
    copies = F.col("repeats") + ((F.col("hash") < F.col("prefix")) | (at & one & (F.col("group_size") <= 2 * F.col("rest")))).cast("long")
    share = F.expr("cast(cast(size as decimal(38,0)) * rest / group_size as bigint)")
    part = F.when(at & ~one, share).otherwise(F.lit(0)).cast("long")
    return measured.join(hint, F.col("source").eqNullSafe(F.col("at"))).select(
        "doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target",
        copies.alias("copies"), part.alias("part"), (F.col("size") * copies + part).alias("taken"),
    ), bounds


def mixed_documents(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mix itself: each document, whole, as often as it is taken.

    Of rows that share the hash at the threshold and give a ``part`` each, as many whole copies come as
    their parts make up: equal rows are counted, and what is left of a copy is decided by a hash of the
    text, so that reruns agree and their sizes add up to what is still wanted, on average. Null texts
    have size 0 and come as often as their source is repeated whole.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    mixed, bounds = _mixture(docs, seed=seed, **options)
    rows = mixed.select(*columns, F.col("copies").alias("times"))
    if not bounds.where("group_rows > 1").isEmpty():
        rows = _with_shared(mixed, columns, seed)
    rows = rows.where("times > 0")
    return rows.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*columns)


def _with_shared(mixed: DataFrame, columns: list[str], seed: str) -> DataFrame:
    """``times`` of every row, where several rows share the hash at a threshold."""
    plain = mixed.where("part = 0").select(*columns, F.col("copies").alias("times"))
    # Rows of one or few ids: the threshold is a single hash of each source.
    equal = mixed.where("part > 0").groupBy(*columns).agg(F.sum("copies").alias("whole"), F.sum("part").alias("words"), F.max("size").alias("size"))
    chance = hash60(F.col("doc_id"), F.md5(F.col("text").cast("binary")), seed=f"{seed}-part") / float(1 << 60)
    shared = equal.select(*columns, (F.col("whole") + F.floor(F.col("words") / F.col("size") + chance)).cast("long").alias("times"))
    return plain.unionByName(shared)


#: The same over documents in DuckDB, without thresholds: running sums in hash order.
SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM rows GROUP BY source),
-- in the order of limit per weight, the first k are at their limit
ordered AS (
  SELECT *, 3.0 * source_size / weight AS ratio,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
         sum(weight) OVER (ORDER BY 3.0 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         sum(source_size) OVER () AS total
  FROM sources),
unit AS (SELECT (total - fixed) / open AS unit FROM ordered WHERE (total - fixed) / open <= ratio ORDER BY ratio, encode(source) NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, least(weight * unit, 3.0 * source_size)::DOUBLE AS target FROM sources, unit),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS repeats,
         CASE WHEN source_size > 0 THEN round(target)::BIGINT % source_size ELSE 0 END AS rest
  FROM targets),
hashes AS (SELECT source, h, sum(size)::BIGINT AS g, count(*) AS n FROM rows GROUP BY source, h),
summed AS (
  SELECT *, coalesce(sum(g) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hashes)
SELECT r.doc_id, r.size, b.source_size, b.target,
       (r.size * b.repeats + CASE
         WHEN s.before + s.g <= b.rest THEN r.size
         WHEN s.before > b.rest THEN 0
         WHEN s.n = 1 THEN CASE WHEN s.g <= 2 * (b.rest - s.before) THEN r.size ELSE 0 END
         ELSE (r.size::HUGEINT * (b.rest - s.before)) // s.g END)::BIGINT AS taken
FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
JOIN summed s ON r.source IS NOT DISTINCT FROM s.source AND r.h = s.h
"""
