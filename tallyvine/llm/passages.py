"""Repeated passages: suffix arrays of shards that hold what may be equal, over whole texts as bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvine.llm.common import ready, staged
from tallyvine.llm.suffix_array import repeated_starts

#: Bytes of a repeated string, and of the string in it that says where it is looked for.
WIDTH, GRAM = 400, 64
#: Different stretches of a shard's group, and how far apart their windows may start. Others are first split by more
#: of the bytes that their windows hold, so that what is equal as a whole or shares only a phrase needs no sorting.
GROUP, NARROW = 32, 84
#: Bytes whose anchors are found at once, bytes of the shards that a worker sorts together, and of one shard.
BUFFER, HELD, SHARD = 512 << 10, 1 << 20, 4096

_SPAN = WIDTH - GRAM + 1
_rng = np.random.default_rng(31)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0xD1342543DE82EF95
_POWERS = np.cumprod(np.full(BUFFER + WIDTH, _STEP, dtype=np.uint64))
_INVERSE = np.cumprod(np.full(BUFFER + WIDTH, pow(_STEP, -1, 1 << 64), dtype=np.uint64))
_POSITION = np.uint64((1 << 24) - 1)


def _anchors(texts: list[bytes], offsets: list[int]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """``(text, anchor, stretch, start, windows, before)`` of texts of together fewer than ``BUFFER + WIDTH`` bytes.

    The anchor of a window of ``WIDTH`` bytes is the gram in it with the least hash, the first
    of equal ones: a function of the window's bytes alone, so equal windows have equal anchors
    at equal places. Windows that follow each other and share an anchor are a stretch.
    """
    whole = b"".join(texts)
    n = len(whole) - WIDTH + 1
    if n <= 0:
        return
    b = np.frombuffer(whole, dtype=np.uint8)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[b] * _POWERS[: len(b)], out=sums[1:])
    gram = (sums[GRAM:] - sums[:-GRAM]) * _INVERSE[: len(b) - GRAM + 1]
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(32)
    rank = (gram & ~_POSITION) | np.arange(len(gram), dtype=np.uint64)
    # Least rank of every span of windows: prefix and suffix minima of blocks of a span's length.
    blocks = np.full(-(-len(rank) // _SPAN) * _SPAN, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[: len(rank)] = rank
    blocks = blocks.reshape(-1, _SPAN)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n], ahead[_SPAN - 1 : _SPAN - 1 + n]) & _POSITION).astype(np.int64)
    start = 0
    for i, (text, offset) in enumerate(zip(texts, offsets, strict=True)):
        own = at[start : start + max(0, len(text) - WIDTH + 1)]
        if len(own):
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            ends = np.append(heads[1:], len(own))
            for lo, hi in zip(heads.tolist(), ends.tolist(), strict=True):
                p = int(own[lo])
                stretch = int.from_bytes(hashlib.blake2b(whole[start + lo : start + hi + WIDTH - 1], digest_size=8).digest(), "big", signed=True)
                yield i, int(gram[p].view(np.int64)), stretch, offset + lo, hi - lo, p - start - lo
        start += len(text)


def _stretches(texts: DataFrame) -> DataFrame:
    """``key, anchor, stretch, start, windows, before`` of all windows of ``texts(key, body)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, offsets, size = [], [], [], 0

        def rows() -> pa.RecordBatch:
            out = list(_anchors(parts, offsets))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array([keys[i] for i in columns[0]], pa.binary()), *(pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True))],
                names=["key", "anchor", "stretch", "start", "windows", "before"],
            )

        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = memoryview(body.as_buffer())
                # A long text is cut so that no window is lost and none comes twice.
                for offset in range(0, max(1, len(body) - WIDTH + 1), BUFFER):
                    part = body[offset : offset + BUFFER + WIDTH - 1].tobytes()
                    if parts and size + len(part) > BUFFER:
                        yield rows()
                        keys, parts, offsets, size = [], [], [], 0
                    keys.append(key)
                    parts.append(part)
                    offsets.append(offset)
                    size += len(part)
        if parts:
            yield rows()

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return texts.mapInArrow(run, "key binary, anchor long, stretch long, start int, windows int, before int")


def _sorted_shards(items: DataFrame) -> DataFrame:
    """``group, sub, runs`` of ``items(group, sub, body)``: the window ranges of each body that are repeated in its group.

    Groups of a worker fill shards; each shard's suffix array is made by induced sorting and read
    by its permuted common prefixes. Groups have at most ``GROUP`` bodies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[tuple[int, list[int], list[bytes]]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            groups.sort(key=lambda g: sum(map(len, g[2])))
            out = []
            for (group, subs, _), starts in zip(groups, repeated_starts([g[2] for g in groups], WIDTH, SHARD), strict=True):
                for sub, found in zip(subs, starts, strict=True):
                    if len(found):
                        cuts = np.flatnonzero(np.diff(found) > 1)
                        lo, hi = found[np.append(0, cuts + 1)], found[np.append(cuts, len(found) - 1)]
                        out.append((group, sub, [{"lo": int(x), "hi": int(y)} for x, y in zip(lo, hi, strict=True)]))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["group", "sub", "runs"])

        for batch in batches:
            for group, sub, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not groups or groups[-1][0] != group:
                    if size > HELD:
                        yield rows()
                        groups, size = [], 0
                    groups.append((group, [], []))
                groups[-1][1].append(sub)
                groups[-1][2].append(body)
                size += len(body)
        if groups:
            yield rows()

    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))]
    dealt = items.select("group", "sub", "body").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, "group long, sub long, runs array<struct<lo:int,hi:int>>")


def _part(body: Column, start: Column, length: Column) -> Column:
    return F.substring(body, start + 1, length)


def _halves(items: DataFrame) -> DataFrame:
    """Windows dealt by how far their anchor is behind their start, ``nearest`` to ``farthest``: each half grouped by the bytes that all its windows hold."""
    middle = F.floor((F.col("nearest") + F.col("farthest")) / 2).cast("int")
    out = []
    for a, b in ((F.col("nearest"), middle), (middle + 1, F.col("farthest"))):
        # Of an item's windows the k-th, from 0, starts ``before - k`` ahead of the anchor.
        cut = items.withColumns({"a": a, "b": b})
        cut = cut.withColumns({"first": F.greatest(F.col("before") - F.col("b"), F.lit(0)), "last": F.least(F.col("before") - F.col("a"), F.col("windows") - 1)})
        body = _part(F.col("body"), F.col("first"), F.col("last") - F.col("first") + WIDTH)
        core = _part(F.col("body"), F.col("before") - F.col("a"), WIDTH - (F.col("b") - F.col("a")))
        out.append(cut.where("first <= last").select(
            F.xxhash64("group", core, "a", "b").alias("group"), F.xxhash64(body).alias("sub"), "n", "anchor", "stretch", (F.col("low") + F.col("first")).alias("low"),
            (F.col("last") - F.col("first") + 1).alias("windows"), (F.col("before") - F.col("first")).alias("before"), body.alias("body"), F.col("a").alias("nearest"), F.col("b").alias("farthest"),
        ))
    return out[0].unionByName(out[1])


def _repeated(stretches: DataFrame, texts: DataFrame) -> DataFrame:
    """``anchor, stretch, lo, hi``: ranges of windows of a stretch that occur elsewhere too."""
    kinds = staged(stretches.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("key", "start", "windows", "before")).alias("one")), "passages-kinds")
    groups = kinds.groupBy("anchor").agg(F.count("*").alias("d"), F.sum("n").alias("total"), F.min("n").alias("least")).where("total > 1")
    shared = staged(kinds.join(groups, "anchor").select("anchor", "stretch", "n", "d", "least", "one.*"), "passages-shared")
    # One stretch, several times: all its windows are repeated. What different ones share is left to the shards.
    found = [shared.where("n > 1").select("anchor", "stretch", F.lit(0).alias("lo"), (F.col("windows") - 1).alias("hi"))]
    bodies = shared.where("d > 1 and least = 1").join(texts, "key").withColumn("body", _part(F.col("body"), F.col("start"), F.col("windows") + WIDTH - 1))
    items = staged(bodies.select(
        F.col("anchor").alias("group"), F.col("stretch").alias("sub"), "n", "anchor", "stretch", F.lit(0).alias("low"), "windows", "before", "body", F.lit(0).alias("nearest"), F.lit(WIDTH - GRAM).alias("farthest"), "d",
    ), "passages-items")
    while True:
        ready_ = (F.col("d") <= GROUP) & (F.col("farthest") - F.col("nearest") <= NARROW)
        several = items.where(ready_)
        runs = _sorted_shards(several.dropDuplicates(["group", "sub"]))
        own = several.select("group", "sub", "anchor", "stretch", "low").join(runs, ["group", "sub"]).select("anchor", "stretch", "low", F.explode("runs").alias("run"))
        found.append(staged(own.select("anchor", "stretch", (F.col("low") + F.col("run.lo")).alias("lo"), (F.col("low") + F.col("run.hi")).alias("hi")), "passages-runs"))
        wide = items.where(~ready_).drop("d")
        if wide.isEmpty():
            return _union(found)
        # At the latest when a half is one window, its group has one body.
        split = _halves(wide)
        subs = split.groupBy("group", "sub").agg(F.sum("n").alias("holders"))
        counts = subs.groupBy("group").agg(F.count("*").alias("d"), F.sum("holders").alias("total"), F.min("holders").alias("least")).where("total > 1").drop("total")
        items = split.join(subs.join(counts, "group"), ["group", "sub"])
        # Where all of a group occur several times there is nothing left to compare.
        items = staged(items.withColumn("body", F.when((F.col("d") > 1) & (F.col("least") == 1), F.col("body"))), "passages-items")
        found.append(items.where("holders > 1").select("anchor", "stretch", F.col("low").alias("lo"), (F.col("low") + F.col("windows") - 1).alias("hi")))
        items = items.where("body is not null").drop("holders", "least")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _without(body: bytes, spans: list) -> tuple[int, int, bytes]:
    """``(bytes removed, runs removed, what is left)``; spans may overlap."""
    kept, removed, runs, end = [], 0, 0, 0
    last = -1
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if lo > last:
            runs += 1
            kept.append(body[end:lo])
        removed += max(0, hi - max(lo, end))
        end, last = max(end, hi), max(last, hi)
    kept.append(body[end:])
    return removed, runs, b"".join(kept)


def without_repeats(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns, n_bytes, n_removed, n_spans, kept`` of every row of ``docs(text)``: texts without their repeated passages.

    A byte goes if a string of ``WIDTH`` bytes that covers it also starts at another place, of this text or
    of another; matches do not cross texts, overlaps count. ``kept`` is what is left, as bytes: a
    passage may begin or end inside a letter. ``n_spans`` counts the stretches that went.

    Null texts are empty; texts shorter than ``WIDTH`` lose nothing; copies, repeated rows included,
    lose everything if they are long enough; an empty table gives no rows. Columns not named are not looked at.
    """
    ready(docs.sparkSession)
    body = F.coalesce("text", F.lit("")).cast("binary")
    keyed = docs.select(*columns, body.alias("body")).withColumn("key", F.unhex(F.md5("body")))
    long = keyed.where(F.length("body") >= WIDTH).select("key", "body")
    stretches = staged(_stretches(long), "passages-stretches")
    texts = long.groupBy("key").agg(F.first("body").alias("body"))
    ranges = _repeated(stretches, texts)
    hits = stretches.select("key", "anchor", "stretch", "start").join(ranges, ["anchor", "stretch"])
    spans = hits.select("key", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + WIDTH).alias("hi")).distinct()
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # of one text

    @F.pandas_udf("n_removed long, n_spans long, kept binary")
    def cut(bodies: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = [(0, 0, None) if s is None else _without(bytes(b), list(s)) for b, s in zip(bodies, spans, strict=True)]
        return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])

    joined = keyed.join(spans, "key", "left")
    cut_ = joined.withColumn("c", cut(F.when(F.col("spans").isNotNull(), F.col("body")), "spans"))
    return cut_.select(*columns, F.length("body").cast("long").alias("n_bytes"), "c.n_removed", "c.n_spans", F.coalesce("c.kept", "body").alias("kept"))


SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS MATERIALIZED (
  SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT r, h, unnest(range(0, greatest(0, len(h) // 2 - 399))) AS i FROM texts)
), repeated AS (
  SELECT m FROM windows GROUP BY m HAVING count(*) > 1
), hits AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM windows SEMI JOIN repeated USING (m)
), runs AS (
  SELECT r, min(i) AS lo, max(i) + 400 AS hi
  FROM (SELECT *, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM hits)
  GROUP BY r, run
), gaps AS (
  SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS start FROM runs
), cut AS (
  SELECT t.r, sum(hi - lo) AS removed, count(*) AS spans, string_agg(substr(h, 2 * start + 1, 2 * (lo - start)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept
  FROM gaps g JOIN texts t ON t.r = g.r GROUP BY t.r
)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM texts t LEFT JOIN cut c ON c.r = t.r
"""
