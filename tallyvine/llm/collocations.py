"""Collocations: phrase counts kept as streams in prefix and in suffix order, merged in lockstep."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvine.llm.common import broadcast_if_few, ready, staged

#: Words of the longest phrase, least occurrences of a phrase, and phrases reported for a language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of text whose phrases a worker counts together before they are shuffled.
HELD = 8 << 20
#: Bits of the filter that every task is sent, whatever the corpus holds: 1 MB. It lets all
#: phrases through that may be frequent; when it fills up, more rows are counted, with the same result.
FILTER_BITS = 23
#: Parts of a language that are ranked apart before they meet.
RANKS = 64

#: Bytes of the buffer: between words, between pieces, between texts (in no UTF-8 text).
_SPACE, _BREAK, _END = 0x20, 0x0A, 0xFF
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_SPACES = re.compile(rb"  +")
_rng = np.random.default_rng(23)
_BYTES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(1, 1 << 63, (2, LONGEST), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD1342543DE82EF95)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of several texts, as places in one buffer, with two independent hashes of each."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        whole = _SPACES.sub(b" ", bytes([_END]).join(texts).translate(_TABLE)) + bytes([_END])
        self.buffer = np.frombuffer(whole, dtype=np.uint8)
        inside = (self.buffer != _SPACE) & (self.buffer != _BREAK) & (self.buffer != _END)
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        self.starts, self.ends = edge[0::2], edge[1::2]
        n = len(self.starts)
        #: Whether the next word is in the same piece: one space apart.
        self.joined = np.zeros(n, dtype=bool)
        if n:
            self.joined[:-1] = (self.starts[1:] - self.ends[:-1] == 1) & (self.buffer[self.ends[:-1]] == _SPACE)
        lengths = self.ends - self.starts
        of = np.repeat(np.arange(n), lengths)
        letters = self.buffer[inside]
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(letters)) - first[of] if n else np.zeros(0, dtype=np.int64)
        powers = np.cumprod(np.full(int(lengths.max()) if n else 1, _STEP, dtype=np.uint64))
        weights = powers[place]
        self.hashes = [_mixed(np.add.reduceat(_BYTES[i][letters] * weights, first)) if n else np.zeros(0, dtype=np.uint64) for i in range(2)]
        self.names = sorted(set(langs))
        at = {x: i for i, x in enumerate(self.names)}
        codes = np.asarray([at[x] for x in langs], dtype=np.int32)
        self.lang = codes[np.searchsorted(np.flatnonzero(self.buffer == _END), self.starts)]
        self.salts = np.asarray([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in self.names], dtype=np.uint64)

    def whole(self, k: int) -> np.ndarray:
        """Whether ``k`` words of one piece start at each word."""
        n, out = len(self.starts), np.zeros(len(self.starts), dtype=bool)
        if n >= k:
            out[: n - k + 1] = True
            for j in range(k - 1):
                out[: n - k + 1] &= self.joined[j : n - k + 1 + j]
        return out

    def phrase_hash(self, k: int, which: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on, within their language; of no meaning where they are not whole."""
        n, out = len(self.starts), self.salts[self.lang] + np.uint64(k)
        for j in range(min(k, n)):
            out[: n - j] += self.hashes[which][j:] * _PLACES[which][j]
        return _mixed(out)

    def passing(self, k: int, bits: np.ndarray | None) -> np.ndarray:
        """Where ``k`` words start that may be a frequent phrase."""
        found = self.whole(k)
        if bits is not None:
            slot = self.phrase_hash(k, 0) >> np.uint64(64 - FILTER_BITS)
            found &= (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        return found

    def counted(self, k: int, at: np.ndarray) -> pa.RecordBatch:
        """``lang, phrase, n`` of the phrases of ``k`` words that start at the words ``at``."""
        one, two = self.phrase_hash(k, 0)[at], self.phrase_hash(k, 1)[at]
        order = np.lexsort((two, one)) if len(at) else np.zeros(0, dtype=np.int64)
        one, two = one[order], two[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        heads = np.flatnonzero(new)
        n = np.diff(np.append(heads, len(at)))
        sample = at[order[heads]]
        lo, hi = self.starts[sample], self.ends[sample + k - 1]
        offsets = np.zeros(len(sample) + 1, dtype=np.int32)
        np.cumsum(hi - lo, out=offsets[1:])
        gather = np.arange(offsets[-1], dtype=np.int64) + np.repeat(lo - offsets[:-1], hi - lo)
        phrases = pa.StringArray.from_buffers(len(sample), pa.py_buffer(offsets), pa.py_buffer(self.buffer[gather]))
        langs = pa.array(self.names, pa.string()).take(pa.array(self.lang[sample]))
        return pa.RecordBatch.from_arrays([langs, phrases, pa.array(n, pa.int64())], names=["lang", "phrase", "n"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The words of some ``HELD`` bytes at a time; one longer text is a buffer of its own."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            body = memoryview(text.as_buffer()).tobytes() if text.is_valid else b""
            if texts and size + len(body) > HELD:
                yield Words(texts, langs)
                texts, langs, size = [], [], 0
            texts.append(body)
            langs.append(lang)
            size += len(body) + 1
    if texts:
        yield Words(texts, langs)


def _counts(texts: DataFrame, k: int, bits: np.ndarray | None) -> DataFrame:
    """``lang, phrase, n`` of phrases of ``k`` words whose two phrases of ``k - 1`` words pass the filter.

    For one word there is a row with a null phrase that counts all words of the language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _held(batches):
            if k == 1:
                n = np.bincount(words.lang, minlength=len(words.names))
                yield pa.RecordBatch.from_arrays([pa.array(words.names, pa.string()), pa.nulls(len(n), pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])
                at = np.arange(len(words.starts))
            else:
                low = words.passing(k - 1, bits)
                at = np.flatnonzero(low[:-1] & low[1:] & words.joined[:-1])
            yield words.counted(k, at)

    return texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _filter(frequent: DataFrame, k: int) -> np.ndarray:
    """A bit for the hash of every frequent phrase: at most 2^FILTER_BITS / 64 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _held(batches):
            at = np.flatnonzero(words.whole(k))
            slot = np.unique(words.phrase_hash(k, 0)[at] >> np.uint64(64 - FILTER_BITS))
            word, first = np.unique(slot >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (slot & np.uint64(63)), first) if len(slot) else slot
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], names=["slot", "mask"])

    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    table = frequent.select("lang", "phrase").mapInArrow(run, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    out[table["slot"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``(lang, words, f)`` of all phrases of up to ``longest`` words that occur ``least`` times, and ``(lang, n)``.

    Level by level: a phrase can only be frequent if its first and its last words without one are.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    levels, bits, totals = [], None, None
    for k in range(1, longest + 1):
        found = staged(_counts(texts, k, bits).where((F.col("n") >= least) | F.col("phrase").isNull()), f"phrases-{k}")
        if k == 1:
            totals = found.where("phrase is null and n > 0").select("lang", "n")
            found = found.where("phrase is not null")
        levels.append(found)
        if k < longest:
            if found.isEmpty():
                break
            bits = _filter(found, k)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.select("lang", F.split("phrase", " ").alias("words"), F.col("n").alias("f")), totals


def _stream(phrases: DataFrame, label: str) -> DataFrame:
    """``lang, words, f, firsts, absorbed`` of all phrases of two words or more, read in the order of their words.

    In that order a phrase follows its own beginnings, so a reader that keeps the counts
    along the current path, one for each word, has the counts of all of them: ``firsts``, for
    1, 2, ... words. ``absorbed``: its beginning without the last word occurs only in it.

    The order is cut into ranges, however many phrases begin alike; the beginnings that
    a range's first phrase needs are handed to it, a few rows a range.
    """
    ranges = staged(phrases.repartitionByRange("lang", "words").withColumn("part", F.spark_partition_id()), f"{label}-ranges")
    heads = ranges.groupBy("part").agg(F.min(F.struct("lang", "words")).alias("head")).select("part", "head.*").where(F.size("words") > 1)
    # At most LONGEST - 1 rows for each shuffle partition.
    lead = heads.select("part", "lang", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.slice("words", 1, k))).alias("words"))
    handed = phrases.join(F.broadcast(lead), ["lang", "words"]).select("part", "lang", "words", "f", F.lit(True).alias("handed"))
    dealt = ranges.withColumn("handed", F.lit(False)).unionByName(handed).repartition("part").sortWithinPartitions("part", "lang", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path, counts = None, [], []
        for batch in batches:
            out: list[tuple] = []
            for part, lang, words, f, is_handed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if where != (part, lang):
                    where, path, counts = (part, lang), [], []
                k = len(words) - 1
                path, counts = [*words], [*counts[:k], f]
                if k and not is_handed:
                    out.append((lang, words, f, counts[:k], counts[k - 1] == f))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "words", "f", "firsts", "absorbed"])

    kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.bool_()]
    return staged(dealt.select("part", "lang", "words", "f", "handed").mapInArrow(run, "lang string, words array<string>, f long, firsts array<long>, absorbed boolean"), label)


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (l * r)), exact to 38 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * wide(a) * wide(n)).cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def scored_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``lang, words, phrase, a, l, r, n, score`` of every frequent phrase of two words or more that no longer one absorbs."""
    phrases, totals = frequent_phrases(docs, least, longest)
    forward = _stream(phrases, "phrases-forward")
    backward = _stream(phrases.withColumn("words", F.reverse("words")), "phrases-backward").withColumn("words", F.reverse("words"))
    long = F.size("words") > 2
    absorbed = forward.where(F.col("absorbed") & long).select("lang", F.slice("words", F.lit(1), F.size("words") - 1).alias("words")).unionByName(
        backward.where(F.col("absorbed") & long).select("lang", F.slice("words", F.lit(2), F.size("words") - 1).alias("words"))
    ).distinct()
    right = backward.select("lang", "words", F.col("firsts").alias("lasts"))
    both = forward.select("lang", "words", F.col("f").alias("a"), "firsts").hint("merge").join(right, ["lang", "words"])
    left = both.hint("merge").join(absorbed, ["lang", "words"], "left_anti").join(broadcast_if_few(totals), "lang")
    cuts = F.transform("firsts", lambda l, i: F.struct(  # noqa: E741
        _score(F.col("a"), F.col("n"), l, F.get("lasts", F.size("words") - 2 - i)).alias("score"), i.alias("cut"), l.alias("l"), F.get("lasts", F.size("words") - 2 - i).alias("r"),
    ))
    best = left.select("lang", "words", "a", "n", F.array_min(cuts).alias("best"))
    return best.select("lang", "words", F.array_join("words", " ").alias("phrase"), "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` collocations of every language of ``docs(lang, text)``.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces, and those at spaces and
    tabs into words. A phrase of 2 to ``longest`` words that occurs at least ``least`` times scores by
    its weakest cut, ``1000 * a * n / (l * r)``, and is dropped where a longer phrase has all its occurrences.

    A null lang is ``und``; null and empty texts have no words; repeated rows count again;
    an empty table gives no rows; other columns are not looked at. A text is held whole by the worker that counts it.
    """
    ready(docs.sparkSession)
    found = scored_phrases(docs, least, longest)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANKS))
    first = found.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), placed AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded
), counts AS MATERIALIZED (
  SELECT lang, w[i : i + k - 1] AS p, count(*) AS f FROM placed, range(1, 6) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT * FROM counts WHERE len(p) > 1
), absorbed AS (
  SELECT c.lang, part.p FROM candidates c, LATERAL (SELECT c.p[:len(c.p) - 1] AS p UNION SELECT c.p[2:]) part JOIN counts s ON s.lang = c.lang AND s.p = part.p AND s.f = c.f
), cuts AS (
  SELECT c.lang, c.p, c.f, x.k, a.f AS l, b.f AS r, t.n, (1000::HUGEINT * c.f * t.n) // (a.f::HUGEINT * b.f) AS score
  FROM candidates c, range(1, 5) x(k), counts a, counts b, totals t
  WHERE x.k < len(c.p) AND a.lang = c.lang AND a.p = c.p[:x.k] AND b.lang = c.lang AND b.p = c.p[x.k + 1:] AND t.lang = c.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM absorbed d WHERE d.lang = b.lang AND d.p = b.p)
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, f AS a, l, r, n, score::BIGINT AS score FROM kept
)
SELECT * FROM ranked WHERE rank <= 2000
"""
