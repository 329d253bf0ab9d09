"""Near-duplicate documents: Chosen-Path set similarity join over minhashes of word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvine.llm.common import broadcast_if_few, components, drawn_together, staged, words
from tallyvine.session import discard

#: Words in a shingle; a link needs ``100 * both >= percent * either``.
SHINGLE, PERCENT = 5, 85
#: Minhashes of a document, independent trees, and levels of a tree.
HASHES, TREES, LEVELS = 128, 16, 5
#: Percent of nodes that branch by a second token: 1 / 0.85 - 1, so a linked pair is expected to meet again at every level.
SECOND = 18
#: Nodes of up to so many documents are compared exhaustively, by sketches of 64 bytes.
SMALL = 2048
#: Documents, and their shingles, on one side of a block that is compared with others.
CLUSTER_ROWS, CLUSTER_SHINGLES = 4096, 1_000_000
#: Documents of a cluster of several blocks that all its others are compared with first.
GUIDES = 8
#: A sketch has 4 bits of every minhash. How many minhashes may differ in it: 4.5 standard
#: deviations more than the least similarity gives, so a link is passed over in 3 of a million cases.
NIBBLES = HASHES // 16


def _most_different(percent: int) -> int:
    expected = (1 - percent / 100) * 15 / 16
    return int(HASHES * expected + 4.5 * (HASHES * expected * (1 - expected)) ** 0.5) + 1


_rng = np.random.default_rng(5)
_MULTIPLY = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_PLACES = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_hashes(text: Column) -> Column:
    return F.transform(words(F.translate(text, *_LOWER)), lambda w: F.xxhash64(w))


def shingle_set(w: np.ndarray) -> np.ndarray:
    """Hashes of the distinct shingles, from the hashes of the words."""
    w = w.astype(np.int64).view(np.uint64)
    if len(w) >= SHINGLE:
        n = len(w) - SHINGLE + 1
        mixed = sum((w[k : k + n] * _PLACES[k] for k in range(SHINGLE)), np.zeros(n, dtype=np.uint64))
    elif len(w):
        mixed = np.asarray([(w * _PLACES[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))])
    else:
        return w
    mixed ^= mixed >> np.uint64(31)
    mixed *= _GOLDEN
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def sketch(hashes: np.ndarray) -> tuple[int, bytes, list[int] | None, list[int] | None]:
    """``(distinct shingles, key of the set, minhashes of 32 bits, sketch words)`` from word hashes.

    With fewer bits, unlike documents would share a node by chance, the more of them the larger the corpus.
    """
    s = shingle_set(hashes)
    key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    if not len(s):
        return 0, key, None, None
    low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 4096):  # bounds the matrix for very long texts
        part = s[at : at + 4096]
        for i in range(0, HASHES, 32):
            m = part[:, None] * _MULTIPLY[i : i + 32] + _ADD[i : i + 32]
            m ^= m >> np.uint64(29)
            np.minimum(low[i : i + 32], m.min(axis=0), out=low[i : i + 32])
    low *= _GOLDEN
    nibbles = (low >> np.uint64(60)).astype(np.uint8)
    bits = ((nibbles[0::2] << 4) | nibbles[1::2]).view(np.int64)
    return len(s), key, ((low >> np.uint64(28)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32).tolist(), bits.tolist()


def _prepared(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Documents with a row number, the key of their shingle set and its sketch, written once."""

    @F.pandas_udf("n_shingles long, set_key binary, minhashes array<int>, bits array<bigint>")
    def sketched(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([sketch(np.asarray(h)) for h in part], columns=["n_shingles", "set_key", "minhashes", "bits"])

    others = [c for c in keep if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", *others, word_hashes(F.col("text")).alias("hashes"), F.monotonically_increasing_id().alias("row"))
    # Used twice, the hashes are a column of their own when the sketch is taken.
    marked = rows.select("row", "doc_id", "text", *others, F.size("hashes").alias("n_places"), sketched("hashes").alias("s"))
    return staged(marked.select("row", "doc_id", "text", *others, "n_places", "s.n_shingles", "s.set_key", "s.minhashes", "s.bits"), "near-docs")


def _coordinates(node: Column) -> Column:
    """The tokens that a node branches by: one, and for some nodes a second; drawn from the node's own hash."""
    pick = lambda seed: F.pmod(F.xxhash64(node, F.lit(seed)), F.lit(HASHES)).cast("int")
    return F.when(F.pmod(F.xxhash64(node, F.lit(3)), F.lit(100)) < SECOND, F.array_distinct(F.array(pick(1), pick(2)))).otherwise(F.array(pick(1)))


def _child(node: Column, coordinate: Column, minhashes: Column) -> Column:
    return F.xxhash64(node, coordinate, F.get(minhashes, coordinate))


def _differ(x: Column, y: Column) -> Column:
    """How many minhashes differ in two sketches."""
    out = F.lit(0)
    for i in range(NIBBLES):
        d = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        for s in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, s))
        out = out + F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    return out


def _may_link(n: Column, m: Column, x: Column, y: Column, percent: int) -> Column:
    """By the sizes of two sets, which is certain, then by their sketches."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (_differ(x, y) <= _most_different(percent))


class _Forest:
    """Which rows of a cell are joined already."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[i] = j
        return i != j


def _likely_pairs(batch: dict[str, np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """``(differing minhashes, i, partners of i)`` of pairs of a cell that may be linked, by size and sketch; of one side with the other where there are two."""
    bits, n, group, side = batch["bits"], batch["n_shingles"], batch["group"], batch["side"]
    most = _most_different(percent)
    for i in range(len(n) - 1):
        m = n[i + 1 :]
        fits = (100 * np.minimum(m, n[i]) >= percent * np.maximum(m, n[i])) & (group[i + 1 :] != group[i])
        fits &= (side[i + 1 :] != side[i]) | (side[i] == 0)
        j = np.flatnonzero(fits)
        x = bits[i + 1 + j] ^ bits[i]
        differ = ((x & 15) != 0).sum(axis=1) + ((x >> 4) != 0).sum(axis=1)
        near = differ <= most
        if near.any():
            yield differ[near].astype(np.int16), i, i + 1 + j[near]


def _in_cells(rows: DataFrame, percent: int, exact: bool) -> DataFrame:
    """``(a, b)``: pairs that span what is alike within each cell of ``rows(cell, row, group, side, n_shingles, bits)``.

    A cell is compared exhaustively, but of pairs that only close a circle none is
    returned, so the result is never longer than the cells. Alike is by sketch; with
    ``exact`` by the full shingle sets, from ``text``. Rows of a cell follow each other,
    and a worker holds no more than one cell.
    """

    def pairs(held: list[tuple]) -> list[tuple[int, int]]:
        row, group, side, n, bits, *rest = zip(*held, strict=True)
        cell = {
            "bits": np.asarray([np.asarray(x, dtype=np.int64).view(np.uint8) for x in bits]), "n_shingles": np.asarray(n),
            "group": np.asarray(group), "side": np.asarray(side),
        }
        forest, out = _Forest(len(row)), []
        if not exact:
            for _, i, partners in _likely_pairs(cell, percent):
                out += [(row[i], row[j]) for j in partners.tolist() if forest.join(i, j)]
            return out
        likely = [(differ, np.full(len(j), i, dtype=np.int32), j.astype(np.int32)) for differ, i, j in _likely_pairs(cell, percent)]
        if not likely:
            return out
        differ, left, right = (np.concatenate(c) for c in zip(*likely, strict=True))
        order = np.argsort(differ, kind="stable")
        sets: dict[int, np.ndarray] = {}
        for at in range(0, len(order), 1 << 14):  # a few pairs at a time as Python numbers
            some = order[at : at + (1 << 14)]
            for i, j in zip(left[some].tolist(), right[some].tolist(), strict=True):
                if forest.find(i) == forest.find(j):
                    continue
                for k in (i, j):
                    if k not in sets:
                        sets[k] = shingle_set(np.asarray(rest[0][k]))
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    forest.join(i, j)
                    out.append((row[i], row[j]))
        return out

    names = ["cell", "row", "group", "side", "n_shingles", "bits", *(["hashes"] if exact else [])]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held = None, []
        for batch in batches:
            out = []
            for key, *values in zip(*(batch[c] for c in names), strict=True):
                if key != cell:
                    out += pairs(held) if len(held) > 1 else []
                    cell, held = key, []
                held.append(tuple(values))
            yield pd.DataFrame(out, columns=["a", "b"])
        if len(held) > 1:
            yield pd.DataFrame(pairs(held), columns=["a", "b"])

    dealt = rows.repartition("cell").sortWithinPartitions("cell")
    if exact:
        dealt = dealt.withColumn("hashes", word_hashes(F.col("text")))
    return dealt.select(*names).mapInPandas(stream, "a long, b long")


def _blocks(rows: DataFrame, by: str, k: Column) -> DataFrame:
    """Rows dealt into ``k`` blocks of their group, and every block with every other: ``cell`` and ``side``."""
    own = rows.withColumn("k", k).withColumn("block", F.pmod(F.xxhash64("row", F.lit(9)), F.col("k")).cast("int"))
    meets = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    return meets.withColumns({"side": side, "cell": F.xxhash64(by, F.least("block", "other"), F.greatest("block", "other"))})


def _likely_links(sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` that span, with the wanted recall, what is alike by sketch: the trees of the chosen paths.

    One level at a time, all trees together. Rows already joined need no further
    comparison with each other; a node of one group is done. A small node is compared
    exhaustively. The members of a large one are compared with a pivot, then it branches.
    What is still large after the last level is compared in blocks, each with every other.
    """
    roots = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.lit(0)))
    first = sets.select("row", "minhashes", F.explode(roots).alias("root")).select("row", "minhashes", "root", F.explode(_coordinates(F.col("root"))).alias("c"))
    level = first.select(_child(F.col("root"), F.col("c"), F.col("minhashes")).alias("node"), "row", F.col("row").alias("group"))
    sketches = sets.select("row", "bits", "n_shingles")
    groups = None
    level_written = None
    for depth in range(LEVELS):
        level = level.distinct() if depth else level
        sizes = level.groupBy("node").agg(
            F.count("*").alias("n"), F.min("group").alias("g0"), F.max("group").alias("g1"),
            F.min(F.struct((F.xxhash64("row", F.lit(depth)) if depth else F.col("row")).alias("rank"), "row")).alias("pivot"),
        ).where("n > 1 and g0 <> g1").select("node", "n", F.col("pivot.row").alias("pivot"))
        alive = staged(level.join(sizes, "node"), f"near-level{depth}")
        if level_written is not None:
            discard(level_written)
        small = alive.where(F.col("n") <= SMALL).join(sketches, "row").withColumns({"side": F.lit(0), "cell": F.col("node")})
        found = [staged(_in_cells(small, percent, False).distinct(), f"near-small{depth}")]
        large = alive.where(F.col("n") > SMALL)
        more = not large.isEmpty()
        if more:
            to_pivot = large.where("row <> pivot").select(F.col("row").alias("a"), F.col("pivot").alias("b")).distinct()
            near = to_pivot.join(sketches.select(F.col("row").alias("a"), F.col("bits").alias("x"), F.col("n_shingles").alias("n")), "a").join(
                sketches.select(F.col("row").alias("b"), F.col("bits").alias("y"), F.col("n_shingles").alias("m")), "b"
            ).where(_may_link(F.col("n"), F.col("m"), F.col("x"), F.col("y"), percent)).select("a", "b")
            found.append(staged(near, f"near-star{depth}"))
        if not more:
            discard(alive)
            return _joined(groups, found, "near-groups")
        # Rows of one label hang together; not all that hang together have one label yet, which costs comparisons only.
        groups = _joined(groups, found, f"near-groups{depth}", whole=False)
        labels = groups.groupBy(F.col("a").alias("row")).agg(F.min("b").alias("root"))
        grouped = large.join(labels, "row", "left").select("node", "row", F.coalesce("root", "row").alias("group"))
        several = grouped.groupBy("node").agg(F.count("*").alias("n"), F.min("group").alias("g0"), F.max("group").alias("g1")).where("g0 <> g1").select("node", "n")
        kept = grouped.join(several, "node")
        if depth + 1 == LEVELS:
            rest = _blocks(kept.join(sketches, "row"), "node", F.ceil(F.col("n") / CLUSTER_ROWS).cast("int"))
            found = [staged(_in_cells(rest, percent, False).distinct(), "near-rest")]
            discard(alive)
            return _joined(groups, found, "near-groups")
        branched = kept.join(sets.select("row", "minhashes"), "row").select("node", "row", "group", "minhashes", F.explode(_coordinates(F.col("node"))).alias("c"))
        level = level_written = staged(branched.select(_child(F.col("node"), F.col("c"), F.col("minhashes")).alias("node"), "row", "group"), f"near-branch{depth}")
        discard(alive)
    raise AssertionError("the last level returns")


def _joined(groups: DataFrame | None, links: list[DataFrame], label: str, whole: bool = True) -> DataFrame:
    """``(a, b)``: each row that is in a group and the group's least row, or with ``whole`` unset edges that join the same rows.

    Older groups and new links make them; both are discarded.
    """
    old = links if groups is None else [groups, *links]
    if whole:
        out = staged(components(_all(old), "near-cc").select(F.col("node").alias("a"), F.col("root").alias("b")), label)
    else:
        out = drawn_together(_all(old), label)
    for one in old:
        discard(one)
    return out


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _links(sets: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Confirmed ``(a, b)``: each linked document and the least one that it hangs together with.

    What hangs together by likely links is a cluster; a likely pair is confirmed on full
    sets, if nothing in its block joins it already. A cluster of one block is compared there. A
    larger one is first dealt into blocks that all hold the same few guides, so its rows
    are sent once; most of a group of near copies hangs together then. Only what is not
    in the cluster's largest group by then, the rest, is compared further: with itself and with the
    largest group, block by block, and no pair within a group.
    """
    clusters = staged(_likely_links(sets, percent).select(F.col("a").alias("row"), F.col("b").alias("cluster")), "near-clusters")
    members = clusters.join(sets.select("row", "bits", "n_shingles"), "row")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("words"))
    sizes = sizes.withColumn("k", F.greatest(F.ceil(F.col("n") / CLUSTER_ROWS), F.ceil(F.col("words") / CLUSTER_SHINGLES)).cast("int")).drop("n", "words")
    dealt = staged(members.join(sizes, "cluster").withColumns({
        "block": F.pmod(F.xxhash64("row", F.lit(9)), F.col("k")).cast("int"), "group": F.col("row"), "side": F.lit(0),
    }), "near-dealt")
    guides = dealt.where("k > 1").groupBy("cluster", "k").agg(F.min_by("row", F.xxhash64("row", F.lit(0))).alias("g0"), *[
        F.min_by("row", F.xxhash64("row", F.lit(i))).alias(f"g{i}") for i in range(1, GUIDES)
    ])
    named = guides.select("cluster", "k", F.explode(F.array_distinct(F.array(*[f"g{i}" for i in range(GUIDES)]))).alias("row"))
    everywhere = named.join(dealt.drop("cluster", "k", "block"), "row").select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"))
    first = dealt.unionByName(everywhere).dropDuplicates(["row", "cluster", "block"]).withColumn("cell", F.xxhash64("cluster", "block"))
    groups = _joined(None, [staged(_in_cells(first.join(texts, "row"), percent, True), "near-links")], "near-linked")

    # What is left of clusters of several blocks.
    large = dealt.where("k > 1").drop("group", "side", "block")
    if large.isEmpty():
        return groups
    own = large.join(groups.select(F.col("a").alias("row"), F.col("b").alias("root")), "row", "left").withColumn("group", F.coalesce("root", "row")).drop("root")
    counts = own.groupBy("cluster", "group").agg(F.count("*").alias("m"))
    leading = counts.groupBy("cluster").agg(F.max_by("group", F.struct("m", "group")).alias("lead"), F.sum("m").alias("n"), F.max("m").alias("most")).where("most < n").select("cluster", "lead")
    marked = staged(own.join(leading, "cluster").withColumn("rest", F.col("group") != F.col("lead")), "near-left")
    share = marked.groupBy("cluster", "rest").agg(F.greatest(F.ceil(F.count("*") / CLUSTER_ROWS), F.ceil(F.sum("n_shingles") / CLUSTER_SHINGLES)).cast("int").alias("parts"))
    shares = share.groupBy("cluster").agg(F.max(F.when(F.col("rest"), F.col("parts"))).alias("rests"), F.max(F.when(~F.col("rest"), F.col("parts"))).alias("leads"))
    placed = marked.drop("k", "lead").join(shares, "cluster").withColumn("block", F.pmod(F.xxhash64("row", F.lit(11)), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("leads"))).cast("int"))
    meets = placed.where("not rest").select("*", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("other")).select(
        "row", "group", "n_shingles", "bits", F.lit(1).alias("side"), F.xxhash64("cluster", F.lit("lead"), "block", "other").alias("cell")
    ).unionByName(placed.where("rest").select("*", F.explode(F.sequence(F.lit(0), F.col("leads") - 1)).alias("other")).select(
        "row", "group", "n_shingles", "bits", F.lit(2).alias("side"), F.xxhash64("cluster", F.lit("lead"), "other", "block").alias("cell")
    )).unionByName(_blocks(placed.where("rest").select("cluster", "row", "group", "n_shingles", "bits", "rests"), "cluster", F.col("rests")).select(
        "row", "group", "n_shingles", "bits", "side", F.xxhash64("cell", F.lit("rest")).alias("cell")
    ))
    return _joined(groups, [staged(_in_cells(meets.join(texts, "row"), percent, True), "near-links")], "near-linked")


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = (), percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, first`` (and ``keep``) of every row of ``docs(doc_id, text)``.

    Documents are linked if their sets of distinct 5-word shingles (A-Z lower-cased) have
    ``100 * intersection >= percent * union``. Equal sets are found by their hash and join as
    one; all other links are searched by chosen paths and confirmed on full sets.
    Only links that join a group are confirmed, not all pairs in it.

    Null, empty and blank texts have the empty set and are linked with nothing. A null
    doc_id never names a component, unless all its members have none (then null, and
    kept is false). Repeated ids and repeated rows are documents of their own: ``first``
    marks exactly one row of each group. Columns not in ``keep`` are not looked at.
    """
    rows = _prepared(docs, keep)
    filled = rows.where("n_shingles > 0")
    by_key = staged(filled.groupBy("set_key").agg(F.min("row").alias("rep"), F.count("*").alias("n")), "near-keys")
    sets = filled.select("row", "minhashes", "bits", "n_shingles").join(broadcast_if_few(by_key.select(F.col("rep").alias("row"))), "row", "left_semi")
    sets = staged(sets, "near-sets")
    roots = _links(sets, rows.select("row", "text"), percent).select(F.col("a").alias("node"), F.col("b").alias("root"))
    keyed = by_key.join(roots, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("root", "rep").alias("root"))
    slim = rows.select("row", "doc_id", "n_shingles", "set_key")
    member = slim.where("n_shingles > 0").join(keyed, "set_key").select("row", "doc_id", "n_shingles", "root").unionByName(
        slim.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("row").alias("root"))
    )
    member = staged(member, "near-members")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("lead")
    heads = member.groupBy("root").agg(lead).select("root", F.col("lead.doc_id").alias("component_id"), F.col("lead.row").alias("head"))
    out = member.join(heads, "root").select(
        "row", "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), (F.col("row") == F.col("head")).alias("first"),
    )
    if keep:
        out = out.join(rows.select("row", *[c for c in keep if c != "doc_id"]), "row")
    return out.drop("row")


def deduplicated(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars"), percent: int = PERCENT) -> DataFrame:
    """One row of every group of near-duplicates, with the given columns."""
    return near_duplicates(docs, columns, percent).where("first").select(*columns)
