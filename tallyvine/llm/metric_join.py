"""Embedding near-duplicates: an exact range join with pivots and the triangle inequality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvine.llm.common import components, staged

#: A pair is linked if its cosine, in double precision, is at least this.
COSINE = 0.93
#: Pivots of a label: one for so many vectors, but at most MOST_PIVOTS.
VECTORS_A_PIVOT, MOST_PIVOTS = 256, 64
#: Rows of one side of a comparison; larger cells are compared block by block.
BLOCK = 2048
#: Slack for rounding in distances; candidates only, links are decided by the cosine itself.
SLACK = 1e-6


def _unit(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def usable(rows: DataFrame) -> DataFrame:
    """``row, vec_id, label, vector`` with ``ok``: labelled, of finite components, not zero."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    ids = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector")).withColumn("row", F.monotonically_increasing_id())
    return ids.withColumn("ok", F.coalesce(ok, F.lit(False)))


def _pivots(distinct: DataFrame) -> DataFrame:
    """``label, length, pivots``: the vectors with the smallest hashes of each label and length, at most MOST_PIVOTS."""
    key = ["label", F.size("vector").alias("length")]
    sizes = distinct.groupBy(*key).agg(F.count("*").alias("n"))
    # A vector is drawn with a chance that gives about the wanted number of its label.
    wanted = F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("n") / VECTORS_A_PIVOT))
    drawn = distinct.select("rep", "vector", *key).join(sizes, ["label", "length"]).where(
        F.pmod(F.xxhash64("rep", F.lit(17)), F.lit(1 << 30)) * F.col("n") < 2 * wanted * F.lit(1 << 30)
    )
    few = drawn.groupBy("label", "length").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("rep").alias("h"), "vector"))), 1, MOST_PIVOTS).alias("p"))
    every = sizes.join(few, ["label", "length"], "left")
    return every.select("label", "length", F.coalesce(F.transform("p", lambda x: x["vector"]), F.array().cast("array<array<double>>")).alias("pivots"))


def _distances(distinct: DataFrame) -> DataFrame:
    """Every vector with its distance to each pivot of its label."""

    @F.pandas_udf("array<double>")
    def far(vectors: pd.Series, pivots: pd.Series) -> pd.Series:
        out = []
        for v, p in zip(vectors, pivots, strict=True):
            if len(p):
                u, q = _unit([v]), _unit(p)
                out.append(np.sqrt(np.maximum(0, 2 - 2 * (q @ u[0]))))
            else:
                out.append(np.zeros(1))
        return pd.Series(out, dtype=object)

    keyed = distinct.withColumn("length", F.size("vector")).join(_pivots(distinct), ["label", "length"])
    return keyed.select("label", "length", "rep", "copies", "vector", far("vector", "pivots").alias("far"))


def _cells(rows: DataFrame, cosine: float) -> DataFrame:
    """Each vector at home in the cell of its nearest pivot, and as a guest where a partner may live.

    For a vector at ``d`` from pivot p and a cell of radius ``r``: no member of the cell is
    within ``reach`` if ``d > r + reach``, nor if ``d > nearest + 2 * reach`` (members are
    nearer to p than to any other pivot). Guests only meet homes of smaller pivots, so a
    pair of two cells is compared once.
    """
    reach = (2 - 2 * cosine) ** 0.5 + SLACK
    home = rows.withColumn("nearest", F.array_min("far")).withColumn("home", (F.array_position("far", F.col("nearest")) - 1).cast("int"))
    home = staged(home, "metric-home")
    cells = home.groupBy("label", "length", "home").agg(F.max("nearest").alias("radius"), F.count("*").alias("members"))
    sizes = cells.groupBy("label", "length").agg(F.map_from_entries(F.collect_list(F.struct("home", F.struct("radius", "members")))).alias("cells"))  # MOST_PIVOTS entries
    at = home.join(sizes, ["label", "length"])
    targets = F.filter(F.map_keys("cells"), lambda c: (c <= F.col("home")) & (
        F.get("far", c) <= F.least(F.element_at("cells", c)["radius"] + reach, F.col("nearest") + 2 * reach)
    ))
    return at.withColumn("cell", F.explode(targets)).select(
        "label", "length", "cell", "rep", "copies", "vector", (F.col("cell") == F.col("home")).alias("native"), F.element_at("cells", F.col("cell"))["members"].alias("members")
    )


FOUND = "rep long, links long, root long"


def _compared(cells: DataFrame, cosine: float) -> DataFrame:
    """``rep, links, root``: how many vectors a row is linked with in one block of one cell, and the least rep it reaches there."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)).cast("int")
    cells = cells.withColumn("k", blocks).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(23)), F.col("k")).cast("int"))
    # Residents meet every block of residents once; guests are dealt over as many groups of guests as there are residents' blocks.
    natives = cells.where("native").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    inner = natives.select("label", "length", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "rep", "copies", "vector")
    guests = cells.where("not native")
    crowd = guests.groupBy("label", "length", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g"))
    at = ["label", "length", "cell"]
    out = guests.join(crowd, at).select(*at, F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"), (-1 - F.pmod(F.xxhash64("rep", F.lit(29)), F.col("g"))).cast("int").alias("j"), F.lit(2).alias("side"), "rep", "copies", "vector")
    facing = cells.where("native").join(crowd, at).select(*at, F.col("own").alias("i"), F.explode(F.sequence(F.lit(1), F.col("g"))).alias("j"), F.lit(1).alias("side"), "rep", "copies", "vector")
    facing = facing.withColumn("j", -F.col("j"))
    dealt = inner.unionByName(out).unionByName(facing)

    def link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "rep"])
        rep, copies, side = group.rep.to_numpy(), group.copies.to_numpy(), group.side.to_numpy()
        empty = pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        same = side[0] == 0
        x = np.arange(len(rep)) if same else np.flatnonzero(side == 1)
        y = x if same else np.flatnonzero(side == 2)
        if not len(x) or not len(y):
            return empty
        unit = _unit(group.vector)
        links, root, edges = np.zeros(len(rep), dtype=np.int64), np.arange(len(rep)), []
        for start in range(0, len(x), 512):
            part = x[start : start + 512]
            hit = unit[part] @ unit[y].T >= cosine
            if same:
                hit[np.arange(len(part)), np.arange(start, start + len(part))] = False
            links[part] += hit @ copies[y]
            if not same:
                links[y] += copies[part] @ hit
            a, b = np.nonzero(hit)
            edges.append((part[a], y[b]))
        a, b = (np.concatenate(e) for e in zip(*edges, strict=True))
        while True:  # labels sink along links until none changes
            before = root.copy()
            np.minimum.at(root, a, root[b])
            np.minimum.at(root, b, root[a])
            root = root[root]
            if (root == before).all():
                break
        least = pd.Series(rep).groupby(root).transform("min").to_numpy()
        seen = links > 0
        return pd.DataFrame({"rep": rep[seen], "links": links[seen], "root": least[seen]})

    return dealt.groupBy(*at, "i", "j").applyInPandas(link, FOUND)


def linked(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``rows(vec_id, embedding, label)``.

    Two rows are linked if their labels are equal and their cosine is at least ``cosine``.
    Equal vectors of a label are compared as one and counted as many. Rows with a null
    label, or a vector that is null, empty, zero or has a null or non-finite component,
    link with nothing and are their own component; so do vectors of another length.
    Repeated ids and rows are rows of their own; a null vec_id never names a component
    that has another. Other columns are not looked at; no rows, no result.
    """
    all_ = staged(usable(rows), "metric-rows")
    good = all_.where("ok")
    distinct = good.groupBy("label", "vector").agg(F.min("row").alias("rep"), F.count("*").alias("copies"))
    distinct = staged(distinct, "metric-distinct")
    found = staged(_compared(_cells(_distances(distinct), cosine), cosine), "metric-found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "metric-cc")
    known = distinct.join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")
    )
    placed = good.select("row", "vec_id", "label", "vector").join(known, ["label", "vector"]).select("row", "vec_id", "n_links", "root")
    alone = all_.where("not ok").select("row", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("row").alias("root"))
    placed = staged(placed.unionByName(alone), "metric-placed")
    heads = placed.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return placed.join(heads, "root").select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


SQL = """
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v,
         label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
links AS (
  SELECT a.r AS a, b.r AS b FROM rows a JOIN rows b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
  WHERE a.ok AND b.ok AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT r AS a, r AS b FROM rows UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN rows ON r = b GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM rows JOIN comp ON r = comp.a LEFT JOIN deg ON r = deg.a
"""
