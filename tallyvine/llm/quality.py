"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filter width in bytes, filters, positions pooled into one chunk.
WIDTH, FILTERS, CHUNK = 6, 16, 128
#: Rows of each label that are learned from, and the longest text among them. Scores have no such bound.
TRAIN_ROWS, TRAIN_CHARS = 600, 20_000
EPOCHS, BATCH, RATE, SEED = 12, 16, 0.02, 7
#: Positions convolved at a time; bounds memory, not the text.
SPAN = CHUNK * 512


@dataclass
class Network:
    """``taps[k][byte]`` is what a byte at offset k adds to every filter (a filter over one-hot bytes)."""

    taps: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float


def to_bytes(text: str | None) -> np.ndarray:
    """UTF-8 with a zero byte before and after, so that also an empty text has a window."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return np.frombuffer(b"\0" + raw + b"\0" * WIDTH, dtype=np.uint8)


def _windows(net: Network, data: np.ndarray) -> np.ndarray:
    n = len(data) - WIDTH + 1
    acts = net.taps[0][data[:n]]
    for k in range(1, WIDTH):
        acts += net.taps[k][data[k : k + n]]
    return acts


def pooled(net: Network, data: np.ndarray) -> np.ndarray:
    """Maximum of every filter over every chunk. Chunks read WIDTH - 1 bytes of the next, so no window is lost."""
    n, parts = len(data) - WIDTH + 1, []
    for start in range(0, n, SPAN):
        acts = _windows(net, data[start : min(start + SPAN, n) + WIDTH - 1])
        parts.append(np.maximum.reduceat(acts, np.arange(0, len(acts), CHUNK), axis=0))
    return np.concatenate(parts)


def probability(net: Network, text: str | None) -> float:
    feature = np.maximum(pooled(net, to_bytes(text)) + net.bias, 0).mean(axis=0)
    return float(1 / (1 + np.exp(-np.clip(feature @ net.out + net.out_bias, -30, 30))))


def fit(texts: list[str | None], labels: list[int]) -> Network:
    """Adam on the log loss. The gradient of a maximum reaches only the window that was the maximum. Without any label every score is 0.5."""
    rng = np.random.default_rng(SEED)
    net = Network(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)
    data, y = [to_bytes(t) for t in texts], np.asarray(labels, dtype=np.float32)
    if not len(y):
        return replace(net, out=np.zeros(FILTERS, np.float32))
    share = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    weight = np.asarray([len(y) / (2 * share[int(v)]) for v in y], dtype=np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.taps, net.bias, net.out, np.zeros(1, np.float32))]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            grads = [np.zeros_like(s[0]) for s in state]
            batch = order[at : at + BATCH]
            for i in batch:
                acts = _windows(net, data[i])
                chunks = -(-len(acts) // CHUNK)
                full = np.full((chunks * CHUNK, FILTERS), -np.inf, dtype=np.float32)
                full[: len(acts)] = acts
                full = full.reshape(chunks, CHUNK, FILTERS)
                best = full.argmax(axis=1)
                top = np.take_along_axis(full, best[:, None, :], axis=1)[:, 0, :] + net.bias
                feature = np.maximum(top, 0).mean(axis=0)
                p = 1 / (1 + np.exp(-np.clip(feature @ net.out + net.out_bias, -30, 30)))
                d = np.float32((p - y[i]) * weight[i] / len(batch))
                grads[2] += d * feature
                grads[3] += d
                down = (top > 0) * (d * net.out / chunks)
                grads[1] += down.sum(axis=0)
                where = best + np.arange(chunks)[:, None] * CHUNK
                columns = np.broadcast_to(np.arange(FILTERS), where.shape)
                for k in range(WIDTH):
                    np.add.at(grads[0][k], (data[i][where + k], columns), down)
            step += 1
            params = [net.taps, net.bias, net.out, np.asarray([net.out_bias], dtype=np.float32)]
            for p, g, (m, v) in zip(params, grads, state, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.out_bias = float(params[3][0])
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, longest: int = TRAIN_CHARS) -> Network:
    """Fit on at most ``rows`` documents of each label, those with the smallest hashes, each of at most ``longest`` characters.

    Rows whose crc32(doc_id) mod 3 is 1 are never learned from. The sample is a bounded
    fit set; it is chosen among labels first, so the texts of other documents are not moved.
    """
    usable = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # Twice the rows, for those without a document or too long.
    picked = usable.where("quality = 0").orderBy(*order).limit(2 * rows).unionByName(usable.where("quality = 1").orderBy(*order).limit(2 * rows))
    texts = docs.select("doc_id", "text").where(F.length(F.coalesce("text", F.lit(""))) <= longest).join(F.broadcast(picked), "doc_id")
    sample = texts.select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "quality")
    chosen = sample.where("quality = 0").orderBy("h", "doc_id", "text").limit(rows).unionByName(sample.where("quality = 1").orderBy("h", "doc_id", "text").limit(rows))
    found = sorted(((r.h, r.doc_id, r.text or "", r.quality) for r in chosen.collect()))
    return fit([r[2] for r in found], [r[3] for r in found])


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """All of ``docs(doc_id, text, lang, source, n_chars)`` with ``held_out, score, predicted``.

    The whole text is scored, in place, without a shuffle; null and empty texts alike
    get the score of the empty window. Null ids are not held out; repeated rows and
    other columns do not matter; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # 100 kB, fixed by the architecture

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([probability(shared.value, t) for t in part], dtype=np.float64)

    rows = docs.select("doc_id", "text", "lang", "source", "n_chars", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
