"""SentencePiece encoding and decoding as a max-plus scan over chunks.

Encoding is a best path over the text: an edge is a piece, its weight the piece's score.
In a byte-pair model the same algebra is used with weights 0 and minus infinity: a
sequence of pieces is what the merges give if and only if every two neighbours are what
the merges give for their own text, so a neighbour that does not fit
weighs minus infinity, and the path that is left is the library's encoding. In a unigram
model paths of equal score may be told apart otherwise than by the library. A chunk of a long text thus gives a matrix from the
pieces that may reach into it to the pieces that may leave it; matrices combine
associatively, and once the pieces at all boundaries are known each chunk is traced alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvine.llm.common import staged

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Code points of a chunk. Texts of one chunk are encoded where they are.
CHUNK = 32_768
#: A worker keeps the ids of the words it met last: two tables of at most so many entries.
WORDS = 200_000
SPACE = "▁"
_LOW = -np.inf


class Pieces:
    """A model with the identity normaliser and byte fallback, of either type."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(data)
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError("only models with the identity normaliser are read")
        kinds = proto.SentencePiece
        if not proto.trainer_spec.byte_fallback or any(p.type in (kinds.UNUSED, kinds.USER_DEFINED) for p in proto.pieces):
            raise ValueError("only models with byte fallback, without unused or user-defined pieces, are read")
        self.merges = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        if not self.merges and proto.trainer_spec.model_type != proto.trainer_spec.UNIGRAM:
            raise ValueError("only BPE and unigram models are read")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.unknown = min(self.scores.values()) - 10.0
        self.longest = max(map(len, self.ids))
        back = {i: bytes([b]) for b, i in self.bytes.items()}
        self.content = [
            back.get(i, p.piece.replace(SPACE, " ").encode() if p.type == kinds.NORMAL else b"") for i, p in enumerate(proto.pieces)
        ]
        #: Whether no piece crosses into a run of spaces, so that every such place is a boundary of any path.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        #: The pieces as a tree of characters: ``{character: [id or -1, tree]}``.
        self._tree: dict[str, list] = {}
        for piece, i in self.ids.items():
            node, entry = self._tree, None
            for c in piece:
                entry = node.setdefault(c, [-1, {}])
                node = entry[1]
            entry[0] = i
        #: All characters that some piece holds; another one never joins its neighbours.
        self._alphabet = frozenset().union(*self.ids)
        self._names = [p.piece for p in proto.pieces]
        #: Length of every piece, and the longest piece that begins it.
        self._length = list(map(len, self._names))
        self._shorter = [next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), -1) for p in self._names]
        self._fits: dict[tuple[str, str], bool] = {}
        #: By the id before (the last row: none before), which ids fit after it.
        self._pairs: list[dict[int, bool]] = [{} for _ in range(len(proto.pieces) + 1)]
        #: Ids of words with their spaces, and of words after one space, without it; the last met and those before.
        self._words: list[dict[str, tuple[int, ...]]] = [{}, {}]
        self._plain: list[dict[str, tuple[int, ...]]] = [{}, {}]

    def normal(self, text: str | None) -> str:
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE) if text else ""

    def merged(self, text: str) -> list[str]:
        """The merges done one by one, best first, then leftmost. For texts of two pieces."""
        parts = list(text)
        while True:
            best, at = _LOW, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1], _LOW)
                if score > best:
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def weight(self, before: str, piece: str) -> float:
        """Of the edge ``piece`` after the edge ``before`` (empty: none, or one that cannot touch it)."""
        if not self.merges:
            return self.scores.get(piece, self.unknown)
        fits = self._fits.get((before, piece))
        if fits is None:
            if len(self._fits) > WORDS:
                self._fits.clear()
            fits = self._fits[before, piece] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return 0.0 if fits else _LOW

    def trace(self, text: str, start: int, end: int, before: str = "") -> list[str]:
        """The best path from ``start`` to ``end`` after the edge ``before``."""
        best: list[tuple[float, int] | None] = [None] * (end - start + 1)
        best[0] = (0.0, 0)
        edge = [before] + [""] * (end - start)
        for p in range(1, end - start + 1):
            for q in range(max(0, p - self.longest), p):
                if best[q] is None:
                    continue
                piece = text[start + q : start + p]
                if p - q > 1 and piece not in self.ids:
                    continue
                value = best[q][0] + self.weight(edge[q], piece)
                if value > (best[p][0] if best[p] else _LOW):
                    best[p], edge[p] = (value, q), piece
                    if self.merges:  # only one edge into a place can be right
                        break
        out, p = [], end - start
        while p:
            out.append(edge[p])
            p = best[p][1]
        return out[::-1]

    def _pair(self, a: int, i: int) -> bool:
        """``weight`` of two ids; -1 is the start."""
        before, piece = self._names[a] if a >= 0 else "", self._names[i]
        fits = self._pairs[a][i] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return fits

    def _word(self, text: str) -> tuple[int, ...]:
        """The ids of ``trace`` for a whole word in a byte-pair model.

        The only path whose neighbours all fit, searched depth first, long pieces first.
        Every place has one path into it at most, so a place that led nowhere is done.
        """
        length, shorter, pairs, tree, n = self._length, self._shorter, self._pairs, self._tree, len(text)
        out: list[int] = []
        dead, pos, a, i, fresh = set(), 0, -1, -1, True
        while pos < n:
            if fresh:  # the longest piece that begins here
                node, i, fresh = tree, -1, False
                for c in text[pos:]:
                    entry = node.get(c)
                    if entry is None:
                        break
                    k, node = entry
                    if k >= 0:
                        i = k
            row = pairs[a]
            while i >= 0:
                if pos + length[i] not in dead:
                    fits = row.get(i)
                    if self._pair(a, i) if fits is None else fits:
                        break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                pos, a, fresh = pos + length[i], i, True
            elif out:
                dead.add(pos)
                pos -= length[a]
                i = shorter[out.pop()]
                a = out[-1] if out else -1
            else:  # some character is no piece
                return tuple(self.numbers(self.trace(text, 0, n)))
        return tuple(out)

    def _parted(self, text: str) -> tuple[int, ...]:
        """``_word`` of a text with characters that no piece holds: what lies between them is on its own."""
        out: list[int] = []
        for known, run in groupby(text, self._alphabet.__contains__):
            part = "".join(run)
            out += self._word(part) if known else self.numbers(list(part))
        return tuple(out)

    def numbers(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is None:
                out.extend(self.bytes[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                out.append(i)
        return out

    def whole(self, text: str) -> list[int]:
        """Ids of a normalised text whose two ends are boundaries. Repeated words are looked up."""
        if not self.cuts:
            return self.numbers(self.trace(text, 0, len(text)))
        if not text.startswith(SPACE):
            head, space, rest = text.partition(SPACE)
            return [*(self._remembered(self._words, head, "") if head else ()), *(self._spaced(rest.split(SPACE)) if space else ())]
        return self._spaced(text[1:].split(SPACE))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        if not text or not self.cuts or not self.prefix or SPACE in text:
            return self.whole(self.normal(text))
        return self._spaced(text.split(" "))

    def _spaced(self, words: list[str]) -> list[int]:
        """Ids of words with one space before each; an empty word is one more space."""
        out: list[int] = []
        known, gap = self._plain, ""
        get = known[0].get
        for word in words:
            if not word:
                gap += SPACE
            elif gap:
                out += self._remembered(self._words, gap + SPACE + word, "")
                gap = ""
            else:
                ids = get(word)
                if ids is None:
                    ids = self._remembered(known, word, SPACE)
                    get = known[0].get
                out += ids
        if gap:
            out += self._remembered(self._words, gap, "")
        return out

    def _remembered(self, known: list[dict[str, tuple[int, ...]]], key: str, before: str) -> tuple[int, ...]:
        newer, older = known
        ids = newer.get(key) or older.get(key)
        if ids is None:
            word = before + key
            if not self.merges:
                ids = tuple(self.numbers(self.trace(word, 0, len(word))))
            elif self._alphabet.issuperset(word):
                ids = self._word(word)
            else:
                ids = self._parted(word)
        if len(key) <= 64:
            if len(newer) >= WORDS:
                known[:] = newer, older = {}, newer
            newer[key] = ids
        return ids

    def crossing(self, text: str, at: int) -> list[tuple[int, int]]:
        """Edges ``(start, end)`` with ``start < at <= end`` that a path may take; offsets count from ``at``."""
        spans = ((a, b) for a in range(max(0, at - self.longest), at) for b in range(at, min(len(text), a + self.longest) + 1))
        return sorted((a - at, b - at) for a, b in spans if b - a == 1 or text[a:b] in self.ids)

    def first_cut(self, text: str, start: int, end: int) -> int | None:
        """The first place in [start, end) that no piece can cross."""
        m = re.compile(f"(?<=[^{SPACE}]){SPACE}").search(text, start, end) if self.cuts else None
        return m.start() if m else None

    def last_cut(self, text: str, start: int, end: int) -> int | None:
        at = end
        while self.cuts and (at := text.rfind(SPACE, start, at)) > 0:
            if text[at - 1] != SPACE:
                return at
        return None

    def spread(self, text: str, sources: list[tuple[int, str]], end: int) -> dict[int, dict[str, np.ndarray]]:
        """Best values of every place up to ``end`` from each source ``(place, edge before)``, by the edge into it."""
        values: dict[int, dict[str, np.ndarray]] = {}
        for i, (place, before) in enumerate(sources):
            row = values.setdefault(place, {}).setdefault(before if self.merges else "", np.full(len(sources), _LOW))
            row[i] = 0.0
        for q in range(min(p for p, _ in sources), end):
            for p in range(q + 1, min(end, q + self.longest) + 1):
                if q in values and (p - q == 1 or text[q:p] in self.ids):
                    self._step(values, text, q, p)
        return values

    def _step(self, values, text: str, q: int, p: int) -> None:
        piece = text[q:p]
        for before, row in values[q].items():
            w = self.weight(before, piece)
            if w > _LOW:
                into = values.setdefault(p, {})
                key = piece if self.merges else ""
                into[key] = np.maximum(into[key], row + w) if key in into else row + w

    def leaving(self, text: str, values, at: int, exits: list[tuple[int, int]], width: int) -> np.ndarray:
        """Values, a row for each source, of the crossing edges ``exits`` at ``at``."""
        out = np.full((width, len(exits)), _LOW)
        for j, (a, b) in enumerate(exits):
            for before, row in values.get(at + a, {}).items():
                out[:, j] = np.maximum(out[:, j], row + self.weight(before, text[at + a : at + b]))
        return out

    def transfer(self, text: str, start: int, end: int, last: bool) -> np.ndarray:
        """The chunk's matrix: from each edge into ``start`` to each edge across ``end``, or to the end of the text."""
        entries = self.crossing(text, start) if start else [(0, 0)]
        sources = [(start + b, text[start + a : start + b]) for a, b in entries]
        exits = [] if last else self.crossing(text, end)
        low = max(p for p, _ in sources)
        c1, c2 = self.first_cut(text, max(1, low), end), self.last_cut(text, max(1, low), end)
        if c1 is None or c2 is None:
            c1 = c2 = None
        reach = self.spread(text, sources, end if c1 is None else c1)
        if c1 is not None:
            into = np.max(list(reach.get(c1, {"": np.full(len(sources), _LOW)}).values()), axis=0)
            middle = 0.0 if self.merges or c2 == c1 else sum(self.weight("", p) for p in self.trace(text, c1, c2))
            reach = self.spread(text, [(c2, "")], end)
            out = self.leaving(text, reach, end, exits, 1) if not last else _ends(reach, end, 1)
            return into[:, None] + middle + out
        return self.leaving(text, reach, end, exits, len(sources)) if not last else _ends(reach, end, len(sources))

    def between(self, text: str, start: int, end: int, entry: tuple[int, int], leave: tuple[int, int] | None) -> list[int]:
        """Ids of the pieces that begin in the chunk, given the edges that cross its two ends."""
        a, b = entry
        before, at = text[start + a : start + b], start + b
        stop = end if leave is None else end + leave[0]
        tail = [] if leave is None else [text[end + leave[0] : end + leave[1]]]
        c1, c2 = self.first_cut(text, max(1, at), stop), self.last_cut(text, max(1, at), stop)
        if c1 is None or c2 is None or c1 > c2:
            return self.numbers(self.trace(text, at, stop, before) + tail)
        return self.numbers(self.trace(text, at, c1, before)) + self.whole(text[c1:c2]) + self.numbers(self.trace(text, c2, stop) + tail)

    def text(self, ids) -> str:
        out = b"".join(map(self.content.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.prefix and out.startswith(" ") else out


def _ends(values, end: int, width: int) -> np.ndarray:
    rows = list(values.get(end, {"": np.full(width, _LOW)}).values())
    return np.max(rows, axis=0)[:, None]


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each inner boundary of the best path, by a tree of max-plus products."""
    if len(matrices) == 1:
        return []
    product = lambda a, b: np.max(a[:, :, None] + b[None, :, :], axis=1)
    levels = [matrices]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([product(row[i], row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)])
    ends = [(0, 0)]  # the states before and after each product, from the root down
    for row in levels[-2::-1]:
        below = []
        for i, (a, b) in enumerate(ends):
            if 2 * i + 1 < len(row):
                middle = int(np.argmax(row[2 * i][a, :] + row[2 * i + 1][:, b]))
                below += [(a, middle), (middle, b)]
            else:
                below.append((a, b))
        ends = below
    return [b for _, b in ends[:-1]]


_loaded: dict[str, Pieces] = {}


def pieces_of(data: bytes) -> Pieces:
    """Read once a worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _loaded:
        _loaded[key] = Pieces(data)
    return _loaded[key]


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:  # the driver's copy of the vocabulary; executors get it by broadcast
        return f.read()


CHUNKS = "row long, doc_id long, chunk long, last boolean, start int, stop int, text string"


def _long_texts(docs: DataFrame, model, size: int) -> DataFrame:
    """``row, doc_id, ids`` of texts of more than one chunk."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(model.value)
        for batch in batches:
            for row, doc_id, text in zip(batch.row, batch.doc_id, batch.text, strict=True):
                full, m = pieces.normal(text), pieces.longest
                for k in range(-(-len(full) // size)):
                    low, high = max(0, k * size - m), min(len(full), (k + 1) * size + m)
                    end = min(len(full), (k + 1) * size)
                    out = (row, doc_id, k, end == len(full), k * size - low, end - low, full[low:high])
                    yield pd.DataFrame([out], columns=[c.split(" ")[0] for c in CHUNKS.split(", ")]).astype({"doc_id": "Int64"})

    def transfers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(model.value)
        for batch in batches:
            out = [(r.row, r.chunk, m.shape[1], m.ravel().tolist()) for r in batch.itertuples() for m in [pieces.transfer(r.text, r.start, r.stop, r.last)]]
            yield pd.DataFrame(out, columns=["row", "chunk", "width", "matrix"])

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        states = boundary_states([np.asarray(m).reshape(-1, w) for m, w in zip(group.matrix, group.width, strict=True)])
        return pd.DataFrame({"row": group.row.to_numpy(), "chunk": group.chunk.to_numpy(), "into": [0, *states], "out": [*states, 0]})

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(model.value)
        for batch in batches:
            out = []
            for r in batch.itertuples():
                entry = pieces.crossing(r.text, r.start)[r.into] if r.start else (0, 0)
                leave = None if r.last else pieces.crossing(r.text, r.stop)[r.out]
                out.append((r.row, r.doc_id, r.chunk, pieces.between(r.text, r.start, r.stop, entry, leave)))
            yield pd.DataFrame(out, columns=["row", "doc_id", "chunk", "ids"]).astype({"doc_id": "Int64"})

    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    chunks = staged(rows.mapInPandas(cut, CHUNKS).repartition("row", "chunk"), "spm-chunks")
    matrices = chunks.select("row", "chunk", "last", "start", "stop", "text").mapInPandas(transfers, "row long, chunk long, width int, matrix array<double>")
    # One small matrix for each chunk of one text; a text is one value, so their number is bounded.
    # Explicit counts: few bytes a row, but Python work behind them, which adaptive execution would merge into one task.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    states = matrices.repartition(tasks, "row").groupBy("row").applyInPandas(scan, "row long, chunk long, into int, out int")
    traced = chunks.join(states, ["row", "chunk"]).repartition(tasks, "row", "chunk").mapInPandas(trace, "row long, doc_id long, chunk long, ids array<int>")
    parts = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    return parts.select("doc_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def encoded(docs: DataFrame, path: str = MODEL, size: int = CHUNK) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs(doc_id, text)``; equal to the library's ids for a byte-pair model, and up to ties of equal scores for a unigram one.

    Null and empty texts have no ids. Repeated rows and ids, and null ids, give a row each;
    other columns are not looked at; no rows, no result.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))  # the vocabulary file, 0.5 MB

    @F.pandas_udf("array<int>")
    def short(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = pieces_of(model.value)
        for part in parts:
            yield pd.Series([np.asarray(pieces.encode(t), dtype=np.int32) for t in part], dtype=object)

    length = F.coalesce(F.length("text"), F.lit(0))
    rows = docs.select("doc_id", "text")
    here = rows.where(length < size).select("doc_id", short("text").alias("ids"))
    return here.unionByName(_long_texts(rows.where(length >= size), model, size))


def decoded(spark, ids: Column, path: str = MODEL) -> Column:
    """Texts of ids; a literal U+2581 comes back as the space that it is to the model."""
    model = spark.sparkContext.broadcast(model_bytes(path))

    @F.pandas_udf("string")
    def back(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = pieces_of(model.value)
        for part in parts:
            yield pd.Series([pieces.text(p.tolist()) for p in part], dtype=object)

    return back(ids)
