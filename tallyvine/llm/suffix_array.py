"""Suffix arrays of many short texts at once, by induced sorting, and their common prefixes.

Induced sorting reads a suffix array in order and places each entry's predecessor, one
after the other. Here the texts are lanes: step ``s`` handles rank ``s`` of every lane by a
few array operations, so the work is linear in the length of a lane and in their number.

Places are held as ``position * lanes + lane``, so a column of lanes is contiguous and the
predecessor of a place is ``lanes`` less.
"""

from __future__ import annotations

import numpy as np


def _types(symbols: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S); the last symbol is the least of its lane and counts as such."""
    n = len(symbols)
    less = np.ones(symbols.shape, dtype=bool)
    less[:-1] = symbols[:-1] < symbols[1:]
    same = np.zeros(symbols.shape, dtype=bool)
    same[:-1] = symbols[:-1] == symbols[1:]
    # A run of equal symbols has the type of its last one.
    last = np.where(same, n, np.arange(n)[:, None])
    last = np.minimum.accumulate(last[::-1], axis=0)[::-1]
    return np.take_along_axis(less, last, axis=0)


def _leftmost(small: np.ndarray) -> np.ndarray:
    """Whether each suffix is S and the one before it is not: where the leftmost-smaller substrings start."""
    out = np.zeros(small.shape, dtype=bool)
    out[1:] = small[1:] & ~small[:-1]
    return out


class _Buckets:
    """Where the suffixes of a lane that begin with a symbol lie."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.n, self.lanes = symbols.shape
        lane = np.arange(self.lanes, dtype=np.int64)
        self.of = (lane * alphabet + symbols).ravel()
        count = np.bincount(self.of, minlength=self.lanes * alphabet).reshape(self.lanes, alphabet)
        after = np.cumsum(count, axis=1)
        self.heads = ((after - count) * self.lanes + lane[:, None]).ravel()
        self.tails = ((after - 1) * self.lanes + lane[:, None]).ravel()

    def placed(self, chosen: np.ndarray) -> np.ndarray:
        """An array with ``chosen`` at the ends of their buckets, in their order; ``chosen`` is grouped by bucket."""
        out = np.full(self.n * self.lanes, -1, dtype=np.int64)
        if len(chosen):
            bucket = self.of[chosen]
            new = np.ones(len(chosen), dtype=bool)
            new[1:] = bucket[1:] != bucket[:-1]
            heads = np.flatnonzero(new)
            ends = np.append(heads[1:], len(chosen))
            behind = np.repeat(ends, ends - heads) - 1 - np.arange(len(chosen))
            out[self.tails[bucket] - behind * self.lanes] = chosen
        return out


def _induced(order: np.ndarray, small: np.ndarray, buckets: _Buckets) -> np.ndarray:
    """All suffixes of all lanes in order, from the leftmost-smaller ones that ``order`` holds."""
    lanes, n = buckets.lanes, buckets.n
    before = np.zeros(n * lanes + 1, dtype=bool)  # an empty place is -1, the last
    flat = small.ravel()
    before[lanes:-1] = ~flat[:-lanes]
    heads = buckets.heads.copy()
    for s in range(0, n * lanes, lanes):
        e = order[s : s + lanes]
        j = e[before[e]] - lanes
        if len(j):
            bucket = buckets.of[j]
            at = heads[bucket]
            order[at] = j
            heads[bucket] = at + lanes
    before[:] = False
    before[lanes:-1] = flat[:-lanes]
    tails = buckets.tails.copy()
    for s in range((n - 1) * lanes, -1, -lanes):
        e = order[s : s + lanes]
        j = e[before[e]] - lanes
        if len(j):
            bucket = buckets.of[j]
            at = tails[bucket]
            order[at] = j
            tails[bucket] = at - lanes
    return order


def _by_lane(order: np.ndarray, chosen: np.ndarray, lanes: int) -> np.ndarray:
    """The chosen places of ``order``, lane after lane."""
    rows = order.reshape(-1, lanes).T
    return rows[chosen.ravel()[rows]]


def _different(symbols: np.ndarray, length: np.ndarray, places: np.ndarray, lanes: int) -> np.ndarray:
    """Whether each leftmost-smaller substring differs from the one before it in the list."""
    flat = symbols.ravel()
    out = np.ones(len(places), dtype=bool)
    a, b = places[:-1], places[1:]
    open_ = np.flatnonzero((length[a] == length[b]) & (a % lanes == b % lanes))
    out[open_ + 1] = False
    step = 0
    while len(open_):
        differs = flat[a[open_] + step * lanes] != flat[b[open_] + step * lanes]
        out[open_[differs] + 1] = True
        open_ = open_[~differs]
        step += 1
        open_ = open_[length[a[open_]] >= step]
    return out


def suffix_order(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    """Places of all suffixes in order, ``[rank, lane]``, of ``symbols[position, lane]``.

    Every lane ends with a 0 that it has nowhere else; symbols are less than ``alphabet``.
    """
    n, lanes = symbols.shape
    small = _types(symbols)
    first = _leftmost(small)
    buckets = _Buckets(symbols, alphabet)
    # Leftmost-smaller substrings in any order, then sorted by their symbols.
    starts = np.flatnonzero(first.T.ravel())  # by lane
    starts = (starts % n) * lanes + starts // n
    some = starts[np.argsort(buckets.of[starts], kind="stable")]
    order = _induced(buckets.placed(some), small, buckets)
    ranked = _by_lane(order, first, lanes)
    length = np.zeros(n * lanes, dtype=np.int64)  # to the next start
    lane = starts % lanes
    follows = np.flatnonzero(lane[1:] == lane[:-1])
    length[starts[follows]] = (starts[follows + 1] - starts[follows]) // lanes
    different = _different(symbols, length, ranked, lanes)
    of_lane = ranked % lanes
    new_lane = np.ones(len(ranked), dtype=bool)
    new_lane[1:] = of_lane[1:] != of_lane[:-1]
    running = np.cumsum(different)
    heads = np.flatnonzero(new_lane)
    count = np.diff(np.append(heads, len(ranked)))
    name = running - np.repeat(running[heads], count)
    names = name[np.append(heads[1:], len(ranked)) - 1] + 1
    if (names < count).any():
        ranked = _sorted_again(ranked, starts, name, heads, count, np.flatnonzero(names < count), n * lanes)
    return _induced(buckets.placed(ranked), small, buckets).reshape(n, lanes)


def _sorted_again(ranked: np.ndarray, starts: np.ndarray, name: np.ndarray, heads: np.ndarray, count: np.ndarray, equal: np.ndarray, size: int) -> np.ndarray:
    """``ranked`` with the lanes ``equal`` sorted by what follows equal substrings: the names' own suffix order."""
    named = np.zeros(size, dtype=np.int64)
    named[ranked] = name
    longest = int(count[equal].max())
    # Names in text order; 1 fills a lane up, 0 ends it. A lane's own end is its last name, 0.
    text = np.ones((longest, len(equal)), dtype=np.int64)
    text[-1] = 0
    for column, k in enumerate(equal):
        own = starts[heads[k] : heads[k] + count[k] - 1]
        text[: len(own), column] = named[own] + 1
    order = suffix_order(text, int(text.max()) + 1)
    position, out = order // len(equal), ranked.copy()
    for column, k in enumerate(equal):
        p = position[:, column]
        p = p[p < count[k] - 1]
        out[heads[k] + 1 : heads[k] + count[k]] = starts[heads[k] + p]
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(before, lcp)`` of ``text[lane, position]``, both in text order: the suffix that precedes each in its lane's order, and their common prefix.

    Where a suffix and its predecessor are preceded by the same byte, the common prefix is one less
    than that of the suffix before; only the others are compared, eight bytes at a time.
    Places are ``lane * length + position``. ``text`` has no more bytes than ``order`` has ranks.
    """
    n, lanes = order.shape
    place = (order % lanes) * n + order // lanes
    before = np.full(lanes * n, -1, dtype=np.int64)
    before[place[1:].ravel()] = place[:-1].ravel()
    flat = np.zeros(lanes * n + 8, dtype=np.uint8)
    flat[: lanes * n].reshape(lanes, n)[:, : text.shape[1]] = text
    wide = np.ndarray((lanes * n + 1,), dtype="<u8", buffer=flat, strides=(1,))
    at = np.arange(lanes * n)
    inner = (at % n > 0) & (before % n > 0) & (before >= 0)
    follows = np.zeros(lanes * n, dtype=bool)
    follows[inner] = (flat[at[inner] - 1] == flat[before[inner] - 1]) & (before[at[inner] - 1] == before[inner] - 1)
    lcp = np.zeros(lanes * n, dtype=np.int64)
    open_ = np.flatnonzero(~follows & (before >= 0))
    room = n - np.maximum(open_ % n, before[open_] % n)
    done = np.zeros(len(open_), dtype=np.int64)
    while len(open_):
        x = wide[np.minimum(open_ + done, lanes * n)] ^ wide[np.minimum(before[open_] + done, lanes * n)]
        low = (x & (~x + np.uint64(1))).astype(np.float64)
        equal = np.where(x == 0, 8, np.log2(np.maximum(low, 1)).astype(np.int64) // 8)
        done = np.minimum(done + equal, room)
        lcp[open_] = done
        more = (equal == 8) & (done < room)
        open_, room, done = open_[more], room[more], done[more]
    last = np.maximum.accumulate(np.where(follows, -1, at))
    lcp = lcp[last] - (at - last)
    return before.reshape(lanes, n), np.maximum(lcp, 0).reshape(lanes, n)


def _packed(groups: list[list[bytes]], length: int) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """``(text[lane, position], (lane, start) of each text)``: whole groups packed into lanes, a byte that no text holds (0xFF) behind each text."""
    places, used, lane = [], 0, 0
    for group in groups:
        size = sum(map(len, group)) + len(group)
        if used and used + size > length:
            lane, used = lane + 1, 0
        own = []
        for t in group:
            own.append((lane, used))
            used += len(t) + 1
        places.append(own)
    out = np.full((lane + 1, length), 0xFF, dtype=np.uint8)
    for group, own in zip(groups, places, strict=True):
        for t, (i, at) in zip(group, own, strict=True):
            out[i, at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
    return out, places


def repeated_starts(groups: list[list[bytes]], width: int, lane_bytes: int) -> list[list[np.ndarray]]:
    """For each text of each group the places where a string of ``width`` bytes starts that also starts elsewhere in its lane, which holds whole groups."""
    length = max(lane_bytes, max(sum(map(len, g)) + len(g) for g in groups))
    text, places = _packed(groups, length)
    symbols = np.zeros((length + 1, len(text)), dtype=np.int64)
    symbols[:length] = text.T
    symbols[:length] += 1
    before, lcp = common_prefixes(text, suffix_order(symbols, 257))
    found = np.zeros(before.size, dtype=bool)
    deep = np.flatnonzero(lcp.ravel() >= width)
    found[deep] = True
    found[before.ravel()[deep]] = True
    found = found.reshape(before.shape)
    return [
        [np.flatnonzero(found[i, at : at + max(0, len(t) - width + 1)]) for t, (i, at) in zip(group, own, strict=True)]
        for group, own in zip(groups, places, strict=True)
    ]
