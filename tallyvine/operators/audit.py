"""Access-audit snapshots at an instant, and the throttle audit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvine.session import materialise


def active_sessions(sessions: DataFrame, as_of_ms: int) -> DataFrame:
    """Sessions that are not revoked and have not expired."""
    return sessions.where(F.col("revoked_at").isNull() & (F.col("expires_at") > as_of_ms))


def latest_challenges(challenges: DataFrame, as_of_ms: int) -> DataFrame:
    """The newest usable challenge per phone and purpose."""
    usable = challenges.where(
        F.col("used_at").isNull()
        & (F.col("expires_at") > as_of_ms)
        & (F.col("attempts") < F.col("max_attempts"))
    )
    newest = F.max_by(
        F.struct("id", "created_at", "expires_at", "attempts"), F.struct("created_at", "id")
    ).alias("newest")
    return usable.groupBy("phone", "purpose").agg(newest).select("phone", "purpose", "newest.*")


def lockout_states(
    logins: DataFrame, lockout_after: int, lockout_ms: int, slice_ms: int = 86_400_000
) -> DataFrame:
    """Consecutive failures after each login and the lock they cause.

    ``logins`` is ``(login_id, user_id, ts, success)``. A success resets the
    count. Counting runs within (user, time slice); one small summary per slice
    carries the count over to the next one. A user with very many logins is
    thus ordered slice by slice in separate tasks.
    """
    sliced = logins.withColumn("slice", F.floor(F.col("ts") / F.lit(slice_ms)))
    within = Window.partitionBy("user_id", "slice").orderBy("ts", "login_id")
    island = F.sum(F.when(F.col("success"), 1).otherwise(0)).over(
        within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    marked = sliced.withColumn("island", island)
    run = Window.partitionBy("user_id", "slice", "island").orderBy("ts", "login_id")
    failures_here = F.count_if(~F.col("success")).over(
        run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = marked.withColumn("here", failures_here)

    # The last row of a slice knows the failures since the slice's last success.
    summary = counted.groupBy("user_id", "slice").agg(
        (F.max("island") > 0).alias("resets"),
        F.max_by("here", F.struct("ts", "login_id")).alias("trailing"),
    )
    over_slices = Window.partitionBy("user_id").orderBy("slice")
    before = over_slices.rowsBetween(Window.unboundedPreceding, -1)
    era = F.sum(F.when(F.col("resets"), 1).otherwise(0)).over(
        over_slices.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Trailing failures add up from the last resetting slice onwards.
    carried = (
        summary.withColumn("era", era)
        .withColumn(
            "run",
            F.sum("trailing").over(
                Window.partitionBy("user_id", "era").orderBy("slice")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .withColumn("carry", F.coalesce(F.last("run").over(before), F.lit(0).cast("bigint")))
        .select("user_id", "slice", "carry")
    )
    total = F.col("here") + F.when(F.col("island") == 0, F.col("carry")).otherwise(F.lit(0))
    return (
        counted.join(carried, ["user_id", "slice"])
        .withColumn("failed_login_count", total)
        .select(
            "user_id", "login_id", "ts", "success", "failed_login_count",
            F.when(
                ~F.col("success") & (F.col("failed_login_count") >= lockout_after),
                F.col("ts") + F.lit(lockout_ms).cast("bigint"),
            ).alias("locked_until"),
        )
    )


def locked_users(states: DataFrame, as_of_ms: int) -> DataFrame:
    """Users whose state after their last login is a lock that still holds."""
    last = F.max_by(
        F.struct("failed_login_count", "locked_until"), F.struct("ts", "login_id")
    ).alias("last")
    return (
        states.where(F.col("ts") <= as_of_ms).groupBy("user_id").agg(last)
        .select("user_id", "last.*")
        .where(F.col("locked_until") > as_of_ms)
    )


def due_jobs(jobs: DataFrame, as_of_ms: int) -> DataFrame:
    """Queued jobs whose time has come."""
    return jobs.where((F.col("state") == "queued") & (F.col("next_run_at") <= as_of_ms))


def next_due(jobs: DataFrame, as_of_ms: int, limit: int) -> DataFrame:
    return due_jobs(jobs, as_of_ms).orderBy("next_run_at", "id").limit(limit)


THROTTLE_SCHEMA = "key string, event_id bigint, ts bigint, allowed boolean, retry_after bigint"
#: Events that one task walks; a key with more spreads over several.
THROTTLE_ROWS = 250_000


class _Bucket:
    """A token bucket in whole numbers: one token is ``1000 * per_seconds`` units, a millisecond refills ``capacity`` units."""

    def __init__(self, capacity: int, per_seconds: int):
        self.rate, self.one, self.full = capacity, 1000 * per_seconds, capacity * 1000 * per_seconds

    def refilled(self, tokens: int, ms: int) -> int:
        return min(self.full, tokens + ms * self.rate)

    def retry_after(self, tokens: int) -> int:
        """Whole seconds until there is a token, at least one."""
        return max(1, (self.one - tokens) // (self.rate * 1000))


class _Transfer:
    """What a run of events makes of any number of tokens: pieces ``(from, shift, fixed)``, in order of ``from``.

    From ``from`` tokens on, the result is the tokens plus ``shift``, or ``fixed`` where the bucket has been
    full on the way. More tokens never admit fewer events, so there are at most some ``2 * capacity`` pieces.
    """

    def __init__(self):
        self.pieces: list[tuple[int, int, int | None]] = [(0, 0, None)]

    def after(self, bucket: _Bucket, ms: int) -> None:
        """One more event, ``ms`` after the one before."""
        out: list[tuple[int, int, int | None]] = []
        for i, (low, shift, fixed) in enumerate(self.pieces):
            top = self.pieces[i + 1][0] - 1 if i + 1 < len(self.pieces) else bucket.full
            if fixed is not None:
                fixed = bucket.refilled(fixed, ms)
                parts = [(low, shift, fixed - bucket.one if fixed >= bucket.one else fixed)]
            else:
                shift += ms * bucket.rate
                brim, taken = bucket.full - shift, bucket.one - shift
                parts = []
                if low < taken:  # no token for these
                    parts.append((low, shift, None))
                if top >= taken:
                    first = max(low, taken)
                    if first < brim:
                        parts.append((first, shift - bucket.one, None))
                    if top >= brim:
                        parts.append((max(first, brim), 0, bucket.full - bucket.one))
            for part in parts:
                if not out or out[-1][1:] != part[1:]:
                    out.append(part)
        self.pieces = out

    def __call__(self, tokens: int) -> int:
        for low, shift, fixed in reversed(self.pieces):
            if tokens >= low:
                return tokens + shift if fixed is None else fixed
        raise ValueError(tokens)


def _started(bucket: _Bucket, tokens: int | None, at: int | None, now: int) -> int:
    """Tokens at a key's first event: its stored bucket refilled, or a full one."""
    return bucket.full if tokens is None else bucket.refilled(tokens, now - at)


def _known(value: float | None) -> int | None:
    return None if value is None or value != value else int(value)


def _throttle_summaries(rows: DataFrame, bucket: _Bucket) -> DataFrame:
    """What each part knows of itself: its first and last key and time, and the tokens that it ends with.

    A part that one key fills may go on from the part before: it has ``pieces``, a map of the tokens at its first event.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["part", "first_key", "first_at", "known", "known_at", "last_key", "last_at", "tokens", "pieces"]
        now: list | None = None
        transfer: _Transfer | None = None

        def row() -> pd.DataFrame:
            return pd.DataFrame([[*now, transfer.pieces if transfer else None]], columns=names).astype(dict.fromkeys(("known", "known_at", "tokens"), "Int64"))

        for batch in batches:
            columns = (batch["part"].tolist(), batch["key"], batch["at"].tolist(), batch["known"].tolist(), batch["known_at"].tolist())
            for part, key, at, known, known_at in zip(*columns, strict=True):
                if now is None or now[0] != part:
                    if now is not None:
                        yield row()
                    now = [part, key, at, _known(known), _known(known_at), key, at, None]
                    transfer = _Transfer()
                    transfer.after(bucket, 0)
                elif key != now[5]:
                    left = _started(bucket, _known(known), _known(known_at), at)
                    now[5:] = [key, at, left - bucket.one if left >= bucket.one else left]
                    transfer = None
                else:
                    ms, now[6] = at - now[6], at
                    if transfer is not None:
                        transfer.after(bucket, ms)
                    else:
                        left = bucket.refilled(now[7], ms)
                        now[7] = left - bucket.one if left >= bucket.one else left
        if now is not None:
            yield row()

    return rows.mapInPandas(run, (
        "part int, first_key string, first_at bigint, known bigint, known_at bigint, last_key string, last_at bigint, tokens bigint, "
        "pieces array<struct<low:bigint, shift:bigint, fixed:bigint>>"
    ))


def _throttle_starts(summaries: DataFrame, bucket: _Bucket) -> dict[int, tuple[int, int]]:
    """``part: (tokens, time)`` of the parts that go on with the key of the part before: the maps composed in order."""
    before, out = None, {}
    for r in sorted(summaries.collect(), key=lambda r: r.part):  # one row a part
        goes_on = before is not None and before[0] == r.first_key
        if goes_on:
            out[r.part] = before[1:]
        if r.pieces is None:
            before = (r.last_key, r.tokens, r.last_at)
        else:
            transfer = _Transfer()
            transfer.pieces = [tuple(p) for p in r.pieces]
            start = bucket.refilled(before[1], r.first_at - before[2]) if goes_on else _started(bucket, r.known, r.known_at, r.first_at)
            before = (r.last_key, transfer(start), r.last_at)
    return out


def throttle_walk(events: DataFrame, capacity: int, per_seconds: int, states: DataFrame | None = None, rows_per_task: int = THROTTLE_ROWS) -> DataFrame:
    """Verdicts of ``throttle_verdicts`` and the bucket after each event: its ``tokens``, in units, and its time ``at``.

    ``states`` is ``(key, tokens, at)`` of buckets that exist already, one row a key; other keys start full.
    An event older than its bucket refills nothing.
    """
    bucket = _Bucket(capacity, per_seconds)
    nothing = F.lit(None).cast("bigint")
    rows = events.select("key", "event_id", "ts")
    if states is None:
        rows = rows.select("*", F.col("ts").alias("at"), nothing.alias("known"), nothing.alias("known_at"))
    else:
        stored = states.select(F.col("key").alias("owner"), F.col("tokens").alias("known"), F.col("at").alias("known_at"))
        rows = rows.join(stored, F.col("key").eqNullSafe(F.col("owner")), "left").drop("owner")
        rows = rows.withColumn("at", F.greatest("ts", "known_at")).select("key", "event_id", "ts", "at", "known", "known_at")
    order = ["key", "ts", "event_id"]
    parts = max(1, -(-events.count() // rows_per_task))
    dealt = materialise(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "throttle-parts")
    ordered = dealt.repartition(parts, "part").sortWithinPartitions("part", *order)
    starts = _throttle_starts(_throttle_summaries(ordered, bucket), bucket)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = key = tokens = last = None
        for batch in batches:
            out = []
            columns = (batch[c].tolist() for c in ("part", "key", "at", "known", "known_at"))
            for p, k, at, known, known_at in zip(*columns, strict=True):
                if p != part and p in starts:
                    tokens, last = starts[p]
                    tokens = bucket.refilled(tokens, at - last)
                elif p != part or k != key:
                    tokens = _started(bucket, _known(known), _known(known_at), at)
                else:
                    tokens = bucket.refilled(tokens, at - last)
                part, key, last = p, k, at
                ok = tokens >= bucket.one
                retry = None if ok else bucket.retry_after(tokens)
                tokens -= bucket.one if ok else 0
                out.append((ok, retry, tokens))
            verdicts = pd.DataFrame(out, columns=["allowed", "retry_after", "tokens"]).astype({"retry_after": "Int64"})
            yield pd.concat([batch[["key", "event_id", "ts"]].reset_index(drop=True), verdicts, batch["at"].reset_index(drop=True)], axis=1)

    return ordered.mapInPandas(walk, THROTTLE_SCHEMA + ", tokens bigint, at bigint")


def throttle_verdicts(
    events: DataFrame, capacity: int, per_seconds: int, rows_per_task: int = THROTTLE_ROWS
) -> DataFrame:
    """Token-bucket verdict for every event ``(key, event_id, ts)``.

    A bucket starts full, refills linearly and an admitted event takes one token, all in whole numbers.
    The verdict depends on all earlier verdicts of the key, however many: events are
    ordered by (key, time) and cut into parts of some ``rows_per_task`` rows. What a part makes of the tokens it
    is given is a small piecewise-linear map; the maps, one a part, are composed in order, and
    then every part knows the tokens it starts with and is walked by itself.
    """
    return throttle_walk(events, capacity, per_seconds, rows_per_task=rows_per_task).select("key", "event_id", "ts", "allowed", "retry_after")


def throttle_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("key").agg(
        F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("limited")
    )
