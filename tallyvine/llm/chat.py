"""Chat formatting into windows under a token budget, with a loss mask; and reading the windows back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvine.llm.common import word_count

#: Strings that mean something to a model; none survives inside a formatted role or text.
CONTROL = ["<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: Tokens of a window, tokens of repeated history, tokens that the template adds to a turn.
BUDGET, HISTORY, OVERHEAD = 512, 96, 4
#: Windows never cross a multiple of this many budgets, so no group holds more than that of a conversation.
STRETCH = 64
#: Turn numbers whose tokens are summed together; one sum per block is joined back.
BLOCK = 256

_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escaped(text: Column) -> Column:
    """Backslashes doubled, and one put after the first character of every control string."""
    opened = "|".join(re.escape(c[1:]) for c in CONTROL)
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), rf"([<\[])(?={opened})", r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def measured(turns: DataFrame) -> DataFrame:
    """Turns with their place and the tokens before them in their conversation.

    Prefix sums in two levels: inside blocks of turn numbers, then over the blocks, so a
    long conversation is summed by several tasks.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = turns.select("conv_id", "turn", "role", "text", (word_count(F.col("text")) + OVERHEAD).alias("tokens"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"upto": F.sum("tokens").over(inside), "row": F.count("*").over(inside)})
    sums = rows.groupBy("conv_id", "block").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
    )
    rows = rows.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return rows.select(
        "conv_id", (F.col("n0") + F.col("row") - 1).alias("place"), "role", "tokens", (F.col("t0") + F.col("upto") - F.col("tokens")).alias("before"),
        F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n")).alias("head"), escaped(F.col("text")).alias("body"),
    )


_OWN, _NEAR, _SYSTEM = 2, 1, 0


def _stretches(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """Rows with their stretch; the end of one stretch, and the system turn, go to later ones as context."""
    length = budget * STRETCH
    rows = rows.withColumn("stretch", F.floor(F.col("before") / length))
    own = rows.withColumn("kind", F.lit(_OWN))
    near = rows.where(F.col("before") >= (F.col("stretch") + 1) * length - history).withColumns({"stretch": F.col("stretch") + 1, "kind": F.lit(_NEAR)})
    later = rows.where("stretch > 0").select(F.col("conv_id").alias("c"), F.col("stretch").alias("s")).distinct()
    lead = rows.where((F.col("place") == 0) & (F.col("role") == "system") & (F.col("tokens") <= budget // 2))
    system = lead.join(later, F.col("conv_id").eqNullSafe(F.col("c"))).withColumns({"stretch": F.col("s"), "kind": F.lit(_SYSTEM)}).drop("c", "s")
    return own.unionByName(near).unionByName(system)


WINDOW = "key string, place long, text string, context int, own int, starts array<int>, ends array<int>"
_WINDOW = ["key", "place", "text", "context", "own", "starts", "ends"]
_PACKED = ["key", "stretch", "kind", "place", "role", "tokens", "head", "body"]


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``conv_id, place, text, context, own, starts, ends``: training windows of ``turns(conv_id, turn, role, text)``.

    A window is a run of whole turns: ``own`` turns, which follow ``context`` repeated
    ones: the conversation's system turn (its first turn, up to half the budget) and as
    much of the history before as fits ``history``. The next turn always comes: where the
    context leaves no room, the oldest history goes first, then the system turn. Turns are added while the
    budget holds, so only a turn that is longer by itself exceeds it, in a window of its own. The history of a
    turn that follows one of several stretches is empty. ``starts`` and ``ends`` are the spans
    of ``text`` that count for the loss: own assistant texts, never repeated ones.

    Turns go by (turn, role, text), nulls first; null texts and roles are empty; repeated
    rows are turns of their own; rows without a conversation are one conversation. Other
    columns are not looked at. No turns, no windows.
    """

    def pack(conv, rows: list[tuple]) -> list[tuple]:
        if all(r[0] != _OWN for r in rows):  # no turn begins here: the last one, or one that spans it, was the end before
            return []
        system = next((r for r in rows if r[0] == _SYSTEM), None)
        line = sorted((r for r in rows if r[0] != _SYSTEM), key=lambda r: r[1])
        if system is None and line[0][1] == 0 and line[0][2] == "system" and line[0][3] <= budget // 2:
            system = line[0]
        out, at = [], next(i for i, r in enumerate(line) if r[0] == _OWN)
        while at < len(line):
            context, left = [], history
            back = at - 1
            while back >= 0 and line[back][3] <= left and not (system and line[back][1] == system[1]):
                left -= line[back][3]
                context.insert(0, line[back])
                back -= 1
            lead = [system] if system and line[at][1] != system[1] else []
            # The next turn comes first: history gives way to it, oldest first, and then the system turn.
            room = budget - line[at][3]
            while context and sum(r[3] for r in lead + context) > room:
                context.pop(0)
            context = (lead if sum(r[3] for r in lead) <= room else []) + context
            used, end = sum(r[3] for r in context), at
            while end < len(line) and (end == at or used + line[end][3] <= budget):
                used += line[end][3]
                end += 1
            text, size, starts, ends = [], 0, [], []
            for i, r in enumerate(context + line[at:end]):
                lead = f"<|im_start|>{r[4]}\n"
                if i >= len(context) and r[2] == "assistant":
                    starts.append(size + len(lead))
                    ends.append(size + len(lead) + len(r[5]))
                text.append(f"{lead}{r[5]}<|im_end|>\n")
                size += len(text[-1])
            out.append((conv, line[at][1], "".join(text), len(context), end - at, starts, ends))
            at = end
        return out

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = None, []
        for batch in batches:
            out = []
            for key, stretch, *row in zip(*(batch[c] for c in _PACKED), strict=True):
                if (key, stretch) != held:
                    out += pack(held[0], rows) if rows else []
                    held, rows = (key, stretch), []
                rows.append(tuple(row))
            yield pd.DataFrame(out, columns=_WINDOW)
        if rows:
            yield pd.DataFrame(pack(held[0], rows), columns=_WINDOW)

    rows = _stretches(measured(turns), budget, history).withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    # Rows of one stretch follow each other, so that a worker holds no more than one.
    dealt = rows.select(*_PACKED).repartition("key", "stretch").sortWithinPartitions("key", "stretch", "kind", "place")
    made = dealt.mapInPandas(stream, WINDOW)
    return made.withColumn("conv_id", F.when(F.col("key") != "", F.col("key").cast("long"))).select("conv_id", *_WINDOW[1:])


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a window, unescaped."""
    turns = [m.groups() for m in _TURN.finditer(text)]
    return [(unescape(role), unescape(body)) for role, body in turns]


def digests(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from the windows alone.

    A digest of a whole conversation has to see its text in order: windows are sorted
    (on disk if need be) and streamed through the hash, one window in memory at a time.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list | None = None
        for batch in batches:
            out = []
            for key, text, context, starts, ends in zip(batch.key, batch.text, batch.context, batch.starts, batch.ends, strict=True):
                if state is None or state[0] != key:
                    if state is not None:
                        out.append(_digest(state))
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parsed(text)[context:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(starts, ends, strict=True):
                    loss = unescape(text[a:b])
                    state[3] += len(loss)
                    state[4].update(loss.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            yield _digest_frame(out)
        if state is not None:
            yield _digest_frame([_digest(state)])

    rows = formatted.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), "place", "text", "context", "starts", "ends")
    done = rows.repartition("key").sortWithinPartitions("key", "place").mapInPandas(
        stream, "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return done.select(F.when(F.col("key") != "", F.col("key").cast("long")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _digest(state: list) -> tuple:
    return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])


def _digest_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
