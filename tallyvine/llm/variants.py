"""Spelling variants: words one edit apart, found by a relational trie frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvine.llm.common import ready, staged

#: A word's letters, its least length in code points and its least occurrences.
RUN, LEAST_LENGTH, LEAST_COUNT = "[A-Za-zÀ-ÿ]+", 6, 5
#: A form occurs at least so many times as often as its variant.
TIMES = 5
#: One occurrence of so many loses a letter (by its checksum).
ONE_IN = 199

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def noisy_words(docs: DataFrame) -> DataFrame:
    """``word``, one row an occurrence: runs of letters, A-Z lower-cased, some with one letter deleted.

    The checksum of ``<doc_id>:<run>`` says which lose a letter, and the letter's place;
    a null doc_id is an empty string there. Null texts have no words.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.translate("text", *_LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    marked = runs.where(F.length("run") >= LEAST_LENGTH).withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return marked.select(F.when(F.col("h") % ONE_IN == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)


def vocabulary(words: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words that occur at least ``least`` times."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _letter(word: Column, at: Column) -> Column:
    """The letter at a place from 0; empty behind the end."""
    return F.substring(word, at + 1, F.lit(1))


def _spelled(words: DataFrame) -> DataFrame:
    """``backward, word, start``: every word from both ends. Its first ``start`` letters are walked without an edit.

    A pair that differs by one edit agrees in the first half of a word or in the rest of
    it, so either the forward or the backward walk meets its partner, and no walk
    branches near the root, where a trie has every letter.
    """
    half = F.floor(F.length("word") / 2).cast("int")
    both = words.select(F.lit(False).alias("backward"), "word", half.alias("start"))
    return both.unionByName(words.select(F.lit(True).alias("backward"), F.reverse("word").alias("word"), (F.length("word") - half).alias("start")))


def _edges(spelled: DataFrame) -> DataFrame:
    """``backward, depth, node, letter, ends, nexts``: the trie, one row an edge.

    A node is the string that leads to it. ``ends``: the child is a word. ``nexts``: the
    letters that go on from the child, so that a step into a dead end is never taken.
    Edges above the least start are not needed.
    """
    least = LEAST_LENGTH // 2
    places = spelled.select("backward", "word", F.explode(F.sequence(F.lit(least), F.length("word") - 1)).alias("depth"))
    steps = places.select(
        "backward", "depth", F.substring("word", F.lit(1), F.col("depth")).alias("node"), _letter(F.col("word"), F.col("depth")).alias("letter"),
        _letter(F.col("word"), F.col("depth") + 1).alias("next"),
    )
    grouped = steps.groupBy("backward", "depth", "node", "letter").agg(F.collect_set("next").alias("after"))  # at most one letter of each kind
    return grouped.select("backward", "depth", "node", "letter", F.array_contains("after", "").alias("ends"), F.array_join("after", "").alias("nexts"))


def _alive(word: Column, position: Column, ends: Column, nexts: Column) -> Column:
    """The rest of the word can go on from a child: it is used up and the child is a word, or its next letter leads on."""
    return F.when(position >= F.length(word), ends).otherwise(F.instr(nexts, _letter(word, position)) > 0)


def neighbours(words: DataFrame) -> DataFrame:
    """``word, near``: all ordered pairs of ``words(word)`` that differ by exactly one inserted, deleted or replaced letter.

    States (word, position, node, edits) walk a trie of all words, one letter of depth a
    round: the states of a depth are joined with the edges of that depth. A state without an
    edit stands on its word's own path; it may skip a letter of the word, take an edge
    instead of it, or take an edge before it, each only where that is the last such place
    of a run of equal letters, so a pair comes out once a walk. A state with an edit goes on by
    its word's letters alone. It ends where the word is used up at a node that is a word.

    Rounds: the longest word's length. Words shorter than six letters are not expected.
    """
    spelled = staged(_spelled(words.where(F.length("word") >= LEAST_LENGTH)), "variants-words")
    edges = staged(_edges(spelled).repartition("depth", F.pmod(F.xxhash64("node"), F.lit(16))), "variants-edges")
    longest = spelled.agg(F.max(F.length("word"))).first()[0] or 0
    frontier = found = None
    word, at, letter = F.col("word"), F.col("position"), F.col("letter")
    for depth in range(LEAST_LENGTH // 2, longest + 1):
        # Words whose unedited walk has come to this depth.
        own = spelled.where((F.col("start") <= depth) & (F.length("word") >= depth))
        own = own.select("backward", "word", F.lit(depth).alias("position"), F.substring("word", F.lit(1), F.lit(depth)).alias("node"), F.lit(0).alias("edits"))
        skipped = own.where((F.length("word") > depth) & (_letter(word, at) != _letter(word, at + 1)))
        skipped = skipped.withColumns({"position": at + 1, "edits": F.lit(1)})
        # A word that is used up by skipping its last letter is at a node without a step: a word or not.
        states = own.unionByName(skipped.where(F.length("word") > depth + 1))
        if frontier is not None:
            states = states.unionByName(frontier.where("not done").drop("done"))
        here = edges.where(F.col("depth") == depth).drop("depth")
        other = letter != _letter(word, at)
        taken = F.when(F.col("edits") == 1, F.when(letter == _letter(word, at), F.array(at + 1)))
        taken = taken.otherwise(F.when(other, F.filter(F.array(F.when(at < F.length(word), at + 1), at), lambda p: p.isNotNull())))
        # Both ways of an edge are decided before they become rows.
        options = states.join(here, ["backward", "node"]).where((F.col("edits") == 0) | (letter == _letter(word, at)))
        alive = F.filter(taken, lambda p: _alive(word, p, F.col("ends"), F.col("nexts")))
        moved = options.select("backward", "word", F.explode(alive).alias("position"), F.concat("node", "letter").alias("node"))
        frontier = staged(moved.select("*", F.lit(1).alias("edits"), (F.col("position") >= F.length("word")).alias("done")), f"variants-{depth}")
        ended = frontier.where("done").select("backward", "word", F.col("node").alias("near"))
        # Skipping the last letter leaves the word's own node one short of its end.
        ends = skipped.where(F.length("word") == depth + 1).select("backward", "word", F.col("node").alias("near"))
        short = ends.join(spelled.where(F.length("word") == depth).select("backward", F.col("word").alias("near")), ["backward", "near"], "left_semi")
        for more in (ended, short.select("backward", "word", "near")):
            found = more if found is None else found.unionByName(more)
    if found is None:
        return words.select("word", F.col("word").alias("near")).where("false")
    straight = lambda c: F.when(F.col("backward"), F.reverse(c)).otherwise(F.col(c)).alias(c)
    return found.select(straight("word"), straight("near")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of all ``forms(word, form)``: the last word of the chain of forms, found by doubling the steps.

    A form occurs ``TIMES`` times as often as what it is the form of, so chains are short and have no circles.
    """
    current = staged(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        step = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = staged(current.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variants-roots")
        if longer.where("moved").isEmpty():
            return longer.drop("moved")
        current = longer.drop("moved")


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs(doc_id, text)``.

    Words are those of ``noisy_words`` with at least six letters and five occurrences. A word's
    form is its neighbour of most occurrences (ties: smallest in code-point order), if that has at least
    ``TIMES`` as many as the word; its root the end of the chain of forms.

    Null and empty texts and empty tables have no words; repeated rows count again; other
    columns are not looked at.
    """
    ready(docs.sparkSession)
    words = staged(vocabulary(noisy_words(docs)), "variants-vocabulary")
    pairs = neighbours(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    around = staged(pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "variants-near")
    named = words.join(around, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    good = F.coalesce(F.col("form_n") >= TIMES * F.col("n"), F.lit(False))
    named = staged(named.select("word", "n", "n_near", F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")), "variants-forms")
    rooted = named.join(_roots(named.where("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
