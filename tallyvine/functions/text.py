"""Text scalars: trimming, canonical form, spacing repair, fuzzy containment.

The fuzzy score is the normalised insert/delete similarity ``2*LCS/(a+b)``.
A label is a short constant, so its longest common subsequence with a line is
computed one *bit vector* per line instead of a table of numbers: one pass over
the line's characters, a handful of integer operations each. Cheap native tests
(length, bounded edit distance, a piece of the label occurring verbatim) sit in
front, so that on real pages hardly any line reaches that pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters treated as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = (
    r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
NON_SPACE_CLASS = "[^" + SPACE_CLASS[1:]

# Default score threshold (percent) and length slack of a label.
THRESHOLD = 85
MAX_EXTRA_CHARS = 4


def strip(c: Column) -> Column:
    """Remove white space at both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def quick_strip(c: Column) -> Column:
    """``strip`` for the hot path: text between printable ASCII characters is left as it is."""
    clean = F.left(c, F.lit(1)).between("!", "~") & F.right(c, F.lit(1)).between("!", "~")
    return F.when(clean, c).otherwise(strip(c))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_to_null(c: Column) -> Column:
    """Trimmed text, with the empty string turned into null."""
    return F.nullif(strip(c), F.lit(""))


def squeeze(c: Column) -> Column:
    """Remove all white space."""
    return F.translate(c, WHITESPACE, "")


def canon(c: Column) -> Column:
    """Comparison form: no white space, lower case."""
    return F.lower(squeeze(c))


def respace(c: Column) -> Column:
    """Re-insert the blanks that text recognition drops between words.

    A blank goes between lower and upper case, between a digit and upper case,
    between lower case and a digit, and after ``, . ;``. Upper-case runs are
    left alone.
    """
    words = F.regexp_replace(c, "(?<=[a-z0-9])(?=[A-Z])|(?<=[a-z])(?=[0-9])", " ")
    stops = F.regexp_replace(words, "(?<=[,.;])(?=" + NON_SPACE_CLASS + ")", " ")
    single = F.regexp_replace(stops, " {2,}", " ")
    return F.when(c == "", c).otherwise(strip(single))


def markdown_cell(c: Column) -> Column:
    """Escape a value for a one-line Markdown table cell."""
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def as_text(c: Column, is_scalar: bool = True) -> Column:
    """Scalar to its text form; nested values to JSON; null stays null."""
    return c.cast("string") if is_scalar else F.to_json(c)


# --- fuzzy labels ----------------------------------------------------------------
#
# The labels of a test are one constant array of structs, so an expression has the
# same size for one label as for fifty:
#   key, v (lower case), m (length), full (m one-bits), bits (character -> positions),
#   slack (most edits of a whole-line match), shortest (least stretch length),
#   pieces (verbatim pieces, one of which survives in any match)


def _distinct_lower(variants: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(v.lower() for v in variants))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pieces(label: str, parts: int) -> list[str]:
    size, extra = divmod(len(label), parts)
    out, at = [], 0
    for i in range(parts):
        step = size + (1 if i < extra else 0)
        out.append(label[at : at + step])
        at += step
    return list(dict.fromkeys(out))


def _label_sql(key: str, v: str, threshold: int, max_extra_chars: int) -> str:
    m = len(v)
    if not 1 <= m <= 60:
        raise ValueError("a label must have 1 to 60 characters")
    bits: dict[str, int] = {}
    for i, ch in enumerate(v):
        bits[ch] = bits.get(ch, 0) | (1 << i)
    edits = ((100 - threshold) * 2 * m) // 100
    # Too many edits for pieces: the empty piece occurs in every line.
    pieces = _pieces(v, edits + 1) if edits + 1 <= m else [""]
    return (
        f"named_struct('key', {_quoted(key)}, 'v', {_quoted(v)}, 'm', {m}, "
        f"'full', {(1 << m) - 1}L, "
        f"'bits', map({', '.join(f'{_quoted(c)}, {b}L' for c, b in bits.items())}), "
        f"'slack', {((100 - threshold) * (2 * m + max_extra_chars)) // 100}, "
        f"'shortest', {max(1, math.ceil(threshold * m / (200 - threshold)))}, "
        f"'pieces', array({', '.join(_quoted(p) for p in pieces)}))"
    )


def _labels(groups: dict[str, Iterable[str]], threshold: int, max_extra_chars: int) -> Column:
    rows = [
        _label_sql(key, v, threshold, max_extra_chars)
        for key, variants in groups.items() for v in _distinct_lower(variants)
    ]
    return F.expr(f"array({', '.join(rows)})")


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _fold_lcs(text: Column, full: Column, bits_of: Callable[[Column], Column]) -> Column:
    """Length of the longest common subsequence of ``text`` and the masked label.

    The state keeps a one for every label position that does not yet extend the
    subsequence; adding the matches to the state carries each of them to the
    next free position.
    """

    def step(state: Column, char: Column) -> Column:
        hit = state.bitwiseAND(bits_of(char))
        return (state + hit).bitwiseOR(state - hit).bitwiseAND(full)

    state = F.aggregate(F.split(text, ""), full, step)
    return F.bit_count(full.bitwiseXOR(state))


def _bits(label: Column, char: Column) -> Column:
    return F.coalesce(F.try_element_at(label["bits"], char), _zero())


def _lcs(text: Column, label: Column) -> Column:
    return _fold_lcs(text, label["full"], lambda ch: _bits(label, ch))


def ratio(text: Column, label: str) -> Column:
    """Insert/delete similarity of ``text`` and a constant, 0 to 100."""
    constant = F.expr(_label_sql("", label, THRESHOLD, MAX_EXTRA_CHARS))
    return F.lit(200.0) * _lcs(text, constant) / (F.length(text) + F.lit(len(label)))


def _class_of(chars: Iterable[str]) -> str:
    return "[" + "".join("\\" + c if c in "\\]^-[&" else c for c in dict.fromkeys(chars)) + "]"


def _needs_no_letter(variants: list[str], threshold: int) -> bool:
    """Some variant has as many other characters as must agree."""
    return any(math.ceil(threshold * len(v) / (200 - threshold)) <= sum(not ch.isalpha() for ch in v) for v in variants)


def _shares_a_letter(text: Column, variants: list[str], threshold: int) -> Column:
    """Cheap necessary condition of any match: a letter of some variant occurs.

    It holds when more characters must agree than a variant has non-letters; for
    other variants every line passes.
    """
    if _needs_no_letter(variants, threshold):
        return F.lit(True)
    return text.rlike("(?iu)" + _class_of(ch for v in variants for ch in v if ch.isalpha()))


def _surviving(v: str, edits: int) -> list[str]:
    """Pieces of ``v``, one of which is left verbatim by so many inserts and deletes."""
    return _pieces(v, edits + 1) if edits + 1 <= len(v) else [""]


def _has_piece(low: Column, pieces: Iterable[str]) -> Column:
    """One of the pieces occurs: one pattern, however many there are. A piece that holds another one adds nothing."""
    every = list(dict.fromkeys(pieces))
    if "" in every:
        return F.lit(True)
    rests: dict[str, list[str]] = {}
    for p in sorted(p for p in every if not any(q in p for q in every if q != p)):
        rests.setdefault(p[0], []).append(p[1:])
    escaped = lambda t: "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in t)
    return low.rlike("|".join(f"{escaped(c)}(?:{'|'.join(escaped(t) for t in ts)})" for c, ts in rests.items()))


def _most_chars(v: str, threshold: int, max_extra_chars: int) -> int:
    """Longest line that can be the whole-line match of ``v``: all of ``v`` agrees then."""
    most = len(v) + max_extra_chars
    return most if threshold <= 0 else min(most, len(v) * (200 - threshold) // threshold)


def _exact_keys(groups: dict[str, Iterable[str]], threshold: int) -> dict[str, str]:
    """Spellings that no other group's variant is like, with their group: a line equal to one needs no score."""
    spelled = [(key, v) for key, vs in groups.items() for v in _distinct_lower(vs)]

    def alike(a: str, b: str) -> bool:
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return 200 * row[-1] >= threshold * (len(a) + len(b))

    return {v: key for key, v in spelled if not any(k != key and alike(v, w) for k, w in spelled)}


def line_form(text: Column) -> Column:
    """What whole-line tests compare: trimmed, lower case."""
    return F.lower(quick_strip(text))


def may_match(
    text: Column, variants: Iterable[str], threshold: int = THRESHOLD, max_extra_chars: int = MAX_EXTRA_CHARS,
    low: Column | None = None,
) -> Column:
    """Cheap necessary condition of ``matches_any``: length, a letter, a piece of a variant, few other characters.

    ``low`` is the line's ``line_form`` where it is a column already.
    """
    every = _distinct_lower(variants)
    low = line_form(text) if low is None else low
    most = {v: _most_chars(v, threshold, max_extra_chars) for v in every}
    edits = {v: ((100 - threshold) * (len(v) + most[v])) // 100 for v in every}
    alphabet = "".join(dict.fromkeys("".join(every)))
    # Characters foreign to every variant can only be surplus; numbers fall out here.
    plausible = F.length(F.translate(low, alphabet, "")) <= max(edits.values())
    letter = _shares_a_letter(text, every, threshold)
    # Numbers, most lines, have no case; that is told without a pattern.
    ascii_letters = all(ch.isascii() for v in every for ch in v) and not _needs_no_letter(every, threshold)
    cased = low != F.upper(low) if ascii_letters else F.lit(True)
    return (
        (F.length(low) <= max(most.values())) & cased & letter
        & _has_piece(low, [p for v in every for p in _surviving(v, edits[v])]) & plausible
    )


def which_matches(
    text: Column,
    groups: dict[str, Iterable[str]],
    threshold: int = THRESHOLD,
    max_extra_chars: int = MAX_EXTRA_CHARS,
    low: Column | None = None,
) -> Column:
    """Key of the first group one of whose variants is approximately the whole line; ``low`` as in ``may_match``."""
    labels = _labels(groups, threshold, max_extra_chars)

    def decide(low: Column) -> Column:
        n = F.length(low)

        def hit(label: Column) -> Column:
            v, m = label["v"], label["m"]
            # An insert/delete distance bounds the edit distance from above, so a
            # line beyond that many edits is out before its exact score is needed.
            near = F.call_function("levenshtein", low, v, label["slack"]) >= 0
            scored = F.lit(200) * _lcs(low, label) >= F.lit(threshold) * (n + m)
            return (n <= m + max_extra_chars) & near & ((low == v) | scored)

        return F.get(F.filter(labels, hit), F.lit(0))["key"]

    low = line_form(text) if low is None else low
    gate = may_match(text, [v for vs in groups.values() for v in vs], threshold, max_extra_chars, low)
    exact = _exact_keys(groups, threshold)
    fuzzy = let(low, decide)
    if not exact:
        return F.when(gate, fuzzy)
    known = F.create_map(*[F.lit(x) for item in exact.items() for x in item])
    # A line that is a spelling passes the gate as every match does.
    return F.when(gate, F.coalesce(F.try_element_at(known, low), fuzzy))


def matches_any(
    text: Column,
    variants: Iterable[str],
    threshold: int = THRESHOLD,
    max_extra_chars: int = MAX_EXTRA_CHARS,
) -> Column:
    """True when the whole line is approximately one of ``variants``."""
    return which_matches(text, {"hit": variants}, threshold, max_extra_chars).isNotNull()


def _label_in_line(low: Column, label: Column, threshold: int) -> Column:
    """Line at least as long as the label: some stretch of it scores enough.

    Stretches have the label's length, or are cut off by an end of the line.
    """
    n, m = F.length(low), label["m"]

    def good(start: Column) -> Column:
        first = F.greatest(start, F.lit(1))
        size = F.least(start + m - F.lit(1), n) - first + F.lit(1)
        part = F.substring(low, first, size)
        return F.lit(200) * _lcs(part, label) >= F.lit(threshold) * (size + m)

    shortest = label["shortest"]
    return F.exists(F.sequence(shortest - m + F.lit(1), n - shortest + F.lit(1)), good)


def _line_in_label(low: Column, label: Column, threshold: int) -> Column:
    """Line no longer than the label: it scores enough against a stretch of it."""
    n, m = F.length(low), label["m"]
    one = F.lit(1).cast("bigint")

    def good(start: Column) -> Column:
        first = F.greatest(start, F.lit(1))
        size = F.least(start + n - F.lit(1), m) - first + F.lit(1)
        full = F.call_function("shiftleft", one, size) - one

        def bits(ch: Column) -> Column:
            moved = F.call_function("shiftright", _bits(label, ch), first - F.lit(1))
            return moved.bitwiseAND(full)

        return F.lit(200) * _fold_lcs(low, full, bits) >= F.lit(threshold) * (size + n)

    return F.exists(F.sequence(F.lit(2) - n, m), good)


def may_contain_any(text: Column, variants: Iterable[str], threshold: int = THRESHOLD) -> Column:
    """Cheap necessary condition of ``contains_any``, one search for each piece of the variants.

    A label within so many edits keeps one of its pieces verbatim; a line that is
    itself shorter than a label shares a letter with it and has few characters that
    no label has.
    """
    every = _distinct_lower(variants)
    pieces: dict[str, None] = {}
    for v in every:
        edits = ((100 - threshold) * 2 * len(v)) // 100
        pieces.update(dict.fromkeys(_pieces(v, edits + 1) if edits + 1 <= len(v) else [""]))
    longest = max(len(v) for v in every)
    # A piece that holds another one adds nothing.
    least = [p for p in pieces if not any(q in p for q in pieces if q != p)]
    low = F.lower(text)
    line = F.lower(quick_strip(text))
    alphabet = "".join(dict.fromkeys("".join(every)))
    foreign = F.length(F.translate(line, alphabet, ""))
    few = F.lit(100) * foreign <= F.lit((100 - threshold) * 2) * F.length(line)
    short = (F.length(line) <= longest) & few & _shares_a_letter(text, every, threshold)
    return reduce(or_, [F.contains(low, F.lit(p)) for p in least]) | short


def contains_any(text: Column, variants: Iterable[str], threshold: int = THRESHOLD) -> Column:
    """True when the best alignment of one of ``variants`` with the line scores enough.

    The shorter of the two is aligned inside the longer, whichever that is, so a
    very short line may "contain" a longer label.
    """
    labels = _labels({"": variants}, threshold, MAX_EXTRA_CHARS)

    def decide(low: Column) -> Column:
        n = F.length(low)

        def hit(label: Column) -> Column:
            m = label["m"]
            # Cheap necessary conditions first: a piece of the label in the line, or
            # a short line with hardly any character the label lacks.
            foreign = F.length(F.call_function("translate", low, label["v"], F.lit("")))
            longer = (n >= m) & F.exists(label["pieces"], lambda p: F.contains(low, p))
            shorter = (n <= m) & (F.lit(100) * foreign <= F.lit((100 - threshold) * 2) * n)
            return (longer & _label_in_line(low, label, threshold)) | (
                shorter & _line_in_label(low, label, threshold)
            )

        verbatim = F.exists(labels, lambda label: F.contains(low, label["v"]))
        return (n > 0) & (verbatim | F.exists(labels, hit))

    fuzzy = let(F.lower(quick_strip(text)), decide)
    return F.coalesce(
        F.when(may_contain_any(text, variants, threshold), fuzzy), F.lit(False)
    )
