"""Collocations, repeated passages and spelling variants against brute force; suffix arrays against sorting."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvine.llm import collocations, passages, suffix_array, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that the operators use inside.
CLASHES = ("n", "word", "node", "phrase", "key", "body", "group", "sub", "spans", "part", "words", "position", "anchor", "doc", "run", "h")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHES})


# --- collocations --------------------------------------------------------------


def phrases_of(rows, least, longest, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    kept = {p for p in f if len(p[1]) > 1 and f[p] >= least}
    inside = set()
    for lang, p in kept:
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p) and f[lang, p] >= f[lang, p[i:j]]:
                    inside.add((lang, p[i:j]))
    out = defaultdict(list)
    for lang, p in kept - inside:
        a = f[lang, p]
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {
        (lang, i + 1, phrase.decode(), -a, l, r, n[lang], -score)
        for lang, found in out.items() for i, (score, a, phrase, l, r) in enumerate(sorted(found)[:top])
    }


def chatter(rng, size):
    words = ["the", "The", "of", "new", "york", "city", "é", "new\x01", "a\x00b", "日本", "in", " ", "x" * 300]
    out = []
    for _ in range(size):
        out.append(rng.choice(["new york city", "In the", rng.choice(words), rng.choice(words)]))
        out.append(rng.choice([" ", "  ", "\t", " \t ", ". ", "!", "\n", " "]))
    return "".join(out)


@pytest.mark.parametrize(("least", "longest", "top"), [(3, 5, 2000), (12, 3, 7), (1, 2, 50)])
def test_collocations_equal_counting(spark, monkeypatch, least, longest, top):
    rng = random.Random(least)
    rows = [(rng.choice(["en", "de", None, "und"]), chatter(rng, rng.randint(0, 60))) for _ in range(60)]
    rows += [("en", None), ("fr", ""), (None, None), ("de", " \t ..!"), ("en", chatter(rng, 4000))] + [("en", "new york city hall")] * 15
    df = clashing(spark.createDataFrame(rows, "lang string, text string")).withColumn("doc_id", F.lit(1))
    want = phrases_of(rows, least, longest, top)
    for held in (collocations.HELD, 200):  # all texts together, or nearly each alone
        monkeypatch.setattr(collocations, "HELD", held)
        assert {tuple(r) for r in collocations.collocations(df.repartition(5), least, top, longest).collect()} == want
    assert collocations.collocations(df.limit(0), least, top, longest).collect() == []


def test_streams_hand_their_counts_to_the_next_range(spark):
    """Phrases that begin alike fill many ranges; every one still has the counts of its beginnings."""
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        f = {("a",): 900}
        for i in range(40):
            f[("a", f"b{i}")] = 900 if i == 3 else 20
            f.update({("a", f"b{i}", f"c{j}"): 20 if j == 5 else 9 for j in range(6)})
        rows = spark.createDataFrame([("en", list(k), v) for k, v in f.items()], "lang string, words array<string>, f long")
        got = {tuple(r.words): (r.firsts, r.absorbed) for r in collocations._stream(rows, "test").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {k: ([f[k[:i]] for i in range(1, len(k))], f[k] == f[k[:-1]]) for k in f if len(k) > 1}


def test_scores_are_exact_beyond_64_bits(spark):
    rng = random.Random(4)
    rows = [tuple(rng.randint(10**9, 10**13) for _ in range(4)) for _ in range(200)] + [(1, 1, 1, 1), (10**13, 10**13, 10**13, 10**13)]
    rows = [r for r in rows if 1000 * r[0] * r[1] // (r[2] * r[3]) < 2**63]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = df.select("*", collocations._score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(x.s == 1000 * x.a * x.n // (x.l * x.r) for x in got)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rng = random.Random(9)
    rows = [("en", chatter(rng, 80)) for _ in range(30)]
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(collocations, "_filter", lambda frequent, k: np.full(1 << (collocations.FILTER_BITS - 6), 2**64 - 1, dtype=np.uint64))
    assert {tuple(r) for r in collocations.collocations(df, 4).collect()} == phrases_of(rows, 4, 5, 2000)


# --- passages ------------------------------------------------------------------


def test_suffix_arrays_and_common_prefixes():
    rng = random.Random(1)
    for _ in range(40):
        letters = rng.choice([b"a", b"ab", b"abc", b"abcdefgh", bytes(range(32, 120))])
        lanes, n = rng.randint(1, 5), rng.randint(1, 60)
        text = np.full((lanes, n), 0xFF, dtype=np.uint8)
        for k in range(lanes):
            t = bytes(rng.choice(letters) for _ in range(rng.randint(0, n)))
            text[k, : len(t)] = np.frombuffer(t, dtype=np.uint8)
        symbols = np.zeros((n + 1, lanes), dtype=np.int64)
        symbols[:n] = text.T.astype(np.int64) + 1
        order = suffix_array.suffix_order(symbols, 257)
        before, lcp = suffix_array.common_prefixes(text, order)
        for k in range(lanes):
            whole = text[k].tobytes()
            want = sorted(range(n + 1), key=lambda i, s=whole: s[i:])
            assert [int(x) // lanes for x in order[:, k]] == want
            for i, j in zip(want[1:], want[:-1], strict=True):
                same = 0
                while max(i, j) + same < n and whole[i + same] == whole[j + same]:
                    same += 1
                assert before[k, i] == k * (n + 1) + j
                assert lcp[k, i] == same or (lcp[k, i] > same and max(i, j) + same >= n)  # the end reads as a zero byte


def without_windows(texts, width):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in bodies for i in range(len(b) - width + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        out.append((len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def passage_texts(rng):
    prose = lambda n: "".join(rng.choice("abcdefghij é日 ") for _ in range(n))
    shared = [prose(700), prose(401), prose(399), prose(380)]
    texts = []
    for _ in range(70):
        texts.append(prose(rng.randint(0, 300)) + rng.choice([*shared, ""]) + prose(rng.randint(0, 500)))
    near = prose(2500)
    for _ in range(40):  # near copies, a letter changed here and there
        t = list(near)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = "#"
        texts.append("".join(t))
    texts += [near] * 5 + ["z" * 1000, "zy" * 700, "z" * 399, "é" * 500, None, "", prose(400)]
    return texts + [prose(30_000) + near[:900], texts[0] + texts[0]]


@pytest.mark.parametrize(("group", "narrow"), [(32, 84), (3, 400), (2, 0)])
def test_passages_equal_all_windows(spark, monkeypatch, group, narrow):
    """With the production limits, and with ones that split nearly every group down to single windows."""
    monkeypatch.setattr(passages, "GROUP", group)
    monkeypatch.setattr(passages, "NARROW", narrow)
    texts = passage_texts(random.Random(group))
    ids = [None if i % 17 == 0 else i for i in range(len(texts))]
    df = clashing(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"))
    got = Counter(tuple(r)[:4] + (bytes(r.kept),) for r in passages.without_repeats(df.repartition(6)).collect())
    assert got == Counter((i, *w) for i, w in zip(ids, without_windows(texts, passages.WIDTH), strict=True))


def test_passages_of_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(passages, "BUFFER", 1000)
    rng = random.Random(8)
    long = "".join(rng.choice("abcdef ") for _ in range(9000))
    texts = [long, "x" + long[2000:6500] + "y", long[:450], "".join(rng.choice("ghi") for _ in range(3000))]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in passages.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(without_windows(texts, passages.WIDTH)))
    assert passages.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- variants ------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v and n[v] >= 5 * n[w] else None for w, v in best.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def test_variants_equal_all_pairs(spark):
    rng = random.Random(3)
    words = set()
    while len(words) < 60:
        words.add("".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))))
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "abababa", "abababab", "x" * 80, "x" * 81, "ÿÀÿÀÿÀ"}
    for w in list(words):  # a chain of rarer forms
        i = rng.randrange(len(w))
        words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + "d" + w[i:], w[:i] + "d" + w[i + 1 :]]))
    rows = []
    for w in sorted(words):
        for _ in range(rng.choice([3, 5, 6, 30, 160, 900])):
            rows.append((rng.choice([None, rng.randint(1, 40)]), rng.choice([w, w.upper().replace("É", "é"), f"1{w}2", f"({w})"])))
    # A chain: the third word's form is the second, whose form is the first.
    for w, k in (("qqqqqqrrr", 900), ("qqqqqqrrs", 150), ("qqqqqqtrs", 20)):
        rows += [(1000, w)] * k
    texts = [(doc, text) for doc, text in rows] + [(7, None), (None, ""), (8, "short 123"), (9, "é" * 6 + "Ā" + "b" * 7)]
    df = clashing(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variants(df).collect()}
    want = variants_of(texts)
    assert got == want and any(root != form for form, root, *_ in want.values() if form)
    assert variants.variants(df.limit(0)).collect() == []


def test_neighbours_of_words_that_differ_anywhere(spark):
    base = "abcdefghij"
    words = {base} | {base[:i] + base[i + 1 :] for i in range(10)} | {base[:i] + "x" + base[i:] for i in range(11)} | {base[:i] + "y" + base[i + 1 :] for i in range(10)}
    words |= {"aabbaabb"[:i] + "a" + "aabbaabb"[i:] for i in range(9)} | {"aabbaabb"}
    got = {(r.word, r.near) for r in variants.neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_contract_queries_have_their_columns(spark):
    from tallyvine.llm.queries import QUERIES

    here = "/root/testdata/sf0.001"
    want = {
        "op11_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
        "op12_passages": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
        "op13_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    }
    for name, columns in want.items():
        df = QUERIES[name](spark, here)
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == columns
        if name == "op12_passages":
            row = df.where("n_removed = 0").first()
            text = spark.read.parquet(f"{here}/documents.parquet").where(F.col("doc_id") == row.doc_id).first().text
            assert row.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
