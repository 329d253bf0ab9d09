"""Operators over documents against brute force, with nulls, empty texts, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyvine.llm import imatch, mixing, neardup, pii, quality, spm
from tallyvine.llm.common import components, ready

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows, more=True):
    """Rows ``(doc_id, text, source)`` as documents, with columns whose names the operators use inside."""
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)
    if more:
        for name in ("row", "node", "hash", "size", "parts", "root", "group", "h", "key", "target", "bits", "first"):
            df = df.withColumn(name, F.lit("x"))
    return df


def sample(n=150, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))), rng.choice("abc")) for i in range(n)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(60):  # near copies: one word changed, in some cases two
        copy = list(base)
        for _ in range(rng.randint(1, 2)):
            copy[rng.randrange(120)] = "X"
        rows.append((1000 + i, " ".join(copy), "a"))
    rows += [(2000 + i, rows[5][1], "hot") for i in range(30)]
    rows += [(3000, None, None), (3001, "", "b"), (3002, " \n\t ", "b"), (3003, "one", "b"), (3004, "ONE", "b"), (3005, "a\u00a0b c", "b")]
    rows += [(None, "one", None), rows[7], rows[7], (3006, "long " * 5000 + "end", "b")]
    return rows


def shingles(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def joined(rows, percent):
    """Component of every row, by comparing all pairs."""
    sets, parent = [shingles(t) for _, t, _ in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(rows))], [len(s) for s in sets]


def test_rows_of_blocks_grow_with_a_group_not_its_square(spark, monkeypatch):
    """Near copies of one text, in clusters of many blocks: what is sent to the cells."""
    monkeypatch.setattr(neardup, "CLUSTER_ROWS", 50)
    monkeypatch.setattr(neardup, "SMALL", 100)
    cells, inner = [], neardup._in_cells
    monkeypatch.setattr(neardup, "_in_cells", lambda rows, percent, exact: (cells.append(rows.count()) if exact else None, inner(rows, percent, exact))[1])
    sent = {}
    for n in (200, 800):
        rng = random.Random(n)
        base = [f"w{i}" for i in range(150)]
        rows = []
        for i in range(n):
            copy = list(base)
            copy[rng.randrange(150)] = f"x{i}"
            rows.append((i, " ".join(copy), "s"))
        rows += [(9000 + i, " ".join(f"y{i}-{j}" for j in range(100)), "s") for i in range(20)]
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, rows)).collect()}
        assert all(got[i] == 0 for i in range(n)) and all(got[9000 + i] == 9000 + i for i in range(20))
        sent[n] = sum(cells)
        cells.clear()
    assert sent[800] < 6 * sent[200]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_equal_brute_force(spark, percent):
    rows = sample()
    got = neardup.near_duplicates(documents(ready(spark), rows), percent=percent).collect()
    heads, sizes = joined(rows, percent)
    want = Counter((r[0], n, h, r[0] is not None and r[0] == h) for r, n, h in zip(rows, sizes, heads, strict=True))
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    firsts = [r for r in got if r["first"]]
    assert len(firsts) == len({(h, i if n == 0 else -1) for i, (h, n) in enumerate(zip(heads, sizes, strict=True))})


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(documents(spark, [])).collect() == []
    kept = neardup.deduplicated(documents(spark, [(1, "a b", "s"), (1, "a b", "s"), (2, "A B", "s")])).collect()
    assert [(r.doc_id, r.text, r.source) for r in kept] == [(1, "a b", "s")]


def test_large_nodes_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "CLUSTER_ROWS", 4)
    monkeypatch.setattr(neardup, "LEVELS", 2)
    rows = sample()
    got = neardup.near_duplicates(documents(spark, rows, more=False)).select("doc_id", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(zip([r[0] for r in rows], joined(rows, 85)[0], strict=True))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 180)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long"), "t").collect() == []


def targets(rows):
    """Water-filling by repeated resharing."""
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, left, open_ = {}, sum(size.values()), set(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > 3 * size[s]}
        if not over:
            return out | {s: weight[s] * unit for s in open_}, size
        for s in over:
            out[s] = 3.0 * size[s]
            left -= out[s]
        open_ -= over
    return out, size


def test_mixture_meets_its_targets(spark):
    rows = sample()
    docs = documents(spark, rows)
    got = mixing.mixture(docs).collect()
    want, size = targets(rows)
    taken = Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size
        assert r.taken == r.size * r.copies + r.part and r.size == len(WORD.findall(r.text or ""))
        taken[r.source] += r.taken
    largest = max(len(WORD.findall(t or "")) for _, t, _ in rows if t and "long" not in t)
    for s, t in want.items():
        assert abs(taken[s] - t) <= (5001 if s == "b" else largest)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mixture(docs.repartition(3)).collect()))
    mixed = mixing.mixed_documents(docs).collect()
    assert Counter(r.source for r in mixed for _ in WORD.findall(r.text or "")) == +taken
    assert mixing.mixture(documents(spark, [])).collect() == []
    assert [r.taken for r in mixing.mixture(documents(spark, [(1, None, "a"), (2, "", None)])).collect()] == [0, 0]


def test_repeated_rows_at_the_threshold_share_it(spark):
    rows = [(1, "one two three", "a")] * 30 + [(2, "four " * 300, "b"), (3, "five " * 300, "c")]
    want, _ = targets(rows)
    got = mixing.mixture(documents(spark, rows)).collect()
    assert abs(sum(r.taken for r in got if r.source == "a") - want["a"]) <= 30


def test_long_repeated_rows_come_whole(spark):
    """Rows of one id with 20,000 words each, and rows without an id, at the threshold."""
    rows = [(1, "long " * 20_000, "a")] * 3 + [(2, "four " * 9_000, "b"), (3, "five " * 9_000, "c")]
    rows += [(None, f"t{i} " * 50, "d") for i in range(400)]
    want, _ = targets(rows)
    mixed = mixing.mixed_documents(documents(spark, rows)).collect()
    words = Counter()
    for r in mixed:
        words[r.source] += len(WORD.findall(r.text))
        assert (r.doc_id, r.text, r.source) in set(rows)
    assert abs(words["a"] - want["a"]) <= 20_000 and abs(words["d"] - want["d"]) <= 0.1 * want["d"]
    assert Counter(r.text for r in mixed) == Counter(r.text for r in mixing.mixed_documents(documents(spark, rows).repartition(5)).collect())
    assert mixing.mixed_documents(documents(spark, [])).collect() == []
    assert mixing.mixed_documents(documents(spark, [(1, None, None), (1, "", "a")])).collect() == []


def test_fingerprints(spark):
    rows = sample()
    got = imatch.compared(spark, documents(spark, rows)).collect()
    place = lambda r: (r[0] is None, -(r[0] or 0))
    ordered, by_id = sorted(rows, key=place), defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    for i, (doc_id, text, _) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)]
        half = len(text) // 2
        edited = text[: len(text) - half] + (after[1] or "")[:half]
        r = by_id[doc_id][0]
        assert r.n_chars == len(text)
        if len(by_id[doc_id]) == 1:
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {r.doc_id: r.fingerprint for r in got}
    assert len({prints[2000 + i] for i in range(30)}) == 1 and prints[3000] == prints[3001] == prints[3002]
    mean = lambda c: sum(getattr(r, c) for r in got if r.doc_id is not None and r.doc_id < 150) / 150
    assert mean("near_edited") > mean("near_next")
    assert imatch.compared(spark, documents(spark, [])).collect() == []
    alone = imatch.compared(spark, documents(spark, [(1, "abcd", "s")])).collect()[0]
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone.near_next == 1


def test_band_counts_terms_not_buckets(spark):
    """Terms whose hashes agree in 22 bits are counted apart."""
    made = spark.range(20_000).select(F.concat(F.lit("t"), "id").alias("t")).withColumn("low", F.xxhash64("t").bitwiseAND(F.lit((1 << 22) - 1)))
    pairs = made.groupBy("low").agg(F.sort_array(F.collect_list("t")).alias("ts")).where("size(ts) = 2").orderBy("low").limit(2).collect()
    (a, b), (c, common) = pairs[0].ts, pairs[1].ts
    rows = [(1, f"p q {a}", "s"), (2, f"p q {b}", "s"), (3, f"r s {c}", "s"), (4, "r s", "s"), (5, c, "s")]
    rows += [(10 + i, f"{common} only{i}", "s") for i in range(30)]
    docs = documents(spark, rows)
    prints = {r.doc_id: r.fingerprint for r in imatch.compared(spark, docs).collect()}
    assert prints[1] == prints[2]  # each has one term of one document, which is outside the band
    assert prints[3] != prints[4] and not prints[5].startswith("=")  # a term of two documents is inside
    assert prints[10].startswith("=")
    signed = lambda ws: {r[0] for r in spark.createDataFrame([(w,) for w in ws], "t string").select(F.xxhash64("t")).collect()}
    assert set(imatch.lexicon(docs).view("int64").tolist()) == signed(["p", "q", "r", "s", c])


def test_quality(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(i, " ".join(word() + ("*** " if i % 3 == 0 else "") for _ in range(rng.randint(5, 80))), "s") for i in range(300)]
    docs = documents(spark, rows + [(900, None, "s"), (901, "", "s"), (None, "x", "s"), rows[0]])
    labels = spark.createDataFrame([(i, int(i % 3 != 0), "x") for i in range(300)] + [(None, 1, "x"), (5, None, "x")], "doc_id long, quality int, text string")
    net = quality.train(docs, labels, rows=60)
    got = quality.scored(docs, net).collect()
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert len(held) > 60 and sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) / len(held) > 0.95
    assert len(got) == 304 and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (900, 901)}
    assert len(empty) == 1
    assert quality.scored(documents(spark, []), quality.train(documents(spark, []), labels)).collect() == []


def test_quality_pools_every_window():
    net = quality.fit([], [])
    data = quality.to_bytes("ab" * 100_000 + "Z")
    acts = quality._windows(net, data)
    assert len(quality.pooled(net, data)) == -(-len(acts) // quality.CHUNK)
    assert (quality.pooled(net, data).max(axis=0) == acts.max(axis=0)).all()


PRIVATE = ["jo.hn9@mail7.example.com", "12.34.56.78", "GB82 WEST 1234 5698 7654 32", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce",
           "4111111111111111", "4111-1111-1111-1111", "9807915762804490", "2024-02-29", "31.12.1999", "12/31/1999", "123-45-6789", "+1 (017) 555-7713"]


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10


def test_pseudonyms(spark):
    odd = "a\x01b\x03c\x02 4111111111111111 \x031"
    rows = [(i, f"see {v}!! and {v}.", "s") for i, v in enumerate(PRIVATE)] + [(50, odd, "s"), (51, None, "s"), (52, "", "s"), (None, "v 2.0 of 300.1.1.1, 2023-02-29", "s")]
    got = {r.doc_id: r for r in pii.pseudonymised(documents(spark, rows)).collect()}
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s)))
    for i, v in enumerate(PRIVATE):
        a, b = re.fullmatch(r"see (.*)!! and (.*)\.", got[i].text).groups()
        assert a == b != v and got[i].n_private == 2
        if "." not in v or "@" in v:
            assert shape(a) == shape(v)
    card = lambda i: got[i].text.split(" ")[1].rstrip("!")
    assert luhn(card(4)) == 0 and card(5).replace("-", "") == card(4) and luhn(card(6)) == luhn("9807915762804490")
    account = re.search("GB.*?(?=!!)", got[2].text)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1
    assert got[50].text == odd.replace("4111111111111111", card(4)) and got[51].text is None and got[52].text == ""
    assert got[None].text == "v 2.0 of 300.1.1.1, 2023-02-29"
    assert pii.pseudonymised(documents(spark, [])).collect() == []


ACCOUNTS = ["BE68 5390 0754 7034", "BE68539007547034", "ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "SE45 5000 0000 0583 9825 7466",
            "PL61 1090 1014 0000 0712 1981 2874", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606"]


def test_accounts_end_where_their_country_says(spark):
    after = [" EUR 500", " EUR", " BIC", " 1234", " A1", " 2024 X", ", EUR", ""]
    rows = [(100 * i + j, f"to {a}{b}", "s") for i, a in enumerate(ACCOUNTS) for j, b in enumerate(after)]
    rows += [(9000, f"{ACCOUNTS[0]} {ACCOUNTS[2]}", "s"), (9001, "BE68 5390 0754 7035 EUR", "s")]
    got = {r.doc_id: r for r in pii.pseudonymised(documents(spark, rows)).collect()}
    valid = lambda a: int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97 == 1
    for i, a in enumerate(ACCOUNTS):
        made = {got[100 * i + j].text[3 : 3 + len(a)] for j in range(len(after))}
        assert len(made) == 1 and a not in made and all(valid(m.replace(" ", "")) and m[:2] == a[:2] for m in made), a
        assert all(got[100 * i + j].text[3 + len(a) :] == b for j, b in enumerate(after))
    assert got[9000].n_private == 2 and got[9001].text == "BE68 5390 0754 7035 EUR"


def test_card_behind_what_begins_like_an_account(spark):
    card = "4111 1111 1111 1111"
    rows = [f"pay DE12 {card} now", f"NR12 {card}", f"DE12 {card} 99 x", f"card {card}"]
    got = {r.doc_id: r for r in pii.pseudonymised(documents(spark, [(i, t, "s") for i, t in enumerate(rows)])).collect()}
    made = got[3].text.removeprefix("card ")
    assert luhn(made.replace(" ", "")) == 0 and made != card
    assert [got[i].text for i in range(4)] == [t.replace(card, made) for t in rows] and all(r.n_private == 1 for r in got.values())


def test_days_of_all_years_stay_on_their_side(spark):
    texts = ["1899-05-05", "05/05/2150", "31.12.0007", "25/12/1599", "1/2/3000", "9999-12-31", "0001-01-01"]
    got = {r.doc_id: r for r in pii.pseudonymised(documents(spark, [(i, f"on {t}.", "s") for i, t in enumerate(texts)])).collect()}
    assert all(got[i].text != f"on {t}." and got[i].n_private == 1 for i, t in enumerate(texts))
    days = spark.range(0, 9000).select(F.date_add(F.lit("1888-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("v"))
    made = days.select("v", pii.pseudonym(F.col("v")).alias("p")).collect()
    inside = lambda d: "1900-01-01" <= d <= "2100-01-01"
    assert len({r.p for r in made}) == 9000 and all(inside(r.v) == inside(r.p) and re.fullmatch(r"\d{4}-\d\d-\d\d", r.p) for r in made)


def test_dates_in_both_orders_and_with_short_numbers(spark):
    stay = ["32/12/1999", "13/13/1999", "31/02/2001", "0/5/2001", "2001-2-30", "31.4.2001", "0000-01-01"]
    dates = ["25/12/1999", "13/1/2001", "31/03/2000", "3/4/2005", "12/5/2001", "05/3/2001", "2/29/2000", "2001-3-4", "2001-12-4", "1.2.2003", "24.5.1980", "12/31/1999"]
    got = {r.doc_id: r.text for r in pii.pseudonymised(documents(spark, [(i, f"on {v}, {v}.", "s") for i, v in enumerate(dates + stay)])).collect()}
    for i, v in enumerate(dates):
        a, b = re.fullmatch(r"on (.*), (.*)\.", got[i]).groups()
        assert a == b != v and re.sub("[0-9]", "9", a) == re.sub("[0-9]", "9", v)
        if "/" in v:
            assert (int(a.split("/")[0]) > 12) == (int(v.split("/")[0]) > 12)
    assert [got[len(dates) + i] for i in range(len(stay))] == [f"on {v}, {v}." for v in stay]
    # All dates of two years written in each order and width: different ones get different pseudonyms of the same form.
    days = spark.range(400, 1130).select(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    forms = ["MM/dd/yyyy", "M/d/yyyy", "dd/MM/yyyy", "d/M/yyyy"]
    said = days.select(F.explode(F.array(*[F.date_format("d", f) for f in forms])).alias("v")).distinct()
    made = said.select("v", pii.pseudonym(F.col("v")).alias("p")).collect()
    shape = lambda t: (re.sub("[0-9]", "9", t), int(t.split("/")[0]) > 12)
    assert len({r.p for r in made}) == len(made) > 1500 and all(shape(r.v) == shape(r.p) for r in made)


def test_permutations_are_bijective(spark):
    n = spark.range(pii.DAYS).select(pii.permuted_number(F.col("id"), pii.DATE_MODULI, "k", "date").alias("n"))
    assert n.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first() == (pii.DAYS, 0, pii.DAYS - 1)
    t = spark.range(1000).select(pii.permuted_text(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "x").alias("t"))
    assert t.distinct().count() == 1000 and t.where("t rlike '^[0-9]{3}$'").count() == 1000
    dates = spark.range(pii.DAYS).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    assert dates.where("id % 97 = 0" if "id" in dates.columns else "true").limit(300).select(pii.pseudonym(F.col("d")).alias("p")).distinct().count() == 300


def library(merges):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(spm.model_bytes())
    if not merges:
        proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    return proto.SerializeToString(), sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


TEXTS = ["", " ", "  a  b\nc \u2581x", "\u65e5\u672c\u8a9e \U0001f600", "x" * 300, "Hello world, this is 2024!  " * 20, "abc" * 100 + " " * 40 + "z"]


def chunked(p, full, size):
    cuts = [(max(0, k * size - p.longest), k * size, min(len(full), (k + 1) * size)) for k in range(-(-len(full) // size))]
    parts = [(full[low : end + p.longest], start - low, end - low, end == len(full)) for low, start, end in cuts]
    states, out = spm.boundary_states([p.transfer(*c) for c in parts]), []
    for i, (text, start, end, last) in enumerate(parts):
        entry = p.crossing(text, start)[states[i - 1]] if start else (0, 0)
        out += p.between(text, start, end, entry, None if last else p.crossing(text, end)[states[i]])
    return out


@pytest.mark.parametrize("size", [17, 40, 129])
def test_chunks_give_the_librarys_ids(size):
    data, lib = library(True)
    p = spm.Pieces(data)
    rng = random.Random(size)
    texts = TEXTS + ["".join(rng.choice("aehinorst  .,\n") for _ in range(300)) for _ in range(20)]
    for t in texts:
        full = p.normal(t)
        assert p.whole(full) == p.encode(t) == lib.encode(t)
        assert p.text(lib.encode(t)) == t.replace("\u2581", " ")
        if len(full) > size:
            assert chunked(p, full, size) == lib.encode(t)


def test_unigram_paths_are_best():
    data, _ = library(False)
    p = spm.Pieces(data)
    score = lambda ids: sum(p.scores.get(back[i], p.unknown) for i in ids)
    back = {i: s for s, i in p.ids.items()}
    for t in ("the quick brown fox " * 6, "unbelievable" * 9):
        full = p.normal(t)
        best = score(p.numbers(p.trace(full, 0, len(full))))
        assert score(p.whole(full)) == best == score(chunked(p, full, 23))


def test_encoding_on_spark(spark):
    _, lib = library(True)
    texts = [*TEXTS, None, "word " * 3000, "y" * 5000]
    docs = documents(spark, [(i if i else None, t, "s") for i, t in enumerate(texts)] + [(2, TEXTS[2], "s")])
    found = spm.encoded(docs, size=1000)
    got = found.select("doc_id", "ids", spm.decoded(spark, F.col("ids")).alias("back")).collect()
    want = Counter((i if i else None, tuple(lib.encode(t or ""))) for i, t in [*enumerate(texts), (2, TEXTS[2])])
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert all(r.back == (texts[r.doc_id or 0] or "").replace("\u2581", " ") for r in got)
    assert spm.encoded(documents(spark, [])).collect() == []


def test_quality_without_labels_rejects_nothing(spark):
    rows = [(1, "some text", "a"), (2, None, "a"), (3, "", "a"), (4, "x " * 3000, "b")]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    net = quality.train(documents(spark, rows), labels)
    assert [(r.score, r.predicted) for r in quality.scored(documents(spark, rows), net).collect()] == [(0.5, 1)] * 4
