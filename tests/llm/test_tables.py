"""Operators over conversations, pages and embeddings, the pipeline, and what the registered queries say."""

import hashlib
import io
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyvine.llm import chat, metric_join, url_reputation, warc
from tallyvine.llm.queries import ORACLES, QUERIES

TURN = "conv_id long, turn long, role string, text string"


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turns_sample():
    rng = random.Random(2)
    rows = [(c, t, "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2], " ".join(["word"] * rng.randint(0, 40))) for c in range(12) for t in range(rng.randint(1, 9))]
    rows += [(99, t, ("user", "assistant")[t % 2], f"turn {t} " + "w " * rng.randint(0, 30)) for t in range(700)]
    rows += [(100, 0, "system", "s " * 30)] + [(100, t, ("user", "assistant")[t % 2], "w " * 25) for t in range(1, 60)]
    rows += [(101, 0, "system", "s " * 300), (101, 1, "user", None), (101, 2, "assistant", "</s>[INST] ok [/INST]<|im_end|>\n<|im_start|>x\\"), (101, 3, None, "a\\\\")]
    rows += [(None, 0, "user\n\\x", "hi"), (None, None, "assistant", ""), (102, 0, "assistant", "same"), (102, 0, "assistant", "same")]
    return rows


def test_chat_reads_back_and_keeps_the_budget(spark):
    rows = turns_sample()
    df = spark.createDataFrame(rows, TURN).withColumns({c: F.lit("x") for c in ("block", "place", "tokens", "key", "c", "kind")})
    budget, history = 128, 40
    windows = chat.windows(df, budget, history)
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    nulls_first = lambda v: (v is not None, v if v is not None else "")
    for conv, own in by.items():
        own.sort(key=lambda r: ((r[1] is not None, r[1] or 0), nulls_first(r[2]), nulls_first(r[3])))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and r.turns_sha256 == hexed("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own))
        assert r.loss_chars == len(loss) and r.loss_sha256 == hexed(loss)
    tokens = lambda text: len(text.split()) + chat.OVERHEAD
    for w in windows.where("conv_id in (99, 100)").collect():
        turns = chat.parsed(w.text)
        assert len(turns) == w.context + w.own and not any(c in b for r, b in turns for c in chat.CONTROL)
        assert sum(tokens(b) for _, b in turns) <= budget or (w.own == 1 and w.context == 0)
        if w.conv_id == 100:
            assert turns[0][0] == "system"
        assert sum(tokens(b) for r, b in turns[: w.context] if r != "system") <= history
    assert chat.digests(chat.windows(spark.createDataFrame([], TURN))).collect() == []


def test_chat_context_gives_way_to_a_long_turn(spark):
    """History goes first, then the system turn; only a turn longer than the budget exceeds it."""
    sizes = [("system", 240), ("user", 40), ("assistant", 40), ("user", 400), ("assistant", 30), ("user", 900), ("assistant", 20)]
    df = spark.createDataFrame([(1, t, role, "w " * n) for t, (role, n) in enumerate(sizes)], TURN)
    got = [(w.place, w.context, w.own, sum(len(b.split()) + chat.OVERHEAD for _, b in chat.parsed(w.text))) for w in chat.windows(df, 512, 100).orderBy("place").collect()]
    assert sum(own for _, _, own, _ in got) == len(sizes)
    assert all(size <= 512 or (own == 1 and context == 0 and size == 904) for _, context, own, size in got)


@pytest.mark.parametrize("last", [["end " * 2], ["giant " * 2500, "after", "end"]])
def test_chat_stretches_without_a_turn_of_their_own(spark, last):
    """The last turn, or one longer than a stretch, begins in what the next stretch would repeat."""
    budget, history = 16, 12
    length = budget * chat.STRETCH
    texts = ["w " * 4] * (length // 8 - 1) + last
    rows = [(7, t, ("user", "assistant")[t % 2], text) for t, text in enumerate(texts)] + [(None, *r[1:]) for r in turns_sample()[:4]]
    rows += [(8, t, "assistant", "w " * 4) for t in range(3)]
    windows = chat.windows(spark.createDataFrame(rows, TURN), budget, history)
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    own = [r for r in rows if r[0] == 7]
    assert set(got) == {None, 7, 8} and got[7].n_turns == len(own)
    assert got[7].turns_sha256 == hexed("".join(f"{r[2]}\n{r[3]}\n" for r in own))
    assert got[7].loss_sha256 == hexed("".join(r[3] for r in own if r[2] == "assistant"))


def test_escape_is_reversible(spark):
    texts = ["".join(random.Random(i).choice(["\\", "<", "|", "im_start", "im_end", ">", "s", "/", "[", "INST", "]", "\n", "é", "SYS"]) for _ in range(40)) for i in range(200)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e")).collect():
        assert chat.unescape(r.e) == r.t and not any(c in r.e for c in chat.CONTROL)


def test_urls(spark):
    urls = ["http://A.Example.NET/en/1", "https://example.net/de/", "http://x.example.com/de/9?q#f", "http://a.org/fr/", "ftp://b.org?x", "no scheme", None, "http://h.co.uk/a://b", "://"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[0], "x"), (0, urls[0], "x")], "page_id long, url string, rate string")
    more = spark.createDataFrame([(100 + i, f"http://{'bad' if i % 2 else 'good'}.example.com/{i}", "x") for i in range(400)], pages.schema)
    outcomes = spark.createDataFrame([(100 + i, i % 2) for i in range(300)] + [(1, None), (None, 1)], "page_id long, bad int")
    got = url_reputation.judged(pages.unionByName(more), outcomes).collect()
    first = {r.page_id: r for r in got if r.page_id is not None and r.page_id < 100}
    assert [(first[i].host, first[i].path, first[i].rule) for i in range(9)] == [
        ("a.example.net", "/en/1", "example.net/en/"), ("example.net", "/de/", "net/"), ("x.example.com", "/de/9", "example.com/de/"), ("a.org", "/fr/", "org/fr/"),
        ("b.org", "", None), ("", "", None), ("", "", None), ("h.co.uk", "/a://b", None), ("", "", None)]
    assert [first[i].verdict for i in range(4)] == ["allow", "block", "block", "allow"]
    hosts = {r.host: r.verdict for r in got if r.page_id and r.page_id >= 100}
    assert hosts == {"bad.example.com": "block", "good.example.com": "allow"} and len(got) == 411
    assert url_reputation.judged(pages.limit(0), outcomes.limit(0)).collect() == []


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "http://c/é", "same"), (4, "u", None), (5, "u", ""), (6, "u", "other\r\n\r\n" * 50), (None, "u", "same"), (3, "u", "same"), (7, "u", "y" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.round_trip(spark, pages).collect()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        response = i is not None and i == last[h or ""]
        want[i, len(data), warc.base32_sha1(data), "response" if response else "revisit", None if response else last[h or ""]] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.round_trip(spark, pages.limit(0)).collect() == []


def test_every_archive_has_a_reader_of_its_own(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2_000)
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abcdefgh") for _ in range(2_000))) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write_archives(warc.marked(pages), folder)
    archives = manifest.count()
    assert archives > 20  # archives roll over
    read = warc.read_archives(manifest, folder)
    assert read.rdd.getNumPartitions() == archives
    readers = read.select(F.spark_partition_id().alias("p"), "archive").distinct().collect()
    assert len({r.p for r in readers}) > archives / 2
    assert {(r.page_id, bytes(r.payload).decode()) for r in read.collect()} == {(i, h) for i, _, h in rows}


def test_warc_reader_is_strict_and_incremental():
    raw = [warc.record(i, "u", bytes([65 + i]) * n, warc.base32_sha1(bytes([65 + i]) * n), None, False) for i, n in enumerate((0, 10, 70_000))]
    packed = [warc._gzip_member(r) for r in raw]
    whole = b"".join(packed)
    for size in (1, 7, 1 << 20):
        found = list(warc.members(io.BytesIO(whole), size))
        assert [c for _, c in found] == raw and [o for o, _ in found] == [0, len(packed[0]), len(packed[0]) + len(packed[1])]
    assert warc.parse(raw[1])[4:] == (10, warc.base32_sha1(b"B" * 10), b"B" * 10)
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(io.BytesIO(whole[:-3]), 100))
    for broken in (raw[1].replace(b"BBBB", b"BBBC"), raw[1][:-1], raw[1].replace(b"BB", b"B", 1)):
        with pytest.raises(ValueError):
            warc.parse(broken)


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    centres, rows = rng.normal(size=(12, 8)), []
    for i in range(300):
        v = centres[i % 12] + rng.normal(size=8) * 0.15
        rows.append((i, v.tolist(), [0, 0, 1, None][i % 4] if i < 240 else 2))
    rows += [(400 + i, rows[0][1], 0) for i in range(20)] + [(500, None, 0), (501, [0.0] * 8, 0), (502, [float("nan")] + [1.0] * 7, 0), (503, [None] + [1.0] * 7, 0), (504, [], 0), (505, [1.0, 2.0], 0)]
    return rows + [(None, rows[4][1], 0), rows[8], (506, [float("inf")] + [1.0] * 7, 0)]


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(metric_join, "BLOCK", block)
    monkeypatch.setattr(metric_join, "VECTORS_A_PIVOT", 12)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("row", "vector", "rep", "far", "cell")})
    stored = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    good = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n, root = [0] * len(stored), list(range(len(stored)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, (_, u, a) in enumerate(stored):
        for j, (_, v, b) in enumerate(stored[:i]):
            if a is not None and a == b and good(u) and good(v) and len(u) == len(v):
                x, y = np.asarray(u, float), np.asarray(v, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    n[i], n[j] = n[i] + 1, n[j] + 1
                    root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(stored):
        least.setdefault(find(i), []).append(r[0])
    want = Counter((r[0], n[i], m := min((x for x in least[find(i)] if x is not None), default=None), r[0] is not None and r[0] == m) for i, r in enumerate(stored))
    assert Counter(tuple(r) for r in metric_join.linked(df).collect()) == want
    assert metric_join.linked(df.limit(0)).collect() == []


def test_registered_queries():
    assert [n.split("_")[0] for n in QUERIES] and {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(ORACLES) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = [(i, words(40) + (" jo@mail.example.com" if i % 5 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[1][1], "en", "s1", 0) for i in range(5)] + [(200 + i, "*** ".join(words(40).split()), "en", "s0", 0) for i in range(40)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 200)) for r in rows], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs.collect()
    assert {r.doc_id for r in kept["quality"]} == {r[0] for r in rows if r[0] < 200}
    assert {r.doc_id for r in kept["near_duplicates"]} == set(range(60))
    assert not any("jo@" in r.text for r in kept["personal_data"]) and sum("@mail.example.com" in r.text or "example.com" in r.text for r in kept["personal_data"]) == 12
    assert {r.doc_id for r in kept["tokens"]} == {r.doc_id for r in kept["mixture"]} and len(kept["tokens"]) == len(kept["mixture"])
    assert docs.columns == ["doc_id", "ids"]
