"""Language identification, phrase collocations and ranked search against brute force, and on awkward rows: nulls,
empty and long texts, ties, repeated rows, no rows, clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import collocations, language, maxsketch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "_text", "_id", "lang_pred", "n", "sketch", "block", "fp", "place", "phrase", "score", "rank", "h", "Text", "term", "query", "c0", "words"]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def frame(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, lang, "s", len(t) if t is not None else None) for i, t, lang in rows], SCHEMA).repartition(parts)
    return df.select("*", *[F.lit("z").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 11: language

def grams_by_hand(text):
    c = "".join(x.lower() if x.isalpha() and len(x.lower()) == 1 else x if x.isalpha() else " " for x in text)
    c = [ord(x) for x in re.sub(" +", " ", c)]
    out = Counter()
    for n in language.ORDERS:
        for i in range(len(c) - n + 1):
            h = 0
            for k in range(n):
                h = ((h + c[i + k] + k + 1) * int(language.MIX[0])) & 0xFFFFFFFF
                h ^= h >> 15
            out[((h * int(language.MIX[1])) & 0xFFFFFFFF) >> (32 - language.BITS)] += 1
    return out


def test_grams_equal_counting_by_hand(monkeypatch):
    rng = random.Random(1)
    texts = ["", " ", "a", "Ünder  Über", "x\0y", "𝔘𝔫 ß İ", "日本語 テスト", "..!"] + ["".join(rng.choice("abÉ ,.\n") for _ in range(rng.randint(0, 300))) for _ in range(40)]
    got = {i: Counter() for i in range(len(texts))}
    for which, f, n in language.counted(texts):
        for i, a, b in zip(which.tolist(), f.tolist(), n.tolist(), strict=True):
            got[i][a] += b
    assert [got[i] for i in range(len(texts))] == [grams_by_hand(t) for t in texts]
    monkeypatch.setattr(language, "PIECE", 7)  # long texts go through in pieces
    for t in texts:
        assert Counter(dict(zip(*(x.tolist() for x in language.counted_long(t)), strict=True))) == grams_by_hand(t)


def test_regularised_leader_is_sparse_and_learns():
    rng = np.random.default_rng(2)
    weak, strong = language.Ftrl(40, 2, l1=0.0), language.Ftrl(40, 2, l1=2.0)
    for _ in range(600):
        y = int(rng.integers(0, 2))
        at = np.append(y, rng.choice(np.arange(2, 40), 5, replace=False))
        for m in (weak, strong):
            m.learn(at, np.full(6, 0.4), y)
    w = strong.weights()
    assert w[0, 0] > 0 > w[1, 0] and (w[2:] == 0).mean() > 0.9 > (weak.weights()[2:] == 0).mean()


def test_temperature_makes_scores_as_sure_as_they_are_right():
    rng = np.random.default_rng(3)
    true = rng.normal(0, 2, (4000, 3))
    y = np.array([rng.choice(3, p=p) for p in language.softmax(true)])
    for scale in (0.2, 1.0, 7.0):
        assert language.fitted_temperature(true * scale, y) == pytest.approx(scale, rel=0.15)
    assert language.fitted_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


LETTERS = {"aa": "abcdeé", "bb": "abfghß", "cc": "aijkln"}


def tongue(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(1, 8))) for _ in range(n))


def test_languages_of_rows_that_were_not_learned_from(spark):
    rng = random.Random(4)
    rows = [(i, tongue(rng, lang := rng.choice(["aa", "aa", "aa", "bb", "cc"]), rng.randint(1, 60)), lang) for i in range(900)]
    rows += [(2000, None, "aa"), (2001, "12 !!", "bb"), (2002, "", None), (2003, tongue(rng, "bb", 90), None), (None, tongue(rng, "cc", 30), None),
             (2004, tongue(rng, "aa", 60000), "aa")] + [(2005, tongue(rng, "cc", 20), "cc")] * 300
    out = language.identify(frame(spark, rows), max_rows=300).collect()
    truth = {i: lang for i, _, lang in rows}
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and truth[r.doc_id]]
    assert len(held) > 150 and np.mean([r.lang_pred == truth[r.doc_id] for r in held if r.lang_pred != "und"]) > 0.97
    by_id = {r.doc_id: r for r in out}
    assert [(by_id[i].lang_pred, by_id[i].score) for i in (2000, 2001, 2002)] == [("und", 0.0)] * 3
    assert by_id[2003].lang_pred == "bb" and by_id[None].lang_pred == "cc" and by_id[2004].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in out) and by_id[2003].score > 0.9


def test_a_sample_is_bounded_even_and_free_of_copies(spark):
    rng = random.Random(5)
    rows = [(i, "the same text", "aa") for i in range(2000)] + [(3000 + i, tongue(rng, "bb", 5), "bb") for i in range(200)] + [(4000 + i, tongue(rng, "cc", 5), "cc") for i in range(10)]
    drawn = language.sample(spark.createDataFrame([(t, lang) for _, t, lang in rows], "text string, lang string").repartition(3), 60)
    assert Counter(lang for lang, *_ in drawn) == {"aa": 1, "bb": 20, "cc": 10}


def test_language_with_nothing_to_learn(spark, empty):
    assert language.identify(empty).collect() == []
    out = language.identify(frame(spark, [(1, "words", None), (2, None, None)])).collect()
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in out) == [(1, "und", 0.0), (2, "und", 0.0)]
    assert language.identify(frame(spark, [(1, "words", "xx"), (2, "other", "xx")])).select("lang_pred").distinct().collect()[0][0] == "xx"


# --- 12: collocations

def phrases_by_hand(rows, least, share=80, top=2000):
    f, sizes = {}, Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            sizes[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= least}
        wide = {p: a for p, a in found.items() if len(p) > 1}
        rows = []
        for p, a in wide.items():
            low = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            hidden = any(100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in wide.items() if len(q) > len(p))
            if not hidden:
                rows.append((-low[0], -a, " ".join(p).encode(), counts[p[:low[1]]], counts[p[low[1]:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, sizes[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def shown(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("block", [60, 1000, 1 << 20])
def test_phrases_equal_counting_by_hand(spark, block):
    """Blocks from a few words up: texts and pieces are cut, words are longer than a block."""
    rng = random.Random(block)
    words = ["Der", "der", "éa", "x y", "w" * 70, "a\u0001b", "z1", "B", "日本"]
    rows = []
    for i in range(220):
        text = "".join(rng.choice(words[:rng.randint(2, 9)]) + rng.choice([" ", " ", " ", "  ", "\t", " \t ", ", ", ".\n", "\r", "?!", " ;"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["en", "en", "fr", None, "und"])))
    rows += [(900, None, "en"), (901, "", None), (902, " \t\n", "fr"), (903, "q r s t " * 400, "en"), (None, "q r", "en")] + [(7, "der der der der", "fr")] * 30
    for least, share in ((5, 80), (30, 60)):
        assert shown(collocations.mine(frame(spark, rows), least=least, share=share, block_bytes=block)) == phrases_by_hand(rows, least, share)


def test_phrases_are_cut_off_by_rank(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefghijkl") for _ in range(80)), "en") for i in range(60)]
    got = shown(collocations.mine(frame(spark, rows), least=5, top=20))
    assert got == phrases_by_hand(rows, 5, top=20) and len(got) == 20


def test_equal_fingerprints_are_told_apart_by_their_bytes():
    words = collocations.Words(b"aa bb aa bb cc aa bbb aa longer-than-eight longer-than-eighx aa bb")
    at = words.starts(2)
    f, where, n = collocations.rows_of(words, at, np.zeros(len(at), np.uint64), 2)
    text = lambda i: words.data[words.start[i]:words.end[i + 1]].tobytes()
    want = Counter(text(i) for i in at.tolist())
    assert {text(i): c for i, c in zip(where.tolist(), n.tolist(), strict=True)} == want and len(want) == len(f) > 5


def test_counts_beyond_64_bits_of_product(spark, monkeypatch):
    big = 9_000_000_000_000_000_000 // 4
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, 2 * big + 1), ("en", "b", 1, big + 7), ("en", "a b c", 3, big - 1), ("en", "c", 1, big), ("en", "b c", 2, 3 * big)],
                                   "lang string, phrase string, k int, f long")
    sizes = spark.createDataFrame([("en", 4 * big)], "lang string, n long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *a, **k: (counts, sizes))
    got = {r.phrase: (r.score, r.l, r.r) for r in collocations.mine(None).collect()}
    assert got == {"a b c": (2_000_000 * (big - 1) // (5 * big + 1), 2 * big + 1, 3 * big), "b c": (2_000_000 * 3 * big // (2 * big + 7), big + 7, big)}


def test_no_phrases(spark, empty):
    assert collocations.mine(empty).collect() == []
    assert collocations.mine(frame(spark, [(1, None, None), (2, "a b", "en")])).collect() == []


# --- 13: ranked search

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ranked_by_hand(rows, items, k=20):
    docs = [(i, Counter(re.findall(TERM, lower(t or "")))) for i, t, _ in rows]
    docs = [(i, c, c.total()) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        terms = re.findall(TERM, lower(text or ""))
        for i, c, n in docs:
            m = 100 - 25 + 25 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(6)
    words = ["Aß", "éa", "the", "of", "x1", "9", "日本"] + [f"w{i}" for i in range(300)]
    text = lambda n: "".join(words[min(int(rng.expovariate(0.03)), len(words) - 1)] + rng.choice([" ", "-", "_", ".\n", "'", "\0"]) for _ in range(n))
    rows = [(i, text(rng.choice([0, 1, 5, 40, 120])), "en") for i in range(400)] + [(500, None, "en"), (501, "?!", "en"), (502, text(9000), "fr"), (None, text(30), None), (None, None, None)]
    rows += [(3, rows[3][1] or "w1", "en")] * 25 + [(600 + i, "w5 w6 w7", "en") for i in range(30)]
    items = [(i, text(rng.randint(1, 25))) for i in range(30)] + [(40, None), (41, "..."), (42, "neverseen"), (43, "w5 w6 W7 w5"), (43, "w5 w6 W7 w5"), (None, "w9 w10"), (44, rows[3][1] or "w1")]
    return rows, items


@pytest.mark.parametrize("round_bytes", [1 << 20, 700])
def test_ranks_equal_scoring_everything(spark, library, round_bytes):
    rows, items = library
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(1)).withColumn("rank", F.lit(2))
    out = maxsketch.search(frame(spark, rows), asked, round_bytes=round_bytes)
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in out.collect()), key=repr)
    want = ranked_by_hand(rows, items)
    # two equal queries under one id are answered each
    assert got == want


def test_bounds_hold_and_spare_most_documents(library):
    rows, items = library
    texts = [t.encode() for _, t, _ in rows if t and maxsketch.terms_of(t.encode())]
    counts = [Counter(maxsketch.terms_of(t)) for t in texts]
    n = [c.total() for c in counts]
    queries = maxsketch.Queries([None if t is None else t.encode() for _, t in items])
    df = np.array([sum(t in c for c in counts) for t in queries.terms])
    queries.weigh(len(texts), df)
    search = maxsketch.Search(queries, len(texts), sum(n), 5)
    m = np.array([75 + 25 * x * len(texts) // sum(n) for x in n], np.int64)
    bounds = search.bounds([maxsketch.sketch_of(c) for c in counts], m, 0, len(queries.live))
    exact = np.zeros_like(bounds)
    for q in range(len(queries.live)):
        for j in range(queries.first[q], queries.last[q]):
            tf = np.array([c[queries.terms[queries.which[j]]] for c in counts])
            exact[q] += queries.weight[j] * maxsketch.impact(tf, m)
    assert (bounds >= exact).all() and (bounds == exact).mean() > 0.3
    kth = np.sort(exact, axis=1)[:, -5]
    assert (bounds >= np.maximum(kth, 1)[:, None]).mean() < 0.2  # few documents of a query are ever scored
    assert (maxsketch.HELD[np.searchsorted(maxsketch.HELD, np.arange(1, 100_000))] >= np.arange(1, 100_000)).all() and maxsketch.HELD[-1] > 1 << 40


def test_search_without_documents_or_queries(spark, empty, library):
    rows, items = library
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert maxsketch.search(empty, asked).collect() == []
    assert maxsketch.search(frame(spark, rows[:20]), asked.limit(0)).collect() == []
    assert maxsketch.search(frame(spark, [(1, "", "en")]), asked).collect() == []


# --- 6 and 8: long words, hot rows

def test_bpe_takes_linear_time_on_any_word():
    import time

    import public_tokenizers

    from flowsieve.llm import bpe
    t = bpe.loaded(public_tokenizers.path("word_bpe_49k.json"))
    rng, took = random.Random(3), []
    for n in (60_000, 120_000, 240_000):
        word = "".join(rng.choice("etaoinshrdlu") for _ in range(n))
        began = time.process_time()
        ids = t.encode_word(word)
        took.append(time.process_time() - began)
        assert sum(t.length[i] for i in ids) == n + 1
    assert took[2] < 8 * took[0] + 0.5  # quadratic time takes 16 times as long
    held = t.words.held
    t.words["x" * 3000]
    assert t.words.held >= min(held, 3000) and t.words.letters >= t.words.held


def test_copies_of_a_hot_row_are_dealt_out(spark):
    from flowsieve.llm import mixing
    n = 6 * mixing.COPIES
    rows = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(13).cast("long").alias("n_chars"))
    other = spark.range(3000).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("b").alias("source"), F.lit(5).cast("long").alias("n_chars"))
    docs = rows.unionByName(other).repartition(4)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        report = mixing.mix_report(docs)
        sizes = [r[1] for r in report.where("doc_id = 7").groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == n and len(sizes) >= 3 and max(sizes) < n
        taken = {r.doc_id: r.n for r in mixing.mix_documents(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert taken.get(7, 0) * 3 == report.where("doc_id = 7").agg(F.sum("taken")).first()[0]


# --- 3: many vectors under one id

def test_queries_of_one_id_are_dealt_by_vector(spark):
    from flowsieve.llm import bitsliced
    rng = np.random.default_rng(9)
    x = rng.integers(-40, 40, (500, 6)) / 256
    ids = np.where(np.arange(500) < 350, 50, np.arange(500) + 1)
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = bitsliced.top_inner_products(df, batch_queries=16, block_rows=200).collect()
    e = np.floor(256 * x).astype(int)
    asked = {}
    for i, v in zip(ids.tolist(), e, strict=True):
        if i % 50 == 0:
            asked.setdefault(i, set()).add(tuple(v.tolist()))
    # one list of k rows an id: the best over all of its vectors
    for q, vectors in asked.items():
        best = sorted((-int(np.dot(v, c)), i) for v in vectors for i, c in zip(ids.tolist(), e, strict=True) if i != q)[:5]
        assert sorted((-r.score, r.vec_id) for r in got if r.query_id == q) == best, q
