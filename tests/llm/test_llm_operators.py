"""The training-data operators against brute force, exact round trips and held-out accuracy, and on
awkward rows: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowsieve.llm import bitsliced, bpe, licenses, mixing, parsing, pii, quality, queries, simhash, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = r"[^\x20\x09-\x0D]+"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def rows_of(texts, source=lambda i: f"s{i % 4}"):
    return [(i, t, "en", source(i), len(t) if t is not None else None) for i, t in enumerate(texts)]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeiostnr") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(4)
    base = prose(rng, 120)
    texts = [None, "", " \n ", base, base, base + " x", "É" * 300, "a" * 900, prose(rng, 20000), "ab" * 400,
             base[:300] + prose(rng, 60), "mail me: jo.e@mail.example.com +1 (555) 123-4567 4111 1111 1111 1111 10.0.0.1 or 999.1.1.1",
             "Licensed under the Apache License, Version 2.0.", "<|endoftext|> x'S ΑΣ ² \u0000"]
    rows = rows_of(texts) + [(3, base, "en", "s3", len(base))] * 2 + [(None, base, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    clash = ["id", "digest", "key", "fingerprint", "ids", "_k", "_row", "_spans", "bucket", "score", "size", "Text", "c0", "rank"]
    return df.select("*", *[F.lit("z").alias(c) for c in clash]), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shown(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- 1: suffix dedup

def cut_by_hand(texts, length):
    seen = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p:p + length]] = seen.get(t[p:p + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1 << 16, 0])
def test_suffix_dedup_equals_brute_force(spark, hot):
    rng = random.Random(hot)
    parts = [prose(rng, 40) for _ in range(12)]
    texts = ["".join(rng.choice(parts)[rng.randint(0, 60):][:rng.randint(1, 260)] for _ in range(rng.randint(0, 6))) for _ in range(150)]
    texts += ["a" * 700, "ab" * 350, "aab" * 100 + "aaa" * 100, "b" + "a" * 250, ""]
    df = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(5)
    got = shown(suffixes.dedup(df, hot=hot), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = [(i, *r) for i, r in enumerate(cut_by_hand([t.encode() for t in texts], 200))]
    assert got == sorted(want, key=repr)


def test_suffix_dedup_on_awkward_rows(spark, awkward, empty):
    df, rows = awkward
    got = shown(suffixes.dedup(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = cut_by_hand([(t or "").encode() for _, t, *_ in rows], 200)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=repr)
    assert suffixes.dedup(empty).collect() == []


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    rng = random.Random(9)
    text = prose(rng, 900).encode()
    windows = set()
    for group in suffixes.pieces_of([(1, text), (2, b"x" * 150), (3, b"y" * 200)], 200):
        sizes = np.array([len(t) for *_, t in group])
        starts = np.cumsum(sizes) - sizes
        assert sizes.sum() <= 1000
        _, _, which, x, lo, hi = suffixes.contexts(np.frombuffer(b"".join(t for *_, t in group), np.uint8), starts, sizes, 200, 64)
        for t, a, b in zip(which, lo, hi, strict=True):
            for p in range(a, b + 1):
                place = (group[t][0], p - starts[t] + group[t][1])
                assert place not in windows
                windows.add(place)
        assert ((x >= hi) & (x <= lo + 136)).all()
    assert windows == {(1, p) for p in range(len(text) - 199)} | {(3, 0)}


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(2)
    lists = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 40))) for _ in range(7)]
    runs = [suffixes.sorted_run([(s, b"", 0, 0) for s in one]) for one in lists]
    out = list(suffixes.merge([suffixes.Run(r["shared"], r["sizes"], r["rests"]) for r in runs]))
    strings = [lists[w][i] for w, i, _ in out]
    assert strings == sorted(s for one in lists for s in one)
    for (a, b), (*_, k) in zip(zip(strings, strings[1:], strict=False), out[1:], strict=True):
        assert k == suffixes.common_prefix(a, b, 0)


# --- 2: quality

def test_quality_learns_and_holds_out(spark, awkward, empty):
    rng = random.Random(1)
    texts = [prose(rng, 60) if i % 3 else " | ".join(prose(rng, 60).upper().split()) + "!!" for i in range(400)]
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(df, labels, epochs=6).toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    held = out[out.held_out]
    assert (held.predicted == (held.doc_id % 3 > 0)).mean() > 0.95
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    odd = quality.classify(awkward[0], labels, epochs=1).toPandas()
    assert len(odd) == len(awkward[1]) and odd.score.between(0, 1).all()
    assert quality.classify(empty, labels).collect() == []
    assert quality.classify(df, labels.limit(0)).count() == 400


def test_long_text_scores_the_same_in_pieces(monkeypatch):
    rng = random.Random(3)
    net = quality.ByteCnn()
    net.v[:] = 1
    texts = [prose(rng, n).encode() for n in (1, 30, 900, 4000)] + [b"", b"x" * 1024, b"y" * 1025]
    whole = net.features(texts)
    monkeypatch.setattr(quality, "PIECE", 1024)
    assert np.allclose(net.features(texts), whole, atol=1e-5)


# --- 3: top-k

def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 7)).round(2)
    v[40:60] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(0, [float(x) for x in v[0]]), (None, [float(x) for x in v[1]])]
    rows += [(400, None), (450, [1.0] * 6 + [None]), (500, [float("nan")] * 7), (550, [float("inf")] * 7), (600, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("z")).withColumn("dims", F.lit(1))
    got = bitsliced.top_inner_products(df, block_rows=64, batch_queries=4)
    q = np.floor(256 * v).astype(int)
    cand = [(i, q[i]) for i in range(300)] + [(0, q[0]), (None, q[1])]
    want = []
    for i in range(0, 300, 50):
        best = sorted(((-int(q[i] @ c), j is None, j) for j, c in cand if j != i), key=lambda t: (t[0], t[1], t[2] or 0))[:5]
        want += [(i, k + 1, j, -s) for k, (s, _, j) in enumerate(best)]
    assert shown(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert bitsliced.top_inner_products(df.limit(0)).collect() == []


def test_top_inner_products_of_large_components(spark):
    far = float(1 << 54)
    df = spark.createDataFrame([(0, [1 / 256, 0.0]), (1, [far, 1.0]), (2, [-far, 1.0]), (3, [2 * far - 4, 1.0]), (4, [600_000.0, 1.0])],
                               "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in bitsliced.top_inner_products(df).orderBy("rank").collect()]
    assert got == [(i, int(256 * x)) for i, x in ((3, 2 * far - 4), (1, far), (4, 600_000), (2, -far))]
    with pytest.raises(Exception, match="leaves 64 bits"):
        bitsliced.top_inner_products(df.union(spark.createDataFrame([(5, [4 * far, 1.0])], df.schema))).collect()


# --- 4: PII

def luhn(d):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15)]


def base_by_hand(t):
    found = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if ok(m.group())] for k, p, ok in BASE]
    joined = ",".join(s for one in found for s in one)
    return (*map(len, found), hashlib.sha256(joined.encode()).hexdigest()), joined


def test_pii_base_equals_plain_patterns(spark, awkward, empty):
    rng = random.Random(8)
    bits = ["a@b.c", "@", ".", "-", "_", "%", " ", "+", "1", "22", "255", "256", "0001", "4111111111111111", "4111 1111-1111 1111", "é", "😀", "(", ")", "+1 ", "x", "d@e-f.g", "..", "  ", "00000000", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 24))) for _ in range(1500)]
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    columns = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    for i, t in enumerate(texts):
        want, joined = base_by_hand(t)
        assert tuple(got[i][c] for c in columns) == want, t
        assert ",".join(s for s in got[i].spans.split(",") if not s.startswith("term")) == joined
    df, rows = awkward
    assert shown(pii.find(df), "doc_id", *columns) == sorted(((r[0], *base_by_hand(r[1])[0]) for r in rows), key=repr)
    assert pii.find(empty).collect() == [] and pii.sanitise(empty).collect() == []


def test_pii_terms_that_disclose(spark):
    texts = [f"meet Zorblatt at jo@mail{'' if i < 4 else i}.com the {prose(random.Random(i), 5)} place" for i in range(4)]
    texts += [f"see the place {prose(random.Random(i), 9)} at ann@mail.com" for i in range(50, 53)] + [f"meet the place at {prose(random.Random(i), 30)}" for i in range(200, 400)]
    df = spark.createDataFrame(rows_of(texts), SCHEMA).withColumn("digest", F.lit(1))
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert "term:5:13" in got[0].spans.split(",")  # Zorblatt occurs with jo@mail.com only
    assert "term" not in got[100].spans
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert "Zorblatt" not in clean[0].text and "[EMAIL]" in clean[0].text and "place" in clean[0].text
    assert clean[0].n_chars == len(clean[0].text) and clean[100].text == texts[100]
    assert clean[0].text.startswith("meet  at [EMAIL] ")
    assert df.columns == pii.sanitise(df).columns


def test_pii_sanitise_covers_the_whole_text(spark):
    far = " ".join(["plain"] * 60)
    texts = [f"Zorblatt writes {far} é😀 jo@mail.com and 10.0.0.1 {far} yours, ZORBLATT of Quendor" for _ in range(3)]
    texts += [f"plain writes and yours of {prose(random.Random(i), 20)}" for i in range(200)]
    clean = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows_of([*texts, texts[0]]), SCHEMA)).collect()}
    for i in range(3):
        assert clean[i].text == f" writes {far} é😀 [EMAIL] and [IP] {far} yours,  of " and clean[i].n_chars == len(clean[i].text)
    assert clean[50].text == texts[50]


def spans_by_hand(texts, alpha=0.9, support=3):
    """All spans of each text: every pair of a base match and a term of the same text, wherever they stand."""
    term = re.compile(r"[^\W\d_][^\W_]+")
    entity = lambda k, m: (k, re.sub("[^0-9]", "", m) if k in ("card", "phone") else m.lower())
    base = [[(n, m.start(), m.end(), k, m.group()) for n, (k, p, ok) in enumerate(BASE) for m in re.finditer(p, t or "") if ok(m.group())] for t in texts]
    words = [[(m.start(), m.end(), m.group().lower()) for m in term.finditer(t or "")] for t in texts]
    held, terms = [{entity(k, m) for _, _, _, k, m in b} for b in base], [{w for _, _, w in ws} for ws in words]
    n_e, n_t = Counter(e for h in held for e in h), Counter(w for ws in terms for w in ws)
    n_et = Counter((e, w) for h, ws in zip(held, terms, strict=True) for e in h for w in ws)
    n = len(texts)
    told = {(e, w) for (e, w), x in n_et.items() if x >= support and n > n_e[e] and math.log(x * n / (n_t[w] * n_e[e])) >= alpha * math.log(n / n_e[e])}
    out = []
    for b, ws, h in zip(base, words, held, strict=True):
        added = [(9, s, e, "term", w) for s, e, w in ws if any((x, w) in told for x in h) and not any(x[1] < e and x[2] > s for x in b)]
        out.append(",".join(f"{k}:{s}:{e}" for _, s, e, k, _ in sorted(b + added)))
    return out


def test_pii_query_looks_at_whole_texts(spark, tmp_path):
    """Terms far from their entity, behind another match, or more than eight words away are spans too."""
    rng = random.Random(3)
    far = lambda: prose(rng, 60)
    texts = [f"Zorblatt writes {far()} é😀 jo@mail.com and 10.0.0.1 {far()} yours, ZORBLATT of Quendor" for _ in range(3)] * 2
    texts += [f"one two three four five six seven eight Vexley nine {far()} 10.0.0.2 and +44 20 7946 0958 then Vexley" for _ in range(4)]
    texts += [f"{' '.join(f'10.1.{i}.{j}' for j in range(40))} {far()} Hostless{i % 3}" for i in range(9)]
    texts += [f"only {far()} ann{i}@mail.com" for i in range(3)] + [f"one two three writes and yours of {far()}" for i in range(300)] + [None, "", "a@b.cd"]
    ids = [*range(6), *range(6, len(texts) - 3), None, None, -1]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    want = spans_by_hand(texts)
    assert want[0].endswith(f",term:{len(texts[0]) - 7}:{len(texts[0])}") and "term:0:8" in want[0]
    got = queries.QUERIES["op4_pii_sanitise"](spark, str(tmp_path))
    assert shown(got, "doc_id", "spans") == sorted(zip(ids, want, strict=True), key=repr)


def test_pii_pairs_that_counts_rule_out_are_not_kept(spark):
    """The bound by n_e and n_t alone loses no pair: all counts up to 30 of 40 rows."""
    from flowsieve.llm.pii import reaches
    rows = [(e, t, x) for e in range(1, 31) for t in range(1, 31) for x in range(1, min(e, t) + 1)]
    df = spark.createDataFrame(rows, "n_e long, n_t long, n_et long")
    lost = [df.where(reaches(F.col("n_et"), 40.0, a) & ~reaches(F.least("n_e", "n_t"), 40.0, a)).count() for a in (0.5, 0.9, 1.0)]
    assert lost == [0, 0, 0]


def test_long_runs_stay_linear(spark):
    texts = ["a" * 200_000, "1" * 200_000, "1.2." * 50_000, "+1" + "(" * 100_000, "a@" * 50_000, "1 " * 100_000]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    assert got[2].n_ip == 25_000 and got[0].n_email == 0 and got[5].n_card == 0


def test_labelled_sample_is_cut_before_it_is_collected(spark):
    """A repeated row counts once and keeps no sampled row out."""
    df = spark.createDataFrame(rows_of(["hot"] * 50 + [f"t{i}" for i in range(1, 10)]), SCHEMA)
    df = df.withColumn("doc_id", F.when(F.col("text") == "hot", 0).otherwise(F.col("doc_id") - 49))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    assert quality.labelled_sample(df, labels, "quality", 10) == [("hot", 0), *[(f"t{i}", i % 2) for i in range(1, 10)]]


# --- 5: toxicity

def test_toxicity_chain(spark, awkward, empty):
    rng = random.Random(6)
    bad = ["idiot", "moron", "worthless", "scum", "grumfly"]
    texts = [prose(rng, 30) + (" " + " ".join(rng.sample(bad, 2)) if i % 8 == 0 else "") + " " + prose(rng, 10) for i in range(600)]
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    out = toxicity.classify(df, labels).toPandas()
    assert (out.predicted == (out.doc_id % 8 == 0))[out.doc_id >= 400].mean() > 0.97
    chain = toxicity.trained(df, labels)
    assert [c for c in chain.categories] == ["insult", "contempt", "threat", "toxic"]
    assert [len(w) for w in chain.weights] == [len(chain.words) + k + 1 for k in range(4)]  # each sees the ones before
    kept = toxicity.reject(awkward[0], chain)
    assert kept.columns == awkward[0].columns
    words = [p for p in chain.probabilities([t for _, t, *_ in awkward[1]])[:, -1] if p < chain.threshold]
    assert kept.count() == len(words) and len(words) >= len(awkward[1]) - 1
    assert toxicity.classify(empty, labels).collect() == [] and toxicity.reject(empty, chain).collect() == []
    assert toxicity.classify(df, labels.where("toxic = 0")).where("predicted = 1").count() == 0


# --- 6: BPE

def test_bpe_equals_the_library(spark, awkward, empty):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.loaded(path)
    rng = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyz'.,!? \n\t0123456789ABCÉéßœŒΣςσİıǅʼn̈²½Ⅷ\xa0　\x85\x1c\x00漢かرس😀👍🏽‍﻿§£_-@#ﬁ"
    words = [w.replace("</w>", "") for w in library.get_vocab()]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice(words) for _ in range(3)) for _ in range(3000)] + ["ab" * 5000, "<|endoftext|>a<|startoftext|><|endof"]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.decode_bytes(ids).decode() == library.decode(ids, skip_special_tokens=False)
    df, rows = awkward
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), *(hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), text))))
    assert shown(bpe.token_digests(df, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    tokens = bpe.encode_documents(df, path)
    assert sorted(tokens.columns) == sorted(c for c in df.columns if c != "text")
    assert bpe.decode_documents(tokens, path).where("decoded is null").count() == 0
    assert bpe.token_digests(empty, path).collect() == [] and bpe.encode_documents(empty, path).collect() == []


# --- 7: SimHash

def simhash_by_hand(t):
    w = re.findall(SPACE, lower(t or ""))
    shingles = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(prints, ids, most):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= most:
                parent[find(a)] = find(b)
    groups = {}
    for a in range(len(prints)):
        if ids[a] is not None:
            groups[find(a)] = min(groups.get(find(a), ids[a]), ids[a])
    return [groups.get(find(a)) for a in range(len(prints))]


def test_simhash_near_duplicates(spark, awkward, empty):
    df, rows = awkward
    prints = [simhash_by_hand(r[1]) for r in rows]
    want = [(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, components_by_hand(prints, [r[0] for r in rows], 4), strict=True)]
    assert shown(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted({c for *_, c in want})
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one(empty).collect() == []


@pytest.mark.parametrize("slices", [simhash.MIN_SLICES, 1 << 12])
def test_ball_links_find_every_pair(spark, monkeypatch, slices):
    monkeypatch.setattr(simhash, "MIN_SLICES", slices)
    rng = random.Random(slices)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        x = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        prints.append(x)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fingerprint long, i long")
    got = {r.fingerprint % (1 << 64): r.component_id for r in simhash.with_components(df, "i", 4).collect()}
    assert [got[p] for p in prints] == components_by_hand(prints, list(range(len(prints))), 4)


# --- 8: mixing

def targets_by_hand(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, rest, active = {}, float(sum(sizes.values())), set(names)
    while active:
        level = rest / sum(weight[s] for s in active)
        over = {s for s in active if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in active}
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        active -= over
    return target


def test_mixing_meets_targets(spark, awkward, empty):
    rng = random.Random(12)
    texts = [prose(rng, rng.randint(0, 80)) for _ in range(3000)]
    df = spark.createDataFrame(rows_of(texts, lambda i: None if i % 97 == 0 else f"s{min(i % 40, 9)}"), SCHEMA).repartition(4)
    out = mixing.mix_report(df, block=64).toPandas()
    again = mixing.mix_report(df.repartition(7), block=64).toPandas()
    assert sorted(zip(out.doc_id, out.taken, strict=True)) == sorted(zip(again.doc_id, again.taken, strict=True))
    source = {r.doc_id: r.source for r in df.collect()}
    out["source"] = out.doc_id.map(lambda i: source[i] or "none")
    assert (out["size"] == [len(re.findall(SPACE, texts[i])) for i in out.doc_id]).all() and (out.taken <= 3 * out["size"]).all()
    sizes = out.groupby("source")["size"].sum().to_dict()
    sizes[None] = sizes.pop("none")
    want = targets_by_hand(sizes)
    for s, g in out.groupby("source"):
        s = None if s == "none" else s
        assert g.target.iloc[0] == pytest.approx(want[s]) and (g.source_size == sizes[s]).all()
        assert abs(g.taken.sum() - want[s]) <= 160  # two documents
    df, rows = awkward
    odd = mixing.mix_report(df).toPandas()
    assert len(odd) == len(rows) and (odd.taken <= 3 * odd["size"]).all()
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    words = sum(len(re.findall(SPACE, r.text or "")) for r in mixed.toDF(*[f"x{i}" for i in range(len(mixed.columns))]).withColumnRenamed("x1", "text").collect())
    assert words == odd.taken.sum()
    assert mixing.mix_report(empty).collect() == [] and mixing.mix_documents(empty).collect() == []


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(3)
    size, p = rng.integers(1, 500, 400), rng.random(400)
    x = mixing.flight(size, p, rng)
    assert ((x > 0) & (x < 1)).sum() <= 2
    assert x.sum() == pytest.approx(p.sum()) and (x * size).sum() == pytest.approx((p * size).sum())


# --- 9: licenses

def licenses_by_hand(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        hit = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        at += hit
        labels |= {label} if hit else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_scan(spark, awkward, empty):
    rng = random.Random(7)
    notices = [t for texts in licenses.TEMPLATES.values() for t in texts]
    texts = [prose(rng, 5) + " " + n + "! " + prose(rng, 5) for n in notices]
    texts += [n.upper().replace(" ", "-") + " x " + n for n in notices]
    texts += ["GNU general\npublic LICENSE cc,by cc by cc by", "mit licenses", "ccéby CC by", "MIT License" + " cc by" * 50, "Apache"]
    one = notices[5].split()  # a long notice with a word left out, then one put in
    texts += [" ".join(one[:8] + one[9:]), " ".join([*one[:8], "really", *one[8:]])]
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in columns) == licenses_by_hand(t), t
    names = [label for label, ts in licenses.TEMPLATES.items() for _ in ts]
    for i, label in enumerate(names):
        assert label in got[i].labels.split(",") and got[i].score == 1.0
    assert "gpl-3.0" in got[len(texts) - 1].labels and "gpl-3.0" in got[len(texts) - 2].labels
    assert set(got[len(notices) * 2].labels.split(",")) >= {"gpl", "cc-by"}
    df, rows = awkward
    assert shown(licenses.scan(df), "doc_id", *columns) == sorted(((r[0], *licenses_by_hand(r[1])) for r in rows), key=repr)
    assert licenses.scan(empty).collect() == []


# --- 10: fingerprints

def test_document_fingerprints(spark, awkward, empty, monkeypatch):
    rng = random.Random(10)
    texts = [prose(rng, rng.randint(0, 300)) for _ in range(200)]
    texts[50] = texts[51]
    monkeypatch.setattr(parsing, "BUCKET_CHARS", 9000)
    df = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    got = {r.doc_id: r for r in parsing.edited_fingerprints(df).collect()}
    assert len(got) == 200
    one = lambda t: parsing.hex_of(parsing.sketches([t])[0])
    for i, t in enumerate(texts):
        q = len(t) // 4
        new = t[:len(t) - q] + texts[(i + 1) % 200][:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (one(t), one(new))
    assert got[50].fingerprint == got[51].fingerprint and got[50].near_next == 1.0
    long = [r for r in got.values() if r.n_chars > 600]
    assert np.mean([r.near_edited for r in long]) > 0.45 and np.mean([r.near_next for r in long if r.doc_id != 50]) < 0.1
    df, rows = awkward
    out = parsing.edited_fingerprints(df).collect()
    assert sorted((repr(r.doc_id), r.n_chars) for r in out) == sorted((repr(r[0]), len(r[1] or "")) for r in rows)
    assert parsing.edited_fingerprints(empty).collect() == []
    alone = parsing.edited_fingerprints(spark.createDataFrame([(7, "abcdefgh" * 40)], "doc_id long, text string")).first()
    assert alone.near_next == 1.0


def test_equal_substrings_share_names_at_any_offset():
    rng = random.Random(11)
    middle = prose(rng, 400)
    a, b = prose(rng, 37) + middle + prose(rng, 11), prose(rng, 5) + middle + prose(rng, 60)

    def names(t, levels):
        x, first = np.frombuffer(t.encode("utf-32-le"), np.uint32), np.array([0])
        for _ in range(levels):
            x, first = parsing.phrases(x, first)
        return x
    for level in (1, 2, 3):
        x, y = names(a, level), names(b, level)
        assert len(np.intersect1d(x, y)) >= 0.7 * len(set(names(middle, level).tolist()))
        assert len(x) < len(a) / 2 ** level
