"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased letters with one space between words; n-grams of 1 to 4 characters are hashed into
2^18 features, weighted by (1 + ln tf) * idf and scaled to length one. The regression is trained with
follow-the-regularised-leader (one step size a weight; the l1 part of the elastic net keeps weights at zero
until the gradients outweigh it), and the temperature that calibrates its probabilities is fitted to
sample rows that it has not seen.

Scale: document frequencies come from all training rows, one count a feature and task. The fit sees a bounded
sample (``max_rows`` different texts, dealt evenly to the languages, copies once), which reaches the driver as
feature counts, at most 2^18 a text, not as text. Scoring is a map: no shuffle, a few megabytes of weights, whole
texts in pieces of bounded size.

Rows without text or without a letter are ``und`` with score 0, as is every row if there is nothing to learn from;
rows with a null language are not learned from; ties go to the smaller language; a null id counts as an empty
one for the fold; repeated rows are returned as they come; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import named, pick

ORDERS = (1, 2, 3, 4)
BITS = 18
PIECE = 1 << 18  # characters that are hashed at a time
SPACE, EDGE = 32, 0
MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B))
TEXTS = 1 << (31 - BITS)  # whose keys (text, feature) fit 31 bits


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


_table: list[np.ndarray] = []


def lower_table() -> np.ndarray:
    """For the characters of the basic plane: the lower-case letter, or a space for what is no letter."""
    if not _table:
        one = [chr(c) for c in range(1 << 16)]
        _table.append(np.array([(ord(low) if len(low := x.lower()) == 1 else ord(x)) if x.isalpha() else SPACE for x in one], np.uint32))
    return _table[0]


def letters(text: str) -> np.ndarray:
    """Code points of a text, lower-cased, all that is no letter as a space."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 1 << 16, lower_table()[c & 0xFFFF], c)


def squeezed(c: np.ndarray) -> np.ndarray:
    return c[np.append(True, (c[1:] != SPACE) | (c[:-1] != SPACE))] if len(c) else c


def features(c: np.ndarray, skip: int = 0, text: np.ndarray | None = None):
    """Features of the n-grams of each order that hold no edge and end at or after ``skip``; with the text
    number of every character, keys (text, feature)."""
    h, ok = np.zeros(len(c), np.uint32), c != EDGE
    inside = ok
    for n in ORDERS:
        if n > len(c):
            return
        size = len(c) - n + 1
        h = (h[:size] + c[n - 1:] + np.uint32(n)) * MIX[0]
        h ^= h >> np.uint32(15)
        ok = ok[:size] & inside[n - 1:]
        f = ((h * MIX[1]) >> np.uint32(32 - BITS)).view(np.int32)
        f = f if text is None else f | text[:size]
        yield f[ok] if not skip else f[max(0, skip - n + 1):][ok[max(0, skip - n + 1):]]


def counted_long(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of one text, read in pieces; n-grams that cross two pieces are counted once."""
    total, carry = np.zeros(1 << BITS, np.int64), np.zeros(0, np.uint32)
    for i in range(0, len(text), PIECE):
        c = squeezed(np.concatenate([carry, letters(text[i:i + PIECE])]))
        for f in features(c, len(carry)):
            total += np.bincount(f, minlength=1 << BITS)
        carry = c[max(0, len(c) - max(ORDERS) + 1):]
    found = np.flatnonzero(total)
    return found, total[found]


def counted(texts: list[str]):
    """(text number, feature, count) of a list of texts, ordered by text and feature, in groups of
    texts of bounded size."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and j - i < TEXTS and size + len(texts[j]) <= PIECE:
            size += len(texts[j]) + 1
            j += 1
        if j == i:
            f, n = counted_long(texts[i])
            yield np.full(len(f), i), f, n
            i += 1
            continue
        c = letters("\0".join(texts[i:j]))
        c[np.cumsum([len(t) + 1 for t in texts[i:j]])[:-1] - 1] = EDGE
        c = squeezed(c)
        text = np.cumsum(c == EDGE, dtype=np.int32) << BITS
        keys = np.concatenate([np.zeros(0, np.int32), *features(c, text=text)])
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        found = keys[first]
        yield (found >> BITS) + i, found & ((1 << BITS) - 1), np.diff(np.append(first, len(keys)))
        i = j


def weighted(which: np.ndarray, f: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(1 + ln tf) * idf, scaled to length one within each text; ``which`` is ascending."""
    x = (1 + np.log(n)) * idf[f]
    first = np.flatnonzero(np.diff(which, prepend=-1))
    size = np.sqrt(np.add.reduceat(x * x, first)) if len(first) else np.zeros(0)
    return x / np.repeat(size, np.diff(np.append(first, len(which))))


class Ftrl:
    """Multinomial logistic regression; per weight an accumulated gradient z and a sum of squares n, from which
    the leader's weight follows in closed form: zero while |z| <= l1."""

    def __init__(self, size: int, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, rows: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(rows)
        g = x[:, None] * (softmax(x @ w) - (np.arange(w.shape[1]) == y))
        more = self.n[rows] + g * g
        self.z[rows] += g - (np.sqrt(more) - np.sqrt(self.n[rows])) / self.alpha * w
        self.n[rows] = more


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fitted_temperature(scores: np.ndarray, y: np.ndarray, low: float = 0.01, high: float = 100.0) -> float:
    """The divisor of the scores that makes the labels likeliest, by golden section over its logarithm. Each
    language counts as if it had been seen once more a row of the whole sample, so that a sample without errors
    does not call for probabilities of one."""
    if not len(y):
        return 1.0
    classes = scores.shape[1]
    target = (np.eye(classes)[y] * len(y) + 1) / (len(y) + classes)

    def loss(t: float) -> float:
        return float(-(target * np.log(softmax(scores / np.exp(t)) + 1e-300)).sum(axis=1).mean())

    a, b, g = np.log(low), np.log(high), (np.sqrt(5) - 1) / 2
    while b - a > 1e-3:
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    """Languages, idf, the weights that are not zero (row 0 stands for all others) and the temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        used = np.flatnonzero(weights.any(axis=1))
        self.row = np.zeros(len(weights), np.int32)
        self.row[used] = np.arange(1, len(used) + 1)
        self.weights = np.concatenate([np.zeros((1, len(langs))), weights[used]]).astype(np.float32)
        self.langs, self.idf, self.bias, self.temperature = langs, idf, bias, temperature

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.tile(self.bias, (len(texts), 1))
        for which, f, n in counted(texts):
            if len(which):
                x = weighted(which, f, n, self.idf)
                first = np.flatnonzero(np.diff(which, prepend=-1))
                out[which[first]] += np.add.reduceat(x[:, None] * self.weights[self.row[f]], first, axis=0)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        p = softmax(self.scores(texts) / self.temperature)
        return [self.langs[i] for i in p.argmax(axis=1).tolist()], p.max(axis=1)


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(texts, texts that hold each feature) over all rows of ``text``."""
    def run(batches):
        df, texts = np.zeros((1 << BITS) + 1, np.int64), 0
        for b in batches:
            column = b.column("text")
            for i in range(0, len(column), 256):
                for _, f, _ in counted(column.slice(i, 256).to_pylist()):
                    df[:-1] += np.bincount(f, minlength=1 << BITS)
            texts += len(column)
        df[-1] = texts
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["feature", "n"])

    found = rows.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros((1 << BITS) + 1, np.int64)
    df[found["feature"].to_numpy()] = found["n"].to_numpy()
    return int(df[-1]), df[:-1]


def sample(rows: DataFrame, max_rows: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, features, counts) of at most ``max_rows`` different texts, the same number of each language
    as far as there are so many, by a hash of the text."""
    keys = rows.select("lang", F.xxhash64("text").alias("h")).distinct()
    langs = keys.agg(F.countDistinct("lang").alias("n")).first().n
    if not langs:
        return []
    # the rank inside a language follows another hash, so that it says nothing about the text's own one; it is
    # taken in parts first, as one language may hold most rows
    first = keys.withColumn("part", F.pmod("h", F.lit(256)))
    for by in (["lang", "part"], ["lang"]):
        first = first.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("h", F.lit(1)), "h"))).where(F.col("at") <= max(1, max_rows // langs))
    first = first.orderBy("at", "lang").limit(max_rows).select("lang", "h")
    texts = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(first), ["lang", "h"]).dropDuplicates(["lang", "h"])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                found = list(counted(b.column("text").slice(i, 1).to_pylist()))
                f, n = (np.concatenate([x[k] for x in found] or [np.zeros(0)]).astype(np.int32) for k in (1, 2))
                yield pa.RecordBatch.from_pylist([{"lang": b.column("lang")[i].as_py(), "h": b.column("h")[i].as_py(), "f": f.tobytes(), "n": n.tobytes()}])

    found = texts.select("lang", "h", "text").mapInArrow(run, "lang string, h long, f binary, n binary").collect()
    return [(r.lang, np.frombuffer(r.f, np.int32), np.frombuffer(r.n, np.int32)) for r in sorted(found, key=lambda r: (r.h, r.lang))]


def train(docs: DataFrame, max_rows: int = 4000, epochs: int = 3, id_col="doc_id", text_col="text", lang_col="lang", seed: int = 7, **options) -> Model | None:
    """A model fitted to rows whose crc32(id as text) mod 4 is not 2; None if there are none. A fifth of the
    sample is kept for the temperature."""
    rows = pick(docs, id=id_col, text=text_col, lang=lang_col).where((fold_of(F.col("id")) != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    drawn = sample(rows, max_rows)
    if not drawn:
        return None
    texts, df = document_frequencies(rows)
    idf = np.log((1 + texts) / (1 + df)) + 1
    langs = sorted({lang for lang, *_ in drawn})
    y = np.array([langs.index(lang) for lang, *_ in drawn])
    # features of the sample have weights, numbered without gaps; the last one is the constant
    seen = np.unique(np.concatenate([f for _, f, _ in drawn]))
    x = [np.append(weighted(np.zeros(len(f), int), f, n, idf), 1.0).astype(np.float32) for _, f, n in drawn]
    at = [np.append(np.searchsorted(seen, f), len(seen)).astype(np.int32) for _, f, _ in drawn]
    model, rng = Ftrl(len(seen) + 1, len(langs), **options), np.random.default_rng(seed)
    kept = np.arange(len(drawn)) % 5 == 4
    fit = np.flatnonzero(~kept)
    for _ in range(epochs):
        for i in rng.permutation(fit):
            model.learn(at[i], x[i], y[i])
    w = model.weights()
    held = np.flatnonzero(kept)
    scores = np.array([x[i] @ w[at[i]] for i in held]).reshape(len(held), len(langs))
    all_w = np.zeros((1 << BITS, len(langs)))
    all_w[seen] = w[:-1]
    return Model(langs, idf, all_w, w[-1], fitted_temperature(scores, y[held]))


def predict(docs: DataFrame, model: Model | None, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: id, held_out, lang_pred, score (the calibrated probability of lang_pred; 0 for ``und``)."""
    d = pick(docs, **{id_col: id_col, "_text": text_col})
    some = F.coalesce(F.col("_text").rlike(r"\p{L}"), F.lit(False)) & F.lit(model is not None)
    d = d.select(named(id_col), (fold_of(named(id_col)) == 2).alias("held_out"), F.when(some, F.col("_text")).alias("_text"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column("_text").to_pylist()
                has = [i for i, t in enumerate(texts) if t is not None]
                langs, scores = ["und"] * len(texts), np.zeros(len(texts))
                if has:
                    found, p = model.predict([texts[i] for i in has])
                    scores[has] = p
                    for i, lang in zip(has, found, strict=True):
                        langs[i] = lang
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)],
                                                 [id_col, "held_out", "lang_pred", "score"])

    schema = d.select(named(id_col), "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return d.mapInArrow(run, schema)


def identify(docs: DataFrame, max_rows: int = 4000, id_col="doc_id", text_col="text", lang_col="lang", **options) -> DataFrame:
    """Train on at most ``max_rows`` texts outside the held-out fold, predict for all rows."""
    return predict(docs, train(docs, max_rows, id_col=id_col, text_col=text_col, lang_col=lang_col, **options), id_col, text_col)
