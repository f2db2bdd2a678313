"""Toxicity by classifier chains of linear models.

Categories are predicted one after another: each logistic model sees the document's words (and
their stems) and the probabilities of the categories before it. For training, these are out-of-fold predictions, so that
a later model meets the same uncertainty as it will when scoring. The labels only say toxic or
not; a category's weak label is "toxic and holds one of the category's seed words", and the last
model of the chain predicts the label itself from all words and all category probabilities.

Training uses a bounded sample of labelled rows (``max_rows``) and of words (``max_words``, the
most telling ones by their log-odds over the sample) on the driver. Scoring is a map: no
shuffle, whole texts, weights of a few kilobytes.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import Sealed, named, pick
from flowsieve.llm.quality import labelled_sample

WORD = re.compile(r"[^\W\d_]+")
# Seed words of the categories, in the order of the chain.
SEEDS = {
    "insult": "idiot stupid moron fool loser clown dumb imbecile".split(),
    "contempt": "worthless pathetic disgusting useless garbage trash scum vermin".split(),
    "threat": "kill hurt die destroy beat burn shoot".split(),
}
LABEL = "toxic"


def word_set(text: str | None) -> set[str]:
    """Lower-cased words, and their first four and five letters (with a trailing dash): inflected and
    compounded words share them."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:4] + "-" for w in words} | {w[:5] + "-" for w in words}


def telling_words(texts: list[str], y: np.ndarray, most: int, least: int = 3) -> list[str]:
    """Words of at least ``least`` toxic texts whose smoothed log-odds between the classes stand out
    most from their own noise. Only these words are ever counted outside the toxic texts."""
    inside, outside = Counter(), Counter()
    for t, v in zip(texts, y, strict=True):
        if v:
            inside.update(word_set(t))
    inside = Counter({w: n for w, n in inside.items() if n >= least})
    for t, v in zip(texts, y, strict=True):
        if not v:
            outside.update(word_set(t) & inside.keys())
    n1, n0 = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)

    def z(w):
        a, b = inside[w] + 0.5, outside[w] + 0.5 * n0 / n1
        return abs(np.log(a / n1) - np.log(b / n0)) / np.sqrt(1 / a + 1 / b)
    return sorted(inside, key=lambda w: (-z(w), w))[:most]


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 0.03, rounds: int = 15) -> np.ndarray:
    """Newton's method with an L2 penalty (none on the intercept, the last weight)."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], decay)
    ridge[-1] = 1e-6
    prior = min(max(float(y.mean()) if len(y) else 0.0, 1e-4), 1 - 1e-4)
    w[-1] = np.log(prior / (1 - prior))
    if len(set(y.tolist())) < 2:
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step * min(1.0, 2.0 / np.abs(step).max())  # damped: separable words would overshoot
        if np.abs(step).max() < 1e-3:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut (0.02 to 0.5) with the best F1 on out-of-fold probabilities; of equal ones the middle."""
    cuts = np.exp(np.linspace(np.log(0.02), np.log(0.5), 60))
    hit = np.array([((p >= c) & (y == 1)).sum() for c in cuts])
    f1 = 2 * hit / np.maximum(np.array([(p >= c).sum() for c in cuts]) + y.sum(), 1)
    return float(np.median(cuts[f1 >= f1.max() - 1e-12])) if y.sum() else 0.5


class Chain:
    """Words, categories in order, one weight vector each, and the cut of the last probability."""

    def __init__(self, words: list[str], categories: list[str], weights: list[np.ndarray], threshold: float = 0.5):
        self.words, self.categories, self.weights = {w: i for i, w in enumerate(words)}, categories, weights
        self.threshold = threshold

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.words)))
        for i, t in enumerate(texts):
            for w in word_set(t) & self.words.keys():
                x[i, self.words[w]] = 1.0
        return x

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """(texts x categories); each is an input of the ones after it."""
        x = self.matrix(texts)
        out = np.zeros((len(texts), 0))
        for w in self.weights:
            out = np.column_stack([out, predict(np.column_stack([x, out]), w)])
        return out


def train(sample: list[tuple[str, int]], max_words: int = 256, folds: int = 3) -> Chain:
    """Chain fitted to (text, toxic). Without both labels every probability is the share of ones."""
    texts, y = [t for t, _ in sample], np.array([v for _, v in sample], float)
    chain = Chain(telling_words(texts, y, max_words), [*SEEDS, LABEL], [])
    x = chain.matrix(texts)
    seeded = {c: {i for i, t in enumerate(texts) if y[i] and not word_set(t).isdisjoint(seeds)} for c, seeds in SEEDS.items()}
    fold = np.arange(len(y)) % folds  # the sample is ordered by id: equal texts may share a fold or not
    before = np.zeros((len(y), 0))  # out-of-fold probabilities of the categories so far
    for c in chain.categories:
        target = y if c == LABEL else np.array([float(i in seeded[c]) for i in range(len(y))])
        inputs = np.column_stack([x, before])
        chain.weights.append(fit_logistic(inputs, target))
        held = np.zeros(len(y))
        for k in range(folds):
            out = fold == k
            held[out] = predict(inputs[out], fit_logistic(inputs[~out], target[~out]))
        before = np.column_stack([before, held])
    chain.threshold = best_threshold(before[:, -1], y)
    return chain


def score(docs: DataFrame, chain: Chain, text_col="text") -> DataFrame:
    """``docs`` without the text and with p_<category> of each category, score (the chain's last
    probability) and predicted (1: toxic). Null and empty texts hold no words; repeated rows are
    returned as they come; no rows give no rows."""
    kept = [c for c in docs.columns if c != text_col]
    new = [*(f"p_{c}" for c in chain.categories[:-1]), "score"]

    def run(batches):
        for b in batches:
            column, out = b.column(text_col), [np.zeros((0, len(new)))]
            for i in range(0, len(column), 256):
                out.append(chain.probabilities(column.slice(i, 256).to_pylist()))
            p = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(p[:, j]) for j in range(len(new))),
                                              pa.array((p[:, -1] >= chain.threshold).astype(np.int32))], [*kept, *new, "predicted"])

    schema = docs.select(*[named(c) for c in kept], *[F.lit(0.0).alias(n) for n in new], F.lit(0).alias("predicted")).schema
    return docs.mapInArrow(run, schema)


def trained(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, id_col="doc_id", text_col="text") -> Chain:
    return train(labelled_sample(docs, labels, LABEL, max_rows, id_col, text_col))


def classify(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """Per row: id, p_insult, p_contempt, p_threat, score, predicted."""
    return score(pick(docs, **{id_col: id_col, "text": text_col}), trained(docs, labels, id_col=id_col, text_col=text_col, **options), "text")


def reject(docs: DataFrame, chain: Chain, text_col="text") -> DataFrame:
    """``docs`` without those that score the chain's threshold or more: rows pass through the map whole."""
    sealed = Sealed(docs)
    text = sealed.column(text_col)

    def run(batches):
        for b in batches:
            column, keep = b.column(text), []
            for i in range(0, len(column), 256):
                keep += (chain.probabilities(column.slice(i, 256).to_pylist())[:, -1] < chain.threshold).tolist()
            yield b.filter(pa.array(keep, pa.bool_()))

    return sealed.open(sealed.df.mapInArrow(run, sealed.df.schema))
