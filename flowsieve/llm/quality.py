"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, overlapping chunks of 16 bytes (every 4 bytes) pass through learned filters, each
filter's largest response over the whole document is kept, and a logistic unit turns these into one
probability. Training runs on the driver over a bounded sample of labelled rows (``max_rows``);
the gradient reaches only the chunk that holds each maximum. Scoring is a map over the documents:
no shuffle, whole texts, a few kilobytes of weights sent with the task; long texts pass through
in pieces of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import named, pick

STEP, WIDTH, DIM = 4, 16, 8
PARTS = WIDTH // STEP
PIECE = 1 << 18  # bytes that pass through the filters at a time


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col="doc_id", text_col="text",
                    where=None) -> list[tuple[str, int]]:
    """At most ``max_rows`` (text, 0/1) of labelled documents, by a hash of the id, and of the id and
    text where ids repeat; rows with a null label, id or text are left out, and repeated rows count once.
    Sent to the driver: ``max_rows`` bounds it."""
    rows = pick(labels, _id=id_col, _y=label).where("_id is not null and _y is not null")
    rows = rows if where is None else rows.where(where(F.col("_id")))
    rows = rows.groupBy("_id").agg(F.max("_y").cast("int").alias("_y"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    found = pick(docs, _i=id_col, _t=text_col).where("_t is not null")
    found = found.join(F.broadcast(rows), F.col("_i") == F.col("_id")).select("_i", "_t", "_y").distinct()
    found = found.orderBy(F.xxhash64("_i", "_t"), "_i", "_t").limit(max_rows).collect()
    return [(r._t, r._y) for r in sorted(found, key=lambda r: (r._i, r._t))]


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first chunk of each text, chunks that would run into the next text)."""
    parts, starts, n = [], [], 0
    for t in texts:
        size = -(-max(len(t), 1) // STEP) * STEP + WIDTH - STEP
        parts.append(t.ljust(size, b"\0"))
        starts.append(n // STEP)
        n += size
    starts = np.array(starts)
    ends = np.append(starts[1:], n // STEP)
    outside = np.concatenate([ends - k for k in range(1, PARTS)])
    return np.frombuffer(b"".join(parts), np.uint8), starts, outside


class ByteCnn:
    """Embedding (256 x DIM), filters (WIDTH * DIM x n), logistic unit."""

    def __init__(self, filters: int = 32, seed: int = 11):
        rng = np.random.default_rng(seed)
        code = np.arange(256)
        kinds = np.stack([(code >= 65) & (code <= 90), (code >= 97) & (code <= 122), (code >= 48) & (code <= 57), code == 32,
                          (code > 32) & (code < 48) | (code > 57) & (code < 65) | (code > 90) & (code < 97) | (code > 122) & (code < 128)], axis=1)
        self.e = (0.3 * rng.standard_normal((256, DIM))).astype(np.float32)
        self.e[:, :kinds.shape[1]] += kinds
        self.w = (rng.standard_normal((WIDTH * DIM, filters)) / np.sqrt(WIDTH * DIM)).astype(np.float32)
        self.b = np.zeros(filters, np.float32)
        self.v = np.zeros(filters, np.float32)
        self.c = np.zeros(1, np.float32)

    def responses(self, data: np.ndarray, outside: np.ndarray) -> np.ndarray:
        """(chunks x filters); chunks overlap, so each group of STEP bytes is multiplied once with
        all its places in a chunk and the products are added with shifts."""
        n = self.w.shape[1]
        groups = self.e[data].reshape(-1, STEP * DIM)
        w = self.w.reshape(PARTS, STEP * DIM, n).transpose(1, 0, 2).reshape(STEP * DIM, PARTS * n)
        y = groups @ w
        z = y[:, :n].copy()
        for k in range(1, PARTS):
            z[:-k] += y[k:, k * n:(k + 1) * n]
        z[outside] = -np.inf
        return z

    def pooled(self, text: bytes) -> np.ndarray:
        """Largest response of each filter over one text, in pieces that overlap by a chunk."""
        best = None
        for i in range(0, max(len(text), 1), PIECE):
            data, _, outside = packed([text[i:i + PIECE + WIDTH - STEP]])
            z = self.responses(data, outside)
            z = (z[:PIECE // STEP] if i + PIECE < len(text) else z).max(axis=0)
            best = z if best is None else np.maximum(best, z)
        return best

    def features(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty((len(texts), self.w.shape[1]), np.float32)
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and size + len(texts[j]) <= PIECE:
                size += len(texts[j]) + WIDTH
                j += 1
            if j == i:
                out[i] = self.pooled(texts[i])
                i += 1
            else:
                data, starts, outside = packed(texts[i:j])
                out[i:j] = np.maximum.reduceat(self.responses(data, outside), starts, axis=0)
                i = j
        return np.maximum(out + self.b, 0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.features(texts) @ self.v + self.c[0]).astype(np.float64)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 10, batch: int = 48, rate: float = 0.01, seed: int = 5):
        rng = np.random.default_rng(seed)
        names = ("e", "w", "b", "v", "c")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        s = {k: np.zeros_like(getattr(self, k)) for k in names}
        prior = min(max(float(labels.mean()), 0.01), 0.99)
        self.c[0] = np.log(prior / (1 - prior))
        self.v[:] = 0.1 * rng.standard_normal(len(self.v))
        t, steps = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                pick = order[i:i + batch]
                g = self._gradients([texts[j] for j in pick], labels[pick])
                t += 1
                lr = rate * 0.5 * (1 + np.cos(np.pi * t / steps))
                for k in names:
                    m[k] += 0.1 * (g[k] - m[k])
                    s[k] += 0.01 * (g[k] ** 2 - s[k])
                    step = lr * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.99 ** t)) + 1e-8)
                    getattr(self, k)[...] -= step
        return self

    def _gradients(self, texts: list[bytes], y: np.ndarray) -> dict:
        data, starts, outside = packed(texts)
        z = self.responses(data, outside)
        ends, n = np.append(starts[1:], len(z)), self.w.shape[1]
        at = np.stack([lo + z[lo:hi].argmax(axis=0) for lo, hi in zip(starts, ends, strict=True)])  # texts x filters
        h = z[at, np.arange(n)] + self.b
        on = h > 0
        h = np.where(on, h, 0)
        p = 1 / (1 + np.exp(-(h @ self.v + self.c[0])))
        d = ((p - y) / len(y)).astype(np.float32)
        dh = (d[:, None] * self.v[None, :]) * on
        byte = data[(at[:, :, None] * STEP + np.arange(WIDTH))]  # texts x filters x WIDTH
        x = self.e[byte].reshape(len(y), n, WIDTH * DIM)
        dw = np.einsum("tf,tfx->xf", dh, x)
        de = np.zeros_like(self.e)
        np.add.at(de, byte.ravel(), (dh[:, :, None] * self.w.T[None]).reshape(-1, DIM))
        decay = 1e-4
        return {"e": de, "w": dw + decay * self.w, "b": dh.sum(axis=0), "v": h.T @ d + decay * self.v, "c": d.sum(keepdims=True)}


def train(sample: list[tuple[str, int]], **options) -> ByteCnn:
    """A network fitted to (text, label); without both labels it scores the share of ones."""
    texts = [t.encode("utf-8", "surrogatepass") for t, _ in sample]
    y = np.array([v for _, v in sample], np.float32)
    net = ByteCnn()
    if len(set(y.tolist())) == 2:
        return net.fit(texts, y, **options)
    net.c[0] = 0.0 if not len(y) else 5.0 if y[0] else -5.0
    return net


def fold_of(doc_id):
    """crc32 of the id as text, mod 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def score(docs: DataFrame, net: ByteCnn, id_col="doc_id", text_col="text", threshold: float = 0.3) -> DataFrame:
    """Per row: id, held_out, score (probability of label 1), predicted. Null texts score like empty
    ones; repeated rows and null ids (held out) are returned as they come; no rows give no rows;
    other columns play no part."""
    d = pick(docs, **{id_col: id_col, "_text": text_col})
    d = d.select(named(id_col), (fold_of(named(id_col)) == 0).alias("held_out"), F.coalesce("_text", F.lit("")).cast("binary").alias("_bytes"))

    def run(batches):
        for b in batches:
            column, out = b.column("_bytes"), []
            for i in range(0, len(column), 128):
                out.append(net.scores(column.slice(i, 128).to_pylist()))
            s = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             [id_col, "held_out", "score", "predicted"])

    schema = d.select(named(id_col), "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return d.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label="quality", max_rows: int = 4000, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """Train on at most ``max_rows`` labelled rows whose crc32(id as text) mod 5 is not 0, score all."""
    sample = labelled_sample(docs, labels, label, max_rows, id_col, text_col, lambda i: fold_of(i) != 0)
    return score(docs, train(sample, **options), id_col, text_col)
