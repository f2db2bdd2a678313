"""Document fingerprints by locally consistent parsing.

Each level groups a sequence of names into phrases by what stands around each place, never by
offset: runs of one name collapse, deterministic coin tossing (index and value of the lowest bit
that differs from the left neighbour, four times over) turns the names into at most eight labels with
unequal neighbours, and local maxima of the labels start phrases of two or more names. A phrase's
name is a hash of its names, so equal substrings get equal names but for a few at their rims, whatever
their offsets. The fingerprint keeps the smallest hash in each of 64 slots over the names of the
upper levels; likeness is the share of equal slots.

Many documents are parsed as one array; no phrase crosses a document. ``edited_fingerprints`` needs
each document's successor by id: texts are shuffled once, into ranges of ids that are read in
order as a stream; the first document of a range also visits the range before it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import named, pick

SLOTS = 64
LEVELS = 4
FROM_LEVEL = 3  # phrases of about 27 characters and more
EMPTY = 0xFFFF
BATCH_CHARS = 1 << 19
BUCKET_CHARS = 2_000_000
BUCKETS_A_TASK = 4  # several small ranges a task even out what the hash of their number deals
MAX_BUCKETS = 20_000
MIX = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing against the left neighbour; the first name of a document is tossed
    against itself with the lowest bit turned."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = x[first] ^ x.dtype.type(1)
    differ = x ^ left
    bit = np.bitwise_count((differ & (~differ + x.dtype.type(1))) - x.dtype.type(1))
    return (bit << np.uint8(1)) | ((x >> bit.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)


def phrases(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level: (names, positions of the documents' first names)."""
    start = np.empty(len(x), bool)
    start[0] = True
    np.not_equal(x[1:], x[:-1], out=start[1:])
    start[first] = True
    runs = np.flatnonzero(start)
    length = np.diff(runs, append=len(x))
    first = np.searchsorted(runs, first)
    labels = toss(x[runs], first)
    for _ in range(3):
        labels = toss(labels, first)
    names = mixed(x[runs].astype(np.uint64) + MIX) + length.astype(np.uint64) * MIX
    peak = np.ones(len(runs), bool)
    peak[1:] = labels[1:] > labels[:-1]
    last = np.append(first[1:], len(runs)) - 1
    falls = np.ones(len(runs), bool)
    falls[:-1] = labels[:-1] > labels[1:]
    falls[last] = False  # a document's last name joins the phrase before it
    peak &= falls
    peak[first] = True
    at = np.flatnonzero(peak)
    place = np.arange(len(runs)) - np.repeat(at, np.diff(at, append=len(runs)))
    named_ = np.add.reduceat(mixed(names) * POWERS[np.minimum(place, len(POWERS) - 1)], at)
    return mixed(named_), np.searchsorted(at, first)


def sketches(texts: list[str]) -> np.ndarray:
    """(texts x SLOTS) uint16 fingerprints; an empty text has empty slots only."""
    out = np.full((len(texts), SLOTS), EMPTY, np.uint16)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    x = np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate(([0], np.cumsum([len(texts[i]) for i in full])[:-1])).astype(np.int64)
    best = np.full(len(full) * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for level in range(1, LEVELS + 1):
        x, first = phrases(x, first)
        if level >= FROM_LEVEL:
            h = mixed(x ^ np.uint64(level))
            doc = np.repeat(np.arange(len(first)), np.diff(first, append=len(x)))
            np.minimum.at(best, doc * SLOTS + (h >> np.uint64(58)).astype(np.int64), h << np.uint64(6))
    none = best == np.iinfo(np.uint64).max
    short = (mixed(best) & np.uint64(0xFFFF)).astype(np.uint16)
    short[short == EMPTY] = EMPTY - 1
    short[none] = EMPTY
    out[full] = short.reshape(len(full), SLOTS)
    return out


def hex_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots among those that either fills; 1 if neither fills any."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    return np.where(used > 0, same / np.maximum(used, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the next text."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q]


def in_id_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, guest, id, digest, text): buckets are ranges of (id, digest), null ids last; within
    a bucket, guests are the first rows of the next bucket (of the first one, after the last)."""
    d = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("digest", F.xxhash64("text"))
    count = d.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = int(min(MAX_BUCKETS, max(1, count // BUCKET_CHARS)))
    share = [i / n for i in range(1, n)]
    cuts = (d.agg(F.percentile_approx("id", share, 10 * n)).first()[0] or []) if share else []
    hot = {v for v, w in zip(cuts, cuts[1:], strict=False) if v == w}  # one id fills several shares
    splits = [float("-inf"), *sorted({float(c) for c in cuts} | {float(v + 1) for v in hot}), float("inf")]
    if len(splits) > 2:
        range_of = Bucketizer(splits=splits, inputCol="_at", outputCol="_range", handleInvalid="keep")
        d = range_of.transform(d.withColumn("_at", F.col("id").cast("double"))).withColumn("_range", F.coalesce("_range", F.lit(len(splits))).cast("long"))
    else:
        d = d.withColumn("_range", F.when(F.col("id").isNull(), 1).otherwise(0).cast("long"))
    # rows of one id, or of none, are dealt on by digest
    fine = F.col("id").isNull() | F.col("id").isin(list(hot)) if hot else F.col("id").isNull()
    part = F.when(fine, F.shiftrightunsigned(F.col("digest").bitwiseXOR(F.lit(-(1 << 63))), 58)).otherwise(F.lit(0).cast("long"))
    d = d.withColumn("bucket", F.col("_range") * 64 + part).select("bucket", F.lit(0).alias("guest"), "id", "digest", "text")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    firsts = sorted((r.bucket, r.first) for r in d.groupBy("bucket").agg(F.min(order).alias("first")).collect())  # a row per bucket
    if not firsts:
        return d
    visits = [(firsts[i - 1][0], b, f.id, f.digest) for i, (b, f) in enumerate(firsts)]
    visits = d.sparkSession.createDataFrame(visits, "to long, bucket long, id long, digest long")
    guests = (d.alias("d").join(F.broadcast(visits).alias("v"), (F.col("d.bucket") == F.col("v.bucket")) & F.col("d.id").eqNullSafe(F.col("v.id"))
                                & (F.col("d.digest") == F.col("v.digest")))
              .select(F.col("v.to").alias("bucket"), F.lit(1).alias("guest"), "d.id", "d.digest", "d.text"))
    return d.unionByName(guests).repartition(max(2, -(-len(firsts) // BUCKETS_A_TASK)), "bucket").sortWithinPartitions("bucket", "guest", F.col("id").asc_nulls_last(), "digest")


FIELDS = [("n_chars", "long", pa.int64()), ("edited_sha256", "string", pa.string()), ("fingerprint", "string", pa.string()),
          ("edited_fingerprint", "string", pa.string()), ("near_edited", "double", pa.float64()), ("near_next", "double", pa.float64())]


def _batch(id_col: str, held: list[tuple]) -> pa.RecordBatch:
    """All but the last of ``held`` (id, text) are answered; the last is the one that follows."""
    texts = [t for _, t in held]
    new = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    s = sketches(texts + new)
    own, after = s[:len(texts)], s[len(texts):]
    columns = [[i for i, _ in held[:-1]], [len(t) for t in texts[:-1]],
               [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new],
               [hex_of(x) for x in own[:-1]], [hex_of(x) for x in after], likeness(own[:-1], after), likeness(own[:-1], own[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *(t for _, _, t in FIELDS)], strict=True)],
                                      [id_col, *(n for n, _, _ in FIELDS)])


def edited_fingerprints(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    Null and empty texts have no code points and a fingerprint without names (alike to each other,
    unlike all others). Rows follow each other by id, then by a hash of the text; null ids come
    last; the first follows the last, also if it is the only row. No rows give no rows; other
    columns play no part. Ids must fit 64-bit integers."""
    def run(batches):
        held, chars, bucket, passed = [], 0, None, False
        for b in batches:
            for r in (x for i in range(0, b.num_rows, 256) for x in b.slice(i, 256).to_pylist()):
                if r["bucket"] != bucket:
                    held, chars, bucket, passed = [], 0, r["bucket"], False
                if passed:  # equal rows visit more than once
                    continue
                held.append((r["id"], r["text"]))
                chars += len(r["text"])
                passed = r["guest"] == 1
                if len(held) > 1 and (passed or chars >= BATCH_CHARS):
                    yield _batch(id_col, held)
                    held, chars = held[-1:], len(held[-1][1])

    schema = ", ".join([f"`{id_col}` long", *(f"{n} {t}" for n, t, _ in FIELDS)])
    return in_id_order(docs, id_col, text_col).drop("digest").mapInArrow(run, schema)


def fingerprints(docs: DataFrame, text_col="text") -> DataFrame:
    """``docs`` without the text, with its ``fingerprint``: no order and no shuffle."""
    kept = [c for c in docs.columns if c != text_col]

    def run(batches):
        for b in batches:
            texts, out, part, chars = b.column(text_col), [], [], 0
            for i in range(0, len(texts), 256):
                for t in texts.slice(i, 256).to_pylist():
                    part.append(t or "")
                    chars += len(part[-1])
                    if chars >= BATCH_CHARS:
                        out += map(hex_of, sketches(part))
                        part, chars = [], 0
            out += map(hex_of, sketches(part))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(out, pa.string())], [*kept, "fingerprint"])

    return docs.mapInArrow(run, docs.select(*[named(c) for c in kept], F.lit("").alias("fingerprint")).schema)
