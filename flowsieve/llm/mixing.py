"""Mixing sources to target weights by the cube method (balanced sampling).

Every source has a target in words. A document of a source with target / size ratio ``r``
is taken ``floor(r)`` times for sure and once more with inclusion probability
``r - floor(r)``. The cube method turns these probabilities into 0 or 1: its flight
phase moves three fractional documents at a time along the null space of the two
constraints (words, documents), so both totals of the source stay what they were, until at
most two documents of a block are fractional. The fractional documents of many blocks meet
in the next level's blocks, and the last two of a source are rounded in the landing phase.

Scale: blocks hold about ``block`` units whatever the size of the source, so a hot source
is only more blocks; each level keeps at most two units of each block. Equal rows
(same id, text and source) are one unit with a multiplicity, counted before the shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import WORD, Sealed, pick, position, stored

EPS = 1e-9
FAN_IN = 1024  # blocks of one level whose leftovers meet in a block of the next
UNIT = ("id string, source string, digest long, size long, m long, source_size long, target double, "
        "sure long, pi double, block long, taken long")


def source_targets(sizes: DataFrame, weights=(1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, n, target) from rows (source, size, n): the total of all sizes
    dealt out by weight (``weights`` repeat over the sources by code point, null last); a
    target stops at ``cap`` times the source's size and the excess goes to the others by
    weight. With ``c = cap * size``, the targets are ``min(c, level * w)`` for the one
    ``level`` at which they add up; the sources stop in ascending order of ``c / w``.
    The windows run over one row per source, not over documents."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("c", F.col("source_size") * F.lit(float(cap)))
    by_stop = Window.orderBy(F.col("c") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("stopped", F.coalesce(F.sum("c").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("w_left", F.sum("w").over(by_stop.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("total", F.sum("source_size").over(every))
         .withColumn("level", (F.col("total") - F.col("stopped")) / F.col("w_left"))
         .withColumn("stop_at", F.col("c") / F.col("w")))
    fits = F.when(F.col("level") <= F.col("stop_at"), F.struct("stop_at", "level"))
    return (s.withColumn("level", F.coalesce(F.min(fits).over(every)["level"], F.max("stop_at").over(every)))
            .select("source", "source_size", "n", F.least(F.col("c"), F.col("level") * F.col("w")).alias("target")))


def _step(x, s, up: bool, u):
    """Longest step along ``u`` (or against it) that keeps every x in [0, 1]."""
    best = np.inf
    for v, d in zip(x, u, strict=True):
        d = d if up else -d
        if d > 0:
            best = min(best, (1 - v) / d)
        elif d < 0:
            best = min(best, -v / d)
    return best


def flight(size, pi, rng) -> np.ndarray:
    """Flight phase over one block: at most two entries of the result are fractional."""
    pi = [float(v) for v in pi]
    pool: list[int] = []
    for i, v in enumerate(pi):
        if v <= EPS or v >= 1 - EPS:
            pi[i] = float(round(v))
            continue
        pool.append(i)
        while len(pool) == 3:
            a, b, c = (float(size[j]) for j in pool)
            u = (b - c, c - a, a - b)  # orthogonal to the sizes and to (1, 1, 1)
            scale = max(map(abs, u))
            u = tuple(v / scale for v in u) if scale else (1.0, -1.0, 0.0)
            x = [pi[j] for j in pool]
            up, down = _step(x, size, True, u), _step(x, size, False, u)
            t = up if rng.random() * (up + down) < down else -down
            for j, v, d in zip(pool, x, u, strict=True):
                v += t * d
                pi[j] = 0.0 if v <= EPS else 1.0 if v >= 1 - EPS else v
            pool = [j for j in pool if 0.0 < pi[j] < 1.0]
    return np.array(pi)


def landing(size, pi) -> np.ndarray:
    """Rounds the last (at most two) fractional entries so that the total of words, then the
    number of documents, moves least."""
    pi = pi.copy()
    open_ = [i for i, v in enumerate(pi) if 0 < v < 1]
    want = [sum(pi[i] * size[i] for i in open_), sum(pi[i] for i in open_)]
    best = min((abs(sum(size[i] for k, i in enumerate(open_) if bits >> k & 1) - want[0]),
                abs(bin(bits).count("1") - want[1]), bits) for bits in range(1 << len(open_)))[2]
    for k, i in enumerate(open_):
        pi[i] = float(best >> k & 1)
    return pi


def _flight_of(level: int, last: bool, seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["digest", "id", "size"], na_position="last", kind="stable").reset_index(drop=True)
        rng = np.random.default_rng(zlib.crc32(repr((key[0] if isinstance(key[0], str) else None, int(key[1]), level, seed)).encode()))
        size = pdf["size"].to_numpy()
        pi = flight(size, pdf["pi"].to_numpy(), rng)
        pdf["pi"] = landing(size, pi) if last else pi
        pdf["block"] = pdf["block"] // FAN_IN
        return pdf
    return run


def mix_units(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(1, 2, 3), cap: float = 3.0,
              seed: int = 7, block: int = 2048) -> DataFrame:
    """One row per distinct (id, text, source): id (as text), source, digest (of the text),
    size, m (equal rows), source_size, target, copies (times that the mix takes the m rows in
    all). Null text counts 0 words; a source without words gets nothing; null is a source of
    its own; no rows give no rows. Other columns, whatever their names, play no part."""
    base = pick(docs, id=id_col, source=source_col, text=text_col).select(
        F.col("id").cast("string"), F.col("source").cast("string"), F.xxhash64("text").alias("digest"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    units = stored(base.groupBy("id", "source", "digest", "size").agg(F.count(F.lit(1)).alias("m")), "mix-units")
    sources = source_targets(units.select("source", (F.col("size") * F.col("m")).alias("size"), F.lit(1).alias("n")), weights, cap)
    sources = stored(sources, "mix-sources")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    times = F.col("m") * F.least(ratio, F.lit(float(cap)))
    u = (units.join(sources, units["source"].eqNullSafe(sources["source"])).drop(sources["source"])
         .withColumn("times", times)
         .withColumn("sure", F.floor(F.col("times") + F.lit(EPS)).cast("long"))
         .withColumn("pi", F.greatest(F.lit(0.0), F.col("times") - F.col("sure")))
         .withColumn("block", F.pmod(F.xxhash64("id", "digest", F.lit(seed)), F.ceil(F.col("n") / F.lit(block)).cast("long")))
         .withColumn("taken", F.lit(0).cast("long"))
         .select(*[p.split()[0] for p in UNIT.split(", ")]))
    blocks = sources.agg(F.max(F.ceil(F.col("n") / F.lit(block)))).first()[0] or 1
    done, level = [], 0
    while True:
        last = blocks <= 1
        u = stored(u.groupBy("source", "block").applyInPandas(_flight_of(level, last, seed), UNIT), f"mix-level{level}")
        whole = (F.col("pi") == 0.0) | (F.col("pi") == 1.0)
        done.append(u if last else u.where(whole))
        if last:
            break
        u, level, blocks = u.where(~whole), level + 1, -(-blocks // FAN_IN)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("id", "source", "digest", "size", "m", "source_size", "target",
                      (F.col("sure") + F.col("pi").cast("long")).alias("copies"))


COPIES = 1024  # of a row that one task writes in a go


def repeated(rows: DataFrame, count: str, out: str) -> DataFrame:
    """Each row ``count`` (at most COPIES) times, ``out`` numbering them from 1."""
    return rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col(count))).alias(out))


def dealt(rows: DataFrame, count: str, out: str) -> DataFrame:
    """Each row ``count`` times: cut into stretches of COPIES, which are dealt out to all tasks."""
    parts = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {COPIES}"))).alias("_part"))
    parts = parts.withColumn("_deal", F.xxhash64(F.monotonically_increasing_id())).repartition("_deal")
    first = F.col("_part") * COPIES
    return parts.select("*", F.explode(F.sequence(first + 1, F.least(first + COPIES, F.col(count)))).alias(out)).drop("_part", "_deal")


def mix_report(docs: DataFrame, id_col="doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: the id, size, source_size, target and taken (words).
    The copies of equal rows are spread evenly over them."""
    u = mix_units(docs, id_col=id_col, **options)
    u = repeated(u.where(F.col("m") <= COPIES), "m", "k").unionByName(dealt(u.where(F.col("m") > COPIES), "m", "k"))
    copies = F.expr("copies div m") + F.when(F.col("k") <= F.col("copies") % F.col("m"), 1).otherwise(0)
    return u.select(F.col("id").cast(docs.schema[position(docs, id_col)].dataType).alias(id_col), "size", "source_size", "target",
                    (F.col("size") * copies).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as it is taken. Null texts count 0
    words and are taken as often as others of their source; of repeated rows one stands for all; null ids and sources are values like any
    other; no rows give no rows; other columns, whatever their names, are those of the row taken."""
    u = (mix_units(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("copies > 0")
         .select(F.col("id").alias("_i"), F.col("source").alias("_s"), F.col("digest").alias("_d"), F.col("m").alias("_m"),
                 F.col("copies").alias("_c")))
    sealed = Sealed(docs)
    i, s, t = (F.col(sealed.column(c)) for c in (id_col, source_col, text_col))
    d = sealed.df.withColumn("_k", F.struct(i.cast("string").alias("i"), s.cast("string").alias("s"), F.xxhash64(t).alias("d")))

    def taken(units: DataFrame) -> DataFrame:
        j = d.join(units, d["_k.i"].eqNullSafe(units["_i"]) & d["_k.s"].eqNullSafe(units["_s"]) & (d["_k.d"] == units["_d"]))
        return j.where("_m = 1").unionByName(j.where("_m > 1").dropDuplicates(["_k"]))

    # rows taken many times are few: they are looked up apart and dealt out
    few, many = taken(u.where(F.col("_c") <= COPIES)), taken(u.where(F.col("_c") > COPIES))
    return sealed.open(repeated(few, "_c", "_n").unionByName(dealt(many, "_c", "_n")))
