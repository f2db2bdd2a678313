"""Exact top-k inner products over a bit-sliced index.

A block of vectors stores one bitmap per bit of each quantised component. A query adds the
slices with bitmap arithmetic: every set bit ``j`` of its component's magnitude contributes the
component's slices at weight ``j`` (complemented where the component is negative), and
carry-save adders reduce all bitmaps of a weight to one, so that the slices of the score stand
there for the whole block. The best rows are then selected from the most significant slice
downward; rows still equal at the last slice are the boundary and are resolved by id.

Scale: vectors are dealt by hash into blocks of bounded size and queries, by id and vector, into batches of bounded
size; each (block, batch) cell is one unit of work, and a block is sent once a batch. A cell returns at most k rows per query,
so the last step sorts ``k x blocks`` rows of a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import pick, stored

BLOCK_ROWS = 1 << 16
BATCH_QUERIES = 64  # least queries of a batch
MOST_QUERIES = 8192  # most: about the bytes of a block
CELLS_A_CORE = 4
MOST_TASKS = 1 << 20


def slices_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lowest value, slice count, bitmaps) of integer columns ``x`` (rows x dims); the bitmaps of
    all dims stand one after the other, least significant slice first."""
    n, dims = x.shape
    low = x.min(axis=0) if n else np.zeros(dims, np.int64)
    y = x.astype(np.int64).view(np.uint64) - low.astype(np.int64).view(np.uint64)  # exact also where the range takes 64 bits
    width = np.array([int(m).bit_length() for m in (y.max(axis=0) if n else low)], np.int64)
    words = -(-n // 64)
    maps = np.zeros((int(width.sum()), words * 8), np.uint8)
    at = 0
    for d in range(dims):
        for b in range(int(width[d])):
            bits = np.packbits((y[:, d] >> np.uint64(b) & np.uint64(1)).astype(bool), bitorder="little")
            maps[at, :len(bits)] = bits
            at += 1
    return low, width, maps.view(np.uint64)


def add_slices(q: np.ndarray, width: np.ndarray, maps: np.ndarray) -> list[np.ndarray]:
    """Slices (least significant first) of ``sum |q_d| y_d``, with ``y_d`` complemented where
    ``q_d`` is negative. Bits past the last row hold anything."""
    start = np.concatenate(([0], np.cumsum(width)))
    by_weight: dict[int, list[np.ndarray]] = {}
    for d, v in enumerate(q.tolist()):
        lo, hi, size = start[d], start[d + 1], abs(v)
        if hi > lo and size:
            part = ~maps[lo:hi] if v < 0 else maps[lo:hi]
            for j in range(size.bit_length()):
                if size >> j & 1:
                    for b in range(hi - lo):
                        by_weight.setdefault(j + b, []).append(part[b:b + 1])
    out, weight = [], 0
    while by_weight:
        held = by_weight.pop(weight, None)
        if held is None:
            out.append(np.zeros(maps.shape[1], np.uint64))
            weight += 1
            continue
        held = np.concatenate(held)
        while len(held) > 1:
            if len(held) == 2:
                a, b = held[:1], held[1:]
                total, carry = a ^ b, a & b
                rest = held[:0]
            else:
                t = len(held) // 3
                a, b, c, rest = held[:t], held[t:2 * t], held[2 * t:3 * t], held[3 * t:]
                half = a ^ b
                total, carry = half ^ c, (a & b) | (half & c)
            by_weight.setdefault(weight + 1, []).append(carry)
            held = np.concatenate([total, rest])
        out.append(held[0])
        weight += 1
    return out


def select_top(slices: list[np.ndarray], candidates: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k largest scores, ties to the smaller row number."""
    chosen, equal = np.zeros_like(candidates), candidates
    for s in reversed(slices):
        more = equal & s
        n = int(np.bitwise_count(chosen | more).sum())
        if n > k:
            equal = more
        else:
            chosen, equal = chosen | more, equal & ~s
            if n == k:
                equal = np.zeros_like(equal)
                break
    rows = lambda bits: np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
    top = rows(chosen)
    return np.concatenate([top, rows(equal)[:k - len(top)]])


def block_top(q: np.ndarray, own: np.ndarray, low, width, maps, n: int, k: int):
    """(rows, scores) of the k best rows of a block for query vector ``q``; rows in ``own`` don't
    take part."""
    slices = add_slices(q, width, maps)
    allowed = np.zeros(maps.shape[1] * 64, bool)
    allowed[:n] = True
    allowed[own] = False
    allowed = np.packbits(allowed, bitorder="little").view(np.uint64)
    rows = select_top(slices, allowed, k)
    # complemented components count (2^width - 1) - y
    base = sum(int(v) * int(x) for v, x in zip(q, low, strict=True)) - sum(int(-v) * ((1 << int(w)) - 1) for v, w in zip(q, width, strict=True) if v < 0)
    scores = [base + sum(int(s[r >> 6] >> np.uint64(r & 63)) % 2 << i for i, s in enumerate(slices)) for r in rows.tolist()]
    return rows, scores


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, dims, vector long[]): floor(scale * x); vectors that are null or hold null or
    non-finite components are left out. A component that leaves 64 bits is an error."""
    df, v = pick(df, id=id_col, v=vector_col), F.col("v")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))

    def floored(x):
        y = F.lit(float(scale)) * x.cast("double")
        fits = (y >= F.lit(-2.0 ** 63)) & (y < F.lit(2.0 ** 63))
        return F.when(fits, F.floor(y).cast("long")).otherwise(F.raise_error(F.lit("vector component leaves 64 bits")).cast("long"))
    whole = F.transform(v, floored)
    return df.where(F.coalesce(finite, F.lit(False))).select(F.col("id").cast("long"), F.size(v).alias("dims"), whole.alias("vector"))


def _matrix(column, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def _build(table: pa.Table) -> pa.Table:
    dims, block = table["dims"][0].as_py(), table["block"][0].as_py()
    table = table.sort_by([("id", "ascending")])  # nulls last
    low, width, maps = slices_of(_matrix(table["vector"], dims))
    ids = table["id"].to_numpy()
    none = int(table["id"].null_count)
    ids = np.nan_to_num(ids).astype(np.int64) if none and none < len(ids) and ids.dtype.kind == "f" else table["id"].fill_null(0).to_numpy()
    return pa.table({"dims": pa.array([dims], pa.int32()), "block": pa.array([block], pa.int64()), "nulls": pa.array([none], pa.int64()),
                     "ids": pa.array([ids.tobytes()], pa.binary()), "low": pa.array([low.tobytes()], pa.binary()),
                     "width": pa.array([width.tobytes()], pa.binary()), "maps": pa.array([maps.tobytes()], pa.binary())})


def _search(k: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, low, width = (np.frombuffer(r[c], np.int64) for c in ("ids", "low", "width"))
                maps = np.frombuffer(r["maps"], np.uint64).reshape(int(width.sum()), -(-len(ids) // 64))
                named_rows = len(ids) - r["nulls"]
                out = [[], [], []]
                for query, vector in zip(r["queries"], r["vectors"], strict=True):
                    lo, hi = np.searchsorted(ids[:named_rows], [query, query + 1])
                    rows, scores = block_top(np.array(vector, np.int64), np.arange(lo, hi), low, width, maps, len(ids), k)
                    out[0] += [query] * len(rows)
                    out[1] += [int(ids[i]) if i < named_rows else None for i in rows]
                    out[2] += scores
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])
    return run


def top_inner_products(vectors: DataFrame, k: int = 5, every: int = 50, id_col="vec_id", vector_col="embedding", scale: int = 256,
                       block_rows: int = BLOCK_ROWS, batch_queries: int = BATCH_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (id divisible by ``every``) its k largest inner
    products of ``floor(scale * x)`` over all rows but those with its own id; ties to the smaller
    id, null ids last (a null id is a candidate, not a query). Only vectors of equal length are
    compared. Rows that repeat an id are candidates each and, as queries, count once per distinct
    vector. A component or one of these scores that leaves 64 bits is an error. No rows give no rows; other
    columns play no part."""
    rows = quantised(vectors, id_col, vector_col, scale).groupBy("id", "dims", "vector").agg(F.count(F.lit(1)).alias("copies"))
    # of equal rows, only k can be among the best k
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("copies"), F.lit(k).cast("long"))))
    rows = stored(rows.withColumn("copy", copies).select("id", "dims", "vector"), "bsi-rows")
    n = rows.count()
    blocks, asked = max(1, -(-n // block_rows)), rows.where(F.col("id") % every == 0).distinct()
    # batches as large as leave every core some cells, so that a block is sent few times
    queries, cores = asked.count(), vectors.sparkSession.sparkContext.defaultParallelism
    batches = max(1, -(-queries // min(MOST_QUERIES, max(batch_queries, queries * blocks // (CELLS_A_CORE * cores)))))
    index = (rows.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)))
             .groupBy("dims", "block").applyInArrow(_build, "dims int, block long, nulls long, ids binary, low binary, width binary, maps binary"))
    grouped = (asked.withColumn("batch", F.pmod(F.xxhash64("id", "vector", F.lit(1)), F.lit(batches)))
               .groupBy("dims", "batch").agg(F.collect_list(F.struct("id", "vector")).alias("q"))
               .select("dims", "batch", F.col("q.id").alias("queries"), F.col("q.vector").alias("vectors")))
    cells = (index.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))))
             .join(grouped, ["dims", "batch"]).repartition(min(4 * blocks * batches, MOST_TASKS), "dims", "block", "batch"))
    found = cells.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
