"""Ranked lexical search over hashed max-sketches.

A document's sketch has a power of two of slots, at least four for each distinct term; a slot holds the largest
frequency among the terms that hash into it, rounded up to one byte. A term's impact grows with its
frequency, so that the slots, turned into impacts once the collection's totals are known, are the coordinatewise
maxima of the impacts of the document's terms, and a query's lookups into them never fall below
its score. A task looks a whole batch of queries up in a block of sketches, takes the documents of a
query by descending bound, scores these exactly from their texts, and stops where the bound falls below the
query's k-th best exact score so far; that threshold is carried over all blocks of the task.

Scale: the index is written once, beside the texts, and read once for the document frequencies of the query
terms and once for the search. Queries are the small side: they are dealt into rounds of bounded size, each
one pass over the index. A task returns at most k rows a query, and these are ranked in two steps.

Null and empty texts have no terms and never match; a null or empty query finds nothing; repeated documents
each take a rank; equal scores go by ascending id (null ids last); repeated queries are answered each; no rows give no
rows; other columns play no part.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import pick, stored

ROUND_BYTES = 8 << 20  # of query texts that are looked up in one pass
BLOCK = 256  # documents whose bounds are held at a time
CELL = 1 << 20  # bounds (terms x documents) held at a time

# The characters between terms (all other bytes, those above 127 included, belong to terms).
BETWEEN = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
TABLE = bytes(32 if c in BETWEEN else c + 32 if 65 <= c <= 90 else c for c in range(256))

# Frequencies a slot can hold: exact to 127, then growing by a fifth, past any count of a text.
HELD = np.array([*range(128), *(math.ceil(127 * 1.2 ** i) for i in range(1, 129))], np.int64)
SCALE = 1_000_000_000


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def slot_hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term)


def sketch_of(counts: Counter) -> bytes:
    """One byte a slot: the place in HELD of the largest frequency, rounded up."""
    if not counts:
        return b""
    bits = max(4, (4 * len(counts) - 1).bit_length())
    slots = np.fromiter((slot_hash(t) >> (64 - bits) for t in counts), np.int64, len(counts))
    codes = np.searchsorted(HELD, np.fromiter(counts.values(), np.int64, len(counts))).astype(np.uint8)
    out = np.zeros(1 << bits, np.uint8)
    np.maximum.at(out, slots, codes)
    return out.tobytes()


def build_index(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n, text, sketch) of every document that has a term; written in the shared folder."""
    d = pick(docs, id=id_col, text=text_col).select("id", F.col("text").cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                counts = [Counter(terms_of(t)) for t in part.column("text").to_pylist()]
                n = [c.total() for c in counts]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), part.column("text"),
                                                  pa.array([sketch_of(c) for c in counts], pa.binary())], ["id", "n", "text", "sketch"])

    schema = d.select("id", F.lit(0).cast("long").alias("n"), "text", F.lit(b"").alias("sketch")).schema
    return stored(d.mapInArrow(run, schema).where("n > 0"), "search-index")


class Queries:
    """A round of queries: their distinct terms, and for each query its terms with how often they occur."""

    def __init__(self, texts: list[bytes | None]):
        each = [Counter(terms_of(t)) for t in texts]
        self.terms = sorted(set().union(*each))
        self.number = {t: i for i, t in enumerate(self.terms)}
        self.slot = np.array([slot_hash(t) for t in self.terms], np.uint64)
        self.live = [i for i, c in enumerate(each) if c]  # queries that have terms
        self.which = np.array([self.number[t] for i in self.live for t in each[i]], np.int64)
        self.times = np.array([n for i in self.live for n in each[i].values()], np.int64)
        sizes = [len(each[i]) for i in self.live]
        self.first = np.cumsum([0, *sizes])[:-1]
        self.last = self.first + np.array(sizes, np.int64)

    def weigh(self, documents: int, df: np.ndarray) -> Queries:
        w = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df]
        self.weight = np.array(w, np.int64)[self.which] * self.times if len(self.which) else np.zeros(0, np.int64)
        return self

    def batches(self):
        """Ranges of queries whose terms times BLOCK documents fit a cell."""
        at = 0
        while at < len(self.live):
            to = max(at + 1, int(np.searchsorted(self.last, self.first[at] + CELL // BLOCK, side="right")))
            yield at, to
            at = to


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (1000 * tf + 12 * m)


class Search:
    """The best ``k`` documents of each query among the blocks it is shown."""

    def __init__(self, queries: Queries, documents: int, terms: int, k: int):
        self.q, self.documents, self.terms, self.k = queries, documents, terms, k
        self.best: list[list] = [[] for _ in queries.live]  # heaps of (score, -id), the worst first

    def bounds(self, sketches: list[bytes], m: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """(queries lo..hi x documents): scores that no document exceeds."""
        q = self.q
        span = slice(int(q.first[lo]), int(q.last[hi - 1]))
        out = np.zeros((hi - lo, len(sketches)), np.int64)
        sizes = np.array([len(s) for s in sketches])
        for width in np.unique(sizes):
            at = np.flatnonzero(sizes == width)
            step = max(1, CELL // int(width))
            for i in range(0, len(at), step):
                some = at[i:i + step]
                codes = np.frombuffer(b"".join([sketches[j] for j in some]), np.uint8).reshape(len(some), width).T
                slots = (q.slot[q.which[span]] >> np.uint64(65 - int(width).bit_length())).astype(np.int64)
                # impacts of all slots or of the slots asked for, whichever are fewer
                maxima = impact(HELD[codes], m[some])[slots] if width < len(slots) else impact(HELD[codes[slots]], m[some])
                found = maxima * q.weight[span, None]
                out[:, some] = np.add.reduceat(found, q.first[lo:hi] - q.first[lo], axis=0)
        return out

    def floor(self, i: int) -> tuple:
        return self.best[i][0] if len(self.best[i]) == self.k else (0, math.inf)

    def show(self, ids: list, n: list[int], texts: list[bytes], sketches: list[bytes]) -> None:
        m = np.array([75 + 25 * size * self.documents // self.terms for size in n], np.int64)
        known: dict[int, np.ndarray] = {}

        def impacts(doc: int) -> np.ndarray:
            if doc not in known:
                counts, tf = Counter(terms_of(texts[doc])), np.zeros(len(self.q.terms), np.int64)
                for t in counts.keys() & self.q.number.keys():
                    tf[self.q.number[t]] = counts[t]
                known[doc] = impact(tf, m[doc])[self.q.which]
            return known[doc]

        for lo, hi in self.q.batches():
            bounds = self.bounds(sketches, m, lo, hi)
            floors = np.array([max(1, self.floor(i)[0]) for i in range(lo, hi)], np.int64)
            for i in np.flatnonzero((bounds >= floors[:, None]).any(axis=1)).tolist():
                terms = slice(int(self.q.first[lo + i]), int(self.q.last[lo + i]))
                heap, row = self.best[lo + i], bounds[i]
                candidates = np.flatnonzero(row >= floors[i])
                for doc in candidates[np.argsort(-row[candidates], kind="stable")].tolist():
                    if row[doc] < max(1, self.floor(lo + i)[0]):
                        break
                    score = int(impacts(doc)[terms] @ self.q.weight[terms])
                    entry = (score, -math.inf if ids[doc] is None else -ids[doc])
                    if score > 0 and len(heap) < self.k:
                        heapq.heappush(heap, entry)
                    elif score > 0 and entry > heap[0]:
                        heapq.heapreplace(heap, entry)


def rounds_of(items: DataFrame, id_col: str, text_col: str, round_bytes: int):
    """Queries in rounds of about ``round_bytes`` of text, as lists of (id, text)."""
    d = pick(items, id=id_col, text=text_col).select("id", F.col("text").cast("binary").alias("text")).where("text is not null")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // round_bytes))
    for i in range(n):
        part = d if n == 1 else d.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
        rows = part.collect()
        if rows:
            yield [(r.id, bytes(r.text)) for r in rows]


def document_frequencies(index: DataFrame, queries: Queries) -> np.ndarray:
    """Documents that hold each term of a round."""
    known = dict(queries.number)

    def run(batches):
        found = np.zeros(len(known), np.int64)
        for b in batches:
            for text in b.column("text"):
                for t in set(terms_of(text.as_py())) & known.keys():
                    found[known[t]] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["term", "df"])

    rows = index.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(known), np.int64)
    out[rows["term"].to_numpy()] = rows["df"].to_numpy()
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
           round_bytes: int = ROUND_BYTES) -> DataFrame:
    """The ``k`` highest-scoring documents of every query: item_id, rank, doc_id, score (above 0 only)."""
    index = build_index(docs, id_col, text_col)
    total = index.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms"), F.max("n").alias("most")).first()
    documents, terms = total.documents, total.terms or 0
    if 25 * (total.most or 0) * documents >= 1 << 63:
        raise OverflowError("25 * n * N leaves 64 bits")
    doc_type, item_type = index.schema["id"].dataType, pick(items, id=item_col).schema["id"].dataType
    spark = docs.sparkSession
    found = spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id {doc_type.simpleString()}, score long")
    for number, asked in enumerate(rounds_of(items, item_col, item_text_col, round_bytes) if documents else ()):
        queries = Queries([text for _, text in asked])
        if not queries.live:
            continue
        queries.weigh(documents, document_frequencies(index, queries))

        def run(batches, queries=queries):
            state = Search(queries, documents, terms, k)
            for b in batches:
                for at in range(0, b.num_rows, BLOCK):
                    part = b.slice(at, BLOCK)
                    state.show(*(part.column(c).to_pylist() for c in ("id", "n", "text", "sketch")))
            rows = [(q, None if key == -math.inf else -key, score) for q, heap in zip(queries.live, state.best, strict=True) for score, key in heap]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.int64(),) * 3, strict=True)],
                                             ["query", "doc_id", "score"])

        hits = index.mapInArrow(run, "query long, doc_id long, score long").withColumn("task", F.spark_partition_id() % 64)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for keys in (["query", "task"], ["query"]):
            hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(asked)], f"query long, item_id {item_type.simpleString()}")
        found = found.unionByName(hits.join(F.broadcast(names), "query").select("item_id", "rank", F.col("doc_id").cast(doc_type).alias("doc_id"), "score"))
    return found
