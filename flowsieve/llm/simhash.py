"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most ``2 r`` bits exactly if some 64-bit value lies within
``r`` bits of both. So every distinct fingerprint stands for all its variants within half the
radius (2,081 for ``r`` = 2); the variants are shuffled by slice of the variant space, and
fingerprints that share a variant are linked.

The slice of a variant is a GF(2)-linear hash (parities of random bit masks), so the slice of
``fingerprint ^ flips`` is ``slice(fingerprint) ^ slice(flips)``. The shuffle therefore
carries each fingerprint once per slice that one of its variants falls into, and the receiving
task spells out just the variants of its own slice. Slices hold a bounded number of
variants: their count grows with the number of distinct fingerprints.

All fingerprints at one variant are within the radius of each other, so a star to the smallest
of them holds the links of the bucket: no bucket is ever expanded into pairs. Components of
the links come from alternating star contractions (checkpointed tables, joins on nodes).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import Sealed, named, pick, row_key, stored

SEED = 42
MIN_SLICES = 128
SLICE_VARIANTS = 1 << 22  # variants that one task holds at a time
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int) -> int:
    """64-bit SimHash of the text's word shingles (A-Z lower-cased, repeats included). Fewer
    words than a shingle: the whole sequence is one; no word or null: 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    buf = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    k = min(words, len(tokens))
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(tokens) - k + 1].tolist()
    ends = ends[k - 1:].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), CHUNK):
        part = [digest(buf[s:e], SEED) for s, e in zip(starts[i:i + CHUNK], ends[i:i + CHUNK], strict=True)]
        h = np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(h, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col="text", words=4) -> DataFrame:
    """All columns but the text, and ``fingerprint`` as a signed 64-bit integer."""
    kept = [c for c in docs.columns if c != text_col]

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(text_col).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(fp)], [*kept, "fingerprint"])

    schema = docs.select(*[named(c) for c in kept], F.lit(0).cast("long").alias("fingerprint")).schema
    return docs.mapInArrow(run, schema)


def flips(radius: int) -> np.ndarray:
    """All 64-bit masks of at most ``radius`` bits."""
    return np.array([sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)], dtype=np.uint64)


def slice_of(values: np.ndarray, bits: int) -> np.ndarray:
    """The linear slice hash: ``bits`` parities."""
    masks = np.random.default_rng(7).integers(1, 1 << 63, size=bits, dtype=np.uint64)
    out = np.zeros(len(values), np.int64)
    for j, m in enumerate(masks):
        out |= (np.bitwise_count(values & m) & 1).astype(np.int64) << j
    return out


def slice_links(fps: np.ndarray, own: int, bits: int, radius: int) -> np.ndarray:
    """Links (smaller, larger) between the fingerprints that share a variant of slice ``own``."""
    masks = flips(radius)
    mask_slice = slice_of(masks, bits)
    of = slice_of(fps, bits)
    order = np.argsort(of, kind="stable")
    fps, of = fps[order], of[order]
    classes, first = np.unique(of, return_index=True)
    variants, sources = [], []
    for c, lo, hi in zip(classes.tolist(), first.tolist(), [*first[1:].tolist(), len(fps)], strict=True):
        m = masks[mask_slice == (c ^ own)]
        if len(m):
            variants.append((fps[lo:hi, None] ^ m[None, :]).ravel())
            sources.append(np.repeat(np.arange(lo, hi, dtype=np.int32), len(m)))
    if not variants:
        return np.zeros((0, 2), np.uint64)
    v, src = np.concatenate(variants), np.concatenate(sources)
    s = np.sort(v)
    shared = s[1:][s[1:] == s[:-1]]
    if not len(shared):
        return np.zeros((0, 2), np.uint64)
    low = np.uint64((1 << 20) - 1)
    maybe = np.zeros(1 << 20, bool)
    maybe[shared & low] = True
    hit = np.flatnonzero(maybe[v & low])  # a few false hits stand alone below
    v, f = v[hit], fps[src[hit]]
    order = np.lexsort((f, v))
    v, f = v[order], f[order]
    start = np.concatenate(([True], v[1:] != v[:-1]))
    centre = f[np.maximum.accumulate(np.where(start, np.arange(len(v)), 0))]
    links = np.stack([centre, f], axis=1)[~start]
    links = links[np.bitwise_count(links[:, 0] ^ links[:, 1]) <= 2 * radius]  # verify
    return np.unique(links, axis=0)


def ball_links(distinct: DataFrame, max_distance: int) -> DataFrame:
    """(a, b): links between distinct ``fingerprint`` values, whose components are those of all
    pairs at ``max_distance`` bits or fewer. The distance must be even."""
    if max_distance % 2:
        raise ValueError("max_distance must be even: variants meet at half of it")
    radius = max_distance // 2
    per = len(flips(radius))
    n = distinct.count()
    bits = max(MIN_SLICES - 1, n * per // SLICE_VARIANTS).bit_length()
    reached = np.unique(slice_of(flips(radius), bits))
    chunk = CHUNK if len(reached) == 1 << bits else max(1, SLICE_VARIANTS // len(reached))  # sent at a time
    tasks = 1 << bits if bits <= 10 else 1 << (bits - 3)  # a task does its slices one after another
    schema = "slice long, fingerprints binary"

    def emit(batches):
        def rows(fps):
            of = slice_of(fps, bits)
            if len(reached) == 1 << bits:
                groups = [(s, fps) for s in range(1 << bits)]
            else:
                target = (of[:, None] ^ reached[None, :]).ravel()
                order = np.argsort(target, kind="stable")
                who = np.repeat(fps, len(reached))[order]
                slices, first = np.unique(target[order], return_index=True)
                groups = zip(slices.tolist(), np.split(who, first[1:]), strict=True)
            ids, blobs = zip(*((s, g.tobytes()) for s, g in groups), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["slice", "fingerprints"])
        held, count = [], 0
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fps), chunk):
                held.append(fps[i:i + chunk])
                count += len(held[-1])
                if count >= chunk:
                    yield rows(np.concatenate(held))
                    held, count = [], 0
        if count:
            yield rows(np.concatenate(held))

    def link(batches):
        def done(own, parts):
            e = slice_links(np.concatenate(parts), own, bits, radius).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])
        own, parts = None, []
        for b in batches:
            for s, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s != own and parts:
                    yield done(own, parts)
                    parts = []
                own = s
                parts.append(np.frombuffer(blob, np.uint64))
        if parts:
            yield done(own, parts)

    spread = distinct.select("fingerprint").mapInArrow(emit, schema).repartition(tasks, "slice").sortWithinPartitions("slice")
    return spread.mapInArrow(link, "a long, b long").distinct()


def components(links: DataFrame, name="simhash") -> DataFrame:
    """(node, root) for every node of the links (a, b): alternating star contractions. A node's
    smallest neighbour is a map-side-combined minimum, joined back on the node, so a node with
    very many links is split like any other skewed join key."""
    e, before = stored(links.where("a <> b").distinct(), f"{name}-links"), None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a and m <> b").select(F.least("m", "b").alias("a"), F.greatest("m", "b").alias("b")).distinct()
        large = stored(large, f"{name}-large")
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        pairs = large.join(low, large["b"] == low["u"])
        small = (pairs.select(F.col("m").alias("a"), F.col("b")).unionByName(
            pairs.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")))).distinct()
        e = stored(small, f"{name}-small")
        now = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def with_components(rows: DataFrame, id_col: str, max_distance: int) -> DataFrame:
    """``rows`` (with ``fingerprint``) and ``component_id``: the smallest id that links reach."""
    reps = stored(rows.groupBy("fingerprint").agg(F.min(named(id_col)).alias("rep")), "simhash-distinct")
    roots = components(ball_links(reps, max_distance))
    by_root = (reps.join(roots, reps["fingerprint"] == roots["node"], "left")
               .select("fingerprint", "rep", F.coalesce("root", "fingerprint").alias("root")))
    by_root = stored(by_root, "simhash-roots")
    least = by_root.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = by_root.join(least, "root").select("fingerprint", "component_id", "root")
    return rows.join(of, "fingerprint")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", words=4, max_distance=4) -> DataFrame:
    """Per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    Fingerprints at ``max_distance`` bits or fewer are linked; a component is what links reach,
    named by its smallest non-null id (null if it has none). Null and empty texts have
    fingerprint 0 and are linked like any other; repeated rows are all returned; no rows give
    no rows; other columns play no part."""
    rows = stored(fingerprints(pick(docs, id=id_col, text=text_col), "text", words), "simhash-rows")
    out = with_components(rows, "id", max_distance)
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", words=4, max_distance=4) -> DataFrame:
    """``docs`` with one row per component: that of the smallest id (null last, then by a hash of
    the row); rows equal in every column count once. The winners are found on
    (id, row hash, fingerprint) alone, so texts of a large group never meet."""
    sealed = Sealed(docs)
    i, d = F.col(sealed.column(id_col)), sealed.df.withColumn("_row", row_key(sealed.df))
    keyed = d.select(i.alias("_id"), F.col("_row").alias("_key"), F.col(sealed.column(text_col)).alias("_text"))
    rows = stored(fingerprints(keyed, "_text", words), "simhash-rows")
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_key").alias("key"))).alias("best")
    won = with_components(rows, "_id", max_distance).groupBy("root").agg(best).select("best.id", "best.key")
    kept = d.join(won, F.col("_row").eqNullSafe(F.col("key")) & i.eqNullSafe(F.col("id")), "left_semi")
    return sealed.open(kept.dropDuplicates([sealed.column(id_col), "_row"]))
