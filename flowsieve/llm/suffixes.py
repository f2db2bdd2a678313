"""Suffix-array dedup: remove every byte covered by a string of ``length`` bytes that starts twice.

1. *Anchors.* Of the ``gram``-byte hashes in each window of ``length`` bytes the smallest one (the
   leftmost of equals) is the window's anchor. Equal windows have equal anchors at equal distances,
   so only windows around anchors that occur more than once can repeat. Consecutive windows with
   one anchor form a context: the bytes from the first window's start to the last one's end.
2. *Equal contexts.* Contexts are counted by (anchor hash, context hash): where a whole context
   repeats, all its windows do. Each task combines its own contexts first and sends at most two of an
   anchor, however hot the anchor is.
3. *Suffix runs.* What is left are contexts whose anchor repeats with other surroundings (the rims of
   copies). Their suffixes from the anchor on are sorted in each task, front-coded (length of the
   prefix shared with the suffix before, then the rest) and exchanged; the receiving task merges the runs
   with a loser tree whose nodes keep the length of the prefix known to be shared, so known
   prefixes are never compared again. This gives the suffixes in order with their common prefixes.
4. *Windows.* A window at distance r before the anchor repeats if some other context shares r bytes to
   the left and ``length - r`` from the anchor on. Both are runs of the two sorted orders (reversed
   left sides, suffixes), so windows of a distance are compared by two run numbers.

Contexts of one anchor meet in one task. An anchor with more than ``hot`` differing contexts is dealt
out by window instead: its windows are counted by two independent 64-bit hashes (map-side
combined), which needs no group in one place.

Scale: texts are shuffled once, by document, for steps 3 and 5 (the cut itself) together; everything
else is fixed-size rows, about one for each 70 bytes of text. Long texts are read in pieces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import named, pick, position, stored

LENGTH, GRAM = 200, 64
PIECE = 1 << 20  # bytes whose anchors are found at a time
PER_TARGET = 1 << 14  # contexts that meet in a task
HOT = 1 << 15
FLUSH = 1 << 20  # anchors a task combines at a time


def _powers(base: int) -> np.ndarray:
    p = np.full(PIECE + 2 * LENGTH, base, np.uint64)
    p[0] = 1
    return np.cumprod(p)


BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
TABLES = np.random.default_rng(2024).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWERS = [_powers(b) for b in BASES]
INVERSES = [_powers(pow(b, -1, 1 << 64)) for b in BASES]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any byte ranges of ``data`` from prefix sums."""

    def __init__(self, data: np.ndarray, which: int):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(TABLES[which][data] * POWERS[which][:len(data)], out=self.sums[1:])
        self.inverse = INVERSES[which]

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((self.sums[hi] - self.sums[lo]) * self.inverse[lo])


def contexts(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, gram: int):
    """Of texts standing one after another (at most PIECE bytes, all of them ``length`` or longer):
    (anchor hash, context hash, text number, anchor, first window, last window) with positions in
    ``data``."""
    h = Hashes(data, 0)
    n = len(data) - gram + 1
    at = np.arange(n)
    grams = h.of(at, at + gram)
    low = np.uint64((1 << 21) - 1)
    key = (grams & ~low) | at.astype(np.uint64)
    span = length - gram + 1
    rows = -(-n // span)
    grid = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = key
    grid = grid.reshape(rows, span)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(after[:n - span + 1], before[span - 1:n]) & low).astype(np.int64)  # by window start
    windows = sizes - length + 1
    text = np.repeat(np.arange(len(sizes)), windows)
    p = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(starts, windows)
    x = anchor[p]
    new = np.ones(len(p), bool)
    new[1:] = (x[1:] != x[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    lo, hi, x = p[first], p[np.append(first[1:], len(p)) - 1], x[first]
    shape = (x - lo).astype(np.uint64) << np.uint64(20) | (hi - lo).astype(np.uint64)
    return grams[x].view(np.int64), (h.of(lo, hi + length) + mixed(shape)).view(np.int64), text[first], x, lo, hi


def pieces_of(texts, length: int):
    """Groups of (key, text, offset, bytes): short texts together, long ones in pieces that overlap so
    that each window lies in one piece."""
    held, size = [], 0
    for key, text in texts:
        for at in range(0, max(len(text) - length + 1, 0), PIECE - length):
            part = text[at:at + PIECE - 1] if len(text) > PIECE - 1 else text
            if size + len(part) > PIECE and held:
                yield held
                held, size = [], 0
            held.append((key, at, part))
            size += len(part)
            if len(text) <= PIECE - 1:
                break
    if held:
        yield held


def combined(key, anchor, context, loc, rim) -> dict:
    """What a task sends of its own contexts: (kind, anchor, context, doc, loc, rim). Kind 0: the
    first two differing contexts of an anchor, to be counted; 1: known to repeat; 2: a further
    differing context of an anchor."""
    order = np.lexsort((loc, key, context, anchor))
    key, anchor, context, loc, rim = (a[order] for a in (key, anchor, context, loc, rim))
    new_anchor = np.append(True, anchor[1:] != anchor[:-1])
    new = new_anchor | np.append(True, context[1:] != context[:-1])
    cls = np.cumsum(new) - 1
    many = np.bincount(cls)[cls] > 1
    nth = np.cumsum(new) - np.cumsum(new)[np.flatnonzero(new_anchor)][np.cumsum(new_anchor) - 1]
    out = {c: [] for c in ("kind", "anchor", "context", "doc", "loc", "rim")}
    for kind, rows in ((0, new & (nth < 2)), (1, many), (2, new & (nth >= 2))):
        out["kind"].append(np.full(int(rows.sum()), kind, np.int8))
        for c, a in (("anchor", anchor), ("context", context), ("doc", key), ("loc", loc), ("rim", rim)):
            out[c].append(a[rows])
    return {c: np.concatenate(v) for c, v in out.items()}


def _find(length: int, gram: int):
    """(key, bytes) -> rows of ``combined``. loc: first window << 32 | last window; rim: how far the
    anchor lies behind the first window."""
    def run(batches):
        held, count = [], 0

        def texts():
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    part = b.slice(i, 256)
                    yield from zip(part.column("key").to_pylist(), part.column("bytes").to_pylist(), strict=True)

        def flush():
            c = combined(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_pydict(c)

        for group in pieces_of(texts(), length):
            sizes = np.array([len(t) for *_, t in group])
            starts = np.cumsum(sizes) - sizes
            anchor, context, text, x, lo, hi = contexts(np.frombuffer(b"".join(t for *_, t in group), np.uint8), starts, sizes, length, gram)
            shift = np.array([at for _, at, _ in group])[text] - starts[text]
            held.append((np.array([k for k, *_ in group], np.int64)[text], anchor, context, (lo + shift) << 32 | (hi + shift), x - lo))
            count += len(text)
            if count >= FLUSH:
                yield flush()
                held, count = [], 0
        if held:
            yield flush()
    return run


def marks_of(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """From (key, bytes): (anchor, doc, loc, rim, repeats, open). ``repeats``: all windows of the context
    do; ``open``: stands for its context among those that differ around one anchor."""
    found = texts.mapInArrow(_find(length, gram), "kind byte, anchor long, context long, doc long, loc long, rim long")
    # rows that are known already only pass through: spread by place
    found = found.withColumn("deal", F.when(F.col("kind") == 0, F.col("anchor")).otherwise(F.xxhash64("doc", "loc")))
    of_anchor = Window.partitionBy("kind", "deal")
    of_context = Window.partitionBy("kind", "deal", "context")
    m = (found.withColumn("n", F.count(F.lit(1)).over(of_context)).withColumn("nth", F.row_number().over(of_context.orderBy("doc", "loc")))
         .withColumn("differ", F.min("context").over(of_anchor) != F.max("context").over(of_anchor)))
    counted = F.col("kind") == 0
    m = m.withColumn("repeats", (F.col("kind") == 1) | (counted & (F.col("n") > 1)))
    m = m.withColumn("open", (F.col("kind") == 2) | (counted & F.col("differ") & (F.col("nth") == 1)))
    return m.where("repeats or open").select("anchor", "doc", "loc", "rim", "repeats", "open")


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, at least ``known``; bytes before that aren't looked at."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (differ.bit_length() + 7) // 8


class Run:
    """A front-coded sorted run, read item by item."""

    def __init__(self, shared: bytes, sizes: bytes, rests: bytes):
        self.shared, self.sizes, self.rests = np.frombuffer(shared, np.uint16).tolist(), np.frombuffer(sizes, np.uint16).tolist(), rests
        self.next, self.at, self.head = 0, 0, b""

    def advance(self) -> int | None:
        """Reads the next suffix; returns the prefix it shares with the last one, None at the end."""
        if self.next == len(self.shared):
            self.head = None
            return None
        k = self.shared[self.next]
        size = self.sizes[self.next] - k
        self.head = self.head[:k] + self.rests[self.at:self.at + size]
        self.at += size
        self.next += 1
        return k


def merge(runs: list[Run]):
    """Loser tree over front-coded runs: yields (run number, item number, prefix shared with the item
    before). Each node keeps the run that lost there and the prefix it shares with the item
    that won; a contender with a longer known prefix wins unseen, and only equal lengths are
    compared, from there on."""
    size = 1
    while size < len(runs):
        size *= 2
    for r in runs:
        r.advance()
    heads = lambda i: runs[i].head if i < len(runs) else None

    def play(a, ka, b, kb):
        """(winner, its prefix, loser, its prefix); prefixes are those shared with the last output."""
        ha, hb = heads(a), heads(b)
        if ha is None or hb is None:
            return (b, kb, a, 0) if ha is None else (a, ka, b, 0)
        if ka != kb:
            return (a, ka, b, kb) if ka > kb else (b, kb, a, ka)
        k = common_prefix(ha, hb, ka)
        if (len(ha) == k) if k in (len(ha), len(hb)) else ha[k] < hb[k]:
            return a, ka, b, k
        return b, kb, a, k

    loser: list[tuple[int, int]] = [(0, 0)] * size

    def build(node):
        if node >= size:
            return node - size, 0
        a, ka = build(2 * node)
        b, kb = build(2 * node + 1)
        w, kw, lost, kl = play(a, ka, b, kb)
        loser[node] = (lost, kl)
        return w, kw

    w, k = build(1)
    while heads(w) is not None:
        yield w, runs[w].next - 1, k
        k = runs[w].advance() or 0
        node = (w + size) // 2
        while node:
            other, known = loser[node]
            w, k, lost, kl = play(w, k, other, known)
            loser[node] = (lost, kl)
            node //= 2


def sorted_run(items: list[tuple]) -> dict:
    """Front-coded run of (suffix, left side, doc, first window)."""
    items.sort(key=lambda t: t[0])
    shared, rests, last = [], [], b""
    for s, *_ in items:
        k = common_prefix(last, s, 0)
        shared.append(k)
        rests.append(s[k:])
        last = s
    return {"shared": np.array(shared, np.uint16).tobytes(), "sizes": np.array([len(t[0]) for t in items], np.uint16).tobytes(),
            "rests": b"".join(rests), "left_sizes": np.array([len(t[1]) for t in items], np.uint16).tobytes(),
            "lefts": b"".join(t[1] for t in items), "docs": np.array([t[2] for t in items], np.int64).tobytes(),
            "firsts": np.array([t[3] for t in items], np.int64).tobytes()}


RUN = "shared binary, sizes binary, rests binary, left_sizes binary, lefts binary, docs binary, firsts binary"


def _extract(length: int, targets: int):
    """(bytes, key, open: list of (anchor hash, loc, rim)) -> (target, front-coded run)."""
    def run(batches):
        by_target: dict[int, list] = {}
        count = 0

        def flush():
            rows = [{"target": t, **sorted_run(items)} for t, items in sorted(by_target.items())]
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("target", pa.int64()), *((f.split()[0], pa.binary()) for f in RUN.split(", "))]))

        for b in batches:
            for i in range(0, b.num_rows, 64):
                for r in b.slice(i, 64).to_pylist():
                    text = r["bytes"]
                    for o in r["open"]:
                        lo, hi = o["loc"] >> 32, o["loc"] & 0xFFFFFFFF
                        x = lo + o["rim"]
                        by_target.setdefault(o["anchor"] % targets, []).append((text[x:hi + length], text[lo:x], r["key"], lo))
                        count += 1
                    if count >= 1 << 17:
                        yield flush()
                        by_target.clear()
                        count = 0
        if count:
            yield flush()
    return run


def repeated_windows(shared: np.ndarray, sizes: np.ndarray, lefts: list[bytes], length: int) -> np.ndarray:
    """(contexts x distances) which windows repeat among contexts in suffix order."""
    n = len(sizes)
    turned = [s[::-1] for s in lefts]
    order = sorted(range(n), key=turned.__getitem__)
    left_shared = np.array([0] + [common_prefix(turned[a], turned[b], 0) for a, b in zip(order, order[1:], strict=False)], np.int64)
    left_size = np.array([len(s) for s in lefts], np.int64)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    least = np.maximum(length - sizes, 0)  # the last window's distance
    repeats = np.zeros((n, int(left_size.max(initial=0)) + 1), bool)
    for r in range(int(least.min(initial=0)), int(left_size.max(initial=-1)) + 1):
        mine = np.flatnonzero((least <= r) & (r <= left_size))
        if len(mine) < 2:
            continue
        pair = np.cumsum(shared < length - r)[mine] * (n + 1) + np.cumsum(left_shared < r)[back[mine]]
        by = np.argsort(pair, kind="stable")
        same = pair[by][1:] == pair[by][:-1]
        hit = np.zeros(len(by), bool)
        hit[1:] |= same
        hit[:-1] |= same
        repeats[mine[by[hit]], r] = True
    return repeats


def _merge(length: int):
    def target_rows(rows):
        runs = [Run(r["shared"], r["sizes"], r["rests"]) for r in rows]
        sizes = [np.frombuffer(r["sizes"], np.uint16) for r in rows]
        docs, firsts = ([np.frombuffer(r[c], np.int64) for r in rows] for c in ("docs", "firsts"))
        ends = [np.cumsum(np.frombuffer(r["left_sizes"], np.uint16).astype(np.int64)) for r in rows]
        merged = list(merge(runs))
        at = [(w, i) for w, i, _ in merged]
        lefts = [rows[w]["lefts"][int(ends[w][i - 1]) if i else 0:int(ends[w][i])] for w, i in at]
        shared = np.array([k for *_, k in merged], np.int64)
        repeats = repeated_windows(shared, np.array([sizes[w][i] for w, i in at], np.int64), lefts, length)
        edge = np.diff(np.pad(repeats.astype(np.int8), ((0, 0), (1, 1))), axis=1)  # runs of distances
        who, near = np.nonzero(edge == 1)
        far = np.nonzero(edge == -1)[1] - 1
        doc = np.array([docs[w][i] for w, i in at], np.int64)[who]
        anchor = np.array([firsts[w][i] + len(s) for (w, i), s in zip(at, lefts, strict=True)], np.int64)[who]
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array((anchor - far) << 32 | (anchor - near))], ["doc", "loc"])

    def run(batches):
        target, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["target"] != target and rows:
                    yield target_rows(rows)
                    rows = []
                target = r["target"]
                rows.append(r)
        if rows:
            yield target_rows(rows)
    return run


def _hot_windows(length: int):
    """(key, bytes, open) -> (doc, start, two hashes) of every window of the contexts."""
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                for r in b.slice(i, 64).to_pylist():
                    out = [[], [], []]
                    for o in r["open"]:
                        lo, hi = o["loc"] >> 32, o["loc"] & 0xFFFFFFFF
                        data = np.frombuffer(r["bytes"][lo:hi + length], np.uint8)
                        at = np.arange(hi - lo + 1)
                        out[0].append(at + lo)
                        for j in (0, 1):
                            out[1 + j].append(Hashes(data, j).of(at, at + length).view(np.int64))
                    start, a, c = (np.concatenate(v) for v in out)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), r["key"], np.int64)), pa.array(start), pa.array(a), pa.array(c)],
                                                     ["doc", "start", "a", "b"])
    return run


def _cut(id_col: str, length: int):
    def run(batches):
        for b in batches:
            out = []
            for i in range(0, b.num_rows, 64):
                for r in b.slice(i, 64).to_pylist():
                    text, kept, done, removed, spans = r["bytes"], hashlib.sha256(), 0, 0, 0
                    for loc in sorted(r["locs"] or ()):
                        lo, end = loc >> 32, (loc & 0xFFFFFFFF) + length
                        if lo > done or not spans:
                            kept.update(text[done:lo])
                            spans += 1
                            done = lo
                        if end > done:
                            removed += end - done
                            done = end
                    kept.update(text[done:])
                    out.append((len(text), removed, spans, kept.hexdigest()))
            n, removed, spans, sha = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(id_col), *(pa.array(v, pa.int64()) for v in (n, removed, spans)), pa.array(sha, pa.string())],
                                             [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return run


def repeated(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """((id, key, bytes) of all rows, (doc, loc) of repeated windows)."""
    docs = pick(docs, i=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    ids = docs.groupBy("i").count().agg(F.max("count").alias("most"), F.count_if(F.col("i").isNull()).alias("none")).first()
    whole = docs.schema["i"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    plain = whole and (ids.most or 0) <= 1 and not ids.none
    # ids that repeat, are null or no integers: documents go by a hash of the row
    key = F.col("i").cast("long") if plain else F.xxhash64("i", text)
    texts = docs.select(F.col("i").alias(id_col), key.alias("key"), text.cast("binary").alias("bytes"))
    marks = stored(marks_of(texts.select("key", "bytes"), length, gram), "dedup-marks")
    opened = marks.where("open")
    crowded = opened.groupBy("anchor").count().where(F.col("count") > hot).select("anchor")
    crowded = stored(crowded, "dedup-hot")
    n = opened.count()
    targets = max(64, n // PER_TARGET)

    def with_texts(o):
        lists = o.groupBy("doc").agg(F.collect_list(F.struct("anchor", "loc", "rim")).alias("open"))
        return texts.select("key", "bytes").join(lists, F.col("key") == F.col("doc")).select("key", "bytes", "open")

    runs = with_texts(opened.join(crowded, "anchor", "left_anti")).mapInArrow(_extract(length, targets), f"target long, {RUN}")
    rims = runs.repartition(targets, "target").sortWithinPartitions("target").mapInArrow(_merge(length), "doc long, loc long")
    out = marks.where("repeats").select("doc", "loc").unionByName(rims)
    if crowded.count():
        windows = with_texts(opened.join(crowded, "anchor", "left_semi")).mapInArrow(_hot_windows(length), "doc long, start long, a long, b long")
        windows = stored(windows, "dedup-windows")
        twice = windows.groupBy("a", "b").count().where("count > 1").select("a", "b")
        start = windows.join(twice, ["a", "b"], "left_semi")
        out = out.unionByName(start.select("doc", F.shiftleft("start", 32).bitwiseOR(F.col("start")).alias("loc")))
    return texts, out


def dedup(docs: DataFrame, id_col="doc_id", text_col="text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes, joined).

    Texts are UTF-8 bytes, null is empty; matches never cross documents; texts shorter than ``length``
    keep everything, and so do empty ones. Strings are judged on the input, so of repeated rows every
    one loses what repeats. Rows with null or repeated ids are documents of their own; no rows give
    no rows; other columns play no part."""
    texts, windows = repeated(docs, id_col, text_col, length, gram, hot)
    lists = windows.groupBy("doc").agg(F.collect_list("loc").alias("locs"))
    j = texts.join(lists, F.col("key") == F.col("doc"), "left").select(named(id_col), "bytes", "locs")
    return j.mapInArrow(_cut(id_col, length), f"`{id_col}` {docs.schema[position(docs, id_col)].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
