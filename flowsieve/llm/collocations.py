"""Phrase collocations by Rabin-Karp fingerprints.

Documents are packed per language into blocks of bounded size and written once. In a block, prefix
polynomials (modulo 2^64) over the bytes hash every word, and prefix polynomials over the word hashes
hash every phrase of 1 to 4 words. Equal fingerprints of a block are compared byte by byte and become one
row: fingerprint, count, pointer to an occurrence. A shuffle sums the counts of a fingerprint; the
pointers of those that reach ``least`` go back to their blocks, which cut the phrases out, and a last
sum by language and text, in buckets of bounded size, gives exact counts whatever collides. Phrases of 3 and 4 words are only looked
at where all their word pairs are frequent (a bitmap of fixed size; what it lets through in vain
is counted like the rest).

Scale: a task holds one block; a fingerprint or phrase that stands in every document reaches the
shuffle once a block; only phrases that may be frequent ever leave their block as text.

Null texts are empty, a null language is ``und``; empty texts and empty tables have no phrases; repeated
rows count as often as they stand; texts longer than a block are cut between words with the words that
follow as context; other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import pick, stored
from flowsieve.session import scratch_path

WIDEST = 4
BLOCK = (8 << 20) - 1
PLACE_BITS = 24  # of a pointer, for the place in its block; ROW_BITS for the block's row in its task
ROW_BITS = 18
SEGMENT = 1 << 17  # bytes whose prefix polynomial is held at a time
BITS = 24  # of a fingerprint, in the bitmap of frequent word pairs: 2 MB at any size of the input
BUCKET_MARKS = 300_000  # pointers of one and two words a bucket of texts
SPACE, BREAK, CONTEXT = 32, 10, 11  # what a normalised text holds between words
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SALTS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)

# The marks that split a text into pieces.
SPLITTERS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes(BREAK if c in SPLITTERS else SPACE if c in b" \t" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def parts_of(text: bytes, limit: int):
    """The normalised text in parts of about ``limit`` bytes, cut between words. A part that is cut
    inside a piece is followed by the next words of it as context: phrases may reach into these
    but not start there."""
    t = text.translate(TABLE)
    if b"  " in t:
        t = re.sub(rb"  +", b" ", t)
    at = 0
    while len(t) - at > limit and (gap := re.compile(rb"[ \n]").search(t, at + limit)):
        end = gap.start()
        more = re.compile(rb"(?:[^ \n]+ ?){0,%d}" % (WIDEST - 1)).match(t, end + 1)[0].rstrip(b" ") if t[end] == SPACE else b""
        yield t[at:end] + (bytes([CONTEXT]) + more if more else b"")
        at = end + 1
    if at < len(t):
        yield t[at:]


class Words:
    """Where the words of a block stand: start, end, whether the next word belongs to the same piece
    (``joined``) and whether a phrase may start here (``own``)."""

    def __init__(self, block: bytes):
        self.data = np.frombuffer(block + bytes(8), np.uint8).copy()
        a = self.data[:len(block)]
        word = (a != SPACE) & (a != BREAK) & (a != CONTEXT)
        edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
        self.start, self.end = edges[::2], edges[1::2]
        gap = a[self.end[:-1]]
        self.joined = np.append((self.start[1:] - self.end[:-1] == 1) & (gap != BREAK), False) if len(self.start) else np.zeros(0, bool)
        self.own = np.ones(len(self.start), bool)
        marks = np.flatnonzero(a == CONTEXT)
        if len(marks):
            breaks = np.flatnonzero(a == BREAK)
            before = lambda places: np.append(-1, places)[np.searchsorted(places, self.start)]
            self.own = before(marks) <= before(breaks)
            a[marks] = SPACE
        self.eight = np.ndarray(len(block) + 1, "<u8", buffer=self.data, strides=(1,))

    def hashes(self) -> np.ndarray:
        """Fingerprint of every word, from prefix polynomials over segments of the bytes."""
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + SEGMENT, side="right")))
            lo, hi = int(self.start[i]), int(self.end[j - 1])
            up, down = powers(hi - lo)
            prefix = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((self.data[lo:hi].astype(np.uint64) + np.uint64(1)) * up, out=prefix[1:])
            s, e = self.start[i:j] - lo, self.end[i:j] - lo
            out[i:j] = (prefix[e] - prefix[s]) * down[s]
            i = j
        return mixed(out)

    def starts(self, k: int) -> np.ndarray:
        """Numbers of the words at which a phrase of ``k`` words starts."""
        ok = self.own.copy()
        for j in range(k - 1):
            ok[:len(ok) - j] &= self.joined[j:]
            ok[len(ok) - j:] = False
        return np.flatnonzero(ok)

    def unequal(self, one: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
        """Whether the phrases of ``k`` words at two word numbers differ, by their bytes."""
        s, t = self.start[one], self.start[other]
        size = self.end[one + k - 1] - s
        bad = size != self.end[other + k - 1] - t
        live, at = np.flatnonzero(~bad), 0
        while len(live):
            left = size[live] - at
            x = self.eight[s[live] + at] ^ self.eight[t[live] + at]
            cut = (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
            off = (x << cut) != 0
            bad[live[off]] = True
            live = live[~off & (left > 8)]
            at += 8
        return bad


_powers: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` (at least) powers of the base and of its inverse modulo 2^64."""
    held = _powers.get("held")
    if held is None or len(held[0]) < n:
        size = max(n, SEGMENT + 1)
        held = tuple(np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64))) for b in (BASE, INVERSE))
        if size <= 8 * SEGMENT:
            _powers["held"] = held
    return held[0][:n], held[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * SALTS[0]
    return h ^ (h >> np.uint64(29))


def fingerprints(words: Words, lang: str, widths: tuple[int, ...]):
    """(k, word numbers, fingerprints) of the phrases of each width, by prefix polynomials over words."""
    h = words.hashes()
    up, down = powers(len(h))
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up, out=prefix[1:])
    tongue = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))
    for k in widths:
        at = words.starts(k)
        yield k, at, mixed(((prefix[at + k] - prefix[at]) * down[at] + tongue) * SALTS[k - 1])


def rows_of(words: Words, at: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, word number of an occurrence, count) of every phrase; phrases of one fingerprint
    that differ in their bytes are rows of their own."""
    order = np.argsort(h)
    f = h[order]
    new = np.diff(f, prepend=~f[:1]) != 0
    pairs = np.flatnonzero(~new)
    bad = pairs[words.unequal(at[order[pairs - 1]], at[order[pairs]], k)]
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(f)))
    found, where = f[first], at[order[first]]
    if len(bad):  # collisions inside a block
        groups = np.unique(np.searchsorted(first, bad, side="right") - 1)
        more: list[tuple[int, int, int]] = []
        for g in groups:
            seen: dict[bytes, list[int]] = {}
            for i in at[order[first[g]:first[g] + counts[g]]].tolist():
                seen.setdefault(words.data[words.start[i]:words.end[i + k - 1]].tobytes(), []).append(i)
            more += [(found[g], same[0], len(same)) for same in seen.values()]
        keep = np.ones(len(found), bool)
        keep[groups] = False
        extra = [np.array(c, t) for c, t in zip(zip(*more, strict=True), (np.uint64, np.int64, np.int64), strict=True)]
        found, where, counts = (np.concatenate([c[keep], x]) for c, x in zip((found, where, counts), extra, strict=True))
    return found, where, counts


def frequent_pairs(words: Words, lang: str, bitmap: np.ndarray) -> np.ndarray:
    """Whether the word pair at each word number may be frequent."""
    out = np.zeros(len(words.start), bool)
    # context words start no phrase of their own but do continue one
    own, words.own = words.own, np.ones(len(words.start), bool)
    (_, at, h), = fingerprints(words, lang, (2,))
    words.own = own
    place = h >> np.uint64(64 - BITS)
    out[at] = (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0
    return out


def give_back() -> None:
    """Free memory that Arrow keeps goes back to the system: workers stay for the next stage, and some wait idle."""
    pa.default_memory_pool().release_unused()


def packed(docs: DataFrame, text_col: str, lang_col: str, block_bytes: int) -> DataFrame:
    """(lang, words, text): normalised texts of a language in blocks, and the number of their words."""
    d = pick(docs, text=text_col, lang=lang_col).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where("text is not null")
    schema = pa.schema([("lang", pa.string()), ("words", pa.int64()), ("text", pa.binary())])

    def block(lang, parts):
        text = b"\n".join(parts)
        return pa.RecordBatch.from_pylist([{"lang": lang, "words": int(Words(text).own.sum()), "text": text}], schema)

    def run(batches):
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                for part in parts_of(text.as_py(), block_bytes):
                    if sizes.get(lang, 0) + len(part) > block_bytes and sizes.get(lang):
                        yield block(lang, held.pop(lang))
                        sizes[lang] = 0
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                if sum(sizes.values()) > 4 * block_bytes:  # many languages: what is held stays bounded
                    most = max(sizes, key=sizes.get)
                    yield block(most, held.pop(most))
                    sizes.pop(most)
        for lang, parts in held.items():
            yield block(lang, parts)
        give_back()

    return d.mapInArrow(run, "lang string, words long, text binary")


MARKS = "fp long, place long, nk long"


def marks_of(blocks: DataFrame, widths: tuple[int, ...], bitmap: np.ndarray | None = None) -> DataFrame:
    """One row for each phrase of a block: fingerprint, pointer (block and first byte), count and words. Three numbers,
    as this is what the shuffle carries."""
    schema = pa.schema([("fp", pa.int64()), ("place", pa.int64()), ("nk", pa.int64())])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                lang, number = b.column("lang")[i].as_py(), b.column("block")[i].as_py()
                words = Words(b.column("text")[i].as_py())
                if not len(words.start):
                    continue
                pairs = None if bitmap is None else frequent_pairs(words, lang, bitmap)
                for k, at, h in fingerprints(words, lang, widths):
                    if pairs is not None:
                        ok = np.ones(len(at), bool)
                        for j in range(k - 1):
                            ok &= pairs[at + j]
                        at, h = at[ok], h[ok]
                    if not len(at):
                        continue
                    f, where, n = rows_of(words, at, h, k)
                    place = words.start[where] | (number << PLACE_BITS)
                    for c in range(0, len(f), 1 << 17):
                        part = slice(c, c + (1 << 17))
                        yield pa.RecordBatch.from_arrays([pa.array(f[part].view(np.int64)), pa.array(place[part]), pa.array(n[part] << 2 | k - 1)], schema=schema)
        give_back()

    return blocks.select("lang", "block", "text").mapInArrow(run, MARKS)


def reaching(marks: DataFrame, least: int) -> DataFrame:
    """The marks of fingerprints whose counts reach ``least`` together."""
    total = F.sum(F.shiftright("nk", 2)).over(Window.partitionBy("fp"))
    return marks.withColumn("total", total).where(F.col("total") >= least).drop("total")


def bitmap_of(marks: DataFrame) -> np.ndarray:
    """The leading bits of the fingerprints of word pairs as a bitmap: 2^BITS bits, whatever their number."""
    place = F.shiftrightunsigned("fp", 64 - BITS)
    rows = marks.where("nk & 3 = 1").select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - BITS}) & 63 as int))").alias("b"))
    found = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out.view(np.uint64)


def phrases_at(marks: DataFrame, blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, lang, phrases, n): the texts under the pointers, cut from their blocks; those of a block that fall into
    one bucket (by a hash of the text) are one row, joined by line breaks, with their counts."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            lang, text, nk = right["lang"][0].as_py(), right["text"][0].as_py(), left["nk"].to_numpy()
            words = Words(text)
            text = text.replace(bytes([CONTEXT]), b" ")
            start = left["place"].to_numpy() & ((1 << PLACE_BITS) - 1)
            end = words.end[np.searchsorted(words.start, start) + (nk & 3)]
            phrases = [text[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]
            bucket = np.fromiter(map(zlib.crc32, phrases), np.int64, len(phrases)) % buckets
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
                some = order[lo:hi]
                rows.append({"bucket": int(bucket[some[0]]), "lang": lang, "phrases": b"\n".join([phrases[i] for i in some.tolist()]), "n": (nk[some] >> 2).tobytes()})
            give_back()
        return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("phrases", pa.binary()), ("n", pa.binary())]))

    # the fingerprint has done its work and stays behind
    marks = marks.select("place", "nk", F.shiftright("place", PLACE_BITS).alias("block"))
    return marks.groupBy("block").cogroup(blocks.select("block", "lang", "text").groupBy("block")).applyInArrow(run, "bucket long, lang string, phrases binary, n binary")


def counted_by_text(packed_phrases: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, k, f): exact counts of the texts of each bucket, those that reach ``least``."""
    def run(table: pa.Table) -> pa.Table:
        found: dict[str, Counter] = {}
        for lang, phrases, n in zip(table["lang"].to_pylist(), table["phrases"], table["n"], strict=True):
            counts = found.setdefault(lang, Counter())
            for phrase, times in zip(phrases.as_py().split(b"\n"), np.frombuffer(n.as_py(), np.int64).tolist(), strict=True):
                counts[phrase] += times
        rows = [(lang, p, p.count(b" ") + 1, f) for lang, counts in found.items() for p, f in counts.items() if f >= least]
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        kinds = {"lang": pa.string(), "phrase": pa.binary(), "k": pa.int32(), "f": pa.int64()}
        return pa.table({name: pa.array(c, t) for (name, t), c in zip(kinds.items(), columns, strict=True)})

    out = packed_phrases.groupBy("bucket").applyInArrow(run, "lang string, phrase binary, k int, f long")
    return out.withColumn("phrase", F.col("phrase").cast("string"))


def frequent_phrases(docs: DataFrame, least: int = 30, text_col="text", lang_col="lang", block_bytes: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f) of all phrases of 1 to 4 words with f >= least, (lang, n) words of a language)."""
    if block_bytes >= 1 << (PLACE_BITS - 1):
        raise ValueError("a place in a block must fit PLACE_BITS")
    row = F.monotonically_increasing_id()  # task << 33 | row of the task
    number = F.shiftleft(F.shiftright(row, 33), ROW_BITS) + (row.bitwiseAND(F.lit((1 << 33) - 1)))
    blocks = packed(docs, text_col, lang_col, block_bytes).withColumn("block", number)
    path = scratch_path(blocks.sparkSession, "collocation-blocks")
    # a row group ends after every block, so that neither writer nor reader holds several
    blocks.write.option("parquet.block.size", block_bytes).option("parquet.page.size.row.check.min", 1).parquet(path)
    blocks = blocks.sparkSession.read.schema(blocks.schema).parquet(path)
    short = stored(reaching(marks_of(blocks, (1, 2)), least), "collocation-marks")
    long = reaching(marks_of(blocks, (3, 4), bitmap_of(short)), least)
    buckets = -(-short.count() // BUCKET_MARKS) or 1
    counts = counted_by_text(phrases_at(short.unionByName(long), blocks, buckets), least)
    return stored(counts, "collocation-phrases"), blocks.groupBy("lang").agg(F.sum("words").alias("n"))


def mine(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000, text_col="text", lang_col="lang", block_bytes: int = BLOCK) -> DataFrame:
    """The first ``top`` phrases of 2 to 4 words of each language: lang, rank, phrase, a, l, r, n, score.

    The score is floor(2000000 a / (l + r)) at the cut that makes it lowest (the first one on ties); a phrase
    inside a longer frequent one that has at least ``share`` percent of its occurrences is dropped. Equal
    scores go by count, then by the bytes of the phrase. Products are decimals of up to 27 digits."""
    counts, sizes = frequent_phrases(docs, least, text_col, lang_col, block_bytes)
    wide = counts.where("k > 1").withColumn("w", F.split("phrase", " "))
    cuts = wide.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("head"),
                       F.expr("array_join(slice(w, cut + 1, size(w) - cut), ' ')").alias("rest"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("cast(a as decimal(19,0)) * cast(2000000 as decimal(7,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low"))
    inside = wide.where("k > 2").select("lang", "f", F.explode(F.expr(
        "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    hidden = F.expr(f"cast(longer as decimal(19,0)) * 100 >= cast(a as decimal(19,0)) * {int(share)}")
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(~F.coalesce(hidden, F.lit(False)))
    w = Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("a").cast("long").alias("a"), F.col("low.l").cast("long").alias("l"),
                                             F.col("low.r").cast("long").alias("r"), F.col("n").cast("long").alias("n"), F.col("low.score").cast("long").alias("score"))
