"""BPE encoding by backtracking over longest token matches, decoding by an offset table.

An Aho-Corasick automaton over the vocabulary proposes the longest tokens of a word from left
to right. Two neighbouring tokens are what the merges would produce exactly if undoing the later
of the two's merges, step by step, never shows a pair that would have merged earlier (the
pair-compatibility table, filled as pairs are met). When a pair fails, the encoder falls back to
the next shorter token, and at a dead end to the token before; positions known to be dead are
never entered twice and a search sees no more of the word than the longest token, so a word takes linear time and no merge loop runs.

Words repeat, so each Python worker keeps a bounded table of the words it has met. Documents are
split among tasks by Spark and never shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import Sealed, named, pick

WORD_TABLE = 300_000  # words a worker keeps, and their letters; it starts anew beyond that
WORD_LETTERS = 4_000_000
ROWS = 256  # rows whose tokens are held at a time
PAIR_TABLE = 1_000_000

# The word pattern in its general form, and the same restricted to Latin-1.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
GENERAL = regex.compile(CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
LATIN_LETTERS, LATIN_NUMBERS, LATIN_SPACES = "a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9²³¹¼½¾", " \t-\r\x85\xa0"
LATIN = re.compile(f"{CONTRACTIONS}|[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|[^{LATIN_LETTERS}{LATIN_NUMBERS}{LATIN_SPACES}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if
    printable in Latin-1, else the next free one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordTable(dict):
    """word -> token ids, computed on first use; emptied when it holds too many words or letters."""

    def __init__(self, encode, most, letters):
        super().__init__()
        self.encode, self.most, self.letters, self.held = encode, most, letters, 0

    def __missing__(self, word):
        if len(self) >= self.most or self.held + len(word) > self.letters:
            self.clear()
            self.held = 0
        self.held += len(word)
        ids = self[word] = self.encode(word)
        return ids


class WordBpe:
    """Tokenizer file with byte-level symbols, a word-end suffix and lower-cased NFC text."""

    END = "\ue000"  # stands for the suffix: one symbol, so that words are matched as written

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.special_at = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        names = {i: t for t, i in (vocab | special).items()}
        size = max(names) + 1
        self.to_symbols = {b: s for b, s in enumerate(byte_symbols())}
        plain = lambda t: t[:-len(suffix)] + self.END if t.endswith(suffix) else t
        self.left, self.right, self.merged = list(range(size)), list(range(size)), {}
        for a, b in model["merges"]:
            i = vocab[a + b]
            self.left[i], self.right[i] = vocab[a], vocab[b]
            self.merged[vocab[a] << 20 | vocab[b]] = i
        ids = {plain(t): i for t, i in vocab.items()}
        self.length = [0] * size
        self.shorter: list[int | None] = [None] * size
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            self.length[i] = len(t)
            self.shorter[i] = next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), None)
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.widest = max(self.length)
        # decoding: every token followed by a space, one after the other, and where each starts
        blobs = [names.get(i, "").encode() + b" " for i in range(size)]
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.offset = np.concatenate(([0], np.cumsum([len(b) for b in blobs])))
        self.text_of = [str(i) for i in range(size)]
        self.pairs: dict[int, bool] = {}
        self.words = WordTable(self.encode_word, WORD_TABLE, WORD_LETTERS)

    def compatible(self, a: int, b: int) -> bool:
        """Do the merges leave ``a`` and ``b`` side by side?"""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIR_TABLE:
                self.pairs.clear()
            known = self.pairs[key] = self._stays_apart(a, b)
        return known

    def _stays_apart(self, a: int, b: int) -> bool:
        before = len(self.left)
        while True:
            m = self.merged.get(a << 20 | b)
            if m is not None and m < before:
                return False
            # undo the later merge of the two; a base symbol has none
            a_base, b_base = self.right[a] == a, self.left[b] == b
            if a_base and b_base:
                return True
            if b_base or (not a_base and a > b):
                before, a = a, self.right[a]
            else:
                before, b = b + 1, self.left[b]

    def encode_word(self, word: str) -> tuple[int, ...]:
        text = "".join(map(self.to_symbols.__getitem__, word.encode("utf-8", "surrogatepass"))) + self.END
        n, longest, compatible = len(text), self.automaton.iter_long, self.compatible
        greedy = [t for _, t in longest(text)]
        if sum(map(self.length.__getitem__, greedy)) == n and all(map(compatible, greedy, greedy[1:])):
            return tuple(greedy)
        out, pos, dead = [], 0, bytearray(n + 1)
        # a search sees as much of the word as the longest token takes, so that a step costs the same in any word
        at = lambda i: next(longest(text[i:i + self.widest]), (0, None))[1]
        token = at(0)
        while pos < n:
            while token is not None and (dead[pos + self.length[token]] or (out and not compatible(out[-1], token))):
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                pos += self.length[token]
                token = at(pos) if pos < n - 1 else None
            else:
                dead[pos] = 1
                token = out.pop()
                pos -= self.length[token]
        return tuple(out)

    def word_list(self, piece: str) -> list[str]:
        """Normalised words of a piece without special tokens."""
        try:
            piece.encode("latin-1")
            return LATIN.findall(piece.lower())
        except UnicodeEncodeError:
            # lower case character by character: a final sigma isn't told apart
            return GENERAL.findall(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())

    def encode(self, text: str | None) -> list[int]:
        text = text or ""
        if self.special_at is None or "<" not in text or not self.special_at.search(text):
            return list(chain.from_iterable(map(self.words.__getitem__, self.word_list(text))))
        out, at = [], 0
        for m in chain(self.special_at.finditer(text), (None,)):
            words = self.word_list(text[at:m.start() if m else None])
            out.extend(chain.from_iterable(map(self.words.__getitem__, words)))
            if m:
                out.append(self.special[m.group()])
                at = m.end()
        return out

    def decode_bytes(self, ids) -> bytes:
        """Token texts joined by spaces (no decoder in the file), by one gather per document."""
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return b""
        start, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        shift = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        return self.blob[shift + np.arange(len(shift))].tobytes()[:-1]

    def ids_text(self, ids) -> str:
        return " ".join(map(self.text_of.__getitem__, ids))


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """The tokenizer of a file, once per process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def _mapped(df: DataFrame, column: str, fields: list[tuple[str, str, pa.DataType]], compute) -> DataFrame:
    """``df`` without ``column``, with new fields computed from each of its values."""
    kept = [c for c in df.columns if c != column]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part, out = b.slice(i, ROWS), [[] for _ in fields]
                for v in part.column(column).to_pylist():
                    for o, x in zip(out, compute(v), strict=True):
                        o.append(x)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(o, t) for o, (_, _, t) in zip(out, fields, strict=True))],
                                                 [*kept, *(n for n, _, _ in fields)])

    schema = df.select(*[named(c) for c in kept], *[F.lit(None).cast(t).alias(n) for n, t, _ in fields]).schema
    return df.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str, text_col="text", decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of token ids) in place of the text and, if asked for, ``decoded``:
    what ``decode_documents`` makes of the ids, in the same pass. Null and empty texts give
    no tokens; very long texts are encoded whole; all other columns stay, but one named ``ids``
    gives way."""
    sealed = Sealed(docs)
    text = sealed.column(text_col)
    fields = [("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())][:1 + decoded]

    def coded(value):
        t = loaded(path)
        ids = t.encode(value)
        return (ids, t.decode_bytes(ids).decode("utf-8")) if decoded else (ids,)
    return sealed.open(_mapped(sealed.df, text, fields, coded), *[n for n, _, _ in fields], without=(text,))


def decode_documents(tokens: DataFrame, path: str, ids_col="ids") -> DataFrame:
    """``tokens`` with ``decoded`` text in place of the ids; null ids give an empty text."""
    sealed = Sealed(tokens)
    ids = sealed.column(ids_col)
    return sealed.open(_mapped(sealed.df, ids, [("decoded", "string", pa.string())],
                               lambda v: (loaded(path).decode_bytes(v if v is not None else []).decode("utf-8"),)), "decoded", without=(ids,))


def token_digests(docs: DataFrame, path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (of the
    decoded text). Repeated rows and null ids are returned as they come; no rows give no rows."""
    def digests(text):
        t = loaded(path)
        ids = t.encode(text)
        return len(ids), hashlib.sha256(t.ids_text(ids).encode()).hexdigest(), hashlib.sha256(t.decode_bytes(ids)).hexdigest()

    return _mapped(pick(docs, **{id_col: id_col, "_text": text_col}), "_text",
                   [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())], digests)
