"""Word-level BPE encoding and decoding: speculate, verify, merge only what fails.

A text is cut at special strings, normalised (NFC, lower case) and cut into words by the
pre-tokenizer's pattern; the last byte of a word carries the end-of-word mark.  For the
distinct words of many texts at once

* greedy longest matches over a trie propose tokens (the longest match is looked up for all
  positions of all words together, one trie level at a time),
* every adjacent pair of proposed tokens is checked: undoing the merges along the seam,
  latest first, no merge across the seam may come before the next one to be undone.  If no
  pair fails, the proposal is what merging by rank gives,
* only words with a failing pair are merged by rank, exactly.

The check needs merges whose parts have lower ranks and tokens made by one merge each;
vocabularies of another kind are merged exactly throughout.  Tokens that merging can never
give are not proposed.

The vocabulary is a fixed file of about 2 MB, read by the driver and broadcast.  Words are
remembered per Python worker in a bounded table; texts go through in chunks.

Letters are those of the ``regex`` module's Unicode tables, which are newer than the
library's: a text may differ where it has letters that Unicode added after them.

Defined results: null and empty texts have no ids and decode to the empty text; a special
string inside a text is its token, as the tokenizer's library has it by default; decoding
joins token strings by a space (the file names no decoder); repeated rows are encoded
each; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editrisk.llm.tokencount import byte_alphabet

# The pre-tokenizer's pattern, and the same for lower-case ASCII texts.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"
END = "</w>"

#: Words remembered by a worker, words numbered at once, and characters of texts taken together.
CACHE_WORDS = 400_000
STEP_WORDS = 200_000
CHUNK_CHARS = 2_000_000
#: Failing words above this many bytes are merged one by one with a heap.
LONG_WORD = 200

_NEVER = np.int64(1) << 60


class WordCodec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        ids: dict[str, int] = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.split_special = re.compile("|".join(
            re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.words, self.ascii_words = regex.compile(WORD_PATTERN), re.compile(ASCII_PATTERN, re.ASCII)
        self.text_of = {i: t.encode() for t, i in (ids | special).items()}

        # symbols 0..255 are bytes inside a word, 256..511 the last byte of one
        alphabet = byte_alphabet()
        self.base = np.array([ids[c] for c in alphabet] + [ids[c + END] for c in alphabet], np.int64)
        places = max(ids.values()) + 1
        self.rank = np.full(places, -1, np.int64)
        self.left, self.right = np.zeros(places, np.int64), np.zeros(places, np.int64)
        self.made: dict[int, tuple[int, int]] = {}
        proper = True
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, t = ids[a], ids[b], ids[a + b]
            proper &= self.rank[t] < 0 and max(self.rank[x], self.rank[y]) < rank
            self.made.setdefault(x << 32 | y, (rank, t))
            self.rank[t], self.left[t], self.right[t] = rank, x, y
        self.proper = proper and not (self.rank[self.base] >= 0).any()
        self.pair = np.array(sorted(self.made), np.int64)
        self.pair_rank = np.array([self.made[k][0] for k in self.pair.tolist()], np.int64)
        self.product = np.zeros(len(spec["model"]["merges"]), np.int64)
        for rank, t in self.made.values():
            self.product[rank] = t
        if self.proper:
            self._grow_trie({c: i for i, c in enumerate(alphabet)}, ids)
        self.forget()

    def _grow_trie(self, byte_of: dict[str, int], ids: dict[str, int]) -> None:
        """Trie over the symbols of all tokens that merging can give."""
        made = np.argsort(self.rank, kind="stable")
        made = made[self.rank[made] >= 0]
        fits = self.compatible(self.left[made], self.right[made], 2 * self.rank[made])
        valid = self.rank < 0
        for t, ok in zip(made.tolist(), fits.tolist()):
            valid[t] = ok and valid[self.left[t]] and valid[self.right[t]]
        child: dict[int, int] = {}
        token = [-1]
        base = set(self.base.tolist())
        for text, t in ids.items():
            if not valid[t] or (self.rank[t] < 0 and t not in base):
                continue
            ends = text.endswith(END)
            symbols = [byte_of[c] for c in (text[:-len(END)] if ends else text)]
            if ends:
                symbols[-1] += 256
            node = 0
            for s in symbols:
                key = node << 9 | s
                if key not in child:
                    child[key] = len(token)
                    token.append(-1)
                node = child[key]
            token[node] = t
        self.child_key = np.array(sorted(child), np.int64)
        self.child = np.array([child[k] for k in self.child_key.tolist()], np.int64)
        self.node_token = np.array(token, np.int64)

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.flat, self.start = np.empty(0, "<u4"), np.zeros(1, np.int64)

    # ------------------------------------------------------------ tokens of new words

    def compatible(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the joined texts of each pair leaves the seam alone.

        Twice the rank of the merge undone last is the limit (plus one on the right side,
        since of equal ranks the leftmost merge comes first)."""
        good = np.ones(len(x), bool)
        at = np.arange(len(x))
        limit = np.full(len(x), _NEVER) if limit is None else limit
        while len(at):
            key = x << 32 | y
            place = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            crossing = (self.pair[place] == key) & (2 * self.pair_rank[place] < limit)
            good[at[crossing]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossing & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            undo_y = ry >= rx
            limit = np.where(undo_y, 2 * ry + 1, 2 * rx)
            x, y = np.where(undo_y, x, self.right[x]), np.where(undo_y, self.left[y], y)
        return good

    def longest_matches(self, symbol: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest token (and its symbols) at every position; ``room`` symbols are left there."""
        token, length = np.full(len(symbol), -1, np.int64), np.zeros(len(symbol), np.int64)
        at, node, depth = np.arange(len(symbol)), np.zeros(len(symbol), np.int64), 0
        while len(at):
            key = node << 9 | symbol[at + depth]
            place = np.minimum(np.searchsorted(self.child_key, key), len(self.child_key) - 1)
            hit = self.child_key[place] == key
            at, node, depth = at[hit], self.child[place[hit]], depth + 1
            found = self.node_token[node]
            ends = found >= 0
            token[at[ends]], length[at[ends]] = found[ends], depth
            more = room[at] > depth
            at, node = at[more], node[more]
        return token, length

    def merge(self, symbols: list[int]) -> list[int]:
        """Merging by rank, leftmost first: a heap of pairs over a linked list."""
        n, made = len(symbols), self.made
        ids = self.base[symbols].tolist() + [-1]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(made[k][0], i) for i in range(n - 1) if (k := ids[i] << 32 | ids[i + 1]) in made]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            found = made.get(ids[i] << 32 | ids[j])
            if found is None or found[0] != rank:
                continue
            ids[i], ids[j] = found[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (f := made.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (f[0], i))
            h = before[i]
            if h >= 0 and (f := made.get(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (f[0], h))
        return [t for t in ids[:n] if t >= 0]

    def merge_all(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` for many words at once: a round joins every word's lowest-ranked, leftmost
        pair; finished words leave.  Ids one after the other, and how many each word has."""
        ids, word = self.base[symbols], np.repeat(np.arange(len(sizes)), sizes)

        def ranks(i: np.ndarray) -> np.ndarray:
            """Rank of the pair that starts at each place."""
            j = np.minimum(i + 1, len(ids) - 1)
            key = ids[i] << 32 | ids[j]
            place = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            return np.where((self.pair[place] == key) & (word[i] == word[j]) & (j > i), self.pair_rank[place], _NEVER >> 32)

        rank = ranks(np.arange(len(ids)))
        done_ids, done_word = [ids[:0]], [word[:0]]
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), first)
            joined = best < _NEVER >> 32 << 32
            at = best[joined] & 0xFFFFFFFF
            ids[at] = self.product[rank[at]]
            keep = np.repeat(joined, np.diff(np.append(first, len(ids))))
            done_ids.append(ids[~keep])
            done_word.append(word[~keep])
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            ids, word, rank, at = ids[keep], word[keep], rank[keep], place[at]
            if len(at):
                rank[at] = ranks(at)
                before = at[at > 0] - 1
                rank[before] = ranks(before)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(sizes))

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all (non-empty) words one after the other, and how many each has."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbol = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        symbol[ends - 1] += 256
        if not self.proper:
            exact = [self.merge(symbol[e - s:e].tolist()) for e, s in zip(ends.tolist(), sizes.tolist())]
            return np.array([t for w in exact for t in w], "<u4"), np.array(list(map(len, exact)), np.int64)
        token, length = self.longest_matches(symbol, np.repeat(ends, sizes) - np.arange(len(symbol)))
        # the greedy path through every word
        on_path = np.zeros(len(symbol), bool)
        at, end = ends - sizes, ends
        while len(at):
            on_path[at] = True
            at = at + length[at]
            inside = at < end
            at, end = at[inside], end[inside]
        word = np.repeat(np.arange(len(words)), sizes)[on_path]
        proposed = token[on_path]
        seam = np.flatnonzero(word[1:] == word[:-1])
        failing = seam[~self.compatible(proposed[seam], proposed[seam + 1])]
        n = np.bincount(word, minlength=len(words))
        failed = np.unique(word[failing])
        # long words by the heap, the others together
        long = {w: self.merge(symbol[ends[w] - sizes[w]:ends[w]].tolist())
                for w in failed[sizes[failed] > LONG_WORD].tolist()}
        short = np.zeros(len(words), bool)
        short[failed[sizes[failed] <= LONG_WORD]] = True
        merged, m = self.merge_all(symbol[np.repeat(short, sizes)], sizes[short])
        good = np.ones(len(words), bool)
        good[failed] = False
        n[short] = m
        n[list(long)] = list(map(len, long.values()))
        out = np.empty(n.sum(), "<u4")
        out[np.repeat(good, n)] = proposed[good[word]]
        out[np.repeat(short, n)] = merged
        begin = np.cumsum(n) - n
        for w, exact in long.items():
            out[begin[w]:begin[w] + n[w]] = exact
        return out, n

    # ------------------------------------------------------------ texts

    def normalise(self, text: str) -> str:
        """NFC and lower case, character by character (no final sigma)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def pieces(self, text: str) -> Iterator[Iterable[str]]:
        """The words and special strings of a text, in order."""
        at = 0
        for m in self.split_special.finditer(text) if self.split_special and "<" in text else ():
            yield self._words(text[at:m.start()])
            yield (m.group(),)
            at = m.end()
        yield self._words(text[at:] if at else text)

    def _words(self, text: str) -> Iterable[str]:
        text = self.normalise(text)
        find = self.ascii_words if text.isascii() else self.words
        return find.findall(text) if len(text) <= CHUNK_CHARS else (m.group() for m in find.finditer(text))

    def learn(self) -> None:
        """Tokens of the numbered words that have none yet."""
        new = list(islice(self.number, len(self.start) - 1, None))
        if not new:
            return
        special = {i: self.special[w] for i, w in enumerate(new) if w in self.special}
        ids, sizes = self.tokens([b"-" if i in special else w.encode() for i, w in enumerate(new)])
        begin = self.start[-1] + np.cumsum(sizes) - sizes
        self.start = np.concatenate([self.start, begin + sizes])
        self.flat = np.concatenate([self.flat, ids])
        for i, t in special.items():  # "-" is one token, too
            self.flat[begin[i]] = t

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        size = self.start[numbers + 1] - self.start[numbers]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[numbers] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; words are learned for chunks of texts together."""
        waiting: list[np.ndarray] = []
        size = 0
        for text in texts:
            text = text or ""
            if waiting and size + len(text) > CHUNK_CHARS:
                yield from self._finish(waiting)
                waiting, size = [], 0
            if len(text) > CHUNK_CHARS:
                yield self._encode_long(text)
                continue
            size += len(text)
            waiting.append(np.array([self.number[w] for words in self.pieces(text) for w in words], np.int64))
        yield from self._finish(waiting)

    def _finish(self, waiting: list[np.ndarray]) -> Iterator[np.ndarray]:
        self.learn()
        for numbers in waiting:
            yield self.ids(numbers)
        if len(self.number) > CACHE_WORDS:
            self.forget()

    def _encode_long(self, text: str) -> np.ndarray:
        words = (w for found in self.pieces(text) for w in found)
        out = []
        while step := list(islice(words, STEP_WORDS)):
            if len(self.number) > CACHE_WORDS:
                self.forget()
            numbers = np.array([self.number[w] for w in step], np.int64)
            self.learn()
            out.append(self.ids(numbers))
        return np.concatenate(out) if out else np.empty(0, "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text: the tokens' strings joined by a space."""
        return b" ".join(map(self.text_of.__getitem__, ids.tolist()))


_CODECS: dict[int, WordCodec] = {}


def _coder(docs: DataFrame, vocabulary_path: str):
    """How a worker gets its codec of this file (the latest one only is kept)."""
    with open(vocabulary_path, "rb") as f:
        data = f.read()
    handle, key = docs.sparkSession.sparkContext.broadcast(data), hash(data)

    def codec() -> WordCodec:
        if key not in _CODECS:
            _CODECS.clear()
            _CODECS[key] = WordCodec(handle.value)
        return _CODECS[key]

    return codec


def encode(docs: DataFrame, vocabulary_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the packed ids (binary, four bytes each) of every text."""
    coder = _coder(docs, vocabulary_path)

    @F.pandas_udf("binary")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = coder()
        for batch in texts:
            yield pd.Series([x.tobytes() for x in codec.encode(batch)], dtype=object)

    return docs.withColumn(out, ids(F.col(text_col)))


def decode(docs: DataFrame, vocabulary_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text that packed ids stand for (null: empty)."""
    coder = _coder(docs, vocabulary_path)

    @F.pandas_udf("string")
    def text(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = coder()
        for batch in ids:
            yield pd.Series([codec.decode(np.frombuffer(x or b"", "<u4")).decode() for x in batch], dtype=object)

    return docs.withColumn(out, text(F.col(ids_col)))


def round_trip(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens, ids_sha256, decoded_sha256``; only digests leave the worker."""
    coder = _coder(docs, vocabulary_path)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = coder()
        for batch in texts:
            rows = [(len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(codec.decode(x)).hexdigest())
                    for x in codec.encode(batch)]
            yield pd.DataFrame(rows, columns=names)

    coded = docs.withColumn("__coded", digests(F.col(text_col)))
    return coded.withColumns({c: F.col(f"__coded.{c}") for c in names}).drop("__coded")
