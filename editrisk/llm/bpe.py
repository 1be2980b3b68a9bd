"""Byte-level BPE encoding and decoding by merge replay.

The distinct pieces of many texts are laid out as one row of symbols.  An inverted
index lists, for every merged token, the positions of the pairs that make it.
The merges present are applied in rank order to all their positions at once, and
only the touched neighbours get new entries in the index.  Pieces do not depend
on each other, so every task replays the merges over its own part of the corpus, in
chunks of bounded size, and remembers pieces in a bounded dictionary.

The rank file (under 1 MB) is fixed; the driver reads and broadcasts it.

Defined results: null and empty texts have no ids and decode to nothing; a piece that
is itself in the vocabulary is one token; ids decode to exactly the text's bytes;
repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import count, islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editrisk.llm.common import tidy

#: Distinct pieces remembered by a worker, and pieces of a long text taken together.
CACHE_PIECES = 150_000
STEP_PIECES = 200_000
#: Characters of texts whose pieces are replayed together, and rows returned together.
CHUNK_CHARS = 6_000_000
OUT_ROWS = 256


class MergeReplay:
    """Encoder and decoder for one rank file.

    Distinct pieces are numbered as they come; ``learn`` replays the merges over all new
    ones together, and texts are sequences of piece numbers until then.
    """

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in
                      (line.split() for line in rank_file.splitlines() if line)}
        self.token = {i: t for t, i in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pieces = regex.compile(pattern)
        # every way to make a token of two others, sorted by pair
        made = {}
        for t, i in self.ranks.items():
            for cut in range(1, len(t)):
                a, b = self.ranks.get(t[:cut]), self.ranks.get(t[cut:])
                if a is not None and b is not None:
                    made[a << 32 | b] = i
        self.pair = np.array(sorted(made), np.int64)
        self.product_of = np.array([made[k] for k in self.pair.tolist()], np.int32)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.flat, self.start = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def product(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token each pair makes, or -1 (a negative symbol is in no pair)."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (a >= 0) & (b >= 0), self.product_of[at], np.int32(-1))

    def replay(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int32)
        sizes = np.array([len(w) if t < 0 else 1 for w, t in zip(words, whole.tolist())], np.int64)
        data = np.frombuffer(b"".join(w if t < 0 else b"\0" for w, t in zip(words, whole.tolist())), np.uint8)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        at = np.arange(len(data), dtype=np.int32) + word
        symbol = np.full(len(data) + len(words), -1, np.int32)  # -1 ends each word
        symbol[at] = np.where(whole[word] >= 0, whole[word], self.byte_ids[data])
        after = np.arange(1, len(symbol) + 1, dtype=np.int32)
        before = np.arange(-1, len(symbol) - 1, dtype=np.int32)

        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(made: np.ndarray, places: np.ndarray) -> None:
            use = made >= 0
            made, places = made[use], places[use]
            order = np.argsort(made, kind="stable")
            made, places = made[order], places[order]
            edges = np.flatnonzero(made[1:] != made[:-1]) + 1
            firsts = [0, *edges.tolist()] if len(made) else []
            for token, lo, hi in zip(made[firsts].tolist(), firsts, [*firsts[1:], len(made)]):
                if token in index:
                    index[token].append(places[lo:hi])
                else:
                    index[token] = [places[lo:hi]]
                    heapq.heappush(queue, token)

        if len(symbol):
            enter(self.product(symbol[:-1], symbol[1:]), np.arange(len(symbol) - 1, dtype=np.int32))
        while queue:
            token = heapq.heappop(queue)
            found = index.pop(token)
            p = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            p = p[symbol[p] >= 0]
            p = p[self.product(symbol[p], symbol[after[p]]) == token]
            if not len(p):
                continue
            j = after[p]
            chained = j[:-1] == p[1:]
            if chained.any():  # overlapping pairs: of each run every other one, from the left
                place = np.arange(len(p))
                run = np.maximum.accumulate(np.where(np.append(False, chained), 0, place))
                p = p[(place - run) % 2 == 0]
                j = after[p]
            symbol[p], symbol[j] = token, -2
            k = after[p] = after[j]
            before[k] = p
            h = before[p]
            enter(np.concatenate([self.product(symbol[h], symbol[p]), self.product(symbol[p], symbol[k])]),
                  np.concatenate([h, p]))
        kept = symbol[at] >= 0
        return symbol[at][kept], np.bincount(word[kept], minlength=len(words))

    def learn(self) -> None:
        """Replay the merges over the numbered pieces that have no ids yet."""
        new = list(islice(self.number, len(self.start) - 1, None))
        if new:
            ids, sizes = self.replay([p.encode() for p in new])
            self.flat = np.concatenate([self.flat, ids.astype("<u4")])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])

    def numbers(self, pieces: Iterable[str]) -> np.ndarray:
        return np.array(list(map(self.number.__getitem__, pieces)), np.int32)

    def ids(self, numbers: np.ndarray) -> bytes:
        """Packed ids of a text given by its pieces' numbers."""
        size = self.start[numbers + 1] - self.start[numbers]
        ends = np.cumsum(size)
        place = np.repeat(self.start[numbers] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[place].tobytes()

    def encode(self, texts: Iterable[str | None], chunk_chars: int = CHUNK_CHARS) -> Iterator[bytes]:
        """Packed ids of each text; the merges are replayed over chunks of texts."""
        parts: list[np.ndarray | bytes] = []
        size = 0
        for t in texts:
            t = t or ""
            if size + len(t) > chunk_chars:
                yield from self._finish(parts)
                parts, size = [], 0
            size += len(t)
            if len(t) <= STEP_PIECES:
                parts.append(self.numbers(self.pieces.findall(t)))
            else:
                parts.append(self._encode_long(t, parts))
        yield from self._finish(parts)

    def _finish(self, parts: list[np.ndarray | bytes]) -> Iterator[bytes]:
        self.learn()
        for x in parts:
            yield x if isinstance(x, bytes) else self.ids(x)
        if len(self.number) > CACHE_PIECES:
            self.forget()

    def _encode_long(self, text: str, parts: list[np.ndarray | bytes]) -> bytes:
        """A long text by steps, after what was numbered so far has its ids."""
        found, out = (m.group() for m in self.pieces.finditer(text)), []
        while step := list(islice(found, STEP_PIECES)):
            if len(self.number) > CACHE_PIECES:
                self.learn()
                parts[:] = [x if isinstance(x, bytes) else self.ids(x) for x in parts]
                self.forget()
            numbers = self.numbers(step)
            self.learn()
            out.append(self.ids(numbers))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_CODECS: dict[int, MergeReplay] = {}


def _codec(key: int, handle, pattern: str) -> MergeReplay:
    """The worker's codec of this rank file (the latest one only)."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = MergeReplay(handle.value, pattern)
    return _CODECS[key]


def _coder(docs: DataFrame, ranks_path: str, pattern: str):
    with open(ranks_path, "rb") as f:
        data = f.read()
    handle, key = docs.sparkSession.sparkContext.broadcast(data), hash((data, pattern))
    return lambda: _codec(key, handle, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text",
           out: str = "ids") -> DataFrame:
    """``docs`` with the packed ids (binary, four bytes each) of every text."""
    coder = _coder(docs, ranks_path, pattern)

    @F.pandas_udf("binary")
    @tidy
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = coder()
        coded = codec.encode(t for batch in texts for t in batch)
        while rows := list(islice(coded, OUT_ROWS)):
            yield pd.Series(rows, dtype=object)
        codec.forget()

    return docs.withColumn(out, ids(F.col(text_col)))


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids",
           out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that packed ids stand for (null: empty)."""
    coder = _coder(docs, ranks_path, pattern)

    @F.pandas_udf("binary")
    def data(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in ids:
            yield pd.Series([coder().decode(x or b"") for x in batch], dtype=object)

    return docs.withColumn(out, data(F.col(ids_col)))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text",
               keep_ids: bool = False, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``docs`` with ``n_tokens, ids_sha256, decoded_sha256`` and, with ``keep_ids``, the packed
    ``ids``: encoded and decoded in one pass, by one Python worker per task.  Smaller chunks
    (any size gives the same ids) take less memory and more time."""
    coder = _coder(docs, ranks_path, pattern)
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
    @tidy
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = coder()
        coded = codec.encode((t for batch in texts for t in batch), chunk_chars)  # chunks span batches
        while rows := [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(codec.decode(x)).hexdigest(),
                        *[x] * keep_ids) for x in islice(coded, OUT_ROWS)]:
            yield pd.DataFrame(rows, columns=names)
        codec.forget()

    out = docs.withColumn("__coded", digests(F.col(text_col)))
    return out.withColumns({c: F.col(f"__coded.{c}") for c in names}).drop("__coded")
