"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at special strings (one token each, as the tokenizer's library does by
default) and then into pieces by the pre-tokenizer's pattern.  Each distinct
piece is merged once: a heap gives the lowest-ranked, leftmost adjacent pair, a
linked list joins it, and the count is the initial bytes minus the merges.  No
identifiers are emitted.

The vocabulary is a fixed file of about 1.5 MB, read by the driver and broadcast.
Counts of short pieces are kept per Python worker in a bounded dictionary.

Defined results: null and empty texts have 0 tokens; long texts are read piece by
piece; repeated rows are counted each.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pattern of the byte-level pre-tokenizer.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces remembered by a worker, and the longest that is.
CACHE_PIECES = 400_000
CACHE_CHARS = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class MergeCounter(dict):
    """piece -> tokens; a missing piece is merged and remembered."""

    def __init__(self, vocabulary: bytes):
        super().__init__()
        spec = json.loads(vocabulary)
        ids = spec["model"]["vocab"]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a] << 20 | ids[b]] = (rank + 1) << 20 | ids[a + b]
        self.byte_ids = [ids[c] for c in byte_alphabet()]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("|".join(
            regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pieces = regex.compile(BYTE_LEVEL_PATTERN)

    def __missing__(self, piece: str) -> int:
        n = self.merged_length(piece.encode())
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = n
        return n

    def merged_length(self, data: bytes) -> int:
        """Bytes minus merges.  Heap entries and merges are single integers: rank, then
        place (of the pair's left symbol) or token."""
        n = count = len(data)
        if n == 1:
            return 1
        find, byte_ids, shift = self.merges.get, self.byte_ids, n.bit_length()
        symbol = [byte_ids[b] for b in data]
        heap = []
        for i in range(n - 1):
            found = find(symbol[i] << 20 | symbol[i + 1])
            if found:
                heap.append((found >> 20) << shift | i)
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, low = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << shift) - 1
        symbol.append(-1)
        while heap:
            top = heapq.heappop(heap)
            i = top & low
            a, j = symbol[i], after[i]
            if a < 0 or symbol[j] < 0:
                continue
            found = find(a << 20 | symbol[j])
            if found is None or found >> 20 != top >> shift:
                continue
            made = symbol[i] = found & 0xFFFFF
            symbol[j] = -2
            k = after[i] = after[j]
            count -= 1
            if k < n:
                before[k] = i
                found = find(made << 20 | symbol[k])
                if found:
                    heapq.heappush(heap, (found >> 20) << shift | i)
            h = before[i]
            if h >= 0:
                found = find(symbol[h] << 20 | made)
                if found:
                    heapq.heappush(heap, (found >> 20) << shift | h)
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.split_special is None or not self.split_special.search(text):
            return self._plain(text)
        n, at = 0, 0
        for m in self.split_special.finditer(text):
            n += self._plain(text[at:m.start()]) + 1
            at = m.end()
        return n + self._plain(text[at:])

    def _plain(self, text: str) -> int:
        return sum(map(self.__getitem__, pieces_of(self.pieces, text)))


def pieces_of(pattern: regex.Pattern, text: str, whole: int = 1 << 20) -> Iterable[str]:
    """The pieces in order; texts above ``whole`` characters as a stream."""
    return pattern.findall(text) if len(text) <= whole else (m.group() for m in pattern.finditer(text))


_COUNTERS: dict[int, MergeCounter] = {}


def _counter(vocabulary) -> MergeCounter:
    """The worker's counter of this broadcast vocabulary (the latest one only)."""
    if vocabulary.id not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[vocabulary.id] = MergeCounter(vocabulary.value)
    return _COUNTERS[vocabulary.id]


class _Vocabulary:
    """A broadcast file with an id that tells files apart within a worker."""

    def __init__(self, spark, data: bytes):
        self.handle, self.id = spark.sparkContext.broadcast(data), hash(data)

    @property
    def value(self) -> bytes:
        return self.handle.value


def count_tokens(docs: DataFrame, vocabulary_path: str, text_col: str = "text",
                 limit: int = 512) -> DataFrame:
    """``docs`` with ``n_bytes, n_tokens, over_limit``; only the text goes to Python."""
    with open(vocabulary_path, "rb") as f:
        vocabulary = _Vocabulary(docs.sparkSession, f.read())

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = _counter(vocabulary).count
        for batch in texts:
            yield pd.Series([count(t) for t in batch], dtype="int64")

    counted = docs.withColumn("n_bytes", F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"))
    counted = counted.withColumn("n_tokens", tokens(F.col(text_col)))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
