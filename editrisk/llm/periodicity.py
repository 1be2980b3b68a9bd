"""Periodic runs in texts: an online sparse dynamic programme over diagonals.

Words are read in order.  A lag q is an active diagonal while the word equals the one q
words before; a word that breaks it ends it, and a diagonal whose stretch (the matches and
the q words before them) is long enough is a run, emitted at once.  Several lags may end with
the same stretch; the least one is the stretch's smallest period.

Diagonals are opened by earlier occurrences.  A run of period q has at least
``max(q, least - q)`` matches, so a word's earlier occurrences are looked up by the gram that
ends at it: 6 words for lags below 48, 48 words for lags below 384, and so on, which keeps
occurrences few (the programme is sparse) and loses no run.  A diagonal met late gets its first
match by walking back.  Inside an established run of period p (its stretch has 2p words and a
gram more) only lags below p are looked up: a longer lag whose looked-up matches all lie in it
would make the whole stretch p-periodic.  The word after a run is looked up in full.  So a
text that is one long repetition costs a few steps a word.

Grams get exact numbers (pairs of numbers are numbered anew), never only hashes.  Texts
without a gram that repeats at a fitting lag, most of them, are recognised for many texts
at once by sorting gram hashes (equal grams have equal hashes) and have no run.

Defined results: null, empty and word-less texts have no words and no run; a null id leaves
the words as they are; repeated rows are reported each; an empty table gives an empty
result; other columns may have any name.  A text's words are held in one task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least words of a run's stretch (an integer of at least 2 * GRAM words).
LEAST = 12
#: Words of the shortest gram, and the factor from one gram to the next.
GRAM, FACTOR = 6, 8
#: Bytes of texts taken together.
CHUNK_BYTES = 4 << 20

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def levels(n: int) -> list[tuple[int, int, int]]:
    """``gram, least lag, lag limit`` of every level that ``n`` words can use."""
    out, gram = [(GRAM, 1, GRAM * FACTOR)], GRAM * FACTOR
    while 2 * gram <= n:
        out.append((gram, gram, gram * FACTOR))
        gram *= FACTOR
    return out


def repetitive(words: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Which texts may have a run: a gram of a level comes again at a lag of that level.

    ``words`` are word numbers of many texts one after the other, ``text`` each one's text.
    """
    found = np.zeros(texts, bool)
    seed = (words.astype(_U) + _U(1)) * _ODD ^ (text.astype(_U) + _U(1)) * _U(0xC2B2AE3D27D4EB4F)
    seed ^= seed >> _U(29)
    for gram, limit in ((GRAM, GRAM * FACTOR), (GRAM * FACTOR, len(words))):
        n = len(words) - gram + 1
        if n < 2:
            break
        sums = np.zeros(n, _U)
        for k in range(gram):
            sums = sums * _ODD + seed[k:k + n]
        order = np.argsort(sums, kind="stable")
        again = (sums[order][1:] == sums[order][:-1]) & (np.diff(order) < limit)
        found[text[order[1:][again]]] = True
    return found


def gram_numbers(words: np.ndarray, gram: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """Exact numbers of the grams by the place of their first word, made from shorter ones."""
    if gram not in known:
        half = gram // 2 if gram % 2 == 0 else gram - 1
        a, b = gram_numbers(words, half, known), gram_numbers(words, gram - half, known)
        n = len(words) - gram + 1
        pair = a[:n].astype(np.int64) * (int(b.max(initial=0)) + 1) + b[half:half + n]
        known[gram] = np.unique(pair, return_inverse=True)[1]
    return known[gram]


def earlier(words: np.ndarray, gram: int, known: dict[int, np.ndarray]) -> list[int]:
    """For every word the last earlier place where the gram that ends there ends, or -1."""
    names = gram_numbers(words, gram, known)
    order = np.argsort(names, kind="stable")
    same = names[order][1:] == names[order][:-1]
    last = np.full(len(words), -1, np.int64)
    last[order[1:][same] + gram - 1] = order[:-1][same] + gram - 1
    return last.tolist()


def find_runs(words: Sequence[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run, by start, then period.

    A run is a stretch with smallest period q, of at least ``max(least, 2q)`` words, that no
    neighbouring word extends.  ``least`` is at least twice ``GRAM``."""
    n = len(words)
    if n < least:
        return []
    codes = np.asarray(words, np.int64)
    known = {1: np.unique(codes, return_inverse=True)[1]}
    w = known[1].tolist()
    plan = [(gram, low, limit, earlier(codes, gram, known)) for gram, low, limit in levels(n)]
    active: dict[int, int] = {}  # lag -> first match
    runs: list[tuple[int, int, int]] = []

    def end(lags: list[int], i: int) -> bool:
        """Emit what is long enough of the lags broken at ``i``."""
        best: dict[int, int] = {}
        for q in lags:
            start = active.pop(q) - q
            if i - start >= max(least, 2 * q) and q < best.get(start, n):
                best[start] = q
        runs.extend((start, i - start, q) for start, q in best.items())
        return bool(best)

    for i in range(n):
        ended = False
        if active:
            x = w[i]
            broken = [q for q in active if w[i - q] != x]
            if broken:
                ended = end(broken, i)
        for gram, low, limit, last in plan:
            j = last[i]
            if j < 0 or i - j >= limit:
                continue
            if active and not ended:
                for q in active:
                    if q < limit and i >= active[q] + q + gram:
                        limit = q
            while j >= 0 and (q := i - j) < limit:
                if q >= low and q not in active:
                    first = i - gram + 1
                    while first > q and w[first - 1] == w[first - 1 - q]:
                        first -= 1
                    active[q] = first
                j = last[j]
    end(list(active), n)
    return sorted((start, length, q) for start, length, q in runs)


def repeat_words(n: int, key: int, one_in: int) -> np.ndarray | None:
    """Places of the words that a text made periodic has, or None where it is left as it is."""
    if key % one_in or not n:
        return None
    g = key // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def describe(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The columns of ``run_report`` but the id."""
    start = length = period = exponent = None
    collapsed = words
    if runs:
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]))
        exponent = 1000 * length // period
        steps = np.zeros(len(words) + 1, np.int64)
        for s, size, q in runs:
            steps[s + q] += 1
            steps[s + size] -= 1
        collapsed = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()
    return (len(runs), start, length, period, exponent, hashlib.sha256(lines).hexdigest(),
            hashlib.sha256(b" ".join(collapsed)).hexdigest())


def texts_runs(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several texts, given as words."""
    sizes = np.array(list(map(len, texts)), np.int64)
    flat = pa.array([x for words in texts for x in words], pa.large_binary()).dictionary_encode()
    codes = flat.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    begin = np.cumsum(sizes) - sizes
    may = repetitive(codes, text, len(texts)) if len(codes) else np.zeros(len(texts), bool)
    return [find_runs(codes[b:b + n], least) if m else []
            for b, n, m in zip(begin.tolist(), sizes.tolist(), may.tolist())]


def _chunks(batches: Iterator[pa.RecordBatch], repeat_one_in: int | None) -> Iterator[tuple[list, list]]:
    """Ids and words of some texts at a time."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for key, text in zip(batch.column("id"), batch.column("text")):
            data = (text.as_py() or "").encode()
            words = data.split()  # ASCII space and tab to return
            key = key.as_py()
            if repeat_one_in and key is not None:
                place = repeat_words(len(words), zlib.crc32(str(key).encode()), repeat_one_in)
                words = words if place is None else [words[i] for i in place.tolist()]
            ids.append(key)
            texts.append(words)
            size += len(data)
            if size >= CHUNK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
               repeat_one_in: int | None = None) -> DataFrame:
    """Per document: id, ``n_runs``, ``start, length, period, exponent_milli`` of its longest run
    (ties: smallest start, then period), digests of the runs and of the text without repeats.

    A word is a repeat if a run contains it after the run's first period.  With
    ``repeat_one_in`` the documents whose id's crc32 it divides are made periodic first.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", narrow.schema["id"].dataType)] + [
        T.StructField(c, T.LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")] + [
        T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches, repeat_one_in):
            rows = [describe(words, runs) for words, runs in zip(texts, texts_runs(texts, least))]
            yield pa.RecordBatch.from_pydict(
                {"id": ids, **dict(zip(schema.names[1:], map(list, zip(*rows))))}, schema=to_arrow_schema(schema))

    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def find_periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       least: int = LEAST) -> DataFrame:
    """One row per run: id, ``start, length, period`` (word numbers from 0)."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", narrow.schema["id"].dataType)] + [
        T.StructField(c, T.LongType()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches, None):
            rows = [(key, *r) for key, runs in zip(ids, texts_runs(texts, least)) for r in runs]
            if rows:
                yield pa.RecordBatch.from_pydict(
                    dict(zip(schema.names, map(list, zip(*rows)))), schema=to_arrow_schema(schema))

    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def to_arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema as convert
    return convert(schema)
