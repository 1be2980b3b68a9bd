"""Spelling variants: blocked Gram matrices of letter counts, then verified edits.

Words are counted over all texts.  Two words are near if one inserted, deleted or replaced
letter turns one into the other; their letter counts then differ by a squared distance of one
or two, and their lengths by one at most.

Blocks: the letters fall into a few classes of about equal use.  A word is filed under
its letters-per-class counts (whole) and under these counts less one letter of each class it has.
Near words share a file: of equal lengths, each less its differing letter; otherwise the
shorter as a whole and the longer less its extra letter.  Of the files that two words share
exactly one is theirs: by class, they differ (or both are whole).  In a file, which holds words of two
adjacent lengths, a NumPy product of the letter-count blocks gives all squared distances;
pairs at most two apart are verified letter by letter, and every block returns only counts and
the best near word per word.  Files above ``BLOCK`` words are dealt into blocks, and pairs of
blocks go to tasks of their own, so no file lands in one task and no pair is left out.

A word's form is its most frequent near word (ties: least in code-point order) if that is at least
``ratio`` times as frequent; the root follows forms to the last, by pointer jumping (a form is
``ratio`` times as frequent, so paths are short).

Defined results: null and letter-less texts have no words; a null id counts as an empty one in
``delete_letters``; ids that repeat are read each; words of any length are compared; an
empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editrisk.llm.common import broadcast_if_small, discard, store

#: The letters, and the least code points and occurrences of a word.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
MIN_LENGTH, MIN_COUNT = 5, 3

#: Letter classes, words of one block, and words whose small files are multiplied together.
CLASSES = 8
BLOCK = 2048
TOGETHER = 256
#: Words up to this length are verified with arrays, longer ones one by one.
ARRAY_LENGTH = 64

_INDEX = np.full(0x100, -1, np.int64)
_INDEX[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))


# ---------------------------------------------------------------- words and counts

def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, word`` of every maximal letter run (A-Z lower-cased) of whole texts."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(
        F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    ascii_ = F.octet_length("run") == F.length("run")
    return runs.select("id", F.when(ascii_, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("word"))


def delete_letters(runs: DataFrame, one_in: int) -> DataFrame:
    """``word`` with one letter less where ``one_in`` divides the crc32 of ``<id>:<word>``
    (the letter at the crc32 modulo the length)."""
    mark = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))
    # words that cannot be long enough are not hashed
    marked = runs.where(F.length("word") >= MIN_LENGTH).select("word", F.crc32(mark.cast("binary")).alias("h"))
    at = (F.col("h") % F.length("word")).cast("int")
    less = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    return marked.select(F.when(F.col("h") % one_in == 0, less).otherwise(F.col("word")).alias("word"))


def count_words(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough."""
    return (words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_count))


# ---------------------------------------------------------------- files of words

def letter_counts(words: list[str]) -> np.ndarray:
    """One row of letter counts per word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    sizes = np.array(list(map(len, words)), np.int64)
    if len(codes) and (codes.max() > 0xFF or (_INDEX[codes] < 0).any()):
        raise ValueError("a word has a character outside the letters")
    at = np.repeat(np.arange(len(words)), sizes) * len(LETTERS) + _INDEX[codes]
    return np.bincount(at, minlength=len(words) * len(LETTERS)).reshape(len(words), -1)


def letter_classes(vocabulary: DataFrame, classes: int) -> np.ndarray:
    """Class of every letter, of about equal use in the vocabulary (one row per letter is read)."""
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()
    use = {r["letter"]: r["count"] for r in letters}
    load, out = [0] * classes, np.zeros(len(LETTERS), np.int64)
    for letter in sorted(LETTERS, key=lambda c: (-use.get(c, 0), c)):
        k = load.index(min(load))
        out[LETTERS.index(letter)] = k
        load[k] += use.get(letter, 0)
    return out


def file_words(vocabulary: DataFrame, class_of: np.ndarray) -> DataFrame:
    """``file, less, word, n``: each word under its class counts (``less`` -1) and under these
    less one letter of class ``less``."""
    classes = int(class_of.max()) + 1
    member = np.zeros((len(LETTERS), classes), np.int64)
    member[np.arange(len(LETTERS)), class_of] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words, n = batch.column("word"), batch.column("n")
            sums = letter_counts(words.to_pylist()) @ member
            for k in range(-1, classes):
                rows = np.arange(len(sums)) if k < 0 else np.flatnonzero(sums[:, k])
                key = sums[rows].astype(">i4")
                if k >= 0:
                    key[:, k] -= 1
                data = key.tobytes()
                width = 4 * classes
                yield pa.RecordBatch.from_arrays([
                    pa.array([data[i:i + width] for i in range(0, len(data), width)], pa.binary()),
                    pa.array(np.full(len(rows), k, np.int32)), words.take(pa.array(rows)), n.take(pa.array(rows))],
                    names=["file", "less", "word", "n"])

    return vocabulary.mapInArrow(run, "file binary, less int, word string, n long")


def deal(files: DataFrame, block: int) -> DataFrame:
    """``files`` with the pair of blocks ``i <= j`` that a row is sent to and its own block.

    A file of up to ``block`` rows is one block; a larger one has as many as it needs, and each
    of its rows goes to every pair that its block is part of."""
    size = files.groupBy("file").agg(F.count("*").alias("size")).where(F.col("size") > block)
    large = store(size.select("file", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "large")
    dealt = files.join(broadcast_if_small(large, 64), "file", "left")
    own = F.pmod(F.xxhash64("word"), F.coalesce("blocks", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    dealt = dealt.withColumn("own", own).withColumn("other", other)
    return dealt.select("file", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                        "own", "less", "word", "n")


# ---------------------------------------------------------------- blocks

def one_edit(a: np.ndarray, b: np.ndarray, words: list[str], left: np.ndarray, right: np.ndarray,
             sizes: np.ndarray) -> np.ndarray:
    """Which pairs of words (places ``a``, ``b``) are one edit apart: the common prefix and
    suffix leave one letter of the longer word at most."""
    longer = np.maximum(sizes[a], sizes[b])
    if left.shape[1]:
        same = left[a] == left[b]
        prefix = np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))
        same = right[a] == right[b]
        suffix = np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))
        return prefix + suffix >= longer - 1
    out = np.empty(len(a), bool)
    for k, (u, v) in enumerate(zip(a.tolist(), b.tolist())):
        u, v = words[u], words[v]
        at = len(commonprefix((u, v)))
        out[k] = u[at + 1:] == v[at + 1:] or u[at + 1:] == v[at:] or u[at:] == v[at + 1:]
    return out


def near_pairs(words: list[str], less: np.ndarray, group: np.ndarray, side: np.ndarray,
               rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near pairs of one group, between ``rows`` and ``cols`` (which may be the
    same) and, where ``side`` is not negative, of different sides."""
    counts = letter_counts(words)
    sizes = counts.sum(axis=1)
    counts = counts[:, counts.any(axis=0)].astype(np.float32 if sizes.max() < 2000 else np.float64)
    square = (counts * counts).sum(axis=1)
    width = int(sizes.max()) if sizes.max() <= ARRAY_LENGTH else 0
    left, right = np.zeros((len(words), width), np.uint8), np.zeros((len(words), width), np.uint8)
    if width:
        codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        row, begin = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes
        place = np.arange(len(codes)) - begin[row]
        left[row, place] = codes
        right[row, sizes[row] - 1 - place] = codes
    distance = square[rows][:, None] + square[cols][None, :] - 2 * (counts[rows] @ counts[cols].T)
    a, b = np.nonzero((distance <= 2) & (distance > 0))
    a, b = rows[a], cols[b]
    ours = (group[a] == group[b]) & ((less[a] != less[b]) | (less[a] < 0)) & ((side[a] < 0) | (side[a] != side[b]))
    if rows is cols:
        ours &= a < b
    a, b = a[ours], b[ours]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for at in range(0, len(a), 100_000):
        x, y = a[at:at + 100_000], b[at:at + 100_000]
        near = one_edit(x, y, words, left, right, sizes)
        found.append((x[near], y[near]))
    a, b = map(np.concatenate, zip(*found))
    return a, b


def best_near(words: list[str], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """``word, n_near, best_n, best``: what a block knows of each of its words."""
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(a)))
    mine, best = a[first].tolist(), b[first].tolist()
    return pa.RecordBatch.from_arrays([
        pa.array([words[i] for i in mine], pa.string()), pa.array(count, pa.int64()),
        pa.array(n[best] if best else [], pa.int64()), pa.array([words[i] for i in best], pa.string())],
        names=["word", "n_near", "best_n", "best"])


def compare_blocks(dealt: DataFrame) -> DataFrame:
    """Partial ``word, n_near, best_n, best`` of every pair of blocks of every file."""

    def solve(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        """Groups of a few rows together, or one larger group, whose rows start at ``starts``."""
        words = table.column("word").to_pylist()
        n, less, own, i, j = (table.column(c).to_numpy() for c in ("n", "less", "own", "i", "j"))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
        side = np.where(i == j, -1, own)
        rows = cols = np.arange(len(words))
        if len(starts) == 1 and i[0] != j[0]:
            rows, cols = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])
        return best_near(words, n, *near_pairs(words, less, group, side, rows, cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            """Solve all groups but the last, which the next batch may continue."""
            nonlocal rest
            keys = list(zip(table.column("file").to_pylist(), table.column("i").to_pylist(),
                            table.column("j").to_pylist()))
            starts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
            ends = [*starts[1:], len(keys)]
            if not last:
                rest = table.slice(starts.pop())
                ends.pop()
            k = 0
            while k < len(starts):
                m = k + 1
                while m < len(starts) and ends[m] - starts[k] <= TOGETHER:
                    m += 1
                if ends[m - 1] - starts[k] > m - k:  # not only groups of one row
                    yield solve(table.slice(starts[k], ends[m - 1] - starts[k]), np.array(starts[k:m]) - starts[k])
                k = m

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
                rest = None
            if table.num_rows:
                yield from groups(table, last=False)
        if rest is not None:
            yield from groups(rest, last=True)

    placed = dealt.repartition("file", "i", "j").sortWithinPartitions("file", "i", "j")
    return placed.mapInArrow(run, "word string, n_near long, best_n long, best string")


# ---------------------------------------------------------------- forms and roots

def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form`` (null: none): pointers double until none moves."""
    at = store(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = store(at.join(step, "root").select("word", F.col("further").alias("root"),
                                                 (F.col("further") != F.col("root")).alias("moved")), "roots")
        moved = not new.where("moved").isEmpty()
        discard(at)
        at = new
        if not moved:
            return at.select("word", "root")


def group_variants(counted: DataFrame, ratio: int = 2, classes: int = CLASSES, block: int = BLOCK) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for ``word, n``."""
    vocabulary = store(counted.select("word", "n"), "vocabulary")
    files = store(file_words(vocabulary, letter_classes(vocabulary, classes)), "files")
    near = compare_blocks(deal(files, block)).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    enough = -F.col("top.less") >= ratio * F.col("n")
    judged = store(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("top.best")).alias("form"), F.when(enough, -F.col("top.less")).alias("form_n")), "judged")
    discard(files)
    return judged.join(roots(judged), "word")
