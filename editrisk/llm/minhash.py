"""Near-duplicate documents: SuperMinHash, banding, verification, union-find.

A document's set is its distinct word shingles.  SuperMinHash signs it: every
element walks one random permutation of the signature's places, and its rank at
step j lies in [j, j + 1); a place keeps its least rank.  Steps stop as soon as all
places hold ranks below the step, so long documents need one or two.  Bands of the
signature propose candidates, the full sets confirm them.

Documents with equal sets are one class; only classes are compared.  Every bucket has a
pivot.  In a few rounds each class is compared with one pivot, that of most common buckets,
unless both are in one component by then; confirmed links merge components.  In buckets that
still hold several components, classes of different components are compared on their full
sets block by block, and a block returns a spanning forest of its links, so no candidate
is dropped and no list of all pairs of a group is made.  With 32 bands of 5 places a pair
at similarity 0.8 is proposed with probability 1 - 3e-6.

Components: union-find within partitions keeps a spanning forest, then least labels
spread along its links with pointer jumping until nothing changes.  Links, sets and
labels stay in tables; hot nodes are reduced by partial minima and AQE-split joins.

Defined results: null or word-less text has an empty set and is linked with
nothing; fewer words than a shingle make one shingle of all of them; a component is
named by its least id (null ids only if it has no other); rows that repeat an id are
one document and stay or go together; an empty table gives an empty result.  Only id
and text are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editrisk.llm.common import SPACE_BYTES, broadcast_if_small, discard, store, tidy

BANDS, ROWS = 32, 5
#: Rounds of comparisons with pivots.
ROUNDS = 3
#: Shingles on either side of a block that compares components within a bucket.
BLOCK = 1 << 19
#: Shingles signed together, and bytes of one text tokenised together.
CHUNK_SHINGLES = 150_000
CHUNK_BYTES = 4 << 20

_U = np.uint64
_LAST = _U(0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the text's lower-cased (A-Z) words, in order."""
    data, parts, at = text.encode(), [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK_BYTES)
        while end < len(data) and data[end] not in SPACE_BYTES:
            end += 1
        words = data[at:end].lower().split()
        parts.append(b"".join(map(xxhash.xxh3_64_digest, words)))
        at = end
    return np.frombuffer(b"".join(parts), dtype=">u8").astype(np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, _U(k))
    for i in range(k):
        out = mix64(out * _U(0x9E3779B97F4A7C15) + h[i:len(h) - k + 1 + i])
    return np.unique(out)


def super_minhash(sets: list[np.ndarray], places: int) -> np.ndarray:
    """Signatures (one row each) of non-empty sets: step in the high word, rank below."""
    sizes = np.array([len(s) for s in sets])
    h = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    sig = np.full(len(sets) * places, _LAST)
    low = _U(0xFFFFFFFF)
    perm = None
    for step in range(places):
        x = mix64(h + _U(((step + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF))
        pick = (((x >> _U(32)) * _U(places - step)) >> _U(32)).astype(np.int64) + step
        if perm is None:
            place = pick
        else:
            each = np.arange(len(h))
            place = perm[each, pick].astype(np.int64)
            perm[each, pick] = perm[:, step]
        np.minimum.at(sig, row * places + place, (_U(step) << _U(32)) | (x & low))
        # a row whose places all hold ranks below the next step is finished
        worst = sig.reshape(-1, places).max(axis=1)
        open_ = (worst >= _U(step + 1) << _U(32))[row]
        if not open_.any():
            break
        if perm is None:
            h, row, pick = h[open_], row[open_], pick[open_]
            perm = np.tile(np.arange(places, dtype=np.uint16), (len(h), 1))
            perm[np.arange(len(h)), pick] = 0
        elif open_.sum() < 0.8 * len(h):
            h, row, perm = h[open_], row[open_], perm[open_]
    return sig.reshape(-1, places)


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key per band."""
    parts = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands))
    for r in range(rows):
        key = mix64(key * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.astype(np.int64)


def sign(docs: DataFrame, words: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n`` (set size), ``key`` (128 bits of the set, null if empty), ``bands``."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("id", narrow.schema["id"].dataType), T.StructField("n", T.LongType()),
        T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            full = [s for s in sets if len(s)]
            keys = bands_of(super_minhash(full, bands * rows), bands, rows) if full else np.empty((0, bands), int)
            signed = iter(keys)
            cols = [pa.array(ids, id_type), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(signed) if len(s) else None for s in sets], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        for batch in batches:
            id_type = batch.schema.field("id").type
            ids, sets, size = [], [], 0
            for key, text in zip(batch.column("id"), batch.column("text")):
                s = shingle_set(text.as_py(), words)
                ids.append(key.as_py())
                sets.append(s)
                size += len(s)
                if size >= CHUNK_SHINGLES or len(sets) >= 2000:
                    yield flush()
                    ids, sets, size = [], [], 0
            if sets:
                yield flush()

    return narrow.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``key, items`` (the full set) of each wanted class, read from the document ``id``."""
    narrow = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    row_bytes = 128 if isinstance(narrow.schema["doc"].dataType, T.StructType) else 64
    mine = narrow.join(broadcast_if_small(wanted, row_bytes), narrow["doc"].eqNullSafe(wanted["id"])).select("key", "text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets, size = [], [], 0
            for key, text in zip(batch.column("key"), batch.column("text")):
                s = shingle_set(text.as_py(), words)
                # a repeated id may also stand for other texts
                if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == key.as_py():
                    keys.append(key.as_py())
                    sets.append(s.astype(np.int64))
                    size += len(s)
                if size >= CHUNK_SHINGLES:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(
                        sets, pa.list_(pa.int64()))], names=["key", "items"])
                    keys, sets, size = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(
                    sets, pa.list_(pa.int64()))], names=["key", "items"])

    found = mine.mapInArrow(run, "key binary, items array<long>")
    return found.groupBy("key").agg(F.first("items").alias("items"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` with 100 * intersection >= percent * union on their full sets."""
    left = sets.select(F.col("key").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("key").alias("b"), F.col("items").alias("items_b"))
    both = pairs.select("a", "b").join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - shared
    return both.where(100 * shared >= percent * union).select("a", "b")


def spanning_forest(links: DataFrame) -> DataFrame:
    """Union-find within each partition: every node linked to its root."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        out = [(x, find(x)) for x in parent]
        out = [(x, r) for x, r in out if x != r]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["a", "b"])

    return links.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """``key, label`` (least key of the component) of every linked key; stored."""
    forest = store(spanning_forest(links), "forest")
    ways = store(forest.select(F.col("a").alias("key"), F.col("b").alias("next")).union(
        forest.select(F.col("b").alias("key"), F.col("a").alias("next"))).distinct(), "ways")
    labels = store(ways.groupBy("key").agg(F.min("next").alias("m"))
                   .select("key", F.least("key", "m").alias("label")), "labels")
    while True:
        told = (ways.join(labels.select(F.col("key").alias("next"), "label"), "next")
                .groupBy("key").agg(F.min("label").alias("m")))
        near = labels.join(told, "key").select("key", F.col("label").alias("old"),
                                               F.least("label", "m").alias("at"))
        jump = labels.select(F.col("key").alias("at"), F.col("label").alias("further"))
        new = store(near.join(jump, "at").select("key", "old", F.least("at", "further").alias("label")), "labels")
        moved = not new.where(F.col("label") != F.col("old")).isEmpty()
        discard(labels)
        labels = new
        if not moved:
            discard(forest, ways)
            return labels


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (least id of its
    component), ``kept`` (its id is that one)."""
    signed = store(sign(docs, words, bands, rows, id_col, text_col), "signed")
    classes = store(signed.where(F.col("n") > 0).groupBy("key").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    labels = link_classes(docs, classes, words, percent, id_col, text_col)
    labelled = classes.select("key", "id").join(labels, "key", "left").select(
        "key", "id", F.coalesce("label", "key").alias("label"))
    named = labelled.groupBy("label").agg(F.min("id").alias("component_id"))
    by_key = labelled.select("key", "label").join(named, "label").select("key", "component_id")
    out = signed.select("id", "n", "key").join(by_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def link_classes(docs: DataFrame, classes: DataFrame, words: int, percent: int, id_col: str,
                 text_col: str) -> DataFrame:
    """``key, label`` of the classes that have a link."""
    # a band key holds its band's number, and classes differ, so buckets need only be counted
    buckets = classes.select("key", "n", F.explode("bands").alias("bucket"))
    shared = store(buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("key", "n")).alias("pivot"))
                   .where(F.col("size") > 1), "shared")
    members = store(buckets.join(broadcast_if_small(shared, 64), "bucket"), "members")
    wanted = store(members.select("key").distinct().join(classes.select("key", "id"), "key"), "wanted")
    sets = store(shingle_sets(docs, wanted, words, id_col, text_col), "sets")

    near = 100 * F.least("n", "pivot.n") >= percent * F.greatest("n", "pivot.n")
    open_ = store(members.where((F.col("key") != F.col("pivot.key")) & near)
                  .groupBy(F.col("pivot.key").alias("a"), F.col("key").alias("b"))
                  .agg(F.count("*").alias("common")), "proposed")
    links: DataFrame | None = None
    for turn in range(ROUNDS):
        best = store(open_.groupBy("b").agg(F.max(F.struct("common", "a")).alias("best"))
                     .select(F.col("best.a").alias("a"), "b"), "pairs")
        found = store(confirm(best, sets, percent), "links")
        links = found if links is None else store(links.unionByName(found), "links")
        labels = components(links)
        narrow = broadcast_if_small(labels, 48)
        label = lambda c: narrow.select(F.col("key").alias(c), F.col("label").alias(f"of_{c}"))
        left = (open_.join(best.hint("merge"), ["a", "b"], "left_anti").join(label("a"), "a", "left")
                .join(label("b"), "b", "left"))
        left = store(left.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b", "common"), "proposed")
        discard(open_, best)
        open_ = left
        if open_.isEmpty():
            break
        if turn + 1 < ROUNDS:
            discard(labels)

    # a bucket of two is settled by its one pair, if that was compared; of the others those that hold
    # several components are open
    pair_of_two = members.where((F.col("size") == 2) & (F.col("key") != F.col("pivot.key"))).select(
        "bucket", F.col("pivot.key").alias("a"), F.col("key").alias("b")).join(open_, ["a", "b"], "left_semi")
    unsettled = members.where(F.col("size") > 2).unionByName(
        members.where(F.col("size") == 2).join(pair_of_two.select("bucket"), "bucket", "left_semi"))
    marked = unsettled.join(broadcast_if_small(labels, 48), "key", "left").select(
        "bucket", "key", "n", F.coalesce("label", "key").alias("label"))
    several = store(marked.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"))
                    .where(F.col("x") != F.col("y")).select("bucket"), "several")
    rest = store(marked.join(broadcast_if_small(several, 16), "bucket"), "open")
    if not rest.isEmpty():
        more = store(across_components(rest, classes, sets, percent), "links")
        if not more.isEmpty():
            discard(labels)
            labels = components(links.unionByName(more))
        discard(more)
    discard(shared, members, wanted, sets, open_, several, rest)
    return labels.select("key", "label")


def across_components(rest: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` (similar on their full sets) that join all components of one open bucket that
    similar classes join: a spanning forest of every pair of blocks.

    In a bucket, the classes outside its largest component are compared with all others.
    Both sides are dealt into blocks of about ``BLOCK`` shingles.  A pair is compared in the
    first of its common buckets only, unless a link of the block has joined it already.
    """
    per = rest.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.sum("n").alias("items"))
    largest = per.groupBy("bucket").agg(F.max(F.struct("c", "label", "items")).alias("m"), F.sum("items").alias("items"))
    largest = store(largest, "largest")
    sized = rest.join(broadcast_if_small(largest, 96), "bucket").select(
        "bucket", "key", "n", "label", (F.col("label") != F.col("m.label")).alias("minor"),
        F.ceil((F.col("items") - F.col("m.items")) / BLOCK).alias("of_minor"),
        F.ceil(F.col("items") / BLOCK).alias("of_all"))
    full = sized.join(sets.hint("merge"), "key").join(classes.select("key", "bands").hint("merge"), "key")
    own = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "key"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kept = ["bucket", "key", "n", "label", "bands", "items"]
    minor = full.where("minor").select(*kept, F.lit(True).alias("first"), own(1, "of_minor").alias("i"),
                                       every("of_all").alias("j"))
    both = full.select(*kept, F.lit(False).alias("first"), own(2, "of_all").alias("j"),
                       every("of_minor").alias("i"))

    def compare(rows: pa.Table) -> pa.Table:
        first = rows.column("first").combine_chunks()
        left, right = rows.filter(first), rows.filter(pa.compute.invert(first))
        found = block_links(left, right, percent) if left.num_rows and right.num_rows else []
        return pa.table({"a": pa.array([min(x) for x in found], pa.binary()),
                         "b": pa.array([max(x) for x in found], pa.binary())})

    return (minor.unionByName(both).groupBy("bucket", "i", "j")
            .applyInArrow(compare, "a binary, b binary").distinct())


def block_links(left: pa.Table, right: pa.Table, percent: int) -> list[tuple[bytes, bytes]]:
    """The links by which similar classes of ``left`` and ``right`` join their components."""
    bucket = left.column("bucket")[0].as_py()
    keys, labels = ([t.column(c).to_pylist() for t in (left, right)] for c in ("key", "label"))
    names = {x: i for i, x in enumerate({*labels[0], *labels[1]})}
    label = [np.array([names[x] for x in c]) for c in labels]
    n = [t.column("n").to_numpy() for t in (left, right)]
    bands = [t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (left, right)]
    items = right.column("items").combine_chunks()
    sizes = np.diff(items.offsets.to_numpy())
    row = np.repeat(np.arange(right.num_rows), sizes)
    # of each set in one order: similar sets share one of their first n - need + 1 shingles
    flat = items.flatten().to_numpy()
    flat = flat[np.lexsort((flat, row))]
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    head = place <= sizes[row] - (percent * sizes[row] + 99) // 100
    flat_head, row_head = flat[head], row[head]
    found = []
    for a in range(left.num_rows):
        need = -(-percent * (n[0][a] + n[1]) // (100 + percent))
        ok = (label[1] != label[0][a]) & (np.minimum(n[1], n[0][a]) >= need)
        same = bands[1][ok] == bands[0][a]
        ok[ok] = bands[1][ok][np.arange(same.shape[0]), same.argmax(axis=1)] == bucket
        if not ok.any():
            continue
        mine = np.sort(left.column("items")[a].values.to_numpy())
        mine_head = mine[:len(mine) - (percent * len(mine) + 99) // 100 + 1]
        use = ok[row_head]
        at = np.minimum(np.searchsorted(mine_head, flat_head[use]), len(mine_head) - 1)
        ok &= np.bincount(row_head[use][mine_head[at] == flat_head[use]], minlength=len(ok)) > 0
        use = ok[row]
        at = np.minimum(np.searchsorted(mine, flat[use]), len(mine) - 1)
        shared = np.bincount(row[use][mine[at] == flat[use]], minlength=len(ok))
        for b in np.flatnonzero(ok & (shared >= need)).tolist():
            x, y = label[0][a], label[1][b]
            if x != y:
                found.append((keys[0][a], keys[1][b]))
                for side in label:
                    side[side == y] = x
    return found
