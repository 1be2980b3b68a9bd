"""Approximate nearest neighbours: a forest of random-projection trees.

Trees are grown on a bounded sample of the distinct vectors (``Settings.sample``): each
inner node parts its points at the median of their projections on the difference
of two two-means centres.  For inner products the vectors get one more component
that brings them all to one length (queries get 0 there), so near in angle means large
in product.  Every vector of the table is put into one leaf of each tree.

A query walks all trees by one shared priority queue (by the squared margins of the sides
it did not take) and takes leaves until they hold ``search_share`` of the table, counted
per tree.  The share is calibrated for every table: a bounded number of its queries are
answered exactly within the sample, and the share is the least with which their walks
meet ``recall`` of these answers (a sample's neighbours are farther than the table's, so
this errs towards more).  Neighbouring leaves form cells of bounded size; a cell's vectors and its queries
meet in blocks, where the products with the vectors of the query's leaves are taken
exactly (double precision, original components); a query's best of all blocks are kept.
Products below what the query reaches with sampled vectors of its own leaves, which it will
find anyway, are not returned by a block.

Equal vectors are indexed once, with the few least ids that can be in any answer, so a
vector that a third of all rows share is one entry.  The trees and leaf sizes that
travel to executors are bounded by the sample, not by the table.

Defined results: vectors null, empty, zero or with null or non-finite components take no
part, nor rows with a null id or of another length than the most frequent one
(the least, at ties); rows that repeat an id are never each other's neighbours; with fewer
candidates than ``k`` all are returned; ties go to the smaller id.  Only id and vector are
read; other columns may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editrisk.llm.common import shuffle_width, store


@dataclass(frozen=True)
class Settings:
    trees: int = 4
    sample: int = 32_768       # bound of the vectors that the trees are grown on
    leaf: int = 48             # sampled vectors in a leaf, at most
    search_share: float | None = None  # of the table, counted per tree, in a query's leaves; None: calibrated
    recall: float = 0.95       # what the calibration aims at
    probes: int = 128          # queries that it looks at, at most
    block_vectors: int = 4096  # bounds of the two sides of a block
    block_queries: int = 8192
    seed: int = 5


class Tree:
    """Inner node i parts by ``x @ normal[i] > offset[i]``; a negative child is leaf ~child."""

    def __init__(self, points: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normal, self.offset, self.child = [], [], []
        self.leaves = 0
        self.root = self._grow(points, leaf, rng)
        width = points.shape[1]
        self.normal = np.array(self.normal, np.float32).reshape(-1, width)
        self.offset = np.array(self.offset, np.float32)
        self.child = np.array(self.child, np.int64).reshape(-1, 2)

    def _grow(self, points: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        todo, root = [(points, None, 0)], None
        while todo:
            part, parent, side = todo.pop()
            split = self._split(part, rng) if len(part) > leaf else None
            if split is None:
                node = ~self.leaves
                self.leaves += 1
            else:
                node = len(self.child)
                self.normal.append(split[0])
                self.offset.append(split[1])
                self.child.append([0, 0])
                right = part @ split[0] > split[1]
                todo += [(part[~right], node, 0), (part[right], node, 1)]
            if parent is None:
                root = node
            else:
                self.child[parent][side] = node
        return root

    @staticmethod
    def _split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float] | None:
        seen = points[rng.choice(len(points), min(len(points), 256), replace=False)]
        a, b = seen[0].copy(), seen[1].copy()
        for _ in range(4):
            nearer = ((seen - a) ** 2).sum(axis=1) <= ((seen - b) ** 2).sum(axis=1)
            if nearer.all() or not nearer.any():
                break
            a, b = seen[nearer].mean(axis=0), seen[~nearer].mean(axis=0)
        normal = a - b
        length = np.linalg.norm(normal)
        if not length:
            return None
        normal = (normal / length).astype(np.float32)
        along = points @ normal
        offset = float(np.median(along))
        if not 0 < (along > offset).sum() < len(points):
            return None
        return normal, offset

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            n = at[inner]
            right = np.einsum("ij,ij->i", x[inner], self.normal[n]) > self.offset[n]
            at[inner] = self.child[n, right.astype(int)]
        return ~at


def leaves_to_search(trees: list[Tree], sizes: list[np.ndarray], query: np.ndarray,
                     search: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of one priority queue over all trees."""
    margins = [t.normal @ query - t.offset for t in trees]
    queue = [(0.0, i, t.root) for i, t in enumerate(trees)]
    heapq.heapify(queue)
    found, held = [], 0
    while queue and held < search:
        miss, i, node = heapq.heappop(queue)
        while node >= 0:
            m = float(margins[i][node])
            good, bad = trees[i].child[node][int(m > 0)], trees[i].child[node][int(m <= 0)]
            heapq.heappush(queue, (miss + m * m, i, int(bad)))
            node = int(good)
        found.append((i, ~node))
        held += int(sizes[i][~node])
    return found


def share_for(trees: list[Tree], sample: np.ndarray, in_leaf: list[np.ndarray], queries: np.ndarray, k: int,
              recall: float) -> float:
    """The least share of the sample, counted per tree, whose leaves hold ``recall`` of the
    queries' ``k`` largest products with the sample (vectors equal to the query aside)."""
    sizes = [np.bincount(leaf, minlength=t.leaves) for leaf, t in zip(in_leaf, trees)]
    needed: list[float] = []
    for q in queries:
        products = sample @ q
        products[(sample == q).all(axis=1)] = -np.inf
        best = np.argsort(-products, kind="stable")[:k]
        best = best[np.isfinite(products[best])]
        held, before = 0, [np.zeros(t.leaves) for t in trees]
        for i, leaf in leaves_to_search(trees, sizes, np.append(q, 0.0).astype(np.float32), np.inf):
            before[i][leaf] = held
            held += int(sizes[i][leaf])
        needed += np.min([before[i][in_leaf[i][best]] for i in range(len(trees))], axis=0).tolist()
    if not needed:
        return 1.0
    # a leaf is taken while less than the share is held
    return (float(np.quantile(needed, recall, method="higher")) + 1) / len(sample)


def cells_of(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf of a tree its cell (a run of leaves of at most ``most`` vectors), and the
    number of blocks it is dealt into (over 1 only for a leaf larger than that)."""
    cell, held, at = np.zeros(len(sizes), np.int64), 0, 0
    for leaf, n in enumerate(sizes):
        if held and held + n > most:
            at, held = at + 1, 0
        cell[leaf] = at
        held += int(n)
    return cell, np.maximum(1, -(-sizes // most))


def usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id",
            vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """``query_id, rank, <id>, score``: for the rows where ``is_query``, the ``k`` rows found
    with the largest inner product among all other rows."""
    s, spark = settings, table.sparkSession
    kind = "array<float>" if dict(table.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"),
                        F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable("v"))
    lengths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if lengths is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    width = lengths["width"]
    rows = rows.where(F.size("v") == width)

    # equal vectors: no answer holds more than the k + 1 least of their ids
    ranked = rows.select("id", "v").distinct().withColumn(
        "r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    entries = store(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        "ids", "v", F.xxhash64(F.lit(s.seed), "v").alias("at"),
        F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")).alias("square")), "entries")
    top, n_entries = entries.agg(F.max("square"), F.count("*")).first()
    sample = np.array([r[0] for r in entries.orderBy("at", "v").limit(s.sample).select("v").collect()])

    def lifted(v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0.0))
        return np.hstack([v, rest[:, None]]).astype(np.float32)

    def matrix(column: pd.Series) -> np.ndarray:
        return np.stack(column.to_numpy()).astype(np.float64)

    rng = np.random.default_rng(s.seed)
    points = lifted(sample)
    forest = spark.sparkContext.broadcast([Tree(points, s.leaf, rng) for _ in range(s.trees)])
    drawn = spark.sparkContext.broadcast((sample.astype(np.float64), [t.leaf_of(points) for t in forest.value]))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = [np.zeros(t.leaves, np.int64) for t in forest.value]
        for batch in batches:
            if len(batch):
                x = lifted(matrix(batch["v"]))
                for size, t in zip(sizes, forest.value):
                    size += np.bincount(t.leaf_of(x), minlength=t.leaves)
        for i, size in enumerate(sizes):
            used = np.flatnonzero(size)
            yield pd.DataFrame({"tree": i, "leaf": used, "n": size[used]})

    sizes = [np.zeros(t.leaves, np.int64) for t in forest.value]
    filled = entries.select("v").mapInPandas(fill, "tree int, leaf int, n long")
    for r in filled.groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():  # a row per leaf of the forest
        sizes[r["tree"]][r["leaf"]] = r["n"]
    dealt = spark.sparkContext.broadcast([(size, *cells_of(size, s.block_vectors)) for size in sizes])
    asked = rows.where("asks").select("id", "v").distinct()
    turns = max(1, -(-asked.count() // s.block_queries))
    share = s.search_share
    if share is None:
        probes = asked.orderBy(F.xxhash64(F.lit(s.seed), "id"), "id").limit(s.probes).select("v").collect()
        share = share_for(forest.value, *drawn.value, np.array([r[0] for r in probes]).reshape(-1, width), k, s.recall)
    search = share * n_entries

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, first = lifted(matrix(batch["v"])), batch["ids"].str[0].to_numpy()
            for i, t in enumerate(forest.value):
                leaf = t.leaf_of(x)
                _, cell, blocks = dealt.value[i]
                for turn in range(turns):
                    yield pd.DataFrame({"tree": i, "cell": cell[leaf], "block": (first * 0x9E3779B1 & 0x7FFFFFFF)
                                        % blocks[leaf], "turn": turn, "leaf": leaf, "ids": batch["ids"],
                                        "v": batch["v"]})

    indexed = entries.select("ids", "v").mapInPandas(
        place, f"tree int, cell int, block int, turn int, leaf int, ids array<long>, v {kind}")

    def floor(products: np.ndarray, at: np.ndarray) -> float:
        """What the k + 1 best sampled vectors in the leaves ``at`` reach.  These will be found,
        so nothing below them is in the answer."""
        inside = np.zeros(len(products), bool)
        for i, in_leaf in enumerate(drawn.value[1]):
            chosen = np.zeros(forest.value[i].leaves, bool)
            chosen[at[at[:, 0] == i, 1]] = True
            inside |= chosen[in_leaf]
        mine = products[inside]
        if len(mine) <= k:
            return float("-inf")
        least = float(np.partition(mine, -(k + 1))[-(k + 1)])
        return least - 1e-9 * abs(least)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            seen = (line for at in range(0, len(batch), 64)
                    for line in matrix(batch["v"].iloc[at:at + 64]) @ drawn.value[0].T)
            for q, v, products in zip(batch["id"], batch["v"], seen):
                at = np.array(leaves_to_search(forest.value, [d[0] for d in dealt.value],
                                               np.append(v, 0.0).astype(np.float32), search))
                least = floor(products, at)
                for i in np.unique(at[:, 0]):
                    leaves = np.sort(at[at[:, 0] == i, 1])
                    _, cell, blocks = dealt.value[i]
                    for c in np.unique(cell[leaves]):
                        here = leaves[cell[leaves] == c]
                        out += [(q, v, least, int(i), int(c), b, (q * 0x9E3779B1 & 0x7FFFFFFF) % turns, here)
                                for b in range(int(blocks[here].max()))]
                if len(out) > 2000:
                    yield pd.DataFrame(out, columns=["query_id", "q", "least", "tree", "cell", "block", "turn", "leaves"])
                    out = []
            yield pd.DataFrame(out, columns=["query_id", "q", "least", "tree", "cell", "block", "turn", "leaves"])

    # few bytes, much work: without this one task would walk for all queries
    paths = asked.repartition(shuffle_width(spark), "id").mapInPandas(
        walk, f"query_id long, q {kind}, least double, tree int, cell int, block int, turn int, leaves array<int>")

    def best_of_block(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(vectors):
            v, ids, leaf = matrix(vectors["v"]).T, vectors["ids"].to_numpy(), vectors["leaf"].to_numpy()
            keep = min(v.shape[1], k + 1)
            for at in range(0, len(queries), 512):
                part = queries.iloc[at:at + 512]
                products = matrix(part["q"]) @ v
                for q, floor_, leaves, line in zip(part["query_id"], part["least"], part["leaves"], products):
                    line[~np.isin(leaf, leaves)] = -np.inf
                    least = max(np.partition(line, -keep)[-keep], floor_, np.finfo(float).min)
                    out += [(q, line[j], ids[j]) for j in np.flatnonzero(line >= least)]
        return pd.DataFrame(out, columns=["query_id", "score", "ids"])

    by = ["tree", "cell", "block", "turn"]
    hits = paths.groupBy(*by).cogroup(indexed.groupBy(*by)).applyInPandas(
        best_of_block, "query_id long, score double, ids array<long>")
    pairs = (hits.select("query_id", "score", F.explode("ids").alias("id"))
             .where(F.col("id") != F.col("query_id"))
             .groupBy("query_id", "id").agg(F.max("score").alias("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
