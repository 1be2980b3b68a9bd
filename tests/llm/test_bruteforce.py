"""The queries against SQL, brute force and the tokenizers' own libraries on a small table."""

import base64
import hashlib
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from editrisk.llm import minhash, mixing, queries
from tests.oracle_compare import digest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return {r[0]: r for r in duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet'").fetchall()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE_SQL[name])
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest(
        [c[0] for c in cur.description], cur.fetchall())


def test_near_duplicates(spark, documents):
    sets = {}
    for k, r in documents.items():
        w = (r[1] or "").encode().lower().split()
        sets[k] = {*zip(w, w[1:])} if len(w) > 1 else {tuple(w)} - {()}
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in queries.op2_minhash_near_dedup(spark, SF).collect()}
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {
        k: (len(sets[k]), root(k), root(k) == k) for k in sets}


def test_components_within_one_bucket(spark, monkeypatch):
    """A family in which many pairs lie near the threshold, in blocks of a few classes."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(120):
        words = list(base)
        for at in rng.choice(60, rng.integers(1, 6), replace=False):
            words[at] = f"x{rng.integers(0, 40)}"
        texts.append(" ".join(words))
    monkeypatch.setattr(minhash, "BLOCK", 900)
    monkeypatch.setattr(minhash, "ROUNDS", 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, words=2).collect()}
    sets = [{*zip(t.split(), t.split()[1:])} for t in texts]
    up = list(range(len(sets)))
    for a, b in combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = up[a], up[b]
            up = [min(x, y) if u in (x, y) else u for u in up]
    assert got == dict(enumerate(up)) and len(set(up)) > 1


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for n, share in ((5, 0.6), (300, 0.8), (4000, 0.5)):
        pool = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        same = int(2 * n * share / (1 + share))
        a, b = pool[:(2 * n + same) // 2], pool[(2 * n - same) // 2:]
        x, y = minhash.super_minhash([a, b], 256)
        real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((x == y).mean() - real) < 0.12


def test_token_counts(spark, documents):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in queries.op7_token_counts(spark, SF).collect()}
    assert got == {k: len(t.encode(r[1] or "", add_special_tokens=False).ids) for k, r in documents.items()}


def test_bpe(spark, documents):
    with open(queries.BPE_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op9_bpe_codec(spark, SF).collect():
        text = documents[r.doc_id][1] or ""
        ids = np.array(codec.encode_ordinary(text), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_texts(spark):
    from editrisk.llm.bpe import MergeReplay
    from editrisk.llm.tokencount import MergeCounter
    odd = ["a" * 3000, "    \n\n\t x  ", "<|endoftext|> a<|endoftext|>", "\x1c\x85\u3000\u200b e\u0301 \U0001f600 ½²", "ab" * 999]
    odd += ["".join(map(chr, range(a, a + 256))) for a in range(0, 0x3000, 256)]
    with open(queries.BPE_RANKS, "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = list(MergeReplay(data, public_tokenizers.PATTERN).encode(odd))
    assert got == [np.array(codec.encode_ordinary(x), "<u4").tobytes() for x in odd]
    t = Tokenizer.from_file(queries.COUNT_VOCABULARY)
    with open(queries.COUNT_VOCABULARY, "rb") as f:
        counter = MergeCounter(f.read())
    assert [counter.count(x) for x in odd] == [len(t.encode(x, add_special_tokens=False).ids) for x in odd]


def test_language_accuracy(spark, documents):
    got = [r for r in queries.op5_language_id(spark, SF).collect() if r.held_out and documents[r.doc_id][2]]
    right = sum(r.lang_pred == documents[r.doc_id][2] for r in got)
    assert right >= 0.95 * len(got)


def test_neighbour_recall(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = {}
    for r in queries.op10_nearest_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        best = [int(ids[j]) for j in np.lexsort((ids, -score)) if j != i][:20]
        hit, total = hit + len(set(best) & set(got[int(ids[i])])), total + 20
        assert all(abs(score[list(ids).index(v)] - s) < 1e-12 for v, s in got[int(ids[i])].items())
    assert hit >= 0.9 * total


def test_mix_comes_near_its_targets(spark):
    got = queries.op3_source_mixing(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"),
                                       F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= r.most


def test_offset_is_fixed_by_seed(spark):
    df = spark.createDataFrame([("a",), (None,)], "__source string")
    u = [r[0] for r in df.select(mixing.random_offset(7)).collect()]
    assert u == [r[0] for r in df.select(mixing.random_offset(7)).collect()] and all(0 <= x < 1 for x in u)


def test_block_links_are_a_spanning_forest():
    """A block returns no more links than components it joins, all on full sets."""
    import pyarrow as pa
    rng = np.random.default_rng(4)
    base = rng.integers(-1 << 62, 1 << 62, 100)
    sets = [np.where(rng.random(100) < 0.08, rng.integers(-1 << 62, 1 << 62, 100), base) for _ in range(60)]
    sets += [rng.integers(-1 << 62, 1 << 62, 100) for _ in range(30)]
    keys = [b"%03d" % i for i in range(len(sets))]
    rows = pa.table({"bucket": [5] * 90, "key": pa.array(keys, pa.binary()), "label": pa.array(keys, pa.binary()),
                     "n": [100] * 90, "bands": [[5]] * 90, "items": pa.array(sets, pa.list_(pa.int64()))})
    got = minhash.block_links(rows, rows, 80)
    place = {k: i for i, k in enumerate(keys)}
    assert all(len({*sets[place[a]]} & {*sets[place[b]]}) >= 89 for a, b in got)
    up = list(range(90))
    for a, b in combinations(range(90), 2):
        both = len({*sets[a]} & {*sets[b]})
        if 100 * both >= 80 * (200 - both) and up[a] != up[b]:
            up = [up[a] if u == up[b] else u for u in up]
    assert len(got) == 90 - len(set(up)) and len(set(up)) < 60


def test_neighbour_search_adapts_to_structure(spark):
    """20,000 vectors in 400 clusters: the calibrated share is small and the recall high."""
    from editrisk.llm import ann
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(400, 16)), 50, axis=0) + 0.1 * rng.normal(size=(20_000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    trees = [ann.Tree(np.hstack([x, np.zeros((len(x), 1))]).astype(np.float32), 48, rng) for _ in range(4)]
    in_leaf = [t.leaf_of(np.hstack([x, np.zeros((len(x), 1))]).astype(np.float32)) for t in trees]
    assert ann.share_for(trees, x, in_leaf, x[::400], 20, 0.95) < 0.2
    table = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": list(x)}))
    got = ann.nearest(table, F.col("vec_id") % 400 == 0).toPandas()
    hit = 0
    for q in range(0, len(x), 400):
        score = x @ x[q]
        best = [int(j) for j in np.lexsort((np.arange(len(x)), -score)) if j != q][:20]
        hit += len(set(best) & set(got.loc[got["query_id"] == q, "vec_id"]))
    assert hit >= 0.9 * 20 * 50 and len(got) == 20 * 50
