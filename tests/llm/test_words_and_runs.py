"""Word codec, spelling variants and periodic runs: library, brute force and edge cases."""

import hashlib
import random
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from editrisk.llm import periodicity, queries, variants, wordbpe

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.WORD_VOCABULARY)


@pytest.fixture(scope="module")
def codec():
    with open(queries.WORD_VOCABULARY, "rb") as f:
        return wordbpe.WordCodec(f.read())


# ---------------------------------------------------------------- word codec

def test_word_bpe(spark, documents, library):
    for r in queries.op11_word_bpe(spark, SF).collect():
        e = library.encode(documents[r.doc_id] or "", add_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest())
        text = library.decode(e.ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def odd_texts():
    rng = random.Random(2)
    pick = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    texts = ["a" * 3000, " \n\t x", "<|endoftext|> a<|startoftext|>B<|EndOfText|>", "\x1c\x85　​ é \U0001f600 ½²",
             "ab" * 999, "ΣΑΣ ΟΔΟΣ İstanbul ǅ ﬁ", "don't DON'T we'll", "", "123 4a5", "< | >", "<|", "e<|endoftext|>́"]
    texts += ["".join(map(chr, range(a, a + 128))) for a in range(0, 0x500, 128)]
    return texts + [pick(letters, 40) for letters in ("etaoinshrdlu", "ab", "éüñ中文字aé") for _ in range(700)]


def test_odd_words(codec, library):
    for text, ids in zip(odd_texts(), codec.encode(odd_texts())):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text[:40]


def test_small_chunks_and_caches_change_nothing(codec, monkeypatch):
    want = [x.tolist() for x in codec.encode(odd_texts())]
    for name, value in (("CHUNK_CHARS", 100), ("STEP_WORDS", 7), ("CACHE_WORDS", 20), ("LONG_WORD", 5)):
        monkeypatch.setattr(wordbpe, name, value)
        codec.forget()
        assert [x.tolist() for x in codec.encode(odd_texts())] == want


def test_failing_words_only_are_merged(codec, monkeypatch):
    """The seam check agrees with merging: a proposal passes exactly if it is the merged word."""
    words = [w.encode() for w in {*"".join(odd_texts()[-2100:-700]).split(), "the", "running", "unbelievable"}][:500]
    merged = [codec.merge([*w[:-1], w[-1] + 256]) for w in words]
    ids, sizes = codec.tokens(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == merged
    monkeypatch.setattr(codec, "merge_all", lambda *a: pytest.fail("merged") if len(a[1]) else (np.empty(0, int),) * 2)
    assert codec.tokens([b"the", b"cat"])[1].tolist() == [1, 1]


def test_codec_edges(spark, codec):
    long = "word Other thing " * 30_000
    df = spark.createDataFrame([(1, "Same text", 1), (1, "Same text", 2), (2, None, 3), (3, "", 4), (None, long, 5)],
                               "doc_id long, text string, __coded long")
    coded = wordbpe.encode(df, queries.WORD_VOCABULARY)
    got = {r["__coded"]: r for r in wordbpe.decode(coded, queries.WORD_VOCABULARY).collect()}
    assert bytes(got[1].ids) == bytes(got[2].ids) and got[1].decoded == "same</w> text</w>"
    assert bytes(got[3].ids) == bytes(got[4].ids) == b"" and got[3].decoded == got[4].decoded == ""
    assert len(got[5].ids) == 4 * 90_000
    report = wordbpe.round_trip(df.drop("__coded"), queries.WORD_VOCABULARY)
    assert report.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert wordbpe.round_trip(df.drop("__coded").limit(0), queries.WORD_VOCABULARY).count() == 0


# ---------------------------------------------------------------- spelling variants

def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) - len(u) == 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def check_variants(got, counts):
    links = {w: [] for w in counts}
    for u, v in combinations(counts, 2):
        if near(u, v):
            links[u].append(v)
            links[v].append(u)
    assert {r.word: (r.n, r.n_near) for r in got} == {w: (n, len(links[w])) for w, n in counts.items()}
    form = {}
    for w, n in counts.items():
        best = min(links[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    for r in got:
        root = r.word
        while form[root] is not None:
            root = form[root]
        assert (r.form, r.form_n, r.root) == (form[r.word], counts.get(form[r.word]), root)


@pytest.mark.parametrize("block, classes", [(2048, 8), (5, 2), (3, 1)])
def test_variants(spark, block, classes, monkeypatch):
    rng = random.Random(block)
    words = {"".join(rng.choice("abcdé") for _ in range(rng.randint(5, 8))) for _ in range(350)}
    words |= {w[:i] + w[i + 1:] for w in list(words)[:80] for i in (1, 3)} | {"x" * 70, "x" * 71, "x" * 69 + "y", "q" * 3000}
    counts = {w: int(3 + 200 * rng.random() ** 4) for w in words if len(w) >= 5}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("root", F.lit(1))
    check_variants(variants.group_variants(df, classes=classes, block=block).collect(), counts)


def test_words_and_deletions(spark):
    texts = ["Über HELLO hello,world_hello", None, "", "123 !", "ÄÖÜ÷×äöü naïve naïve naïve" * 40, "letters " * 500] * 30
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(0))
    counts = {}
    letters = set(variants.LETTERS) | set(variants.UPPER)
    for i, t in rows:
        for run in "".join(c if c in letters else " " for c in t or "").split(" "):
            run = "".join(c.lower() if c in variants.UPPER else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if run and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] = counts.get(run, 0) + 1
    want = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    runs = variants.word_runs(df)
    got = variants.count_words(variants.delete_letters(runs, one_in=97))
    assert {r.word: r.n for r in got.collect()} == want and len(want) > 5
    check_variants(variants.group_variants(got).collect(), want)
    none = variants.group_variants(got.limit(0))
    assert none.count() == 0 and set(none.columns) == {"word", "n", "n_near", "form", "form_n", "root"}


# ---------------------------------------------------------------- periodic runs

def all_runs(w, least=12):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        first = None
        for i in range(q, n + 1):
            same = i < n and w[i] == w[i - q]
            if same and first is None:
                first = i
            elif not same and first is not None:
                start, first = first - q, None
                if i - start >= max(least, 2 * q):
                    out.setdefault((start, i - start), q)
    return sorted((s, size, q) for (s, size), q in out.items())


def test_runs_against_brute_force():
    rng = random.Random(5)
    total = 0
    for _ in range(600):
        letters, n = rng.choice([1, 2, 2, 3, 5, 20]), rng.randint(0, 160)
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 4) if n > 20 else 0):
            a = rng.randrange(n)
            p, size = rng.randint(1, max(1, (n - a) // 2)), rng.randint(0, n - a)
            for i in range(a, a + size):
                w[i] = w[a + (i - a) % p]
        want = all_runs(w)
        total += len(want)
        assert periodicity.find_runs(w) == want
        assert not want or periodicity.repetitive(np.array(w), np.zeros(n, int), 1)[0]
    assert total > 400


def test_runs_of_long_periods_and_nested_ones():
    rng = random.Random(6)
    word = [0, 1]
    while len(word) < 900:
        word, fib = word + word[:rng.randint(1, len(word))], word
    texts = [word[:900], ([0, 1] * 150 + [2]) * 4, [0] * 700, ([0] * 13 + [1]) * 40]
    for _ in range(12):
        base = [rng.randrange(rng.choice([1, 2, 30])) for _ in range(rng.randint(1, 400))]
        w = (base * (900 // len(base) + 1))[:rng.randint(500, 900)]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = 99
        texts.append(w)
    for w in texts:
        assert periodicity.find_runs(w) == all_runs(w)


def test_a_long_repetition_is_cheap():
    assert periodicity.find_runs([0] * 200_000) == [(0, 200_000, 1)]


def report(key, text):
    words = [w for w in (text or "").translate({ord(c): " " for c in SPACES}).split(" ") if w]
    h = zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (len(runs), *top, None if top[0] is None else 1000 * top[1] // top[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_run_report(spark, documents):
    short = {k: t for k, t in documents.items() if len(t or "") < 12_000}
    got = {r[0]: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert set(got) == set(documents)
    assert {k: got[k] for k in short} == {k: report(k, t) for k, t in short.items()}
    assert sum(r[0] for r in got.values()) > 10


def test_run_report_edges(spark):
    rows = [(1, "a b " * 9), (1, "a b " * 9), (2, None), (3, ""), (4, " \t\n"), (None, "x " * 12), (5, "x\x0b" * 11),
            (6, "one two three"), (7, "word other thing " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    got = {}
    for r in periodicity.run_report(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [r.n_runs for r in got[1]] == [1, 1] and got[1][0].period == 2 and got[1][0].exponent_milli == 9000
    empty = hashlib.sha256(b"").hexdigest()
    assert all(got[k][0].collapsed_sha256 == empty and got[k][0].start is None for k in (2, 3, 4))
    assert got[None][0].length == 12 and got[5][0].n_runs == 0 and got[7][0].length == 90_000
    assert got[None][0].collapsed_sha256 == hashlib.sha256(b"x").hexdigest()
    runs = {tuple(r) for r in periodicity.find_periodic_runs(df.where("doc_id = 7 OR doc_id IS NULL")).collect()}
    assert runs == {(None, 0, 12, 1), (7, 0, 90_000, 3)}
    assert periodicity.run_report(df.limit(0)).count() == 0
