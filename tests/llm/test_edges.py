"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from editrisk.llm import (ann, blocknames, bpe, langid, linededup, minhash, mixing, queries, tokencount,
                          url_trie, warc)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, key string, id long"
LONG = "word other thing " * 30_000
ROWS = [
    (1, "the same text of six words", "en", "a", 5, "h", "k", 9),
    (1, "the same text of six words", "en", "a", 5, "h", "k", 9),
    (2, "the same  text of six\twords", "en", None, 5, None, None, None),
    (3, None, None, "a", None, None, None, None),
    (4, "", "fr", "b", 0, "x", "y", 1),
    (5, " \n\t ", None, "b", 4, "x", "y", 1),
    (None, "un autre texte", "fr", "b", 4, "x", "y", 1),
    (6, LONG, "en", "b", None, "x", "y", 1),
    (7, LONG + "end", "en", None, None, "x", "y", 1),
    (8, "12 34 !!", "en", "c", 8, "x", "y", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_near_duplicates(docs, none):
    got = by_id(minhash.near_duplicates(docs, words=2))
    assert sum(map(len, got.values())) == len(ROWS)
    assert [r.component_id for r in got[1]] == [1, 1] and got[2][0].component_id == 1 and not got[2][0].kept
    assert got[7][0].component_id == 7  # 3 of 4 shingles in common
    assert (got[3][0].n_shingles, got[3][0].component_id, got[3][0].kept) == (0, 3, True)
    assert got[4][0].component_id == 4 and got[5][0].component_id == 5 and got[None][0].component_id is None
    assert minhash.near_duplicates(none).count() == 0


def test_exact_duplicates(docs, none):
    got = by_id(blocknames.exact_duplicates(docs, block_bytes=4))
    assert sorted(r.kept for r in got[1]) == [False, False] and got[2][0].kept  # the longest original
    assert {got[i][0].keep_id for i in (3, 4, 5)} == {5} and got[3][0].group_size == 3
    assert got[3][0].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[6][0].kept and got[7][0].kept and got[None][0].keep_id is None
    assert blocknames.exact_duplicates(none).count() == 0


def test_names_do_not_depend_on_the_block_size(docs):
    keep = lambda n: sorted(map(tuple, blocknames.exact_duplicates(docs, block_bytes=n).collect()), key=str)
    assert keep(7) == keep(100_000)


def test_mixing(docs, none):
    got = by_id(mixing.mix_report(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[3][0].size == 0 and got[6][0].size == 90_000
    assert all(0 <= r.taken <= 3 * r.size for rows in got.values() for r in rows)
    targets = {r.source: (r.source_size, r.target) for r in mixing.mix_report(docs).join(
        docs.select("doc_id", "source"), "doc_id").collect()}
    assert sum(t for _, t in targets.values()) == pytest.approx(sum(s for s, _ in targets.values()))
    assert all(t <= 3 * s + 1e-9 for s, t in targets.values())
    again = by_id(mixing.mix_report(docs.repartition(5)))
    assert {k: sorted(v) for k, v in again.items()} == {k: sorted(v) for k, v in got.items()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.where("text is not null").select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] > 0
    assert mixing.mix(none).count() == 0 and mixing.mix_report(none).count() == 0


def test_line_dedup(spark, none):
    rows = [(i, f"menu\n\nown {i}\nmenu" if i else None, "a") for i in range(12)]
    rows += [(i, f"foot\nown {i}", None) for i in range(60, 72)] + [(50, "menu\nx", "b"), (51, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__lines_", F.lit(1))
    got = {r.doc_id: r for r in linededup.drop_boilerplate(df, counts=True).collect()}
    assert got[3].text == "\nown 3" and (got[3].n_lines, got[3].n_dropped) == (4, 2)
    assert got[0].text is None and got[0].n_lines == 0
    assert got[50].text == "menu\nx" and got[51].text == ""  # a small site
    assert got[60].text == "own 60"  # a null site is a site
    assert linededup.drop_boilerplate(none).count() == 0


def test_language(docs, none):
    model = langid.train(docs.where("lang is not null"), langid.Settings(min_df=1))
    got = by_id(langid.identify(docs, model))
    assert got[3][0].lang_pred == got[4][0].lang_pred == got[5][0].lang_pred == got[8][0].lang_pred == "und"
    assert got[3][0].score == 0.0 and 0 < got[6][0].score <= 1
    assert got[None][0].lang_pred in ("en", "fr")
    empty = langid.train(none)
    assert empty.labels == [] and {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_sample_does_not_depend_on_the_hash_limit(spark, monkeypatch):
    """Only hashes below a limit are ranked; the least ones, those of the sample, are all below it."""
    rows = [(i, f"{'le mot' if i % 3 else 'the word'} {i * 7919 % 997} x{i % 13}", "fr" if i % 3 else "en") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    settings = langid.Settings(max_train_docs=40, dim=1 << 10)
    limited = langid.train(df, settings)
    monkeypatch.setattr(langid, "_hash_limit", lambda share: (1 << 63) - 1)
    whole = langid.train(df, settings)
    assert (limited.weights == whole.weights).all() and limited.temperature == whole.temperature


def test_hash_limit():
    assert langid._hash_limit(1.0) == langid._hash_limit(7.0) == (1 << 63) - 1
    assert langid._hash_limit(0.5) == 0 and -(1 << 63) <= langid._hash_limit(1e-12) < -(1 << 62)


def test_tokens_and_codec(docs, none):
    got = by_id(tokencount.count_tokens(docs, queries.COUNT_VOCABULARY))
    assert got[3][0].n_tokens == got[4][0].n_tokens == 0 and got[3][0].n_bytes == 0
    assert got[6][0].over_limit and len({r.n_tokens for r in got[1]}) == 1
    coded = bpe.round_trip(docs, queries.BPE_RANKS, queries.BPE_PATTERN)
    for rows in by_id(coded).values():
        for r in rows:
            assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    two = bpe.decode(bpe.encode(docs, queries.BPE_RANKS, queries.BPE_PATTERN), queries.BPE_RANKS, queries.BPE_PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in two.collect())
    assert bpe.round_trip(none, queries.BPE_RANKS, queries.BPE_PATTERN).count() == 0


def test_urls(spark):
    urls = [None, "no scheme", "http://", "HTTP://Example.NET/en/x", "http://a.example.net/en", "https://x.org/fr/?q=/de/",
            "ftp://org/fr/a#b", "http://net?x", "a://b://net/", "http://notexample.com/de/", "http://example.com/de/1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in url_trie.filter_urls(df, queries.URL_RULES).collect()}
    rules = [got[i].rule for i in range(len(urls))]
    assert rules == [None, None, None, "example.net/en/", "net/", "org/fr/", "org/fr/", None, None, None, "example.com/de/"]
    assert (got[0].host, got[0].path) == ("", "") and got[3].host == "example.net"
    joined = url_trie.filter_urls_joined(df, spark.createDataFrame(queries.URL_RULES, "host string, path string, action string"))
    assert sorted(joined.collect(), key=str) == sorted(url_trie.filter_urls(df, queries.URL_RULES).collect(), key=str)
    clash = [("x.org", "/a", "allow"), ("x.org", "/a", "block"), ("", "/a/b", "allow")]
    one = spark.createDataFrame([(1, "http://y.x.org/a/bc")], "page_id long, url string")
    assert url_trie.filter_urls(one, clash).first().verdict == "block"


def test_warc(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "http://a/", big, 1), (2, "http://b/\r\nWARC-Type: evil", big, 2), (3, None, "small", 3), (4, "u", "small", 4),
            (5, "u", None, 5), (None, "u", big, 6), (7, "u", "", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload long")
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    assert (got[1].record_type, got[1].refers_to, got[1].payload_bytes) == ("revisit", 2, 1500)
    assert got[2].record_type == got[3].record_type == got[4].record_type == "response"
    assert got[5].payload_bytes == 0 and got[None].record_type == "revisit" and got[None].refers_to == 2
    assert got[3].payload_digest == hashlib.sha1(b"small").hexdigest()
    path = warc.write_archive(pages, str(tmp_path / "archive"))
    assert spark.read.parquet(f"{path}/payloads").count() == 3  # each distinct payload once
    records = warc.read_archive(spark, path)
    back = warc.import_warc(spark, warc.export_warc(records, str(tmp_path / "files")))
    want = sorted((r.record_id or "", r.record_type, bytes(r.payload) if r.record_type == "response" else b"")
                  for r in records.collect())
    assert sorted((r.record_id or "", r.record_type, bytes(r.payload)) for r in back.collect()) == want
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_damaged_payload_fails(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    path = warc.write_archive(pages, str(tmp_path / "a"))
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"abd")).write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(f"{path}/headers").write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()


def test_neighbours(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []),
            (6, [0.0, 0.0]), (7, [1.0, None]), (8, [inf, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (40, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 2, 0.5)]
    assert len(ann.nearest(df, F.col("vec_id") == 0, k=20).collect()) == 4
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_pipeline_stages(spark, docs, none):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        out.collect()
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns, name
        assert stage(spark, none, "").count() == 0


def test_near_duplicate_stage_tells_rows_apart(spark, tmp_path):
    x, y, z = ("one two three four five six seven eight", "nothing of the first text is said in here at all",
               "a third text that stands for itself and has no copy")
    rows = [(None, x), (1, x), (None, y), (None, z), (None, z), (2, z + " "), (3, None), (3, None), (4, ""),
            (5, "repeated row of one id with six words"), (5, "repeated row of one id with six words"),
            (5, "another text that has the same id as they have"), (None, None)]
    want = [(None, y), (1, x), (2, z + " "), (3, None), (3, None), (4, ""), (None, None),
            (5, "repeated row of one id with six words"), (5, "another text that has the same id as they have")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.repartition(3).write.parquet(str(tmp_path / "docs"))
    for docs in (df, spark.read.parquet(str(tmp_path / "docs"))):
        got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        assert got.columns == ["doc_id", "text"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    # a table with null ids only: copies go, texts of their own stay
    nulls = spark.createDataFrame([(None, x), (None, x), (None, y)], "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, nulls, "").collect()
    assert sorted(r.text for r in got) == sorted([x, y])


def test_copied_documents_are_no_boilerplate(spark):
    copied = "\n".join(f"line {i} of a text that was copied often" for i in range(6))
    rows = [(i, f"menu of the site\nown words of page {i} and {i * 7} more\nthat say {i * i} things", "a")
            for i in range(40)]
    rows += [(i, copied, "a" if i % 2 else None) for i in range(100, 120)]
    rows += [(i, None, None) for i in range(200, 230)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    cut = corpus_pipeline.drop_site_boilerplate(spark, df, "")
    got = {r.doc_id: r for r in cut.collect()}
    assert len(got) == len(rows)
    assert all(got[i].text == copied and got[i].n_chars == len(copied) for i in range(100, 120))
    assert got[3].text == "own words of page 3 and 21 more\nthat say 9 things" and got[200].text is None
    left = corpus_pipeline.drop_near_duplicates(spark, cut, "").collect()
    assert [(r.doc_id, r.text) for r in left if r.text == copied] == [(100, copied)]
    assert not [r for r in left if r.text == ""]


def test_null_and_repeated_ids_come_near_their_target(spark):
    """Equal rows take their steps of the sum one by one, in the report and in the mix."""
    words = lambda n, x: " ".join([x] * n)
    rows = [(None if i % 3 == 0 else i % 50, words(1 + i % 11, f"w{i % 4}"), "abc"[i % 2], i) for i in range(600)]
    rows += [(None, "same text", "c", 1)] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(5)
    size = {s: sum(len(t.split()) for _, t, x, _ in rows if x == s) for s in "abc"}
    report = mixing.mix_report(df).collect()
    assert len(report) == len(rows)
    target = {r.source_size: r.target for r in report}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    got = [tuple(r) for r in mixed.collect()]
    for s in "abc":
        taken = sum(len(t.split()) for _, t, x, _ in got if x == s)
        assert abs(taken - target[size[s]]) <= 11
        assert taken == sum(r.taken for r in report if r.source_size == size[s])
    from collections import Counter
    have, out = Counter(rows), Counter(got)
    assert set(out) <= set(have) and all(n <= 3 * have[r] for r, n in out.items())
