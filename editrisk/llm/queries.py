"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editrisk.llm import (ann, blocknames, bpe, langid, linededup, minhash, mixing, periodicity, tokencount,
                          url_trie, variants, warc, wordbpe)

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
COUNT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BPE_PATTERN = public_tokenizers.PATTERN
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_trie.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the documents on two-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the pages, written to an archive and read back."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out("doc_id"))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with equal texts, white space apart."""
    return blocknames.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, COUNT_VOCABULARY).drop("text")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its site's boilerplate lines (a source is a site)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.drop_boilerplate(docs, counts=True)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, BPE_RANKS, BPE_PATTERN).drop("text")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest vectors of every twentieth vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the word vocabulary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wordbpe.round_trip(docs, WORD_VOCABULARY).drop("text")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents with their near words' counts, form and root."""
    runs = variants.word_runs(table(spark, sf_dir, "documents"))
    return variants.group_variants(variants.count_words(variants.delete_letters(runs, one_in=97)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, of which every tenth is made periodic first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodicity.run_report(docs, repeat_one_in=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_url_filter, op2_minhash_near_dedup, op3_source_mixing, op4_warc_archive, op5_language_id,
        op6_exact_dedup, op7_token_counts, op8_line_dedup, op9_bpe_codec, op10_nearest_neighbours,
        op11_word_bpe, op12_spelling_variants, op13_periodic_runs)}

WORDS_SQL = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

#: SQL for the queries that it can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": r"""
        WITH u AS (
          SELECT page_id,
                 translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
          FROM pages),
        r AS (
          SELECT *, CASE
            WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
          FROM u)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM r""",
    "op3_source_mixing": rf"""
        WITH d AS (SELECT doc_id, source, CAST({WORDS_SQL} AS BIGINT) AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
                     3.0::DOUBLE * source_size AS most FROM s),
        o AS (SELECT *, row_number() OVER (ORDER BY most / w, source NULLS LAST) AS pos FROM w),
        l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE
                         - coalesce(sum(most) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
              FROM o),
        t AS (SELECT source, source_size, least(most, w * (SELECT arg_min(level, pos) FROM l WHERE level <= most / w)) AS target FROM l),
        k AS (SELECT d.*, t.source_size, t.target,
                     CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
                     row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS r,
                     CAST('0x' || substr(md5('7|' || coalesce('=' || d.source, 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST((floor(r * rate + u) - floor((r - 1) * rate + u)) * size AS BIGINT) AS taken
        FROM k""",
    "op4_warc_archive": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                          sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS payload FROM pages),
        h AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS holder FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to
        FROM h""",
    "op6_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
        g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY t) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
    "op8_line_dedup": r"""
        WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, source, unnest(list_distinct(lines)) AS line FROM d),
        b AS (SELECT source, line FROM l
              JOIN (SELECT source AS host, count(*) AS total FROM documents GROUP BY source) t
                ON source IS NOT DISTINCT FROM t.host
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
              GROUP BY source, line, total HAVING count(*) >= 5 AND count(*) > 0.1::DOUBLE * total),
        s AS (SELECT source, list(line) AS bad FROM b GROUP BY source),
        k AS (SELECT doc_id, d.source, text, lines,
                     list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS kept
              FROM d LEFT JOIN s ON d.source IS NOT DISTINCT FROM s.source)
        SELECT doc_id, source, array_to_string(kept, chr(10)) AS text,
               coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped
        FROM k""",
    "op12_spelling_variants": r"""
        WITH RECURSIVE
        d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id,
                     unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
        r AS (SELECT id, run, count(*) AS c FROM d WHERE length(run) >= 5 GROUP BY id, run),
        b AS (SELECT run, c, encode(id || ':' || run)::BIT AS bits FROM r),
        h AS (SELECT run, c, xor(4294967295::BIGINT, list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(range(bit_length(bits)),
                  lambda i: get_bit(bits, ((i // 8) * 8 + 7 - i % 8)::INT)::BIGINT)),
                lambda s, x: xor(s >> 1, 3988292384::BIGINT * (xor(s, x) & 1)))) AS h FROM b),
        w AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                          ELSE run END AS word, c FROM h),
        v AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
        o AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
        k AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS z FROM o),
        pairs AS (SELECT x.word, y.word AS near, y.n AS near_n FROM k x JOIN k y ON x.a = y.a AND x.z = y.z AND x.i = y.i AND x.word <> y.word
                  UNION SELECT x.word, y.word, y.n FROM k x JOIN v y ON x.a || x.z = y.word
                  UNION SELECT y.word, x.word, x.n FROM k x JOIN v y ON x.a || x.z = y.word),
        best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * v.n THEN
                     (SELECT min(near) FROM pairs p WHERE p.word = v.word AND p.near_n = top) END AS form,
                     CASE WHEN top >= 2 * v.n THEN top END AS form_n
              FROM v LEFT JOIN best ON v.word = best.word),
        walk AS (SELECT word, word AS at, form AS next FROM f
                 UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON walk.next = f.word)
        SELECT f.word, f.n, f.n_near, f.form, f.form_n, walk.at AS root FROM f JOIN walk ON f.word = walk.word AND walk.next IS NULL""",
}
