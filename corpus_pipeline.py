"""From raw documents to token ids: language, lines, near copies, mix, encoding.

``STAGES`` lists the stages in order.  Each takes ``(spark, docs, sf_dir)`` and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.  ``run`` applies them.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows,
empty tables and extra columns, as its operator's docstring says.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editrisk.llm import bpe, langid, linededup, minhash, mixing
from editrisk.llm.common import store
from editrisk.llm.queries import BPE_PATTERN, BPE_RANKS
from editrisk.session import configure

#: A document is rejected without a letter, or when no language reaches this probability.
MIN_LANGUAGE_SCORE = 0.5
#: Characters encoded together: workers stand next to heaps that earlier stages have grown.
ENCODE_CHARS = 3_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the rest (null text, no letter, no language
    above ``MIN_LANGUAGE_SCORE``) go.  ``lang`` is left as it came."""
    model = langid.train(docs.where(~langid.held_out("doc_id")))
    judged = langid.identify(docs.withColumn("__row", F.struct(*docs.columns)).select("__row", F.col("text")), model)
    if not model.labels:  # nothing labelled to learn from: no grounds to reject a language
        judged = judged.withColumn("lang_pred", F.when(F.rlike("text", F.lit(r"\p{L}")), "?").otherwise("und"))
        return judged.where(F.col("lang_pred") != "und").select("__row.*")
    found = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return judged.where(found).select("__row.*")


def drop_site_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's distinct texts go; all rows stay, and
    ``n_chars`` follows the new text (as it came where the text did not change).  Copies
    are one page here: they are left to the next stage."""
    cut = linededup.drop_boilerplate(docs, counts=True, copies=False)
    if "n_chars" in docs.columns:
        n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, n_chars).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def with_row_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__file, __at``: a key of its own for every row, the same at each read.

    It is the row's place in its Parquet file; what is no plain table of Parquet files is
    written first."""
    relation = docs._jdf.queryExecution().analyzed()
    if relation.nodeName() != "LogicalRelation" or "parquet" not in relation.simpleString(100):
        docs = store(docs, "rows")
    place = docs.metadataColumn("_metadata")
    return docs.withColumns({"__file": F.xxhash64(place["file_path"]), "__at": place["row_index"]})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five words, similarity 0.8) stays: the one with
    the least id, null ids last.  Ids may be null or repeat: rows are told apart by their place."""
    keyed = with_row_keys(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "__file", "__at")
    groups = minhash.near_duplicates(keyed.select(key.alias("__key"), "text"), words=5, percent=80, id_col="__key")
    gone = store(groups.where(~F.col("kept")).select("__key.__file", "__key.__at"), "gone")
    return keyed.join(gone, ["__file", "__at"], "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix (sources weigh 5, 2, 1 in turn) takes them."""
    return mixing.mix(docs)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` with token count, packed ids, and the digest of ids and decoded bytes."""
    return bpe.round_trip(docs.select("doc_id", "text"), BPE_RANKS, BPE_PATTERN, keep_ids=True,
                          chunk_chars=ENCODE_CHARS).drop("text")


def _configured(stage):
    """The stage under the library's session settings (small Arrow batches)."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        configure(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [(name, _configured(stage)) for name, stage in (
    ("language ID", identify_language),
    ("line dedup", drop_site_boilerplate),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_documents),
)]

#: The language model cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store(docs, "stage")
    return docs
