"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed bigrams and trigrams of the lower-cased letters of the whole
text (everything that is neither letter nor mark is one separator), with
1 + log(tf) times a smoothed idf, scaled to unit length.  Document frequencies are counted
over all labelled training documents.  The classifier is fitted on a bounded sample
of them (``max_train_docs``, the same number of each language where there are as
many) by follow-the-regularised-leader with elastic-net penalties; a tenth of the sample is
kept out of the fit and sets the temperature of the probabilities.

The driver holds the sample's sparse features and the weights (``dim`` times languages);
both have fixed bounds.  Every document is scored where it lies.

Defined results: null text or text without a letter gets ``und`` and score 0; so
does every text if there is nothing to learn from; rows with null language are
never learned from; a null id counts as an empty one in the hold-out rule; repeated
rows are scored alike.  Only the text decides a prediction; other columns may have any
name.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editrisk.llm.common import tidy

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    dim: int = 1 << 15          # hashed features
    max_train_docs: int = 5000  # bound of the sample that the classifier is fitted on
    min_df: int = 2             # a feature is used from so many training documents on
    epochs: int = 4
    alpha: float = 0.3          # FTRL learning rate
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.001
    seed: int = 11


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the symbol it counts as (0: separator), and whether it is a letter."""
    if not _TABLES:
        symbol, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind in "LM":
                symbol[c], letter[c] = c, kind == "L"
        _TABLES.append((symbol, letter))
    return _TABLES[0]


def features(text: str | None, dim: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Feature numbers and 1 + log(tf) of a whole text; None without a letter."""
    if not text:
        return None
    symbol, letter = _tables()
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    if not letter[points].any():
        return None
    s = np.concatenate([[0], symbol[points], [0]]).astype(np.uint64)
    s = s[(s != 0) | np.concatenate([[True], s[:-1] != 0])]
    pair = s[:-1] * np.uint64(0x9E3779B97F4A7C15) + s[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    triple = pair[:-1] * np.uint64(0x165667B19E3779F9) + s[2:] * np.uint64(0x27D4EB2F165667C5)
    shift = np.uint64(64 - int(math.log2(dim)))
    mixed = np.concatenate([pair, triple])
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> shift
    counts = np.bincount(mixed.astype(np.int64), minlength=dim)
    idx = np.flatnonzero(counts)
    return idx, 1.0 + np.log(counts[idx])


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray      # 0 where a feature is not used
    weights: np.ndarray  # dim x labels
    bias: np.ndarray
    temperature: float = 1.0
    dim: int = field(default=0)

    def logits(self, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        idx, x = scaled(found, self.idf)
        return x @ self.weights[idx] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text, self.dim) if self.labels else None
        if found is None:
            return UNDETERMINED, 0.0
        p = softmax(self.logits(found) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def scaled(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    idx, tf = found
    x = tf * idf[idx]
    norm = math.sqrt(float(x @ x))
    return idx, (x / norm if norm else x)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_labels: int,
             s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over scaled sparse rows (idx, x, label): weights and bias.

    Per coordinate, w = -(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2) where
    |z| > l1, else 0.  The bias is the last coordinate and has no penalty.
    """
    z, n = np.zeros((s.dim + 1, n_labels)), np.zeros((s.dim + 1, n_labels))

    def weights(zi, ni, l1, l2):
        return -np.sign(zi) * np.maximum(np.abs(zi) - l1, 0.0) / ((s.beta + np.sqrt(ni)) / s.alpha + l2)

    rng = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for r in rng.permutation(len(rows)):
            idx, x, label = rows[r]
            zi, ni = z[idx], n[idx]
            w, b = weights(zi, ni, s.l1, s.l2), weights(z[-1], n[-1], 0.0, 0.0)
            error = softmax(x @ w + b)
            error[label] -= 1.0
            for at, old_z, old_n, g, now in ((idx, zi, ni, x[:, None] * error, w),
                                             (s.dim, z[-1], n[-1], error, b)):
                new_n = old_n + g * g
                z[at] = old_z + g - (np.sqrt(new_n) - np.sqrt(old_n)) / s.alpha * now
                n[at] = new_n
    w = weights(z, n, s.l1, s.l2)
    return w[:-1], weights(z[-1], n[-1], 0.0, 0.0)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood (golden section on its log)."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        z = logits / math.exp(log_t)
        top = z.max(axis=1)
        return float((top + np.log(np.exp(z - top[:, None]).sum(axis=1)) - z[np.arange(len(z)), labels]).mean())

    lo, hi, g = -3.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def held_out(id_col: str) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _hash_limit(share: float) -> int:
    """The signed 64-bit value that this share of all hashes does not exceed."""
    return (1 << 63) - 1 if share >= 1 else int(share * 2.0 ** 64) - (1 << 63)


def train(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "lang") -> Model:
    """Fit on the labelled rows of ``docs`` (the caller leaves held-out rows away)."""
    spark, dim = docs.sparkSession, settings.dim
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    per_label = {r[0]: r[1] for r in labelled.groupBy(label_col).count().orderBy(label_col).collect()}
    labels = list(per_label)
    if not labels:
        return Model([], np.zeros(dim), np.zeros((dim, 0)), np.zeros(0), dim=dim)

    @tidy
    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(dim, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                found = features(text, dim)
                if found is not None:
                    df[found[0]] += 1
                    n += 1
        used = np.flatnonzero(df)
        yield pd.DataFrame({"feature": np.append(used, -1), "df": np.append(df[used], n)})

    counted = (labelled.select(F.col(text_col).alias("text")).mapInPandas(frequencies, "feature int, df long")
               .groupBy("feature").agg(F.sum("df").alias("df")).toPandas())
    df = np.zeros(dim)
    real = counted[counted["feature"] >= 0]
    df[real["feature"]] = real["df"]
    n_docs = float(counted.loc[counted["feature"] < 0, "df"].sum())
    idf = np.where(df >= settings.min_df, np.log((1.0 + n_docs) / (1.0 + df)) + 1.0, 0.0)

    quota = max(1, settings.max_train_docs // len(labels))
    order = Window.partitionBy("label").orderBy("at", "id")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    # the hash below which a label has about 2 * quota + 200 rows: only those are ranked
    below = F.create_map(*[F.lit(x) for lab, n in per_label.items()
                           for x in (lab, _hash_limit((2 * quota + 200) / n))])
    chosen = (labelled.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                              F.xxhash64(F.lit(settings.seed), key).alias("at"))
              .where(F.col("at") <= below[F.col("label")])
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= quota)
              .select("id", "label", (F.pmod("at", F.lit(10)) == 0).alias("check")).dropDuplicates())
    # at most max_train_docs rows by construction
    mine = labelled.join(F.broadcast(chosen), labelled[id_col].eqNullSafe(chosen["id"])
                         & (labelled[label_col] == chosen["label"]))

    @tidy
    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(features(t, dim), lab, c, k) for t, lab, c, k in zip(
                batch["text"], batch["label"], batch["check"], batch["key"])]
            yield pd.DataFrame([(f[0].astype("<i4").tobytes(), f[1].astype("<f4").tobytes(), lab, c, k)
                                for f, lab, c, k in rows if f is not None],
                               columns=["idx", "tf", "label", "check", "key"])

    sample = (mine.select(labelled[text_col].alias("text"), "label", "check",
                          labelled[id_col].cast("string").alias("key"))
              .mapInPandas(sparse, "idx binary, tf binary, label string, check boolean, key string")
              .orderBy("key", "label", "idx").limit(settings.max_train_docs).toPandas())
    rows, checks = [], []
    for r in sample.itertuples():
        found = np.frombuffer(r.idx, "<i4").astype(np.int64), np.frombuffer(r.tf, "<f4").astype(np.float64)
        (checks if r.check else rows).append((*scaled(found, idf), labels.index(r.label)))
    weights, bias = fit_ftrl(rows, len(labels), settings)
    logits = np.array([x @ weights[idx] + bias for idx, x, _ in checks]).reshape(len(checks), len(labels))
    temperature = fit_temperature(logits, np.array([c[2] for c in checks], dtype=int))
    return Model(labels, idf, weights.astype(np.float32), bias, temperature, dim)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the text goes to Python."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    @tidy
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = handle.value.predict
        for batch in texts:
            yield pd.DataFrame([predict(t) for t in batch], columns=["lang_pred", "score"])

    out = docs.withColumn("__judged", judge(F.col(text_col)))
    return out.withColumns({"lang_pred": F.col("__judged.lang_pred"),
                            "score": F.col("__judged.score")}).drop("__judged")
