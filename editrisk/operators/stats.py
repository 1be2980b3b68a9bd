"""Corpus and per-value statistics (all grouped aggregates, no row joins).

Result tables are long and small (one row per value, slice or split);
ordering is expressed with ``orderBy`` on the small table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles_of

# Slice and class names of the corpus tables.
SLICES = [("ALL", None), ("ITEM_HEAD", ["TEXT"]), ("ITEM_BODY", ["STATEMENT", "SITELINK"])]
CLASSES = ["Total", "Vandalism", "Regular"]
TOP_K = 5


def _as_text(c: Column) -> Column:
    """The value as text, missing -> 'nan' (the reference casts to str)."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def value_risk(df: DataFrame, value: str | Column, label: str = "label",
               out: str = "value") -> DataFrame:
    """Per value: positives, total and their ratio, most positives first."""
    v = F.col(value) if isinstance(value, str) else value
    return (df.groupBy(_as_text(v).alias(out))
              .agg(F.sum(F.col(label).cast("bigint")).alias("vandalismRevisions"),
                   F.count(F.lit(1)).alias("totalRevisions"))
              .withColumn("vandalismProbability",
                          F.col("vandalismRevisions") / F.col("totalRevisions"))
              .orderBy(F.desc("vandalismRevisions"), F.asc(out)))


def _ordered(t: DataFrame, out: str) -> DataFrame:
    # 'misc' then 'nan' at the end, the rest by positives (ties by value)
    tail = F.when(F.col(out) == "nan", 2).when(F.col(out) == "misc", 1).otherwise(0)
    return t.orderBy(tail, F.desc("vandalismRevisions"), F.asc(out))


def regroup(risk: DataFrame, mapping: Column, out: str = "value") -> DataFrame:
    """Re-aggregate a ``value_risk`` table after mapping its values."""
    t = (risk.groupBy(mapping.alias("__m"))
             .agg(F.sum("vandalismRevisions").alias("vandalismRevisions"),
                  F.sum("totalRevisions").alias("totalRevisions"))
             .withColumnRenamed("__m", out)
             .withColumn("vandalismProbability", F.col("vandalismRevisions") / F.col("totalRevisions")))
    return _ordered(t, out)


def value_risk_mapped(df: DataFrame, value: str, mapping: Callable[[Column], Column],
                      label: str = "label", out: str = "value") -> DataFrame:
    """``value_risk`` after mapping each value to its class."""
    risk = value_risk(df, value, label, out)
    return regroup(risk, mapping(F.col(out)), out)


def value_risk_topk(df: DataFrame, value: str,
                    mapping: Callable[[Column], Column] | None = None,
                    label: str = "label", out: str = "value", k: int = TOP_K) -> DataFrame:
    """Top-k values by positives, the rest folded into 'misc', 'nan' kept,
    and a first row 'nonNan' over all non-missing values."""
    risk = value_risk(df, value, label, out)
    if mapping is not None:
        risk = regroup(risk, mapping(F.col(out)), out)
    non_nan = risk.where(F.col(out) != "nan")
    # k rows: a broadcast bounded by k
    top = (non_nan.orderBy(F.desc("vandalismRevisions"), F.asc(out)).limit(k)
                  .select(F.col(out).alias("__top")))
    tagged = risk.join(F.broadcast(top), F.col(out) == F.col("__top"), "left")
    folded = F.when(F.col(out) == "nan", F.lit("nan")).when(F.col("__top").isNotNull(), F.col(out)) \
              .otherwise(F.lit("misc"))
    truncated = regroup(tagged, folded, out)
    first = (non_nan.agg(F.sum("vandalismRevisions").alias("vandalismRevisions"),
                         F.sum("totalRevisions").alias("totalRevisions"))
                    .where(F.col("totalRevisions").isNotNull())
                    .select(F.lit("nonNan").alias(out), "vandalismRevisions", "totalRevisions",
                            (F.col("vandalismRevisions") / F.col("totalRevisions")).alias("vandalismProbability")))
    rank = F.when(F.col(out) == "nonNan", 0).when(F.col(out) == "nan", 3) \
            .when(F.col(out) == "misc", 2).otherwise(1)
    return (first.unionByName(truncated)
                 .orderBy(rank, F.desc("vandalismRevisions"), F.asc(out)))


def percent_table(t: DataFrame) -> DataFrame:
    """Display form: counts in thousands (half-even), probability in percent."""
    from ..functions.scalars import round_thousands
    return t.select(t.columns[0], round_thousands(F.col("vandalismRevisions")).alias("vandalismRevisions"),
                    round_thousands(F.col("totalRevisions")).alias("totalRevisions"),
                    (F.col("vandalismProbability") * 100).alias("vandalismProbability"))




def distinct_counts(df: DataFrame, tags: dict[tuple[str, str], Column],
                    entities: Sequence[tuple[str, str]], tag_names: tuple[str, str]) -> DataFrame:
    """Distinct entities per tag, for overlapping tags, without exploding rows.

    For every entity column one ``groupBy(entity)`` ORs the tag flags (map-side
    partial aggregation keeps one row per entity and task), then the flags are
    summed.  The long result has one row per tag and one column per entity.
    """
    flags = {f"__t{i}": c for i, c in enumerate(tags.values())}
    keys = list(tags.keys())
    base = df.select(*[F.col(c) for _, c in entities],
                     *[F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in flags.items()])
    parts = []
    for name, col in entities:
        per_entity = base.where(F.col(col).isNotNull()).groupBy(col).agg(
            *[F.max(n).alias(n) for n in flags])
        sums = per_entity.agg(*[F.sum(n).alias(n) for n in flags])
        # unpivot the one-row sums to (tag index, count)
        parts.append(sums.select(F.lit(name).alias("__entity"), F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias("n"))
            for i, n in enumerate(flags)])).alias("__v")).select("__entity", "__v.i", "__v.n"))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    wide = long.groupBy("i").pivot("__entity", [n for n, _ in entities]).agg(F.first("n"))
    a, b = tag_names
    tag_a = F.element_at(F.array(*[F.lit(k[0]) for k in keys]), F.col("i") + 1)
    tag_b = F.element_at(F.array(*[F.lit(k[1]) for k in keys]), F.col("i") + 1)
    return wide.select(tag_a.alias(a), tag_b.alias(b), *[F.col(n).cast("bigint").alias(n) for n, _ in entities])


def corpus_statistics(df: DataFrame, label: str = "label", slice_col: str = "contentType",
                      revision: str = "revisionId", session: str = "groupId",
                      item: str = "itemId", user: str = "userName") -> DataFrame:
    """Distinct revisions, sessions, items, users per (slice, class).

    Slices overlap (ALL contains HEAD and BODY) and 'Total' includes rows
    without a label: 9 tags, 36 numbers, four grouped passes.
    """
    y = F.col(label).cast("boolean")
    classes = {"Total": F.lit(True), "Vandalism": y == F.lit(True), "Regular": y == F.lit(False)}
    tags = {}
    for sname, vals in SLICES:
        in_slice = F.lit(True) if vals is None else F.col(slice_col).isin(*vals)
        for cname, cond in classes.items():
            tags[(sname, cname)] = in_slice & cond
    ents = [("Revisions", revision), ("Sessions", session), ("Items", item), ("Users", user)]
    return distinct_counts(df, tags, ents, ("slice", "class"))


def dataset_statistics(df: DataFrame, bounds: Sequence, col: str = "revisionId",
                       names: Sequence[str] = ("Training", "Validation", "Test"),
                       revision: str = "revisionId", session: str = "groupId",
                       item: str = "itemId", user: str = "userName") -> DataFrame:
    """The four distinct counts per split; splits are half-open ranges
    ``[bounds[i], bounds[i+1])``."""
    from .splits import _lit
    tags = {}
    for i, name in enumerate(names):
        tags[(name, "")] = (F.col(col) >= _lit(bounds[i], df, col)) & (F.col(col) < _lit(bounds[i + 1], df, col))
    ents = [("Revisions", revision), ("Sessions", session), ("Items", item), ("Users", user)]
    return distinct_counts(df, tags, ents, ("split", "__none")).drop("__none")


def vandalism_fraction(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.avg(F.col(label).cast("double")).alias("vandalism_fraction"))


def describe_all(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: count, unique, top, freq (text columns) and mean, std,
    min, quartiles, max (numeric columns); one row per column.

    All plain aggregates run in one ``agg``; unique, top and freq come from one grouped
    count of all text columns; all quartiles from one selection (``quantiles``).
    """
    cols = list(columns) if columns is not None else df.columns
    numeric, text = [], []
    for f in df.schema.fields:
        if f.name not in cols:
            continue
        t = f.dataType.typeName()
        if t in ("integer", "long", "float", "double", "short", "byte", "decimal"):
            numeric.append(f.name)
        else:
            # text, category and boolean columns: count, unique, top, freq
            text.append(f.name)
    aggs = []
    for c in numeric:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    for c in text:
        aggs.append(F.count(c).alias(f"{c}__count"))
    row = df.agg(*aggs).first().asDict() if aggs else {}
    quart = exact_quantiles_of(df, {c: c for c in numeric}, [0.25, 0.5, 0.75])
    rows = []
    for c in numeric:
        q = quart[c]
        rows.append((c, row[f"{c}__count"], None, None, None, row[f"{c}__mean"], row[f"{c}__std"],
                     row[f"{c}__min"], q[0], q[1], q[2], row[f"{c}__max"]))
    # distinct values, top value and its frequency of ALL text columns in one grouped pass:
    # (column, value) pairs, counted with partial aggregation, then reduced per column
    tops = {}
    if text:
        pairs = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in text])).alias("p"))
        counts = pairs.where(F.col("p.v").isNotNull()).groupBy("p.c", "p.v").count()
        for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min(
                F.struct((-F.col("count")).alias("less"), "v")).alias("top")).collect():
            tops[r["c"]] = (r["top"]["v"], -r["top"]["less"], r["n"])
    for c in text:
        t, fq, unique = tops.get(c, (None, None, 0))
        if t is not None and dict(df.dtypes)[c] == "boolean":
            t = "True" if t == "true" else "False"
        rows.append((c, row[f"{c}__count"], unique, t, fq, None, None, None, None,
                     None, None, None))
    schema = ("column string, count bigint, unique bigint, top string, freq bigint, mean double, "
              "std double, min double, q25 double, q50 double, q75 double, max double")
    # one row per described column: a small, bounded table built on the driver
    return df.sparkSession.createDataFrame(rows, schema)
