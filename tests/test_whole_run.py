"""Feature sets of the real log, steps with several outputs, and a run from file to tables."""

import pytest
from pyspark.sql import functions as F

from editrisk.operators import feature_steps as FS
from editrisk.operators import steps as ST
from editrisk.plans import feature_sets as SETS
from editrisk.plans import runs as RU
from editrisk.plans.catalog import Feature, feature_names, input_columns, output_columns
from editrisk.plans.pipeline import feature_pipeline
from editrisk.sources import schema as S

# the sets impute these; a log always has user names, items and raw counts
MISSING = {"literalValue", "userCity", "badWordRatio", "commentLength", "isLatinLanguage", "isHuman",
           "asciiRatio"}


@pytest.mark.parametrize("make, size", [(SETS.main, 47), (SETS.filter_baseline, 1), (SETS.diff_baseline, 45),
                                        (SETS.misc, 44)])
def test_sets_use_declared_columns_once_per_output(make, size):
    features = make()
    assert len(features) == size == len(feature_names(features))
    assert {c for inputs in input_columns(features) for c in inputs} <= set(S.DECLARED)


@pytest.fixture(scope="module")
def log_file(spark, tmp_path_factory):
    """A quoted CSV log with every declared column and missing cells."""
    rows = spark.range(600).withColumn("h", F.abs(F.hash("id")))
    cells = []
    for i, (name, kind) in enumerate(S.DECLARED_COLUMNS):
        n = F.abs(F.hash("id", F.lit(i)))
        cell = {S.INT: (n % 9).cast("string"), S.LONG: (n % 50).cast("string"),
                S.FLOAT: (n % 100 / 100).cast("string"), S.BOOL: F.when(n % 2 == 0, "T").otherwise("F")}.get(
            kind, F.concat(F.lit("v"), (n % 7).cast("string")))
        if name == "revisionId":
            cell = (F.col("id") + 3_000_000_000).cast("string")
        elif name == "timestamp":
            cell = F.date_format(F.timestamp_seconds(F.col("id") * 3600 + 1_400_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        elif name == "contentType":
            cell = F.when(n % 2 == 0, "TEXT").otherwise("STATEMENT")
        elif name in MISSING:
            cell = F.when(n % 5 == 0, "NA").otherwise(cell)
        cells.append(cell.alias(name))
    path = str(tmp_path_factory.mktemp("log") / "csv")
    rows.select(*cells).write.option("header", True).option("quoteAll", True).csv(path)
    return path


def test_run_from_file_to_tables(spark, log_file, tmp_path):
    bounds = lambda use_test: (3_000_000_000, 3_000_000_400, 3_000_000_500)
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    out = str(tmp_path / "out")
    systems = {s: SETS.SYSTEMS[s] for s in ("FILTER", "BASELINE")}
    names = RU.run_all(spark, log_file, out, systems, statistics=True, bounds=bounds)
    assert names == ["statistics"] + [f"metrics/time_label=VALIDATION/system={s}" for s in systems]
    m = spark.read.parquet(f"{out}/metrics")
    assert m.where("slice = 'ALL'").groupBy("system").count().orderBy("system").collect() == [
        ("BASELINE", 6), ("FILTER", 6)]
    assert m.where("slice = 'ALL' and positives + negatives != 100").count() == 0
    assert m.where("ROC not between 0 and 1 or PR not between 0 and 1").count() == 0
    assert spark.read.parquet(f"{out}/log").count() == 600
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= before


@pytest.mark.parametrize("make", [SETS.main, SETS.misc])
def test_features_of_a_loaded_log(spark, log_file, make):
    from editrisk.sources.csv_log import load_revisions
    features = make()
    t = feature_pipeline(load_revisions(spark, log_file), features, F.col("revisionId") < 3_000_000_400,
                         label=S.LABEL_COLUMN)
    names = feature_names(features)
    assert t.columns[4:-1] == names
    assert t.select(*[F.count(F.when(F.col(c).isNull() & (F.lit(c) != ""), 1)).alias(c) for c in names]
                    ).first().asDict() == dict.fromkeys(names, 0)


def test_category_and_text_steps_as_features(spark):
    words = ["good fine", "bad", None, "bad fine", "good", "bad bad"] * 5
    rows = [(i, 1, "TEXT", None, w, "a,b" if i % 2 else "b", i % 3 == 1) for i, w in enumerate(words)]
    log = spark.createDataFrame(rows, "revisionId long, groupId long, contentType string, timestamp timestamp, "
                                      "comment string, tag string, label boolean")
    features = [Feature("tag", [FS.one_hot()], "tagIs"),
                Feature("tag", [FS.most_frequent_tag(), ST.frequency()], "topTagFreq"),
                Feature("tag", [FS.long_tail(1)], "tailTag"),
                Feature(["tag", "label"], [FS.impact_code(0.0)], "tagImpact"),
                Feature("comment", [FS.word_length()], "words"),
                Feature("comment", [FS.char_length()], "characters"),
                Feature(["comment", "label"], [FS.bad_word_ratio(1, 0.4), ST.impute_zero()], "badWords"),
                Feature(["comment", "label"], [FS.comment_word_max(1)], "worstWord"),
                Feature(["comment", "label"], [FS.comment_score()], "commentScore")]
    t = feature_pipeline(log, features, None).orderBy("revisionId")
    assert output_columns(features, t.columns) == ["tagIs_a,b", "tagIs_b", *feature_names(features)[1:]]
    got = t.collect()
    assert [r["tagIs_b"] for r in got] == [1, 0] * 15
    assert [r["topTagFreq"] for r in got] == [30] * 30
    assert [r["tailTag"] for r in got] == [0, 15] * 15
    assert [round(r["tagImpact"], 4) for r in got] == [round(1 / 3, 4)] * 30
    assert [r["words"] for r in got] == [2, 1, -1, 2, 1, 2] * 5
    assert [r["characters"] for r in got] == [9, 3, -1, 8, 4, 7] * 5
    assert all(0 <= r["badWords"] <= 1 and 0 <= r["worstWord"] <= 1 for r in got)
