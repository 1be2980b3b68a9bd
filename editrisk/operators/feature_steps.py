"""Feature steps around the category and text operators.

Each is a ``CustomStep``; the operators that learn from the label take it as their last
input.  Steps that end with text (``most_frequent_tag``) are followed by another step,
such as ``steps.frequency``; ``one_hot`` gives a column per class, named
``{feature}_{class}``, ``one_hot_vector`` one sparse vector with a place per class.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from . import categories as G
from . import cumulative as C
from . import textmodels as X
from .steps import CustomStep, ExprStep


def char_length() -> ExprStep:
    return ExprStep(T.char_length, "char_length")


def word_length() -> ExprStep:
    return ExprStep(T.word_length, "word_length")


def most_frequent_tag() -> CustomStep:
    return CustomStep(lambda df, inputs, out, fit: G.most_frequent_tag(df, inputs[0], out, fit),
                      "most_frequent_tag")


def one_hot() -> CustomStep:
    return CustomStep(lambda df, inputs, out, fit: G.one_hot(df, inputs[0], out, fit), "one_hot", many=True)


def one_hot_vector() -> CustomStep:
    return CustomStep(lambda df, inputs, out, fit: G.one_hot_vector(df, inputs[0], out, fit), "one_hot_vector",
                      vector=True)


def long_tail(count: int) -> CustomStep:
    return CustomStep(lambda df, inputs, out, fit: G.long_tail(df, inputs[0], out, count), "long_tail")


def impact_code(alpha: float = 1.0) -> CustomStep:
    return CustomStep(lambda df, inputs, out, fit: G.impact_code(df, *inputs, out, alpha, fit), "impact_code")


def bad_word_ratio(min_words: int, threshold: float, key: str = C.ORDER) -> CustomStep:
    """A row without words stays missing: follow it by an imputer."""
    return CustomStep(lambda df, inputs, out, fit: X.bad_word_ratio(
        df, key, *inputs, out, min_words, threshold, fit), "bad_word_ratio")


def comment_word_max(min_rows: int = 5, key: str = C.ORDER) -> CustomStep:
    return CustomStep(lambda df, inputs, out, fit: X.comment_word_max(df, key, *inputs, out, min_rows, fit),
                      "comment_word_max")


def comment_score(c: float = 1.0, key: str = C.ORDER) -> CustomStep:
    return CustomStep(lambda df, inputs, out, fit: X.comment_score(
        df.withColumn(inputs[1], F.col(inputs[1]).cast("double")), key, *inputs, out, fit, c), "comment_score")
