"""Column expressions for the stateless steps (missing values, scaling, time).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
Missing is always SQL NULL; float NaN is never produced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType

# Largest finite float32 / float64 (what ``clamp_infinity``
# replaces +inf / -inf with).
FLOAT32_MAX = 3.4028234663852886e38
FLOAT64_MAX = 1.7976931348623157e308


def clamp_infinity(c: Column, dtype: DataType = DoubleType()) -> Column:
    """+inf -> largest finite value of the float type, -inf -> smallest."""
    top = FLOAT32_MAX if isinstance(dtype, FloatType) else FLOAT64_MAX
    return (F.when(c == F.lit(float("inf")), F.lit(top).cast(dtype))
             .when(c == F.lit(float("-inf")), F.lit(-top).cast(dtype))
             .otherwise(c))


def finite_float32(c: Column) -> Column:
    """Cast to float32; what lies beyond its range becomes its largest or smallest value."""
    return (F.when(c > F.lit(FLOAT32_MAX), F.lit(FLOAT32_MAX).cast("float"))
             .when(c < F.lit(-FLOAT32_MAX), F.lit(-FLOAT32_MAX).cast("float"))
             .otherwise(c.cast("float")))


def impute_string(c: Column) -> Column:
    return F.coalesce(c, F.lit("missing"))


def impute_constant(c: Column, value: float, dtype: DataType = DoubleType()) -> Column:
    return clamp_infinity(F.coalesce(c.cast(dtype), F.lit(value).cast(dtype)), dtype)


def impute_zero(c: Column, dtype: DataType = DoubleType()) -> Column:
    return impute_constant(c, 0.0, dtype)


def impute_minus_one(c: Column, dtype: DataType = DoubleType()) -> Column:
    return impute_constant(c, -1.0, dtype)


def impute_boolean(c: Column) -> Column:
    """true/false -> 1/0, missing -> 0.5, as float32."""
    return F.coalesce(c.cast("float"), F.lit(0.5).cast("float"))


def null_indicator(c: Column) -> Column:
    return c.isNull()


def to_float32(c: Column) -> Column:
    return c.cast("float")


def log_scale(c: Column) -> Column:
    """sign(x) * ceil(log2(|x| + 1)); missing -> 0."""
    x = c.cast("double")
    return F.coalesce(F.signum(x) * F.ceil(F.log2(F.abs(x) + 1)).cast("double"), F.lit(0.0))


def sqrt_scale(c: Column) -> Column:
    """ceil(sqrt(x + 1)); missing stays missing (x < -1 gives missing, not NaN)."""
    x = c.cast("double") + 1
    return F.when(x >= 0, F.ceil(F.sqrt(x)).cast("double"))


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week(ts: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(ts)


def day_of_month(ts: Column) -> Column:
    return F.dayofmonth(ts)


TIME_UNITS = {"hourOfDay": hour_of_day, "dayOfWeek": day_of_week, "dayOfMonth": day_of_month}


def time_unit(ts: Column, unit: str) -> Column:
    if unit not in TIME_UNITS:
        raise ValueError(f"no such time unit: {unit}")
    return TIME_UNITS[unit](ts)


def logical_or(*cols: Column) -> Column:
    """OR over columns; a missing input counts as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in cols], F.lit(False))


def _uniform(key: Column, salt: str) -> Column:
    """A uniform value in (0, 1] from the first 52 bits of md5(key:salt)."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{salt}")))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (bits + 1.0) / F.lit(float(2 ** 52))


def normal_noise(key: Column, seed: int) -> Column:
    """Seeded N(0, 1) per row, stable under any partitioning.

    Two uniforms come from an md5 of the row key and the seed and are mapped
    by Box-Muller; ``randn`` would change with the partition layout.
    """
    u1 = _uniform(key, f"{seed}a")
    u2 = _uniform(key, f"{seed}b")
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * F.pi() * u2)


def round_thousands(c: Column) -> Column:
    """/1000 and round half-even, for display tables."""
    return F.bround(c.cast("double") / 1000.0, 0)


def classify_threshold(prob: Column, threshold: float = 0.5) -> Column:
    """Prediction from a score: strictly greater than the threshold."""
    return prob > F.lit(threshold)
