"""Column-level helpers (JVM expressions only, so they stay inside whole-stage codegen).

Every helper returns a ``Column``; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash_key(*parts) -> Column:
    """``concat_ws('|', ...)`` of the parts cast to string — the seed text of every draw."""
    return F.concat_ws("|", *[_c(p).cast("string") if not isinstance(p, (int, float)) else F.lit(str(p))
                             for p in parts])


def hash_int32(*parts) -> Column:
    """Unsigned 32-bit integer from the first 8 hex digits of md5 — same value in any SQL engine."""
    return F.conv(F.substring(F.md5(hash_key(*parts)), 1, 8), 16, 10).cast("long")


def hash_uniform(*parts) -> Column:
    """Deterministic uniform number in [0, 1) that does not depend on partitioning."""
    return hash_int32(*parts).cast("double") / F.lit(TWO_POW_32)


def signed_sentiment(label, prob) -> Column:
    """F1: classifier output (label, probability) -> signed score in [-1, 1]."""
    p = _c(prob).cast("double")
    return F.when(_c(label) == F.lit("POSITIVE"), 2 * p - 1).otherwise(1 - 2 * p)


def valence_normalise(x, alpha: float = 15.0) -> Column:
    """F2 normalisation of a summed valence into [-1, 1]: x / sqrt(x^2 + alpha)."""
    x = _c(x).cast("double")
    return x / F.sqrt(x * x + F.lit(float(alpha)))


def sigmoid(x) -> Column:
    """F4."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def relu(x) -> Column:
    """F5."""
    return F.greatest(_c(x).cast("double"), F.lit(0.0))


def dot(a, b) -> Column:
    """F7 on two equal-length numeric arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a, b) -> Column:
    """F7 cosine; 0 when either side is the zero vector."""
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)


def l2_normalise_array(a) -> Column:
    """F6 on an array column; a zero vector stays zero."""
    n = norm(a)
    return F.transform(_c(a), lambda v: F.when(n == 0, F.lit(0.0)).otherwise(v.cast("double") / n))


def _v(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def pad_right(arr, length: int, value=0) -> Column:
    """Keep the first ``length`` items, pad behind with ``value``."""
    a = _c(arr)
    return F.concat(F.slice(a, 1, length),
                    F.array_repeat(_v(value), F.greatest(F.lit(0), F.lit(length) - F.size(a))))


def pad_left_keep_first(arr, length: int, value=0) -> Column:
    """P9 (faithful to the reference, Q2): over-long keeps the *first* items, short is padded in front."""
    a = _c(arr)
    return F.concat(F.array_repeat(_v(value), F.greatest(F.lit(0), F.lit(length) - F.size(a))),
                    F.slice(a, 1, length))


def pad_left_keep_last(arr, length: int, value=0) -> Column:
    """P9 option ``keep='last'``: over-long keeps the most recent items."""
    a = _c(arr)
    n = F.size(a)
    return F.concat(F.array_repeat(_v(value), F.greatest(F.lit(0), F.lit(length) - n)),
                    F.slice(a, F.greatest(F.lit(1), n - F.lit(length) + 1), length))


def click_mask(n_negative: int) -> Column:
    """``1`` followed by N zeros."""
    return F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), n_negative))


def split_history(col) -> Column:
    """Space-separated ids; the empty string is an empty list (``size(split('',' '))`` is 1)."""
    c = F.trim(_c(col))
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")) \
        .otherwise(F.filter(F.split(c, " +"), lambda x: x != ""))


def explode_default(arr, default=-1) -> Column:
    """P5 input: an empty (or null) list becomes a single default element."""
    a = _c(arr)
    return F.when(F.coalesce(F.size(a), F.lit(0)) <= 0, F.array(F.lit(default))).otherwise(a)


def parse_log_time(col, fmt: str = "M/d/yyyy h:mm:ss a") -> Column:
    """The log's 12-hour clock timestamp."""
    return F.to_timestamp(_c(col), fmt)
