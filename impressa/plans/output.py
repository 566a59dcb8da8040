"""Stable output types for checked queries: integers as BIGINT, reals rounded to 6 places."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6
# Both engines round x + BIAS: sums computed in another order can sit on either side of a
# rounding half (data with short decimals often lands exactly on one); the bias moves both
# copies to the same side.  The oracle text gets the same bias (see ``bias_sql``).
BIAS = 1e-11


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            cols.append(c.cast("long").alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            cols.append(F.round(c.cast("double") + F.lit(BIAS), digits).alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            cols.append(c.cast("string").alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def bias_sql(sql: str) -> str:
    """Apply the rounding bias to every ``round(`` of an oracle query."""
    return re.sub(r"\bround\(", "round(1e-11 + ", sql, flags=re.IGNORECASE)


def rnd(col, digits: int):
    """Rounding with the same bias as ``finish`` (for the few outputs kept at other precision)."""
    return F.round(col.cast("double") + F.lit(BIAS), digits)
