"""Skew-safe equi joins: split hot keys over salt buckets.

A key may hold a large share of all rows (a duplicated text, a prolific author, a hub
node).  ``skew_join`` finds such heavy hitters with one partially aggregated count per key
(a bounded list is collected), spreads only their rows on the large side over ``salt``
buckets by a row hash, and replicates the matching small-side rows once per bucket.  All
other keys join as usual, so the extra shuffle volume is limited to the hot keys' small
side.  Results are identical to the plain join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 1_000


def hot_keys(df: DataFrame, key: str, share: float = 0.01, min_rows: int = 100_000,
             max_keys: int = MAX_HOT_KEYS) -> list:
    """Keys holding more than ``share`` of the rows (and at least ``min_rows`` rows), at most
    ``max_keys`` of them, heaviest first.  One partial aggregation plus a global count."""
    total = df.count()
    limit = max(min_rows, int(share * total))
    if total <= limit:   # no key can hold more rows than the table has
        return []
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    return [r[key] for r in counts.orderBy(F.col("_n").desc()).limit(max_keys).collect()]


def skew_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", salt: int = 32,
              share: float = 0.01, min_rows: int = 100_000, hot: list | None = None) -> DataFrame:
    """``big.join(small, key, how)`` with hot keys of ``big`` split over ``salt`` buckets.

    ``how`` is one of ``inner``, ``left``, ``left_semi``, ``left_anti`` (joins that keep the
    big side's rows, so salting only the big side is exact).  ``hot`` passes keys already
    known to be hot (skips the detection pass)."""
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    if hot is None:
        hot = hot_keys(big, key, share, min_rows)
    if not hot:
        return big.join(small, key, how)
    is_hot = F.col(key).isin(hot)
    b = big.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*big.columns), F.lit(salt)))
                       .otherwise(F.lit(0)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salt - 1)))
                                            .otherwise(F.array(F.lit(0)))))
    return b.join(s, [key, "_salt"], how).drop("_salt")
