"""First-wins deduplication, duplicate counts and label broadcast.

Deduplication is an aggregation, not a window: ``min(struct(order, payload))`` per key is
combined map-side, so a key that holds a third of all rows is reduced before the shuffle
instead of being sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_first(df: DataFrame, key: list[str] | str, order_col: str, payload: list[str] | None = None) -> DataFrame:
    """One row per key: the row with the smallest ``order_col`` wins."""
    keys = [key] if isinstance(key, str) else list(key)
    payload = payload if payload is not None else [c for c in df.columns if c not in keys and c != order_col]
    first = F.min(F.struct(F.col(order_col).alias("_o"), *[F.col(c) for c in payload])).alias("_f")
    g = df.groupBy(*keys).agg(first)
    return g.select(*keys, F.col("_f._o").alias(order_col), *[F.col(f"_f.{c}").alias(c) for c in payload])


def dedup_counts(df: DataFrame, key: list[str] | str, order_col: str, payload: list[str] | None = None) -> DataFrame:
    """Unique rows with ``count_total`` (singletons kept), busiest first."""
    keys = [key] if isinstance(key, str) else list(key)
    payload = payload if payload is not None else []
    g = df.groupBy(*keys).agg(F.min(F.struct(F.col(order_col).alias("_o"), *[F.col(c) for c in payload])).alias("_f"),
                              F.count(F.lit(1)).alias("count_total"))
    out = g.select(*keys, F.col("_f._o").alias(order_col), *[F.col(f"_f.{c}").alias(c) for c in payload],
                   "count_total")
    return out.orderBy(F.col("count_total").desc(), F.col(order_col))


def broadcast_labels(rows: DataFrame, unique_labels: DataFrame, key: str, label_col: str,
                     hot_share: float = 0.01, hot_min_rows: int = 100_000) -> DataFrame:
    """Copy the label of each unique key back to every row carrying that key.

    An equi join (AQE broadcasts the unique side when it is small at run time); a key
    duplicated into a large share of the rows is split over salt buckets (``skew_join``)."""
    from consensa.operators.skew import skew_join
    return skew_join(rows, unique_labels.select(key, label_col), key, "left",
                     share=hot_share, min_rows=hot_min_rows)
