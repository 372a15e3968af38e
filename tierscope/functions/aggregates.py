"""Aggregation shapes that hold up when one group has a third of all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_items(
    df: DataFrame,
    keys: Sequence[str],
    item: str,
    total: str,
    flags: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Distinct items per key, in total and for each condition.

    Same answer as COUNT(DISTINCT item) next to several
    COUNT(DISTINCT CASE WHEN flag THEN item END), but Spark would run those by
    copying every row once per distinct expression. Here rows collapse once to
    (keys, item) with OR-ed flags, hashed on keys AND item so a hot key is spread,
    and the second step only adds up map-side counts.
    """
    flags = dict(flags or {})
    per_item = df.groupBy(*keys, item).agg(
        *[F.max(F.when(cond, 1).otherwise(0)).alias(name) for name, cond in flags.items()]
    ) if flags else df.select(*keys, item).distinct()
    present = F.col(item).isNotNull()
    return per_item.groupBy(*keys).agg(
        F.count(item).alias(total),
        *[
            F.coalesce(F.sum(F.when(present, F.col(name)).otherwise(0)), F.lit(0)).cast("long").alias(name)
            for name in flags
        ],
    )
