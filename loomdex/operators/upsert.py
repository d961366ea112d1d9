"""Last write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each key the row that is last in ``order``; other columns as they are.

    An aggregate rather than a window: each task keeps one row a key before anything is
    shuffled, so a key with very many versions isn't gathered in one place.
    """
    rest = [c for c in rows.columns if c not in keys]
    kinds = dict(rows.dtypes)
    if set(order) <= set(rest) and not any("map<" in kinds[c] or "variant" in kinds[c] for c in rest):
        # One struct, which holds columns of the order once; ties go by the other columns.
        last = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("last")
    else:
        last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col("last")[c].alias(c) for c in rest]).select(*rows.columns)
