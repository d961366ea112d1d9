"""Positions of rows in an order within groups, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.runtime import materialize


def with_positions(rows: DataFrame, keys: list[str], order: list[Column], name: str = "idx") -> DataFrame:
    """``rows`` with the position, from 0, of each row within its group.

    Rows are range-partitioned by group and order; positions within a partition are shifted by the
    counts of the group's earlier partitions. A group of any size spreads over many tasks.
    """
    by = [F.col(k) for k in keys]
    sorted_ = rows.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id())
    sorted_ = materialize(sorted_, "sorted")
    counts = sorted_.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    local = Window.partitionBy(*keys, "__part").orderBy(*order)
    ranked = sorted_.withColumn("__rn", F.row_number().over(local) - 1)
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    placed = ranked.join(shift, same)
    return placed.withColumn(name, (F.col("__rn") + F.col("__shift")).cast("long")).select(*rows.columns, name)
