"""Shapes that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def salted_join(big: DataFrame, other: DataFrame, on: list[str], salts: int = 16, how: str = "inner",
                hot_rows: int = 200_000) -> DataFrame:
    """Equi-join whose hot keys of `big` are spread over `salts` tasks; `other` is repeated for those keys only.

    `how` may be inner, left, left_semi or left_anti (seen from `big`). Which keys are hot comes from a partially
    aggregated count, so the result is whole whatever the distribution.
    """
    hot = big.groupBy(*on).count().where(F.col("count") > hot_rows).select(*on, F.lit(True).alias("__hot"))
    # A salt from the row's own values is the same when a lost task is run again.
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)).cast("int")
    left = (big.join(hot, on, "left")
            .withColumn("__salt", F.when(F.col("__hot"), spread).otherwise(F.lit(0))).drop("__hot"))
    right = (other.join(hot, on, "left")
             .withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                                             .otherwise(F.array(F.lit(0))))).drop("__hot"))
    return left.join(shuffled(right), [*on, "__salt"], how).drop("__salt")


def shuffled(df: DataFrame) -> DataFrame:
    """A side of an equi-join that must not go through the driver: both sides are dealt and sorted by the key.

    Spark takes a table for as large as its file, so one that grows when it is read (compressed columns, exploded words) passes for small enough to broadcast.
    """
    return df.hint("merge")


def blocked_running_sum(df: DataFrame, group: list[str], block: Column, order: list[Column], value: Column,
                        name: str) -> DataFrame:
    """Running sum of `value` inside each group, computed block by block.

    `block` must grow with `order` inside a group, so a group of any size is spread over its blocks: sums run inside
    (group, block), then the totals of earlier blocks are added. Only block totals are ever ordered per group.
    """
    rows = df.withColumn("__block", block).withColumn("__value", value)
    inside = Window.partitionBy(*group, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, "__block").agg(F.sum("__value").alias("__total"))
    offsets = totals.select(*group, "__block", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    return (rows.withColumn("__inside", F.sum("__value").over(inside))
            .join(offsets, [*group, "__block"])
            .withColumn(name, F.col("__inside") + F.col("__offset"))
            .drop("__block", "__value", "__inside", "__offset"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], limit: int, name: str = "rank") -> DataFrame:
    """The `limit` best rows of each group with their rank from 1. Spark prunes each task to `limit` rows per group
    before the shuffle, so a hot group never travels whole."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)
