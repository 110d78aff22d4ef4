"""Ordered folds that stay parallel when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 100_000


def best_before(
    df: DataFrame, keys: list[str], order: str, rank: Column, alias: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add the smallest `rank` among the rows of the key that come earlier in `order`.

    `order` is a whole number, unique within a key. Its range is cut into blocks; a window
    runs inside each block and another one over the blocks' minima, so no task sees more
    than `block_rows` rows of one key at a time, or one row per block of it.
    """
    ranked = df.withColumn("_rank", rank).withColumn("_block", F.floor(F.col(order) / F.lit(block_rows)))
    block_key = [*keys, "_block"]
    earlier_blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ranked.groupBy(*block_key)
        .agg(F.min("_rank").alias("_best"))
        .withColumn("_carried", F.min("_best").over(earlier_blocks))
        .drop("_best")
    )
    earlier_rows = Window.partitionBy(*block_key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranked.withColumn("_within", F.min("_rank").over(earlier_rows))
        .join(carried, block_key, "left")
        .withColumn(alias, F.least("_within", "_carried"))
        .drop("_rank", "_block", "_within", "_carried")
    )
