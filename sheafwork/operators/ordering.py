"""Whole-table ranks and running sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.session import shared_checkpoint


def global_row_number(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based position in a total order.

    Rows are range-partitioned by the sort key and checkpointed once (so the split points cannot
    change between uses); each range is numbered on its own and shifted by the size of the ranges
    before it. The order must end in a unique column, or equal keys cannot be split over ranges.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = shared_checkpoint(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    sizes = placed.groupBy("_pid").agg(F.count("*").alias("_n"))
    # one row per range partition: bounded by n
    before = sizes.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    return placed.withColumn("_rn", local).join(before, "_pid").withColumn(
        name, (F.col("_rn") + F.col("_before")).cast("long")).drop("_rn", "_before", "_pid")


def row_number_within(df: DataFrame, keys: list[str], position: str, name: str = "n", block: int = 1_000_000) -> DataFrame:
    """1-based row number per key along an integer position, in two levels.

    Blocks of positions are numbered apart and shifted by the blocks before them, so a key that holds
    a third of all rows is still spread over its blocks.
    """
    blocked = df.withColumn("_block", F.floor(F.col(position) / block))
    sizes = blocked.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = sizes.select(*keys, "_block", (
        F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(position))
    return blocked.withColumn("_rn", inside).join(before, [*keys, "_block"]).withColumn(
        name, F.col("_rn") + F.col("_before")).drop("_rn", "_before", "_block")


def running_totals(df: DataFrame, position: str, columns: list[str], block: int = 10_000) -> DataFrame:
    """Running sums along a dense integer position, in two levels.

    Blocks of ``block`` positions are summed in parallel; only one row per block meets in the last
    window.
    """
    blocked = df.withColumn("_block", F.floor(F.col(position) / block))
    totals = blocked.groupBy("_block").agg(*[F.sum(c).alias(c) for c in columns])
    w = Window.orderBy("_block")
    before = totals.select("_block", *[(F.sum(c).over(w) - F.col(c)).alias(f"_before_{c}") for c in columns])
    inside = Window.partitionBy("_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.join(before, "_block")
    for c in columns:
        out = out.withColumn(f"running_{c}", F.sum(c).over(inside) + F.col(f"_before_{c}"))
    return out.drop("_block", *[f"_before_{c}" for c in columns])
