"""Global ranks and exact quantiles without a single-task sort.

Rows are range-partitioned on the sort key, the partitions are fixed by a checkpoint, and
only one small row per (partition, group) is combined to get each partition's offset. A hot
group spreads over as many range partitions as it needs, because the sort key is part of the
range key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from evidra.session import cut_lineage


def _fixed_ranges(df: DataFrame, order_by: Sequence[Column]) -> DataFrame:
    ranged = df.repartitionByRange(*order_by).withColumn("_pid", F.spark_partition_id())
    return cut_lineage(ranged)


def global_row_number(df: DataFrame, order_by: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position in the total order; ``order_by`` must end in a unique column."""
    parts = _fixed_ranges(df, order_by)
    # One row per range partition, so the unpartitioned window is bounded by their number.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("_pid")
        .agg(F.count("*").alias("_n"))
        .select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy("_pid").orderBy(*order_by)
    return (
        parts.join(F.broadcast(offsets), "_pid")
        .withColumn(name, (F.row_number().over(within) + F.col("_offset")).cast("bigint"))
        .drop("_pid", "_offset")
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Linear-interpolation quantiles of ``value`` per ``keys`` as columns ``names``, plus ``n``.

    Equal values are counted before the shuffle, only the range partitions holding a wanted
    order statistic are scanned again, and no group's values ever meet in one task.
    """
    keys = list(keys) or ["_all"]
    base = df if "_all" not in keys else df.withColumn("_all", F.lit(0))
    base = base.where(F.col(value).isNotNull() & ~F.isnan(value))
    counted = base.groupBy(*keys, value).agg(F.count("*").alias("_w"))
    parts = _fixed_ranges(counted, [F.asc(k) for k in keys] + [F.asc(value)])

    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy(*keys, "_pid")
        .agg(F.sum("_w").alias("_pw"))
        .withColumn("_offset", F.coalesce(F.sum("_pw").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_pw").over(by_key))
    )
    position = {p: F.lit(float(p)) * (F.col("_total") - 1) for p in probs}
    wanted = [f(position[p]).cast("bigint") for p in probs for f in (F.floor, F.ceil)]
    holds = F.lit(False)
    for rank in wanted:
        holds = holds | ((rank >= F.col("_offset")) & (rank < F.col("_offset") + F.col("_pw")))

    running = (
        Window.partitionBy(*keys, "_pid")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = (
        parts.join(offsets.where(holds), [*keys, "_pid"])
        .withColumn("_upto", F.sum("_w").over(running) + F.col("_offset"))
        .withColumn("_from", F.col("_upto") - F.col("_w"))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_upto")), F.col(value)))

    aggs = [F.max("_total").alias("n")]
    for i, p in enumerate(probs):
        low, high = F.floor(position[p]), F.ceil(position[p])
        aggs += [at(low).alias(f"_lo{i}"), at(high).alias(f"_hi{i}")]
        aggs.append(F.max(position[p] - low).alias(f"_t{i}"))
    out = ranked.groupBy(*keys).agg(*aggs)
    quantiles = [
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_t{i}")).alias(names[i])
        for i in range(len(probs))
    ]
    return out.select(*[k for k in keys if k != "_all"], "n", *quantiles)
