"""Order-dependent work on groups of any size.

A group is cut into chunks by a value computed from the row itself, so a very
large group becomes many tasks; what must cross a chunk border is carried by one
summary row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provlake.session import ensure_checkpoint_dir


def chunked_lag(rows: DataFrame, group: list[str], chunk: Column, order: list[str], carry: list[str],
                name: str = "prev") -> DataFrame:
    """Struct ``name`` with ``carry`` of the previous row of the group in ``order``.

    ``chunk`` must not decrease along ``order``.
    """
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order)
    across = Window.partitionBy(*group).orderBy("_chunk")
    cut = rows.withColumn("_chunk", chunk).withColumn("_near", F.lag(F.struct(*carry)).over(inside))
    ends = (cut.groupBy(*group, "_chunk").agg(F.max_by(F.struct(*carry), F.struct(*order)).alias("_last"))
            .withColumn("_far", F.lag("_last").over(across)).select(*group, "_chunk", "_far"))
    return (cut.join(ends, group + ["_chunk"], "left")
            .withColumn(name, F.coalesce("_near", "_far")).drop("_near", "_far", "_chunk"))


def first_rows(rows: DataFrame, group: str, pos: str, n: int | None, chunk_rows: int = 4096) -> DataFrame:
    """The first ``n`` rows of each group by integer position, however large the group; all of them if ``n`` is None.

    Rows are counted per chunk; only chunks that begin before the limit are ranked.
    """
    if n is None:
        return rows
    cut = rows.withColumn("_chunk", F.floor(F.col(pos) / chunk_rows))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    reach = (cut.groupBy(group, "_chunk").agg(F.count("*").alias("_n"))
             .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
             .where(F.col("_before") < n).select(group, "_chunk", "_before"))
    rank = F.row_number().over(Window.partitionBy(group, "_chunk").orderBy(pos))
    return (cut.join(reach, [group, "_chunk"]).withColumn("_rank", rank + F.col("_before"))
            .where(F.col("_rank") <= n).drop("_chunk", "_before", "_rank"))


def dense_positions(rows: DataFrame, group: str, order: list[str], name: str = "position") -> DataFrame:
    """Number the rows of each group from 1 in ``order``, however large the group.

    Rows are range-partitioned by (group, order) and saved once, so that every
    later use sees the same cut.  A group that reaches over a partition border
    continues the count of the partitions before it: at most one group per
    partition does, so the table of carried counts has at most as many rows as
    there are partitions and is broadcast.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    cut = (rows.repartitionByRange(group, *order).withColumn("_pid", F.spark_partition_id())
           .checkpoint(eager=True))
    counts = cut.groupBy("_pid", group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # only a group that goes on from another partition carries a count, and each border has at most one
    carried = counts.withColumn("_carry", F.sum("_n").over(before)).where("_carry IS NOT NULL").drop("_n")
    within = F.row_number().over(Window.partitionBy("_pid", group).orderBy(*order))
    return (cut.withColumn("_rank", within)
            .join(F.broadcast(carried), [group, "_pid"], "left")
            .withColumn(name, F.col("_rank") + F.coalesce("_carry", F.lit(0)))
            .drop("_pid", "_rank", "_carry"))
