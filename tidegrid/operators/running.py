"""Running sums over a written range sort: no task holds a whole group, however large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import written


def running_sums(df: DataFrame, group: str, order: Sequence, sums: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(``group``, ``keep``, ``sums``, ``<sum>_upto``): sums of long columns over a group's rows up to each row, in the order given.

    Rows are range-sorted by group and order and written with their places, so that places and sums speak of the same partitions
    whatever is computed again. Only a partition's first group can have begun before it: what came before is one row per
    partition, which is broadcast. ``group`` must not be NULL; columns that only serve the order aren't written.
    """
    names = list(dict.fromkeys([group, *keep, *sums]))
    placed = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).select(*names, F.monotonically_increasing_id().alias("_at"))
    placed = written(placed, "running").withColumn("_p", F.shiftright("_at", 33))
    ends = placed.groupBy("_p").agg(F.min(group).alias("_lo"), F.max(group).alias("_hi"))  # one row per partition
    edge = placed.join(F.broadcast(ends), "_p").where((F.col(group) == F.col("_lo")) | (F.col(group) == F.col("_hi")))
    edge = edge.groupBy("_p", F.col(group).alias("_g"), (F.col(group) == F.col("_lo")).alias("_first")).agg(*[F.sum(c).alias(c) for c in sums])  # two rows per partition
    w = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = edge.select("_p", "_g", "_first", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_b_{c}") for c in sums]).where("_first").drop("_first")
    inside = Window.partitionBy("_p", group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    each = placed.select("*", *[F.sum(c).over(inside).alias(f"_i_{c}") for c in sums])
    both = each.join(F.broadcast(before), (each["_p"] == before["_p"]) & (F.col(group) == F.col("_g")), "left")
    return both.select(*names, *[(F.col(f"_i_{c}") + F.coalesce(f"_b_{c}", F.lit(0))).alias(f"{c}_upto") for c in sums])
