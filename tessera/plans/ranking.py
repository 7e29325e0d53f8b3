"""Exact ranks within groups of any size."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.lineage import cut, tasks


def rank_in_group(df: DataFrame, group: str, order: list[Column], out: str = "rank", total: str | None = None) -> DataFrame:
    """1-based row number of every row within ``group`` by ``order``, without gathering a group in one task.

    Rows are range-partitioned by group and order, so a group larger than a partition spreads over neighbouring
    ones; a running count per partition plus the group's rows in earlier partitions is the rank. ``order`` has to be
    total for a defined result. With ``total`` the size of the group comes as a column of that name. NULL groups rank as
    one group. An empty input gives an empty result.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(tasks(spark), F.col(group), *order).withColumn("_part", F.spark_partition_id())
    placed = cut(placed.withColumn("_local", F.row_number().over(W.partitionBy("_part", group).orderBy(*order))))
    before = W.partitionBy("_g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy(F.col("_part").alias("_p"), F.col(group).alias("_g")).count()
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    if total is None:
        sizes = sizes.filter("_before > 0")
    else:
        sizes = sizes.withColumn(total, F.sum("count").over(W.partitionBy("_g")))
    joined = placed.join(sizes, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    ranked = joined.withColumn(out, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("bigint"))
    return ranked.select(*df.columns, out, *([total] if total else []))
