"""Running totals and ranks within groups of any size: a group is dealt over buckets, and bucket totals give each its offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from optiqal.functions.graph import written


def running(df: DataFrame, group: str, bucket: str, order: list[str], value: Column) -> DataFrame:
    """df with `before`, the sum of value over the rows of its group that come earlier in the order (bucket, *order), and `nth`, its number within the bucket.

    group and bucket must not be null, bucket must follow the order, and value must be a whole number.
    The window needs the rows of one bucket of one group together; only a row for each of these is summed over a group.
    """
    total = df.groupBy(group, bucket).agg(F.sum(value).alias("bucket_total"))
    so_far = W.partitionBy(group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offset = total.select(group, bucket, F.coalesce(F.sum("bucket_total").over(so_far), F.lit(0)).alias("bucket_before"))
    own = W.partitionBy(group, bucket).orderBy(*order)
    return (
        df.join(offset, [group, bucket])
        .withColumn("before", F.col("bucket_before") + F.coalesce(F.sum(value).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("nth", F.row_number().over(own))
        .drop("bucket_before")
    )


def numbered(df: DataFrame, group: str, ranges: list, order: list) -> DataFrame:
    """df with `before`, the number of rows of its group that come earlier in the order, and `bucket`, the part of the group it lies in.

    group must not be null. Rows are dealt by ranges of (group, *ranges), which the order must follow, so a large group lies
    in many parts; only rows equal in all of `ranges` stay together. The parts are written, so that each later use sees the same.
    """
    dealt = written(df.repartitionByRange(group, *ranges).withColumn("bucket", F.spark_partition_id()), "ranges")
    return running(dealt, group, "bucket", order, F.lit(1)).drop("nth")
