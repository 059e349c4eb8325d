"""Running sums and joins whose scopes may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 16
BLOCK = 20_000


def sums_before(rows: DataFrame, scope: str, order: str, value: str, out: str, bucket: int = BUCKET) -> DataFrame:
    """rows with `out`, the sum of `value` over the rows of the scope before this one in `order` (a whole number).

    Orders are cut into buckets of `bucket` numbers: sums of whole buckets are carried into the next ones, so a task
    holds one bucket of a scope, or one sum a bucket, never the scope.
    """
    cut = rows.withColumn("bucket_", F.floor(F.col(order) / bucket))
    whole = cut.groupBy(scope, "bucket_").agg(F.sum(value).alias("in_bucket_"))
    before = Window.partitionBy(scope).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select(scope, "bucket_", F.coalesce(F.sum("in_bucket_").over(before), F.lit(0)).alias("start_"))
    inside = Window.partitionBy(scope, "bucket_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("own_", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(starts, [scope, "bucket_"]).select(*rows.columns, (F.col("start_") + F.col("own_")).alias(out))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str, block: int = BLOCK) -> DataFrame:
    """left joined to right on keys. A key with n rows on the left is laid over n / block tasks by a hash of `spread`, right rows being copied to each."""
    blocks = left.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks_"))
    many = right.join(blocks, keys).withColumn("salt_", F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1))).drop("blocks_")
    one = left.join(blocks, keys).withColumn("salt_", F.pmod(F.xxhash64(spread), F.col("blocks_")).cast("int")).drop("blocks_")
    return one.join(many, [*keys, "salt_"]).drop("salt_")
