"""Running totals within keys that may hold any share of the rows.

Rows of a key are spread over ``BUCKETS`` buckets by their order value; the totals of the buckets, a small table, are summed
up first, so that a window never sees more than one bucket of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.shared import written

BUCKETS = 256


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same keys that come before, by hash of ``order``.

    ``order`` should tell the rows of a key apart; ties are taken in no set order. Null values count as 0.
    """
    h, b, v, before, last = (f"{name}__{x}" for x in ("h", "b", "v", "before", "last"))
    hashed = df.withColumn(h, F.xxhash64(*order)).withColumn(b, F.pmod(F.col(h), F.lit(buckets))).withColumn(v, F.coalesce(value, F.lit(0)))
    totals = hashed.groupBy(*keys, b).agg(F.sum(v).alias(last))
    up_to = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn(before, F.coalesce(F.sum(last).over(up_to), F.lit(0))).drop(last)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, b]]
    joined = hashed.alias("l").join(totals.alias("r"), same, "left").select("l.*", f"r.{before}")
    within = Window.partitionBy(*keys, b).orderBy(h).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(name, F.col(before) + F.coalesce(F.sum(v).over(within), F.lit(0))).drop(h, b, v, before)


def ordered_totals(df: DataFrame, order: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with a column for each of ``values``: its sum over all rows that come before in the order of these columns.

    Rows are dealt to as many ranges of that order as there are shuffle partitions; the sums of the ranges, a row each, are
    summed up first, so that no window sees more than a range. ``order`` should tell rows apart; nulls come first.
    """
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("__range").agg(*(F.sum(v).alias(f"__{n}") for n, v in values.items()))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = sums.select("__range", *(F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in values))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(offsets), "__range")
    return joined.withColumns({n: F.col(f"__{n}") + F.coalesce(F.sum(v).over(within), F.lit(0)) for n, v in values.items()}).select(*df.columns, *values)
