"""Running sums and extremes over a key's rows, without bringing the rows of one key together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, key: str, bucket: str, order: list[str], value: Column, kind: str, name: str, until: int = 0) -> DataFrame:
    """``df`` with ``name``: the sum, max or min of ``value`` over the key's rows in ``order``, up to each row (``until`` 0) or to the one before (-1).

    ``bucket`` must not fall along ``order``. Rows are dealt out by key and bucket; only one total a bucket is carried over to later ones, so a hot key is spread over its buckets.
    """
    of = KINDS[kind]
    marked = df.withColumn("_value", value)
    inside = of("_value").over(Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, until))
    totals = marked.groupBy(F.col(key).alias("_key"), F.col(bucket).alias("_bucket")).agg(of("_value").alias("_total"))
    before = of("_total").over(Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.select("_key", "_bucket", before.alias("_before"))
    met = marked.withColumn(name, inside).join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col(bucket) == F.col("_bucket")))
    both = F.coalesce(F.col(name) + F.col("_before"), name, "_before") if kind == "sum" else (F.greatest if kind == "max" else F.least)(name, "_before")
    return met.withColumn(name, both).drop("_value", "_key", "_bucket", "_before")
