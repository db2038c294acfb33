"""Running values along an order within a key, without a window over a whole key.

Rows of a key are cut into buckets that follow each other in the order (such as ranges of blocks). Each bucket is summed
up, the sums of a key's buckets are run through, and a window over one bucket at a time does the rest. A key that holds a
third of all rows is so many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, key: str, bucket: str, order: list[str], sums: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    """rows with, for each name in sums, the sum of its column over this row and those before, and for each name in lasts
    the last non-null value of its column before this row."""
    inside = Window.partitionBy(key, bucket).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    values = {f"_s_{k}": c for k, c in sums.items()} | {f"_l_{k}": c for k, c in lasts.items()}
    rows = rows.withColumns(values)
    totals = [F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums]
    totals += [F.max_by(f"_l_{k}", F.when(F.col(f"_l_{k}").isNotNull(), F.struct(*order))).alias(f"_t_{k}") for k in lasts]
    across = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(key, bucket).agg(*totals)
    carried = carried.select(key, bucket, *[F.coalesce(F.sum(f"_t_{k}").over(across), F.lit(0)).alias(f"_c_{k}") for k in sums], *[F.last(f"_t_{k}", True).over(across).alias(f"_c_{k}") for k in lasts])
    out = rows.join(carried, [key, bucket])
    out = out.withColumns({k: F.col(f"_c_{k}") + F.sum(f"_s_{k}").over(inside) for k in sums} | {k: F.coalesce(F.last(f"_l_{k}", True).over(before), F.col(f"_c_{k}")) for k in lasts})
    return out.drop(*values, *[f"_c_{k}" for k in (*sums, *lasts)])


def carry_forward(rows: DataFrame, position: str, value: str, span: int) -> DataFrame:
    """rows with `carried`: the last non-null value at this position or before, null if there is none.

    Positions are cut into spans; the last values of the spans (a row each) are run through in one small window.
    """
    rows = rows.withColumn("_span", F.floor(F.col(position) / span))
    ends = rows.groupBy("_span").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(position))).alias("_end"))
    across = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_span", F.last("_end", True).over(across).alias("_before"))
    inside = Window.partitionBy("_span").orderBy(position)
    return rows.join(ends, "_span").withColumn("carried", F.coalesce(F.last(value, True).over(inside), "_before")).drop("_span", "_before")
