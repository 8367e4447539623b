"""Running sums in groups of any size: bucket sums first, order inside one bucket only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets a group is cut into.
BUCKETS = 1024


def running_before(df: DataFrame, group: list[str], on: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of its column over the rows of the group that
    come before in ``order`` (0 for the first).

    ``on`` is a number that rises with the order. A group is cut into BUCKETS even ranges of it; the
    buckets' sums are added up (at most BUCKETS rows a group), and rows are put in order only inside
    their bucket, so no task orders a whole group however large. Order must tell rows apart. Rows with
    a null in the group or in ``on`` are left out.
    """
    rows = df.where(" and ".join(f"{c} is not null" for c in [*group, on])).withColumns({f"ws_v_{n}": c.cast("bigint") for n, c in sums.items()})
    ends = rows.groupBy(*group).agg(F.min(on).alias("ws_lo"), F.max(on).alias("ws_hi"))
    width = F.greatest((F.col("ws_hi") - F.col("ws_lo") + 1) / F.lit(float(BUCKETS)), F.lit(1.0))
    placed = rows.join(ends, group).withColumn("ws_b", F.floor((F.col(on) - F.col("ws_lo")) / width).cast("int")).drop("ws_lo", "ws_hi")
    earlier = W.partitionBy(*group).orderBy("ws_b").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy(*group, "ws_b").agg(*[F.sum(f"ws_v_{n}").alias(f"ws_s_{n}") for n in sums])
    starts = totals.select(*group, "ws_b", *[F.coalesce(F.sum(f"ws_s_{n}").over(earlier), F.lit(0)).alias(f"ws_a_{n}") for n in sums])
    inside = W.partitionBy(*group, "ws_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = placed.join(starts, [*group, "ws_b"]).withColumns({n: F.col(f"ws_a_{n}") + F.coalesce(F.sum(f"ws_v_{n}").over(inside), F.lit(0)) for n in sums})
    return out.drop("ws_b", *[f"ws_{k}_{n}" for k in ("v", "a") for n in sums])
