"""Running sums over a whole table in order, in two passes and with no window over one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sums(rows: DataFrame, order: list[str], values: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with n (their place from 1), total (number of all) and sum_<value> of all rows up to each.

    ``order`` must tell rows apart. Rows are cut into ranges of the order; each range gives its sums, and a row adds to
    those of the ranges before its own the sums within it. What is added up in one task are the ranges, not rows.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = [r for r in rows.stat.approxQuantile(order[0], [i / n for i in range(1, n)], 0.25 / n)] if n > 1 else []
    edges = sorted(set(bounds))
    # the number of bounds at or below the first column: ranges hold where their bounds do, in each run and on any cluster
    part = F.lit(0) if not edges else F.size(F.filter(F.array(*map(F.lit, edges)), lambda b: b <= F.col(order[0])))
    x = rows.withColumn("_part", part)
    sums = x.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_{v}") for v in values])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    every = Window.partitionBy(F.lit(0))
    starts = sums.select("_part", F.sum("_n").over(every).alias("total"), start("_n").alias("_n"), *[start(f"_{v}").alias(f"_{v}") for v in values])
    within = Window.partitionBy("_part").orderBy(*order)
    y = x.join(F.broadcast(starts), "_part").withColumn("n", F.col("_n") + F.row_number().over(within))
    y = y.withColumns({f"sum_{v}": F.col(f"_{v}") + F.sum(v).over(within.rowsBetween(Window.unboundedPreceding, 0)) for v in values})
    return y.drop("_part", "_n", *[f"_{v}" for v in values])
