"""Places, running sums and exact quantiles over all rows or large groups, without one task that holds a group.

Rows are range-sorted by group and order into a written table, so a group of any size, and a value that any number of
rows share, lies in several partitions. Counts and sums of each group's partitions, a row per partition and group, give
what lies before a partition; windows then run inside partitions only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockweave.session import materialize, shuffle_partitions


def in_order(rows: DataFrame, order: Sequence[str | tuple[str, str]], value: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """rows with place_ (from 1 in each group by the order: names, or (name, "desc")), count_ (rows of the group) and, for a value column, before_
    (the value's sum over the places before) and total_. Nulls of value count as 0; rows that the order ties are placed
    anyhow, each once; a null in by is a group of its own.
    """
    keys = [f"by_{k}_" for k in range(len(by))]
    names = [c if isinstance(c, str) else c[0] for c in order]
    named = rows.withColumns({k: F.col(c) for k, c in zip(keys, by, strict=True)} | {f"order_{k}_": F.col(c) for k, c in enumerate(names)} | {"tie_": F.monotonically_increasing_id()})
    sort = [F.col(k) for k in keys] + [F.col(f"order_{k}_") if isinstance(c, str) else F.col(f"order_{k}_").desc() for k, c in enumerate(order)] + [F.col("tie_")]
    spread = named.repartitionByRange(shuffle_partitions(rows.sparkSession), *sort).withColumn("part_", F.spark_partition_id())
    spread = materialize(spread, "in-order")
    amount = F.coalesce(F.col(value).cast("double"), F.lit(0.0)) if value else F.lit(0.0)
    parts = spread.groupBy(*keys, "part_").agg(F.count("*").alias("n_"), F.sum(amount).alias("sum_"))
    whole, earlier = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    known = parts.select(*[F.col(k).alias(f"{k}p") for k in keys], F.col("part_").alias("part_p"), F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("n_before"), F.coalesce(F.sum("sum_").over(earlier), F.lit(0.0)).alias("sum_before"), F.sum("n_").over(whole).alias("count_"), F.sum("sum_").over(whole).alias("total_"))
    same = F.col("part_") == F.col("part_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}p"))
    met = spread.join(known if keys else F.broadcast(known), same)  # without groups: a row per partition
    inside = Window.partitionBy(*keys, "part_").orderBy(*sort[len(keys) :])
    placed = met.withColumn("place_", F.row_number().over(inside) + F.col("n_before"))
    if value:
        placed = placed.withColumn("before_", F.col("sum_before") + F.coalesce(F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return placed.select(*rows.columns, "place_", "count_", *(["before_", "total_"] if value else []))


def quantiles(rows: DataFrame, value: str, wanted: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """by and a column for each wanted name: the value's exact quantile in each group, interpolated between neighbours.

    Nulls have no place; a group of nulls only has no row.
    """
    placed = in_order(rows.select(*by, F.col(value).cast("double").alias("value_")).where("value_ is not null"), ["value_"], by=by)
    at = {name: (F.col("count_") - 1) * F.lit(q) for name, q in wanted.items()}
    near = None
    for h in at.values():
        here = F.col("place_").between(F.floor(h) + 1, F.floor(h) + 2)
        near = here if near is None else near | here
    ends = []
    for name, h in at.items():
        ends += [F.max(F.when(F.col("place_") == F.floor(h) + 1, F.col("value_"))).alias(f"{name}_lo"), F.max(F.when(F.col("place_") == F.floor(h) + 2, F.col("value_"))).alias(f"{name}_hi"), F.max(h - F.floor(h)).alias(f"{name}_w")]
    found = placed.where(near).groupBy(*by).agg(*ends)
    return found.select(*by, *[(F.col(f"{n}_lo") + F.col(f"{n}_w") * (F.coalesce(f"{n}_hi", f"{n}_lo") - F.col(f"{n}_lo"))).alias(n) for n in wanted])
