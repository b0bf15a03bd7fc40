"""Connected components by label propagation with pointer jumping, and semi and anti joins that leave most rows in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (node, component = smallest reachable node), for nodes with links.

    Each round takes the least label among neighbours, then the label of that label; rounds grow with the
    logarithm of a component's diameter in practice. Labels are written every round; the driver sees counts only.
    Self links, repeated links and nulls are harmless; no links give no rows.
    """
    both = edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("component").alias("m"))
        lower = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("jumped"))
        new = materialize(lower.join(jump, "c", "left").select("node", "old", F.least("c", "jumped").alias("component")), "labels")
        moved = new.where("component < old").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels


#: Bits of the id filter: its broadcast is 4 MB at most, whatever the number of ids.
FILTER_BITS = 1 << 25


def _spare(rows: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where rows has a column of that name."""
    taken = {c.lower() for c in rows.columns}
    return [next(n + "_" * k for k in range(len(taken) + 1) if n + "_" * k not in taken) for n in names]


def _maybe_in(rows: DataFrame, ids: DataFrame, key: str, maybe: str) -> DataFrame:
    """rows with maybe: false where key is surely not among ids. The filter has FILTER_BITS bits, in buckets of 4 KB."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    at, bucket, bits = _spare(rows, "at_", "bucket_", "bits_")
    made = ids.select(place(key).alias(at)).groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits))
    met = rows.withColumn(at, place(key)).withColumn(bucket, F.bitmap_bucket_number(at)).join(F.broadcast(made), bucket, "left")
    bit = f"cast(bitmap_bit_position(`{at}`) as int)"
    found = F.expr(f"coalesce(shiftright(cast(conv(hex(substring(`{bits}`, {bit} div 8 + 1, 1)), 16, 10) as int), {bit} % 8) & 1 = 1, false)")
    return met.withColumn(maybe, found).select(*rows.columns, maybe)


def rows_in(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Semi join: only rows that pass the filter are shuffled, then joined exactly. Rows of a null key have no partner."""
    (maybe,) = _spare(rows, "maybe_")
    return _maybe_in(rows, ids, key, maybe).where(F.col(maybe)).drop(maybe).join(ids.select(key), key, "left_semi").select(*rows.columns)


def rows_not_in(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Anti join: rows that the filter rules out stay where they are; rows of a null key stay too."""
    (maybe,) = _spare(rows, "maybe_")
    marked = _maybe_in(rows, ids, key, maybe)
    rest = marked.where(F.col(maybe)).drop(maybe).join(ids.select(key), key, "left_anti")
    return marked.where(~F.col(maybe)).select(*rows.columns).unionByName(rest.select(*rows.columns))


#: Rows of one key that a join puts into one place; at most HOT_KEYS keys have more.
PLACE_ROWS, HOT_KEYS = 100_000, 10_000


def _listed(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def hot_keys(counts: DataFrame, key: str | list[str], place_rows: int = PLACE_ROWS) -> DataFrame | None:
    """The key columns (with a trailing _) and places_ of the keys with more rows than one place takes; None if there are none.

    counts (key, n_) is a written table. What a place takes rises with the number of all rows, so that there are never
    more than HOT_KEYS such keys: their list can be broadcast.
    """
    most, n = counts.agg(F.max("n_"), F.sum("n_")).first()
    limit = max(place_rows, (n or 0) // HOT_KEYS)
    if (most or 0) <= limit:
        return None
    columns = [F.col(k).alias(f"{k}_") for k in _listed(key)]
    return materialize(counts.where(F.col("n_") > limit).select(*columns, F.ceil(F.col("n_") / limit).cast("int").alias("places_")), "hot-keys")


def spread_join(rows: DataFrame, side: DataFrame, key: str | list[str], hot: DataFrame | None) -> DataFrame:
    """Inner join on key, where side has one row a key and rows may have very many of some keys.

    A hot key's rows are dealt to several places by a hash of the row, and its row of side goes to each.
    """
    keys = _listed(key)
    if hot is None:
        return rows.join(side, keys)
    met = lambda df: df.join(F.broadcast(hot), [F.col(k) == F.col(f"{k}_") for k in keys], "left")
    spare = [f"{k}_" for k in keys] + ["places_"]
    dealt = met(rows).withColumn("place_", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("places_")).cast("int"), F.lit(0))).drop(*spare)
    copied = met(side).withColumn("place_", F.explode(F.sequence(F.lit(0), F.coalesce("places_", F.lit(1)) - 1))).drop(*spare)
    return dealt.join(copied, [*keys, "place_"]).drop("place_")
