"""Mixing sources to target weights, with DataFrame operations only.

Targets: every source gets its weight's share of the whole, at most ``limit`` times its own size; what is over
goes to the others by weight. Sorted by limit over weight, the sources that stop at their limit come first, so
one pass of prefix sums over the sources (a row each) finds them.

Draws: a document gets a hash-random key. A source's keys are cut into as many equal key ranges as the square
root of its row count, so neither a range nor the list of ranges grows past that; prefix sums of sizes run over
the list of ranges and inside each range. A source's budget gives whole epochs and a rest; the rest cuts the
key order at the exact word.

Defined results: a null text has size 0 and is taken 0 words; a null source is a source of its own, sorted
last; rows of equal key repeat each other whole, id and text, and lie in one range; each counts; an empty table
gives no rows; other columns pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.session import materialize

#: A word is a run of anything but these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size, n_rows) -> with weight, target. The windows run over one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * limit)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = ranked.withColumns({
        "total": F.sum("source_size").over(Window.partitionBy()) * F.lit(share),
        "cap_before": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weight_left": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    })
    full = F.col("cap") * F.col("weight_left") <= F.col("weight") * (F.col("total") - F.col("cap_before"))
    judged = rest.withColumn("full", full)
    free = judged.withColumns({
        "left": F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(Window.partitionBy()), F.lit(0)),
        "weights": F.sum(F.when(~F.col("full"), F.col("weight"))).over(Window.partitionBy()),
    })
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight").cast("double") * F.col("left").cast("double") / F.col("weights").cast("double"))
    return free.select("source", "source_size", "n_rows", "weight", target.alias("target"))


def order_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A hash-random hexadecimal key of a row's id and text, so that rows of one id, or of none, lie in different ranges; a null
    counts as the empty string."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def _sized(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text"), seed).alias("order_key"), *more)


def _taken(rows: DataFrame, sized: DataFrame, weights: tuple[int, ...], limit: int, share: float) -> DataFrame:
    """rows with source_size, target and taken; sized is the written table of their sizes."""
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), weights, limit, share)
    plan = plan.withColumns({"ranges": F.greatest(F.lit(1), F.ceil(F.sqrt("n_rows"))).cast("long"), "source_key": F.xxhash64(F.coalesce("source", F.lit("\u0000null")))})
    plan = materialize(plan.withColumnRenamed("source", "s").drop("weight", "n_rows"), "targets")

    def keyed(df: DataFrame) -> DataFrame:
        # the first 52 bits of the key as a fraction: ranges in key order
        fraction = F.conv(F.substring("order_key", 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
        return df.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("range", F.floor(fraction * F.col("ranges")).cast("long"))

    sums = keyed(sized).groupBy("source_key", "range").agg(F.sum("size").alias("range_size"))
    over = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source_key", "range", F.coalesce(F.sum("range_size").over(over), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_key", "range").orderBy("order_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed(rows).join(offsets, ["source_key", "range"]).withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    return placed.withColumn("taken", (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("at")))).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = 3, share: float = 1.0, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of docs(doc_id, source, text)."""
    sized = materialize(_sized(docs, seed), "sizes")
    return _taken(sized, sized, weights, limit, share).select("doc_id", "source", "size", "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word's end, with the white space between."""
    starts = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    return F.array_join(F.slice(starts, 1, n.cast("int")), "")


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = 3, share: float = 1.0, seed: int = 7) -> DataFrame:
    """The mixed corpus: a row for every whole repeat of a document, and the first words of a cut one.

    Every row, repeated ones too, gives exactly the words that ``mix`` grants it: rows travel with their plan.
    """
    sized = materialize(_sized(docs, seed), "sizes")
    rows = _taken(_sized(docs, seed, F.struct("*").alias("row_")), sized, weights, limit, share).where("taken > 0")
    copies = F.expr("transform(sequence(1, cast(ceil(taken / size) as int)), i -> least(size, taken - (i - 1) * size))")
    out = rows.select("row_", "size", F.explode(copies).alias("words"))
    text = F.when(F.col("words") < F.col("size"), first_words(F.col("row_.text"), F.col("words"))).otherwise(F.col("row_.text"))
    mixed = out.withColumn("text", text)
    own = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return mixed.select(*[own.get(c, F.col("row_").getField(c)).alias(c) for c in docs.columns])
