"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; a chunk ends where the hash has enough zero bits: more bits before the
normal size, fewer after it (normalised chunking), between a least and a greatest size. Boundaries depend on
nearby bytes only, so an insertion or deletion changes the chunks around it and no others. A fingerprint is the
set of chunk digests, each with its length: ``digest length`` as hexadecimal text, sorted.
``likeness`` is containment: length of the common chunks over the smaller total length.

``edited_with_next`` walks documents in descending doc_id and pairs each with the one after it (the last with
the first). Documents are dealt to key ranges and sorted inside each; a range also gets the first document of
the range below it, so that every pair meets in one task with one shuffle of the text. An id with very many rows, or
very many null ids, are cut further by a hash of the text, so that no range takes all of them.

Defined results: null text is empty; an empty text has an empty fingerprint; two empty fingerprints are alike
(1.0), an empty and another one are not (0.0); rows of equal doc_id follow one another by a
hash of the text, then the text (equal texts have one fingerprint, whichever comes first); a null doc_id comes last; a table of one row follows itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.session import attach, shuffle_partitions

LEAST, NORMAL, GREATEST = 16, 48, 256
_STRICT, _LOOSE = np.uint32(0x7F << 25), np.uint32(0x1F << 27)
#: Random 32-bit numbers, one per byte value.
_GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint32)


def _ends(data: np.ndarray) -> list[int]:
    """End offsets of the chunks of data; doubling builds the 32-byte gear hash in five vector steps."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k) if len(h) > k else 0
    loose = np.flatnonzero((h & _LOOSE) == 0)
    strict = ((h[loose] & _STRICT) == 0).tolist()
    ends, at, n = [], 0, len(data)
    for p, s in zip(loose.tolist(), strict, strict=True):
        p += 1
        while p - at > GREATEST:
            at += GREATEST
            ends.append(at)
        if p - at >= (LEAST if s else NORMAL):
            at = p
            ends.append(at)
    while n - at > GREATEST:
        at += GREATEST
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunk_set(data: bytes) -> dict[int, int]:
    """Digest -> length of the distinct chunks."""
    if not data:
        return {}
    digest, at, found = xxhash.xxh3_64_intdigest, 0, {}
    for end in _ends(np.frombuffer(data, np.uint8)):
        found[digest(data[at:end]) >> 16] = end - at
        at = end
    return found


def render(chunks: dict[int, int]) -> str:
    return "".join(f"{d:012x}{n:03x}" for d, n in sorted(chunks.items()))


def parse(fingerprint: str) -> dict[int, int]:
    return {int(fingerprint[i : i + 12], 16): int(fingerprint[i + 12 : i + 15], 16) for i in range(0, len(fingerprint), 15)}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    if not a or not b:
        return float(not a and not b)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    common = sum(n for d, n in small.items() if d in large)
    return common / min(sum(a.values()), sum(b.values()))


def edit(text: str, following: str) -> str:
    """The last third of the text's code points gives way to the first as many of the next one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row; a narrow map."""
    attach(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([render(chunk_set((t.as_py() or "").encode())) for t in b.column(1)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited_with_next(docs: DataFrame, ranges_per_partition: int = 8) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness; see the module's notes.

    The driver holds the range bounds only: a fixed number per shuffle partition.
    """
    spark = docs.sparkSession
    attach(spark)
    n = shuffle_partitions(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    wanted = n * ranges_per_partition
    points = [k / wanted for k in range(1, wanted)]
    total, known, found = docs.agg(F.count("*"), F.count("doc_id"), F.percentile_approx(F.col("doc_id").cast("long"), points, 20 * wanted)).first()
    bounds, times = np.unique(np.array(found or [], np.int64), return_counts=True)
    null_cuts = max(1, -(-(total - known) * wanted // max(total, 1)))

    @F.pandas_udf("long")
    def range_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """Ascending with (doc_id, hash), nulls under all others; a bound that several quantiles share is cut that often."""
        values, missing = ids.fillna(0).to_numpy(np.int64), ids.isna().to_numpy()
        part = lambda cuts: ((hashes.to_numpy(np.int64) >> 40) + (1 << 23)) * cuts >> 24
        k = np.searchsorted(bounds, values)
        own = np.minimum(k, max(len(bounds) - 1, 0))
        on_bound = (bounds[own] == values) & (k < len(bounds)) if len(bounds) else np.zeros(len(values), bool)
        cuts = np.where(on_bound, times[own], 0) if len(bounds) else np.zeros(len(values), np.int64)
        return pd.Series(np.where(missing, part(null_cuts) - null_cuts, k * (wanted + 1) + np.where(on_bound, 1 + part(cuts), 0)))

    ranged = rows.withColumn("r", range_of("doc_id", "h"))
    first = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")
    heads = ranged.select("r", "doc_id", "h").groupBy("r").agg(F.max(first).alias("head"))
    listed = sorted((r["r"], r["head"]["doc_id"], r["head"]["h"]) for r in heads.collect())  # a row per range
    # a range's last row is followed by the head of the next lower range with rows, the lowest one's by the head of all
    follows = spark.createDataFrame([(r, head, h, listed[k + 1][0] if k + 1 < len(listed) else listed[0][0]) for k, (r, head, h) in enumerate(listed)], "hr long, head long, hh long, gets long")
    ghosts = (
        ranged.join(F.broadcast(follows), (F.col("r") == F.col("hr")) & (F.col("h") == F.col("hh")) & F.col("doc_id").eqNullSafe(F.col("head")))
        .groupBy("gets")
        .agg(F.max(F.struct("doc_id", "text")).alias("x"))
        .select(F.col("gets").alias("r"), F.lit(True).alias("ghost"), "x.doc_id", "x.text", F.lit(0).cast("long").alias("h"))
    )
    both = ranged.select("r", F.lit(False).alias("ghost"), "doc_id", "text", "h").unionByName(ghosts)
    walk = both.repartition(n, "r").sortWithinPartitions("r", "ghost", F.col("doc_id").desc_nulls_last(), F.desc("h"), F.col("text").desc())
    return walk.drop("h").mapInArrow(_walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _walk(batches):
    """Rows come by range, its ghost last; each but the ghost is paired with the row after it."""
    before = None
    for batch in batches:
        out = []
        for r, ghost, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            text = text.as_py()
            chunks = before[3] if before and before[2] == text else chunk_set(text.encode())
            if before and before[0] == r:
                _, own_id, own, own_chunks = before
                edited = edit(own, text).encode()
                edited_chunks = chunk_set(edited)
                out.append((own_id, len(own), hashlib.sha256(edited).hexdigest(), render(own_chunks), render(edited_chunks), likeness(own_chunks, edited_chunks), likeness(own_chunks, chunks)))
            before = None if ghost else (r, doc_id, text, chunks)
        cols = list(zip(*out, strict=True)) or [()] * len(_OUT)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)
