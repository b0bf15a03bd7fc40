"""Ranked lexical search, score at a time: postings grouped by exact impact, processed in descending order.

1. Query terms set bits of a filter of fixed size. Documents are read once: a batch of whole texts becomes one shard of the
   index, a written row with its postings (term, document, occurrences) of terms that pass the filter, and every
   document's length. The filter only saves work; a full one lets every term pass.
2. N, L and each term's df are aggregations over shards; queries get their terms' weights, in groups of bounded terms.
3. A shard meets every group. Its postings of a term are put in order of impact, which is a whole number: equal impacts
   stand together. A query's lists are processed from the highest impact down, band by band: a band takes every
   posting of every list from the next bound up. It stops once k documents have more than any other can still reach,
   as the first impact left of each list bounds what a document can gain. The documents that can be among the first k get
   their scores completed from the lists left.
4. A shard gives at most k documents a query; a window per query merges them, with a limit in every task first.

Terms are 64-bit hashes of lower-cased runs of ASCII letters, digits and all characters from U+0080.

Defined results: null texts have no terms; rows of one query id are one query of all their terms; documents without an
id count in the statistics and are not ranked; repeated rows are documents of their own and are ranked next to each
other; a query without terms, without an id or without matches has no rows; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockweave.llm.topk import copies
from stockweave.llm.words import slices, trimmed, word_hashes
from stockweave.session import attach, materialize, shuffle_partitions

#: Bits of the term filter: 2 MB, whatever the number of queries.
FILTER_BITS = 1 << 24
#: Most text and documents of a shard; most terms of a group of queries (or one query's).
SHARD_BYTES, SHARD_DOCS, GROUP_TERMS = 16 << 20, 1 << 14, 1 << 16
#: Fixed values of the score.
B_PERCENT, K, IMPACT = 50, 20, 1_000_000_000
_APART = np.ones(256, bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_SHARD = "tokens long, filled long, ids binary, named binary, lengths binary, terms binary, starts binary, docs binary, counts binary"
_HIT = "item_id long, doc_id long, score long"


def _terms(column: pa.Array):
    """(first row, rows, term hash of each occurrence, row offsets) for each slice of texts."""
    for row, n, data, offsets in slices(column):
        hashes, at, _ = word_hashes(data, offsets, _APART)
        yield row, n, hashes, at


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of every item(item_id, text) that has an id."""

    def run(batches):
        for batch in batches:
            for row, n, hashes, at in _terms(batch.column(1)):
                ids = batch.column(0).slice(row, n).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, np.diff(at))), pa.array(hashes.view(np.int64))], ["item_id", "term"])

    found = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term long")
    return found.distinct()


def term_filter(terms: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A byte array of bits / 8 bytes whose bit (term mod bits) is set for every term."""
    at = F.pmod("term", F.lit(bits)) + 1  # Spark's bitmaps count from 1
    found = terms.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in found.toLocalIterator():  # at most bits / 32768 rows of 4 KB
        part = np.frombuffer(r["bits"], np.uint8)
        out[(r["bucket"] - 1) * 4096 :][: len(part)] |= part
    return out


def _narrow(values: np.ndarray) -> bytes:
    """The dtype's letter, then the values in the smallest unsigned type that holds them."""
    kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
    return kind.char.encode() + values.astype(kind).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[1:], raw[:1].decode()).astype(np.int64)


def build_index(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """One row a shard: the documents' ids and lengths, and postings by term. Written by the caller."""
    attach(docs.sparkSession)
    bits = len(wanted) * 8
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def shard(ids, named, lengths, rows, terms, counts):
        order = np.lexsort((rows, terms))
        terms, rows, counts = terms[order], rows[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
        row = [int(lengths.sum()), int((lengths > 0).sum()), ids.tobytes(), named.tobytes(), _narrow(lengths), terms[first].tobytes(), np.append(first, len(terms)).astype(np.int64).tobytes(), _narrow(rows), _narrow(counts)]
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 7]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _SHARD.split(", ")])

    def run(batches):
        passes = np.unpackbits(shared.value, bitorder="little").view(bool)
        held, n_rows, n_bytes = [], 0, 0
        for batch in batches:
            known = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for row, n, hashes, at in _terms(batch.column(1)):
                lengths, owner = np.diff(at), np.repeat(np.arange(n), np.diff(at))
                hit = passes[(hashes % np.uint64(bits)).astype(np.int64)]
                terms, owner = hashes[hit], owner[hit]
                order = np.lexsort((terms, owner))
                terms, owner = terms[order], owner[order]
                new = np.ones(len(terms), bool)
                new[1:] = (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                held.append((known[row : row + n].astype(np.int64), named[row : row + n], lengths, owner[first] + n_rows, terms[first].view(np.int64), np.diff(np.append(first, len(terms)))))
                n_rows, n_bytes = n_rows + n, n_bytes + 6 * len(hashes)
                if n_rows >= SHARD_DOCS or n_bytes >= SHARD_BYTES:
                    yield shard(*map(np.concatenate, zip(*held, strict=True)))
                    held, n_rows, n_bytes = [], 0, 0
        if held:
            yield shard(*map(np.concatenate, zip(*held, strict=True)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), _SHARD)


def document_frequencies(index: DataFrame) -> DataFrame:
    """term, df: documents of all shards that hold the term."""

    def run(batches):
        for batch in batches:
            for terms, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int64)), pa.array(np.diff(np.frombuffer(starts, np.int64)))], ["term", "df"])

    return index.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def best_documents(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores): the k highest sums of impacts above 0, ties by id, in order.

    lists has a term's (impacts descending, documents). Bands go down the impacts of all lists; a stop leaves the rest.
    """
    score = np.zeros(n_docs, np.int64)
    done = np.zeros(len(lists), np.int64)
    left = np.array([impacts[0] if len(impacts) else 0 for impacts, _ in lists], np.int64)
    while left.any():
        bound = int(left.max()) * 3 // 4
        for t in np.flatnonzero(left > bound).tolist():
            impacts, docs = lists[t]
            end = len(impacts) - int(np.searchsorted(impacts[::-1], bound, "right"))
            score[docs[done[t] : end]] += impacts[done[t] : end]
            done[t] = end
            left[t] = impacts[end] if end < len(impacts) else 0
        rest = int(left.sum())
        if n_docs > k and rest:
            kth = int(np.partition(score, n_docs - k)[n_docs - k])
            if rest < kth and np.count_nonzero(score + rest >= kth) <= 4 * k:
                break
    else:
        rest = 0
    if n_docs > k:
        kth = max(1, int(np.partition(score, n_docs - k)[n_docs - k]))
        able = np.flatnonzero(score + rest >= kth)
    else:
        able = np.flatnonzero(score)
    full = score[able]
    if rest:  # complete the scores of those that can be among the first
        place = np.full(n_docs, -1, np.int64)
        place[able] = np.arange(len(able))
        for t in np.flatnonzero(left).tolist():
            impacts, docs = lists[t]
            at = place[docs[done[t] :]]
            full[at[at >= 0]] += impacts[done[t] :][at >= 0]
    order = np.lexsort((ids[able], -full))[:k]
    order = order[full[order] > 0]
    return able[order], full[order]


def _search(k: int, n: int, tokens: int):
    """Rows come by shard, the shard first, then its groups of queries."""

    def run(batches):
        lists, shard = {}, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["terms"] is not None:
                    shard, lists = r["shard"], {}
                    ids, named, lengths = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["named"], bool), _wide(r["lengths"])
                    m = 100 - B_PERCENT + (B_PERCENT * lengths * n) // max(1, tokens)
                    terms, starts, docs, counts = np.frombuffer(r["terms"], np.int64), np.frombuffer(r["starts"], np.int64), _wide(r["docs"]), _wide(r["counts"])
                    continue
                if shard is None or shard != r["shard"]:
                    continue
                asked, offsets, weights = (np.frombuffer(r[c], np.int64) for c in ("asked", "offsets", "weights"))
                at = np.searchsorted(terms, asked)
                hit = np.flatnonzero(terms[np.minimum(at, max(0, len(terms) - 1))] == asked) if len(terms) else np.zeros(0, np.int64)
                for j in hit.tolist():
                    if asked[j].item() not in lists:
                        lo, hi = starts[at[j]], starts[at[j] + 1]
                        ranked = named[docs[lo:hi]]
                        own, tf = docs[lo:hi][ranked], counts[lo:hi][ranked]
                        impacts = weights[j] * ((IMPACT * tf) // (1000 * tf + K * m[own]))
                        order = np.argsort(-impacts, kind="stable")
                        lists[asked[j].item()] = impacts[order], own[order]
                out = []
                cuts = np.searchsorted(hit, offsets)
                for q, item in enumerate(np.frombuffer(r["items"], np.int64).tolist()):
                    mine = hit[cuts[q] : cuts[q + 1]]
                    if len(mine):
                        found, score = best_documents([lists[asked[j].item()] for j in mine.tolist()], len(ids), ids, k)
                        out.append((np.full(len(found), item), ids[found], score))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["item_id", "doc_id", "score"])

    return run


def _groups(weighted: DataFrame, most: int) -> DataFrame:
    """items, asked, offsets, weights (binary): queries of one group after another; rows come sorted by item."""

    def run(batches):
        ids, terms, weights = (np.zeros(0, np.int64) for _ in range(3))

        def row(n):
            new = np.flatnonzero(np.concatenate([[True], ids[1:n] != ids[: n - 1]]))
            values = [ids[new], terms[:n], np.append(new, n), weights[:n]]
            return pa.RecordBatch.from_arrays([pa.array([v.astype(np.int64).tobytes()], pa.binary()) for v in values], ["items", "asked", "offsets", "weights"])

        for batch in batches:
            ids, terms, weights = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((ids, 0), (terms, 1), (weights, 2)))
            while len(ids) > most:
                ends = np.flatnonzero(ids[1:] != ids[:-1]) + 1
                if not len(ends):
                    break
                n = int(ends[max(0, np.searchsorted(ends, most, "right") - 1)])
                yield row(n)
                ids, terms, weights = ids[n:], terms[n:], weights[n:]
        if len(ids):
            yield row(len(ids))

    return weighted.mapInArrow(run, "items binary, asked binary, offsets binary, weights binary")


def search(docs: DataFrame, items: DataFrame, k: int = 50, group_terms: int = GROUP_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: for every item its k best documents."""
    spark = docs.sparkSession
    attach(spark)
    asked = materialize(query_terms(items), "query-terms")
    index = materialize(build_index(docs, term_filter(asked)).withColumn("shard", F.monotonically_increasing_id()), "impact-index")
    n, tokens, shards = index.agg(F.sum("filled"), F.sum("tokens"), F.count("*")).first()
    weight = F.floor(1000 * F.log((2 * F.lit(n or 0) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked.join(document_frequencies(index), "term").select("item_id", "term", weight.alias("weight")).where("weight > 0")
    sorted_ = weighted.repartitionByRange(shuffle_partitions(spark), "item_id").sortWithinPartitions("item_id", "term")
    groups = materialize(_groups(sorted_, group_terms), "query-groups")
    # every group visits every shard: shards are numbered by the task that wrote them and their place in it
    task, place = F.shiftright("shard", 33), F.col("shard").bitwiseAND((1 << 33) - 1)
    most, tasks = index.agg(F.max(place) + 1, F.max(task) + 1).first()
    index = index.withColumn("shard", (task * F.lit(most or 1) + place).cast("int"))
    met = copies(groups.withColumn("times", F.lit((most or 0) * (tasks or 0)).cast("int")), "shard", "times").drop("times")
    met = index.unionByName(met, allowMissingColumns=True).repartition(max(1, min(shards, 4 * shuffle_partitions(spark))), "shard")
    found = met.sortWithinPartitions("shard", F.col("terms").isNull()).mapInArrow(trimmed(_search(k, n or 0, tokens or 0)), _HIT)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
