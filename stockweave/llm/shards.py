"""Token-id output as sorted-string-table shards.

``write_shards`` range-partitions documents by identifier, encodes each whole text and writes one shard per
partition; ``read_shards`` reads every record back, ``lookup`` fetches identifiers by key range, Bloom filter, sparse
index and binary search.

File: blocks, index, Bloom filter, footer. A block holds records in key order, each
``shared, rest, 2 * value length + narrow (u32 each), rest of key, value``: a key drops the prefix that it shares with the
one before it; every ``RESTART``-th key of a block is whole, and the block ends with the offsets of these and their number
(u32 each), so a block is searched by halving. The index has ``offset, length, first key`` of every block. A value is token
ids as unsigned 16-bit integers where all ids of the record fit (narrow), else 32-bit.

Defined results: null text is empty (only the end id); a null doc_id sorts first and reads back as null;
repeated rows each keep a record; an empty table gives no shard; other columns are ignored.
Rows of one doc_id, or of none, stand in the order of a hash of their texts, then of the texts, and may lie in several shards.
Shards are written under a temporary name and renamed, in place of an earlier attempt's file, so a task that runs twice
leaves one whole file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockweave.llm.tokens import encoder
from stockweave.session import attach, materialize, shared_dir, shuffle_partitions

MAGIC = b"SWSST001"
BLOCK_BYTES = 64 << 10
RESTART = 16
_FOOTER = struct.Struct("<QQQQQQB")  # index at, index length, bloom at, bloom length, records, tokens, hashes
_RECORD = struct.Struct("<III")
_NULL_KEY = b""
HASHES = 7


def key_of(doc_id: int | None) -> bytes:
    """Byte order is numeric order; null comes first."""
    return _NULL_KEY if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _hashes(key: bytes) -> tuple[int, int]:
    return zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1


def _bloom_bits(first, step, n_bits: int, hashes: int) -> list:
    return [(first + i * step) % n_bits for i in range(hashes)]


class ShardWriter:
    """Streams records in key order; holds one block and 8 + 10/8 bytes a key in memory."""

    def __init__(self, out):
        self.out, self.at, self.block, self.block_key, self.last = out, 0, [], b"", b""
        self.size, self.count, self.restarts, self.index, self.tokens = 0, 0, [], [], 0
        self.first_key: bytes | None = None
        self.hashed = array("I")

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.block and self.size >= BLOCK_BYTES:
            self._flush()
        if not self.block:
            self.block_key = key
        shared = 0
        if self.count % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(self.size)
        narrow = not len(ids) or int(ids.max()) < 1 << 16
        value = ids.astype("<u2" if narrow else "<u4").tobytes()
        self.block += [_RECORD.pack(shared, len(key) - shared, len(value) << 1 | narrow), key[shared:], value]
        self.size += len(value) + len(key) - shared + _RECORD.size
        self.count += 1
        self.last, self.tokens = key, self.tokens + len(ids)
        self.first_key = key if self.first_key is None else self.first_key
        self.hashed.extend(_hashes(key))

    @property
    def records(self) -> int:
        return len(self.hashed) // 2

    def _flush(self) -> None:
        raw = b"".join(self.block) + np.array([*self.restarts, len(self.restarts)], "<u4").tobytes()
        self.out.write(raw)
        self.index.append((self.at, len(raw), self.block_key))
        self.at += len(raw)
        self.block, self.size, self.count, self.restarts = [], 0, 0, []

    def close(self) -> None:
        if self.block:
            self._flush()
        index = b"".join(struct.pack("<QQB", a, n, len(k)) + k for a, n, k in self.index)
        n_bits = max(64, 10 * self.records)
        bits = np.zeros(n_bits, bool)
        first, step = np.array(self.hashed, np.uint64).reshape(-1, 2).T
        for places in _bloom_bits(first, step, n_bits, HASHES):
            bits[places.astype(np.int64)] = True
        bloom = struct.pack("<Q", n_bits) + np.packbits(bits).tobytes()
        footer = _FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.records, self.tokens, HASHES)
        self.out.write(index + bloom + footer + MAGIC)


class ShardReader:
    def __init__(self, file, size: int):
        self.file = file
        tail = self._at(size - _FOOTER.size - len(MAGIC), _FOOTER.size + len(MAGIC))
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a shard, or cut short")
        self.index_at, self.index_n, self.bloom_at, self.bloom_n, self.records, self.tokens, self.hashes = _FOOTER.unpack(tail[: _FOOTER.size])

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def index(self) -> list[tuple[int, int, bytes]]:
        """(offset, length, first key) of every block."""
        raw, out, i = self._at(self.index_at, self.index_n), [], 0
        while i < len(raw):
            a, m, k = struct.unpack_from("<QQB", raw, i)
            out.append((a, m, raw[i + 17 : i + 17 + k]))
            i += 17 + k
        return out

    @staticmethod
    def _restarts(raw: bytes) -> tuple[int, np.ndarray]:
        """(where the records end, offsets of the whole keys)."""
        n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
        end = len(raw) - 4 * (n + 1)
        return end, np.frombuffer(raw, "<u4", n, end)

    @staticmethod
    def _records(raw: bytes, i: int, end: int):
        key = b""
        while i < end:
            shared, rest, value = _RECORD.unpack_from(raw, i)
            i += _RECORD.size
            key = key[:shared] + raw[i : i + rest]
            i += rest
            yield key, np.frombuffer(raw, "<u2" if value & 1 else "<u4", (value >> 1) // (2 if value & 1 else 4), i)
            i += value >> 1

    def __iter__(self):
        for at, n, _ in self.index():
            raw = self._at(at, n)
            yield from self._records(raw, 0, self._restarts(raw)[0])

    def maybe_has(self, key: bytes) -> bool:
        bloom = self._at(self.bloom_at, self.bloom_n)
        n_bits = struct.unpack_from("<Q", bloom)[0]
        return all(bloom[8 + b // 8] >> (7 - b % 8) & 1 for b in _bloom_bits(*_hashes(key), n_bits, self.hashes))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """All records of an identifier: Bloom filter, then halving of the sparse index and of the block's whole keys."""
        key = key_of(doc_id)
        if not self.maybe_has(key):
            return []
        index, found = self.index(), []
        # a key may begin in the block before the first one that starts with it
        for at, n, first in index[max(0, bisect_left([k for *_, k in index], key) - 1) :]:
            if first > key:
                break
            raw = self._at(at, n)
            end, restarts = self._restarts(raw)
            whole = lambda i: raw[i + _RECORD.size : i + _RECORD.size + _RECORD.unpack_from(raw, i)[1]]  # noqa: E731, B023
            start = max(0, bisect_left(restarts.tolist(), key, key=whole) - 1)
            for k, ids in self._records(raw, int(restarts[start]), end):
                if k > key:
                    return found
                if k == key:
                    found.append(ids)
        return found


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def replace(files, temporary: str, final: str) -> None:
    """Move a whole file to its name, on file systems too that refuse to move onto a file: a task that runs again writes the
    same records, so the file of the attempt before goes first."""
    from pyarrow import fs

    if files.get_file_info(final).type != fs.FileType.NotFound:
        files.delete_file(final)
    files.move(temporary, final)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, partitions: int | None = None) -> DataFrame:
    """Write one shard per key range; returns the manifest (shard, path, records, tokens, first_key, last_key, folder), a small written table."""
    spark = docs.sparkSession
    attach(spark)
    folder = folder or f"{shared_dir(spark)}/stockweave/shards-{uuid.uuid4().hex}"

    def encode(batches):
        shard = TaskContext.get().partitionId()
        files, root = _filesystem(folder)
        enc, writer, out = encoder(tokenizer), None, None
        end = np.array([end_id], "<u4")
        temporary, final = f"{root}/_{shard:06d}-{uuid.uuid4().hex}", f"{root}/shard-{shard:06d}.sst"
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(temporary)
                    writer = ShardWriter(out)
                writer.add(key_of(doc_id), np.concatenate([np.frombuffer(enc.ids_of(text.as_py()), "<u4"), end]))
        if writer is not None:
            writer.close()
            out.close()
            replace(files, temporary, final)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [final], "records": [writer.records], "tokens": [writer.tokens], "first_key": pa.array([writer.first_key], pa.binary()), "last_key": pa.array([writer.last], pa.binary())})

    # rows of one id, or of none, go by a hash of their text: however many, they are cut into ranges as others are
    order = [F.col("doc_id").asc_nulls_first(), F.col("by_text")]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("by_text"))
    ordered = keyed.repartitionByRange(partitions or shuffle_partitions(spark), *order).sortWithinPartitions(*order, "text").drop("by_text")
    manifest = ordered.mapInArrow(encode, "shard long, path string, records long, tokens long, first_key binary, last_key binary")
    return materialize(manifest.withColumn("folder", F.lit(folder)), "manifest")


def _opened(row: dict):
    files, _ = _filesystem(row["folder"])
    return files.open_input_file(row["path"]), files.get_file_info(row["path"]).size


def footers(manifest: DataFrame) -> DataFrame:
    """shard, path, folder, records, tokens, as the files' own footers say."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file, size = _opened(row)
                with file:
                    reader = ShardReader(file, size)
                    yield pa.RecordBatch.from_pylist([{**row, "records": reader.records, "tokens": reader.tokens}])

    return manifest.select("shard", "path", "folder").repartition(shuffle_partitions(manifest.sparkSession), "shard").mapInArrow(read, "shard long, path string, folder string, records long, tokens long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit), from the files alone.

    The window runs over one row per shard.
    """
    spark = manifest.sparkSession
    attach(spark)
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = footers(manifest).select("shard", "path", "folder", F.coalesce(F.sum("tokens").over(w), F.lit(0)).alias("base"))

    def rows(ids, starts, values):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())], ["doc_id", "start", "ids"])

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file, size = _opened(row)
                with file:
                    at, ids, starts, values, held = row["base"], [], [], [], 0
                    for key, tokens in ShardReader(file, size):
                        ids.append(id_of(key))
                        starts.append(at)
                        values.append(tokens.astype("<u4").tobytes())
                        at, held = at + len(tokens), held + 4 * len(tokens)
                        if held > 4 << 20:
                            yield rows(ids, starts, values)
                            ids, starts, values, held = [], [], [], 0
                    yield rows(ids, starts, values)

    return based.repartition(shuffle_partitions(spark), "shard").mapInArrow(read, "doc_id long, start long, ids binary")


def lookup(spark: SparkSession, manifest: DataFrame, doc_id: int | None) -> list[list[int]]:
    """Token ids of one identifier's records. Only the shards whose key range holds it are opened: one, or few for a repeated id."""
    out = []
    for row in manifest.where((F.col("first_key") <= F.lit(key_of(doc_id))) & (F.col("last_key") >= F.lit(key_of(doc_id)))).orderBy("shard").toLocalIterator():
        file, size = _opened(row.asDict())
        with file:
            out += [x.tolist() for x in ShardReader(file, size).get(doc_id)]
    return out
