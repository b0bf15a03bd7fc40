"""Chunk boundaries and containment against plain versions, hot ids, and the parts of a shard file."""

import io
import random

import numpy as np
import pandas as pd
import pytest

from stockweave.llm import chunks, shards
from stockweave.llm.tokens import default_tokenizer

DIR = "/root/testdata/sf0.001"


def plain_ends(data):
    """One byte at a time: the hash is shifted and takes the byte's number; its top bits decide."""
    ends, h, start = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(chunks._GEAR[b])) & 0xFFFFFFFF
        n = i + 1 - start
        mask = chunks._STRICT if n < chunks.NORMAL else chunks._LOOSE
        if n >= chunks.LEAST and h & int(mask) == 0 or n == chunks.GREATEST:
            ends.append(i + 1)
            start = i + 1
    return ends + [len(data)] if start < len(data) else ends


def texts():
    docs = pd.read_parquet(f"{DIR}/documents.parquet").text.dropna().tolist()
    return [t.encode() for t in docs[:60]] + [b"", b"a", b"ab" * 500, bytes(range(256)) * 9, b"\0" * 3000]


def test_boundaries():
    for data in texts():
        got = chunks._ends(np.frombuffer(data, np.uint8)) if data else []
        assert got == plain_ends(data)


def test_likeness_is_containment():
    rng = random.Random(1)
    sets = [chunks.chunk_set(t) for t in texts()]
    for _ in range(300):
        a, b = rng.choice(sets), rng.choice(sets)
        small = min(sum(a.values()), sum(b.values()))
        common = sum(n for d, n in a.items() if d in b)
        assert chunks.likeness(a, b) == (float(not a and not b) if not a or not b else common / small)
        assert chunks.parse(chunks.render(a)) == a


def test_an_insertion_moves_few_chunks():
    rng = np.random.default_rng(2)
    data = bytes(rng.integers(32, 127, 20_000, dtype=np.uint8))
    edited = data[:9000] + b"inserted words" + data[9000:]
    assert chunks.likeness(chunks.chunk_set(data), chunks.chunk_set(edited)) > 0.97




def test_hot_and_null_ids(spark):
    rows = [(7, f"text {k % 40} of the hot id") for k in range(300)] + [(None, f"null {k}") for k in range(200)] + [(k, f"doc {k}") for k in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = chunks.edited_with_next(docs, 4).toPandas()
    assert len(got) == len(rows) and got.doc_id.isna().sum() == 200 and (got.doc_id == 7).sum() == 300
    # each document is followed by exactly one other: the edited texts of distinct neighbours close one ring
    plain = chunks.fingerprint(docs).toPandas()
    assert sorted(plain.fingerprint) == sorted(got.fingerprint)
    by_text = got.groupby("fingerprint").n_chars.nunique()
    assert (by_text == 1).all()


def test_neighbours_of_distinct_ids(spark):
    """Every likeness by the plain definitions, over many ranges."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    rows = {rng.randrange(-(10**12), 10**12): " ".join(rng.choices(words, k=rng.randrange(0, 200))) for _ in range(150)}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in chunks.edited_with_next(docs, 6).collect()}
    ids = sorted(rows, reverse=True)
    for k, i in enumerate(ids):
        following = rows[ids[(k + 1) % len(ids)]]
        own, nxt, ed = (chunks.chunk_set(t.encode()) for t in (rows[i], following, chunks.edit(rows[i], following)))
        assert got[i]["near_next"] == chunks.likeness(own, nxt) and got[i]["near_edited"] == chunks.likeness(own, ed)
        assert got[i]["fingerprint"] == chunks.render(own) and got[i]["edited_fingerprint"] == chunks.render(ed)


@pytest.fixture(scope="module")
def records():
    rng = random.Random(5)
    ids = sorted([None, *[rng.randrange(-500, 500) for _ in range(3000)], 7, 7, 7], key=lambda i: (i is not None, i or 0))
    return [(i, np.array([rng.randrange(1 << rng.choice([8, 20])) for _ in range(rng.randrange(0, 40))], "<u4")) for i in ids]


def test_shard_file(records, monkeypatch):
    monkeypatch.setattr(shards, "BLOCK_BYTES", 2000)
    out = io.BytesIO()
    writer = shards.ShardWriter(out)
    for i, ids in records:
        writer.add(shards.key_of(i), ids)
    writer.close()
    raw = out.getvalue()
    reader = shards.ShardReader(io.BytesIO(raw), len(raw))
    assert [(shards.id_of(k), v.tolist()) for k, v in reader] == [(i, v.tolist()) for i, v in records]
    assert reader.records == len(records) and reader.tokens == sum(len(v) for _, v in records)
    index = reader.index()
    assert len(index) > 20 and [k for *_, k in index] == sorted(k for *_, k in index)
    block = raw[index[3][0] : index[3][0] + index[3][1]]
    end, restarts = reader._restarts(block)
    keys = [k for k, _ in reader._records(block, 0, end)]
    assert len(restarts) == -(-len(keys) // shards.RESTART) and keys[0] == index[3][2]
    for n, at in enumerate(restarts.tolist()):
        assert next(reader._records(block, at, end))[0] == keys[n * shards.RESTART]
    for i in (None, 7, -500, 499, *[r[0] for r in records[::97]]):
        assert [v.tolist() for v in reader.get(i)] == [v.tolist() for j, v in records if j == i]
    present = {shards.key_of(i) for i, _ in records}
    assert all(map(reader.maybe_has, present))
    absent = [shards.key_of(i) for i in range(10**6, 10**6 + 3000)]
    assert sum(map(reader.maybe_has, absent)) < 0.03 * len(absent) and reader.get(10**6) == []


def test_lookup_opens_one_shard(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(200)] + [(5, "again"), (None, "no id")], "doc_id long, text string")
    manifest = shards.write_shards(docs, default_tokenizer(), 2, partitions=6)
    want = {}
    for r in shards.read_shards(manifest).collect():
        want.setdefault(r["doc_id"], []).append(np.frombuffer(r["ids"], "<u4").tolist())
    opened = []
    real = shards._opened
    monkeypatch.setattr(shards, "_opened", lambda row: opened.append(row["path"]) or real(row))
    for i in (0, 5, 77, 199, None):
        opened.clear()
        assert sorted(shards.lookup(spark, manifest, i)) == sorted(want[i]) and len(opened) <= 2
    assert shards.lookup(spark, manifest, 10**9) == [] and manifest.count() > 3
    told = shards.footers(manifest).select("shard", "records", "tokens").collect()
    assert sorted(told) == sorted(manifest.select("shard", "records", "tokens").collect())


class Strict:
    """A file system of names that refuses to move onto one that is there."""

    def __init__(self, *names):
        self.names = set(names)

    def get_file_info(self, name):
        from pyarrow import fs

        return fs.FileInfo(name, fs.FileType.File if name in self.names else fs.FileType.NotFound)

    def delete_file(self, name):
        self.names.remove(name)

    def move(self, a, b):
        assert a in self.names and b not in self.names
        self.names.remove(a)
        self.names.add(b)


def test_a_second_attempt_replaces_the_file():
    for there in ((), ("shard-1",)):
        files = Strict("_temporary", *there)
        shards.replace(files, "_temporary", "shard-1")
        assert files.names == {"shard-1"}


def test_hot_and_null_ids_lie_in_several_shards(spark):
    rows = [(None, f"text {k}") for k in range(1500)] + [(7, f"other {k}") for k in range(900)] + [(k, "x") for k in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = shards.write_shards(docs, default_tokenizer(), 2, partitions=8)
    sizes = [r["records"] for r in manifest.collect()]
    assert sum(sizes) == len(rows) and len(sizes) >= 7 and max(sizes) < 700
    read = shards.read_shards(manifest).collect()
    assert len(read) == len(rows) and sum(r["doc_id"] is None for r in read) == 1500
    ends = sorted((r["start"], r["start"] + len(r["ids"]) // 4) for r in read)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    order = [r["doc_id"] if r["doc_id"] is not None else -1 for r in sorted(read, key=lambda r: r["start"])]
    assert order == sorted(order)
    assert len(shards.lookup(spark, manifest, 7)) == 900 and len(shards.lookup(spark, manifest, None)) == 1500
