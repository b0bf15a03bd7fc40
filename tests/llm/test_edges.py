"""Nulls, empty tables, repeated rows and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from stockweave.llm import chat, chunks, graph, html_text, minhash, mixing, packing, quality, shards, topk, urls
from stockweave.llm.tokens import default_tokenizer

EXTRA = "doc string, component string, u string, v string, size int, taken int, key int, at_ int, n_shingles int"
ROWS = [(1, "a b c d e f", "en", "s", 11), (2, "A b c d e f", "en", None, 11), (2, "A b c d e f", "en", None, 11), (3, None, None, "s", None), (4, "", "en", "s", 0), (None, "x y", "en", "t", 3)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark):
    made = spark.createDataFrame(ROWS if request.param == "rows" else [], SCHEMA)
    return made.select("*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in EXTRA.split(", ")])


def test_documents(docs):
    n, tok = docs.count(), default_tokenizer()
    groups = minhash.near_duplicates(docs).collect()
    assert len(groups) == n and all(r["component_id"] == (1 if r["doc_id"] in (1, 2) else r["doc_id"]) for r in groups)
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == n and all(0 <= r["taken"] <= 3 * r["size"] for r in mixed)
    assert all(r["n_chars"] == len(r["text"]) for r in mixing.apply_mix(docs).collect())
    assert sum(r["start"] == 0 for r in packing.pack(docs, tok, 2).collect()) == n
    prints = chunks.edited_with_next(docs).collect()
    assert len(prints) == n and all(0 <= r["near_next"] <= 1 for r in prints)
    labels = docs.sparkSession.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    scored = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(scored) == n and all(0 <= r["score"] <= 1 for r in scored)
    read = sorted((r["start"], len(r["ids"]) // 4) for r in shards.read_shards(shards.write_shards(docs, tok, 2)).collect())
    assert len(read) == n and all(a[0] + a[1] == b[0] for a, b in zip(read, read[1:], strict=False))


@pytest.mark.parametrize("n", [0, 9])
def test_others(spark, n):
    pages = spark.createDataFrame([(1, "http://A.example.com/en/x", "<p>hi"), (1, "http://A.example.com/en/x", "<p>hi"), (2, None, None), (None, "no host", ""), (3, "ftp://", "<"), (4, "http://h.net/es/1", "&amp;")][:n], "page_id long, url string, html string").withColumns({"host": F.lit(1), "purity": F.lit(2), "s1": F.lit(None).cast("int")})
    assert urls.judge(pages).count() == html_text.extract(pages).count() == pages.count()
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "<|x"), (None, 2, "assistant", "y")][:n], "conv_id long, turn long, role string, text string")
    assert sum(len(r["t"]) for r in chat.format_conversations(turns).select(chat.read_turns(F.col("formatted")).alias("t")).collect()) == turns.count()
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [float("nan"), 1.0]), (None, [1.0, 1.0]), (4, []), (5, [1.0, None])][:n], "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = topk.top_k(vectors, F.col("vec_id") % 20 == 0).collect()
    assert len(got) == (6 if n else 0)


def test_rows_in_and_not_in(spark, monkeypatch):
    """Semi and anti join: nulls, repeated rows, empty sides, clashing names, and a filter whose every bit is set."""
    rows = spark.createDataFrame([(k % 50 if k % 7 else None, k) for k in range(200)] + [(3, 3)] * 2, "doc_id long, at_ long").withColumns({c: F.lit(1) for c in ("maybe_", "Bucket_", "bits_", "bits__")})
    plain = [tuple(r) for r in rows.collect()]
    for ids in ([], [None], [3, 3, 11, None, 999], list(range(40))):
        held = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        for bits in (1 << 25, 8):
            monkeypatch.setattr(graph, "FILTER_BITS", bits)
            known = {i for i in ids if i is not None}
            found, rest = ([tuple(r) for r in f(rows, held).collect()] for f in (graph.rows_in, graph.rows_not_in))
            assert sorted(found, key=str) == sorted((r for r in plain if r[0] in known), key=str)
            assert sorted(rest, key=str) == sorted((r for r in plain if r[0] not in known), key=str)
