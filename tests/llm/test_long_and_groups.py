"""Long texts and many turns, tiers and step groups of packing, exact words of the mix."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stockweave.llm import chat, chunks, html_text, minhash, mixing, packing, quality, shards
from stockweave.llm.tokens import default_tokenizer

DIR = "/root/testdata/sf0.001"


def packed(docs, **options):
    packer = packing.Packer(**options)
    for k, n in enumerate(docs):
        packer.add(k, np.arange(n, dtype="<u4").tobytes())
    packer.finish()
    return pd.DataFrame(packer.out, columns=["doc", "start", "length", "ids", "total", "sequence", "offset", "tier", "group"])


@pytest.mark.parametrize("seed", range(4))
def test_tiers_and_step_groups(seed):
    rng = np.random.default_rng(seed)
    docs = [int(x) for x in np.exp(rng.uniform(0, 10, 400))] + [1, 4096, 4097, 0]
    got = packed(docs)
    for k, part in got.sort_values("start").groupby("doc"):
        assert b"".join(part.ids) == np.arange(docs[k], dtype="<u4").tobytes() and (part.total == docs[k]).all()
    sizes = got.groupby("sequence").agg(length=("length", "sum"), tier=("tier", "first"), tiers=("tier", "nunique"), groups=("group", "nunique"), group=("group", "first"))
    assert (sizes.length == sizes.tier).all() and (sizes.tiers == 1).all() and (sizes.groups == 1).all()
    assert {n & (n - 1) for n in sizes.tier} == {0} and sizes.tier.max() == 4096
    tokens = sizes.groupby("group").length.sum()
    assert (tokens.iloc[:-1] == 8 * 4096).all() and tokens.iloc[-1] <= 8 * 4096 and got.length.sum() == sum(docs)
    small = [d for d in docs if 0 < d <= 512]
    whole = got[got.doc.isin([k for k, d in enumerate(docs) if 0 < d <= 512])]
    assert len(whole) < 1.5 * len(small)  # few short documents are cut


def test_cutting_a_long_document_is_linear():
    seconds = []
    for n in (1_000_000, 8_000_000):
        packer, ids = packing.Packer(), np.zeros(n, "<u4").tobytes()
        began = time.time()
        packer.add(1, ids)
        packer.finish()
        seconds.append(time.time() - began)
    assert seconds[1] < 40 * max(seconds[0], 0.01)


def test_mixed_words_are_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 5 + [(2, "d e f g h i j", "t"), (3, "k l", None), (4, None, "t"), (1, "a b c d", "s")], "doc_id long, text string, source string").withColumn("n_chars", F.lit(0)).withColumn("taken", F.lit("x"))
    for share in (1.0, 0.63):
        plan = mixing.mix(docs, share=share).groupBy("doc_id").agg(F.sum("taken").alias("t")).where("t > 0").collect()
        made = mixing.apply_mix(docs, share=share)
        assert made.columns == docs.columns
        words = made.groupBy("doc_id").agg(F.sum(mixing.n_words(F.col("text"))).alias("t")).collect()
        assert sorted(map(tuple, words)) == sorted(map(tuple, plan))


def test_mix_spreads_rows_of_one_id(spark):
    """Rows without an id, or of one id, have keys of their own; the draw is the plain one by the key."""
    rows = [(None if k % 4 else 7, f"word{k} " * (k % 5), "s" if k % 2 else "t") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = mixing.order_key(F.col("doc_id"), F.col("text"), 7)
    bins = docs.groupBy(F.substring(key, 1, 2)).count().agg(F.max("count"), F.count("*")).first()
    texts = docs.where("text <> ''")
    assert texts.select(key).distinct().count() == texts.count() and bins[1] == 256 and bins[0] < 900  # 800 rows have no words
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken"), F.first("target")).collect()
    assert all(r[1] == int(r[2] + 1e-9) for r in got)


def test_repeated_rows_teach_once(spark):
    """A labelled id with very many rows gives the model of one row."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    once, often = quality.train(docs, labels), quality.train(docs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(50)))), labels)
    assert once.base == often.base and all((a == b).all() for a, b in zip(once.tables + once.pair_tables, often.tables + often.pair_tables, strict=True))


def test_many_turns(spark):
    n = 3001
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é<|im_end|>"), F.col("id")).alias("text"))
    made = chat.format_conversations(rows.unionByName(rows.limit(2).withColumn("conv_id", F.lit(None).cast("int"))))
    got = made.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.size("loss_spans").alias("spans")).collect()
    assert len(got) == 3 and sum(r["conv_id"] is None and len(r["turns"]) == 1 for r in got) == 2
    one = next(r for r in got if r["conv_id"] == 1)
    assert [t["text"] for t in one["turns"]] == [f"é<|im_end|>{k}" for k in range(n)]
    assert one["loss"] == "".join(f"é<|im_end|>{k}" for k in range(n) if k % 3) and one["spans"] == sum(k % 3 > 0 for k in range(n))


def test_very_long_texts(spark):
    """A text of 20 MB goes whole through every operator on documents."""
    rng = np.random.default_rng(0)
    base = " ".join(f"word{x}" for x in rng.integers(0, 5000, 2_000_000))
    docs = spark.createDataFrame([(1, base, "en", "s", len(base)), (2, base + " end", "en", "s", 0), (3, "short text of a few words here", "en", "t", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    groups = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert groups[1][0] > 1_900_000 and groups[2] == (groups[1][0] + 1, 1) and groups[3] == (3, 3)
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()}
    assert sizes == {1: 2_000_000, 2: 2_000_001, 3: 7}
    prints = {r["doc_id"]: r for r in chunks.edited_with_next(docs).collect()}
    assert prints[2]["n_chars"] == len(base) + 4 and prints[2]["near_next"] > 0.99
    x = quality.features(__import__("pyarrow").array([base, base + " end"]))
    assert np.allclose(x[0], x[1], rtol=1e-3, atol=1e-5)
    tok = default_tokenizer()
    pieces = packing.pack(docs, tok, 2).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    read = {r["doc_id"]: len(r["ids"]) // 4 for r in shards.read_shards(shards.write_shards(docs, tok, 2)).collect()}
    assert {r["doc_id"]: r["n"] for r in pieces} == read == {r["doc_id"]: r["d"] for r in pieces}
    blocks = [f"block {k} {x}" for k, x in enumerate(base[:5_000_000].split("word7"))]
    page = "<body><div class='menu'><a href='/'>home</a></div><article>" + "".join(f"<p>{w}</p>" for w in blocks) + "</article></body>"
    assert html_text.main_text(page).split("\n") == [" ".join(x.split()) for x in blocks]
