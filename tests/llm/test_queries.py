"""Every corpus query against a brute-force version over the same whole tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from stockweave.llm import queries, quality
from stockweave.llm.tokens import default_tokenizer

DIR = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DIR}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def ascii_lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def shingles(text):
    words = WORD.findall(ascii_lower(text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(sets):
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    seen = set()
    for members in holders.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                        x, y = sorted((top(a), top(b)))
                        parent[y] = x
    return {i: top(i) for i in sets}


def test_op1(spark, docs):
    got = queries.op1_minhash_dedup(spark, DIR).toPandas().set_index("doc_id")
    sets = {i: shingles(t) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    want = components(sets)
    assert len(got) == len(docs)
    for i, s in sets.items():
        assert (got.n_shingles[i], got.component_id[i], got.kept[i]) == (len(s), want[i], want[i] == i)


def test_op2(spark, docs):
    got = queries.op2_source_mix(spark, DIR).toPandas()
    size = dict(zip(docs.doc_id, (len(WORD.findall(t or "")) for t in docs.text), strict=True))
    by = docs.assign(size=docs.doc_id.map(size)).groupby("source", dropna=False)["size"].sum()
    names = sorted((s for s in by.index if isinstance(s, str)), key=lambda s: [ord(c) for c in s]) + [s for s in by.index if not isinstance(s, str)]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, float(by.sum()), list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * left / total > 3 * by[s]]
        if not over:
            target |= {s: weight[s] * left / total for s in open_}
            break
        for s in over:
            target[s] = 3.0 * by[s]
            left -= target[s]
            open_.remove(s)
    assert len(got) == len(docs)
    assert (got["size"] == got.doc_id.map(size)).all() and (got.taken <= 3 * got["size"]).all()
    source = docs.set_index("doc_id").source
    for s, rows in got.groupby(got.doc_id.map(source), dropna=False):
        assert rows.target.iloc[0] == pytest.approx(target[s], rel=1e-12)
        assert rows.taken.sum() == int(rows.target.iloc[0] + 1e-9)
        assert rows.source_size.iloc[0] == by[s]


def test_op3(spark):
    got = queries.op3_url_filter(spark, DIR).toPandas().set_index("page_id")
    pages = pd.read_parquet(f"{DIR}/pages.parquet")
    assert len(got) == len(pages)
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    for i, url in zip(pages.page_id, pages.url, strict=True):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = ascii_lower(host)
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        row = got.loc[i]
        assert (row.host, row.path) == (host, path)
        if fits:
            assert (row["rule"], row.verdict) == max(fits)[1:]
        else:
            assert row["rule"] is None and row.verdict in ("allow", "block")


def token_ids(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for i, x in zip(docs.doc_id, docs.text, strict=True)}


def test_op4(spark, docs):
    got = queries.op4_pack(spark, DIR).toPandas()
    ids = token_ids(docs)
    for i, rows in got.sort_values("start").groupby("doc_id"):
        at = 0
        for r in rows.itertuples():
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    assert set(got.doc_id) == set(ids)
    padding = 0
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert (rows.offset == rows.length.cumsum().shift(fill_value=0)).all() and rows.length.sum() <= 4096
        n = int(rows.length.sum())
        padding += 0 if n & (n - 1) == 0 else 4096 - n
    assert padding == 0


def test_op5(spark, docs):
    got = queries.op5_fingerprints(spark, DIR).toPandas().set_index("doc_id")
    texts = docs.sort_values("doc_id", ascending=False)
    ids, values = texts.doc_id.tolist(), [t or "" for t in texts.text]
    assert len(got) == len(ids)
    for k, (i, t) in enumerate(zip(ids, values, strict=True)):
        n = values[(k + 1) % len(ids)]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + n[:cut]
        row = got.loc[i]
        assert row.n_chars == len(t) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row.near_next <= 1 and 0 <= row.near_edited <= 1
        if len(t) > 1000 and n != t:
            assert row.near_edited > 0.4
    assert got.near_next.median() < 0.1
    same = docs.assign(f=got.loc[docs.doc_id].fingerprint.values).groupby("text").f.nunique()
    assert (same == 1).all()


def test_op6(spark):
    got = queries.op6_topk(spark, DIR).toPandas()
    rows = pd.read_parquet(f"{DIR}/embeddings.parquet").sort_values("vec_id")
    v = np.floor(64 * np.stack(rows.embedding).astype(float)).astype(np.int64)
    ids = rows.vec_id.to_numpy()
    assert got.query_id.nunique() == (ids % 20 == 0).sum()
    for q, part in got.sort_values("rank").groupby("query_id"):
        scores = v @ v[ids == q][0]
        order = [k for k in np.lexsort((ids, -scores)) if ids[k] != q][:20]
        assert part.vec_id.tolist() == ids[order].tolist() and part.score.tolist() == scores[order].tolist()
        assert part["rank"].tolist() == list(range(1, len(order) + 1))


def test_op7(spark):
    got = queries.op7_chat_format(spark, DIR).toPandas().set_index("conv_id")
    rows = pd.read_parquet(f"{DIR}/conversations.parquet")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = pd.DataFrame({"conv_id": [-1, -1], "turn": [0, 1], "role": ["user", "assistant"], "text": [said, said]})
    rows = pd.concat([rows, extra])
    assert len(got) == rows.conv_id.nunique()
    for c, part in rows.sort_values("turn").groupby("conv_id"):
        text = [t or "" for t in part.text]
        loss = "".join(t for r, t in zip(part.role, text, strict=True) if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in zip(part.role, text, strict=True))
        row = got.loc[c]
        assert row.n_turns == len(part) and row.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert row.loss_chars == len(loss) and row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert row.formatted_chars >= len(whole)


def test_op8(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op8_quality_gam(spark, d).toPandas()
    labels = pd.read_parquet(f"{d}/labels.parquet")
    both = got.merge(labels, on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    test = both[both.held_out & both.quality.notna()]
    good, bad = test[test.quality == 1].score.to_numpy(), test[test.quality == 0].score.to_numpy()
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    assert auc > 0.97 and (test.predicted == test.quality).mean() > 0.95


def test_op9(spark):
    """The generated pages keep their text in one article; here it is cut out by its tags."""
    import html

    got = queries.op9_html_main_text(spark, DIR).toPandas().set_index("page_id")
    pages = pd.read_parquet(f"{DIR}/pages.parquet")
    assert len(got) == len(pages)
    for i, page in zip(pages.page_id, pages.html, strict=True):
        body = (page or "").partition("<article>")[2].partition("</article>")[0]
        body = re.sub(r"<[^>]*\Z", "", body)
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got.text[i].replace("\n", "") .replace(" ", "") == "".join(blocks).replace(" ", "")
        assert got.n_chars[i] == len(got.text[i])


def test_op10(spark, docs):
    got = queries.op10_token_shards(spark, DIR).toPandas().set_index("doc_id")
    at = 0
    assert len(got) == len(docs)
    for i, ids in sorted(token_ids(docs).items()):
        row = got.loc[i]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op6_many_blocks_and_groups(spark):
    """Blocks of few rows, several groups a block, tied scores and a repeated row give the brute-force ranking."""
    from pyspark.sql import functions as F
    from stockweave.llm import topk

    values = np.random.default_rng(5).integers(-3, 4, (300, 3))
    data = [(k, [float(x) / 64 for x in v]) for k, v in enumerate(values.tolist())]
    vectors = spark.createDataFrame([*data, data[7]], "vec_id long, embedding array<double>")
    got = topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=9, block_rows=40, query_rows=4).collect()
    ids, rows = np.array([*range(300), 7]), np.vstack([values, values[7]])
    want = []
    for q in range(0, 300, 20):
        scores = rows @ values[q]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:9]
        want += [(q, r, int(ids[i]), int(scores[i])) for r, i in enumerate(order, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
