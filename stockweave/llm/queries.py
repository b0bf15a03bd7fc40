"""One query per operator, over the whole of its table, and the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.llm import chat, chunks, html_text, minhash, mixing, packing, quality, ranked, runs, shards, topk, urls, vectors
from stockweave.llm.tokens import default_tokenizer

END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_source_mix(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_url_filter(spark, sf_dir):
    return urls.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_pack(spark, sf_dir):
    pieces = packing.pack(_table(spark, sf_dir, "documents"), default_tokenizer(), END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op5_fingerprints(spark, sf_dir):
    return chunks.edited_with_next(_table(spark, sf_dir, "documents"))


def op6_topk(spark, sf_dir):
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


_PROBE = "<|im_end|><|im_start|>assistant ok"


def op7_chat_format(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(_PROBE).alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    made = chat.format_conversations(rows.unionByName(extra)).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_quality_gam(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op9_html_main_text(spark, sf_dir):
    return html_text.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_token_shards(spark, sf_dir):
    read = shards.read_shards(shards.write_shards(_table(spark, sf_dir, "documents"), default_tokenizer(), END_ID))
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_runs(spark, sf_dir):
    """Documents whose crc32 ends in 0 get a periodic tail first, as the contract says."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    n, g = F.size(words), F.floor(h / 10)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    edited = F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(F.col("text"))
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    found = runs.find_runs(docs, edited).withColumn("best", F.when(F.size("runs") > 0, longest))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    length, period = -F.col("best.l"), F.col("best.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_vector_dedup(spark, sf_dir):
    return vectors.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark, sf_dir):
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries():
    return {f.__name__: f for f in (op1_minhash_dedup, op2_source_mix, op3_url_filter, op4_pack, op5_fingerprints, op6_topk, op7_chat_format, op8_quality_gam, op9_html_main_text, op10_token_shards, op11_runs, op12_vector_dedup, op13_ranked_search)}


_WORD = r"[^\x20\x09-\x0D]+"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _url_sql(levels: int = 6) -> str:
    """The template tree level by level, for paths of at most that many segments."""
    u = urls
    smooth = lambda above: f"(bad + {u.SMOOTH!r}::DOUBLE * {above}) / (known + {u.SMOOTH!r}::DOUBLE)"
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"
    rules = [(text, verb, fits(*text.split("/", 1))) for verb, text in sorted(u.RULES, key=lambda r: -len(r[1]))]
    case = lambda k: "CASE " + " ".join(f"WHEN {r[2]} THEN '{r[k]}'" for r in rules) + " END"
    form = "CASE " + " ".join(f"WHEN regexp_matches(s, '{pat}'){' AND length(s) >= 8' if name == '{hex}' else ''} THEN '{name}'" for pat, name in u.FORMS) + " ELSE translate(s, '|*', '!+') END"
    sums = "count(*) AS n, count(blocked) AS known, CAST(coalesce(sum(blocked), 0) AS BIGINT) AS bad"
    parts = [
        rf"""u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{u.UPPER}', '{u.LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages)""",
        f"r AS (SELECT *, {case(0)} AS rule, {case(1)} AS ruled, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {form}) AS seg FROM u)",
        "b AS (SELECT *, CASE ruled WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS blocked FROM r)",
        "w AS (SELECT CAST(coalesce(sum(blocked), 0) + 1 AS DOUBLE) / (count(blocked) + 2) AS p FROM b)",
        f"h AS (SELECT host, {smooth('(SELECT p FROM w)')} AS p FROM (SELECT host, {sums} FROM b GROUP BY host))",
        f"f AS (SELECT s, {smooth('(SELECT p FROM w)')} AS p1 FROM (SELECT seg[1] AS s, {sums} FROM b WHERE len(seg) > 0 GROUP BY 1))",
        "t0 AS (SELECT b.*, '' AS t, h.p FROM b JOIN h USING (host))",
    ]
    for k in range(1, levels + 1):
        above = "CASE WHEN label = seg[1] THEN (p + p1) / 2 ELSE p END" if k == 1 else "p"
        parts += [
            f"c{k} AS (SELECT *, n >= {u.LEAST_COUNT} AND n >= {u.LEAST_SHARE!r}::DOUBLE * sum(n) OVER (PARTITION BY host, t) AS kept FROM (SELECT host, t, seg[{k}] AS s, {sums} FROM t{k - 1} WHERE len(seg) >= {k} GROUP BY ALL))",
            f"d{k} AS (SELECT *, lag(known) OVER o AS k0, lag(bad) OVER o AS b0 FROM c{k} WHERE kept AND known > 0 WINDOW o AS (PARTITION BY host, t ORDER BY bad / known, s))",
            f"e{k} AS (SELECT *, coalesce((bad / known - b0 / k0) * (bad / known - b0 / k0) > {u.Z!r}::DOUBLE * {u.Z!r}::DOUBLE * (((b0 + bad + 1) / (k0 + known + 2)) * (1 - (b0 + bad + 1) / (k0 + known + 2)) * (1 / k0 + 1 / known)), false) AS differ FROM d{k})",
            f"g{k} AS (SELECT *, sum(CAST(differ AS INTEGER)) OVER (PARTITION BY host, t ORDER BY bad / known, s ROWS UNBOUNDED PRECEDING) AS band FROM e{k})",
            f"""l{k} AS (SELECT host, t, s, string_agg(s, '|') OVER (PARTITION BY host, t, band ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS label FROM g{k}
                UNION ALL SELECT host, t, s, CASE WHEN kept THEN s ELSE '*' END FROM c{k} WHERE NOT kept OR known = 0)""",
            f"m{k} AS (SELECT x.* EXCLUDE (t, p), x.t || '/' || label AS t, {above} AS p FROM t{k - 1} x JOIN l{k} ON x.host = l{k}.host AND x.t = l{k}.t AND x.seg[{k}] = l{k}.s{' JOIN f ON x.seg[1] = f.s' if k == 1 else ''})",
            f"n{k} AS (SELECT host, t, {smooth('above')} AS q FROM (SELECT host, t, max(p) AS above, {sums} FROM m{k} GROUP BY ALL))",
            f"t{k} AS (SELECT m.* EXCLUDE (p), q AS p FROM m{k} m JOIN n{k} USING (host, t))",
        ]
    ended = " UNION ALL ".join(f"SELECT page_id, host, path, rule, ruled, p FROM t{k} WHERE len(seg) {'=' if k < levels else '>='} {k}" for k in range(levels + 1))
    # a part that several others read is worked out once
    shared = [p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts]
    return f"WITH {', '.join(shared)} SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN p >= {u.REJECT!r}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict FROM ({ended})"


_ORACLES = {
    "op1_minhash_dedup": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '{_WORD}') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, greatest(1, len(w) - 4) + 1)]) END AS s FROM w),
        x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        links AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
        reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.v FROM reach JOIN links ON links.u = reach.r)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, c = doc_id AS kept FROM s JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY 1) USING (doc_id)""",
    "op2_source_mix": rf"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
        r AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
        f AS (SELECT *, cap * sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= weight * (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS stopped FROM r),
        t AS (SELECT source, source_size, CASE WHEN stopped THEN CAST(cap AS DOUBLE) ELSE CAST(weight AS DOUBLE) * CAST(total - coalesce(sum(cap) FILTER (stopped) OVER (), 0) AS DOUBLE) / CAST(sum(weight) FILTER (NOT stopped) OVER () AS DOUBLE) END AS target FROM f),
        p AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken FROM p""",
    "op3_url_filter": _url_sql(),
    "op6_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
        r AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM r WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 20""",
    "op7_chat_format": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{_PROBE}'), (-1, 1, 'assistant', '{_PROBE}')),
        o AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w IS DISTINCT FROM role AS head FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        a AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss,
        sum(length(replace(text, '<|', '<||')) + CASE WHEN head THEN length('{chat.START}{chat.END}') + 2 + length(replace(replace(role, '<|', '<||'), chr(10), '{chat.NL}')) ELSE length('{chat.SEP}') END) AS f FROM o GROUP BY conv_id)
        SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars FROM a""",
    "op11_runs": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
        h AS (SELECT *, len(w) AS n, CASE WHEN doc_id IS NOT NULL THEN xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(CAST(doc_id AS VARCHAR), '')])),
            lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) END AS h FROM d),
        a AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a, CASE WHEN n > 0 THEN 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) END AS p FROM h),
        e AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] for i in range(n)] ELSE w END AS w FROM a),
        g AS (SELECT r, n, unnest(range(n - 5)) AS i, unnest([array_to_string(w[i + 1 : i + 6], ' ') for i in range(n - 5)]) AS g FROM e),
        m AS (SELECT a.r, b.i - a.i AS q, a.i - row_number() OVER (PARTITION BY a.r, b.i - a.i ORDER BY a.i) AS island, a.i FROM g a JOIN g b ON a.r = b.r AND a.g = b.g AND a.i < b.i AND 2 * (b.i - a.i) <= a.n),
        s AS (SELECT r, q, min(i) AS start, count(*) + 5 + q AS length FROM m GROUP BY r, q, island HAVING count(*) + 5 + q >= greatest(12, 2 * q)),
        u AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM s GROUP BY r, start, length),
        x AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u),
        k AS (SELECT e.r, string_agg(e.word, ' ' ORDER BY e.i) AS kept FROM (SELECT r, unnest(w) AS word, unnest(range(n)) AS i FROM e WHERE r IN (SELECT r FROM u)) e ANTI JOIN x ON e.r = x.r AND e.i = x.i GROUP BY e.r),
        b AS (SELECT r, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, (-length, start, period)) AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM u GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.b.s AS start, b.b.l AS length, b.b.p AS period, 1000 * b.b.l // b.b.p AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, array_to_string(w, ' '))) AS collapsed_sha256
        FROM e LEFT JOIN b ON e.r = b.r LEFT JOIN k ON e.r = k.r""",
    "op12_vector_dedup": """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        u AS (SELECT r, vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
        links AS (SELECT a.r AS u, b.r AS v FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) >= 0.95),
        reach AS (SELECT r, r AS s FROM v UNION SELECT reach.r, links.v FROM reach JOIN links ON links.u = reach.s),
        c AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.s GROUP BY 1),
        n AS (SELECT u AS r, count(*) AS n FROM links GROUP BY 1)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)""",
    "op13_ranked_search": rf"""WITH t AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '{_TERM}')) AS t FROM (SELECT row_number() OVER () AS r, * FROM documents)),
        n AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY r),
        s AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS l FROM n),
        f AS (SELECT r, t, count(*) AS tf FROM t GROUP BY ALL),
        w AS (SELECT t, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY t, big_n),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '{_TERM}')) AS t FROM benchmark WHERE item_id IS NOT NULL),
        x AS (SELECT item_id, n.r, n.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // l)))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN f USING (t) JOIN n USING (r), s GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0 AND doc_id IS NOT NULL WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 50""",
}


def oracle_sql() -> dict[str, str]:
    """Where SQL states the result; the other queries are tested against brute-force versions."""
    return dict(_ORACLES)
