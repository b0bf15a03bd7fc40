"""URL filter on a path-template tree, with DataFrame operations only.

Rules judge a url first: a rule ``host/path`` fits its host and all subdomains where the url's path starts with
its path; the longest wins. Urls that a rule judges are the labels of the tree:

1. Path segments that look variable (numbers, hexadecimal runs, words with digits) become wildcards; urls are
   counted by (host, segments). Empty segments do not count.
2. Level by level the segments below a node that are rare there become ``*``; so at most
   1 / LEAST_SHARE stay. Those with labels are put in order of their share of blocked urls, and neighbours whose shares
   do not differ (a two-sided z test of two proportions) merge into one branch ``a|b``. Branches without labels stay apart.
   A node that fewer than LEAST_COUNT urls go through has nothing but ``*`` below it, so its few paths are followed to their
   ends at once, however deep: levels cost jobs only while so many urls share a node.
3. A node's purity is its share of blocked urls, smoothed towards its parent's. The root's parent is the host, the host's the
   whole; a branch of one segment starts half-way between its host and that segment over all hosts. A url without a
   rule is blocked where the purity of its deepest node reaches ``REJECT``.

A node that very many rows share is dealt to several places (``spread_join``).

Defined results: a null url, or one without ``://``, has an empty host and path; an empty table gives no rows;
repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.llm.graph import hot_keys, spread_join
from stockweave.session import materialize

#: (verdict, host/path)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
LEAST_SHARE, LEAST_COUNT, Z, SMOOTH, REJECT = 0.02, 5, 1.96, 4.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"^(?s).*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = None
    for verb, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, verb) if verdict is None else verdict.when(fits, verb)
    return rule, verdict


#: Forms of variable segments, the first that fits: (pattern, wildcard).
FORMS = ((r"^[0-9]+$", "{number}"), (r"^[0-9a-fA-F-]*[0-9][0-9a-fA-F-]*$", "{hex}"), (r"[0-9]", "{mixed}"))


def _form(segment: Column) -> Column:
    out = F.translate(segment, "|*", "!+")  # these two are the template's own marks
    for pattern, name in reversed(FORMS):
        fits = segment.rlike(pattern)
        out = F.when(fits & (F.char_length(segment) >= 8) if name == "{hex}" else fits, name).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """array<string>: the path's segments, generalised by form."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), _form)


def _smooth(bad: Column, known: Column, above: Column) -> Column:
    return (bad + SMOOTH * above) / (known + SMOOTH)


def _labels(child: DataFrame) -> DataFrame:
    """(host, t, s, label, pn): what the segments below each node (host, t) become, and the urls that go through the node.
    child is a written table."""
    node = ["host", "t"]
    above = materialize(child.groupBy(*node).agg(F.sum("n").alias("pn"), F.count("*").alias("n_")), "url-parents")
    rows = spread_join(child.select(*node, "s", "n", "known", "bad"), above.select(*node, "pn"), node, hot_keys(above, node))
    kept = (F.col("n") >= LEAST_COUNT) & (F.col("n") >= LEAST_SHARE * F.col("pn"))
    # at most 1 / LEAST_SHARE rows a node from here on
    order = Window.partitionBy(*node).orderBy(F.col("bad") / F.col("known"), "s")
    known, bad = F.lag("known").over(order), F.lag("bad").over(order)
    shown = rows.where(kept & (F.col("known") > 0)).withColumns({"k0": known, "b0": bad})
    pooled = (F.col("b0") + F.col("bad") + 1) / (F.col("k0") + F.col("known") + 2)
    gap = F.col("bad") / F.col("known") - F.col("b0") / F.col("k0")
    differ = gap * gap > Z * Z * (pooled * (1 - pooled) * (1 / F.col("k0") + 1 / F.col("known")))
    banded = shown.withColumn("band", F.sum(F.when(differ, 1).otherwise(0)).over(order))
    joint = banded.groupBy(*node, "band").agg(F.sort_array(F.collect_list("s")).alias("members"), F.max("pn").alias("pn"))
    merged = joint.select(*node, F.explode("members").alias("s"), F.array_join("members", "|").alias("label"), "pn")
    alone = rows.where(kept & (F.col("known") == 0)).select(*node, "s", F.col("s").alias("label"), "pn")
    rare = rows.where(~kept).select(*node, "s", F.lit("*").alias("label"), "pn")
    return merged.unionByName(alone).unionByName(rare)


def _to_the_end(rows: DataFrame, level: int) -> DataFrame:
    """rows whose node (host, t) at that level fewer than LEAST_COUNT urls go through, with t and p of their last node: below,
    every label is ``*``, so a node's urls are those of the group that are as long, less than LEAST_COUNT at every step."""
    group = Window.partitionBy("host", "t")
    depth = F.size("segments")
    met = rows.withColumns({"depth_": depth, "group_": F.collect_list(F.struct(depth.alias("d"), "known", "bad")).over(group)})
    count = lambda c, k: F.aggregate(F.filter("group_", lambda g: g["d"] >= k), F.lit(0).cast("long"), lambda a, g: a + g[c])
    p = F.aggregate(F.sequence(F.lit(level), F.col("depth_")), F.col("p"), lambda above, k: _smooth(count("bad", k), count("known", k), above))
    return met.withColumns({"p": p, "t": F.concat("t", F.repeat(F.lit("/*"), F.col("depth_") - (level - 1)))}).drop("depth_", "group_")


def template_tree(labelled: DataFrame) -> DataFrame:
    """(host, segments, blocked) -> (host, segments, template, purity): every template's smoothed share of blocked urls.

    blocked: 1, 0 or null (no label).
    """
    tree = labelled.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("blocked").alias("known"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("bad"))
    tree = materialize(tree.withColumn("s", F.get("segments", F.lit(0))), "templates")
    counts = [F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad"), F.count("*").alias("n_")]
    whole = tree.agg(((F.sum("bad") + 1) / (F.sum("known") + 2)).alias("p")).first()
    start = F.lit(1.0 if whole["p"] is None else whole["p"])
    hosts = materialize(tree.groupBy("host").agg(*counts), "url-hosts")
    firsts = materialize(tree.where("s is not null").groupBy("s").agg(*counts), "url-firsts")
    tree = spread_join(tree, hosts.select("host", _smooth(F.col("bad"), F.col("known"), start).alias("p")), "host", hot_keys(hosts, "host"))
    tree = tree.withColumn("t", F.lit(""))
    done = tree.where("s is null").select("host", "segments", "t", "p")
    first = spread_join(tree.where("s is not null"), firsts.select("s", _smooth(F.col("bad"), F.col("known"), start).alias("p1")), "s", hot_keys(firsts, "s"))
    tree = materialize(first, "url-level")
    node = ["host", "t"]
    level = 1
    while not tree.isEmpty():
        child = materialize(tree.groupBy(*node, "s").agg(*counts), "url-children")
        named = materialize(spread_join(tree, _labels(child), [*node, "s"], hot_keys(child, [*node, "s"])), "url-level")
        done = done.unionByName(_to_the_end(named.where(F.col("pn") < LEAST_COUNT), level).select(*done.columns))
        named = named.where(F.col("pn") >= LEAST_COUNT)
        above = F.when(F.col("label") == F.col("s"), (F.col("p") + F.col("p1")) / 2).otherwise(F.col("p")) if level == 1 else F.col("p")
        named = named.select("host", "segments", "n", "known", "bad", "s", F.concat("t", F.lit("/"), "label").alias("t"), above.alias("p"))
        nodes = materialize(named.groupBy(*node).agg(*counts, F.max("p").alias("above")), "url-nodes")
        tree = spread_join(named.drop("p"), nodes.select(*node, _smooth(F.col("bad"), F.col("known"), F.col("above")).alias("p")), node, hot_keys(nodes, node))
        tree = materialize(tree.withColumn("s", F.get("segments", F.lit(level))), "url-level")
        done = done.unionByName(tree.where("s is null").select(*done.columns))
        tree = tree.where("s is not null")
        level += 1
    return done.select("host", "segments", F.when(F.col("t") == "", "/").otherwise(F.col("t")).alias("template"), F.col("p").alias("purity"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of pages(page_id, url)."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = materialize(parts.withColumns({"rule": rule, "ruled": verdict, "segments": segments(F.col("path"))}), "urls")
    found = template_tree(ruled.withColumn("blocked", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)))
    key = ["host", "segments"]
    counts = materialize(ruled.groupBy(*key).agg(F.count("*").alias("n_")), "url-counts")
    out = spread_join(ruled, found, key, hot_keys(counts, key))
    learned = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "template", "purity")
