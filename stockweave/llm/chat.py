"""Chat formatting with Spark expressions only.

A conversation's turns are collected, sorted and merged: adjacent turns of one role share a block
``<|im_start|>role\\nfirst text<|im_sep|>second text<|im_end|>\\n``. Inside roles and texts every ``<|`` is
written ``<||``, which nothing in the template is, so no text can open or close a block and the original comes
back exactly. The loss mask is a list of (start, length) spans, in code points, over assistant texts.

Defined results: null text or role is empty; turns are ordered by turn (null first), then role, then text;
repeated rows are turns of their own; a line break in a role is written ``<|nl|>``; every row of a null conv_id is a
conversation of its own; an empty table gives no rows; other columns are ignored. A conversation is one string, so
its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEP, NL = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|nl|>"


def escape(x: Column) -> Column:
    return F.replace(x, F.lit("<|"), F.lit("<||"))


def unescape(x: Column) -> Column:
    return F.replace(x, F.lit("<||"), F.lit("<|"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start, length>> (0-based, code points)."""
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit(NL)).alias("role"),
        escape(F.coalesce("text", F.lit(""))).alias("text"),
    )
    turns = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    turns = turns.unionByName(rows.where("conv_id is null").select("conv_id", F.array(turn).alias("turns")))
    # positions where a block begins, then the turns of each block
    heads = F.expr("filter(sequence(1, size(turns)), i -> i = 1 or turns[i - 1].role <> turns[i - 2].role)")
    blocks = F.expr("transform(heads, (h, k) -> named_struct('role', turns[h - 1].role, 'texts', transform(slice(turns, h, coalesce(get(heads, k + 1), size(turns) + 1) - h), t -> t.text)))")
    # pieces alternate template and text; a piece that counts for the loss is marked
    pieces = F.expr(f"""flatten(transform(blocks, b -> concat(
        array(named_struct('s', concat('{START}', b.role, '\\n'), 'loss', false)),
        flatten(transform(b.texts, (t, i) -> array(named_struct('s', if(i = 0, '', '{SEP}'), 'loss', false), named_struct('s', t, 'loss', b.role = 'assistant')))),
        array(named_struct('s', '{END}\\n', 'loss', false)))))""")
    # spans in runs of about the square root of their number: appending to a short list, and one sum a run
    runs = F.expr("""transform(sequence(0, (size(pieces) - 1) div run), k -> slice(pieces, k * run + 1, run))""")
    sizes = F.expr("transform(runs, r -> aggregate(r, 0L, (n, p) -> n + char_length(p.s)))")
    starts = F.expr("aggregate(sizes, array(0L), (a, n) -> array_append(a, element_at(a, -1) + n))")
    spans = F.expr("""flatten(transform(runs, (r, k) -> aggregate(r, named_struct('at', starts[k], 'spans', cast(array() as array<struct<start: bigint, length: bigint>>)),
        (a, p) -> named_struct('at', a.at + char_length(p.s), 'spans', if(p.loss, array_append(a.spans, named_struct('start', a.at, 'length', cast(char_length(p.s) as bigint))), a.spans)), a -> a.spans)))""")
    return (
        turns.withColumn("heads", heads)
        .withColumn("blocks", blocks)
        .select("conv_id", pieces.alias("pieces"))
        .withColumn("run", F.expr("cast(ceil(sqrt(size(pieces))) as int)"))
        .withColumn("runs", runs)
        .withColumn("sizes", sizes)
        .withColumn("starts", starts)
        .select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the original turns, parsed from the formatted text alone."""
    blocks = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    def turns(block):
        at = F.instr(block, "\n")
        body = F.substring_index(F.substring(block, at + 1, F.char_length(block)), END, 1)
        role = unescape(F.replace(F.substring(block, F.lit(1), at - 1), F.lit(NL), F.lit("\n")))
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, in order, nothing between.

    Spans are read in runs: a run's part of the text is cut out once, its spans from that part.
    """
    run = F.ceil(F.sqrt(F.size(spans))).cast("int")
    first, last = (lambda r: F.get(r, F.lit(0))["start"]), (lambda r: F.element_at(r, -1)["start"] + F.element_at(r, -1)["length"])
    cut = lambda text, start, length: F.substring(text, (start + 1).cast("int"), length.cast("int"))

    def read(k):
        own = F.slice(spans, k * run + 1, run)
        part = F.array(F.struct(own.alias("own"), cut(formatted, first(own), last(own) - first(own)).alias("text")))
        return F.get(F.transform(part, lambda p: F.array_join(F.transform(p["own"], lambda s: unescape(cut(p["text"], s["start"] - first(p["own"]), s["length"]))), "")), F.lit(0))

    return F.when(F.size(spans) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / run).cast("int")), read), ""))
