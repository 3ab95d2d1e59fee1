"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; neighbouring turns of one role share a block. Template:

    <s>[INST] role [/INST] text { [SEP] text } </s>

The control strings ``<s> </s> [INST] [/INST] [SEP]`` inside roles and texts get one more backslash in front (a control string
after any run of backslashes), which reading takes away again; the template itself has a space around its inner marks, so a
mark is one exactly when no backslash stands before it. The loss mask covers the assistant texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_CONTROL = r"(?:</?s>|\[/?INST\]|\[SEP\])"
OPEN, HEAD, TAIL, SEP, CLOSE = "<s>", "[INST] ", " [/INST] ", " [SEP] ", " </s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*{_CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*{_CONTROL})", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss`` (array of start, length: assistant texts, in code points from 0).

    ``turns`` needs conv_id, turn, role, text; extra columns are ignored. Order within a conversation: turn (null first), then
    role, then text, so ties and repeated rows have one order. Null role or text: empty. A null conv_id is a conversation of
    its own. An empty table gives no rows.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # a run of one role is a slice from its first turn to the next run's
    first = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i - 1)["role"] != F.get("turns", i)["role"]))
    firsts = lists.withColumn("firsts", first)
    length = lambda k, i: F.coalesce(F.get("firsts", k + 1), F.size("turns")) - i
    runs = firsts.select("conv_id", F.transform("firsts", lambda i, k: F.slice("turns", i + 1, length(k, i))).alias("runs"))
    head = lambda t, k: F.concat(F.when(k > 0, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(OPEN + HEAD), escape(t["role"]), F.lit(TAIL))

    def piece(t: Column, i: Column, k: Column) -> Column:
        lead = F.when(i > 0, F.lit(SEP)).otherwise(head(t, k))
        return F.struct(lead.alias("lead"), escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss"))

    merged = F.flatten(F.transform("runs", lambda run, k: F.transform(run, lambda t, i: piece(t, i, k))))
    pieces = runs.select("conv_id", F.posexplode(merged).alias("no", "p"))
    # where each text starts: lengths run over the pieces of a conversation, which stay where they were collected
    before = Window.partitionBy("conv_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    size, before_text = F.char_length("p.lead") + F.char_length("p.text"), F.char_length("p.lead")
    placed = pieces.withColumn("start", (F.coalesce(F.sum(size).over(before), F.lit(0)) + before_text).cast("long"))
    kept = F.struct("no", F.concat("p.lead", "p.text").alias("text"), "p.loss", "start", F.char_length("p.text").cast("long").alias("length"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(kept)).alias("pieces"))
    text = F.concat(F.array_join(F.transform("pieces", lambda p: p["text"]), ""), F.lit(CLOSE))
    loss = F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return whole.select("conv_id", text.alias("formatted"), loss.alias("loss"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Back from the output: ``conv_id, formatted, loss, turns`` (array of role, text as they were), ``loss_text`` (unescaped)."""
    parts = F.split("formatted", r"(?<!\\)<s>", -1)
    blocks = F.slice(parts, F.lit(2), F.size(parts) - 1)

    def turns_of(block: Column) -> Column:
        head = F.instr(block, TAIL)  # the first one: a role's own is escaped
        role = F.substring(block, F.lit(len(HEAD) + 1), head - 1 - len(HEAD))
        body = F.substring(block, head + len(TAIL), F.char_length(block) - head - len(TAIL) + 1 - len(CLOSE))
        return F.transform(F.split(body, r" \[SEP\] ", -1), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", "loss", F.flatten(F.transform(blocks, turns_of)).alias("turns"), F.array_join(loss, "").alias("loss_text"))
