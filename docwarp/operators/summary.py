"""Summary plans under a budget, reductions, and the validation of generated answers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarp.functions.text import collapse, section_islands

#: Characters of a call, of what each item adds, of stored and of partial summaries; calls per revision. Fixed values.
BUDGET, OVERHEAD, MOST, MOST_PARTIAL, MOST_CALLS = 6000, 200, 1200, 700, 200
FAN_IN = BUDGET // (MOST_PARTIAL + OVERHEAD)
REFUSAL = "관련 문서에서 확인할 수 없습니다."  # fixed value


def _pack(weights: list[int], sections: list[int]) -> list[int]:
    """The group of each item. A section is cut into runs within the budget; only its first run may join the group before, and only whole."""
    out: list[int] = []
    group, total, before = -1, 0, None
    at = 0
    while at < len(weights):
        end, run = at, 0
        while end < len(weights) and sections[end] == sections[at] and (end == at or run + weights[end] <= BUDGET):
            run += weights[end]
            end += 1
        if group >= 0 and sections[at] != before and total + run <= BUDGET:
            total += run
        else:
            group, total = group + 1, run
        out += [group] * (end - at)
        before, at = sections[at], end
    return out


def _packed(weights: pa.Array, sections: pa.Array) -> pa.Array:
    pairs = zip(weights.to_pylist(), sections.to_pylist(), strict=True)
    return pa.array([_pack(w or [], s or []) for w, s in pairs], pa.list_(pa.int32()))


def pack(items: DataFrame) -> DataFrame:
    """revision_id, chunk_index, part, grp of items (revision_id, chunk_index, part, weight, section): adjacent sections merged up to the budget, larger ones cut.

    Only the items' numbers are gathered, a revision at a time.
    """
    lists = items.groupBy("revision_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "part", "weight", "section"))).alias("items"))
    numbers = lambda c: F.transform("items", lambda x: x[c].cast("int"))
    grouped = lists.withColumn("groups", F.arrow_udf(_packed, "array<int>")(numbers("weight"), numbers("section")))
    rows = grouped.select("revision_id", F.explode(F.arrays_zip("items", "groups")).alias("z"))
    return rows.select("revision_id", F.col("z.items.chunk_index").alias("chunk_index"), F.col("z.items.part").alias("part"), F.col("z.groups").cast("long").alias("grp"))


def summary_items(chunks: DataFrame) -> DataFrame:
    """Items (revision_id, chunk_index, part, weight, section, text) of the non-blank chunks (revision_id, chunk_index, section_title, text).

    A chunk over the budget is cut into parts. Without section structure every chunk is a section of its own.
    """
    usable = section_islands(chunks.where(collapse(F.col("text")) != "").select("revision_id", "chunk_index", "section_title", "text"))
    sections = usable.groupBy("revision_id").agg(F.max("island").alias("sections"))
    rows = usable.join(sections, "revision_id").withColumn("section", F.when(F.col("sections") > 1, F.col("island")).otherwise(F.col("chunk_index")))
    room = BUDGET - OVERHEAD
    parts = rows.select("revision_id", "chunk_index", "section", "text", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.char_length("text") / room).cast("int")))).alias("part"))
    piece = F.substring(F.col("text"), (F.col("part") - 1) * room + 1, F.lit(room))
    return parts.select("revision_id", "chunk_index", F.col("part").cast("long").alias("part"), (F.char_length(piece) + OVERHEAD).cast("long").alias("weight"), "section", piece.alias("text"))


def reduction_calls(n: Column) -> Column:
    """Calls that bring n summaries down to one, FAN_IN at a time."""
    start = F.struct(n.cast("long").alias("n"), F.lit(0).cast("long").alias("calls"))

    def level(a: Column, _: Column) -> Column:
        less = F.when(a["n"] > 1, F.ceil(a["n"] / FAN_IN)).otherwise(F.lit(0)).cast("long")
        return F.struct(F.when(a["n"] > 1, less).otherwise(a["n"]).alias("n"), (a["calls"] + less).alias("calls"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(24)), start, level, lambda a: a["calls"])  # 6 ** 24 summaries


def plan(revisions: DataFrame, chunks: DataFrame) -> DataFrame:
    """revision_id, n_groups, hierarchical, max_calls, oversized for every revision (id); one without text has no groups."""
    counts = pack(summary_items(chunks)).groupBy("revision_id").agg((F.max("grp") + 1).alias("n_groups"))
    rows = revisions.select(F.col("id").alias("revision_id")).join(counts, "revision_id", "left").withColumn("n_groups", F.coalesce("n_groups", F.lit(0)).cast("long"))
    calls = F.when(F.col("n_groups") <= 1, F.col("n_groups")).otherwise(F.col("n_groups") + reduction_calls(F.col("n_groups")))
    return rows.select("revision_id", "n_groups", (F.col("n_groups") > 1).alias("hierarchical"), calls.alias("max_calls"), (calls > MOST_CALLS).alias("oversized"))


def truncated(text: Column, most: int = MOST) -> Column:
    flat = collapse(text)
    return F.when(F.char_length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…")))


def reduce_level(summaries: DataFrame) -> DataFrame:
    """Partial summaries (revision_id, chunk_index, text), cut to their limit, with the group of the next pass: one group means the last call."""
    cut = summaries.select("revision_id", "chunk_index", truncated(F.col("text"), MOST_PARTIAL).alias("text"))
    items = cut.select("revision_id", "chunk_index", F.lit(1).cast("long").alias("part"), (F.char_length("text") + OVERHEAD).cast("long").alias("weight"), F.lit(0).cast("long").alias("section"))
    return cut.join(pack(items).drop("part"), ["revision_id", "chunk_index"])


def validate(generations: DataFrame) -> DataFrame:
    """Generations (raw JSON, context: array of chunk ids) with answer, refused, citations.

    ``raw`` is an object of exactly answerable (true or false), answer (a string of at most 8000 characters) and citation_chunk_ids (at
    most 100 strings). Anything else, a citation from outside the context, or an answer without text or citations is refused whole.
    """
    v = F.try_parse_json("raw")
    read = lambda path, kind: F.try_variant_get(v, f"$.{path}", kind)
    shape = [f"OBJECT<answer: STRING, answerable: BOOLEAN, citation_chunk_ids: ARRAY<{t}>>" for t in ("STRING", "VOID")]
    cited = F.array_distinct(F.coalesce(read("citation_chunk_ids", "array<string>"), F.array().cast("array<string>")))
    rows = generations.withColumns({
        "_shape": F.schema_of_variant(v).isin(*shape), "_answer": read("answer", "string"), "_able": read("answerable", "boolean"), "_cited": cited,
        "_n": F.size(read("citation_chunk_ids", "array<string>")),
    })
    known = F.size(F.array_except("_cited", "context")) == 0
    sound = F.coalesce(F.col("_shape") & (F.char_length("_answer") <= 8000) & (F.col("_n") <= 100) & known, F.lit(False))
    good = sound & F.col("_able") & (F.size("_cited") > 0) & (collapse(F.col("_answer")) != "")
    none = F.array().cast("array<string>")
    refused = sound & ~F.col("_able")
    return rows.select(
        *generations.columns, F.when(good, F.col("_answer")).otherwise(REFUSAL).alias("answer"), (~good).alias("refused"), F.when(good | refused, F.col("_cited")).otherwise(none).alias("citations")
    )
