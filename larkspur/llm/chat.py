"""Chat formatting: logged snapshots of a growing conversation collapse to the longest one, which is then rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm._shared import stored

START, END = "<|im_start|>", "<|im_end|>"


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn in the template; a `<|` within role or text is opened up, so that no text can forge a turn."""
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(START), safe(role), F.lit("\n"), safe(text), F.lit(END + "\n"))


def prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, idx, role, text, n (turns of the conversation) and the rolling hash (h1, h2) of its first idx turns.

    The hash of a prefix is the XOR of 128-bit hashes of its turns, each with its place, so it rolls on in a window.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("idx", F.row_number().over(order).cast("long"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    own = [F.col("idx"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    return rows.select(
        "conv_id", "idx", "role", "text", F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n"),
        F.bit_xor(F.xxhash64(F.lit(1), *own)).over(so_far).alias("h1"), F.bit_xor(F.xxhash64(F.lit(2), *own)).over(so_far).alias("h2"),
    )


def collapsed(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, n_logged, rendered: each maximal conversation once.

    Exactly repeated rows count once; turns go by number (null first), then role, then text. A conversation whose
    turns are the first turns of a longer one goes; of equal ones the smallest conv_id stays and n_logged counts them.
    Null role and text count as empty; a null conv_id is a conversation of its own (last choice among equal ones). An
    empty table gives none.
    """
    rows = stored(prefixes(turns, conv, turn, role, text), "chat-prefixes")
    whole = rows.filter("idx = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_logged"))
    inner = rows.filter("idx < n").select(F.col("idx").alias("n"), "h1", "h2").distinct()
    kept = whole.join(inner, ["n", "h1", "h2"], "left_anti").select(F.col("conv_id").alias("kept"), "n_logged")
    lines = rows.join(kept, rows["conv_id"].eqNullSafe(kept["kept"])).select("conv_id", "n", "n_logged", F.struct("idx", rendered_turn(F.col("role"), F.col("text")).alias("line")).alias("t"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["line"]), "")
    return lines.groupBy("conv_id", "n", "n_logged").agg(said.alias("rendered")).select("conv_id", F.col("n").alias("n_turns"), "n_logged", "rendered")


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS idx, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
p AS (SELECT conv_id, idx, n, string_agg(coalesce(role, '') || chr(30) || coalesce(text, '') || chr(31), '') OVER (PARTITION BY conv_id ORDER BY idx) AS said,
  string_agg('<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY idx) AS rendered FROM r),
w AS (SELECT said, n, min(conv_id) AS conv_id, count(*) AS n_logged, min(rendered) AS rendered FROM p WHERE idx = n GROUP BY said, n)
SELECT conv_id, n AS n_turns, n_logged, rendered FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.idx < p.n AND p.idx = w.n AND p.said = w.said)
"""
