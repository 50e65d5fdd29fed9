"""Preference formatting: a shared prompt and two masked completions for each chosen and rejected conversation.

Turns are ordered by turn, then role and text; a null role or text counts as empty, repeated rows are turns of their own,
and rows without a conv_id are left out.  The prompt is the longest common prefix of turns (equal role and text),
rendered once; each completion is the rest of its conversation and may be empty.  The mask of a completion lists the
spans (code points, end exclusive) that are learned: the text and end mark of its assistant turns.  Pairs with a
conversation that does not exist are left out; repeated pairs give equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END = "<|end|>"


def _opening(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array of (role, text, at) in order; ``at`` is the length of the turns before, as rendered."""
    each = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.length(F.concat(F.lit("<|"), "role", F.lit("|>\n"))) + F.length("text") + len(END) + 1
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)))
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "at"))).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), x["at"].alias("at"))).alias("turns"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_opening(x), x["text"], F.lit(END + "\n"))), "")


def learned_spans(turns: Column, role: str = "assistant") -> Column:
    """``start:end`` of the learned parts of the rendered turns, comma-joined."""

    def span(x: Column) -> Column:
        start = x["at"] - F.get(turns, F.lit(0))["at"] + F.length(_opening(x))
        return F.concat_ws(":", start.cast("string"), (start + F.length(x["text"]) + len(END)).cast("string"))

    return F.array_join(F.transform(F.filter(turns, lambda x: x["role"] == role), span), ",")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of equal leading turns."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))

    def step(acc: Column, x: Column) -> Column:
        on = acc["on"] & x["a"]["role"].eqNullSafe(x["b"]["role"]) & x["a"]["text"].eqNullSafe(x["b"]["text"])
        return F.struct((acc["n"] + on.cast("int")).alias("n"), on.alias("on"))

    return F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), zero, step, lambda acc: acc["n"])


def format_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask for each row of ``pairs`` (chosen_id, rejected_id)."""
    each = conversations(turns)
    joined = pairs.select("chosen_id", "rejected_id").join(each.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a")), "chosen_id")
    joined = joined.join(each.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b")), "rejected_id")
    n = joined.withColumn("n", common_prefix(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    n = n.withColumn("c", rest(F.col("a"))).withColumn("r", rest(F.col("b")))
    return n.select(
        "chosen_id",
        "rejected_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        render(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        render(F.col("c")).alias("chosen"),
        render(F.col("r")).alias("rejected"),
        learned_spans(F.col("c")).alias("chosen_mask"),
        learned_spans(F.col("r")).alias("rejected_mask"),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """chosen_id, rejected_id: each even conv_id with the next one, where both exist."""
    ids = turns.where("conv_id is not null").select("conv_id").distinct()
    even = ids.where(F.pmod("conv_id", F.lit(2)) == 0).select(F.col("conv_id").alias("chosen_id"), (F.col("conv_id") + 1).alias("rejected_id"))
    return even.join(ids.select(F.col("conv_id").alias("rejected_id")), "rejected_id", "left_semi").select("chosen_id", "rejected_id")


def op7_preference_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return format_pairs(turns, neighbour_pairs(turns))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT DISTINCT a.conv_id AS chosen_id, b.conv_id AS rejected_id
  FROM t a JOIN t b ON b.conv_id = a.conv_id + 1 AND a.conv_id % 2 = 0 AND a.pos = 1 AND b.pos = 1),
k AS (
  SELECT chosen_id, rejected_id,
         coalesce(min(c.pos) FILTER (WHERE r.pos IS NULL OR r.role <> c.role OR r.text <> c.text), max(c.pos) + 1) - 1 AS n
  FROM p JOIN t c ON c.conv_id = chosen_id LEFT JOIN t r ON r.conv_id = rejected_id AND r.pos = c.pos
  GROUP BY chosen_id, rejected_id),
s AS (
  SELECT k.*, side, pos, role, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' AS body
  FROM k JOIN (SELECT 1 AS side UNION ALL SELECT 2) x ON true
  JOIN t ON t.conv_id = CASE side WHEN 1 THEN chosen_id ELSE rejected_id END),
u AS (
  SELECT *, coalesce(sum(CASE WHEN pos > n THEN length(head) + length(body) + 1 ELSE 0 END)
    OVER (PARTITION BY chosen_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s),
v AS (SELECT *, CAST(before + length(head) AS BIGINT) AS a, CAST(before + length(head) + length(body) AS BIGINT) AS z FROM u)
SELECT chosen_id, rejected_id, n AS n_prompt_turns,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY pos) FILTER (WHERE side = 1 AND pos <= n), '') AS prompt,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY pos) FILTER (WHERE side = 1 AND pos > n), '') AS chosen,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY pos) FILTER (WHERE side = 2 AND pos > n), '') AS rejected,
  coalesce(string_agg(a || ':' || z, ',' ORDER BY pos) FILTER (WHERE side = 1 AND pos > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(a || ':' || z, ',' ORDER BY pos) FILTER (WHERE side = 2 AND pos > n AND role = 'assistant'), '') AS rejected_mask
FROM v GROUP BY chosen_id, rejected_id, n
"""
