"""Chat formatting: cumulative-snapshot collapse, then rendering. DataFrame functions only.

Loggers that write a conversation anew at each turn leave snapshots that prefix each other. Turns are numbered within
their conversation (by turn, role, text). Each turn has two 64-bit hashes of its place, role and text; their running
exclusive-or over the conversation is the rolling hash of the prefix that ends there. A conversation goes if its whole
hash, at its length, is a prefix hash of a longer one; of equal conversations the one with the smallest id stays. The kept
ones are rendered, a block for each turn::

    <|im_start|>ROLE
    TEXT<|im_end|>

Prefix hashes are made distinct before they are joined, so a very common first turn is one row. No pairs of conversations
are made.

Defined results: a null role is rendered as ``user`` and a null text as empty (for comparison they are not the same as
those). A null conv_id is a conversation of its own. Null turns come first. Repeated rows are turns of their own. Marks
within texts are broken by a space, so that a text can't open or close a block. Other columns play no part, whatever their
names. Turns of equal number are ordered by role and text (ties). An empty table gives no rows. A very long conversation
is one group of a window, which Spark sorts and spills; its rendering is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import load


def _turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(order))
    kind = F.isnull("role").cast("int") * 2 + F.isnull("text").cast("int")
    for name, salt in (("h1", 17), ("h2", 40503)):
        rows = rows.withColumn(name, F.xxhash64(F.lit(salt), "pos", kind, "role", F.lit(salt), "text"))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name in ("h1", "h2"):
        rows = rows.withColumn(name, F.expr(f"bit_xor({name})").over(so_far))
    return rows.withColumn("n", F.lead("pos").over(order))


def maximal(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` of the conversations that no longer one contains as its beginning, equal ones once."""
    turns = _turns(conversations)
    whole = turns.where(F.col("n").isNull()).groupBy("pos", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNull().alias("no"), "conv_id")).alias("first"))
    begun = turns.where(F.col("n").isNotNull()).select("pos", "h1", "h2").distinct()
    kept = whole.join(begun, ["pos", "h1", "h2"], "left_anti")
    return kept.select(F.col("first.conv_id").alias("conv_id"), F.col("pos").cast("long").alias("n_turns"))


def chat_format(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, rendered`` of the maximal conversations."""
    turns = _turns(conversations)
    kept = maximal(conversations)
    rows = turns.join(kept.withColumnRenamed("conv_id", "kept_id"), F.col("conv_id").eqNullSafe(F.col("kept_id")))
    safe = F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|(im_start|im_end)\|>", "< |$1| >")
    block = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("user")), F.lit("\n"), safe, F.lit("<|im_end|>\n"))
    blocks = rows.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(F.struct("pos", block.alias("block")))).alias("blocks"))
    return blocks.select("conv_id", "n_turns", F.array_join(F.transform("blocks", lambda b: b["block"]), "").alias("rendered"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(load(spark, sf_dir, "conversations"))


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
    count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
p AS (
  SELECT conv_id, pos, n, list(struct_pack(r := role, x := text)) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS pre FROM t),
kept AS (
  SELECT pre, min(conv_id) AS conv_id, any_value(n) AS n FROM p WHERE pos = n AND pre NOT IN (SELECT DISTINCT pre FROM p WHERE pos < n) GROUP BY pre)
SELECT t.conv_id, CAST(t.n AS BIGINT) AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '< |\1| >', 'g') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY t.conv_id, t.n
"""
