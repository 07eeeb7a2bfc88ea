"""Chat formatting after cumulative-snapshot collapse.

A chat log often holds the same conversation many times, each time with a few
more turns. Every turn gets two 64-bit hashes of its place, role and text; their
running xor is the hash of the conversation up to that turn. A conversation
whose whole hash is the hash of a proper prefix of another one is a snapshot and
goes, by an anti-join; of equal conversations the one with the smallest id
stays. What stays is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tensorloom.llm.staging import stage

START, END = "<|im_start|>", "<|im_end|>\n"


def _turn_hash(seed: str) -> Column:
    return F.xxhash64(F.lit(seed), "pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def _clean(x: Column, default: str) -> Column:
    """Text that looks like a marker must not end a turn."""
    return F.replace(F.coalesce(x, F.lit(default)), F.lit("<|im_"), F.lit("< |im_"))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per retained conversation: conv_id, n_turns, n_logs, text.

    Turns are ordered by turn (null last), role, text; repeated rows are turns
    of their own. n_logs counts the logs that were this very conversation. Rows
    without conv_id are conversations of one turn each. A null role is
    `unknown`, a null text empty. A conversation must fit a row, as its
    rendering does; extra columns are not read; no rows give no rows.
    """
    base = turns.select(
        F.col("conv_id").isNull().alias("none"),
        F.coalesce(F.col("conv_id").cast("long"), F.monotonically_increasing_id()).alias("id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    whole = Window.partitionBy("none", "id")
    order = whole.orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = base.withColumn("pos", F.row_number().over(order)).withColumn("size", F.count(F.lit(1)).over(whole))
    base = base.withColumn("a", F.bit_xor(_turn_hash("a")).over(upto)).withColumn("b", F.bit_xor(_turn_hash("b")).over(upto))
    base = stage(base, "turns")
    ends = base.where("pos = size").select("none", "id", "size", "a", "b")
    proper = base.where("pos < size").select(F.col("pos").alias("size"), "a", "b").distinct()
    kinds = ends.groupBy("size", "a", "b").agg(F.min(F.struct("none", "id")).alias("who"), F.count(F.lit(1)).alias("n_logs"))
    stay = kinds.join(proper, ["size", "a", "b"], "left_anti").select("who.none", "who.id", "n_logs")
    parts = base.select("none", "id", "pos", "role", "text").join(stay, ["none", "id"])
    lines = F.sort_array(F.collect_list(F.struct("pos", "role", "text")))
    chats = parts.groupBy("none", "id", "n_logs").agg(lines.alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: F.concat(F.lit(START), _clean(x["role"], "unknown"), F.lit("\n"), _clean(x["text"], ""), F.lit(END))), "")
    return chats.select(F.when(~F.col("none"), F.col("id")).alias("conv_id"), F.size("lines").cast("long").alias("n_turns"), "n_logs", text.alias("text"))


SQL = r"""
WITH c AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS LAST, role, text) AS l,
    string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|im_', '< |im_') || chr(10)
      || replace(coalesce(text, ''), '<|im_', '< |im_') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS text
  FROM conversations GROUP BY conv_id),
k AS (SELECT min(conv_id) AS conv_id, len(l) AS n_turns, count(*) AS n_logs, min(text) AS text, l FROM c GROUP BY l)
SELECT conv_id, n_turns, n_logs, text FROM k
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.l[1] = k.l[1] AND len(c.l) > k.n_turns AND c.l[1:k.n_turns] = k.l)"""
