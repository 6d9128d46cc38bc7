"""Chat logs: collapse cumulative snapshots, then render.

A conversation that is logged after every turn leaves snapshots that are prefixes of longer ones. The
prefix hash after k turns is a sum of hashes of (place, role, text), so a whole conversation's hash
needs no order, and prefix hashes are running sums; four 32-bit lanes make collisions negligible. A
conversation stays unless its hash is a longer one's prefix hash, or a smaller conv_id has the same turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

TURNS_PER_CHUNK = 1024


def collapse(turns: DataFrame) -> DataFrame:
    """Conversations of ``turns`` (conv_id, turn, role, text) that stay: conv_id, n_turns.

    Turns are placed by ``turn`` (null first), ties by role and text; null role and text differ from empty
    ones. Turns with null conv_id belong to no conversation. A long conversation is summed in chunks.
    """
    own = turns.where("conv_id is not null")
    chunk = F.floor(F.coalesce(F.col("turn"), F.lit(0)) / TURNS_PER_CHUNK).cast("long")
    chunked = own.withColumn("chunk", F.when(F.col("turn").isNull(), F.lit(-(1 << 62))).otherwise(chunk))
    ahead = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = chunked.groupBy("conv_id", "chunk").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    placed = chunked.withColumn("inside", F.row_number().over(inside)).join(before, ["conv_id", "chunk"]).withColumn("place", (F.col("ahead") + F.col("inside")).cast("long"))
    parts = [F.col("place"), F.col("role").isNull(), F.col("text").isNull(), F.col("role"), F.col("text")]
    a, b = F.xxhash64(F.lit("a"), *parts), F.xxhash64(F.lit("b"), *parts)
    low = F.lit(0xFFFFFFFF)
    lanes = {"l0": a.bitwiseAND(low), "l1": F.shiftrightunsigned(a, 32), "l2": b.bitwiseAND(low), "l3": F.shiftrightunsigned(b, 32)}
    hashed = common.materialize(placed.select("conv_id", "chunk", "place", *[v.alias(k) for k, v in lanes.items()]), "turn-hashes")
    sums = hashed.groupBy("conv_id", "chunk").agg(*[F.sum(k).alias(f"s{k}") for k in lanes])
    base = sums.select("conv_id", "chunk", *[F.coalesce(F.sum(f"s{k}").over(ahead), F.lit(0)).alias(f"b{k}") for k in lanes])
    running = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefix = hashed.join(base, ["conv_id", "chunk"]).select("conv_id", F.col("place").alias("n_turns"), *[(F.sum(k).over(running) + F.col(f"b{k}")).alias(k) for k in lanes])
    whole = hashed.groupBy("conv_id").agg(F.count("*").alias("n_turns"), *[F.sum(k).alias(k) for k in lanes])
    keys = ["n_turns", *lanes]
    distinct = whole.groupBy(*keys).agg(F.min("conv_id").alias("conv_id"))
    total = whole.select("conv_id", F.col("n_turns").alias("total"))
    proper = prefix.join(total, "conv_id").where("n_turns < total").select(*keys).distinct()
    return distinct.join(proper, keys, "left_anti").select("conv_id", "n_turns")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """Text of each conversation of ``kept``: "<|role|>", line feed, text, line feed, for each turn."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    order = F.struct(F.col("turn"), F.col("role"), F.col("text"), line.alias("line"))
    grouped = turns.join(kept, "conv_id").groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(order)).alias("all"))
    return grouped.select("conv_id", "n_turns", F.array_join(F.transform("all", lambda t: t["line"]), "").alias("rendered"))


def op5_chat_snapshots(spark, sf_dir: str) -> DataFrame:
    """All maximal conversations, rendered."""
    turns = common.table(spark, sf_dir, "conversations")
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return render(turns, collapse(turns))


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, count(*) AS n_turns, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS all_turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), t AS (
  SELECT conv_id, n_turns, list_transform(all_turns, lambda x: {'role': x.role, 'text': x.text}) AS turns FROM c
), prefixes AS (
  SELECT DISTINCT turns[1:k]::VARCHAR AS prefix FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM t)
), maximal AS (
  SELECT turns, n_turns, min(conv_id) AS conv_id FROM t WHERE turns::VARCHAR NOT IN (SELECT prefix FROM prefixes) GROUP BY turns, n_turns
)
SELECT conv_id, n_turns, array_to_string(list_transform(turns, lambda x: '<|' || coalesce(x.role, '') || '|>' || chr(10) || coalesce(x.text, '') || chr(10)), '') AS rendered
FROM maximal
"""
