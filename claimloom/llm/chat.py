"""Chat formatting: cumulative snapshots of a conversation collapse into the longest, which is rendered.

DataFrame operations only. Turns are range-partitioned by conversation and turn, so one conversation of any
length is spread over tasks. Positions and prefix hashes come from a scan in two levels: within a
partition by a window, then over the partitions' totals of each conversation. A prefix's hash is the
exclusive or of two independent 64-bit hashes of each turn with its position, so totals combine in any
order. Conversations whose whole is a proper prefix of another, or equals one with a smaller id, go by
a grouped minimum and an anti-join on those hashes. Rendered turns are joined by bounded segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut


def format_chats(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = 64) -> DataFrame:
    """conv_id, segment (from 0), n_turns (of the conversation) and rendered (up to `segment` turns
    each; the segments of a conversation in order are its whole rendering) of maximal conversations.

    Turns are ordered by turn (null first), then role, then text; repeated equal turns count once.
    Null roles and texts are empty ones. Rows without a conversation id belong to none and are left out.
    Other columns are not read. An empty table gives no rows.
    """
    turns = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    order = ["t", "role", "text"]
    placed = turns.repartitionByRange("c", *order).withColumn("part", F.spark_partition_id())
    here = Window.partitionBy("part", "c").orderBy(*order)
    # Equal rows are neighbours in one partition: the range key holds all columns.
    new = placed.withColumn("_before", F.lag(F.struct(*order)).over(here)).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.struct(*order))).drop("_before")
    local = cut(new.withColumn("at", F.row_number().over(here)))

    # Offsets of each partition's share of a conversation; one row for each such share.
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = local.groupBy("c", "part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("n_turns", F.sum("n").over(Window.partitionBy("c")))
    numbered = local.join(shares.select("c", "part", "offset", "n_turns"), ["c", "part"]).withColumn("pos", F.col("offset") + F.col("at"))
    hashed = numbered.select("c", "part", "pos", "n_turns", *(F.xxhash64(F.lit(seed), "pos", "role", "text").alias(f"x{seed}") for seed in (1, 2)))

    running = Window.partitionBy("part", "c").orderBy("pos")
    within = hashed.select("c", "part", "pos", "n_turns", *(F.bit_xor(x).over(running).alias(x) for x in ("x1", "x2")))
    totals = hashed.groupBy("c", "part").agg(*(F.bit_xor(x).alias(x) for x in ("x1", "x2")))
    carried = totals.select("c", "part", *(F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(f"{x}_before") for x in ("x1", "x2")))
    prefixes = within.join(carried, ["c", "part"]).select("c", "part", "pos", "n_turns", *(F.col(x).bitwiseXOR(F.col(f"{x}_before")).alias(x) for x in ("x1", "x2")))

    key = ["pos", "x1", "x2"]
    whole = prefixes.where("pos = n_turns").groupBy(*key).agg(F.min("c").alias("c"))
    proper = prefixes.where("pos < n_turns").select(*key).distinct()
    maximal = whole.join(proper, key, "left_anti").select("c")

    kept = shares.join(maximal, "c").select("c", "part", "offset", "n_turns")
    lines = local.join(kept, ["c", "part"]).select("c", "n_turns", (F.col("offset") + F.col("at")).alias("pos"), F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n")).alias("line"))
    parts = lines.groupBy("c", F.floor((F.col("pos") - 1) / segment).alias("segment"), "n_turns").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return parts.select(F.col("c").alias(conv), F.col("segment").cast("long").alias("segment"), F.col("n_turns").cast("long").alias("n_turns"), F.array_join(F.col("lines.line"), "").alias("rendered"))


SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
p AS (SELECT *, string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM o),
w AS (SELECT prefix, min(conv_id) AS conv_id FROM p WHERE pos = n GROUP BY prefix),
m AS (SELECT conv_id FROM w WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n))
SELECT conv_id, CAST((pos - 1) // 64 AS BIGINT) AS segment, CAST(n AS BIGINT) AS n_turns,
       string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM o JOIN m USING (conv_id) GROUP BY conv_id, (pos - 1) // 64, n
"""
