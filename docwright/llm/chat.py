"""Chat formatting with cumulative-snapshot collapse, in DataFrame expressions only.

A conversation that is logged again after each turn leaves snapshots that are prefixes of the final one. Every turn's
prefix gets a rolling hash: two 64-bit hashes of (position, role, text), folded over the turns before it. A conversation
whose whole hash is some longer conversation's prefix hash is dropped by an anti-join; of equal ones the smallest conv_id
stays. The rest are rendered.

Edge cases: turns are ordered by turn, role, text, nulls first, so ties and repeated rows have one order; repeated rows are
turns of their own. Null roles and texts differ from empty ones when compared and are rendered as empty. A null conv_id is
a conversation of its own. Columns beside the four are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

TURN = ("<|im_start|>", "\n", "<|im_end|>\n")


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), n_turns and the hashes x1, x2 of the first pos turns."""
    w = Window.partitionBy("conv_id").orderBy(*_order())
    seen = turns.select("conv_id", "turn", "role", "text").withColumn("pos", F.row_number().over(w))
    cells = [F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    seen = seen.select("conv_id", "pos", F.xxhash64(*cells).alias("h1"), F.xxhash64(F.lit("second"), *cells).alias("h2"))
    by, whole = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("conv_id")
    return seen.select("conv_id", "pos", F.count(F.lit(1)).over(whole).alias("n_turns"), F.bit_xor("h1").over(by).alias("x1"), F.bit_xor("h2").over(by).alias("x2"))


def maximal(hashes: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that no longer one starts with."""
    whole = hashes.filter("pos = n_turns").groupBy("n_turns", "x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    prefixes = hashes.filter("pos < n_turns").select(F.col("pos").cast("long").alias("n_turns"), "x1", "x2").distinct()
    return whole.join(prefixes, ["n_turns", "x1", "x2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def render(turns: DataFrame, kept: DataFrame, template=TURN) -> DataFrame:
    """Adds ``rendered``: each turn as opening, role, break, text, closing, in order. A conversation is one output row."""
    head, mid, tail = template
    order = F.struct(F.coalesce(F.col("turn").isNotNull(), F.lit(False)), "turn", F.col("role").isNotNull(), "role", F.col("text").isNotNull(), "text").alias("o")
    one = F.concat(F.lit(head), F.coalesce("role", F.lit("")), F.lit(mid), F.coalesce("text", F.lit("")), F.lit(tail)).alias("line")
    lines = turns.select("conv_id", F.struct(order, one).alias("t")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["line"]), "").alias("rendered"))
    return kept.join(lines, kept["conv_id"].eqNullSafe(lines["conv_id"])).select(kept["conv_id"], "n_turns", "n_copies", "rendered")


def format_chats(turns: DataFrame, template=TURN) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered of every maximal conversation."""
    scratch = Scratch(turns.sparkSession, "chat")
    hashes = scratch.table(prefix_hashes(turns), "prefixes")
    return render(turns, maximal(hashes), template)


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY pos) AS l,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
  FROM t GROUP BY conv_id),
k AS (SELECT l, n_turns, unnest(range(1, n_turns)) AS k FROM c),
p AS (SELECT DISTINCT list_slice(l, 1, k) AS l FROM k),
g AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, l FROM c GROUP BY l)
SELECT c.conv_id, c.n_turns, g.n_copies, c.rendered
FROM g JOIN c ON c.conv_id = g.conv_id
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = g.l)
"""
