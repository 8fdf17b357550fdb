"""Chat rendering from every participant's side, in DataFrame functions only.

For each participant of a conversation the whole dialogue is written with that speaker as the assistant
and all others as named users; only the speaker's own words, with their closing mark, are to be learned.
The result is one row per turn and side with its place in the rendered dialogue, so no conversation,
however long, is gathered into one row: concatenating "rendered" by "position" gives the dialogue, and
[mask_start, mask_end) are its characters under the loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles that speak for nobody: shown to every side as they are.
NARRATORS = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turn numbers that are put in order together.
CHUNK = 1024


def _length(*parts: Column) -> Column:
    return sum((F.length(p).cast("long") for p in parts[1:]), F.length(parts[0]).cast("long"))


def perspectives(turns: DataFrame, narrators: tuple[str, ...] = NARRATORS, conversation: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(conv_id, speaker, position, turn, role, name, rendered, start_char, end_char, mask_start, mask_end).

    Positions follow turn (nulls first), role and text, so ties and repeated rows have a defined place;
    repeated rows stay.  A null role is "unknown", a null text empty; a conversation of narrators only has
    no side and no rows; a null conversation is one of its own.  Masks are null on turns of others.
    Extra columns are not read.
    """
    own = F.coalesce(F.col(role), F.lit("unknown"))
    said = turns.select(
        F.col(conversation).alias("c"), F.col(turn).cast("long").alias("t"), own.alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"),
        F.coalesce(F.floor(F.col(turn) / chunk), F.lit(-2**62)).cast("long").alias("k"))
    sides = said.where(~F.col("r").isin(*narrators)).select(F.col("c").alias("sc"), F.col("r").alias("speaker")).distinct()
    both = said.join(sides, F.col("c").eqNullSafe(F.col("sc"))).drop("sc")
    mine = F.col("r") == F.col("speaker")
    kind = F.when(mine, F.lit("assistant")).when(F.col("r").isin(*narrators), F.col("r")).otherwise(F.lit("user"))
    name = F.when(kind == "user", F.col("r"))
    head = F.concat(F.lit(OPEN), kind, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    both = both.select("c", "speaker", "t", "k", "r", "x", kind.alias("kind"), name.alias("name"), head.alias("head"),
                       (_length(head, F.col("x")) + len(CLOSE) + 1).alias("size"))
    # Places within a chunk of turns, then the chunks one after another: no window holds a whole long conversation.
    sums = both.groupBy("c", "speaker", "k").agg(F.sum("size").alias("chars"), F.count(F.lit(1)).alias("turns"))
    ahead = Window.partitionBy("c", "speaker").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("c").alias("bc"), F.col("speaker").alias("bs"), F.col("k").alias("bk"),
                        F.coalesce(F.sum("chars").over(ahead), F.lit(0)).alias("chars0"), F.coalesce(F.sum("turns").over(ahead), F.lit(0)).alias("turns0"))
    within = Window.partitionBy("c", "speaker", "k").orderBy(F.asc_nulls_first("t"), "r", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("upto", F.sum("size").over(within)).withColumn("n", F.count(F.lit(1)).over(within))
    placed = placed.join(bases, F.col("c").eqNullSafe(F.col("bc")) & (F.col("speaker") == F.col("bs")) & (F.col("k") == F.col("bk")))
    end = F.col("chars0") + F.col("upto")
    start = end - F.col("size")
    spoken = F.col("kind") == "assistant"
    return placed.select(
        F.col("c").alias(conversation), "speaker", (F.col("turns0") + F.col("n")).alias("position"), F.col("t").alias("turn"),
        F.col("kind").alias("role"), "name", F.concat("head", "x", F.lit(CLOSE + "\n")).alias("rendered"),
        start.alias("start_char"), end.alias("end_char"),
        F.when(spoken, start + F.length("head")).alias("mask_start"), F.when(spoken, end - 1).alias("mask_end"))


SQL = """
WITH said AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS r, coalesce(text, '') AS x FROM conversations),
sides AS (SELECT DISTINCT conv_id, r AS speaker FROM said WHERE r NOT IN ('system')),
shown AS (
  SELECT s.conv_id, p.speaker, s.turn, s.r, s.x,
         CASE WHEN s.r = p.speaker THEN 'assistant' WHEN s.r = 'system' THEN 'system' ELSE 'user' END AS role
  FROM said s JOIN sides p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
parts AS (
  SELECT *, CASE WHEN role = 'user' THEN r END AS name,
         '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || r ELSE '' END || chr(10) AS head FROM shown),
texts AS (SELECT *, head || x || '<|im_end|>' || chr(10) AS rendered FROM parts),
placed AS (
  SELECT *, row_number() OVER w AS position, CAST(sum(length(rendered)) OVER w AS BIGINT) AS end_char FROM texts
  WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, r, x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, speaker, position, turn, role, name, rendered, end_char - length(rendered) AS start_char, end_char,
       CASE WHEN role = 'assistant' THEN end_char - length(rendered) + length(head) END AS mask_start,
       CASE WHEN role = 'assistant' THEN end_char - 1 END AS mask_end
FROM placed
"""
