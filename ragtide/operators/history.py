"""Interaction history: W2 last-N per session with the total count, W5 clear.

History is a table (session_id, seq, query, answer, ts).  The last-N window
is a ``row_number() <= N`` per session, which Spark plans with a partial
WindowGroupLimit before the shuffle, so a session holding a third of all rows
ships at most N rows per task; the count is a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragtide.functions.text import iso_timestamp

# --- fixed values -----------------------------------------------------------
HISTORY_LAST_N = 10
# ----------------------------------------------------------------------------


def interactions_from_turns(turns: DataFrame, *, epoch: str = "2024-01-01 00:00:00") -> DataFrame:
    """Chat interactions from a turn table (conv_id, turn, role, text): each
    user turn with the assistant turn right after it.  An equi-join on
    (conv_id, turn) keys spreads a long conversation over many tasks, where a
    ``lead`` window would put it in one.  ts = epoch + conv_id minutes + turn
    seconds (a derived stand-in for the interaction time; the minutes begin
    again every 10^10, so any 64-bit conv_id has one)."""
    u = turns.where(F.col("role") == "user").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("text").alias("query"))
    a = turns.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("session_id"), (F.col("turn") - 1).alias("seq"), F.col("text").alias("answer"))
    j = u.join(a, ["session_id", "seq"], "inner")
    ts = (F.to_timestamp_ntz(F.lit(epoch))
          + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                               (F.pmod(F.col("session_id").cast("long"), F.lit(10_000_000_000)) * 60 + F.col("seq"))
                               .cast("decimal(18,6)")))
    return j.select(F.col("session_id").cast("long"), F.col("seq").cast("long"), "query", "answer",
                    ts.alias("ts"))


def history_last_n(history: DataFrame, n: int = HISTORY_LAST_N) -> DataFrame:
    """Per session the last n interactions (oldest first) and the total
    count: (session_id, position, seq, query, answer, timestamp, count)."""
    w = Window.partitionBy("session_id").orderBy(F.col("seq").desc())
    last = history.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    counts = history.groupBy("session_id").agg(F.count(F.lit(1)).alias("count"))
    kept = last.join(counts, "session_id")
    # position 1 = oldest of the kept items
    pos = (F.least(F.col("count"), F.lit(n)) - F.col("_rn") + 1).cast("long")
    return kept.select("session_id", pos.alias("position"), "seq", "query", "answer",
                       iso_timestamp("ts").alias("timestamp"), "count")


def clear_history(history: DataFrame, session_id) -> DataFrame:
    """The history without the given session (write the result back)."""
    return history.where(~F.col("session_id").eqNullSafe(F.lit(session_id)))
