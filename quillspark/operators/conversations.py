"""Conversations: order-sensitive reads as windows, writes as appends and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous_user_text(messages: DataFrame) -> DataFrame:
    """Each message with the latest user text before it in its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("question", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w))


def recent_history(messages: DataFrame, n: int = 40) -> DataFrame:
    """The last n messages strictly before each conversation's last user turn, in order."""
    asked = messages.filter("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("asked"))
    before = messages.join(asked, "conv_id").filter("turn < asked")
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return before.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n).drop("asked")


def running_totals(messages: DataFrame, measure: str) -> DataFrame:
    """Totals of the prefix that a branch at each message would copy."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("branch_messages", F.count(F.lit(1)).over(w)).withColumn("branch_total", F.sum(measure).over(w))


def branch(messages: DataFrame, conv_id: Column, through: int, new_id: Column) -> DataFrame:
    """A copy of the prefix under a new conversation id."""
    return messages.filter((F.col("conv_id") == conv_id) & (F.col("turn") <= through)).withColumn("conv_id", new_id)


def next_sequence(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, next_turn) for all conversations, 1 for an empty one."""
    top = messages.groupBy("conv_id").agg(F.max("turn").alias("m"))
    return conversations.select("conv_id").distinct().join(top, "conv_id", "left").select("conv_id", (F.coalesce("m", F.lit(0)) + 1).alias("next_turn"))


def append(messages: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh rows (conv_id, arrival, role, text) take the next turns of their conversations."""
    base = next_sequence(messages, fresh)
    w = Window.partitionBy("conv_id").orderBy("arrival")
    numbered = fresh.withColumn("__n", F.row_number().over(w)).join(base, "conv_id")
    return messages.unionByName(numbered.select("conv_id", (F.col("next_turn") + F.col("__n") - 1).cast("long").alias("turn"), "role", "text"))


def delete_conversations(messages: DataFrame, gone: DataFrame) -> DataFrame:
    return messages.join(gone.select("conv_id"), "conv_id", "left_anti")


def contains_any(term: str | None, *columns: str) -> Column:
    """Case-insensitive containment in any column; a blank term filters nothing."""
    t = (term or "").strip().lower()
    out = F.lit(not t)
    for c in columns if t else ():
        out = out | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(t)), F.lit(False))
    return out


def feedback_totals(rated: DataFrame) -> DataFrame:
    return rated.agg(F.count_if(F.col("feedback") == "like").alias("likes"), F.count_if(F.col("feedback") == "dislike").alias("dislikes"))


def changed_only(rows: DataFrame, key: list[str], order: list[str], column: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = F.row_number().over(w) == 1
    return rows.withColumn("__keep", first | ~F.col(column).eqNullSafe(F.lag(column).over(w))).filter("__keep").drop("__keep")


def latest_piece(pieces: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Later pieces of a call replace earlier ones."""
    return pieces.groupBy(*key).agg(F.max_by(value, order).alias(value))


def section_ends(headings: DataFrame, totals: DataFrame) -> DataFrame:
    """Headings (doc_id, line, level) with the last line of each section.

    A section ends before the next heading of its level or above.  For each of the six levels one
    window gives the next heading of that level; the least over the levels up to the own one is wanted,
    so no pair of headings is compared.
    """
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.min(F.when(F.col("level") == k, F.col("line"))).over(w) for k in range(1, 7)]
    cut = F.least(*(F.when(F.col("level") >= k, n) for k, n in enumerate(nexts, 1)), F.lit(None).cast("int"))
    return headings.withColumn("__next", cut).join(totals, "doc_id").select("doc_id", "line", "level", F.coalesce(F.col("__next") - 1, F.col("total_lines")).alias("end_line"))


def neighbours(chunks: DataFrame, key: list[str], n: int = 600) -> DataFrame:
    """Each chunk with the tail of the one before and the head of the next."""
    w = Window.partitionBy(*key).orderBy("chunk_number")
    return chunks.withColumn("before", F.right(F.lag("content").over(w), F.lit(n))).withColumn("after", F.left(F.lead("content").over(w), F.lit(n)))
