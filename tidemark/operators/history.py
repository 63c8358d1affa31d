"""Conversation analytics over message rows: pairs, preceding questions, last turns, recency, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def earliest(*columns: str) -> Column:
    """What orders the stored copies of one message: time, nulls last, then content. The first is the one that counts."""
    return F.struct(F.col("created_at").isNull(), "created_at", "content", *columns)


def turns(messages: DataFrame) -> DataFrame:
    """(id, conversation_id, user_name, role, content, created_at, feedback) of user and assistant rows, one per id, its
    earliest copy."""
    cid = F.lower(F.regexp_replace("conversation_id", r"[{}\s]", ""))
    role = F.lower(F.trim("role"))
    t = messages.where(role.isin("user", "assistant")).select("id", cid.alias("conversation_id"), "user_name", role.alias("role"), "content", "created_at", "feedback")
    rest = [c for c in t.columns if c != "id"]
    return t.groupBy("id").agg(F.min_by(F.struct(*rest), earliest("role", "feedback", "conversation_id")).alias("m")).select("id", "m.*")


def _order() -> list[Column]:
    return [F.col("created_at").asc_nulls_last(), F.col("id").asc()]


def pairs(t: DataFrame) -> DataFrame:
    """(conversation_id, question_id, answer_id): each user turn that the next turn of its conversation answers. Within a
    conversation the order is time, nulls last, then id."""
    w = Window.partitionBy("conversation_id").orderBy(*_order())
    x = t.withColumn("next_role", F.lead("role").over(w)).withColumn("answer_id", F.lead("id").over(w))
    return x.where("role = 'user' and next_role = 'assistant'").select("conversation_id", F.col("id").alias("question_id"), "answer_id")


def last_pairs(t: DataFrame, n: int = 3) -> DataFrame:
    """The last n pairs of each conversation, numbered from the oldest of them."""
    p = pairs(t).join(t.select(F.col("id").alias("question_id"), "created_at"), "question_id")
    back = Window.partitionBy("conversation_id").orderBy(F.col("created_at").desc_nulls_first(), F.col("question_id").desc())
    p = p.withColumn("b", F.row_number().over(back)).where(F.col("b") <= n)
    ahead = Window.partitionBy("conversation_id").orderBy(F.col("b").desc())
    return p.withColumn("turn", F.row_number().over(ahead)).select("conversation_id", "turn", "question_id", "answer_id")


def preceding_question(t: DataFrame, missing: str = "(no question found)") -> DataFrame:
    """(answer_id, feedback, question): for each rated answer the last user message strictly before it in time; ties by
    the higher id. As-of by value range, so equal times do not count as before. Only ids and times are sorted; the texts of
    the questions that are found are joined behind."""
    x = t.where("created_at is not null").select("conversation_id", "id", "role", "feedback", F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"))
    w = Window.partitionBy("conversation_id").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    said = F.max(F.when(F.col("role") == "user", F.struct("t", "id"))).over(w)
    x = x.withColumn("q", said).where("role = 'assistant' and feedback is not null").select(F.col("id").alias("answer_id"), "feedback", F.col("q.id").alias("q_id"))
    texts = t.where("role = 'user'").select(F.col("id").alias("q_id"), "content")
    return x.join(texts, "q_id", "left").select("answer_id", "feedback", F.coalesce("content", F.lit(missing)).alias("question"))


def first_questions(t: DataFrame) -> DataFrame:
    """(conversation_id, user_name, first_question, started_at): the earliest user turn, by time then id; combined in the
    tasks before the shuffle."""
    u = t.where("role = 'user' and created_at is not null")
    g = u.groupBy("conversation_id").agg(F.min_by(F.struct("user_name", "content", "created_at"), F.struct("created_at", "id")).alias("f"))
    return g.select("conversation_id", "f.user_name", F.col("f.content").alias("first_question"), F.col("f.created_at").alias("started_at"))


def recency(day: Column, today: Column) -> Column:
    """Today, Yesterday, This Week (7 days, and the future), This Month (30 days), Older."""
    return F.when(day == today, "Today").when(day == F.date_sub(today, 1), "Yesterday").when(day >= F.date_sub(today, 7), "This Week").when(day >= F.date_sub(today, 30), "This Month").otherwise("Older")


def search_texts(t: DataFrame, prior: int = 2) -> DataFrame:
    """(id, search_text): each question twice, then up to ``prior`` earlier non-empty questions, oldest first."""
    w = Window.partitionBy("conversation_id").orderBy(*_order()).rowsBetween(-prior, -1)
    u = t.where((F.col("role") == "user") & F.col("content").rlike(r"[\p{L}\p{N}]")).withColumn("before", F.collect_list("content").over(w))
    return u.select("id", F.concat_ws(" ", F.concat(F.array("content", "content"), F.col("before"))).alias("search_text"))
