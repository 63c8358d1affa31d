"""Queries of conversations, feedback, notes and activity, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import history
from ..session import table
from ..streaming import activity

TODAY = "2025-12-31"
TURNS_SQL = """
t as (select id, any_value(lower(regexp_replace(conversation_id, '[{}\\s]', '', 'g'))) as conversation_id, any_value(user_name) as user_name, any_value(lower(trim(role))) as role,
      any_value(content) as content, any_value(created_at) as created_at, any_value(feedback) as feedback
      from messages where lower(trim(role)) in ('user', 'assistant') group by id)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.turns(table(spark, sf_dir, "messages"))


def q_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.pairs(_turns(spark, sf_dir))


PAIRS_SQL = f"""
with {TURNS_SQL},
x as (select *, lead(role) over w as next_role, lead(id) over w as answer_id from t window w as (partition by conversation_id order by created_at asc nulls last, id))
select conversation_id, id as question_id, answer_id from x where role = 'user' and next_role = 'assistant'
"""


def q_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.last_pairs(_turns(spark, sf_dir)).withColumn("turn", F.col("turn").cast("bigint"))


LAST_TURNS_SQL = f"""
with {TURNS_SQL},
x as (select *, lead(role) over w as next_role, lead(id) over w as answer_id from t window w as (partition by conversation_id order by created_at asc nulls last, id)),
p as (select *, row_number() over (partition by conversation_id order by created_at desc nulls first, id desc) as b from x where role = 'user' and next_role = 'assistant')
select conversation_id, row_number() over (partition by conversation_id order by b desc) as turn, id as question_id, answer_id from p where b <= 3
"""


def q_preceding_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.preceding_question(_turns(spark, sf_dir))


PRECEDING_SQL = f"""
with {TURNS_SQL},
a as (select * from t where role = 'assistant' and feedback is not null and created_at is not null),
q as (select a.id, arg_max(u.content, struct_pack(c := u.created_at, i := u.id)) as question from a join t u on u.conversation_id = a.conversation_id and u.role = 'user' and u.created_at < a.created_at group by a.id)
select a.id as answer_id, a.feedback, coalesce(q.question, '(no question found)') as question from a left join q on a.id = q.id
"""


def q_first_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = history.first_questions(_turns(spark, sf_dir))
    return f.select("conversation_id", "user_name", "first_question", F.unix_micros("started_at").alias("started_us"))


FIRST_QUESTION_SQL = f"""
with {TURNS_SQL},
r as (select *, row_number() over (partition by conversation_id order by created_at, id) as n from t where role = 'user' and created_at is not null)
select conversation_id, user_name, content as first_question, epoch_us(created_at) as started_us from r where n = 1
"""


def q_recent_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 500 conversations of all users, by start."""
    f = q_first_question(spark, sf_dir)
    return f.orderBy(F.desc("started_us"), "conversation_id").limit(500).select("conversation_id", "started_us")


RECENT_SQL = f"select conversation_id, started_us from ({FIRST_QUESTION_SQL}) order by started_us desc, conversation_id limit 500"


def q_recency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = history.first_questions(_turns(spark, sf_dir))
    b = f.select(history.recency(F.to_date("started_at"), F.to_date(F.lit(TODAY))).alias("bucket"))
    return b.groupBy("bucket").agg(F.count("*").alias("conversations"))


RECENCY_SQL = f"""
with f as ({FIRST_QUESTION_SQL}), d as (select cast(make_timestamp(started_us) as date) as day from f)
select case when day = date '{TODAY}' then 'Today' when day = date '{TODAY}' - 1 then 'Yesterday' when day >= date '{TODAY}' - 7 then 'This Week' when day >= date '{TODAY}' - 30 then 'This Month' else 'Older' end as bucket,
count(*) as conversations from d group by 1
"""


def q_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.search_texts(_turns(spark, sf_dir))


SEARCH_TEXT_SQL = f"""
with {TURNS_SQL},
u as (select *, lag(content, 1) over w as p1, lag(content, 2) over w as p2 from t where role = 'user' and regexp_matches(content, '[\\p{{L}}\\p{{N}}]') window w as (partition by conversation_id order by created_at asc nulls last, id))
select id, concat_ws(' ', content, content, p2, p1) as search_text from u
"""


def q_feedback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    return t.where("role = 'assistant'").agg(F.count_if(F.col("feedback") == "up").alias("up"), F.count_if(F.col("feedback") == "down").alias("down"), F.count_if(F.col("feedback").isNull()).alias("unrated"), F.count_distinct("conversation_id").alias("conversations"))


FEEDBACK_SQL = f"with {TURNS_SQL} select count(*) filter (feedback = 'up') as up, count(*) filter (feedback = 'down') as down, count(*) filter (feedback is null) as unrated, count(distinct conversation_id) as conversations from t where role = 'assistant'"


def q_user_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    return t.groupBy("user_name").agg(F.count("*").alias("messages"), F.count_distinct("conversation_id").alias("conversations"), F.unix_micros(F.max("created_at")).alias("last_us"))


USER_SQL = f"with {TURNS_SQL} select user_name, count(*) as messages, count(distinct conversation_id) as conversations, epoch_us(max(created_at)) as last_us from t group by 1"


def q_resolve_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that answers name, resolved by id; ids without a note are left out."""
    m = table(spark, sf_dir, "messages").where("field_notes_used is not null").groupBy("id").agg(F.min_by("field_notes_used", history.earliest()).alias("used"))
    n = table(spark, sf_dir, "engineer_notes").select(F.col("id").alias("note_id"), "author", F.date_format("created_at", "MMM dd, yyyy").alias("noted_on"))
    used = m.select(F.col("id").alias("message_id"), F.explode("used.id").alias("note_id")).distinct()
    return used.join(n, "note_id").select("message_id", "note_id", "author", "noted_on")


RESOLVE_NOTES_SQL = """
with u as (select distinct id as message_id, unnest(list_transform(field_notes_used, lambda x: x.id)) as note_id from messages where field_notes_used is not null)
select message_id, note_id, author, strftime(n.created_at at time zone 'UTC', '%b %d, %Y') as noted_on from u join engineer_notes n on u.note_id = n.id
"""


def q_note_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as lines of a prompt; the same note submitted twice counts once, as the earlier."""
    n = table(spark, sf_dir, "engineer_notes")
    once = n.groupBy("category", "position", "author", "note_text").agg(F.min_by(F.struct("id", "author_role", "created_at"), F.struct("created_at", "id")).alias("f"))
    who = F.concat(F.coalesce("author", F.lit("")), F.coalesce(F.concat(F.lit(", "), "f.author_role"), F.lit("")))
    head = F.concat(F.lit("["), F.col("f.id").cast("string"), F.lit("] "), F.coalesce("category", F.lit("")), F.coalesce(F.concat(F.lit(" ("), "position", F.lit(")")), F.lit("")))
    return once.select(F.col("f.id").alias("id"), F.concat(head, F.lit(" - "), who, F.lit(": "), F.coalesce("note_text", F.lit(""))).alias("line"))


NOTE_LINES_SQL = """
with r as (select *, row_number() over (partition by category, position, author, note_text order by created_at, id) as n from engineer_notes)
select id, '[' || id || '] ' || coalesce(category, '') || coalesce(' (' || position || ')', '') || ' - ' || coalesce(author, '') || coalesce(', ' || author_role, '') || ': ' || coalesce(note_text, '') as line from r where n = 1
"""


def q_shown_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of each answer, each address once, at most five, with how many more there are."""
    m = table(spark, sf_dir, "messages").where("show_document_images is not null").groupBy("id").agg(F.min_by("show_document_images", history.earliest()).alias("i"))
    urls = F.array_distinct(F.transform("i", lambda x: x["url"]))
    return m.select(F.col("id").alias("message_id"), F.array_join(F.slice(urls, 1, 5), " ").alias("shown"), F.greatest(F.size(urls) - 5, F.lit(0)).cast("bigint").alias("more"))


SHOWN_IMAGES_SQL = """
with m as (select id, any_value(show_document_images) as i from messages where show_document_images is not null group by id),
x as (select id, unnest(range(len(i))) as pos, i from m),
d as (select id, i[pos + 1].url as url, min(pos) as pos from x group by 1, 2),
r as (select *, row_number() over (partition by id order by pos) as n from d)
select m.id as message_id, coalesce(string_agg(case when n <= 5 then url end, ' ' order by pos), '') as shown, greatest(count(url) - 5, 0) as more from m left join r on m.id = r.id group by m.id
"""


def q_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembled prompt of each answered question: excerpts with their numbers, then question; lengths beside it."""
    t = _turns(spark, sf_dir)
    p = history.pairs(t)
    m = table(spark, sf_dir, "messages").where("chunks is not null").groupBy("id").agg(F.min_by("chunks", history.earliest()).alias("chunks"))
    part = F.transform("chunks", lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c["metadata"]["document_title"], F.lit(", p. "), c["metadata"]["page_number"].cast("string"), F.lit("\n"), c["text"]))
    e = m.select(F.col("id").alias("answer_id"), F.array_join(part, "\n\n").alias("excerpts"))
    q = t.select(F.col("id").alias("question_id"), F.col("content").alias("question"))
    return p.join(e, "answer_id").join(q, "question_id").select("question_id", F.concat(F.lit("Excerpts:\n"), "excerpts", F.lit("\n\nQuestion: "), "question").alias("prompt"))


PROMPT_SQL = f"""
with p as ({PAIRS_SQL}), {TURNS_SQL[1:]},
m as (select id, any_value(chunks) as chunks from messages where chunks is not null group by id),
e as (select id as answer_id, array_to_string(list_transform(range(1, len(chunks) + 1), lambda i: '[' || i || '] ' || chunks[i].metadata.document_title || ', p. ' || chunks[i].metadata.page_number || chr(10) || chunks[i].text), chr(10) || chr(10)) as excerpts from m)
select p.question_id, 'Excerpts:' || chr(10) || excerpts || chr(10) || chr(10) || 'Question: ' || t.content as prompt from p join e on p.answer_id = e.answer_id join t on p.question_id = t.id
"""


def q_stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    c = activity.windowed_counts(spark, f"{sf_dir}/events.parquet", schema)
    return c.select(F.unix_micros("window_start").alias("window_us"), "event_type", "n", F.round("total", 2).alias("total"))


STREAM_SQL = "select epoch_us(date_trunc('hour', ts)) as window_us, event_type, count(*) as n, round(round(sum(value), 6), 2) as total from events group by 1, 2"


def q_error_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of error events of each user between two other events: islands by a count of what breaks a run."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("bad"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    runs = e.withColumn("island", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(w)).where("bad")
    return runs.groupBy("user_id", "island").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"), F.count("*").alias("streaks"))


STREAKS_SQL = """
with i as (select user_id, event_type, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from events),
r as (select user_id, island, count(*) as n from i where event_type = 'error' group by 1, 2)
select user_id, max(n) as longest, count(*) as streaks from r group by 1
"""

QUERIES = {f.__name__: f for f in (q_pairs, q_last_turns, q_preceding_question, q_first_question, q_recent_conversations, q_recency_buckets, q_search_text, q_feedback_counts, q_user_activity, q_resolve_notes, q_note_lines, q_shown_images, q_prompt, q_stream_events, q_error_streaks)}
ORACLE_SQL = {"q_pairs": PAIRS_SQL, "q_last_turns": LAST_TURNS_SQL, "q_preceding_question": PRECEDING_SQL, "q_first_question": FIRST_QUESTION_SQL, "q_recent_conversations": RECENT_SQL, "q_recency_buckets": RECENCY_SQL, "q_search_text": SEARCH_TEXT_SQL, "q_feedback_counts": FEEDBACK_SQL, "q_user_activity": USER_SQL, "q_resolve_notes": RESOLVE_NOTES_SQL, "q_note_lines": NOTE_LINES_SQL, "q_shown_images": SHOWN_IMAGES_SQL, "q_prompt": PROMPT_SQL, "q_stream_events": STREAM_SQL, "q_error_streaks": STREAKS_SQL}
