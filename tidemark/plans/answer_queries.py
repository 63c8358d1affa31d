"""Queries of labels, names, hints and embeddable chunks, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers
from ..functions import text as tx
from ..operators import library
from ..session import table


def q_short_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "tm_chunks").select("document_title", "revision").distinct()
    return d.select("document_title", "revision", answers.short_label(F.col("document_title"), library.system_of(F.col("document_title")), F.col("revision")).alias("label"))


SHORT_LABELS_SQL = """
with d as (select distinct document_title, revision, coalesce(nullif(trim(string_split(document_title, ' - ')[1]), ''), 'Unknown') as system from tm_chunks),
l as (select document_title, revision, case when starts_with(document_title, system || ' - ') then substr(document_title, length(system) + 4) else document_title end || coalesce(' · ' || revision, '') as x from d)
select document_title, revision, case when length(x) > 40 then left(x, 40) || '...' else x end as label from l
"""


def q_person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "messages").where("user_name is not null").groupBy(answers.person_name(F.col("user_name")).alias("person")).agg(F.count_distinct("user_name").alias("spellings"), F.count("*").alias("rows"))
    return m


PERSON_NAMES_SQL = r"""
with p as (select user_name, list_reduce(list_transform(regexp_extract_all(lower(trim(user_name)), '\p{L}+|[^\p{L}]+'), lambda x: upper(left(x, 1)) || substr(x, 2)), lambda a, b: a || b) as person from messages where user_name is not null)
select person, count(distinct user_name) as spellings, count(*) as rows from p group by 1
"""


def q_unit_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the chunks state in old units, converted, counted by the other unit."""
    t = table(spark, sf_dir, "tm_chunks").select(F.explode(answers.unit_hints(F.col("text"))).alias("h")).select("h.value", F.explode("h.targets").alias("t"))
    return t.groupBy("t.label").agg(F.count("*").alias("statements"), F.round(F.min("t.converted"), 3).alias("least"), F.round(F.max("t.converted"), 3).alias("most"))


# the look-ahead of feet is not in this regex language: feet before a pound are hidden first
_FEET = r"regexp_replace(text, '(?i)(\d\s*)ft(-?lbs?\b)', '\1f_\2', 'g')"
_UNITS_SQL = [
    ("°F", "text", answers.UNITS[0][1], [("°C", "(x - 32) * 5 / 9")]),
    ("psi", "text", answers.UNITS[1][1], [("bar", "x * 0.0689476::double"), ("MPa", "x * 0.00689476::double")]),
    ("lb-ft", "text", answers.UNITS[2][1], [("N·m", "x * 1.35582::double")]),
    ("in", "text", answers.UNITS[3][1], [("mm", "x * 25.4::double")]),
    ("ft", _FEET, r"(?:feet\b|foot\b|ft\b)", [("m", "x * 0.3048::double")]),
]
_STATED_SQL = " union all ".join(
    f"select chunk_id, text, {k} as unit, '{label}' as label, unnest(m) as stated, unnest(range(len(m))) as no from (select chunk_id, text, regexp_extract_all({of}, '(?i){answers.NUMBER}{unit}', 1) as m from tm_chunks)"
    for k, (label, of, unit, _) in enumerate(_UNITS_SQL)
)
UNIT_HINTS_SQL = f"with s as ({_STATED_SQL}), v as (select unit, stated::double as x from s), c as (" + " union all ".join(f"select '{label}' as label, {way} as y from v where unit = {k}" for k, (*_, others) in enumerate(_UNITS_SQL) for label, way in others) + ") select label, count(*) as statements, round(min(y), 3) as least, round(max(y), 3) as most from c group by 1"


def q_unit_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the search text of each chunk gets behind it."""
    t = table(spark, sf_dir, "tm_chunks").select("chunk_id", "text", answers.expanded_units(F.col("text")).alias("long"))
    return t.where("long <> text").select("chunk_id", F.expr("substr(long, length(text) + 1)").alias("added"))


UNIT_EXPAND_SQL = f"""
with s as ({_STATED_SQL}), v as (select *, stated::double as x from s),
h as (select chunk_id, unit, no, stated || label || ' (' || case unit {" ".join(f"when {k} then " + " || ', ' || ".join(f"printf('%.1f', {way}) || '{label}'" for label, way in others) for k, (*_, others) in enumerate(_UNITS_SQL))} end || ')' as hint from v)
select chunk_id, ' [' || string_agg(hint, ', ' order by unit, no) || ']' as added from h group by 1
"""


def q_embeddable(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks")
    ok = F.coalesce(F.col("has_text_layer") & (tx.strip(F.col("text")) != ""), F.lit(False))
    return c.groupBy("document_type").agg(F.count_if(ok).alias("embeddable"), F.count_if(~ok).alias("refused"))


EMBEDDABLE_SQL = r"""
with c as (select document_type, coalesce(has_text_layer and regexp_replace(text, '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g') <> '', false) as ok from chunks)
select document_type, count(*) filter (ok) as embeddable, count(*) filter (not ok) as refused from c group by 1
"""


def q_registry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of each vessel as lines, with a heading wherever the system changes."""
    v = table(spark, sf_dir, "vessel_equipment").withColumn("system", F.coalesce("system", F.lit("Drivetrain")))
    w = Window.partitionBy("vessel").orderBy("system", F.col("category").asc_nulls_last(), F.col("position").asc_nulls_last(), "id")
    head = F.when(F.lag("system").over(w).eqNullSafe(F.col("system")), "").otherwise(F.concat(F.col("system"), F.lit(":\n")))
    what = F.concat_ws(" ", "position", "category")
    line = F.concat(F.lit("- "), what, F.coalesce(F.concat(F.lit(": "), F.nullif(F.concat_ws(" ", "manufacturer", "model"), F.lit(""))), F.lit("")))
    return v.select("id", "vessel", F.concat(head, line).alias("line"))


REGISTRY_LINES_SQL = """
with v as (select *, coalesce(system, 'Drivetrain') as s from vessel_equipment),
l as (select *, lag(s) over (partition by vessel order by s, category nulls last, position nulls last, id) as before from v)
select id, vessel, case when before is not distinct from s then '' else s || ':' || chr(10) end || '- ' || concat_ws(' ', position, category) || coalesce(': ' || nullif(concat_ws(' ', manufacturer, model), ''), '') as line from l
"""


def q_unread_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant messages by whether they follow the five-section form."""
    m = table(spark, sf_dir, "messages").where(F.lower(F.trim("role")) == "assistant").select("id", answers.reply_sections(F.col("content")).alias("s"))
    return m.groupBy(F.col("s.excerpts_used").isNotNull().alias("sectioned")).agg(F.count_distinct("id").alias("messages"))


UNREAD_SQL = f"""
with m as (select id, content as c from messages where lower(trim(role)) = 'assistant'),
p as (select id, {", ".join(f"strpos(c, '{x}') as p{i}" for i, x in enumerate(answers.SECTIONS))} from m)
select coalesce(p0 > 0 and p1 > p0 and p2 > p1 and p3 > p2 and p4 > p3, false) as sectioned, count(distinct id) as messages from p group by 1
"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers, each id once: the copy with the least content, by text."""
    m = table(spark, sf_dir, "messages").where(F.lower(F.trim("role")) == "assistant").where("content is not null")
    return m.groupBy("id").agg(F.min_by(F.struct("content", "safety_info", "field_notes_used", "show_document_images"), F.struct("content", F.to_json("field_notes_used"))).alias("m")).select("id", "m.*")


def q_reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers put into the five-section form from their stored parts, and read again."""
    m = _answers(spark, sf_dir)
    notes = F.coalesce(F.nullif(F.array_join(F.transform("field_notes_used", lambda n: n["id"].cast("string")), ", "), F.lit("")), F.lit("NONE"))
    shown = F.array_join(F.transform("show_document_images", lambda i: i["page_number"].cast("string")), ",")
    used = F.when(F.col("show_document_images").isNull(), "none").otherwise(shown)
    parts = [F.lit(answers.SECTIONS[0]), notes, F.lit(answers.SECTIONS[1]), F.coalesce("safety_info", F.lit("None")), F.lit(answers.SECTIONS[2]), F.coalesce(shown, F.lit("")), F.lit(answers.SECTIONS[3]), used, F.lit(answers.SECTIONS[4]), F.col("content")]
    s = m.select("id", answers.reply_sections(F.array_join(F.array(*parts), "\n")).alias("s"))
    return s.select("id", F.array_join("s.field_note_ids", ",").alias("notes"), "s.safety_info", F.array_join("s.show_excerpts", ",").alias("shown"), F.size("s.excerpts_used").cast("bigint").alias("used"), "s.answer")


REPLY_PARSE_SQL = r"""
with m as (select * from (select *, row_number() over (partition by id order by content, to_json(field_notes_used) nulls first) as n from messages where lower(trim(role)) = 'assistant' and content is not null) where n = 1),
t as (select *, regexp_replace(coalesce(safety_info, 'None'), '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g') as safe from m)
select id, coalesce(array_to_string(list_transform(field_notes_used, lambda x: x.id), ','), '') as notes, case when upper(safe) = 'NONE' then '' else safe end as safety_info,
 coalesce(array_to_string(list_transform(show_document_images, lambda x: x.page_number), ','), '') as shown, cast(coalesce(len(list_filter(show_document_images, lambda x: x.page_number is not null)), 0) as bigint) as used,
 regexp_replace(content, '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g') as answer from t
"""


def q_equipment_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equipment as a model replies with it, JSON in a code fence, read again."""
    v = table(spark, sf_dir, "vessel_equipment").select("id", F.concat(F.lit("```json\n"), F.to_json(F.array(F.struct("category", "manufacturer", "model", "position"))), F.lit("\n```\n")).alias("raw"))
    p = v.select("id", F.explode(answers.parsed_items(F.col("raw"), "struct<category: string, manufacturer: string, model: string, position: string>")).alias("i"))
    return p.select("id", "i.*")


EQUIPMENT_JSON_SQL = "select id, category, manufacturer, model, position from vessel_equipment"


def q_note_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "engineer_notes").select("id", answers.minute_stamp(F.col("created_at")).alias("stamp"))


NOTE_STAMPS_SQL = "select id, strftime(created_at at time zone 'UTC', '%Y-%m-%d %H:%M') || ' UTC' as stamp from engineer_notes"

QUERIES = {f.__name__: f for f in (q_short_labels, q_person_names, q_unit_hints, q_unit_expand, q_embeddable, q_registry_lines, q_unread_sections, q_reply_parse, q_equipment_json, q_note_stamps)}
ORACLE_SQL = {"q_short_labels": SHORT_LABELS_SQL, "q_person_names": PERSON_NAMES_SQL, "q_embeddable": EMBEDDABLE_SQL, "q_registry_lines": REGISTRY_LINES_SQL, "q_unread_sections": UNREAD_SQL, "q_unit_hints": UNIT_HINTS_SQL, "q_unit_expand": UNIT_EXPAND_SQL, "q_reply_parse": REPLY_PARSE_SQL, "q_equipment_json": EQUIPMENT_JSON_SQL, "q_note_stamps": NOTE_STAMPS_SQL}
