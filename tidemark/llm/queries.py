"""Queries of the text operators. Each reads whole tables and uses the operators with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, written
from . import canonical, conversations, encoding, mixing, packing, quality, scans, tokens


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tm_chunks").select("chunk_id", "text")
    return encoding.repair_encoding(t).where("garbled").select("chunk_id")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tm_chunks").select("chunk_id", "text")
    return encoding.repair_encoding(t).where("garbled").select("chunk_id", "restored", F.concat_ws(",", "mappings").alias("mappings"), "lost")


def p1_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tm_chunks").select("chunk_id", "text")
    return encoding.restore_replacement(encoding.repair_encoding(t))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, _, _ = conversations.rebuild(table(spark, sf_dir, "messages"))
    return turns.select("conversation_id", "turn_no", "id")


def p2_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "messages")
    return conversations.with_content(conversations.rebuild(messages)[0], messages)


def p2_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.rebuild(table(spark, sf_dir, "messages"))[1]


def p2_clock_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = conversations.rebuild(table(spark, sf_dir, "messages"))[2]
    return offsets.withColumn("offset_s", F.round("offset_s", 6))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tm_chunks").select("chunk_id", "text", "source_file", "page_number")
    return scans.damage(t)["found"].select("chunk_id", "defect")


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repair(table(spark, sf_dir, "tm_chunks").select("chunk_id", "text", "source_file", "page_number"))


def p4_text_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the stored hint agrees with the damage found: chunks by hint and defect."""
    found = p4_found(spark, sf_dir)
    hint = table(spark, sf_dir, "chunks").groupBy("chunk_id").agg(F.min("has_text_layer").alias("has_text_layer"))
    return found.join(hint, "chunk_id").groupBy("defect", "has_text_layer").agg(F.count("*").alias("chunks"))


def _canonical(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    equipment, chunks = table(spark, sf_dir, "vessel_equipment").select("manufacturer", "model"), table(spark, sf_dir, "tm_chunks").select("equipment_model")
    return canonical.canonical(equipment, chunks, table(spark, sf_dir, "equipment_catalog"), table(spark, sf_dir, "manufacturer_list"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = {k: d.where("not exact") for k, d in _canonical(spark, sf_dir).items()}
    equipment, chunks = table(spark, sf_dir, "vessel_equipment").select(F.col("id").cast("string").alias("record_id"), "manufacturer", "model"), table(spark, sf_dir, "tm_chunks").select(F.col("chunk_id").alias("record_id"), "equipment_model")
    by_maker = equipment.join(got["maker"], equipment["manufacturer"] == got["maker"]["value"]).select(F.lit("vessel_equipment.manufacturer").alias("field"), "record_id", F.col("maker_id").alias("canonical_id"))
    same = (equipment["model"] == got["model"]["value"]) & equipment["manufacturer"].eqNullSafe(got["model"]["maker_value"])
    by_model = equipment.join(got["model"], same).select(F.lit("vessel_equipment.model").alias("field"), "record_id", F.col("catalog_id").alias("canonical_id"))
    by_chunk = chunks.join(got["both"], chunks["equipment_model"] == got["both"]["value"]).select(F.lit("tm_chunks.equipment_model").alias("field"), "record_id", F.col("catalog_id").alias("canonical_id"))
    return by_maker.unionByName(by_model).unionByName(by_chunk)


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the three fields that have no entry, with their rows. A model that several makers use can fail with one
    manufacturer only; its rows are those of the failing pairs."""
    got = _canonical(spark, sf_dir)
    m = got["maker"].where("maker_id = 0").select(F.lit("vessel_equipment.manufacturer").alias("field"), "value", "rows")
    d = got["model"].where("catalog_id = 0 and not exact").groupBy("value").agg(F.sum("rows").alias("rows"))
    e = got["both"].where("catalog_id = 0 and not exact").select(F.lit("tm_chunks.equipment_model").alias("field"), "value", "rows")
    return m.unionByName(d.select(F.lit("vessel_equipment.model").alias("field"), "value", "rows")).unionByName(e)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the packer had to split."""
    return p6_blocks(spark, sf_dir).where("part > 0").select("doc_id").distinct()


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(tokens.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "tokens"), "document-tokens")


def p6_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = int(table(spark, sf_dir, "pack_profile").first()["capacity_tokens"])
    return packing.pack(_sized(spark, sf_dir), capacity)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = int(table(spark, sf_dir, "pack_profile").first()["capacity_tokens"])
    return packing.fill_report(packing.pack(_sized(spark, sf_dir), capacity), capacity)


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixture(docs, table(spark, sf_dir, "mix_targets"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = quality.text_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return t.where("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = quality.text_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return t.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in t.dtypes])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_restored, p1_replacements, p2_found, p2_conversations, p2_verdicts, p2_clock_offsets, p4_found, p4_repaired, p4_text_layer, p5_found, p5_unmatched, p6_found, p6_blocks, p6_fill, p7_mixture, p7_shares, p8_found, p8_statistics)
}

# p2_found in SQL: the definition, without blocks or offsets. Patterns are those of the operator.
_TURNS = f"""
with m as (select id, lower(regexp_replace(conversation_id, '[\\s{{}}()]', '', 'g')) as conversation_id, lower(regexp_replace(role, '[\\s\\p{{Z}}:]+', '', 'g')) as r, content, created_at from messages where conversation_id is not null),
o as (select * from (select *, row_number() over (partition by conversation_id, id order by created_at nulls last) as n from m) where n = 1 and conversation_id <> ''),
s as (select id, conversation_id, content, created_at, case when r in {conversations.USER_NAMES} then 'user' when r in {conversations.ASSISTANT_NAMES} then 'assistant' when r in {conversations.SYSTEM_NAMES} then 'system' end as speaker from o),
t as (select *, trim(regexp_replace(lower(content), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as words,
 created_at is not null and speaker is not null and coalesce(regexp_matches(content, '[\\p{{L}}\\p{{N}}]') and not regexp_matches(content, '{conversations.PLACEHOLDER}') and not (regexp_matches(content, '{conversations.NOTICE}') and regexp_matches(content, '{conversations.FAILURE}')), false) as fit
 from s where speaker is distinct from 'system'),
p as (select *, lag(speaker) over w as before, lag(words) over w as said, row_number() over w as i from t window w as (partition by conversation_id order by created_at asc nulls first, id)),
q as (select *, i > 1 and before is not distinct from speaker and said is not distinct from words as again from p),
v as (select *, not again and i > 1 and before is not distinct from speaker as broken, sum(case when again then 0 else 1 end) over (partition by conversation_id order by created_at asc nulls first, id rows unbounded preceding) as turn_no from q),
k as (select conversation_id from v group by 1 having bool_and(fit) and not bool_or(broken) and arg_min(speaker, i) = 'user' and arg_max(speaker, i) = 'assistant')
select conversation_id, cast(turn_no as int) as turn_no, id from v where not again and conversation_id in (select conversation_id from k)
"""
ORACLE_SQL: dict[str, str] = {"p2_found": _TURNS}
