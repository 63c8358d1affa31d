"""Queries of the library, its coverage and its upkeep, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import library, merging
from ..session import table

NORM = "regexp_replace(upper(coalesce({0}, '')), '[^A-Z0-9]', '', 'g')"


def norm(x: str) -> str:
    return NORM.format(x)


def q_library_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.documents_of(table(spark, sf_dir, "tm_chunks"))


LIBRARY_DOCUMENTS_SQL = "select document_title, document_type, revision, equipment_model, count(*) as chunk_count from tm_chunks group by 1, 2, 3, 4"

SYSTEM = "coalesce(nullif(regexp_replace(string_split(document_title, ' - ')[1], '^\\s+|\\s+$', '', 'g'), ''), 'Unknown')"


def q_library_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each system: how many, and the first five titles."""
    d = table(spark, sf_dir, "tm_chunks").select("document_title").distinct().withColumn("system", library.system_of(F.col("document_title")))
    n = d.groupBy("system").agg(F.count("*").alias("documents"))
    w = Window.partitionBy("system").orderBy("document_title")
    top = d.withColumn("n", F.row_number().over(w)).where("n <= 5").groupBy("system").agg(F.array_join(F.sort_array(F.collect_list("document_title")), "; ").alias("first_titles"))
    return n.join(top, "system")


LIBRARY_PANEL_SQL = f"""
with d as (select document_title, {SYSTEM} as system from (select distinct document_title from tm_chunks)),
r as (select *, row_number() over (partition by system order by document_title) as n from d)
select system, count(*) as documents, string_agg(case when n <= 5 then document_title end, '; ' order by document_title) as first_titles from r group by 1
"""


def q_library_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that hold every word of a filter, underscores read as spaces, case aside."""
    d = table(spark, sf_dir, "tm_chunks").select("document_title", "document_type", "equipment_model").distinct()
    hay = F.replace(F.lower(F.concat_ws(" ", "document_title", "document_type", "equipment_model")), F.lit("_"), F.lit(" "))
    words = F.split(F.lower(F.lit("drivetrain manual")), " ")
    return d.where(F.forall(words, lambda w: F.contains(hay, w)))


LIBRARY_FILTER_SQL = """
with d as (select distinct document_title, document_type, equipment_model from tm_chunks), h as (select *, replace(lower(concat_ws(' ', document_title, document_type, equipment_model)), '_', ' ') as x from d)
select document_title, document_type, equipment_model from h where contains(x, 'drivetrain') and contains(x, 'manual')
"""


def q_document_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = library.documents_of(table(spark, sf_dir, "tm_chunks"))
    return d.groupBy(library.document_class(F.col("document_type")).alias("class")).agg(F.count("*").alias("documents"), F.sum("chunk_count").alias("chunks"))


DOCUMENT_CLASSES_SQL = f"""
with d as ({LIBRARY_DOCUMENTS_SQL})
select case when document_type in ('General Arrangement Drawing', 'Wiring Diagram') then 'drawing' when document_type in ('O&M Manual', 'Service Manual') then 'manual' else 'other' end as class, count(*) as documents, cast(sum(chunk_count) as bigint) as chunks from d group by 1
"""


def q_inventory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "tm_chunks").groupBy("document_title", "document_type").agg(F.count_distinct("revision").alias("revisions"), F.count_distinct("source_file").alias("files"))
    return d.select(F.concat(F.lit("- "), "document_title", F.lit(" ["), F.coalesce("document_type", F.lit("?")), F.lit("], "), F.col("revisions").cast("string"), F.lit(" revision(s), "), F.col("files").cast("string"), F.lit(" file(s)")).alias("line"))


INVENTORY_SQL = "select '- ' || document_title || ' [' || coalesce(document_type, '?') || '], ' || count(distinct revision) || ' revision(s), ' || count(distinct source_file) || ' file(s)' as line from tm_chunks group by document_title, document_type"


def q_dup_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose texts have the same size in bytes."""
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    return d.groupBy(F.octet_length("text").cast("bigint").alias("bytes")).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id")).where("documents > 1")


DUP_SIZES_SQL = "select cast(strlen(text) as bigint) as bytes, count(*) as documents, min(doc_id) as first_id from documents where length(text) > 0 group by 1 having count(*) > 1"


def q_dup_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    return d.groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id"), F.count_distinct("document_title").alias("titles")).where("documents > 1")


DUP_HASH_SQL = "select sha256(text) as hash, count(*) as documents, min(doc_id) as first_id, count(distinct document_title) as titles from documents where length(text) > 0 group by 1 having count(*) > 1"


def _file_hash(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    t = table(spark, sf_dir, name).where(F.length(F.trim("text")) > 0).select("source_file", "chunk_id", "text").distinct()
    h = merging.content_hash(t, "source_file")
    return h.select(F.col("source_file").alias("filename"), F.concat_ws("-", F.col("content").cast("string"), F.col("parts").cast("string")).alias("hash"))


def _hash_sql(name: str) -> str:
    # hex digits to numbers: the position of each digit, by its weight
    def number(at: int) -> str:
        return " + ".join(f"cast(strpos('0123456789abcdef', substr(h, {at + i}, 1)) - 1 as hugeint) * {16 ** (15 - i)}" for i in range(16))

    return f"select source_file as filename, cast(sum({number(1)}) as varchar) || '.' || cast(sum({number(17)}) as varchar) || '-' || count(*) as hash from (select distinct source_file, chunk_id, text, sha256(text) as h from {name} where length(trim(text)) > 0) group by 1"


def q_manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the store against those of the backup, by name and content."""
    return merging.renames(_file_hash(spark, sf_dir, "tm_chunks"), _file_hash(spark, sf_dir, "chunks")).groupBy("status").agg(F.count("*").alias("files"), F.min("filename").alias("first_file"))


MANIFEST_DIFF_SQL = f"""
with l as ({_hash_sql("tm_chunks")}), k as ({_hash_sql("chunks")}),
g as (select k.hash, max(k.filename) as was from k left join l on k.filename = l.filename where l.filename is null group by 1),
n as (select l.filename, case when k.filename is not null and l.hash = k.hash then 'unchanged' when k.filename is not null then 'changed' when g.was is not null then 'renamed' else 'new' end as status, g.was
      from l left join k on l.filename = k.filename left join g on g.hash = l.hash and k.filename is null),
r as (select k.filename, 'removed' as status from k left join l on k.filename = l.filename where l.filename is null and k.filename not in (select was from n where status = 'renamed'))
select status, count(*) as files, min(filename) as first_file from (select filename, status from n union all select * from r) group by 1
"""


def q_same_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files taken in twice: one content under several names."""
    h = _file_hash(spark, sf_dir, "tm_chunks")
    return h.groupBy("hash").agg(F.count("*").alias("files"), F.min("filename").alias("first_file"), F.max("filename").alias("last_file")).where("files > 1")


SAME_CONTENT_SQL = f"with h as ({_hash_sql('tm_chunks')}) select hash, count(*) as files, min(filename) as first_file, max(filename) as last_file from h group by 1 having count(*) > 1"


def q_manifest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the backup, refused ones too, against the store."""
    return merging.audit(table(spark, sf_dir, "chunks").select("source_file", "chunk_id"), table(spark, sf_dir, "tm_chunks").select("source_file", "chunk_id"))


MANIFEST_AUDIT_SQL = """
with d as (select distinct source_file, chunk_id from chunks), s as (select distinct source_file, chunk_id from tm_chunks),
j as (select coalesce(d.source_file, s.source_file) as source_file, d.chunk_id as d, s.chunk_id as s from d full join s on d.chunk_id = s.chunk_id),
a as (select source_file, count(d) as declared, cast(sum(case when d is not null and s is null then 1 else 0 end) as bigint) as missing, cast(sum(case when d is null then 1 else 0 end) as bigint) as orphaned from j group by 1)
select source_file, case when declared = 0 then 'orphaned' when missing = declared then 'missing' else 'partial' end as status, declared, missing, orphaned,
 case when declared > 0 then cast(round_even(100.0 * missing / declared, 0) as int) end as missing_pct from a where declared = 0 or missing > 0
"""


def q_chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after the backup is written over it: rows by type, and their characters."""
    store = table(spark, sf_dir, "tm_chunks").select("chunk_id", "document_type", "text")
    new = table(spark, sf_dir, "chunks").where(F.length(F.trim("text")) > 0).select("chunk_id", "document_type", "text")
    merged = merging.upsert(store, new, ["chunk_id"], ["text", "document_type"])
    return merged.groupBy("document_type").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters"))


CHUNK_MERGE_SQL = """
with n as (select * from (select chunk_id, document_type, text, row_number() over (partition by chunk_id order by text desc nulls last, document_type desc nulls last) as r from chunks where length(trim(text)) > 0) where r = 1),
m as (select chunk_id, document_type, text from n union all select chunk_id, document_type, text from tm_chunks t where not exists (select 1 from n where n.chunk_id = t.chunk_id))
select document_type, count(*) as chunks, cast(sum(length(text)) as bigint) as characters from m group by 1
"""


def q_delete_reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store keeps when all files of drawings are taken out to be read again."""
    t = table(spark, sf_dir, "tm_chunks").select("chunk_id", "source_file", "document_type")
    gone = t.where(F.col("source_file").contains("_DWG_")).select("source_file")
    return merging.delete_keys(t, gone, ["source_file"]).groupBy("document_type").agg(F.count("*").alias("kept"))


DELETE_SQL = "select document_type, count(*) as kept from tm_chunks where not contains(source_file, '_DWG_') group by 1"


def q_registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equipment lists read again replace their row: the last of each vessel, system, category and position, nulls equal."""
    v = table(spark, sf_dir, "vessel_equipment").select("id", "vessel", "system", "category", "position", "model", "updated_at")
    m = merging.last_per_key(v, ["vessel", "system", "category", "position"], [F.col("updated_at"), F.col("id")])
    return m.select("id", "vessel", "system", "category", "position", "model")


REGISTRY_SQL = """
select id, vessel, system, category, position, model from
(select *, row_number() over (partition by vessel, system, category, position order by updated_at desc nulls last, id desc) as n from vessel_equipment) where n = 1
"""


def q_equipment_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.dedupe_items(table(spark, sf_dir, "vessel_equipment"))


EQUIPMENT_DEDUPE_SQL = f"""
with t as (select *, {norm("manufacturer")} as m, {norm("model")} as n from vessel_equipment),
k as (select *, case when length(n) >= 3 then concat_ws('|', m, n) else concat_ws('|', '?', coalesce(source_document, ''), coalesce(category, '')) end as item_key from t)
select item_key, min(id) as first_id, arg_min_null(manufacturer, id) as manufacturer, arg_min_null(model, id) as model, count(distinct source_document) as documents, count(*) as mentions from k group by 1
"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vessel_equipment").select(F.col("id").alias("item_id"), "model", "system")
    return library.gap_report(v, table(spark, sf_dir, "equipment_catalog"), table(spark, sf_dir, "tm_chunks").select("document_title", "equipment_model"))


def q_gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


GAP_SQL = f"""
with i as (select id as item_id, model, system, {norm("model")} as needle from vessel_equipment),
h as (select distinct {norm("document_title")} || {norm("equipment_model")} as hay, document_title as label from tm_chunks),
r as (select distinct {norm("model")} as name from equipment_catalog),
n as (select distinct needle from i),
c as (select needle, min(label) as matched_document from n join h on contains(h.hay, n.needle) where length(needle) >= 3 group by 1),
k as (select distinct needle from n join r on (contains(r.name, n.needle) or contains(n.needle, r.name)) where length(needle) >= 3 and name <> '')
select item_id, system, model, case when length(i.needle) < 3 then 'unknown' when matched_document is not null then 'covered' else 'gap' end as status, matched_document,
 case when length(i.needle) >= 3 and matched_document is null then k.needle is not null end as in_registry
from i left join c on i.needle = c.needle left join k on i.needle = k.needle
"""


def q_gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.gap_summary(_report(spark, sf_dir))


GAP_SUMMARY_SQL = f"""
with g as ({GAP_SQL}), s as (select system, cast(sum(case when status = 'covered' then 1 else 0 end) as bigint) as covered, cast(sum(case when status = 'gap' then 1 else 0 end) as bigint) as gaps from g where status in ('covered', 'gap') group by 1),
m as (select system, model, row_number() over (partition by system order by model) as n, count(*) over (partition by system) as k from (select distinct system, model from g where status = 'gap')),
t as (select system, string_agg(case when n <= 3 then model end, '; ' order by n) || case when max(k) > 3 then ' (+' || (max(k) - 3) || ' more)' else '' end as first_gaps from m group by 1)
select s.system, covered, gaps, cast(round_even(100.0 * covered / (covered + gaps), 0) as int) || '%' as pct, coalesce(first_gaps, '') as first_gaps from s left join t on s.system = t.system
"""


def q_gap_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.gap_totals(_report(spark, sf_dir))


GAP_TOTALS_SQL = f"""
with g as ({GAP_SQL}), c as (select coalesce(system, 'Unknown') as system, count(*) as items, count(*) filter (status = 'covered') as covered, count(*) filter (status = 'gap') as gaps, count(*) filter (status = 'unknown') as unknown from g group by 1)
select * from c union all select 'Total', cast(sum(items) as bigint), cast(sum(covered) as bigint), cast(sum(gaps) as bigint), cast(sum(unknown) as bigint) from c having count(*) > 0
"""


def q_equipment_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of equipment was seen besides the row that is kept of it."""
    return library.item_sources(table(spark, sf_dir, "vessel_equipment"))


EQUIPMENT_SOURCES_SQL = f"""
with t as (select *, {norm("manufacturer")} as m, {norm("model")} as n from vessel_equipment),
k as (select *, case when length(n) >= 3 then concat_ws('|', m, n) else concat_ws('|', '?', coalesce(source_document, ''), coalesce(category, '')) end as item_key from t),
f as (select item_key, min(id) as kept from k group by 1)
select k.item_key, source_document, min(id) as first_id, count(*) as mentions, min(id) = any_value(kept) as is_first from k join f on k.item_key = f.item_key where source_document is not null group by 1, 2
"""


def q_image_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = library.image_backlog(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "tm_chunks"))
    return d.groupBy("status").agg(F.count("*").alias("files"), F.min("source_file").alias("first_file"))


IMAGE_BACKLOG_SQL = """
with s as (select source_file, count(page_image_url) as images from tm_chunks group by 1), l as (select distinct source_file from chunks),
b as (select l.source_file, case when images is null then 'not indexed' when images > 0 then 'has images' else 'open' end as status from l left join s on l.source_file = s.source_file)
select status, count(*) as files, min(source_file) as first_file from b group by 1
"""


def q_incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backup's files read into the store with their hashes as manifest: rows of the store by what became of their file."""
    store = table(spark, sf_dir, "tm_chunks").select("chunk_id", "source_file", "text")
    arrived = table(spark, sf_dir, "chunks").where(F.length(F.trim("text")) > 0).select("chunk_id", "source_file", "text").distinct()
    after, _, report = merging.ingest(store, _file_hash(spark, sf_dir, "tm_chunks"), _file_hash(spark, sf_dir, "chunks"), arrived)
    j = after.join(report, after["source_file"] == report["filename"], "left")
    return j.groupBy("status").agg(F.count("*").alias("rows"), F.count_distinct("source_file").alias("files"), F.sum(F.length("text")).alias("characters"))


INGEST_SQL = f"""
with l as ({_hash_sql("chunks")}), k as ({_hash_sql("tm_chunks")}),
g as (select k.hash, max(k.filename) as was from k left join l on k.filename = l.filename where l.filename is null group by 1),
n as (select l.filename, case when k.filename is not null and l.hash = k.hash then 'unchanged' when k.filename is not null then 'changed' when g.was is not null then 'renamed' else 'new' end as status, g.was
      from l left join k on l.filename = k.filename left join g on g.hash = l.hash and k.filename is null),
r as (select filename, status, was from n union all select k.filename, 'removed', null from k left join l on k.filename = l.filename where l.filename is null and k.filename not in (select was from n where status = 'renamed')),
a as (select t.chunk_id, coalesce(m.filename, t.source_file) as source_file, text from tm_chunks t left join r m on m.status = 'renamed' and m.was = t.source_file where t.source_file not in (select filename from r where status in ('changed', 'new'))
      union all select distinct chunk_id, source_file, text from chunks where length(trim(text)) > 0 and source_file in (select filename from r where status in ('changed', 'new')))
select status, count(*) as rows, count(distinct a.source_file) as files, cast(sum(length(text)) as bigint) as characters from a left join r on a.source_file = r.filename group by 1
"""


def q_image_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page images given to the rows of the page that have none."""
    t = table(spark, sf_dir, "tm_chunks").select("chunk_id", "source_file", "page_number", "page_image_url")
    known = t.where("page_image_url is not null").groupBy("source_file", "page_number").agg(F.min("page_image_url").alias("found"))
    return t.join(known, ["source_file", "page_number"], "left").select("chunk_id", F.coalesce("page_image_url", "found").alias("page_image_url"))


IMAGE_FILL_SQL = "select chunk_id, coalesce(page_image_url, min(page_image_url) over (partition by source_file, page_number)) as page_image_url from tm_chunks"


def q_spec_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs as rows: how often each key is used and by how many vessels."""
    v = table(spark, sf_dir, "vessel_equipment").where("specs is not null").select("vessel", F.explode("specs").alias("key", "value"))
    return v.groupBy("key").agg(F.count("*").alias("uses"), F.count_distinct("vessel").alias("vessels"), F.max(F.length("value")).cast("bigint").alias("longest"))


SPEC_VALUES_SQL = """
with v as (select vessel, unnest(map_entries(specs)) as e from vessel_equipment where specs is not null)
select e.key as key, count(*) as uses, count(distinct vessel) as vessels, cast(max(length(e.value)) as bigint) as longest from v group by 1
"""

QUERIES = {f.__name__: f for f in (q_library_documents, q_library_panel, q_library_filter, q_document_classes, q_inventory_lines, q_dup_sizes, q_dup_hash, q_manifest_diff, q_same_content, q_manifest_audit, q_chunk_merge, q_delete_reprocess, q_registry_merge, q_equipment_dedupe, q_gap_report, q_gap_summary, q_gap_totals, q_equipment_sources, q_image_backlog, q_incremental_ingest, q_image_fill, q_spec_values)}
ORACLE_SQL = {"q_library_documents": LIBRARY_DOCUMENTS_SQL, "q_library_panel": LIBRARY_PANEL_SQL, "q_library_filter": LIBRARY_FILTER_SQL, "q_document_classes": DOCUMENT_CLASSES_SQL, "q_inventory_lines": INVENTORY_SQL, "q_dup_sizes": DUP_SIZES_SQL, "q_dup_hash": DUP_HASH_SQL, "q_manifest_diff": MANIFEST_DIFF_SQL, "q_same_content": SAME_CONTENT_SQL, "q_manifest_audit": MANIFEST_AUDIT_SQL, "q_chunk_merge": CHUNK_MERGE_SQL, "q_delete_reprocess": DELETE_SQL, "q_registry_merge": REGISTRY_SQL, "q_equipment_dedupe": EQUIPMENT_DEDUPE_SQL, "q_gap_report": GAP_SQL, "q_gap_summary": GAP_SUMMARY_SQL, "q_gap_totals": GAP_TOTALS_SQL, "q_equipment_sources": EQUIPMENT_SOURCES_SQL, "q_image_backlog": IMAGE_BACKLOG_SQL, "q_incremental_ingest": INGEST_SQL, "q_image_fill": IMAGE_FILL_SQL, "q_spec_values": SPEC_VALUES_SQL}
