"""Queries of text quality, tables, chunk ids and batches, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers
from ..functions import text as tx
from ..operators import chunking
from ..operators.numbering import numbered
from ..session import table

PAIRS = ", ".join(f"'{p}'" for p in tx.COMMON_PAIRS)
STRIP = r"^[\s\x{{85}}\p{{Z}}]+|[\s\x{{85}}\p{{Z}}]+$".replace("{{", "{").replace("}}", "}")


def _rate(letters: str) -> str:
    return f"case when length({letters}) < 20 then 0.0 else len(list_filter(range(1, length({letters})), lambda i: substr({letters}, i, 2) in ({PAIRS}))) / (length({letters}) - 1) end"


def _strip(s: str) -> str:
    return f"regexp_replace({s}, '{STRIP}', '', 'g')"


def _meaningful(text: str) -> str:
    row = f"list_sum(list_transform(string_split(regexp_replace(s, '^\\|+|\\|+$', '', 'g'), '|'), lambda c: length({_strip('c')})))"
    line = f"case when s = '' or regexp_matches(s, '^\\|[\\s\\-|]*\\|$') then 0 when starts_with(s, '|') and ends_with(s, '|') then {row} else length(s) end"
    lines = f"list_transform(string_split({text}, chr(10)), lambda l: {_strip('l')})"
    return f"cast(list_sum(list_transform({lines}, lambda s: {line})) as bigint)"


def q_bigram_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tm_chunks").select("chunk_id", F.round(tx.pair_rate(F.col("text")), 6).alias("rate"))


BIGRAM_SQL = f"with t as (select chunk_id, regexp_replace(lower(text), '[^a-z]', '', 'g') as x from tm_chunks) select chunk_id, round({_rate('x')}, 6) as rate from t"


def q_real_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return d.where(~tx.is_real_language(F.col("text"))).select("doc_id", F.round(tx.pair_rate(F.col("text")), 6).alias("rate"))


REAL_LANGUAGE_SQL = f"""
with t as (select doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') as x from documents where text is not null),
r as (select doc_id, {_rate('x')} as a, {_rate('reverse(x)')} as b from t)
select doc_id, round(a, 6) as rate from r where a < 0.08 and b >= 0.08 and b > 2 * a
"""


def q_meaningful_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tm_chunks").select("chunk_id", tx.meaningful_length(F.col("text")).cast("bigint").alias("meaningful"))


MEANINGFUL_SQL = f"select chunk_id, {_meaningful('text')} as meaningful from tm_chunks"


def q_nav_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tm_chunks").where(tx.is_navigational(F.col("text")))
    return t.groupBy("document_type").agg(F.count("*").alias("pages"))


NAV_SQL = f"select document_type, count(*) as pages from tm_chunks where regexp_matches(upper(left({_strip('text')}, 40)), '^(TABLE OF CONTENTS|INDEX)') group by 1"


def q_cover_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tm_chunks")
    return t.where(tx.is_cover(F.col("text"), F.col("page_number"), F.col("total_pages"))).select("chunk_id", "total_pages")


COVER_SQL = f"select chunk_id, total_pages from tm_chunks where page_number = 1 and total_pages > 20 and {_meaningful('text')} < 500"


def q_vision_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = chunking.vision_candidates(table(spark, sf_dir, "tm_chunks").select("chunk_id", "source_file", "page_number", "text"))
    return v.withColumn("meaningful", F.col("meaningful").cast("bigint"))


VISION_SQL = f"""
with p as (select source_file, page_number, arg_min(text, (case when regexp_matches(chunk_id, '-densetable\\d+$') then '1' else '0' end) || chunk_id) as text from tm_chunks group by 1, 2),
q as (select *, regexp_replace(lower(text), '[^a-z]', '', 'g') as x from p),
r as (select source_file, page_number, {_meaningful('text')} as meaningful, {_rate('x')} as a, {_rate('reverse(x)')} as b from q)
select source_file, page_number, meaningful from r where not (meaningful >= 200 and not (a < 0.08 and b >= 0.08 and b > 2 * a))
"""


def q_detect_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tm_chunks").select("chunk_id", tx.last_heading(F.col("text")).alias("section"))
    return t.where("section is not null")


SECTION_SQL = rf"""
with t as (select chunk_id, regexp_extract_all(text, '{tx.HEADING}', 1) as n, regexp_extract_all(text, '{tx.HEADING}', 2) as h from tm_chunks)
select chunk_id, n[-1] || ' ' || {_strip('h[-1]')} as section from t where len(n) > 0
"""


def q_markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.markdown_tables(table(spark, sf_dir, "tm_chunks").select("chunk_id", "text"))
    return rows.groupBy("chunk_id", "table_no").agg(F.max("row_no").cast("bigint").alias("data_rows"), F.sum(F.size("cells")).alias("cells"), F.sum(F.aggregate("cells", F.lit(0), lambda a, c: a + F.length(c))).alias("characters"))


MARKDOWN_SQL = rf"""
with l as (select chunk_id, unnest(range(len(x))) as line_no, x from (select chunk_id, string_split(text, chr(10)) as x from tm_chunks)),
s as (select chunk_id, line_no, {_strip('x[line_no + 1]')} as s from l),
t as (select * from s where starts_with(s, '|') and ends_with(s, '|') and length(s) >= 2),
i as (select *, line_no - row_number() over (partition by chunk_id order by line_no) as run from t),
n as (select *, row_number() over (partition by chunk_id, run order by line_no) - 1 as i from i),
ok as (select chunk_id, run from n where i = 1 and regexp_matches(s, '^\|[\s\-:|]+\|$')),
c as (select n.chunk_id, dense_rank() over (partition by n.chunk_id order by n.run) as table_no, case when i = 0 then 0 else i - 1 end as row_no,
  list_transform(string_split(regexp_replace(s, '^\|+|\|+$', '', 'g'), '|'), lambda c: {_strip('c')}) as cells
  from n join ok on n.chunk_id = ok.chunk_id and n.run = ok.run where i <> 1)
select chunk_id, cast(table_no as int) as table_no, cast(max(row_no) as bigint) as data_rows, cast(sum(len(cells)) as bigint) as cells, cast(sum(list_sum(list_transform(cells, lambda c: length(c)))) as bigint) as characters from c group by 1, 2
"""


def q_dense_table_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.markdown_tables(table(spark, sf_dir, "tm_chunks").select("chunk_id", "text"))
    g = chunking.dense_groups(rows)
    return g.select("chunk_id", "table_no", F.col("first_row").cast("bigint").alias("first_row"), F.col("last_row").cast("bigint").alias("last_row"), F.col("rows").cast("bigint").alias("rows"))


DENSE_SQL = f"""
with t as ({MARKDOWN_SQL}), g as (select chunk_id, table_no, data_rows, unnest(range(cast((data_rows + 5) // 6 as bigint))) as g from t where data_rows > 6)
select chunk_id, table_no, g * 6 + 1 as first_row, least(g * 6 + 6, data_rows) as last_row, data_rows as rows from g
"""


def q_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tm_chunks").select("chunk_id", "source_file", "page_number")
    made = F.concat(tx.chunk_stem(F.col("source_file")), F.lit("-p"), F.col("page_number").cast("string"))
    return t.select("chunk_id", made.alias("page_id"), F.col("chunk_id").startswith(made).alias("same"))


CHUNK_IDS_SQL = r"""
with t as (select chunk_id, regexp_replace(regexp_replace(source_file, '(?i)\.pdf$', ''), '[^A-Za-z0-9]+', '_', 'g') || '-p' || page_number as page_id from tm_chunks)
select chunk_id, page_id, starts_with(chunk_id, page_id) as same from t
"""


def q_filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tm_chunks").select("source_file").distinct()
    return t.select("source_file", *[c.alias(k) for k, c in tx.file_name_parts(F.col("source_file")).items()])


FILENAME_SQL = r"""
with f as (select distinct source_file, regexp_extract(source_file, '(?i)^([A-Za-z0-9]+)_([A-Za-z0-9]+)_([A-Za-z0-9]+)_([A-Za-z0-9]+)_(Rev[A-Za-z0-9]+)\.pdf$', ['a', 'b', 'c', 'd', 'e']) as x from tm_chunks)
select source_file, nullif(x.a, '') as system, nullif(x.b, '') as manufacturer, nullif(x.c, '') as model, nullif(x.d, '') as doc_code, nullif(x.e, '') as revision from f
"""


def q_image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.rendered_pages(table(spark, sf_dir, "chunks").select("source_file", "page_number", "text", "total_pages")).groupBy("source_file").agg(F.count("*").alias("pages"), F.max("page_number").alias("last_page"))


IMAGE_PAGES_SQL = f"""
with h as (select distinct source_file, page_number from chunks where length({_strip('text')}) > 0),
l as (select source_file, max(greatest(coalesce(total_pages, 0), page_number)) as last from chunks group by 1),
n as (select distinct source_file, unnest([page_number - 1, page_number, page_number + 1]) as page_number from h)
select n.source_file, count(*) as pages, max(page_number) as last_page from n join l on n.source_file = l.source_file where page_number between 1 and last group by 1
"""


def q_write_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = numbered(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"])
    b = d.withColumn("batch", ((F.col("row_no") - 1) / 100).cast("bigint"))
    return b.groupBy("batch").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum("n_chars").alias("characters"))


WRITE_BATCHES_SQL = """
with b as (select doc_id, n_chars, (row_number() over (order by doc_id) - 1) // 100 as batch from documents)
select batch, count(*) as rows, min(doc_id) as first_id, max(doc_id) as last_id, cast(sum(n_chars) as bigint) as characters from b group by 1
"""


def q_greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    b = chunking.greedy_batches(d, "doc_id", "size")
    return b.groupBy("batch").agg(F.count("*").alias("items"), F.sum("size").alias("characters"), F.min("doc_id").alias("first_id"))


GREEDY_SQL = """
with recursive d as materialized (select coalesce(length(text), 0) as size, doc_id, row_number() over (order by doc_id) as i from documents),
f as (select i, doc_id, size, 0 as batch, size as used, 1 as n from d where i = 1
  union all select d.i, d.doc_id, d.size, case when f.n >= 1000 or f.used + d.size > 250000 then f.batch + 1 else f.batch end,
  case when f.n >= 1000 or f.used + d.size > 250000 then d.size else f.used + d.size end, case when f.n >= 1000 or f.used + d.size > 250000 then 1 else f.n + 1 end
  from f join d on d.i = f.i + 1)
select cast(batch as bigint) as batch, count(*) as items, cast(sum(size) as bigint) as characters, min(doc_id) as first_id from f group by 1
"""


def q_dense_table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that long tables give besides their page: six rows each, with the head repeated."""
    t = table(spark, sf_dir, "tm_chunks").select("chunk_id", "text", "page_number")
    return chunking.dense_chunks(chunking.markdown_tables(t), t).select("chunk_id", "table_no", F.col("first_row").cast("bigint").alias("first_row"), "text")


DENSE_CHUNKS_SQL = rf"""
with {{rows}},
h as (select chunk_id, table_no, '| ' || array_to_string(cells, ' | ') || ' |' || chr(10) || '|' || array_to_string(list_transform(cells, lambda c: '---'), '|') || '|' as head from c where row_no = 0),
cnt as (select chunk_id, table_no, max(row_no) as rows from c group by 1, 2 having max(row_no) > 6),
g as (select chunk_id, table_no, (row_no - 1) // 6 as g, string_agg('| ' || array_to_string(cells, ' | ') || ' |', chr(10) order by row_no) as body, min(row_no) as a, max(row_no) as b from c where row_no > 0 group by 1, 2, 3)
select g.chunk_id, cast(g.table_no as int) as table_no, cast(a as bigint) as first_row, '(Table ' || g.table_no || ' on page ' || p.page_number || ', rows ' || a || '-' || b || ' of ' || rows || ')' || chr(10) || chr(10) || head || chr(10) || body as text
from g join cnt on g.chunk_id = cnt.chunk_id and g.table_no = cnt.table_no join h on g.chunk_id = h.chunk_id and g.table_no = h.table_no join tm_chunks p on p.chunk_id = g.chunk_id
""".replace("{{rows}}", MARKDOWN_SQL.split("select chunk_id, cast(table_no as int)")[0].strip().removeprefix("with ")).replace("{rows}", MARKDOWN_SQL.split("select chunk_id, cast(table_no as int)")[0].strip().removeprefix("with "))


def q_transcribed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with too little real text get what the backup has for them as a transcription: on the page's primary chunk,
    while the parts of its tables go."""
    t = table(spark, sf_dir, "tm_chunks").select("chunk_id", "source_file", "page_number", "text")
    pages = chunking.vision_candidates(t)
    told = table(spark, sf_dir, "chunks").groupBy("source_file", "page_number").agg(F.max("text").alias("text"))
    told = told.join(pages, ["source_file", "page_number"], "left_semi").select("source_file", "page_number", answers.transcript(F.col("text")).alias("transcript"))
    done = chunking.with_transcripts(t, told)
    return done.where(F.col("text").startswith(answers.TRANSCRIBED)).select("chunk_id", F.length("text").cast("bigint").alias("characters"))


TRANSCRIBED_SQL = f"""
with v as ({VISION_SQL}),
told as (select c.source_file, c.page_number, {_strip('max(c.text)')} as s from chunks c join v on v.source_file = c.source_file and v.page_number = c.page_number group by 1, 2),
p as (select source_file, page_number, arg_min(chunk_id, (case when regexp_matches(chunk_id, '-densetable\\d+$') then '1' else '0' end) || chunk_id) as chunk_id from tm_chunks group by 1, 2)
select p.chunk_id, length('{answers.TRANSCRIBED}') + 2 + length(s) as characters from p join told on p.source_file = told.source_file and p.page_number = told.page_number where s <> '' and s <> '{answers.NO_TEXT}'
"""


def q_document_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts of each drawing, put together in order, at most twenty pages a part."""
    t = table(spark, sf_dir, "tm_chunks").where(F.col("source_file").contains("_DWG_")).select("source_file", "page_number", "chunk_id", "text")
    return chunking.document_parts(t).select("source_file", "part", F.length("text").cast("bigint").alias("characters"), F.left("text", F.lit(40)).alias("head"))


DOCUMENT_PARTS_SQL = """
with p as (select source_file, (page_number - 1) // 20 as part, string_agg('--- Page ' || page_number || ' ---' || chr(10) || text, chr(10) || chr(10) order by page_number, chunk_id) as text from tm_chunks where contains(source_file, '_DWG_') group by 1, 2)
select source_file, cast(part as bigint) as part, cast(length(text) as bigint) as characters, left(text, 40) as head from p
"""


def q_garbled_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of 200 characters or more that read backwards, each once, with how many documents have it."""
    d = table(spark, sf_dir, "documents").where(F.length(F.trim("text")) >= 200)
    bad = d.where(~tx.is_real_language(F.col("text")))
    return bad.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id"))


GARBLED_SQL = f"""
with t as (select doc_id, text, regexp_replace(lower(text), '[^a-z]', '', 'g') as x from documents where length(trim(text)) >= 200),
r as (select doc_id, text, {_rate('x')} as a, {_rate('reverse(x)')} as b from t)
select sha256(text) as text_hash, count(*) as documents, min(doc_id) as first_id from r where a < 0.08 and b >= 0.08 and b > 2 * a group by 1
"""

# Two conversions of stated values.
PSI_KPA, NUMBER = 6.894757, r"(-?\d+(?:\.\d+)?)\s*"


def q_unit_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain psi and degree F values of each chunk with kPa and degree C beside them."""
    t = table(spark, sf_dir, "tm_chunks").select("chunk_id", "text")
    psi = t.select("chunk_id", F.lit("psi").alias("unit"), F.explode(F.regexp_extract_all("text", F.lit(r"(?i)\b(\d+(?:\.\d+)?)\s*psi\b"), F.lit(1))).alias("n")).withColumn("metric", F.round(F.col("n").cast("double") * PSI_KPA, 6))
    f = t.select("chunk_id", F.lit("F").alias("unit"), F.explode(F.regexp_extract_all("text", F.lit(r"\b(\d+(?:\.\d+)?)\s*°\s*F\b"), F.lit(1))).alias("n")).withColumn("metric", F.round((F.col("n").cast("double") - 32) * 5 / 9, 6))
    return psi.unionByName(f).groupBy("chunk_id", "unit").agg(F.count("*").alias("values"), F.round(F.max("metric"), 3).alias("highest"))


UNIT_NUMBERS_SQL = rf"""
with v as (select chunk_id, 'psi' as unit, unnest(regexp_extract_all(text, '(?i)\b(\d+(?:\.\d+)?)\s*psi\b', 1)) as n from tm_chunks
 union all select chunk_id, 'F', unnest(regexp_extract_all(text, '\b(\d+(?:\.\d+)?)\s*°\s*F\b', 1)) from tm_chunks)
select chunk_id, unit, count(*) as values, round(max(round(case when unit = 'psi' then cast(n as double) * {PSI_KPA} else (cast(n as double) - 32) * 5 / 9 end, 6)), 3) as highest from v group by 1, 2
"""

QUERIES = {f.__name__: f for f in (q_bigram_rate, q_real_language, q_meaningful_length, q_nav_pages, q_cover_pages, q_vision_candidates, q_detect_section, q_markdown_tables, q_dense_table_split, q_chunk_ids, q_filename_parse, q_image_pages, q_write_batches, q_greedy_batches, q_dense_table_chunks, q_transcribed_pages, q_document_parts, q_garbled_audit, q_unit_numbers)}
ORACLE_SQL = {"q_bigram_rate": BIGRAM_SQL, "q_real_language": REAL_LANGUAGE_SQL, "q_meaningful_length": MEANINGFUL_SQL, "q_nav_pages": NAV_SQL, "q_cover_pages": COVER_SQL, "q_vision_candidates": VISION_SQL, "q_detect_section": SECTION_SQL, "q_markdown_tables": MARKDOWN_SQL, "q_dense_table_split": DENSE_SQL, "q_chunk_ids": CHUNK_IDS_SQL, "q_filename_parse": FILENAME_SQL, "q_image_pages": IMAGE_PAGES_SQL, "q_write_batches": WRITE_BATCHES_SQL, "q_greedy_batches": GREEDY_SQL, "q_dense_table_chunks": DENSE_CHUNKS_SQL, "q_transcribed_pages": TRANSCRIBED_SQL, "q_document_parts": DOCUMENT_PARTS_SQL, "q_garbled_audit": GARBLED_SQL, "q_unit_numbers": UNIT_NUMBERS_SQL}
