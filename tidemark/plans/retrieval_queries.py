"""Queries of search and ranking, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import history, retrieval
from ..operators.numbering import numbered
from ..session import table, written

CHUNK_COLUMNS = ("chunk_id", "text", "document_title", "page_number")


def q_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    top = retrieval.vector_topk(e, queries, 5)
    return top.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), (F.round("distance", 6) + 0.0).alias("distance"))


VECTOR_TOPK_SQL = """
with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 50 = 0),
c as (select vec_id, embedding::double[] as v from embeddings),
s as (select query_id, vec_id, 1 - list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) as d
      from q, c where list_dot_product(q.v, q.v) > 0 and list_dot_product(c.v, c.v) > 0),
r as (select *, row_number() over (partition by query_id order by round(d, 12), vec_id) as rank from s)
select query_id, vec_id, rank, round(d, 6) + 0.0 as distance from r where rank <= 5
"""


def q_zero_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance of the chunks of each type to the first axis; chunks without a direction get none."""
    t = table(spark, sf_dir, "tm_chunks").select("chunk_id", "document_type", "embedding")
    first = F.array(*[F.lit(1.0) if i == 0 else F.lit(0.0) for i in range(8)])
    d = t.withColumn("d", tx.cosine_distance(F.col("embedding"), first))
    return d.groupBy("document_type").agg(F.count("*").alias("chunks"), F.sum(F.when(F.col("d").isNull(), 1).otherwise(0)).alias("without_direction"), F.round(F.avg("d"), 6).alias("mean_distance"))


ZERO_VECTORS_SQL = """
with t as (select document_type, embedding::double[] as v from tm_chunks),
d as (select document_type, case when list_dot_product(v, v) > 0 then 1 - v[1] / sqrt(list_dot_product(v, v)) end as d from t)
select document_type, count(*) as chunks, cast(sum(case when d is null then 1 else 0 end) as bigint) as without_direction, round(avg(d), 6) as mean_distance from d group by 1
"""


def q_title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tm_chunks").select("chunk_id", "document_title", "page_number")
    title = t.groupBy("document_title").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "document_title").limit(1)
    return t.join(F.broadcast(title.select("document_title")), "document_title").orderBy(F.col("page_number").asc_nulls_last(), "chunk_id").limit(8).select("chunk_id", "document_title", "page_number")


TITLE_LOOKUP_SQL = """
with top as (select document_title, count(*) as n from tm_chunks group by 1 order by n desc, document_title limit 1)
select chunk_id, t.document_title, page_number from tm_chunks t join top on t.document_title = top.document_title order by page_number nulls last, chunk_id limit 8
"""


def q_title_first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("document_title").orderBy(F.col("page_number").asc_nulls_last(), "chunk_id")
    t = table(spark, sf_dir, "tm_chunks").select("chunk_id", "document_title", "page_number")
    return t.withColumn("rank", F.row_number().over(w)).where("rank <= 3").withColumn("rank", F.col("rank").cast("bigint"))


TITLE_FIRST_PAGES_SQL = """
select chunk_id, document_title, page_number, rank from
(select chunk_id, document_title, page_number, row_number() over (partition by document_title order by page_number nulls last, chunk_id) as rank from tm_chunks) where rank <= 3
"""


def q_code_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tm_chunks").select("chunk_id", "text")
    return t.select("chunk_id", F.explode(tx.code_terms(F.col("text"))).alias("term"))


CODE_TERMS_SQL = r"""
select distinct chunk_id, regexp_replace(term, '\s*-\s*', '-', 'g') as term from
(select chunk_id, unnest(regexp_extract_all(text, '\b(\d{2,5}\s*-\s*\d{1,4}|[A-Za-z]{1,4}-\d{1,5})\b')) as term from tm_chunks)
"""


def q_code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "equipment_catalog").select(F.explode(tx.code_terms(F.col("model"))).alias("term"))
    hits = retrieval.code_search(table(spark, sf_dir, "tm_chunks").select(*CHUNK_COLUMNS), terms)
    return hits.select("term", "chunk_id", "document_title", "page_number", F.col("rank").cast("bigint").alias("rank"))


CODE_SEARCH_SQL = r"""
with t as (select distinct regexp_replace(term, '\s*-\s*', '-', 'g') as term from
  (select unnest(regexp_extract_all(model, '\b(\d{2,5}\s*-\s*\d{1,4}|[A-Za-z]{1,4}-\d{1,5})\b')) as term from equipment_catalog)),
c as (select chunk_id, document_title, page_number, lower(regexp_replace(text, '\s*-\s*', '-', 'g')) as x from tm_chunks),
h as (select distinct term, chunk_id, document_title, page_number from c join t on contains(c.x, lower(t.term)) where length(term) >= 3)
select * from (select *, row_number() over (partition by term order by document_title, page_number, chunk_id) as rank from h) where rank <= 20
"""

# What makes a question one about shutting something off, and words that say nothing about what.
TRIGGER = r"(?i)\b(isolat\w*|lock\s*out|lockout|tag\s*out|tagout|LOTO|shut\s+(off|down)|de-?energi\w*|depressuriz\w*|disconnect\w*)\b"
GENERIC = tuple("""what which would should could need needs needed work working system systems engine engines pump pumps valve
valves with this that these those isolate isolated isolation before while there their""".split())
# Titles of drawings that list equipment.
DRAWING_TITLE = r"(?i)^GeneralArrangement - |MachineryArrangement|EquipmentArrgt"
DRAWINGS = ("General Arrangement Drawing", "Wiring Diagram")


def q_drawing_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings whose title holds a keyword of a question about isolation, at most 20 for each keyword."""
    m = table(spark, sf_dir, "messages").where(F.col("content").rlike(TRIGGER)).select("content")
    words = m.select(F.explode(F.regexp_extract_all(F.lower("content"), F.lit("([a-z]{4,})"), F.lit(1))).alias("keyword")).distinct()
    words = words.where(~F.col("keyword").isin(*GENERIC))
    titles = table(spark, sf_dir, "tm_chunks").where(F.col("document_type").isin(*DRAWINGS)).select("document_title").distinct()
    # a keyword has letters only, so it stands inside a run of letters: distinct runs meet keywords on three letters
    runs = titles.select("document_title", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("document_title"), F.lit("([a-z]{4,})"), F.lit(1)))).alias("run"))
    laid = runs.select("run").distinct().select("run", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("run") - 2), lambda i: F.substr(F.col("run"), i, F.lit(3))))).alias("piece"))
    hits = words.withColumn("piece", F.left("keyword", F.lit(3))).join(laid, "piece").where(F.contains("run", "keyword")).select("keyword", "run").distinct()
    found = hits.join(runs, "run").select("keyword", "document_title").distinct()
    w = Window.partitionBy("keyword").orderBy("document_title")
    return found.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 20")


DRAWING_KEYWORDS_SQL = rf"""
with m as (select content from messages where regexp_matches(content, '{TRIGGER}')),
w as (select distinct k as keyword from (select unnest(regexp_extract_all(lower(content), '[a-z]{{4,}}')) as k from m) where k not in ({", ".join(f"'{g}'" for g in GENERIC)})),
t as (select distinct document_title from tm_chunks where document_type in ({", ".join(f"'{d}'" for d in DRAWINGS)})),
h as (select keyword, document_title from w join t on contains(lower(document_title), keyword))
select * from (select *, row_number() over (partition by keyword order by document_title) as rank from h) where rank <= 20
"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "messages").where("chunks is not null").groupBy("id").agg(F.min_by("chunks", history.earliest()).alias("chunks"))
    h = m.select("id", F.posexplode("chunks").alias("pos", "c"))
    return h.select("id", "pos", F.col("c.metadata.document_title").alias("document_title"), F.col("c.metadata.page_number").alias("page_number"), F.col("c.text").alias("text"), F.col("c.distance").alias("distance"), F.col("c.metadata.revision").alias("revision"), F.col("c.metadata.total_pages").alias("total_pages"))


def q_stored_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored hits of every answer in their final order."""
    d = retrieval.finalize_hits(_hits(spark, sf_dir), "id")
    return d.select(F.col("id").alias("message_id"), F.col("final_rank").cast("bigint").alias("final_rank"), "document_title", "page_number", F.round("distance", 6).alias("distance"))


HITS_SQL = """
m as (select id, any_value(chunks) as chunks from messages where chunks is not null group by id),
u as (select id, unnest(range(len(chunks))) as pos, chunks from m),
h as (select id, pos, chunks[pos + 1].metadata.document_title as document_title, chunks[pos + 1].metadata.page_number as page_number, chunks[pos + 1].text as text,
      chunks[pos + 1].distance as distance, chunks[pos + 1].metadata.revision as revision, chunks[pos + 1].metadata.total_pages as total_pages from u)"""

STORED_HITS_SQL = f"""
with {HITS_SQL},
d as (select * from (select *, row_number() over (partition by id, document_title, page_number, left(text, 80) order by pos) as n from h) where n = 1),
r as (select *, row_number() over (partition by id order by distance, pos) as rank from d),
p as (select id, document_title, page_number, case when page_number - lag(page_number) over (partition by id, document_title order by page_number) <= 1 then 0 else 1 end as new
      from (select distinct id, document_title, page_number from r)),
s as (select *, sum(new) over (partition by id, document_title order by page_number rows unbounded preceding) as run from p),
j as (select r.*, s.run from r left join s on r.id = s.id and r.document_title = s.document_title and r.page_number = s.page_number),
g as (select id, document_title, run, count(distinct page_number) as pages, min(rank) as best from j group by 1, 2, 3),
f as (select j.*, coalesce(g.pages >= 2, false) as in_run, case when g.pages >= 2 then g.best else j.rank end as anchor from j left join g on j.id = g.id and j.document_title = g.document_title and j.run = g.run)
select id as message_id, row_number() over (partition by id order by anchor, case when in_run then page_number else 0 end, rank) as final_rank, document_title, page_number, round(distance, 6) as distance from f
"""


# What makes a question one to be shown a document, and how many hits the arms hold.
SHOW = r"(?i)\b(show\s+me|can\s+I\s+see|let\s+me\s+see|display|view|picture\s+of|what\s+does\s+.+\s+look\s+like|pull\s+up)\b"
TOP_K, TITLE_K, EXACT = 10, 8, -1.0


def q_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth chunk as a question to all chunks: the nearest vectors, then chunks with its codes, then drawings with
    its words in their names, each fingerprint once, in final order. A question to be shown a title gets that title only."""
    t = table(spark, sf_dir, "tm_chunks")
    rows = written(numbered(t.select("chunk_id", "embedding"), ["chunk_id"]), "hybrid-rows")
    asked = rows.where("row_no % 50 = 0").select(F.col("row_no").alias("query_id"), "chunk_id", "embedding")
    questions = written(asked.select("query_id", "chunk_id").join(t.select("chunk_id", "text"), "chunk_id").select("query_id", "text"), "hybrid-questions")
    pages = t.select("chunk_id", "document_title", "page_number", F.left("text", F.lit(80)).alias("text"))

    titled = written(retrieval.title_hits(t, questions.where(F.col("text").rlike(SHOW)), TITLE_K), "hybrid-titles")
    open_ = questions.join(titled.select("query_id").distinct(), "query_id", "left_anti")
    near = retrieval.vector_topk(rows.select(F.col("row_no").alias("vec_id"), "embedding"), asked.join(titled.select("query_id").distinct(), "query_id", "left_anti"), TOP_K)
    near = near.join(rows.select(F.col("row_no").alias("vec_id"), "chunk_id"), "vec_id").select("query_id", "chunk_id", F.col("rank").alias("pos"), "distance")

    terms = open_.select("query_id", F.posexplode(tx.code_terms(F.col("text"))).alias("no", "term"))
    coded = retrieval.code_search(t.select(*CHUNK_COLUMNS), terms.select("term")).select("term", "chunk_id", "rank")
    coded = terms.join(coded, "term").groupBy("query_id", "chunk_id").agg((F.min(F.struct("no", "rank"))).alias("at"))

    words = open_.where(F.col("text").rlike(TRIGGER)).select("query_id", F.posexplode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1)))).alias("no", "keyword")).where(~F.col("keyword").isin(*GENERIC))
    drawings = t.where(F.col("document_type").isin(*DRAWINGS)).select("chunk_id", "document_title", "source_file", "page_number")
    drawn = words.join(retrieval.drawing_hits(drawings, words), "keyword").groupBy("query_id", "chunk_id").agg((F.min(F.struct("no", "rank"))).alias("at"))

    by_place = Window.partitionBy("query_id").orderBy("at", "chunk_id")
    boosts = [d.select("query_id", "chunk_id", F.row_number().over(by_place).alias("pos"), F.lit(EXACT).alias("distance")) for d in (coded, drawn)]
    # the title's pages stand in the first arm: such a question has no others
    shown = titled.select("query_id", "chunk_id", F.col("rank").alias("pos"), F.lit(0.0).alias("distance"))
    arms = [written(d.join(pages, "chunk_id"), "hybrid-arm") for d in (near.unionByName(shown), *boosts)]
    d = retrieval.finalize_hits(retrieval.ranked_union(arms, "query_id"), "query_id")
    return d.select("query_id", F.col("final_rank").cast("bigint").alias("final_rank"), "arm", "chunk_id", "document_title", "page_number", F.round("distance", 6).alias("distance"))


# "arm" 0 is the nearest vectors, or the title's pages; 1 the codes; 2 the drawings.
HYBRID_SQL = rf"""
with t as (select *, row_number() over (order by chunk_id) as row_no, embedding::double[] as v from tm_chunks),
q as (select row_no as query_id, text, v from t where row_no % 50 = 0),
named as (select query_id, min(document_title) as document_title from q join (select distinct document_title from tm_chunks) on contains(lower(q.text), lower(document_title)) where regexp_matches(q.text, '{SHOW}') and length(document_title) >= 3 group by 1),
shown as (select query_id, chunk_id, 0 as arm, pos, cast(0 as double) as distance from
  (select query_id, chunk_id, row_number() over (partition by query_id order by page_number nulls last, chunk_id) as pos from named join t using (document_title)) where pos <= {TITLE_K}),
o as (select * from q where query_id not in (select query_id from named)),
s as (select query_id, chunk_id, row_no, 1 - list_dot_product(o.v, t.v) / (sqrt(list_dot_product(o.v, o.v)) * sqrt(list_dot_product(t.v, t.v))) as d
      from o, t where list_dot_product(o.v, o.v) > 0 and list_dot_product(t.v, t.v) > 0),
near as (select query_id, chunk_id, 0 as arm, pos, round(d, 12) as distance from (select *, row_number() over (partition by query_id order by round(d, 12), row_no) as pos from s) where pos <= {TOP_K}),
terms as (select query_id, term, min(no) as no from (select query_id, regexp_replace(unnest(c), '\s*-\s*', '-', 'g') as term, unnest(range(len(c))) as no from
  (select query_id, regexp_extract_all(text, '\b(\d{{2,5}}\s*-\s*\d{{1,4}}|[A-Za-z]{{1,4}}-\d{{1,5}})\b') as c from o)) where length(term) >= 3 group by 1, 2),
hits as (select term, chunk_id, row_number() over (partition by term order by document_title, page_number, chunk_id) as rank from
  (select distinct term from terms) join (select *, lower(regexp_replace(text, '\s*-\s*', '-', 'g')) as x from tm_chunks) on contains(x, lower(term))),
coded as (select query_id, chunk_id, 1 as arm, row_number() over (partition by query_id order by place, chunk_id) as pos, cast({EXACT} as double) as distance from
  (select query_id, chunk_id, min(no * 1000 + rank) as place from terms join hits using (term) where rank <= 20 group by 1, 2)),
words as (select query_id, keyword, min(no) as no from (select query_id, unnest(c) as keyword, unnest(range(len(c))) as no from
  (select query_id, regexp_extract_all(lower(text), '[a-z]{{4,}}') as c from o where regexp_matches(text, '{TRIGGER}'))) where keyword not in ({", ".join(f"'{g}'" for g in GENERIC)}) group by 1, 2),
plans as (select keyword, chunk_id, row_number() over (partition by keyword order by document_title, page_number, chunk_id) as rank from
  (select distinct keyword from words) join tm_chunks on document_type in ({", ".join(f"'{d}'" for d in DRAWINGS)}) and (contains(lower(document_title), keyword) or contains(lower(source_file), keyword))),
drawn as (select query_id, chunk_id, 2 as arm, row_number() over (partition by query_id order by place, chunk_id) as pos, cast({EXACT} as double) as distance from
  (select query_id, chunk_id, min(no * 1000 + rank) as place from words join plans using (keyword) where rank <= 20 group by 1, 2)),
u as (select * from shown union all select * from near union all select * from coded union all select * from drawn),
h as (select query_id as id, chunk_id, arm, row_number() over (partition by query_id order by arm, pos) as pos, document_title, page_number, text, distance from u join tm_chunks using (chunk_id)),
d as (select * from (select *, row_number() over (partition by id, document_title, page_number, left(text, 80) order by pos) as n from h) where n = 1),
r as (select *, row_number() over (partition by id order by distance, pos) as rank from d),
p as (select id, document_title, page_number, case when page_number - lag(page_number) over (partition by id, document_title order by page_number) <= 1 then 0 else 1 end as new
      from (select distinct id, document_title, page_number from r)),
i as (select *, sum(new) over (partition by id, document_title order by page_number rows unbounded preceding) as run from p),
j as (select r.*, i.run from r left join i on r.id = i.id and r.document_title = i.document_title and r.page_number = i.page_number),
g as (select id, document_title, run, count(distinct page_number) as pages, min(rank) as best from j group by 1, 2, 3),
f as (select j.*, coalesce(g.pages >= 2, false) as in_run, case when g.pages >= 2 then g.best else j.rank end as anchor from j left join g on j.id = g.id and j.document_title = g.document_title and j.run = g.run)
select id as query_id, row_number() over (partition by id order by anchor, case when in_run then page_number else 0 end, rank) as final_rank, arm, chunk_id, document_title, page_number, round(distance, 6) as distance from f
"""


def q_format_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation lines of each answer: each title, revision and page once, in order of the hits."""
    h = _hits(spark, sf_dir)
    h = h.groupBy("id", "document_title", "revision", "page_number", "total_pages").agg(F.min("pos").alias("pos"))
    page = F.when(F.col("total_pages") > 0, F.concat(F.lit("p. "), F.col("page_number").cast("string"), F.lit(" of "), F.col("total_pages").cast("string"))).otherwise(F.concat(F.lit("p. "), F.col("page_number").cast("string")))
    line = F.concat_ws(", ", "document_title", "revision", page)
    first = Window.partitionBy("id", "document_title", "revision", "page_number").orderBy("pos")
    h = h.withColumn("n", F.row_number().over(first)).where("n = 1")
    no = Window.partitionBy("id").orderBy("pos")
    return h.select(F.col("id").alias("message_id"), F.row_number().over(no).cast("bigint").alias("line_no"), line.alias("line"))


FORMAT_SOURCES_SQL = f"""
with {HITS_SQL},
d as (select * from (select *, row_number() over (partition by id, document_title, revision, page_number order by pos) as n from h) where n = 1)
select id as message_id, row_number() over (partition by id order by pos) as line_no,
 concat_ws(', ', document_title, revision, case when total_pages > 0 then 'p. ' || page_number || ' of ' || total_pages else 'p. ' || page_number end) as line from d
"""


def q_page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.page_runs(table(spark, sf_dir, "tm_chunks"))


PAGE_RUNS_SQL = """
with p as (select distinct document_title, page_number from tm_chunks where page_number is not null),
i as (select *, page_number - row_number() over (partition by document_title order by page_number) as island from p)
select document_title, min(page_number) as first_page, max(page_number) as last_page, count(*) as pages from i group by document_title, island having count(*) >= 2
"""


def q_dedupe_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.merging import first_per_fingerprint

    t = table(spark, sf_dir, "tm_chunks").select("chunk_id", "document_title", "page_number", "text")
    return first_per_fingerprint(t, "chunk_id").select("chunk_id")


DEDUPE_SQL = "select min(chunk_id) as chunk_id from tm_chunks group by document_title, page_number, left(text, 80)"

QUESTION = "why does the relief valve leak oil at the cylinder head"


def q_tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.tfidf_topk(table(spark, sf_dir, "documents").select("doc_id", "text"), QUESTION, 10)


def q_show_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, and the panel's question for every document's title, that ask to be shown a document: the title each of
    them names, with how many do."""
    m = table(spark, sf_dir, "messages").where("content is not null").groupBy("id").agg(F.min("content").alias("text"))
    panel = table(spark, sf_dir, "documents").where("document_title is not null").select((-F.col("doc_id") - 1).alias("query_id"), F.concat(F.lit("Can I see the "), "document_title", F.lit("?")).alias("text"))
    asked = m.select(F.col("id").alias("query_id"), "text").unionByName(panel)
    named = retrieval.named_titles(table(spark, sf_dir, "tm_chunks"), asked.where(F.col("text").rlike(SHOW)))
    return named.groupBy("document_title").agg(F.count("*").alias("questions"), F.min("query_id").alias("first_id"))


SHOW_REQUESTS_SQL = rf"""
with a as (select id as q, min(content) as x from messages where content is not null group by 1 union all select -doc_id - 1, 'Can I see the ' || document_title || '?' from documents where document_title is not null),
n as (select q, min(t.document_title) as document_title from a join (select distinct document_title from tm_chunks where length(document_title) >= 3) t on contains(lower(a.x), lower(t.document_title)) where regexp_matches(a.x, '{SHOW}') group by 1)
select document_title, count(*) as questions, min(q) as first_id from n group by 1
"""


def q_drawing_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of drawings that list equipment, as they would be written without spaces round the words."""
    t = table(spark, sf_dir, "tm_chunks").select("document_title", "document_type").distinct()
    t = t.withColumn("full_title", F.concat(F.replace("document_type", F.lit(" Drawing"), F.lit("")), F.lit(" - "), "document_title")).withColumn("full_title", F.regexp_replace("full_title", "General Arrangement", "GeneralArrangement"))
    return t.where(F.col("full_title").rlike(DRAWING_TITLE)).select("full_title")


DRAWING_TITLES_SQL = rf"""
with t as (select distinct document_title, document_type from tm_chunks), f as (select replace(replace(document_type, ' Drawing', '') || ' - ' || document_title, 'General Arrangement', 'GeneralArrangement') as full_title from t)
select full_title from f where regexp_matches(full_title, '{DRAWING_TITLE}')
"""


def q_inspect_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tm_chunks")
    return t.where(F.col("document_title").ilike("%steering%parts list%")).select("chunk_id", "page_number", F.length("text").cast("bigint").alias("characters"))


INSPECT_SQL = "select chunk_id, page_number, cast(length(text) as bigint) as characters from tm_chunks where document_title ilike '%steering%parts list%'"

QUERIES = {f.__name__: f for f in (q_vector_topk, q_zero_vectors, q_title_lookup, q_title_first_pages, q_code_terms, q_code_search, q_drawing_keywords, q_hybrid_search, q_stored_hits, q_format_sources, q_page_runs, q_dedupe_fingerprint, q_tfidf_topk, q_show_requests, q_drawing_titles, q_inspect_page)}
ORACLE_SQL = {
    "q_vector_topk": VECTOR_TOPK_SQL,
    "q_zero_vectors": ZERO_VECTORS_SQL,
    "q_title_lookup": TITLE_LOOKUP_SQL,
    "q_title_first_pages": TITLE_FIRST_PAGES_SQL,
    "q_code_terms": CODE_TERMS_SQL,
    "q_code_search": CODE_SEARCH_SQL,
    "q_drawing_keywords": DRAWING_KEYWORDS_SQL,
    "q_hybrid_search": HYBRID_SQL,
    "q_stored_hits": STORED_HITS_SQL,
    "q_format_sources": FORMAT_SOURCES_SQL,
    "q_page_runs": PAGE_RUNS_SQL,
    "q_dedupe_fingerprint": DEDUPE_SQL,
    "q_show_requests": SHOW_REQUESTS_SQL,
    "q_drawing_titles": DRAWING_TITLES_SQL,
    "q_inspect_page": INSPECT_SQL,
}
