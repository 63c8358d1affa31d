"""Tables of the session catalog: created if absent, widened if a column is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered

# Columns of the stored relations.
SCHEMAS = {
    "tm_chunks": "chunk_id string, text string, embedding array<float>, document_title string, revision string, page_number int, total_pages int, equipment_model string, document_type string, source_file string, page_image_url string",
    "messages": "id bigint, conversation_id string, user_name string, role string, content string, chunks array<struct<text: string, metadata: struct<document_title: string, revision: string, page_number: int, total_pages: int, equipment_model: string, document_type: string, source_file: string, page_image_url: string>, distance: double>>, feedback string, safety_info string, field_notes_used array<struct<id: bigint, category: string, position: string, author: string>>, show_document_images array<struct<url: string, document_title: string, page_number: int>>, created_at timestamp",
    "engineer_notes": "id bigint, category string, position string, author string, author_role string, note_text string, created_at timestamp",
    "vessel_equipment": "id bigint, vessel string, system string, category string, position string, manufacturer string, model string, serial_number string, specs map<string, string>, notes string, source_document string, source_page int, updated_at timestamp",
}


def ensure_tables(spark: SparkSession, names: list[str] | None = None) -> list[str]:
    """Create what is absent; returns the names created. Running it again changes nothing."""
    made = []
    for name in names or SCHEMAS:
        if not spark.catalog.tableExists(name):
            spark.sql(f"create table if not exists {name} ({SCHEMAS[name]}) using parquet")
            made.append(name)
    return made


def widened(df: DataFrame, name: str) -> DataFrame:
    """df with every column of the relation, missing ones null, in the relation's order; others are left out."""
    fields = df.sparkSession.createDataFrame([], SCHEMAS[name]).schema.fields
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def reprocessed(store: DataFrame, backup: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(store, backup, report) with all rows of the named files taken out so that they are read again. names has
    source_file; the report says 'removed' with the rows, or 'unknown'."""
    n = names.select("source_file").distinct()
    counts = store.join(n, "source_file", "left_semi").groupBy("source_file").agg(F.count("*").alias("rows"))
    report = n.join(counts, "source_file", "left").select("source_file", F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.col("rows").isNull(), "unknown").otherwise("removed").alias("status"))
    return store.join(n, "source_file", "left_anti"), backup.join(n, "source_file", "left_anti"), report


def appended(store: DataFrame, new: DataFrame, order: list[str], as_json: list[str]) -> DataFrame:
    """The rows to append: new with the ids behind the store's highest, in ``order``, and the given columns as JSON; what is
    null stays null. new must not have the column id."""
    highest = store.agg(F.coalesce(F.max("id"), F.lit(0)).alias("highest"))  # one row
    rows = numbered(new, order, "_no").join(F.broadcast(highest))
    return rows.select((F.col("highest") + F.col("_no")).alias("id"), *[F.to_json(c).alias(c) if c in as_json else F.col(c) for c in new.columns])
