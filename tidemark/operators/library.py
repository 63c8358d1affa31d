"""Library analytics: documents, coverage of equipment by documents, registry reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

LEAST_MODEL = 3


def system_of(title: Column) -> Column:
    s = tx.strip(F.split(title, " - ")[0])
    return F.when(F.coalesce(s, F.lit("")) == "", "Unknown").otherwise(s)


def documents_of(chunks: DataFrame) -> DataFrame:
    """One row per document and revision with its number of chunks."""
    return chunks.groupBy("document_title", "document_type", "revision", "equipment_model").agg(F.count("*").alias("chunk_count"))


def document_class(kind: Column) -> Column:
    return F.when(kind.isin("General Arrangement Drawing", "Wiring Diagram"), "drawing").when(kind.isin("O&M Manual", "Service Manual"), "manual").otherwise("other")


def dedupe_items(items: DataFrame) -> DataFrame:
    """(item_key, first_id, manufacturer, model, documents): equipment named several times, once: by maker and model if
    the model says enough, else by document and category. The lowest id is kept, with the number of source documents."""
    m, n = tx.normalized(F.col("manufacturer")), tx.normalized(F.col("model"))
    key = F.when(F.length(n) >= LEAST_MODEL, F.concat_ws("|", m, n)).otherwise(F.concat_ws("|", F.lit("?"), F.coalesce("source_document", F.lit("")), F.coalesce("category", F.lit(""))))
    t = items.withColumn("item_key", key)
    g = t.groupBy("item_key").agg(F.min_by(F.struct("id", "manufacturer", "model"), "id").alias("f"), F.count_distinct("source_document").alias("documents"), F.count("*").alias("mentions"))
    return g.select("item_key", F.col("f.id").alias("first_id"), F.col("f.manufacturer").alias("manufacturer"), F.col("f.model").alias("model"), "documents", "mentions")


def item_sources(items: DataFrame) -> DataFrame:
    """(item_key, source_document, first_id, mentions, is_first): where each piece of equipment was seen, one row for each
    document, so that no list of them is ever put together. is_first marks the document whose row was kept."""
    m, n = tx.normalized(F.col("manufacturer")), tx.normalized(F.col("model"))
    key = F.when(F.length(n) >= LEAST_MODEL, F.concat_ws("|", m, n)).otherwise(F.concat_ws("|", F.lit("?"), F.coalesce("source_document", F.lit("")), F.coalesce("category", F.lit(""))))
    g = items.where("source_document is not null").withColumn("item_key", key).groupBy("item_key", "source_document").agg(F.min("id").alias("first_id"), F.count("*").alias("mentions"))
    first = items.withColumn("item_key", key).groupBy("item_key").agg(F.min("id").alias("kept"))
    return g.join(first, "item_key").select("item_key", "source_document", "first_id", "mentions", (F.col("first_id") == F.col("kept")).alias("is_first"))


def first_containing(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(needle, label): for each needle the first label whose hay contains it. needles(needle) of three characters or
    more; hay(hay, label).

    A needle can only be inside a hay that has its first three characters, so the two meet on these: the distinct hays are
    laid out by their three-character pieces and joined by equality, then tested. A common piece makes its needles meet
    more hays, never all with all."""
    h = hay.select("hay").distinct().where(F.length("hay") >= LEAST_MODEL)
    piece = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("hay") - 2), lambda i: F.substr(F.col("hay"), i, F.lit(3)))))
    laid = h.select("hay", piece.alias("piece"))
    n = needles.select("needle").distinct().where(F.length("needle") >= LEAST_MODEL).withColumn("piece", F.left("needle", F.lit(3)))
    met = n.join(laid, "piece").where(F.contains("hay", "needle")).select("needle", "hay")
    return met.join(hay.groupBy("hay").agg(F.min("label").alias("label")), "hay").groupBy("needle").agg(F.min("label").alias("label"))


def gap_report(items: DataFrame, registry: DataFrame, inventory: DataFrame) -> DataFrame:
    """items(item_id, model, system) against registry(model) and inventory(document_title, equipment_model): 'unknown' if
    the model says too little, 'covered' if a document names it (the first title), else 'gap', with whether the registry
    knows it (either name contains the other)."""
    t = items.withColumn("needle", tx.normalized(F.col("model")))
    inv = inventory.select(F.concat(tx.normalized(F.col("document_title")), tx.normalized(F.col("equipment_model"))).alias("hay"), F.col("document_title").alias("label")).distinct()
    needles = t.select("needle").distinct()
    covered = first_containing(needles, inv).withColumnRenamed("label", "matched_document")
    reg = registry.select(tx.normalized(F.col("model")).alias("hay")).where("hay <> ''").distinct().withColumn("label", F.col("hay"))
    inside = first_containing(needles, reg).select("needle")
    # the other way round: a registry name inside the item's name
    around = first_containing(reg.select(F.col("hay").alias("needle")), needles.select(F.col("needle").alias("hay"), F.col("needle").alias("label")))
    # first_containing keeps one label per needle; here every item that contains some registry name counts
    laid = needles.where(F.length("needle") >= LEAST_MODEL).select("needle", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("needle") - 2), lambda i: F.substr(F.col("needle"), i, F.lit(3))))).alias("piece"))
    names = around.select(F.col("needle").alias("name")).distinct().withColumn("piece", F.left("name", F.lit(3)))
    contains = laid.join(names, "piece").where(F.contains("needle", "name")).select("needle")
    known = inside.unionByName(contains).distinct().withColumn("in_registry", F.lit(True))
    out = t.join(covered, "needle", "left").join(known, "needle", "left")
    status = F.when(F.length("needle") < LEAST_MODEL, "unknown").when(F.col("matched_document").isNotNull(), "covered").otherwise("gap")
    return out.select("item_id", "system", "model", status.alias("status"), "matched_document", F.when(status == "gap", F.coalesce("in_registry", F.lit(False))).alias("in_registry"))


def gap_summary(report: DataFrame, shown: int = 3) -> DataFrame:
    """(system, covered, gaps, pct, first_gaps): coverage by system; the first gap models in order, with how many more.
    Only the first ``shown`` models of a system are ever gathered."""
    sums = report.where("status in ('covered', 'gap')").groupBy("system").agg(F.sum(F.when(F.col("status") == "covered", 1).otherwise(0)).alias("covered"), F.sum(F.when(F.col("status") == "gap", 1).otherwise(0)).alias("gaps"))
    models = report.where("status = 'gap'").select("system", "model").distinct()
    w = Window.partitionBy("system").orderBy("model")
    counts = models.groupBy("system").agg(F.count("*").alias("gap_models"))
    top = models.withColumn("n", F.row_number().over(w)).where(F.col("n") <= shown).groupBy("system").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "model"))), lambda x: x["model"]), "; ").alias("listed"))
    s = sums.join(counts, "system", "left").join(top, "system", "left")
    more = F.when(F.col("gap_models") > shown, F.concat(F.lit(" (+"), (F.col("gap_models") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    pct = F.concat(F.bround(100.0 * F.col("covered") / (F.col("covered") + F.col("gaps")), 0).cast("int").cast("string"), F.lit("%"))
    return s.select("system", "covered", "gaps", pct.alias("pct"), F.concat(F.coalesce("listed", F.lit("")), F.coalesce(more, F.lit(""))).alias("first_gaps"))


def gap_totals(report: DataFrame) -> DataFrame:
    """(system, items, covered, gaps, unknown) of each system, and of all with system 'Total'."""
    counts = [F.count("*").alias("items"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("covered", "covered"), ("gap", "gaps"), ("unknown", "unknown"))]]
    return report.withColumn("system", F.coalesce("system", F.lit("Unknown"))).rollup("system").agg(*counts).select(F.coalesce("system", F.lit("Total")).alias("system"), "items", "covered", "gaps", "unknown")


def image_backlog(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """(source_file, status) of every listed file: 'not indexed' if nothing of it is stored, 'has images' if a stored row
    has one, else 'open'. stored has source_file and page_image_url."""
    s = stored.groupBy("source_file").agg(F.count("page_image_url").alias("images"))
    status = F.when(F.col("images").isNull(), "not indexed").when(F.col("images") > 0, "has images").otherwise("open")
    return listed.select("source_file").distinct().join(s, "source_file", "left").select("source_file", status.alias("status"))
