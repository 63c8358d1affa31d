"""Writes expressed as tables: upsert, delete by key, reconciliation, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, null-safe: the last in ``order``. Aggregates before the shuffle, so a hot key costs one row per
    task."""
    cols = [F.col(c) for c in df.columns]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_row")).select("_row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """old with the rows of new put in by key: new rows win with all their columns, nulls too; null keys are equal.

    new may hold a key several times if ``order`` says which comes last. Columns that only one side has become null."""
    source = last_per_key(new, keys, order) if order else new
    same = None
    o, s = old.alias("o"), source.select(*keys).distinct().alias("s")
    for k in keys:
        c = F.col(f"o.{k}").eqNullSafe(F.col(f"s.{k}"))
        same = c if same is None else same & c
    return o.join(s, same, "left_anti").unionByName(source, allowMissingColumns=True)


def delete_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def audit(declared: DataFrame, stored: DataFrame, group: str = "source_file", key: str = "chunk_id") -> DataFrame:
    """(group, status, declared, missing, orphaned, missing_pct) of each group that is not complete: 'missing' if
    nothing of it is stored, 'partial' if some is not, 'orphaned' if it is stored but nowhere declared."""
    d = declared.select(group, key).distinct().withColumn("d", F.lit(1))
    s = stored.select(F.col(group).alias("s_group"), key).distinct().withColumn("s", F.lit(1))
    j = d.join(s, key, "full_outer").withColumn("g", F.coalesce(group, "s_group"))
    a = j.groupBy(F.col("g").alias(group)).agg(
        F.count("d").alias("declared"),
        F.sum(F.when(F.col("d").isNotNull() & F.col("s").isNull(), 1).otherwise(0)).alias("missing"),
        F.sum(F.when(F.col("d").isNull(), 1).otherwise(0)).alias("orphaned"),
    )
    status = F.when(F.col("declared") == 0, "orphaned").when(F.col("missing") == F.col("declared"), "missing").when(F.col("missing") > 0, "partial")
    pct = F.when(F.col("declared") > 0, F.bround(100.0 * F.col("missing") / F.col("declared"), 0).cast("int"))
    return a.withColumn("status", status).where("status is not null").select(group, "status", "declared", "missing", "orphaned", pct.alias("missing_pct"))


def content_hash(df: DataFrame, group: str, text: str = "text") -> DataFrame:
    """(group, content, parts): a hash of each group's texts that does not depend on their order: the sums of the first and
    of the second 64 bits of their SHA-256. Sums are combined in the tasks, so a group may be of any size."""
    h = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    sums = [F.sum(F.conv(F.substring(h, at, 16), 16, 10).cast("decimal(20,0)").cast("decimal(38,0)")) for at in (1, 17)]
    return df.groupBy(group).agg(F.concat_ws(".", *[x.cast("string") for x in sums]).alias("content"), F.count("*").alias("parts"))


def renames(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(filename, status, was): listing and known have filename and hash. unchanged, changed, new, or renamed from a
    known name of the same content that is no longer listed; 'removed' for names that are gone otherwise."""
    l = listing.select("filename", F.col("hash").alias("h"))
    k = known.select(F.col("filename").alias("k_name"), F.col("hash").alias("k_hash"))
    j = l.join(k, l["filename"] == k["k_name"], "full_outer")
    gone = j.where("filename is null").groupBy("k_hash").agg(F.max("k_name").alias("was"))
    here = j.where("filename is not null").select("filename", "h", "k_name", "k_hash")
    here = here.join(gone.withColumnRenamed("k_hash", "g"), (here["h"] == F.col("g")) & here["k_name"].isNull(), "left")
    status = F.when(F.col("k_name").isNotNull() & F.col("h").eqNullSafe(F.col("k_hash")), "unchanged").when(F.col("k_name").isNotNull(), "changed").when(F.col("was").isNotNull(), "renamed").otherwise("new")
    now = here.select("filename", status.alias("status"), "was")
    moved = now.where("status = 'renamed'").select(F.col("was").alias("k_name"))
    lost = j.where("filename is null").join(moved, "k_name", "left_anti").select(F.col("k_name").alias("filename"), F.lit("removed").alias("status"), F.lit(None).cast("string").alias("was"))
    return now.unionByName(lost)


def first_per_fingerprint(df: DataFrame, order: str) -> DataFrame:
    w = Window.partitionBy("document_title", "page_number", F.left("text", F.lit(80))).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ingest(store: DataFrame, known: DataFrame, listing: DataFrame, arrived: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(store, manifest, report) after a folder was read again, with the manifest as state.

    known and listing have filename and hash; arrived has the chunks of the listed files, with store's columns. Unchanged
    files are skipped, the chunks of changed ones replaced, those of renamed ones only renamed, new ones added; what is no
    longer listed stays. Running it again with its own result changes nothing."""
    report = renames(listing, known)
    renamed = report.where("status = 'renamed'").select(F.col("was").alias("source_file"), F.col("filename").alias("now"))
    taken = report.where("status in ('changed', 'new')").select(F.col("filename").alias("source_file"))
    kept = store.join(taken, "source_file", "left_anti").join(renamed, "source_file", "left")
    kept = kept.withColumn("source_file", F.coalesce("now", "source_file")).select(*store.columns)
    fresh = arrived.join(taken, "source_file", "left_semi").select(*store.columns)
    gone = report.where("status = 'removed'").select("filename")
    return kept.unionByName(fresh), listing.select("filename", "hash").unionByName(known.join(gone, "filename", "left_semi").select("filename", "hash")), report
