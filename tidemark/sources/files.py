"""Sources and sinks: folders of documents, page extraction, JSON lines, CSV, manifests, object folders."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGES = T.StructType([T.StructField("path", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])
CHUNK = T.StructType([T.StructField(c, t) for c, t in (("chunk_id", T.StringType()), ("text", T.StringType()), ("vessel", T.StringType()), ("order_no", T.StringType()), ("equipment_model", T.StringType()), ("document_type", T.StringType()), ("document_title", T.StringType()), ("revision", T.StringType()), ("source_file", T.StringType()), ("page_number", T.IntegerType()), ("section", T.StringType()), ("has_text_layer", T.BooleanType()), ("total_pages", T.IntegerType()))])
LEAST_BYTES = 1024


def list_names(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """(path, length) of all files below the folder whose name ends so, empty ones too, which a file scan leaves out.
    Names are listed by the driver, as Spark lists them for any scan; contents are not touched."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    found, rows = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True), []
    while found.hasNext():
        f = found.next()
        if f.getPath().getName().endswith(suffix):
            rows.append((f.getPath().toString(), int(f.getLen())))
    return spark.createDataFrame(rows, "path string, length long")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, modificationTime, content) of all matching files below the folder that hold anything."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)


def file_hashes(files: DataFrame) -> DataFrame:
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))


def offline_pages(content: bytes) -> list[str]:
    """Pages of a container (ZIP whose manifest.json lists page files), of HTML or of plain text with form feeds."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = json.loads(z.read("manifest.json"))["pages"]
            return [z.read(n).decode("utf-8", "replace") for n in names]
    text = content.decode("utf-8", "replace")
    if "<html" in text[:400].lower():
        text = re.sub(r"<[^>]+>", " ", re.sub(r"(?is)<(script|style).*?</\1>", " ", text))
    return text.split("\f")


def extract_pages(files: DataFrame, pages_of: Callable[[bytes], list[str]] = offline_pages) -> DataFrame:
    """(path, page_number, text, error): one row per page; a file that cannot be read gives one row with its error. NUL
    characters are taken out."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, i, p.replace("\x00", ""), None) for i, p in enumerate(pages_of(content), 1)]
                except Exception as e:  # noqa: BLE001 - any reader may fail in its own way
                    rows.append((path, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=PAGES.fieldNames()).astype({"page_number": "Int32"})

    return files.select("path", "content").mapInPandas(extract, PAGES)


def validity(names: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, valid, issue) of listed names: empty, too small, unreadable or without pages; a warning if the first three of several pages
    have no text."""
    p = pages.groupBy("path").agg(F.max("error").alias("error"), F.count("page_number").alias("pages"), F.sum(F.when(F.col("page_number") <= 3, F.length(F.trim("text"))).otherwise(0)).alias("sample"))
    j = names.select("path", "length").join(p, "path", "left")
    issue = (
        F.when(F.col("length") == 0, "empty file").when(F.col("length") < LEAST_BYTES, "file too small").when(F.col("error").isNotNull(), F.concat(F.lit("unreadable: "), "error")).when(F.coalesce("pages", F.lit(0)) == 0, "no pages").when((F.col("pages") > 1) & (F.coalesce("sample", F.lit(0)) == 0), "WARNING: no text in the first pages")
    )
    return j.select("path", (issue.isNull() | issue.startswith("WARNING")).alias("valid"), issue.alias("issue"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The local backup, JSON lines; an empty table if there is none yet."""
    return spark.read.schema(CHUNK).json(path) if exists(spark, path) else spark.createDataFrame([], CHUNK)


def write_chunks(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(filename, hash, chunk_ids) of the manifest, an object by file name; empty if there is none."""
    shape = "map<string, struct<hash: string, chunk_ids: array<string>>>"
    if not exists(spark, path):
        return spark.createDataFrame([], "filename string, hash string, chunk_ids array<string>")
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", shape)).alias("filename", "m"))
    return m.select("filename", "m.hash", "m.chunk_ids")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, as written."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def upload_plan(pages: DataFrame, prefix: str = "") -> DataFrame:
    """(source_file, page_number, object_key): the key a page image has; the same page has the same key every time."""
    return pages.select("source_file", "page_number", F.concat(F.lit(prefix), "source_file", F.lit("/p"), F.col("page_number").cast("string"), F.lit(".png")).alias("object_key"))
