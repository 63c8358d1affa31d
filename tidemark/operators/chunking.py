"""Chunking: tables in page text, dense tables, page gates, batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import written
from .numbering import numbered

ROWS_PER_GROUP = 6
# The second line of a table.
RULE_ROW = r"^\|[\s\-:|]+\|$"


def markdown_tables(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, table_no, row_no, cells): the rows of every table in a text. A table is a maximal run of two or more lines
    that begin and end with a pipe, of which the second is a rule; row 0 is its head, the rule is no row."""
    lines = chunks.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "raw")).withColumn("s", tx.strip(F.col("raw")))
    t = lines.where(F.col("s").startswith("|") & F.col("s").endswith("|") & (F.length("s") >= 2))
    w = Window.partitionBy(key).orderBy("line_no")  # the lines of one text
    t = t.withColumn("start", F.when(F.col("line_no") - F.lag("line_no").over(w) == 1, 0).otherwise(1)).withColumn("run", F.sum("start").over(w))
    r = Window.partitionBy(key, "run").orderBy("line_no")
    t = t.withColumn("i", F.row_number().over(r) - 1)
    t = t.withColumn("ok", F.max(F.when(F.col("i") == 1, F.col("s").rlike(RULE_ROW)).otherwise(False)).over(Window.partitionBy(key, "run"))).where("ok and i <> 1")
    number = F.dense_rank().over(Window.partitionBy(key).orderBy("run"))
    cells = F.transform(F.split(F.regexp_replace("s", r"^\|+|\|+$", ""), r"\|"), tx.strip)
    return t.select(key, number.alias("table_no"), F.when(F.col("i") == 0, 0).otherwise(F.col("i") - 1).alias("row_no"), cells.alias("cells"))


def dense_groups(rows: DataFrame, key: str = "chunk_id", size: int = ROWS_PER_GROUP) -> DataFrame:
    """(key, table_no, first_row, last_row, rows): tables of more than ``size`` rows cut into groups of ``size``."""
    data = rows.where("row_no > 0")
    total = data.groupBy(key, "table_no").agg(F.max("row_no").alias("rows")).where(F.col("rows") > size)
    g = total.withColumn("g", F.explode(F.sequence(F.lit(0), ((F.col("rows") - 1) / size).cast("int"))))
    return g.select(key, "table_no", (F.col("g") * size + 1).alias("first_row"), F.least(F.col("g") * size + size, F.col("rows")).alias("last_row"), "rows")


def vision_candidates(chunks: DataFrame) -> DataFrame:
    """(source_file, page_number, meaningful): pages whose primary chunk has too little real text. Primary is the chunk
    that is no part of a dense table, the lowest id; its text decides for the page."""
    primary = F.struct(F.col("chunk_id").rlike("-densetable\\d+$"), "chunk_id")
    p = chunks.groupBy("source_file", "page_number").agg(F.min_by("text", primary).alias("text"))
    m = tx.meaningful_length(F.col("text"))
    return p.where(~((m >= tx.VISION_CHARS) & tx.is_real_language(F.col("text")))).select("source_file", "page_number", m.alias("meaningful"))


def rendered_pages(chunks: DataFrame) -> DataFrame:
    """(source_file, page_number): pages 1 to the last that have text or a neighbour with text."""
    have = chunks.where(F.length(tx.strip(F.col("text"))) > 0).select("source_file", "page_number").distinct()
    last = chunks.groupBy("source_file").agg(F.max(F.greatest(F.coalesce("total_pages", F.lit(0)), F.col("page_number"))).alias("last"))
    near = have.select("source_file", F.explode(F.array(F.col("page_number") - 1, F.col("page_number"), F.col("page_number") + 1)).alias("page_number")).distinct()
    return near.join(last, "source_file").where((F.col("page_number") >= 1) & (F.col("page_number") <= F.col("last"))).select("source_file", "page_number")


def table_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("\n"), F.lit(" "))), " | "), F.lit(" |"))


def table_head(cells: Column) -> Column:
    """The head of a table and the rule below it."""
    return F.concat(table_row(cells), F.lit("\n|"), F.array_join(F.transform(cells, lambda c: F.lit("---")), "|"), F.lit("|"))


def dense_chunks(rows: DataFrame, pages: DataFrame, key: str = "chunk_id", size: int = ROWS_PER_GROUP) -> DataFrame:
    """(key, table_no, first_row, text): for each table of more than ``size`` rows a chunk of every ``size`` of them, with
    the head of the table repeated. rows as markdown_tables gives them; pages has the key and page_number."""
    groups = dense_groups(rows, key, size)
    data = rows.where("row_no > 0").withColumn("g", ((F.col("row_no") - 1) / size).cast("int"))
    body = data.groupBy(key, "table_no", "g").agg(F.sort_array(F.collect_list(F.struct("row_no", table_row(F.col("cells")).alias("line")))).alias("lines"))  # ``size`` rows
    body = body.select(key, "table_no", (F.col("g") * size + 1).alias("first_row"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("body"))
    head = rows.where("row_no = 0").select(key, "table_no", table_head(F.col("cells")).alias("head"))
    t = groups.join(body, [key, "table_no", "first_row"]).join(head, [key, "table_no"]).join(pages.select(key, "page_number"), key)
    what = F.format_string("(Table %d on page %d, rows %d-%d of %d)", "table_no", "page_number", "first_row", "last_row", "rows")
    return t.select(key, "table_no", "first_row", F.concat(what, F.lit("\n\n"), "head", F.lit("\n"), "body").alias("text"))


def with_transcripts(chunks: DataFrame, transcripts: DataFrame) -> DataFrame:
    """chunks (chunk_id, source_file, page_number, text ...) after pages were transcribed: the page's primary chunk (no part
    of a dense table, lowest id) gets the transcript, its others go. transcripts has source_file, page_number (each page
    once) and transcript; null transcripts change nothing."""
    told = transcripts.where("transcript is not null")
    pages = ["source_file", "page_number"]
    primary = F.struct(F.col("chunk_id").rlike("-densetable\\d+$"), "chunk_id")
    first = chunks.groupBy(*pages).agg(F.min_by("chunk_id", primary).alias("primary"))
    t = chunks.join(told.join(first, pages), pages, "left").where(F.col("primary").isNull() | (F.col("primary") == F.col("chunk_id")))
    return t.withColumn("text", F.coalesce("transcript", "text")).select(*chunks.columns)


def document_parts(pages: DataFrame, size: int = 20) -> DataFrame:
    """(source_file, part, text): the texts of a file's pages in order, each behind a line with its number, put together for
    every ``size`` pages, as a request holds no document of any length. pages has source_file, page_number, chunk_id, text;
    rows without a page or text are left out."""
    p = pages.where("page_number is not null and text is not null").withColumn("part", F.floor((F.col("page_number") - 1) / size))
    line = F.concat(F.lit("--- Page "), F.col("page_number").cast("string"), F.lit(" ---\n"), "text")
    g = p.groupBy("source_file", "part").agg(F.sort_array(F.collect_list(F.struct("page_number", "chunk_id", line.alias("line")))).alias("lines"))  # the chunks of ``size`` pages
    return g.select("source_file", "part", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("text"))


def greedy_batches(df: DataFrame, key: str, size: str, most_items: int = 1000, most_size: int = 250_000, block_size: int | None = None) -> DataFrame:
    """(batch, key, size): batches in order of key that close when the next item would exceed the size or the count; an
    item larger than most_size stands alone. Null keys come first; keys are unique.

    Greedy filling depends on all items before. A batch that begins before a block ends among the block's first
    ``most_items`` items, so a block is told by where the batch that begins at each of these makes the next block begin:
    ``most_items`` numbers, whatever the block's size. These tables are chained, one row of each, and then every block is
    filled for itself. Blocks have about as many items as there are rows of all tables, so neither grows with the data."""
    spark = df.sparkSession
    rows = numbered(df.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("size")), ["key"])
    n = rows.count()
    block = block_size or max(4 * most_items, int((n * most_items) ** 0.5))
    rows = written(rows.withColumn("block", ((F.col("row_no") - 1) / block).cast("bigint")), "greedy-rows")
    # the items that a batch from the block before can reach stand in both blocks
    reach = rows.where((F.col("row_no") - 1) % block < most_items).where("block > 0").withColumn("block", F.col("block") - 1)

    def ends(sizes: np.ndarray) -> np.ndarray:
        """For each item the first one behind the batch that begins there."""
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(len(sizes))
        return np.maximum(np.minimum(np.searchsorted(total, total[:-1] + most_size, side="right") - 1, at + most_items), at + 1)

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_no")
        own = int((pdf["own"]).sum())
        step = ends(pdf["size"].to_numpy())
        out = np.arange(len(pdf) + 1)
        for i in range(own - 1, -1, -1):
            out[i] = out[step[i]]
        first = min(most_items, own)
        return pd.DataFrame({"block": pdf["block"].iloc[:first], "entry": np.arange(first), "leave": out[:first] - own})

    both = rows.withColumn("own", F.lit(True)).unionByName(reach.withColumn("own", F.lit(False))).select("block", "row_no", "size", "own")
    table = written(both.groupBy("block").applyInPandas(exits, "block bigint, entry bigint, leave bigint"), "greedy-exits")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        leave = {(b, e): x for b, e, x in zip(pdf["block"], pdf["entry"], pdf["leave"])}
        out, at = [], 0
        for b in range(int(pdf["block"].max()) + 1):
            out.append((b, at))
            at = leave.get((b, at), 0)
        return pd.DataFrame(out, columns=["block", "entry"])

    # one row for each block and entry: as many as a block has items
    entries = table.groupBy(F.lit(0).alias("all")).applyInPandas(chain, "block bigint, entry bigint")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_no")
        step, at, n = ends(pdf["size"].to_numpy()), int(pdf["entry"].iloc[0]), len(pdf)
        begins = np.zeros(n, np.int64)
        while at < n:
            begins[at] = 1
            at = int(step[at])
        return pdf.assign(inside=np.cumsum(begins))[["block", "key", "size", "inside"]]

    kind = df.schema[key].dataType.simpleString()
    filled = written(rows.join(entries, "block").groupBy("block").applyInPandas(fill, f"block bigint, key {kind}, size bigint, inside bigint"), "greedy-batches")
    starts = filled.groupBy("block").agg(F.max("inside").alias("batches"))  # one row for each block
    before = starts.select("block", F.coalesce(F.sum("batches").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return filled.join(before, "block").select((F.col("inside") + F.col("before") - 1).alias("batch"), F.col("key").alias(key), "size")
