"""Page layout: markers inside cells, tiles of large pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKER = 20.0
PIXELS, DPI, OVERLAP = 8000, 300, 0.15


def marked_cells(cells: DataFrame, images: DataFrame, grid: float = 50.0) -> DataFrame:
    """cells with their text, where empty cells that hold a marker get 'X'.

    cells: page, row_no, col_no, x0, top, x1, bottom, text; images: page, x0, top, x1, bottom. A marker is an image of at
    most 20 by 20 points; it is in a cell if its centre is, borders included. Centres and cells meet on squares of a grid,
    so the range join is an equi-join with a test behind it. A cell without a box keeps its text."""
    m = images.where((F.col("x1") - F.col("x0") <= MARKER) & (F.col("bottom") - F.col("top") <= MARKER))
    m = m.select("page", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("top") + F.col("bottom")) / 2).alias("cy"))
    m = m.withColumn("gx", F.floor(F.col("cx") / grid)).withColumn("gy", F.floor(F.col("cy") / grid))
    span = lambda a, b: F.sequence(F.floor(F.col(a) / grid), F.floor(F.col(b) / grid))
    boxes = cells.where("x0 is not null and x1 >= x0 and bottom >= top and top is not null")
    boxes = boxes.select("page", "row_no", "col_no", "x0", "top", "x1", "bottom", F.explode(span("x0", "x1")).alias("gx")).withColumn("gy", F.explode(span("top", "bottom")))
    inside = (F.col("cx") >= F.col("x0")) & (F.col("cx") <= F.col("x1")) & (F.col("cy") >= F.col("top")) & (F.col("cy") <= F.col("bottom"))
    hit = boxes.join(m, ["page", "gx", "gy"]).where(inside).select("page", "row_no", "col_no").distinct().withColumn("hit", F.lit(True))
    out = cells.join(hit, ["page", "row_no", "col_no"], "left")
    return out.withColumn("text", F.when(F.col("hit") & (F.trim(F.coalesce("text", F.lit(""))) == ""), "X").otherwise(F.col("text"))).drop("hit")


def clamped_dpi(width: Column, height: Column, dpi: int = DPI, most: int = PIXELS) -> Column:
    """Resolution at which neither side of a page in points passes the most pixels."""
    return F.least(F.lit(dpi), (most / width * 72).cast("int"), (most / height * 72).cast("int"))


def tiles(pages: DataFrame, dpi: int = DPI, most: int = PIXELS, overlap: float = OVERLAP) -> DataFrame:
    """(columns of pages, row_no, col_no, left, top, right, bottom): overlapping tiles of pages (width_pt, height_pt) in
    pixels, none larger than ``most``."""
    step = most * (1 - overlap)
    p = pages.withColumn("_w", F.ceil(F.col("width_pt") / 72 * dpi)).withColumn("_h", F.ceil(F.col("height_pt") / 72 * dpi))
    count = lambda c: F.when(F.col(c) <= most, F.lit(1)).otherwise(F.ceil(F.col(c) / step)).cast("int")
    p = p.withColumn("row_no", F.explode(F.sequence(F.lit(0), count("_h") - 1))).withColumn("col_no", F.explode(F.sequence(F.lit(0), count("_w") - 1)))
    p = p.withColumn("left", (F.col("col_no") * step).cast("int")).withColumn("top", (F.col("row_no") * step).cast("int"))
    return p.withColumn("right", F.least(F.col("left") + most, F.col("_w")).cast("int")).withColumn("bottom", F.least(F.col("top") + most, F.col("_h")).cast("int")).drop("_w", "_h")
