"""Problem 6: filling containers of fixed capacity with items of varying length.

Method. Harmonic packing: an item longer than C/(k+1) and not longer than C/k is of class k, and k items of a class fill
a bin whatever their exact sizes, so every class is filled by counting, in shares that know nothing of each other.
Classes are cut into shares of a bounded number of items by a hash, so a class that holds a third of all items is spread
over many tasks. Items of the last class (at most C/CLASSES) and those of bins left incomplete then fill the gaps of the
bins of large items: gaps and items are laid end to end within each share, and an item that lies wholly inside a gap goes
there. What still remains is packed next-fit within each share.

An item longer than the capacity, and only such an item, is split: into full containers and one remainder, which is
packed like any item. Null and empty texts have no tokens and give no item. Equal items are told apart by their id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import FOLDER, VOCABULARY, token_count

CLASSES = 32
SHARE = 20_000


def oversize(df: DataFrame, capacity: int, text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """df's rows whose text alone exceeds the capacity, with their tokens. A byte-level tokenizer makes at most one token
    of each byte, so a text of no more bytes than the capacity is settled without tokenizing it; all others are."""
    long = df.where(F.octet_length(text) > capacity)
    return long.withColumn("tokens", token_count(F.col(text), folder, vocabulary)).where(F.col("tokens") > capacity)


def items_of(sized: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """(key, part, start, size, class): one row per item; an oversize text gives its pieces."""
    t = sized.where(F.col("tokens") > 0)
    pieces = F.sequence(F.lit(0), ((F.col("tokens") - 1) / capacity).cast("int"))
    t = t.select(key, "tokens", F.explode(pieces).alias("part"))
    t = t.withColumn("start", F.col("part") * capacity).withColumn("size", F.least(F.lit(capacity), F.col("tokens") - F.col("start")).cast("int"))
    return t.drop("tokens").withColumn("class", F.least(F.lit(CLASSES), (F.lit(capacity) / F.col("size")).cast("int")))


def pack(sized: DataFrame, capacity: int, key: str = "doc_id", share_size: int = SHARE) -> DataFrame:
    """(block_id, key, part, start, size): every item in exactly one block of at most ``capacity``.

    sized has the key and ``tokens``. Shares are counted from the data, so they stay near ``share_size`` items."""
    items = items_of(sized, capacity, key)
    counts = {r["class"]: r["n"] for r in items.groupBy("class").agg(F.count("*").alias("n")).collect()}  # CLASSES rows at most
    shares = {k: max(1, -(-n // share_size)) for k, n in counts.items()}
    # lanes hold loose items and the gaps of bins, whichever are more
    loose_items, bins = counts.get(CLASSES, 0) + sum(k * shares[k] for k in shares if k < CLASSES), sum(n // k for k, n in counts.items() if k < CLASSES)
    lanes = max(1, -(-max(loose_items, bins) // share_size))
    of_class = F.create_map(*[F.lit(x) for k in sorted(shares) for x in (k, shares[k])])[F.col("class")] if shares else F.lit(1)
    t = items.withColumn("share", F.pmod(F.xxhash64(key, "part"), of_class).cast("int"))
    inside = Window.partitionBy("class", "share").orderBy(F.col("size").desc(), F.col(key), "part")
    t = t.withColumn("i", F.row_number().over(inside) - 1).withColumn("n", F.count("*").over(Window.partitionBy("class", "share")))
    full = (F.col("i") < F.col("n") - F.col("n") % F.col("class")) & (F.col("class") < CLASSES)
    t = t.withColumn("bin", F.when(full, F.floor(F.col("i") / F.col("class"))))
    placed = t.where(F.col("bin").isNotNull()).withColumn("block_id", F.concat_ws("-", F.lit("h"), "class", "share", "bin"))
    loose = t.where(F.col("bin").isNull())

    # gaps of the bins of the largest classes, and the loose items, laid end to end in the same shares
    gaps = placed.groupBy("block_id").agg((F.lit(capacity) - F.sum("size")).alias("gap")).where(F.col("gap") > 0)
    gaps = gaps.withColumn("lane", F.pmod(F.xxhash64("block_id"), F.lit(lanes)).cast("int"))
    loose = loose.withColumn("lane", F.pmod(F.xxhash64(key, "part"), F.lit(lanes)).cast("int"))
    upto = Window.partitionBy("lane").rowsBetween(Window.unboundedPreceding, 0)
    gaps = gaps.withColumn("gap_end", F.sum("gap").over(upto.orderBy(F.col("gap").desc(), "block_id"))).withColumn("gap_start", F.col("gap_end") - F.col("gap"))
    loose = loose.withColumn("end", F.sum("size").over(upto.orderBy(F.col("size").desc(), F.col(key), "part"))).withColumn("begin", F.col("end") - F.col("size"))
    # an item meets the gap its start lies in: both sides in one ordered pass, no range join
    marks = gaps.select("lane", F.col("gap_start").alias("at"), F.lit(0).alias("kind"), "block_id", "gap_end")
    seen = loose.select("lane", F.col("begin").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("block_id"), F.lit(None).cast("bigint").alias("gap_end"), key, "part", "start", "size", "end", "class")
    line = marks.unionByName(seen, allowMissingColumns=True)
    back = Window.partitionBy("lane").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("in_block", F.last("block_id", True).over(back)).withColumn("in_end", F.last("gap_end", True).over(back)).where("kind = 1")
    fits = F.col("end") <= F.col("in_end")
    filled = line.where(fits).select(F.col("in_block").alias("block_id"), key, "part", "start", "size")
    rest = line.where(~fits | F.col("in_end").isNull())

    rest = next_fit(rest, capacity, key)
    return placed.select("block_id", key, "part", "start", "size").unionByName(filled).unionByName(rest.select("block_id", key, "part", "start", "size"))


def next_fit(rest: DataFrame, capacity: int, key: str) -> DataFrame:
    """Next-fit inside each lane, whose size is bounded, as a fold over its running order."""
    import pandas as pd

    schema = f"block_id string, {key} bigint, part int, start int, size int"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", key, "part"], ascending=[False, True, True])
        used, number, out = capacity + 1, 0, []
        for size in pdf["size"]:
            if used + size > capacity:
                number += 1
                used = 0
            used += size
            out.append(number)
        lane = int(pdf["lane"].iloc[0]) if len(pdf) else 0
        return pd.DataFrame({"block_id": [f"n-{lane}-{n}" for n in out], key: pdf[key], "part": pdf["part"], "start": pdf["start"], "size": pdf["size"]})

    return rest.select("lane", key, "part", F.col("start").cast("int").alias("start"), "size").groupBy("lane").applyInPandas(fold, schema)


def fill_report(blocks: DataFrame, capacity: int) -> DataFrame:
    """(blocks, tokens, capacity, fill): how much of the room is used."""
    b = blocks.groupBy("block_id").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
    return b.agg(F.count("*").alias("blocks"), F.sum("n").alias("items"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("fill"))
