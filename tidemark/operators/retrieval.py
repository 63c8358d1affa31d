"""Search: exact vector top-k for a set of queries, literal codes, keywords, and the ranking of their union."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import written

#: Queries that one pass over the corpus answers; their vectors are what a task holds.
QUERY_BLOCK = 4096
#: Rows that a task compares with the block at once, and what two ways of summing a similarity may differ by.
TILE, SLACK = 1024, 1e-9


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_key, key, distance, rank): the k nearest rows by cosine distance of each query, ties by key.

    The query set goes against all rows in blocks of at most query_block vectors. A task multiplies its batches with the
    block, width by width, and hands on k rows per query and batch; a window merges them. Vectors that are null or without
    length, or of another width than the query's, have no distance and are no result. Keys are bigint."""
    spark = corpus.sparkSession
    q = queries.select(F.col(query_key).cast("bigint").alias(query_key), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    blocks = max(1, -(-q.count() // query_block))
    q = q.withColumn("b", F.pmod(F.xxhash64(query_key), F.lit(blocks)))
    c = corpus.select(F.col(key).cast("bigint").alias(key), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    found = None
    for b in range(blocks):
        held = q.where(F.col("b") == b).select(query_key, "v").toPandas()  # about query_block rows
        part = spark.sparkContext.broadcast((held[query_key].to_numpy(np.int64), held["v"].tolist()))

        def near(batches: Iterator[pd.DataFrame], part=part) -> Iterator[pd.DataFrame]:
            ids, vectors = part.value
            sizes = np.array([len(v) for v in vectors], int)
            best = {int(w): Nearest(ids[sizes == w], np.array([v for v in vectors if len(v) == w], float), k) for w in set(sizes.tolist()) if w}
            for pdf in batches:
                widths = pdf["v"].map(len).to_numpy()
                for w, b in best.items():
                    if (of := widths == w).any():
                        b.add(np.stack(pdf["v"].to_numpy()[of]), pdf[key].to_numpy(np.int64)[of])
            for b in best.values():
                yield pd.DataFrame({query_key: b.ids[b.best["row"].to_numpy()], key: b.best["key"].to_numpy(), "distance": b.best["distance"].to_numpy()})

        one = c.mapInPandas(near, f"{query_key} bigint, {key} bigint, distance double")
        found = one if found is None else found.unionByName(one)
    best = Window.partitionBy(query_key).orderBy("distance", key)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class Nearest:
    """The k nearest rows so far of a block of queries of one width."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        norm = np.sqrt((vectors * vectors).sum(axis=1))
        self.ids, self.q, self.norm, self.k = ids[norm > 0], vectors[norm > 0], norm[norm > 0], k
        self.best = pd.DataFrame({"row": np.empty(0, np.int64), "key": np.empty(0, np.int64), "distance": np.empty(0)})
        self.least = np.full(len(self.ids), -np.inf)  # similarity below which a row is none of the query's k

    def add(self, every: np.ndarray, all_keys: np.ndarray) -> None:
        for at in range(0, len(every) if len(self.ids) else 0, TILE):
            m, keys = every[at : at + TILE], all_keys[at : at + TILE]
            n = np.sqrt((m * m).sum(axis=1))
            m, n, keys = m[n > 0], n[n > 0], keys[n > 0]
            if not len(m):
                continue
            near_by = (self.q / self.norm[:, None]) @ (m / n[:, None]).T
            floor = self.least
            if len(m) >= self.k and np.isinf(floor).any():
                floor = np.maximum(floor, np.partition(near_by, len(m) - self.k, axis=1)[:, len(m) - self.k])
            r, c = np.nonzero(near_by >= floor[:, None] - SLACK)
            if not len(r):
                continue
            d = np.round(1.0 - np.einsum("ij,ij->i", self.q[r], m[c]) / (self.norm[r] * n[c]), 12)
            best = pd.concat([self.best, pd.DataFrame({"row": r, "key": keys[c], "distance": d})]).sort_values(["row", "distance", "key"])
            self.best = best[(best.groupby("row").cumcount() < self.k).to_numpy()]
            full = self.best.groupby("row").nth(self.k - 1)
            self.least[full["row"].to_numpy()] = 1.0 - full["distance"].to_numpy()


def code_search(corpus: DataFrame, terms: DataFrame, limit: int = 20) -> DataFrame:
    """(term, chunk_id, document_title, page_number, rank): rows whose text, hyphens closed, contains the term.

    corpus has chunk_id, text, document_title, page_number; terms has term, made of letters, digits and hyphens. Such a
    term can only stand inside a run of these characters, so the distinct runs meet the terms on the terms' first three
    characters, and the rows are found by joining on the run. No row is compared with every term."""
    t = terms.select(F.lower("term").alias("low"), "term").where(F.length("term") >= 3).distinct().withColumn("gram", F.left("low", F.lit(3)))
    runs = F.array_distinct(F.regexp_extract_all(F.lower(tx.closed_hyphens(F.col("text"))), F.lit(r"([a-z0-9]+(?:-[a-z0-9]*)+)"), F.lit(1)))
    rows = corpus.select("chunk_id", "document_title", "page_number", F.explode(runs).alias("run"))
    grams = rows.select("run").distinct().withColumn("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("run") - 2, F.lit(1))), lambda i: F.substr(F.col("run"), i, F.lit(3))))))
    hits = grams.join(t, "gram").where(F.contains("run", "low")).select("run", "term").distinct()
    found = rows.join(hits, "run").select("term", "chunk_id", "document_title", "page_number").distinct()
    order = Window.partitionBy("term").orderBy("document_title", "page_number", "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _pieces(col: str, n: int) -> Column:
    return F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(col) - n + 1), lambda i: F.substr(F.col(col), i, F.lit(n)))))


def named_titles(titles: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, document_title): the first title, by the alphabet, that a question names in full, letter case aside.

    titles has document_title; questions has query_id and text. A title can only stand where its first twelve characters do
    (three, if it is shorter), so the distinct titles meet the questions' pieces by equality."""
    titles = titles.select("document_title").distinct().withColumn("low", F.lower("document_title")).where(F.length("low") >= 3)
    q = questions.select("query_id", F.lower("text").alias("text"))
    met = None
    for n, kept in ((12, F.length("low") >= 12), (3, F.length("low") < 12)):
        laid = q.where(F.length("text") >= n).select("query_id", _pieces("text", n).alias("piece"))
        one = laid.join(titles.where(kept).withColumn("piece", F.left("low", F.lit(n))), "piece").select("query_id", "document_title", "low")
        met = one if met is None else met.unionByName(one)
    return met.join(q, "query_id").where(F.contains("text", "low")).groupBy("query_id").agg(F.min("document_title").alias("document_title"))


def title_hits(corpus: DataFrame, questions: DataFrame, limit: int = 8) -> DataFrame:
    """(query_id, chunk_id, rank): the first pages of the title that a question names (see named_titles). corpus has
    chunk_id, document_title, page_number."""
    order = Window.partitionBy("document_title").orderBy(F.col("page_number").asc_nulls_last(), "chunk_id")
    first = corpus.select("chunk_id", "document_title", "page_number").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return named_titles(corpus, questions).join(first, "document_title").select("query_id", "chunk_id", "rank")


def drawing_hits(corpus: DataFrame, words: DataFrame, limit: int = 20) -> DataFrame:
    """(keyword, chunk_id, rank): chunks of drawings whose title or file name holds the keyword, at most limit for each.

    corpus has chunk_id, document_title, source_file, page_number; words has keyword, of four or more letters a-z. A keyword
    stands inside a run of letters, so distinct runs meet keywords on three letters. A document hands on its first limit
    chunks, and a keyword meets the first limit titles, each of which has a chunk."""
    doc = ["document_title", "source_file"]
    names = F.lower(F.concat_ws("\n", *doc))
    runs = corpus.select(*doc).distinct().withColumn("run", F.explode(F.array_distinct(F.regexp_extract_all(names, F.lit("([a-z]{4,})"), F.lit(1)))))
    laid = runs.select("run").distinct().withColumn("piece", _pieces("run", 3))
    held = words.select("keyword").distinct().withColumn("piece", F.left("keyword", F.lit(3))).join(laid, "piece").where(F.contains("run", "keyword")).select("keyword", "run").distinct()
    docs = held.join(runs, "run").select("keyword", *doc).distinct()
    docs = docs.withColumn("no", F.dense_rank().over(Window.partitionBy("keyword").orderBy("document_title"))).where(F.col("no") <= limit)
    order = ["page_number", "chunk_id"]
    first = corpus.select("chunk_id", *doc, "page_number").withColumn("no_in", F.row_number().over(Window.partitionBy(*doc).orderBy(*order))).where(F.col("no_in") <= limit)
    a, b = docs.alias("a"), first.alias("b")
    rows = a.join(b, F.col("a.document_title").eqNullSafe(F.col("b.document_title")) & F.col("a.source_file").eqNullSafe(F.col("b.source_file"))).select("a.keyword", "b.chunk_id", "b.document_title", "b.page_number")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("keyword").orderBy("document_title", *order))).where(F.col("rank") <= limit).select("keyword", "chunk_id", "rank")


def ranked_union(arms: list[DataFrame], group: str) -> DataFrame:
    """All arms' hits with arm and a pos that counts through the arms; a later arm's hit whose fingerprint (null-safe) an
    earlier arm of the group has is left out. Arms have group, pos, document_title, page_number, text, distance, chunk_id."""
    out = arms[0].withColumn("arm", F.lit(0))
    for no, arm in enumerate(arms[1:], 1):
        seen = out.select(F.col(group).alias("fp_group"), *tx.fingerprint(F.col("document_title"), F.col("page_number"), F.col("text"))).distinct()
        same = (F.col(group) == F.col("fp_group")) & F.col("document_title").eqNullSafe(F.col("fp_title")) & F.col("page_number").eqNullSafe(F.col("fp_page")) & F.left("text", F.lit(80)).eqNullSafe(F.col("fp_text"))
        out = out.unionByName(arm.join(seen, same, "left_anti").withColumn("arm", F.lit(no)))
    return out.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy("arm", "pos", "chunk_id")))


def finalize_hits(hits: DataFrame, group: str, max_gap: int = 1) -> DataFrame:
    """Hits of each group in their final order: first of equal fingerprints, by distance, then runs of consecutive pages
    of one title read together at the place of their best member.

    hits has group, pos, document_title, page_number, text, distance. Result adds final_rank. Groups are the hits of one
    question, tens of rows. Null pages belong to no run."""
    fp = [F.col("document_title"), F.col("page_number"), F.left("text", F.lit(80))]
    first = Window.partitionBy(group, *fp).orderBy("pos")
    d = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("distance", "pos")))
    by_page = Window.partitionBy(group, "document_title").orderBy("page_number")
    d = d.withColumn("_before", F.max("page_number").over(by_page.rangeBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("_new", F.when(F.col("_before").isNull() | (F.col("page_number") - F.col("_before") > max_gap), 1).otherwise(0))
    starts = d.select(group, "document_title", "page_number", "_new").distinct()
    starts = starts.withColumn("run", F.sum("_new").over(by_page.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    d = d.drop("_before", "_new").join(starts, [group, "document_title", "page_number"], "left")
    same = Window.partitionBy(group, "document_title", "run")
    pages = F.size(F.collect_set("page_number").over(same))
    d = d.withColumn("in_run", F.coalesce(pages >= 2, F.lit(False)) & F.col("page_number").isNotNull())
    d = d.withColumn("anchor", F.when(F.col("in_run"), F.min("rank").over(same)).otherwise(F.col("rank")))
    final = Window.partitionBy(group).orderBy("anchor", F.when(F.col("in_run"), F.col("page_number")).otherwise(0), "rank")
    return d.withColumn("final_rank", F.row_number().over(final)).drop("run", "in_run", "anchor", "rank")


def page_runs(chunks: DataFrame, max_gap: int = 1) -> DataFrame:
    """(document_title, first_page, last_page, pages): runs of two or more consecutive pages of each title."""
    p = chunks.select("document_title", "page_number").where("page_number is not null").distinct()
    w = Window.partitionBy("document_title").orderBy("page_number")
    p = p.withColumn("new", F.when(F.col("page_number") - F.lag("page_number").over(w) <= max_gap, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return p.groupBy("document_title", "run").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.count("*").alias("pages")).where("pages >= 2").drop("run")


def stop_words(language: str = "english") -> list[str]:
    """The stop words that Spark's own StopWordsRemover ships."""
    return StopWordsRemover.loadDefaultStopWords(language)


def tfidf_topk(docs: DataFrame, question: str, k: int, key: str = "doc_id", text: str = "text", features: int = 5000, without: list[str] | None = None) -> DataFrame:
    """(key, score): the k documents with the largest cosine similarity of TF-IDF vectors to the question.

    Smooth idf ln((1+n)/(1+df))+1 over the ``features`` commonest terms that are no stop words (``without``, else Spark's
    English list), counts as tf, rows of length one. Term counts are written once; a document keeps its norm and its
    product with the question, so no pair of documents ever meets."""
    spark = docs.sparkSession
    without = stop_words() if without is None else without
    pattern = F.lit(r"(?U)\b(\w\w+)\b")
    words = F.filter(F.regexp_extract_all(F.lower(text), pattern, F.lit(1)), lambda w: ~w.isin(*without)) if without else F.regexp_extract_all(F.lower(text), pattern, F.lit(1))
    known = docs.where(F.col(text).isNotNull())
    tf = written(known.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")), "term-counts")
    n = known.count()
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    kept = df.orderBy(F.desc("cf"), "term").limit(features).select("term", (F.log((F.lit(1.0) + n) / (F.col("df") + 1)) + 1).alias("idf"))
    q = spark.createDataFrame([(question,)], "q string").select(F.explode(F.regexp_extract_all(F.lower("q"), pattern, F.lit(1))).alias("term")).groupBy("term").agg(F.count("*").alias("qtf"))
    # the vocabulary with the question's weights: at most ``features`` rows
    vocabulary = written(kept.join(q, "term", "left").select("term", "idf", (F.coalesce("qtf", F.lit(0)) * F.col("idf")).alias("qw")), "vocabulary")
    w = tf.join(F.broadcast(vocabulary), "term").withColumn("w", F.col("tf") * F.col("idf"))
    sums = w.groupBy(key).agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return sums.where("dot > 0").select(key, F.round(F.col("dot") / F.col("norm"), 9).alias("score")).orderBy(F.desc("score"), key).limit(k)
