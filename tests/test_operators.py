import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import chunking, history, library, merging, retrieval
from tidemark.operators.numbering import numbered

HIT = "q int, pos int, document_title string, page_number int, text string, distance double"


def test_page_order(spark):
    pages = [175, 176, 173, 174, 177, 165]
    d = spark.createDataFrame([(1, i, "A", p, f"t{p}", 0.1 * i) for i, p in enumerate(pages)], HIT)
    got = [r["page_number"] for r in retrieval.finalize_hits(d, "q").orderBy("final_rank").collect()]
    assert got == [173, 174, 175, 176, 177, 165]


def test_three_chunks_of_a_page_stay_and_copies_go(spark):
    rows = [(1, 0, "A", 5, "x", 0.1), (1, 1, "A", 5, "y", 0.2), (1, 2, "A", 5, "z", 0.3), (1, 3, "A", 5, "x", 0.0), (1, 4, "B", None, "n", 0.05)]
    got = retrieval.finalize_hits(spark.createDataFrame(rows, HIT), "q").orderBy("final_rank").collect()
    assert [r["text"] for r in got] == ["n", "x", "y", "z"]
    assert retrieval.finalize_hits(spark.createDataFrame([], HIT), "q").count() == 0


def test_vector_topk_is_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 5))
    v[7] = 0
    v[9] = v[8]
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None), (98, [1.0])], "vec_id long, embedding array<double>")
    q = d.where("vec_id % 10 = 0 or vec_id in (7, 99)").withColumnRenamed("vec_id", "query_id")
    for block in (2, 4096):
        got = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.vector_topk(d, q, 4, query_block=block).collect()}
        for i in range(0, 60, 10):
            dist = [(round(1 - v[i] @ x / np.linalg.norm(v[i]) / np.linalg.norm(x), 12), j) for j, x in enumerate(v) if np.linalg.norm(x) > 0]
            assert [got[i, k + 1] for k in range(4)] == [j for _, j in sorted(dist)[:4]]
        assert not any(k[0] in (7, 99) for k in got)


def test_code_search_closes_hyphens(spark):
    c = spark.createDataFrame([("a", "order 4367- 1 today", "T", 1), ("b", "x14367-12y", "T", 2), ("c", "none", "T", 3), ("d", None, None, None)], "chunk_id string, text string, document_title string, page_number int")
    t = spark.createDataFrame([("4367-1",)], "term string")
    assert sorted(r["chunk_id"] for r in retrieval.code_search(c, t).collect()) == ["a", "b"]


def test_numbered(spark):
    d = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "x int")
    assert [(r["x"], r["row_no"]) for r in numbered(d, ["x"]).orderBy("x").collect()] == [(i, i + 1) for i in range(101)]
    assert numbered(d.where("x < 0"), ["x"]).count() == 0


def test_upsert(spark):
    old = spark.createDataFrame([(1, None, "a"), (2, "p", "b")], "k int, p string, v string")
    new = spark.createDataFrame([(1, None, None, "e"), (3, "p", "c", "e"), (3, "p", "d", "e")], "k int, p string, v string, extra string")
    got = sorted(tuple(r) for r in merging.upsert(old, new, ["k", "p"], [F.col("v")]).select("k", "v").collect())
    assert got == [(1, None), (2, "b"), (3, "d")] or got == sorted([(1, None), (2, "b"), (3, "d")], key=lambda x: x[0])
    again = merging.upsert(merging.upsert(old, new, ["k", "p"], [F.col("v")]), new, ["k", "p"], [F.col("v")])
    assert again.count() == 3


def test_renames(spark):
    s = "filename string, hash string"
    now = spark.createDataFrame([("a", "1"), ("b", "9"), ("c2", "3"), ("d", "4"), ("a copy", "1")], s)
    was = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("e", "5")], s)
    got = {r["filename"]: r["status"] for r in merging.renames(now, was).collect()}
    # a copy beside its original is new: the original's chunks stay with it
    assert got == {"a": "unchanged", "b": "changed", "c2": "renamed", "d": "new", "a copy": "new", "e": "removed"}


def test_audit(spark):
    s = "source_file string, chunk_id string"
    d = spark.createDataFrame([("f", "1"), ("f", "2"), ("g", "3"), ("h", "4")], s)
    st = spark.createDataFrame([("f", "1"), ("h", "4"), ("x", "9")], s)
    got = {r["source_file"]: (r["status"], r["missing_pct"]) for r in merging.audit(d, st).collect()}
    assert got == {"f": ("partial", 50), "g": ("missing", 100), "x": ("orphaned", None)}


def test_tables(spark):
    text = "intro\n| a | b |\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(1, 17)) + "\nprose\n| no rule |\n| at all |\n| alone |"
    d = spark.createDataFrame([("c", text), ("e", ""), ("n", None)], "chunk_id string, text string")
    rows = chunking.markdown_tables(d)
    assert rows.where("row_no > 0").count() == 16 and rows.select("table_no").distinct().count() == 1
    got = [(r["first_row"], r["last_row"]) for r in chunking.dense_groups(rows).orderBy("first_row").collect()]
    assert got == [(1, 6), (7, 12), (13, 16)]


def test_greedy_batches(spark):
    sizes = [3, 4, 5, 1, 9, 2]
    d = spark.createDataFrame(list(enumerate(sizes)), "k long, s int")
    got = [r["batch"] for r in chunking.greedy_batches(d, "k", "s", 3, 8).orderBy("k").collect()]
    assert got == [0, 0, 1, 1, 2, 3]


@pytest.mark.parametrize("block", [7, 20, 1000])
def test_greedy_batches_run_across_blocks(spark, block):
    rng = np.random.default_rng(block)
    sizes = rng.integers(0, 40, 300).tolist() + [500, 0, 0, 0, 0, 0, 0, 60, 61]
    d = spark.createDataFrame(list(enumerate(sizes)), "k long, s int")
    want, batch, used, n = [], 0, 0, 0
    for x in sizes:
        if n and (n >= 5 or used + x > 60):
            batch, used, n = batch + 1, 0, 0
        used, n = used + x, n + 1
        want.append(batch)
    got = [r["batch"] for r in chunking.greedy_batches(d, "k", "s", 5, 60, block).orderBy("k").collect()]
    assert got == want
    assert chunking.greedy_batches(d.where("k < 0"), "k", "s").count() == 0


def test_dense_chunks_repeat_the_head(spark):
    text = "Intro\n| A | B |\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(1, 9))
    d = spark.createDataFrame([("c", text, 4)], "chunk_id string, text string, page_number int")
    got = [r["text"] for r in chunking.dense_chunks(chunking.markdown_tables(d), d).orderBy("first_row").collect()]
    assert got[1] == "(Table 1 on page 4, rows 7-8 of 8)\n\n| A | B |\n|---|---|\n| 7 | x |\n| 8 | x |" and len(got) == 2


def test_transcripts_go_to_the_primary_chunk(spark):
    c = spark.createDataFrame([("f-p1", "f", 1, "old"), ("f-p1-densetable0", "f", 1, "t"), ("f-p2", "f", 2, "keep"), ("f-p2-densetable0", "f", 2, "t2")], "chunk_id string, source_file string, page_number int, text string")
    t = spark.createDataFrame([("f", 1, "new"), ("f", 2, None)], "source_file string, page_number int, transcript string")
    assert sorted(map(tuple, chunking.with_transcripts(c, t).select("chunk_id", "text").collect())) == [("f-p1", "new"), ("f-p2", "keep"), ("f-p2-densetable0", "t2")]


def test_ingest_is_idempotent(spark):
    store = spark.createDataFrame([("a1", "a.pdf", "x"), ("b1", "b.pdf", "y"), ("c1", "c.pdf", "z"), ("e1", "e.pdf", "e")], "chunk_id string, source_file string, text string")
    known = spark.createDataFrame([("a.pdf", "1"), ("b.pdf", "2"), ("c.pdf", "3"), ("e.pdf", "5")], "filename string, hash string")
    listing = spark.createDataFrame([("a.pdf", "1"), ("b.pdf", "22"), ("c2.pdf", "3"), ("d.pdf", "4")], "filename string, hash string")
    arrived = spark.createDataFrame([("b9", "b.pdf", "new"), ("d1", "d.pdf", "n"), ("a1", "a.pdf", "x"), ("c1", "c2.pdf", "z")], "chunk_id string, source_file string, text string")
    want = [("a1", "a.pdf", "x"), ("b9", "b.pdf", "new"), ("c1", "c2.pdf", "z"), ("d1", "d.pdf", "n"), ("e1", "e.pdf", "e")]
    after, manifest, report = merging.ingest(store, known, listing, arrived)
    assert sorted(map(tuple, after.collect())) == want
    assert {r["filename"]: r["status"] for r in report.collect()} == {"a.pdf": "unchanged", "b.pdf": "changed", "c2.pdf": "renamed", "d.pdf": "new", "e.pdf": "removed"}
    again, same, report = merging.ingest(after, manifest, listing, arrived)
    assert sorted(map(tuple, again.collect())) == want and sorted(map(tuple, same.collect())) == sorted(map(tuple, manifest.collect()))
    assert {r["status"] for r in report.collect()} == {"unchanged", "removed"}


def test_vectors_of_several_widths(spark):
    v = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [0.0, 1.0, 0.0]), (7, [])]
    d = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    q = d.withColumnRenamed("vec_id", "query_id")
    for block in (4096, 2):
        got = {}
        for r in retrieval.vector_topk(d, q, 5, query_block=block).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert got == {1: {1, 2}, 2: {1, 2}, 3: {3, 6}, 6: {3, 6}}


def test_tfidf_is_brute_force(spark):
    import math
    from collections import Counter

    texts = ["the pump and the valve leak", "pump pump oil", "valve of the oil head", None, "", "the and of"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stop = set(retrieval.stop_words())
    bags = {i: Counter(w for w in t.split() if w not in stop) for i, t in enumerate(texts) if t is not None}
    n = len(bags)
    idf = {w: math.log((1 + n) / (1 + sum(w in b for b in bags.values()))) + 1 for b in bags.values() for w in b}
    question = "does the pump leak oil"
    q = Counter(w for w in question.split() if w in idf)
    want = {}
    for i, b in bags.items():
        dot, norm = sum(b[w] * idf[w] * q[w] * idf[w] for w in q), math.sqrt(sum((k * idf[w]) ** 2 for w, k in b.items()))
        if dot > 0:
            want[i] = round(dot / norm, 9)
    got = {r["doc_id"]: r["score"] for r in retrieval.tfidf_topk(d, question, 10).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-8 for i in want)
    assert {"the", "and", "of"} <= stop


def test_history_ties_and_gaps(spark):
    s = "id long, conversation_id string, user_name string, role string, content string, created_at timestamp, feedback string"
    from datetime import datetime as T

    rows = [(1, "c", "u", "user", "q1", T(2025, 1, 1), None), (2, "c", "u", "assistant", "a1", T(2025, 1, 1), "down"), (3, "c", "u", "user", "q2", T(2025, 1, 2), None), (4, "c", "u", "user", "q3", T(2025, 1, 3), None), (5, "c", "u", "assistant", "a3", T(2025, 1, 4), "up"), (6, "d", "u", "assistant", "a", None, "up")]
    t = spark.createDataFrame(rows, s)
    assert [(r["question_id"], r["answer_id"]) for r in history.pairs(t).orderBy("question_id").collect()] == [(1, 2), (4, 5)]
    got = {r["answer_id"]: r["question"] for r in history.preceding_question(t).collect()}
    assert got == {2: "(no question found)", 5: "q3"}


def test_first_containing(spark):
    n = spark.createDataFrame([("KE683",), ("ZZ9",), ("A",)], "needle string")
    h = spark.createDataFrame([("DRIVEKE683AMANUAL", "b title"), ("XKE683", "a title")], "hay string, label string")
    assert [(r["needle"], r["label"]) for r in library.first_containing(n, h).collect()] == [("KE683", "a title")]


def test_later_arms_lose_hits_that_an_earlier_arm_has(spark):
    s = "q int, pos int, document_title string, page_number int, text string, distance double, chunk_id string"
    near = spark.createDataFrame([(1, 1, "A", None, "x", 0.2, "a"), (1, 2, "B", 7, "y", 0.3, "b")], s)
    coded = spark.createDataFrame([(1, 1, "A", None, "x", -1.0, "copy"), (1, 2, "C", 1, "z", -1.0, "c"), (2, 1, "A", None, "x", -1.0, "a")], s)
    drawn = spark.createDataFrame([(1, 1, "C", 1, "z", -1.0, "c"), (1, 2, "D", 1, "w", -1.0, "d")], s)
    got = retrieval.finalize_hits(retrieval.ranked_union([near, coded, drawn], "q"), "q").orderBy("q", "final_rank").collect()
    assert [(r["q"], r["arm"], r["chunk_id"]) for r in got] == [(1, 1, "c"), (1, 2, "d"), (1, 0, "a"), (1, 0, "b"), (2, 1, "a")]


def test_title_and_drawing_hits(spark):
    rows = [(f"c{i}", "Fuel - KE683 Wiring Diagram", "Fuel_KE683_FuelOilPiping_DWG.pdf", i) for i in range(30)] + [("e", "Hull", "Hull_DWG.pdf", 1)]
    c = spark.createDataFrame(rows, "chunk_id string, document_title string, source_file string, page_number int")
    q = spark.createDataFrame([(1, "Show me the FUEL - KE683 wiring diagram please"), (2, "view the hull"), (3, "show me fuel")], "query_id long, text string")
    got = retrieval.title_hits(c, q, 2).collect()
    assert sorted((r["query_id"], r["chunk_id"]) for r in got) == [(1, "c0"), (1, "c1"), (2, "e")]
    words = spark.createDataFrame([("piping",), ("hull",), ("none",)], "keyword string")
    got = retrieval.drawing_hits(c, words, 20).groupBy("keyword").count().collect()
    assert {r["keyword"]: r["count"] for r in got} == {"piping": 20, "hull": 1}


def test_vector_topk_keeps_the_nearest_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", 3)
    v = np.random.default_rng(1).integers(-2, 3, size=(80, 3)).astype(float)  # many ties and some without length
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").coalesce(1)
    got = retrieval.vector_topk(d, d.withColumnRenamed("vec_id", "query_id"), 5).groupBy("query_id").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).collect()
    for r in got:
        q = v[r["query_id"]]
        dist = sorted((round(1 - float((q * x).sum()) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum())), 12), i) for i, x in enumerate(v) if x.any())
        assert r["ids"] == sorted(i for _, i in dist[:5])
    assert len(got) == sum(x.any() for x in v)


def test_hybrid_search_asks_the_chunks(spark, small):
    from tidemark.plans.retrieval_queries import q_hybrid_search

    got = q_hybrid_search(spark, small)
    n = spark.read.parquet(f"{small}/tm_chunks.parquet").count()
    assert {r["query_id"] for r in got.select("query_id").distinct().collect()} <= set(range(50, n + 1, 50))
    assert {r["arm"] for r in got.select("arm").distinct().collect()} >= {0, 1} and "chunk_id" in got.columns
