import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import encoding as e

CLEAN = ["Pumpen går jevnt på øvre dekk, må åpnes før prøven.", "Der Kühler muß für die Prüfung geöffnet werden – sofort.", "La presión cambió; el técnico encontró corrosión.", "The crew’s “valve” reads 40 °C ± 0.5 — never less.", "The mast reads VILA DAS MARÇÃS and ÂNCORA NÃO USAR.", "For three phases multiply by √3 and check the Σ of all."] * 40


def corpus(spark, extra):
    rows = [(str(i), t) for i, t in enumerate(CLEAN)] + [(f"x{i}", t) for i, t in enumerate(extra)]
    return spark.createDataFrame(rows, "chunk_id string, text string")


def garble(text, page):
    return "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in text.encode("utf-8"))


@pytest.mark.parametrize("page", ["cp1252", "cp437", "cp850", "mac_roman", "cp1251"])
def test_round_trip(spark, page):
    extra = [garble(CLEAN[i], page) for i in (0, 1, 2)]
    got = {r["chunk_id"]: r for r in e.repair_encoding(corpus(spark, extra)).collect()}
    for k, i in enumerate((0, 1, 2)):
        assert got[f"x{k}"]["garbled"] and got[f"x{k}"]["restored"] == CLEAN[i]
    assert not any(r["garbled"] for k, r in got.items() if k[0] != "x")


def test_twice_and_partly_and_lost(spark):
    twice = garble(garble(CLEAN[0], "cp1252"), "cp1252")
    part = "Pumpen gÃ¥r jevnt på øvre dekk"
    single = CLEAN[1].encode("cp1252").decode("cp437")
    lost = "f�r die Prüfung"
    got = {r["chunk_id"]: r for r in e.repair_encoding(corpus(spark, [twice, part, single, lost, None, "", "plain"])).collect()}
    assert got["x0"]["restored"] == CLEAN[0]
    assert got["x1"]["restored"] == "Pumpen går jevnt på øvre dekk"
    assert got["x2"]["garbled"] and "Kühler" in got["x2"]["restored"]
    assert got["x3"]["garbled"] and got["x3"]["lost"] == 1
    assert got["x4"]["restored"] is None and not got["x4"]["garbled"] and not got["x5"]["garbled"] and not got["x6"]["garbled"]
    # f�r may have been für or før; K�hler can only have been Kühler
    words = e.restore_replacement(e.repair_encoding(corpus(spark, [lost + " K�hler"]))).collect()
    assert [(r["word"], r["original"]) for r in words] == [("K�hler", "Kühler")]


def test_counts_are_brute_force(spark):
    d = corpus(spark, [])
    got = {r["pair"]: r["n"] for r in e.pair_counts(d.repartition(3)).collect()}
    a, b = e.SYMBOL_OF[ord("å")], e.SYMBOL_OF[ord(" ")]
    assert got[int(a) * e.SYMBOLS + int(b)] == sum(t.count("å ") for t in CLEAN)
    assert e.SYMBOLS <= 1024


def test_segments_have_the_best_score():
    pairs = np.array([e.SYMBOL_OF[ord(a)] * e.SYMBOLS + e.SYMBOL_OF[ord(b)] for a, b in ("th", "he", "Ã¥")])
    m = e.PairModel(pairs, np.array([5000, 5000, 1]))
    runs = e.improbable_runs("thethÃ¥thethe", m)
    s = e.SYMBOL_OF[e._points("thethÃ¥thethe")]
    score = m.improbable[s[:-1], s[1:]]
    total = [score[a : b - 1].sum() for a, b in runs]
    best = max(score[i:j].sum() for i in range(len(score)) for j in range(i + 1, len(score) + 1))
    assert abs(max(total) - best) < 1e-3


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "chunk_id string, text string, garbled_before int")
    assert e.repair_encoding(empty).count() == 0
    long = "Pumpen gÃ¥r. " * 20000
    got = e.repair_encoding(corpus(spark, [long]).withColumn("n", F.lit(1))).where("chunk_id = 'x0'").first()
    assert got["restored"] == "Pumpen går. " * 20000 and got["n"] == 1


def model_of(df):
    got = e.pair_counts(df).toPandas()
    return e.PairModel(*(got[c].to_numpy(np.int64) for c in ("pair", "n", "apart")))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_runs_cover_little_of_clean_pages_and_all_that_was_garbled(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/tm_chunks.parquet").select("chunk_id", "text")
    m = model_of(d)
    assert (m.improbable * m.n).sum() / m.n.sum() < -3
    bad = {r["chunk_id"] for r in e.repair_encoding(d).where("garbled").collect()}
    clean = covered = 0
    for r in d.collect():
        runs = e.improbable_runs(r["text"], m)
        if r["chunk_id"] not in bad:
            clean += len(r["text"])
            covered += sum(b - a for a, b in runs)
        else:
            for found in e.AS_BYTES.finditer(r["text"]):
                assert any(a <= found.start() and found.end() <= b for a, b in runs)
    assert 0 < covered < 0.05 * clean


def test_a_garbling_of_a_third_of_all_rows_stays_improbable(spark):
    bad = [garble(t, "cp1252") for t in CLEAN[:4]] * 30
    d = corpus(spark, bad)
    got = e.repair_encoding(d).where("garbled").collect()
    assert {r["chunk_id"] for r in got} == {f"x{i}" for i in range(len(bad))}
    assert {r["restored"] for r in got} == set(CLEAN[:4])


@pytest.mark.parametrize(("source", "page"), [("cp1252", "cp850"), ("cp850", "mac_roman"), ("mac_roman", "cp1252"), ("cp437", "mac_roman")])
def test_any_page_can_be_the_source(spark, source, page):
    bad = CLEAN[1].replace("–", "-").encode(source).decode(page)
    got = e.repair_encoding(corpus(spark, [bad])).where("chunk_id = 'x0'").first()
    assert got["garbled"] and got["restored"] == CLEAN[1].replace("–", "-")


def test_undone_as_often_as_it_was_done(spark):
    t = "Pumpen går jevnt"
    bad = t
    for _ in range(5):
        bad = garble(bad, "cp1252")
    assert e.repair_encoding(corpus(spark, [bad])).where("chunk_id = 'x0'").first()["restored"] == t
