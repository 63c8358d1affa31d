"""Nulls in every column, empty and very long texts, repeated rows, empty tables, extra columns with clashing names."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.llm import canonical, conversations, encoding, mixing, packing, quality, scans, tokens

LONG = "The relief valve should be checked at the end of each watch. " * 8000
TEXTS = ["plain text of the valve", "plain text of the valve", None, "", " \n\t", LONG, "gÃ¥r", "�", "a" * 50_000, "|" * 3000, "\n" * 3000, "- " * 500, "\x00\x01", "𝄞 ok 𝄞"]


def wide(df, names):
    """df with extra columns of the given names, null in every other row."""
    for n in names:
        df = df.withColumn(n, F.when(F.rand(1) > 0.5, F.lit("x")))
    return df


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(str(i), t, "f.pdf" if i % 2 else None, i if i % 3 else None) for i, t in enumerate(TEXTS)] + [(None, None, None, None), ("0", TEXTS[0], None, None)]
    return spark.createDataFrame(rows, "chunk_id string, text string, source_file string, page_number int")


def test_encoding(texts):
    got = encoding.repair_encoding(wide(texts, ["garbled", "restored", "_fix", "LOST", "n"])).collect()
    assert len(got) == len(TEXTS) + 2
    by = {r["chunk_id"]: r for r in got}
    assert by["6"]["garbled"] in (True, False) and by["7"]["garbled"] and by["7"]["lost"] == 1
    assert by["5"]["restored"] == LONG and by["2"]["restored"] is None and by["0"]["n"] in (None, "x")


def test_quality(texts):
    got = quality.text_statistics(wide(texts, ["words", "Kind", "_s", "n"])).collect()
    assert len(got) == len(TEXTS) + 2
    by = {r["chunk_id"]: r for r in got}
    assert by["2"]["kind"] == by["3"]["kind"] == by["4"]["kind"] == "empty" and by["5"]["kind"] == "prose" and by["8"]["kind"] == "junk"
    assert by["5"]["words"] == len(LONG.split())


def test_scans(texts):
    d = wide(texts, ["key", "kind", "a", "b", "word", "n"])
    found = scans.damage(d)["found"].collect()
    assert len(found) == len(set(found))
    assert scans.repair(d).count() == len({r["chunk_id"] for r in found})


def test_canonical(spark):
    makers = spark.createDataFrame([(1, "Korvane Marine", None), (2, "Quennard Pumps", [])], "maker_id long, manufacturer string, also_known_as array<string>")
    catalog = spark.createDataFrame([(10, "Korvane Marine", "KE-683")], "catalog_id long, manufacturer string, model string")
    rows = [("KE-683", "Korvane"), ("KE-683", "Korvane"), (None, None), ("", " "), ("x" * 3000, "y " * 2000), ("K" * 40 + "E-683", None), ("()", "(,)"), ("KE-683", None)]
    d = wide(spark.createDataFrame(rows, "model string, manufacturer string"), ["value", "id", "rows", "key", "form", "exact"])
    m = {r["value"]: r["maker_id"] for r in canonical.canonical_makers(d, "manufacturer", makers).collect()}
    assert m["Korvane"] == 1 and m["(,)"] == 0 and len(m) == 3
    k = canonical.canonical_models(d, "model", "manufacturer", catalog, makers).collect()
    assert {(r["value"], r["maker_value"]): r["catalog_id"] for r in k}[("KE-683", None)] == 10 and len(k) == 5
    e = canonical.canonical_equipment(d.withColumn("both", F.concat_ws(" ", "manufacturer", "model")), "both", catalog, makers).collect()
    assert {r["value"]: r["catalog_id"] for r in e}["Korvane KE-683"] == 10
    none = makers.where("maker_id > 9")
    assert {r["maker_id"] for r in canonical.canonical_makers(d, "manufacturer", none).collect()} == {0}


def test_conversations(spark):
    s = "id long, conversation_id string, user_name string, role string, content string, created_at timestamp"
    t = datetime(2025, 1, 1)
    rows = [(1, "c", None, "user", LONG, t), (1, "c", None, "user", LONG, t), (2, "c", None, "assistant", LONG, t), (None, "d", None, "user", "q", t), (None, "d", None, "assistant", "a", t.replace(hour=2)), (None,) * 6, (3, None, "u", "user", "q", t), (4, "", "u", "user", "q", t)]
    d = wide(spark.createDataFrame(rows, s), ["speaker", "at", "block", "k", "turn_no", "words", "fit"])
    turns, verdict, _ = conversations.rebuild(d)
    assert {(r["conversation_id"], r["turn_no"]) for r in turns.collect()} == {("c", 1), ("c", 2), ("d", 1), ("d", 2)}
    assert verdict.count() == 2


def test_packing_and_mixing(spark):
    rows = [(i, t, s) for i, (t, s) in enumerate(zip(TEXTS, ["a", None, "a", "b", None, "A ", " ", "c"] * 2))] + [(None, None, None)]
    d = wide(tokens.with_tokens(spark.createDataFrame(rows, "doc_id long, text string, source string")), ["part", "size", "p", "bound", "lane", "class", "share", "rate"])
    b = packing.pack(d, 500)
    assert b.groupBy("block_id").agg(F.sum("size").alias("u")).where("u > 500").count() == 0
    want = d.where("doc_id is not null").agg(F.sum("tokens")).first()[0]
    assert b.agg(F.sum("size")).first()[0] == want
    assert packing.oversize(d, 500).count() == d.where("tokens > 500").count()
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("zz", 0.2, 1)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mixture(d, targets)
    assert mix.where("copies > 2").count() == 0 and report.count() == 3
    assert mixing.mixture(d.where("doc_id < 0"), targets)[0].count() == 0
