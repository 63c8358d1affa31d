import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


PROSE = "The relief valve on the starboard side must be tested before the engine is started and the result entered in the log."


def rate(text):
    letters = [c for c in text.lower() if "a" <= c <= "z"]
    if len(letters) < 20:
        return 0.0
    return sum(a + b in tx.COMMON_PAIRS for a, b in zip(letters, letters[1:])) / (len(letters) - 1)


THIS = "this path of thought had nothing of both hot things and cold things in that thin bath of his"


@pytest.mark.parametrize("text", [PROSE, PROSE[::-1], THIS, THIS[::-1], "xq zv kk pp wq xx vv zz qq jj", "12345 | 678", "ab", ""])
def test_language(spark, text):
    ahead, back = rate(text), rate(text[::-1])
    want = True if ahead >= 0.08 else not (back >= 0.08 and back > 2 * ahead)
    assert one(spark, text, tx.is_real_language) is want
    assert abs(one(spark, text, tx.pair_rate) - ahead) < 1e-12


def test_backwards_text_is_told(spark):
    backwards = "foxht " * 8
    assert rate(backwards) < 0.08 and one(spark, backwards, tx.is_real_language) is False
    assert one(spark, None, tx.is_real_language) in (None, True)


def test_pair_rate_is_brute_force(spark):
    letters = [c for c in PROSE.lower() if "a" <= c <= "z"]
    hits = sum(a + b in tx.COMMON_PAIRS for a, b in zip(letters, letters[1:]))
    assert abs(one(spark, PROSE, tx.pair_rate) - hits / (len(letters) - 1)) < 1e-12


def test_meaningful_length(spark):
    assert one(spark, "| a | bb |\n|---|---|\n|   |   |\n\n  xyz  ", tx.meaningful_length) == 6
    scaffold = "| | | |\n" * 40
    assert len(scaffold) > 200 and one(spark, scaffold, tx.meaningful_length) == 0
    assert one(spark, "", tx.meaningful_length) == 0


def test_navigational(spark):
    assert one(spark, "\n  Table of Contents\n1 x", tx.is_navigational)
    assert one(spark, "INDEX a", tx.is_navigational)
    assert not one(spark, "the index of", tx.is_navigational)


def test_codes(spark):
    assert one(spark, "see 4367 - 1, 4367-1 and V-204; not A1", tx.code_terms) == ["4367-1", "V-204"]
    assert one(spark, "", tx.code_terms) == []


def test_heading(spark):
    assert one(spark, "1.2 First Part\nx\n3 Second Part\ny", tx.last_heading) == "3 Second Part"
    assert one(spark, "4.5.1. Additional Functions\nText", tx.last_heading) == "4.5.1 Additional Functions"
    assert one(spark, "  2. Safety/Care-1\n", tx.last_heading) == "2 Safety/Care-1"
    assert one(spark, "nothing here", tx.last_heading) is None


def test_file_names(spark):
    d = spark.createDataFrame([("Fuel_Maker_X1_OMM_RevA.pdf",), ("fuel_maker_x1_omm_reva.PDF",), ("Fuel_Maker_X-1_OMM_RevA.pdf",), ("Fuel_Maker_OMM_RevA.pdf",), (None,)], "n string")
    got = [r["revision"] for r in d.select(tx.file_name_parts(F.col("n"))["revision"].alias("revision")).collect()]
    assert got == ["RevA", "reva", None, None, None]


def test_cosine(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in d.select(tx.cosine_distance(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, None, None]
    assert duckdb.sql("select list_cosine_distance([1.0, 0.0], [0.0, 2.0])").fetchall()[0][0] == 1.0
