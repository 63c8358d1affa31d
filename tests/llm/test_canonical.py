import pytest
from pyspark.sql import types as T

from tidemark.llm import canonical as c

MAKERS = [(1, "Korvane Marine", ["KRVNM"]), (2, "Quennard Pumps", ["Saltmere Pumps 1903"]), (3, "Belzoro Deck Gear", []), (4, "Børsund Filtration", None), (5, "Sarkholt Works", ["Marl Point Works 1908"])]
CATALOG = [(10, "Korvane Marine", "KE-683"), (11, "Korvane Marine", "KE-683A"), (12, "Quennard Pumps", "QD170/2"), (13, "Belzoro Deck Gear", "FX 40"), (14, "Quennard Pumps", "FX 40"), (15, "Korvane Marine", "12V 330 KR")]


@pytest.fixture(scope="module")
def lists(spark):
    m = spark.createDataFrame(MAKERS, "maker_id long, manufacturer string, also_known_as array<string>")
    k = spark.createDataFrame([(*x, "c", "s") for x in CATALOG], "catalog_id long, manufacturer string, model string, category string, system string")
    return m, k


def test_makers(spark, lists):
    want = {"Korvane Marine": 1, "KORVANE, GmbH": 1, "Koravne": 1, "KorvaneMarine": 1, "Marine / Korvane": 1, "Korvane Mar.": 1, "krvnm": 1, "Saltmere Pumps 1903": 2, "Saltmere Pumps 1908": 0, "Quenard Pumps Ltd": 2, "Deck Gear / Belzoro": 3, "Borsund Filtration": 4, "BOERSUND (Marine Div.)": 4, "Ridgeport Foundry": 0, "N/A": 0, "?": 0, "Korvane Tools": 0, "Sarkholt-Works": 5}
    d = spark.createDataFrame([(v, 1) for v in [*want, None, "  "]], "manufacturer string, id int")
    got = {r["value"]: r["maker_id"] for r in c.canonical_makers(d, "manufacturer", lists[0]).collect()}
    assert got == want


def test_models(spark, lists):
    want = {("KE-6B3", None): 10, ("type: ke 683a", "x"): 11, ("KE-684", None): 0, ("KE-683E", None): 0, ("QDI70/2 (spare)", None): 12, ("FX40", "Belzoro"): 13, ("fx 40", "Quennard Pmups"): 14, ("FX-40", "Korvane Marine"): 0, ("12v330kr", ""): 15, ("OEM", None): 0}
    d = spark.createDataFrame([(m, k) for m, k in [*want, (None, "x"), (" ", None)]], "model string, manufacturer string")
    got = {(r["value"], r["maker_value"]): r["catalog_id"] for r in c.canonical_models(d, "model", "manufacturer", lists[1], lists[0]).collect()}
    assert got == want


def test_together(spark, lists):
    want = {"Korvane Marine KE-683": 10, "KE-683 KorvaneMarine": 10, "KorvaneMarine KE683A": 11, "KRVNM Type: KE-683, as fitted": 10, "Saltmere Pumps 1903 QD1702": 12, "Belzoro Deck Gear FX 4O": 13, "Korvane Marine QD170/2": 0, "Korvane": 0, "Bluegannet WT 1": 0}
    d = spark.createDataFrame([(v,) for v in [*want, None, ""]], "equipment_model string")
    got = {r["value"]: r["catalog_id"] for r in c.canonical_equipment(d, "equipment_model", lists[1], lists[0]).collect()}
    assert got == want


def test_index_finds_what_brute_force_finds(spark, lists):
    import random

    rng = random.Random(3)
    typed = set()
    for _, name, _ in MAKERS:
        word = name.split()[0]
        for _ in range(12):
            i = rng.randrange(1, len(word) - 1)
            typed.add(word[:i] + word[i + 1 :] if rng.random() < 0.5 else word[: i - 1] + word[i] + word[i - 1] + word[i + 1 :])
    d = spark.createDataFrame([(v,) for v in typed], "m string")
    got = {r["value"]: r["maker_id"] for r in c.canonical_makers(d, "m", lists[0]).collect()}
    for v in typed:
        costs = sorted((c.name_cost(v, n, a), i) for i, n, a in MAKERS)
        assert got[v] == (costs[0][1] if costs[0][0] <= 3 else 0), v


def test_distance():
    assert c.weighted_distance("abc", "abc") == 0
    assert c.weighted_distance("korvane", "koravne") == pytest.approx(0.8)
    assert c.weighted_distance("abc", "abcd") == 1 and c.weighted_distance("korvane", "korvanne") == pytest.approx(0.6)


def test_empty(spark, lists):
    d = spark.createDataFrame([], T.StructType([T.StructField("m", T.StringType())]))
    assert c.canonical_makers(d, "m", lists[0]).count() == 0 and c.canonical_equipment(d, "m", lists[1], lists[0]).count() == 0


@pytest.mark.parametrize("typed, entry, fits", [("SEREIS9", "SERIES9", True), ("KE683MKLI", "KE683MKII", True), ("KE683MKIII", "KE683MKII", False), ("KE683MKIIC", "KE683MKII", False), ("KE683MKIIS", "KE683MKIIC", False), ("KF683", "KE683", False), ("KE684", "KE683", False), ("KE6B3", "KE683", True), ("SERIES19", "SERIES9", False), ("SERLES9", "SERIES9", True)])
def test_designations_stand_one_slip_in_long_groups_only(typed, entry, fits):
    assert (c.form_cost(typed, entry) <= 1) is fits
    if fits:
        assert set(c.form_keys(typed)) & set(c.form_keys(entry))


def test_slips_in_models_and_values_of_any_length(spark):
    m = spark.createDataFrame([(1, "Internationalmotorenwerke Hansen", [])], "maker_id long, manufacturer string, also_known_as array<string>")
    k = spark.createDataFrame([(10, "Internationalmotorenwerke Hansen", "SERIES 9"), (11, "Internationalmotorenwerke Hansen", "A-1"), (12, "Internationalmotorenwerke Hansen", "SERIES 9 TYPE 27 FRAME 1234567890")], "catalog_id long, manufacturer string, model string")
    makers = spark.createDataFrame([("Intrnationlmotorenwerke Hansen",), ("Internationalmotornwreke",)], "manufacturer string")
    assert {r["maker_id"] for r in c.canonical_makers(makers, "manufacturer", m).collect()} == {1}
    models = spark.createDataFrame([("SEREIS 9", None), ("B-1", None)], "model string, manufacturer string")
    assert {r["value"]: r["catalog_id"] for r in c.canonical_models(models, "model", "manufacturer", k, m).collect()} == {"SEREIS 9": 10, "B-1": 0}
    both = spark.createDataFrame([("Internationalmotorenwerke Hansen SEREIS-9",), ("SERIES 9 TYPE 27 FRAME 1234567890 Hansen Internationalmotorenwerke",)], "equipment_model string")
    assert sorted(r["catalog_id"] for r in c.canonical_equipment(both, "equipment_model", k, m).collect()) == [10, 12]


def test_few_python_nodes(spark, lists):
    d = spark.createDataFrame([("Korvane", "KE-683")], "manufacturer string, model string")
    e = spark.createDataFrame([("Korvane KE-683",)], "equipment_model string")
    for df in c.canonical(d, e, lists[1], lists[0]).values():
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 0
