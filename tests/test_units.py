import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import units


def values(text):
    return sorted((q, u, round(v, 3)) for q, u, v, *_ in units.resolve(units.text_statements(text)))


@pytest.mark.parametrize(
    "text, expected",
    [
        ("at 220 degrees F now", [("temperature", "°F", 104.444)]),
        ("kit AC-220PSI-B and code ABC-220F", []),
        ("between 10 and 300 psi here", [("pressure", "psi", 68.948), ("pressure", "psi", 2068.427)]),
        ("53-278°F", [("temperature", "°F", 11.667), ("temperature", "°F", 136.667)]),
        ("is -10 °F.", [("temperature", "°F", -23.333)]),
        ('a stroke of 3 1/4" (L)', [("length", "in", 82.55)]),
        ("6¾ in. of", [("length", "in", 171.45)]),
        ("There are 9 in the box and 12 in the store", []),
        ("1,500 lbs", [("mass", "lb", 680.389)]),
        ("beträgt 1\xa0148 PS (P)", [("power", "PS", 844.353)]),
        ("4,3 m (L)", [("length", "m", 4300.0)]),
        ("98 Â°F and 41 ┬░F", [("temperature", "°F", 5.0), ("temperature", "°F", 36.667)]),
        ("7 gal\xadlons left", [("volume", "gal", 26.498)]),
        ("7 gal­\nlons left", [("volume", "gal", 26.498)]),
        ("33 horsep0wer", [("power", "hp", 24.608)]),
        ("It runs at 489 rpm on a 24 V supply", []),
        ("", []),
    ],
)
def test_text(text, expected):
    got = values(text)
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert all(abs(a[2] - b[2]) < 0.01 for a, b in zip(got, expected))


def test_unit_once_for_several():
    block = "(flow figures: L/s)\nValve: 4\nCooling jacket: 53.3\n\nOther: 9"
    assert values(block) == [("flow", "L/s", 240.0), ("flow", "L/s", 3198.0)]
    assert [(q, u, round(v, 1)) for q, u, v in values("TEST PRESSURE [kgf/cm²]\nA ..... 2\nB .... 3")] == [("pressure", "kgf/cm²", 196.1), ("pressure", "kgf/cm²", 294.2)]
    table = "| Item | Pressure (psi) |\n|---|---|\n| 1 | 10 |\n| 2 | 20 |"
    assert [v[1] for v in values(table)] == ["psi", "psi"]


def test_identities_choose_the_unit():
    # 6 imperial gallons are 27.3 litres, 6 US gallons 22.7
    imperial = units.resolve(units.text_statements("holds 600 gal (2728 L)"))
    assert imperial[0][1] == "gal (imp)" and imperial[0][4]
    us = units.resolve(units.text_statements("holds 600 gal (2271 L)"))
    assert us[0][1] == "gal" and us[0][4]
    alone = units.resolve(units.text_statements("holds 600 gal"))
    assert alone[0][1] == "gal" and not alone[0][4]
    # power = torque x angular speed gives a number without unit its unit
    specs = {"output": "314.16", "rated_torque": "2000 Nm", "rpm": "1500"}
    got = {q: (u, where) for q, u, _, where, *_ in units.resolve(units.spec_statements(specs, None))}
    assert got["power"] == ("kW", "inferred")
    assert not units.resolve(units.spec_statements({"output": "314.16"}, None))


def test_specs():
    specs = {"max_temp_degf": "-4", "hp": "80", "flow": "29", "bore": 'max 29.8"', "hose_length_in_ft": "2", "quantity": "3", "voltage": "230V", "x": None}
    got = sorted((q, u, w) for q, u, _, w, *_ in units.resolve(units.spec_statements(specs, "All flows in gpm. painted over")))
    assert got == [("flow", "gpm", "note"), ("length", "ft", "key"), ("length", "in", "number"), ("power", "hp", "key"), ("temperature", "°F", "key")]


def test_frames(spark):
    t = spark.createDataFrame([("a", "12 psi and 12 psi", 1), ("b", None, 2), ("c", "", 3), ("d", "5 kPa", 4)], "chunk_id string, text string, value int")
    targets = spark.createDataFrame([("pressure", "kPa"), ("mass", "kg")], "quantity string, common_unit string")
    got = units.converted(units.text_quantities(t, "chunk_id"), targets).collect()
    assert [tuple(r) for r in got] == [("a", "pressure", 83)]
    v = spark.createDataFrame([(1, {"weight_lbs": "10"}, None), (2, None, "Flows: gpm."), (3, {}, None)], T.StructType([T.StructField("id", T.LongType()), T.StructField("specs", T.MapType(T.StringType(), T.StringType())), T.StructField("notes", T.StringType())]))
    assert [tuple(r) for r in units.converted(units.spec_quantities(v, "id"), targets).collect()] == [("1", "mass", 5)]
    assert units.spec_quantities(v.where("id > 9"), "id").count() == 0
    assert spark.range(1).select(units.nearest(F.lit(2.5)).alias("n")).first()["n"] == 2


def test_round_trip():
    for unit, (quantity, factor, offset) in units.UNITS.items():
        text = next((s for s in units.SPELLINGS.get(unit, "").split("|") if s), None)
        if text:
            assert units.unit_of(text) == unit, (unit, text)
            assert abs(units.to_common(unit, 7 / factor - offset) - 7) < 1e-9


def test_edges(spark):
    rows = [("a", "12 psi", "x"), ("a", "12 psi", None), (None, "3 psi", "x"), ("l", "At 12 psi. " * 20_000, "x"), ("n", "9" * 400 + " psi", "x"), ("s", "5/0 in. and 1 1/0 in.", "x"), ("m", "\n".join("| 1 | 2 |" for _ in range(3000)), "x")]
    d = spark.createDataFrame(rows, "chunk_id string, text string, unit string").withColumn("quantity", F.lit("q")).withColumn("value", F.lit(1)).withColumn("s", F.lit(1))
    targets = spark.createDataFrame([("pressure", "kPa")], "quantity string, common_unit string")
    got = units.converted(units.text_quantities(d, "chunk_id"), targets)
    assert {(r[0], r[2]) for r in got.collect()} == {("a", 83), (None, 21), ("l", 83)}
    empty = d.where("chunk_id = 'zz'")
    assert units.text_quantities(empty, "chunk_id").count() == 0


def test_many_open_statements_are_solved_apart():
    # ten dual statements of one record, each an imperial gallon: more than eight open ones
    said = [s for g in range(1, 11) for s in (("gal", 10.0 * g, g, "number"), ("L", 45.4609 * g, g, "number"))]
    assert [r[1] for r in units.resolve(said)] == ["gal (imp)", "L"] * 10


def test_one_large_set_of_open_statements_is_solved_exactly():
    said = [("gal", 10.0, 1, "number") for _ in range(14)] + [("L", 45.4609, 1, "number")]
    assert [r[1] for r in units.resolve(said)] == ["gal (imp)"] * 14 + ["L"]


def test_speed_of_a_text_ties_power_and_torque(spark):
    d = spark.createDataFrame([("a", "The engine gives 100 hp at 1500 rpm and a torque of 468.2 N·m."), ("b", "The engine gives 100 hp and a torque of 468.2 N·m.")], "chunk_id string, text string")
    got = {(r["record_id"], r["quantity"]): r["unit"] for r in units.text_quantities(d, "chunk_id").collect()}
    assert got["a", "power"] == "PS" and got["b", "power"] == "hp"


def test_a_dual_statement_does_not_switch_identities_off():
    # 660.2 N·m at 1500 rpm are 141 PS, and 468.2 are 100 PS
    said = [("hp", 141.0, 1, "number"), ("PS", 141.0, 1, "number"), ("N·m", 660.2, 2, "number"), ("rpm", 1500.0, 0, "number")]
    assert units.resolve(said)[0][1] == "PS"
    ranged = [("N·m", 468.2, 2, "number"), ("hp", 100.0, 1, "number"), ("hp", 80.0, -1, "number"), ("rpm", 1500.0, 0, "number")]
    assert units.resolve(ranged)[1][1] == "PS"
