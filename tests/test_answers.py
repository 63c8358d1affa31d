import pytest
from pyspark.sql import functions as F

from tidemark import providers
from tidemark.functions import answers as a
from tidemark.operators import layout
from tidemark.sources import tables

FULL = "\n".join(f"###{m}###\n{t}" for m, t in (("FIELD_NOTE_IDS", "3, x, 7"), ("SAFETY_INFO", "none"), ("SHOW_DOCUMENT", ""), ("EXCERPTS_USED", "1,2"), ("ANSWER", "Turn it.")))


def parse(spark, raw):
    return spark.createDataFrame([(raw,)], "r string").select(a.reply_sections(F.col("r")).alias("s")).first()["s"].asDict()


def test_reply(spark):
    assert parse(spark, FULL) == {"field_note_ids": [3, 7], "safety_info": "", "show_excerpts": [], "excerpts_used": [1, 2], "answer": "Turn it."}
    swapped = FULL.replace("###SAFETY_INFO###", "#").replace("###FIELD_NOTE_IDS###", "###SAFETY_INFO###\n###FIELD_NOTE_IDS###")
    for raw in ("no markers", FULL.replace("###ANSWER###", ""), swapped):
        got = parse(spark, raw)
        assert got == {"field_note_ids": [], "safety_info": "", "show_excerpts": [], "excerpts_used": None, "answer": raw}
    # none said is not the same as nothing said
    assert parse(spark, FULL.replace("1,2", "NONE"))["excerpts_used"] == [] == parse(spark, FULL.replace("1,2", ""))["excerpts_used"]
    assert parse(spark, FULL.replace("none", "Wear gloves."))["safety_info"] == "Wear gloves."
    # markers are looked for behind each other; the answer may name one again
    assert parse(spark, FULL + " ###ANSWER### again")["answer"] == "Turn it. ###ANSWER### again"
    assert parse(spark, None)["answer"] is None


def test_kept_excerpts(spark):
    d = spark.createDataFrame([(None,), ([],), ([2],), ([9],)], "u array<int>").withColumn("x", F.array(F.lit("a"), F.lit("b")))
    assert [r[0] for r in d.select(a.kept_excerpts(F.col("u"), F.col("x"))).collect()] == [["a", "b"], [], ["b"], ["a", "b"]]


def expand(spark, t):
    return spark.createDataFrame([(t,)], "t string").select(a.expanded_units(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text, added",
    [
        ("at 220 degrees F", "220°F (104.4°C)"),
        ("-10°F and 300 psi", "-10°F (-23.3°C), 300psi (20.7bar, 2.1MPa)"),
        ("50 ft-lbs", "50lb-ft (67.8N·m)"),
        ("50 foot-pounds", "50lb-ft (67.8N·m), 50ft (15.2m)"),
        ("lbf-ft: 50 lbf-ft, 20 lbft", "50lb-ft (67.8N·m), 20lb-ft (27.1N·m)"),
        ('6" or 2.5 inches', "6in (152.4mm), 2.5in (63.5mm)"),
        ("12 in and 1000 feet", "1000ft (304.8m)"),
        ("9000 psi", "9000psi (620.5bar, 62.1MPa)"),
    ],
)
def test_units_are_expanded(spark, text, added):
    assert expand(spark, text) == f"{text} [{added}]"


def test_texts_without_units_stay(spark):
    assert expand(spark, "valve 12 in, ABC-220") == "valve 12 in, ABC-220" and expand(spark, None) is None and expand(spark, "") == ""
    # half to even on the exact value, no commas
    d = spark.createDataFrame([(0.25,), (0.35,), (1234567.05,), (-0.04,)], "x double")
    assert [r[0] for r in d.select(a.one_decimal(F.col("x"))).collect()] == [f"{x:.1f}" for x in (0.25, 0.35, 1234567.05, -0.04)]


def test_transcripts_and_replies(spark):
    d = spark.createDataFrame([(" read me ",), ("NO_TEXT_FOUND",), ("",), (None,)], "t string")
    assert [r[0] for r in d.select(a.transcript(F.col("t"))).collect()] == [f"{a.TRANSCRIBED}\n\nread me", None, None, None]
    t = spark.createDataFrame([(["one", "NO_TEXT_FOUND", "two"],), (["x"],), (["NO_TEXT_FOUND"],), ([],)], "t array<string>")
    assert [r[0] for r in t.select(a.tiled_transcript(F.col("t"))).collect()] == ["[Tile 1 of 3]\none\n\n[Tile 3 of 3]\ntwo", "x", "", ""]
    j = spark.createDataFrame([('```json\n[{"m": "x"}, {"m": null}]\n```',), ('[{"m": "y"}]',), ("sorry",)], "r string")
    assert [r[0] and [x["m"] for x in r[0]] for r in j.select(a.parsed_items(F.col("r"), "struct<m: string>")).collect()] == [["x", None], ["y"], None]
    assert spark.createDataFrame([("Fuel_ABC_DE12_RevA.pdf",)], "f string").select(a.drawing_number(F.col("f"), "ABC")).first()[0] == "DE12"


def test_labels(spark):
    d = spark.createDataFrame([("Fuel - A very long title of a manual that goes on", "Fuel", "RevA"), ("Other", "Fuel", None)], "t string, s string, r string")
    assert [r[0] for r in d.select(a.short_label(F.col("t"), F.col("s"), F.col("r"))).collect()] == ["A very long title of a manual that goes ...", "Other"]
    n = spark.createDataFrame([("  o'brien mc-donald ",), (None,)], "n string")
    assert [r[0] for r in n.select(a.person_name(F.col("n"))).collect()] == ["O'Brien Mc-Donald", None]
    f = spark.createDataFrame([(None, "up"), ("up", "up"), ("up", "down")], "c string, k string")
    assert [r[0] for r in f.select(a.toggled(F.col("c"), F.col("k"))).collect()] == ["up", None, "down"]
    v = spark.createDataFrame([([1.5, -2.0],)], "v array<float>")
    assert v.select(a.parsed_vector(a.vector_literal(F.col("v")))).first()[0] == [1.5, -2.0]


def test_marked_cells(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 100.0, 20.0, ""), (1, 0, 1, 100.0, 0.0, 200.0, 20.0, "t"), (1, 1, 0, 0.0, 20.0, 100.0, 40.0, None), (1, 1, 1, None, None, None, None, "")], "page int, row_no int, col_no int, x0 double, top double, x1 double, bottom double, text string")
    images = spark.createDataFrame([(1, 45.0, 5.0, 55.0, 15.0), (1, 145.0, 5.0, 155.0, 15.0), (1, 40.0, 35.0, 60.0, 45.0), (2, 45.0, 5.0, 55.0, 15.0), (1, 0.0, 20.0, 25.0, 30.0)], "page int, x0 double, top double, x1 double, bottom double")
    got = {(r["row_no"], r["col_no"]): r["text"] for r in layout.marked_cells(cells, images).collect()}
    assert got == {(0, 0): "X", (0, 1): "t", (1, 0): "X", (1, 1): ""}
    assert layout.marked_cells(cells, images.where("page > 9")).where("text = 'X'").count() == 0


def test_tiles(spark):
    p = spark.createDataFrame([("letter", 612.0, 792.0), ("a0", 2384.0, 3370.0)], "name string, width_pt double, height_pt double")
    t = layout.tiles(p)
    assert t.where("name = 'letter'").count() == 1 and t.where("name = 'a0'").count() == 6
    assert t.where("right - left > 8000 or bottom - top > 8000 or right <= left").count() == 0
    assert p.select(layout.clamped_dpi(F.col("width_pt"), F.col("height_pt")).alias("d")).collect()[1]["d"] == 170


def test_providers(spark):
    assert [(s.start, s.stop) for s in providers.batches([3, 4, 5, 1, 9, 2], 3, 8)] == [(0, 2), (2, 4), (4, 5), (5, 6)]
    assert list(providers.batches([])) == []
    d = spark.createDataFrame([("a", "pump valve"), ("b", "pump valve"), ("c", None), ("d", "")], "k string, text string")
    got = {r["k"]: r["embedding"] for r in providers.with_embeddings(d, providers.embedder(width=8), "k").collect()}
    assert got["a"] == got["b"] and len(got["a"]) == 8 and set(got) == {"a", "b", "d"} and set(got["d"]) == {0.0}
    with pytest.raises(ValueError):
        providers.embedder("other")
    e = spark.createDataFrame([("x", True), ("  ", True), ("y", False), ("z", None)], "text string, has_text_layer boolean")
    assert [r["text"] for r in providers.embeddable(e).collect()] == ["x"]


def test_appended_rows_follow_the_highest_id(spark):
    store = spark.createDataFrame([(7,), (3,)], "id long")
    new = spark.createDataFrame([("b", [1], 2), ("a", None, 1)], "t string, c array<int>, k int")
    assert [tuple(r) for r in tables.appended(store, new, ["k"], ["c"]).orderBy("id").collect()] == [(8, "a", None, 1), (9, "b", "[1]", 2)]
    assert tables.appended(store.where("id > 9"), new, ["k"], []).agg(F.min("id")).first()[0] == 1


def test_tables(spark):
    n = spark.createDataFrame([("f",), ("zz",)], "source_file string")
    s = spark.createDataFrame([("f", 1), ("f", 2), ("g", 3)], "source_file string, c int")
    store, backup, report = tables.reprocessed(s, s, n)
    assert store.count() == backup.count() == 1
    assert {(r["source_file"], r["rows"], r["status"]) for r in report.collect()} == {("f", 2, "removed"), ("zz", 0, "unknown")}
    w = tables.widened(spark.createDataFrame([("c", "x")], "chunk_id string, extra string"), "tm_chunks")
    assert "extra" not in w.columns and w.first()["total_pages"] is None and len(w.columns) == 11
