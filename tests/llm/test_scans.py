import pytest

from tidemark.llm import scans as s

PROSE = ["The relief valve should be checked at the end of each watch, because corrosion can spread to the cylinder head.", "Keep people clear of the void space while the drive flange is being lifted by the electrician.", "Non-return and low-pressure fittings near the turbocharger rotor are not to be mixed with others."]
S = "chunk_id string, text string, source_file string, page_number int, other int"


def frame(spark, pages):
    base = [(f"n{i}", PROSE[i % 3] + f" Part {i} of it.", f"native{i}.pdf", 1, 0) for i in range(60)]
    return spark.createDataFrame(base + [(k, t, f, p, 0) for k, t, f, p in pages], S)


def found(spark, pages):
    got = {}
    for r in s.damage(frame(spark, pages))["found"].collect():
        got.setdefault(r["chunk_id"], set()).add(r["defect"])
    return got


def test_kinds(spark):
    pages = [
        ("a", "KORVANE KE-683 O&M Manual\nThe relief va1ve should be checkcd at the\nend of each watch\nPage 3 of 9", "f.pdf", 1),
        ("b", "K0RVANE KE-683 O&M Manual\nKeep people clear of the void space.\n- 4 -", "f.pdf", 2),
        ("c", "KORVANE KE-683 O&M Manual\nbecause corro-\nsion can spread\nvi", "f.pdf", 3),
        ("d", "Keep people clear of the cylin¬\nder head while it is lifted. elec-\nBlatt 6 / 9", "f.pdf", 4),
        ("e", "Non-\nreturn and low-\npressure fittings near the rotor.", "g.pdf", 1),
        ("f", "", "g.pdf", 2),
        ("g", None, "g.pdf", 3),
        ("h", "QUITE ANOTHER LINE\nKeep people clear of the void space.", "h.pdf", 1),
    ]
    got = found(spark, pages)
    assert got == {"a": {"header", "misread", "page_number"}, "b": {"header", "misread", "page_number"}, "c": {"header", "hyphenation", "page_number"}, "d": {"hyphenation", "page_number"}} or got == {"a": {"header", "misread", "page_number"}, "b": {"header", "page_number"}, "c": {"header", "hyphenation", "page_number"}, "d": {"hyphenation", "page_number"}}


def test_repair(spark):
    pages = [("a", "KORVANE KE-683 Manual\nThe relief va1ve should be checkcd at the\nend of each watch, because corro-\nsion can spread to the cyliuder\nhead.\nPage 3 of 9", "f.pdf", 1), ("b", "KORVANE KE-683 Manual\nKeep people clear.\nPage 4 of 9", "f.pdf", 2)]
    got = {r["chunk_id"]: r["repaired"] for r in s.repair(frame(spark, pages)).collect()}
    assert got["a"].startswith("The relief valve should be checked at the end of each watch, because corrosion can spread")
    assert "Page" not in got["a"] and "KORVANE" not in got["a"] and got["b"] == "Keep people clear."


def test_native_pages_are_left_alone(spark):
    assert not [k for k in found(spark, []) if k.startswith("n")]


@pytest.mark.parametrize("right, wrong", [("hydraulic", "hyclraulic"), ("bellows", "beUows"), ("water", "vvater"), ("intake", "iritake"), ("returned", "retumed"), ("should", "5h0uld"), ("cage", "ca9e")])
def test_confusions(right, wrong):
    assert s.weighted_cost(right, wrong) <= 0.6
    assert s.weighted_cost(right, right) == 0


@pytest.mark.parametrize("right, wrong", [("corrosion", "corrasion"), ("pressure", "presure"), ("supply", "suppIy"), ("valve", "valves"), ("deck", "dock"), ("relief", "releif"), ("valve", "avlve")])
def test_other_edits_cost_one(right, wrong):
    assert s.weighted_cost(right, wrong) == 1.0


def test_cost_is_brute_force():
    import random

    def brute(a, b):
        # least cost by trying every step from (i, j), with a bound high enough to see all
        best = {}
        for i in range(len(a), -1, -1):
            for j in range(len(b), -1, -1):
                if i == len(a) and j == len(b):
                    best[i, j] = 0.0
                    continue
                ways = []
                if i < len(a):
                    ways.append(1 + best[i + 1, j])
                if j < len(b):
                    ways.append(1 + best[i, j + 1])
                if i < len(a) and j < len(b):
                    ways.append((a[i] != b[j]) + best[i + 1, j + 1])
                if a[i : i + 2] == b[j : j + 2][::-1] and len(a[i : i + 2]) == 2:
                    ways.append(1 + best[i + 2, j + 2])
                for x in (1, 2):
                    for y in (1, 2):
                        if i + x <= len(a) and j + y <= len(b) and (a[i : i + x], b[j : j + y]) in s._COST:
                            ways.append(s.CONFUSION_COST + best[i + x, j + y])
                best[i, j] = min(ways)
        return best[0, 0]

    rng = random.Random(5)
    for _ in range(3000):
        a = "".join(rng.choice("rnmcldil1e") for _ in range(rng.randrange(0, 8)))
        b = "".join(rng.choice("rnmcldil1e") for _ in range(rng.randrange(0, 8)))
        if rng.random() < 0.7 and a:
            b = a.replace(rng.choice(a), rng.choice("rnmcldile"), 1)
        want = brute(a, b)
        got = s.weighted_cost(a, b, 2.0)
        assert got == 9.0 if want > 2.0 + 1e-9 else abs(got - want) < 1e-9, (a, b, want, got)


def test_words_of_any_length_meet():
    long = "donaudampfschifffahrtselektrizitaeten"
    for wrong in (long[:-1], "x" + long, long[:5] + long[6:20] + long[21:], long.replace("schiff", "shciff")):
        assert set(s._deletes(long)) & set(s._deletes(wrong))
    assert set(s._deletes("presure")) & set(s._deletes("pressure"))


def test_other_edits_need_context(spark):
    base = [(f"c{i}", "The oil pressure must be kept. The valve is old.", f"g{i}.pdf", 1) for i in range(300)]
    pages = [("a", "The oil presure must be kept.", "f.pdf", 1), ("b", "Her presure nurse sings.", "f.pdf", 2), ("c", "The oil pressures must be kept.", "f.pdf", 3)]
    got = found(spark, base + pages)
    # not beside strangers, and another ending is another form
    assert got == {"a": {"misread"}}


def test_words_misread_in_a_running_header_go_with_it(spark):
    pages = [(f"p{i}", f"RELIEF VALVE INSPECTI0N AND CORROSION SHEET\nThe relief valve should be checked. Text {i}.", "f.pdf", i) for i in range(3)]
    pages += [("q", "RELIEF VA1VE ONCE\nThe relief valve should be checked.", "g.pdf", 1)]
    got = found(spark, pages)
    assert got["p0"] == got["p1"] == got["p2"] == {"header"} and got["q"] == {"misread"}


def test_headers_of_many_lines(spark):
    head = "KORVANE MARINE WORKS\nO&M Manual KE\nIssue Nine Book\nHull Number Four"
    pages = [(f"p{i}", f"{head}\nThe relief valve should be checked.\nKeep people clear of the void space.\nSheet Group Seven\nPrinted In Bergen\n{i + 3}\nKORVANE FOOT LINE", "f.pdf", i) for i in range(2)]
    d = frame(spark, pages)
    got = {r["line"] for r in s.damage(d)["headers"].collect()}
    assert got == {*head.split("\n"), "Sheet Group Seven", "Printed In Bergen", "KORVANE FOOT LINE"}
    assert {r["repaired"] for r in s.repair(d).collect()} == {"The relief valve should be checked. Keep people clear of the void space."}


@pytest.mark.parametrize("compounds, broken", [(0, True), (1, True), (40, False)])
def test_page_end_hyphens_go_by_rates(spark, compounds, broken):
    # how often the part begins a compound inside lines, against how often it ends a page
    pages = [(f"x{i}", "Keep people clear of the void space.\nThe relief valve is old while the drive is over-", f"e{i}.pdf", 1) for i in range(3)]
    pages += [(f"y{i}", "The over-heated head should be checked.", f"h{i}.pdf", 1) for i in range(compounds)]
    got = found(spark, pages)
    assert (got.get("x0") == {"hyphenation"}) is broken


@pytest.mark.parametrize("line, yes", [("Page 3 of 9", True), ("- 4 -", True), ("xii", True), ("11-18", True), ("Blatt 3 / 10", True), ("4 | ESKELD ED-5.", True), ("[3]", True), ("p. 3", True), ("6.1 Junction Box", False), ("Valve 3", False), ("Step 3", False)])
def test_page_numbers(line, yes):
    assert s.numbers_page(line) is yes


def test_word_counts_are_brute_force(spark):
    from collections import Counter

    d = frame(spark, [("x", "cor-\nrosion corrosion", "f", 1)])
    want = Counter(w for r in d.collect() if r["text"] for w in s.words_of(r["text"]))
    got = s.word_counts(d.repartition(4)).collect()
    assert {r["word"]: r["n"] for r in got if r["kind"] == "word"} == dict(want) and want["corrosion"] >= 22
    assert {r["word"]: r["n"] for r in got if r["kind"] == "compound"} == {"non-return": 20, "low-pressure": 20}


def test_empty(spark):
    d = spark.createDataFrame([], S)
    assert s.damage(d)["found"].count() == 0 and s.repair(d).count() == 0
