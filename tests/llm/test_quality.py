import pytest

from tidemark.llm import quality as q

PROSE = "The relief valve should be checked at the end of each watch, because corrosion can spread to the cylinder head. Keep people clear of the void space while the flange is being lifted."
PARTS = ["drain plug", "thermostat element", "brake band", "fuel injector", "gasket ring", "relay panel"]
CASES = {
    "prose": [PROSE, PROSE.upper(), PROSE.replace(". ", ".\n"), "1. " + PROSE.replace(". ", ".\n2. "), PROSE * 3 + "\n- drain plug\n- brake band", "Wenn das Öl trüb ist, muss der Filter sofort gewechselt werden. Die Pumpe läuft ruhig, aber der Druck fällt nach einer Stunde.", "Verftet har lovet å rette feilen før neste tur. Ventilen på babord side må stenges før arbeidet begynner."],
    "list": ["\n".join(f"- {p}" for p in PARTS), "\n".join(PARTS * 3), "\n".join(f"{i}) {p.title()}" for i, p in enumerate(PARTS)), "INDEX\n" + "\n".join(f"{p}, {i * 7}" for i, p in enumerate(PARTS)), "\n".join(f"[ ] refit {p}" for p in PARTS)],
    "table": ["| Pos | Name |\n|---|---|\n" + "\n".join(f"| {i} | {p} |" for i, p in enumerate(PARTS)), "Qty;Tag;Name\n" + "\n".join(f"{i};V-{i}7;{p}" for i, p in enumerate(PARTS)), "a\tb\n" + "\n".join(f"{i}.5\t{i * 3}" for i in range(8)), "\n---\n".join(f"Pos: {i}\nName: {p}\nReading: {i}.7" for i, p in enumerate(PARTS)), "\n".join(f"{p:<20}{i:<10}{i * 31}" for i, p in enumerate(PARTS))],
    "junk": ["zsrzjptn qdnjqwqjm dvfvdqlt lp lxlkpddb\n" * 3, "9408e8b144d3151b6b13823416f79d3a4a139a9c\n" * 4, "COPY" * 60, "void " * 50, PROSE[::-1], "?#;!|</@\\/!.|=_\n!$_| _<;!_\\ \\#$^" * 3, "HrKzegEXY9btWioLCkwaB9MzItuBl+aTKFseP3c2W2wfVSm+l+6hLgsyE8MFT99Y905/Ad2ShWesRkujK1rOZPqh"],
    "empty": [None, "", " \n "],
}


@pytest.fixture(scope="module")
def got(spark):
    rows = [(f"{k}{i}", t, 1) for k, ts in CASES.items() for i, t in enumerate(ts)]
    filler = [(f"f{i}", PROSE + " " + " and ".join(PARTS), 1) for i in range(40)] + [(f"g{i}", " ".join(CASES["prose"][5:]), 1) for i in range(10)]
    d = spark.createDataFrame(rows + filler, "doc_id string, text string, words_before int")
    return {r["doc_id"]: r for r in q.text_statistics(d).collect()}


@pytest.mark.parametrize("key", [f"{k}{i}" for k, ts in CASES.items() for i in range(len(ts))])
def test_kind(got, key):
    assert got[key]["kind"] == key.rstrip("0123456789"), got[key]


def test_numbers(got):
    r = got["prose0"]
    assert r["words"] == len(PROSE.split()) and r["line_end_punctuation"] == 1.0 and r["lines"] == 1
    assert abs(r["mean_word_length"] - sum(map(len, PROSE.split())) / len(PROSE.split())) < 1e-9
    assert r["symbol_ratio"] == 0 and r["common_word_share"] > 0.3 and got["junk5"]["symbol_ratio"] > 0.5
    assert got["table0"]["alignment"] == 1.0 and got["empty0"]["words"] == 0


def test_counts_are_brute_force(spark):
    long, short = "the pump and the valve are near the Öl tank", "the pump; 24 V"
    d = spark.createDataFrame([("aba ab",), (None,), ("",), (f"{long}\n{short}",), (long,)], "text string").repartition(3)
    got = {(r["kind"], r["word"]): (r["long"], r["short"]) for r in q.corpus_counts(d).collect()}
    words = {k[1]: v for k, v in got.items() if k[0] == "word"}
    # a word counts once a line; what holds marks or digits is no word
    assert words == {**dict.fromkeys("and valve are near öl tank".split(), (2, 0)), "the": (2, 1), "pump": (2, 0), "v": (0, 1), "aba": (0, 1), "ab": (0, 1)}
    n = {int(k[1]): v[0] for k, v in got.items() if k[0] == "pair"}
    t = [" aba ab "] + [f" {x} ".lower().replace("ö", "o") for x in (f"{long}\n{short}", long)]
    assert n[0 * q.LETTERS + 1] == sum(x.count("ab") for x in t) and n[14 * q.LETTERS + 11] == 2
    assert sum(n.values()) == sum(len(x) - 1 for x in t)


FOREIGN = [
    "Przed uruchomieniem pompy należy sprawdzić poziom oleju w zbiorniku. Jeżeli łożysko jest gorące, trzeba zatrzymać silnik i zawiadomić mechanika. Uszczelkę zawsze zakłada się nową.",
    "Перед пуском насоса необходимо проверить уровень масла в баке. Если подшипник горячий, следует остановить двигатель и сообщить механику.",
    "启动泵之前，应检查油箱中的油位。如果轴承过热，必须停止发动机并通知轮机长。过滤器每五百小时更换一次。",
    "Ennen pumpun käynnistämistä on tarkistettava säiliön öljytaso. Jos laakeri on kuuma, moottori on pysäytettävä ja konepäällikölle on ilmoitettava.",
    "Pompayı çalıştırmadan önce tanktaki yağ seviyesi kontrol edilmelidir. Yatak sıcaksa motor durdurulmalı ve mühendise haber verilmelidir.",
]


@pytest.mark.parametrize("text", FOREIGN + [FOREIGN[0].upper(), FOREIGN[0].replace(" i ", "\ni ").replace(" w ", "\nw ")])
def test_a_language_the_corpus_does_not_know_is_prose(spark, text):
    d = spark.createDataFrame([(0, text)] + [(1, PROSE)] * 60, "id int, text string")
    assert q.text_statistics(d).where("id = 0").first()["kind"] == "prose"


def test_common_words_come_from_the_corpus(spark):
    pump, parts = "il est dit que la pompe et la vanne sont en bon ordre", "\n".join(PARTS + ["pompe", "vanne"])
    d = spark.createDataFrame([(t,) for t in [pump, pump + " sans bruit"] * 30 + [parts] * 30 + ["pump " * 40, " ".join(w[::-1] for w in pump.split())]], "text string")
    common = set(q.corpus_model(d)[2])
    assert {"il", "que", "la", "et", "sont"} <= common
    assert not common & {"brake", "tse", "euq", "tnos"}


@pytest.mark.parametrize("fields", [3, 6, 31])
def test_line_autocorrelation_decides_records(spark, monkeypatch, fields):
    text = "\n---\n".join("\n".join(f"{'field' * (1 + k % 3)} {k}: {PARTS[(i + k) % 6] if k % 2 else i * 7}" for k in range(fields)) for i in range(6))
    filler = ["and ".join([PROSE, *PARTS]) + " field fieldfield"] * 40
    m = q.CorpusModel(*q.corpus_model(spark.createDataFrame([(t,) for t in filler], "text string")))
    assert q.statistics(text, m)[-1] == "table"
    # without the evidence of periodic lengths the same lines are a list
    monkeypatch.setattr(q, "_autocorrelation", lambda x: (0.0, 0))
    assert q.statistics(text, m)[-1] == "list"


def test_indent_periodicity_decides_lists(spark, monkeypatch):
    m = q.CorpusModel(*q.corpus_model(spark.createDataFrame([(PROSE + " " + " and ".join(PARTS) + " " + LONG_NAME,)] * 40, "text string")))
    assert q.statistics(STEPPED, m)[-1] == "list"
    monkeypatch.setattr(q, "_autocorrelation", lambda x: (0.0, 0))
    assert q.statistics(STEPPED, m)[-1] == "prose"


def test_autocorrelation_is_brute_force():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (3, 4, 9, 32, 33, 200):
        x = rng.normal(size=n)
        c = x - x.mean()
        want = [float(np.dot(c[k:], c[:-k])) / (n - k) / float((c * c).mean()) for k in range(1, max(1, n // 2) + 1)]
        r, lag = q._autocorrelation(x)
        assert abs(r - max(want)) < 1e-6 and lag == int(np.argmax(want)) + 1
    assert q._autocorrelation(np.ones(5)) == (1.0, 1) and q._autocorrelation(np.ones(2)) == (0.0, 0)


def test_long_words_can_be_read(spark):
    word = "Donaudampfschifffahrtselektrizitätenhauptbetriebswerkbauunterbeamtengesellschaft"
    text = f"Die {word} ist groß und die {word} hat einen Sitz in der alten Stadt."
    d = spark.createDataFrame([(0, text)] + [(1, " ".join(CASES["prose"][5:]))] * 40, "id int, text string")
    r = q.text_statistics(d).where("id = 0").first()
    assert r["kind"] == "prose" and r["readable_share"] > 0.7


def test_empty(spark):
    assert q.text_statistics(spark.createDataFrame([], "doc_id long, text string")).count() == 0


STACKED = "\n".join(f"Position\n{i}\nName\n{p}\nPart number\n{84000 + 7 * i}-{i + 3}" for i, p in enumerate(PARTS, 1))
SPACED = "\n".join(f"V-{i}7 {p} {i * 3} {84000 + i * 31}-8" for i, p in enumerate(PARTS, 1))
LONG_NAME = "stainless cylinder gasket assembly complete flange bolt washer nut bearing housing thermostat element bracket spacer"
STEPPED = "\n".join(f"{LONG_NAME} {p}\n    {LONG_NAME} {p} bracket\n    {LONG_NAME} {p} spacer" for p in PARTS)
CONTENTS = "\n".join(f"{i}.3 {p.title()} ........... {i * 3}" for i, p in enumerate(PARTS, 1))
NUMBERED = "\n".join(f"{i}. {p} 24 V" for i, p in enumerate(PARTS, 1))


@pytest.mark.parametrize("text, kind", [(STACKED, "table"), (SPACED, "table"), (STEPPED, "list"), (CONTENTS, "list"), (NUMBERED, "list"), (STEPPED.replace("    ", ""), "prose")])
def test_shape_of_lines_decides_where_alignment_does_not(spark, text, kind):
    filler = [(PROSE + " " + " and ".join(PARTS) + " " + LONG_NAME,)] * 40
    d = spark.createDataFrame([(text,)] + filler, "text string")
    assert [r["kind"] for r in q.text_statistics(d).where("text not like 'The relief%'").collect()] == [kind]
