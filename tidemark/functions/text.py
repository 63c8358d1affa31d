"""Column builders for text: language tests, lengths, codes, names. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The twenty commonest letter pairs of English, and the rules around them.
COMMON_PAIRS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar")
LEAST_LETTERS = 20
LANGUAGE_RATE = 0.08
REVERSED_FACTOR = 2
# A separator row of a table; codes such as 4367-1 or V-204; numbered headings; parts of a file name.
SEPARATOR_ROW = r"^\|[\s\-|]*\|$"
CODE = r"\b(\d{2,5}\s*-\s*\d{1,4}|[A-Za-z]{1,4}-\d{1,5})\b"
HEADING = r"(?m)^\s*(\d+(?:\.\d+){0,3})\.?\s+([A-Z][A-Za-z0-9 /\-]{2,60})"
FILE_NAME = r"(?i)^([A-Za-z0-9]+)_([A-Za-z0-9]+)_([A-Za-z0-9]+)_([A-Za-z0-9]+)_(Rev[A-Za-z0-9]+)\.pdf$"
COVER_PAGES, COVER_CHARS, HEAD_CHARS, VISION_CHARS = 20, 500, 40, 200


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _rate(letters: Column, pairs: tuple[str, ...]) -> Column:
    # a look-ahead counts pairs that share a letter; pairs of one first letter are one branch
    heads = dict.fromkeys(p[0] for p in pairs)
    hits = F.regexp_count(letters, F.lit("(?=" + "|".join(f"{a}[{''.join(p[1] for p in pairs if p[0] == a)}]" for a in heads) + ")"))
    return F.when(F.length(letters) < LEAST_LETTERS, F.lit(0.0)).otherwise(hits / (F.length(letters) - 1))


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def pair_rate(text: Column) -> Column:
    """Share of adjacent ASCII letter pairs that are among the commonest twenty; 0 for fewer than 20 letters."""
    return _rate(_letters(text), COMMON_PAIRS)


def is_real_language(text: Column) -> Column:
    """False for text that reads backwards: few common pairs, and more than twice as many in reverse."""

    def rule(r: Column) -> Column:
        return F.when(r["ahead"] >= LANGUAGE_RATE, True).when((r["back"] >= LANGUAGE_RATE) & (r["back"] > REVERSED_FACTOR * r["ahead"]), False).otherwise(True)

    turned = tuple(p[::-1] for p in COMMON_PAIRS)
    rates = _bound(_letters(text), lambda x: F.struct(_rate(x, COMMON_PAIRS).alias("ahead"), _rate(x, turned).alias("back")))
    return _bound(rates, rule)


def meaningful_length(text: Column) -> Column:
    """Characters that say something: separator rows and blank lines count nothing, table rows only their cells."""

    def line(raw: Column) -> Column:
        s = strip(raw)
        cells = F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|")
        in_cells = F.aggregate(F.transform(cells, lambda c: F.length(strip(c))), F.lit(0), lambda a, x: a + x)
        return F.when((s == "") | s.rlike(SEPARATOR_ROW), 0).when(s.startswith("|") & s.endswith("|"), in_cells).otherwise(F.length(s))

    return F.aggregate(F.transform(F.split(text, "\n"), line), F.lit(0), lambda a, x: a + x)


def is_navigational(text: Column) -> Column:
    head = F.upper(F.left(strip(text), F.lit(HEAD_CHARS)))
    return head.startswith("TABLE OF CONTENTS") | head.startswith("INDEX")


def is_cover(text: Column, page: Column, total: Column) -> Column:
    return F.coalesce((page == 1) & (total > COVER_PAGES) & (meaningful_length(text) < COVER_CHARS), F.lit(False))


def code_terms(text: Column) -> Column:
    """Distinct codes in order of appearance, without spaces round the hyphen."""
    found = F.regexp_extract_all(text, F.lit(CODE), F.lit(1))
    return F.array_distinct(F.transform(found, lambda c: F.regexp_replace(c, r"\s*-\s*", "-")))


def closed_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, r"\s*-\s*", "-")


def last_heading(text: Column) -> Column:
    """Number and title of the last numbered heading; null if there is none."""
    numbers, titles = F.regexp_extract_all(text, F.lit(HEADING), F.lit(1)), F.regexp_extract_all(text, F.lit(HEADING), F.lit(2))
    return F.when(F.size(numbers) > 0, F.concat_ws(" ", F.element_at(numbers, -1), strip(F.element_at(titles, -1))))


def file_name_parts(name: Column) -> dict[str, Column]:
    """The five parts of a valid file name; all null otherwise."""
    ok = name.rlike(FILE_NAME)
    return {k: F.when(ok, F.regexp_extract(name, FILE_NAME, i)) for i, k in enumerate(("system", "manufacturer", "model", "doc_code", "revision"), 1)}


def chunk_stem(source: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(source, r"(?i)\.pdf$", ""), "[^A-Za-z0-9]+", "_")


def normalized(text: Column) -> Column:
    """Upper-case letters and digits only; null becomes empty."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]", "")


def fingerprint(title: Column, page: Column, text: Column) -> list[Column]:
    return [title.alias("fp_title"), page.alias("fp_page"), F.left(text, F.lit(80)).alias("fp_text")]


def cosine_distance(a: Column, b: Column) -> Column:
    """Null if either vector has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return F.lit(1.0) - F.try_divide(dot, norm(a) * norm(b))
