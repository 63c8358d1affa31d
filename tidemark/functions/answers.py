"""Column builders for questions and replies: section parsing, unit hints, labels, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# The five markers of a structured reply, in order.
SECTIONS = ("###FIELD_NOTE_IDS###", "###SAFETY_INFO###", "###SHOW_DOCUMENT###", "###EXCERPTS_USED###", "###ANSWER###")
# Units of questions that are converted for the search: label, how the unit is written behind a number, and
# for each other unit its label and how the number is turned into it.
UNITS = (
    ("°F", r"(?:°\s*F\b|degrees?\s*F\b|deg\.?\s*F\b)", (("°C", lambda x: (x - 32) * 5 / 9),)),
    ("psi", r"psi\b", (("bar", lambda x: x * 0.0689476), ("MPa", lambda x: x * 0.00689476))),
    ("lb-ft", r"(?:lb-?ft\b|ft-?lbs?\b|lbf-?ft\b|foot-?pounds?\b)", (("N·m", lambda x: x * 1.35582),)),
    ("in", r"(?:inches\b|inch\b|\")", (("mm", lambda x: x * 25.4),)),
    ("ft", r"(?:feet\b|foot\b|ft\b(?!-?lbs?\b))", (("m", lambda x: x * 0.3048),)),
)
NUMBER = r"(-?\d+(?:\.\d+)?)\s*"
# What a transcription begins with, and what stands for a page without text.
TRANSCRIBED, NO_TEXT = "[AI-transcribed from a drawing/image — no native text layer on this page]", "NO_TEXT_FOUND"


def reply_sections(raw: Column) -> Column:
    """Struct of a reply: field_note_ids, safety_info, show_excerpts, excerpts_used, answer.

    Each marker is looked for behind the one before. Unless all five are found so, the whole text is the answer, nothing
    was used as far as is known (excerpts_used is null), and the rest is empty. NONE (in any case) is empty too: that
    nothing was used was said then. Parts of a list that are no whole numbers are left out."""
    at: list[Column] = []
    for i, m in enumerate(SECTIONS):
        at.append(F.locate(m, raw) if not i else F.when(at[-1] > 0, F.call_function("locate", F.lit(m), raw, at[-1] + len(SECTIONS[i - 1]))).otherwise(0))
    found = at[-1] > 0

    def section(i: int) -> Column:
        start = at[i] + len(SECTIONS[i])
        end = at[i + 1] if i + 1 < len(SECTIONS) else F.length(raw) + 1
        return tx.strip(F.substr(raw, start, end - start))

    def numbers(s: Column) -> Column:
        parts = F.filter(F.transform(F.split(s, ","), tx.strip), lambda p: p.rlike(r"^\d+$"))
        return F.when(F.upper(s) == "NONE", F.array().cast("array<int>")).otherwise(F.transform(parts, lambda p: p.cast("int")))

    empty = F.array().cast("array<int>")
    return F.struct(
        F.when(found, numbers(section(0))).otherwise(empty).alias("field_note_ids"),
        F.when(found & (F.upper(section(1)) != "NONE"), section(1)).otherwise("").alias("safety_info"),
        F.when(found, numbers(section(2))).otherwise(empty).alias("show_excerpts"),
        F.when(found, numbers(section(3))).alias("excerpts_used"),
        F.when(found, section(4)).otherwise(raw).alias("answer"),
    )


def kept_excerpts(used: Column, excerpts: Column) -> Column:
    """Excerpts an answer shows: all if nothing was said or no number exists, none if the list is empty, else those named
    (from 1)."""
    named = F.filter(excerpts, lambda x, i: F.array_contains(used, i + 1))
    return F.when(used.isNull(), excerpts).when(F.size(used) == 0, named).when(F.size(named) == 0, excerpts).otherwise(named)


def one_decimal(x: Column) -> Column:
    """With one decimal, the double's exact value rounded half to even."""
    return F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))


def unit_hints(text: Column) -> Column:
    """Array of (stated, label, value, targets), in the order of the units and of the text: the number as written, its unit,
    and the same in each other unit as (label, converted)."""

    def of(label: str, targets):
        def one(m: Column) -> Column:
            x = m.cast("double")
            others = F.array(*[F.struct(F.lit(k).alias("label"), f(x).alias("converted")) for k, f in targets])
            return F.struct(m.alias("stated"), F.lit(label).alias("label"), x.alias("value"), others.alias("targets"))

        return one

    return F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(f"(?i){NUMBER}{unit}"), F.lit(1)), of(label, targets)) for label, unit, targets in UNITS])


def expanded_units(text: Column) -> Column:
    """The text with what it states in old units in other units behind it, for search only."""

    def hint(h: Column) -> Column:
        others = F.array_join(F.transform(h["targets"], lambda t: F.concat(one_decimal(t["converted"]), t["label"])), ", ")
        return F.concat(h["stated"], h["label"], F.lit(" ("), others, F.lit(")"))

    hints = F.transform(unit_hints(text), hint)
    return F.when(F.size(hints) > 0, F.concat(text, F.lit(" ["), F.array_join(hints, ", "), F.lit("]"))).otherwise(text)


def transcript(text: Column) -> Column:
    """A transcription with its mark before it; null if the page has no text."""
    s = tx.strip(text)
    return F.when((s != "") & (s != NO_TEXT), F.concat(F.lit(TRANSCRIBED + "\n\n"), s))


def tiled_transcript(tiles: Column) -> Column:
    """One transcription of the tiles of a page, in order; tiles without text are left out, one tile stands for itself."""
    told = F.transform(tiles, lambda t, i: F.when((tx.strip(t) != "") & (tx.strip(t) != NO_TEXT), F.concat(F.lit("[Tile "), (i + 1).cast("string"), F.lit(" of "), F.size(tiles).cast("string"), F.lit("]\n"), tx.strip(t))))
    whole = F.array_join(F.filter(told, lambda t: t.isNotNull()), "\n\n")
    return F.when(F.size(tiles) == 1, F.when(tx.strip(tiles[0]) != NO_TEXT, tx.strip(tiles[0])).otherwise("")).otherwise(whole)


def without_fence(raw: Column) -> Column:
    """A reply without the code fence round it."""
    return tx.strip(F.regexp_replace(tx.strip(raw), r"^```[A-Za-z]*\s*|\s*```$", ""))


def parsed_items(raw: Column, schema: str) -> Column:
    """The array that a reply holds as JSON, in a fence or not; null if it cannot be read."""
    return F.from_json(without_fence(raw), f"array<{schema}>")


def minute_stamp(at: Column) -> Column:
    return F.concat(F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def short_label(title: Column, system: Column, revision: Column, most: int = 40) -> Column:
    """Title without its system, with the revision, cut with dots beyond ``most`` characters."""
    bare = F.when(F.startswith(title, F.concat(system, F.lit(" - "))), F.substr(title, F.length(system) + 4)).otherwise(title)
    full = F.concat(bare, F.coalesce(F.concat(F.lit(" · "), revision), F.lit("")))
    return F.when(F.length(full) > most, F.concat(F.left(full, F.lit(most)), F.lit("..."))).otherwise(full)


def person_name(name: Column) -> Column:
    """Stripped and in title case; a letter after any other character is a capital."""
    parts = F.regexp_extract_all(F.lower(tx.strip(name)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))), "")


def vector_literal(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def parsed_vector(literal: Column) -> Column:
    return F.from_json(literal, "array<float>")


def drawing_number(source: Column, maker: str) -> Column:
    """The number behind a maker's short name in a file name."""
    return F.regexp_extract(source, rf"_{maker}_([A-Z]{{1,2}}\d+)", 1)


def toggled(current: Column, clicked: Column) -> Column:
    """Feedback after a click: the same value again takes it back."""
    return F.when(~current.eqNullSafe(clicked), clicked)
