"""Problem 4: noise in text from scanned pages.

Method. The corpus gives a lexicon: every word with its frequency, words broken at line ends joined first. Rare words
meet frequent ones over a symmetric-delete index (equal strings after up to two deletions, plus one key with look-alike
letters made one): an equi-join, never all pairs. Weighted edit distance keeps the candidates: confusions of recognition
(rn/m, cl/d, c/e, 1/l ...) cost CONFUSION_COST, any other insertion, deletion, substitution or transposition one, and
MOST_COST is the bound. A word that only confusions part from a far more frequent one is misread; one that another edit
parts from it is so only if it is EDIT_RATIO times as rare and the words beside it stand beside the right one elsewhere.
Where several candidates remain, pair counts with the neighbouring words choose. A line is a running header if it stands
at the top or bottom of several pages of its file, read with look-alike letters made one; lines further in count as long
as all lines outside them do. What is misread inside a running header goes with it and is no misread word of the page.
Lines that only number the page are known by their form. A hyphen at a line end is a broken word unless the compound is
the commoner one; one at a page end unless compounds begin with the word at least as often inside lines.

The lexicon is never collected. Tasks hold the SKIP commonest words (a fixed number) to drop them early; every other
word is settled by a join, so the result does not depend on that number. Right words make up LEAST_SHARE of all words, so
there are at most 1 / LEAST_SHARE of them: that bounds the set that tasks hold while pairs are counted.

Null and empty texts have no defect and are repaired to themselves. Repeated rows give repeated defects once per key.
Texts are read whole. Columns beyond key, text, file and page are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.units import _BROKEN, _WHOLE
from ..session import written

#: Commonest words that tasks hold to drop early; a constant, not a cut of the result.
SKIP = 50_000
#: How many times as frequent the right word must be.
RATIO = 12
#: How many times as frequent if more than confusions part them.
EDIT_RATIO = 100
#: Least frequency of a right word, in a small corpus and as a share of all words.
LEAST, LEAST_SHARE = 5, 2e-6
MOST_COST = 1.0
# What recognition makes of letters, as (right, wrong).
CONFUSIONS = [("m", "rn"), ("rn", "m"), ("n", "ri"), ("d", "cl"), ("cl", "d"), ("w", "vv"), ("ll", "U"), ("o", "0"), ("l", "1"), ("i", "l"), ("i", "1"), ("s", "5"), ("g", "9"), ("a", "@"), ("b", "8"), ("e", "c"), ("t", "f"), ("h", "b"), ("z", "2"), ("q", "9"), ("h", "li"), ("k", "lc"), ("g", "q"), ("O", "0")]
CONFUSION_COST = 0.3
_COST = dict.fromkeys([*CONFUSIONS, *((b, a) for a, b in CONFUSIONS)], CONFUSION_COST)
_JOIN = re.compile(r"(?<=[^\W\d_])[-‐­¬][ \t]*\n[ \t]*(?=[a-zß-ÿ])")
# a word takes in what a wrong decoding left inside it, else its ends would look like words
_WORD = re.compile(r"[^\x00-/:-?\[-\^`{-\x7f\s–—‘’“”„…«»‐\xad¬_]+(?:&[^\x00-/:-?\[-\^`{-\x7f\s–—‘’“”„…«»‐\xad¬_]+)*(?:['’][a-z]{1,2}\b)?")
_SPACED = {c: " " for c in range(128) if not (chr(c).isalnum() or chr(c) == "@")}
# capitals with a digit or two that look like letters: a word, not a code
_CAPITALS = re.compile(r"^(?=.{5})(?=(?:[^A-Z]*[A-Z]){3})[A-Z0158]+$")
_LINE_HYPHEN = re.compile(r"[-‐\xad¬][ \t]*\n\s*")
_PLAIN_CODE = re.compile(r"^(?:\d+|[A-Z\d]+|\d+[a-zA-Z]{1,3}|[a-zA-Z]\d+)$")
_BEFORE = re.compile(r"([^\W\d_][\w@]*|[\w@]*[^\W\d_])$")
_AFTER = re.compile(r"[^\W_][\w@]*")
_PAGE_END = re.compile(r"(?<![\w-])([a-zß-ÿ@\d]{2,}|[A-Z][a-zß-ÿ@\d]+)([-‐­¬])[ \t]*$")
_NUMBERED = re.compile(
    r"^\W{0,4}(?:\d{1,4}|[ivxlc]{1,7})\W{0,4}$|^\d{1,4}\s*/\s*\d{1,4}$|^\d{1,3}[-–]\d{1,4}$|^\d{1,4}\s*\|\s*[^\s|][^|]*$|^(?P<w>[^\W\d][\w@1]{2,5}|[pPsS]|5eite)\.?\s*\d{1,4}(?:\s*(?:of|/|von|de|av|0f|ot)\s*\d{1,4})?$"
)
# Marks that the ingestion writes itself, and headings of lists and of sections; a line that ends in brackets
# heads values.
_NO_HEADER = re.compile(r"^\[Transcribed|^\(Table \d|^\||^[┌├└│]|^TABLE OF CONTENTS$|^INDEX$|^Contents$|^\W*\d+(?:\.\d+)+\s|[\[(][^\[\]()]+[\])]$", re.I)


def look_alike(word: str) -> str:
    """The word with letters that recognition confuses made one."""
    w = word.replace("U", "ll") if re.search("[a-z]U|U[a-z]", word) else word
    w = w.lower()
    for a, b in (("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("0", "o"), ("1", "l"), ("5", "s"), ("9", "g"), ("@", "a"), ("8", "b"), ("c", "e"), ("f", "t"), ("i", "l"), ("h", "b")):
        w = w.replace(a, b)
    return w


_NUMBER_WORDS = {look_alike(w) for w in ("page", "seite", "blatt", "side", "sheet", "pag", "página", "folio", "p", "s", "pg")}


def prepared(text: str) -> str:
    """Text with symbols whole again that a wrong decoding broke; hyphens are what matters here."""
    return text if text.isascii() else _BROKEN.sub(lambda m: _WHOLE[m.group()], text)


def joined(text: str) -> str:
    return _JOIN.sub("", text) if _LINE_HYPHEN.search(text) else text


def tokens_of(text: str) -> list[str]:
    """All that _WORD finds; plain texts are split without it."""
    if text.isascii() and "&" not in text and "'" not in text:
        return text.translate(_SPACED).split()
    return _WORD.findall(text)


def as_counted(w: str) -> str | None:
    """A word as it is counted: in lower case unless its case tells something; None for numbers and codes."""
    if "&" in w:
        return w if len(w) <= 5 else w.lower()
    if w.isupper() and len(w) <= 3:
        return w if w.isalpha() else None
    if w.isalpha() and (w.islower() or w.isupper() or w.istitle()):
        return w.lower()
    if _CAPITALS.match(w) and sum(map(str.isdigit, w)) <= 2:
        return w.lower()
    if _PLAIN_CODE.match(w) or w == "@":
        return None
    return w[0].lower() + w[1:] if not re.search("[A-Z]{2}", w) else w.lower()


def words_of(text: str) -> list[str]:
    """Words as counted: broken words joined; numbers and codes left out."""
    return [x for w in tokens_of(joined(text)) if (x := as_counted(w))]


class Rare(dict):
    """Word as written -> word as counted if it is to be looked up, else None. Kept for words already seen."""

    def __init__(self, common: frozenset):
        super().__init__()
        self.common = common

    def __missing__(self, w: str) -> str | None:
        if len(self) > 500_000:
            self.clear()
        x = as_counted(w)
        got = self[w] = None if x is None or x in self.common or len(x) < 2 else x
        return got


def breaks(text: str) -> list[tuple[str, str, str]]:
    """(part before, hyphen, part after) of words that end a line at a hyphen and go on in lower case."""
    out = []
    for m in _LINE_HYPHEN.finditer(text):
        start = max(text.rfind(" ", 0, m.start()), text.rfind("\n", 0, m.start())) + 1
        a, b = _BEFORE.search(text, start, m.start()), _AFTER.match(text, m.end())
        if a and b and (b.group()[0].islower() or b.group()[0].isdigit()):
            out.append((a.group(), m.group()[0], b.group()))
    return out


#: Lines at the top and at the bottom that are looked at in any case.
EDGE = 2


def page_edges(lines: list[str]) -> list[tuple[int, bool, int, str | None]]:
    """(index, is top, place from the edge, form) of the lines at the top and at the bottom of a page: EDGE on either side,
    and on from there while they could be headers or number the page (the form of these is '#'). No line comes twice."""
    out: list[tuple[int, bool, int, str | None]] = []
    if len(lines) < 2:
        return out

    def form(line: str) -> str | None:
        return "#" if numbers_page(line) else header_form(line)

    end, whole = 0, True
    while end < len(lines) and (end < EDGE or whole):
        f = form(lines[end])
        if f is None and end >= EDGE:
            break
        whole = whole and f is not None
        out.append((end, True, end, f))
        end += 1
    whole = True
    for place, i in enumerate(range(len(lines) - 1, end - 1, -1)):
        f = form(lines[i]) if place < EDGE or whole else None
        if f is None and place >= EDGE:
            break
        whole = whole and f is not None
        out.append((i, False, place, f))
    return out


def numbers_page(line: str) -> bool:
    m = _NUMBERED.match(line)
    return bool(m) and (m.group("w") is None or look_alike(m.group("w")) in _NUMBER_WORDS)


def header_form(line: str) -> str | None:
    """The form by which a line is compared from page to page; None for lines that read like sentences or rows."""
    if len(line) < 4 or line[-1] in ".;:,?!":
        return None
    words = [w for w in line.split() if len(w) > 1]
    if not words or sum(w[0].islower() for w in words) * 4 > len(words) or _NO_HEADER.search(line) or numbers_page(line):
        return None
    form = re.sub(r"[^\w]+", "", look_alike(line))
    return form if len(form) >= 4 else None


_COMPOUND = re.compile(r"(?<![^\W_])(?<!-)[^\W\d_]+-[^\W\d_]+(?![^\W_]|-)")


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(kind, word, n) over all texts: 'word' as counted, and 'compound' for hyphenated words inside lines. Tasks count
    first and hand on at most one row per distinct word and flush."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        compounds: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words: Counter = Counter()
            for w, n in total.items():
                if x := as_counted(w):
                    words[x] += n
            out = pa.RecordBatch.from_arrays(
                [pa.array(["word"] * len(words) + ["compound"] * len(compounds), pa.string()), pa.array([*words, *compounds], pa.string()), pa.array([*words.values(), *compounds.values()], pa.int64())],
                names=["kind", "word", "n"],
            )
            total.clear()
            compounds.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                whole = prepared(t)
                total.update(tokens_of(joined(whole)))
                if "-" in t:
                    for w in t.lower().split():
                        if "-" in w[1:-1]:
                            compounds.update(_COMPOUND.findall(w))
            if len(total) + len(compounds) > 300_000:
                yield flush()
        yield flush()

    return df.select(text).where(F.length(text) > 0).mapInArrow(count, "kind string, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))


def _deletes(word: str) -> list[str]:
    """Symmetric-delete keys: up to two characters left out (one in short words), and the look-alike form. Of a long word,
    one character left out of either end: with two edits, one end has no more than one."""
    out = {word, "~" + look_alike(word)}
    n = len(word)
    if n > 24:
        for mark, end in (("^", word[:12]), ("$", word[-12:])):
            out |= {mark + end[:i] + end[i + 1 :] for i in range(12)}
    elif n >= 3:
        one = {word[:i] + word[i + 1 :] for i in range(n)}
        out |= one
        if n >= 6:
            out |= {w[:i] + w[i + 1 :] for w in one for i in range(len(w))}
    return list(out)


def weighted_cost(right: str, wrong: str, most: float = MOST_COST) -> float:
    """Weighted edit distance with insertions, deletions, substitutions and transpositions of neighbours at one and
    confusions of recognition at CONFUSION_COST; 9 if it is more than ``most``."""
    if abs(len(right) - len(wrong)) > most / CONFUSION_COST:
        return 9.0
    n, m = len(right), len(wrong)
    best = [[9.0] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        row = best[i]
        below = best[i + 1] if i < n else None
        for j in range(m + 1):
            d = row[j]
            if d > most:
                continue
            same = below is not None and j < m and right[i] == wrong[j]
            if same and d < below[j + 1]:
                below[j + 1] = d
            if d + 1.0 <= most:
                if below is not None and d + 1.0 < below[j]:
                    below[j] = d + 1.0
                if j < m and d + 1.0 < row[j + 1]:
                    row[j + 1] = d + 1.0
                if not same and below is not None and j < m and d + 1.0 < below[j + 1]:
                    below[j + 1] = d + 1.0
                if i + 1 < n and j + 1 < m and right[i] == wrong[j + 1] and right[i + 1] == wrong[j] and d + 1.0 < best[i + 2][j + 2]:
                    best[i + 2][j + 2] = d + 1.0
            if d + CONFUSION_COST <= most:
                for a in (1, 2):
                    if i + a > n:
                        break
                    for b in (1, 2):
                        if j + b > m:
                            break
                        if (right[i : i + a], wrong[j : j + b]) in _COST and d + CONFUSION_COST < best[i + a][j + b]:
                            best[i + a][j + b] = d + CONFUSION_COST
    return best[n][m] if best[n][m] <= most else 9.0


def least_count(lexicon: DataFrame, least: int = LEAST, share: float = LEAST_SHARE) -> float:
    """How often a right word must occur at least."""
    return max(float(least), share * (lexicon.agg(F.sum("n")).first()[0] or 0))


def corrections(lexicon: DataFrame, ratio: int = RATIO, least: float = LEAST) -> DataFrame:
    """(wrong, right, cost, n_right): all candidates of each misread word within the least cost and a tenth. A candidate
    of cost one or more is one only in context."""

    @F.pandas_udf("array<string>")
    def keys(words: pd.Series) -> pd.Series:
        return words.map(_deletes)

    @F.pandas_udf("double")
    def cost(right: pd.Series, wrong: pd.Series) -> pd.Series:
        return pd.Series([weighted_cost(a, b) for a, b in zip(right, wrong)], dtype="float64")

    words = lexicon.where(F.length("word") > 1)
    most = lexicon.agg(F.max("n")).first()[0] or 0
    right = words.where((F.col("n") >= least) & F.col("word").rlike(r"^[\p{L}'’&]+$")).select(F.col("word").alias("right"), F.col("n").alias("n_right"))
    # a digit inside a word is evidence enough; other words must be far rarer than the right one
    odd = F.col("word").rlike("[0-9@]")
    wrong = words.where(odd | (F.col("n") * ratio <= most)).select(F.col("word").alias("wrong"), F.col("n").alias("n_wrong"), odd.alias("odd"))
    right, wrong = right.withColumn("key", F.explode(keys("right"))), wrong.withColumn("key", F.explode(keys("wrong")))
    near = F.abs(F.length("right") - F.length("wrong")) <= int(MOST_COST / CONFUSION_COST)
    rarer = F.col("n_right") >= F.col("n_wrong") * F.when(F.col("odd"), 1).otherwise(ratio)
    met = wrong.join(right, "key").where(near & rarer & (F.col("wrong") != F.col("right"))).select("wrong", "right", "n_right", "n_wrong").distinct()
    # what came from a wrong decoding is no edit, and another last letter is another form of the word
    stem = [F.expr(f"substr({w}, 1, length({w}) - 1)") for w in ("wrong", "right")]
    ended = (stem[0] == stem[1]) | (stem[0] == F.col("right")) | (stem[1] == F.col("wrong"))
    plain = ~ended & (F.regexp_replace("wrong", r"[\x00-\x7f]", "") == F.regexp_replace("right", r"[\x00-\x7f]", ""))
    scored = met.withColumn("cost", cost("right", "wrong")).where((F.col("cost") < 1.0) | (F.col("cost") <= MOST_COST) & plain & (F.length("wrong") >= 5) & (F.col("n_right") >= F.col("n_wrong") * EDIT_RATIO))
    least_cost = F.min("cost").over(Window.partitionBy("wrong"))  # a word has few candidates
    return scored.withColumn("least", least_cost).where(F.col("cost") <= F.col("least") + 0.1).drop("least", "n_wrong")


SIGNS = "key string, kind string, a string, b string, c string, place int, top boolean"


def signs(df: DataFrame, skip: set[str], key: str, text: str, file: str) -> DataFrame:
    """One row per sign of damage: edge (file, form, line, place from the edge; the form of a page number is '#'), hyphenation
    (certain), hyphen (joined, compound, tail), page_end (word), word (word, before, after; with place and top if it stands
    in an edge line that may be a header)."""
    held = df.sparkSession.sparkContext.broadcast(frozenset(skip))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = Rare(held.value)
        for batch in batches:
            out: list[tuple] = []
            for k, t, f in zip(*(batch.column(i).to_pylist() for i in range(3))):
                t = prepared(t)
                rows = t.split("\n")
                filled = [i for i, x in enumerate(rows) if x.strip()]
                edges = page_edges([rows[i].strip() for i in filled])
                heads = {}
                for i, top, place, form in edges:
                    if form is not None:
                        line = rows[filled[i]].strip()
                        out.append((k, "edge", f, form, line, place, top))
                        if form != "#":
                            heads[filled[i]] = (place, top, line)
                whole = t
                if _LINE_HYPHEN.search(t):
                    for a, h, b in breaks(t):
                        if h != "-":
                            out.append((k, "hyphenation", None, None, None, None, None))
                        else:
                            out.append((k, "hyphen", (a + b).lower(), f"{a}-{b}".lower(), b.lower(), None, None))
                # the last line of the page's own text, with footers left out, may end in a broken word
                foot = {i for i, top, _, form in edges if not top and form is not None}
                last = next((rows[filled[i]].strip() for i in range(len(filled) - 1, -1, -1) if i not in foot), None) if len(filled) > 1 else None
                if last and last[-1] in "-‐\xad¬" and (m := _PAGE_END.search(last)):
                    out.append((k, "hyphenation" if m.group(2) != "-" else "page_end", m.group(1).lower(), None, None, None, None))
                # words of lines that may be headers are told apart from the page's own
                parts = [("\n".join(x for i, x in enumerate(rows) if i not in heads), None, None)] if heads else [(whole, None, None)]
                for part, place, top in [*parts, *((line, place, top) for place, top, line in heads.values())]:
                    seen = tokens_of(joined(part))
                    for i, w in enumerate(seen):
                        x = rare[w]
                        if x is not None:
                            before, after = (as_counted(seen[i - 1]) if i else None), (as_counted(seen[i + 1]) if i + 1 < len(seen) else None)
                            out.append((k, "word", x, before, after, place, top))
            types = [pa.string()] * 5 + [pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], types[i]) for i in range(7)], names=["key", "kind", "a", "b", "c", "place", "top"])

    return df.select(F.col(key).cast("string"), text, file).where(F.length(text) > 0).mapInArrow(look, SIGNS)


def damage(df: DataFrame, key: str = "chunk_id", text: str = "text", file: str = "source_file", page: str = "page_number") -> dict[str, DataFrame]:
    """found(key, defect); and what the repair needs: headers(key, line), fixes(key, wrong, right ...), lexicon."""
    counts = written(word_counts(df, text), "scan-lexicon")
    lexicon = counts.where("kind = 'word'").drop("kind")
    compounds = counts.where("kind = 'compound'").select(F.col("word").alias("compound"), F.col("n").alias("n_compound"))
    least = least_count(lexicon)
    fixes = written(corrections(lexicon, least=least), "scan-corrections")
    wrong = fixes.select(F.col("wrong").alias("word")).distinct()
    top = lexicon.join(wrong, "word", "left_anti").orderBy(F.col("n").desc(), "word").limit(SKIP).collect()  # SKIP words at most
    s = written(signs(df, {r["word"] for r in top if r["n"] >= least}, key, text, file), "scan-signs")
    pages = df.select(F.col(key).cast("string").alias("key"), F.col(page).alias("page"))

    # edge lines that other pages of the file have too, and page numbers; further in, only behind such lines
    lines = s.where("kind = 'edge'").join(pages.dropDuplicates(["key"]), "key")
    repeated = lines.where("b <> '#'").groupBy("a", "b").agg(F.count_distinct("page").alias("pages")).where("pages >= 2").select("a", "b", F.lit(True).alias("again"))
    lines = lines.join(repeated, ["a", "b"], "left").withColumn("sure", (F.col("b") == "#") | F.coalesce("again", F.lit(False)))
    outside = Window.partitionBy("key", "top").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # the edge of one page
    lines = lines.withColumn("run", F.min("sure").over(outside) & (F.count("*").over(outside) == F.col("place") + 1))
    lines = written(lines.where(F.col("sure") & ((F.col("place") < EDGE) | F.col("run"))).select("key", "top", "place", F.col("b").alias("form"), F.col("c").alias("line")), "scan-edges")
    headers = lines.where("form <> '#'").select("key", "line", "top", "place")

    # is the joined word a word, and commoner than the compound?
    h = s.where("kind = 'hyphen'").select("key", "a", "b", "c")
    known = lexicon.select(F.col("word").alias("a"), F.col("n").alias("n_joined"))
    parts = lexicon.select(F.col("word").alias("c"), F.col("n").alias("n_tail"))
    h = h.join(known, "a", "left").join(parts, "c", "left").join(compounds.withColumnRenamed("compound", "b"), "b", "left").fillna(0, ["n_joined", "n_tail", "n_compound"])
    misspelt = fixes.select(F.col("wrong").alias("a"), F.lit(True).alias("fixable")).distinct()
    h = h.join(misspelt, "a", "left")
    broken = h.where((F.col("n_joined") > F.col("n_compound") * 3) | (F.col("n_compound") == 0) & (F.coalesce("fixable", F.lit(False)) | (F.col("n_tail") < least)))
    # how often a word ends a page at a hyphen, against how often compounds begin with it
    starts = compounds.groupBy(F.split("compound", "-")[0].alias("a")).agg(F.sum("n_compound").alias("n_starts"))
    ends = s.where("kind = 'page_end'").select("key", "a")
    own = ends.groupBy("a").agg(F.count("*").alias("n_ends")).join(starts, "a", "left").where(F.coalesce("n_starts", F.lit(0)) < F.col("n_ends"))
    ends = ends.join(own, "a", "left_semi")

    w = s.where("kind = 'word'").select("key", F.col("a").alias("wrong"), F.col("b").alias("before"), F.col("c").alias("after"), "place", "top")
    w = w.join(headers.select("key", "top", "place"), ["key", "top", "place"], "left_anti").drop("top", "place").join(fixes, "wrong")
    words = written(in_context(df, w, text, least), "scan-words")
    found = (
        s.where("kind = 'hyphenation'").select("key", F.lit("hyphenation").alias("defect"))
        .unionByName(lines.select("key", F.when(F.col("form") == "#", "page_number").otherwise("header").alias("defect")))
        .unionByName(broken.select("key", F.lit("hyphenation").alias("defect")))
        .unionByName(ends.select("key", F.lit("hyphenation").alias("defect")))
        .unionByName(words.select("key", F.lit("misread").alias("defect")))
        .distinct()
    )
    return {"found": found.withColumnRenamed("key", key), "headers": headers.select("key", "line"), "fixes": words, "lexicon": lexicon}


def pair_counts(df: DataFrame, among: set[str], text: str = "text") -> DataFrame:
    """(before, word, n): adjacent words over all texts of which one is in ``among``, counted in the tasks first."""
    held = df.sparkSession.sparkContext.broadcast(frozenset(among))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        counted: dict[str, str | None] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["before", "word", "n"])
            total.clear()
            return out

        wanted = held.value
        for batch in batches if wanted else ():
            for t in batch.column(0).to_pylist():
                seen = tokens_of(joined(prepared(t)))
                for w in set(seen):
                    if w not in counted:
                        counted[w] = as_counted(w)
                w = [counted[x] for x in seen]
                near = {i for i, x in enumerate(w) if x in wanted}
                total.update((w[i], w[i + 1]) for i in near | {i - 1 for i in near} if 0 <= i < len(w) - 1 and w[i] and w[i + 1])
                if len(counted) > 500_000:
                    counted.clear()
            if len(total) > 300_000:
                yield flush()
        yield flush()

    return df.select(text).where(F.length(text) > 0).mapInArrow(count, "before string, word string, n long").groupBy("before", "word").agg(F.sum("n").alias("n"))


def in_context(df: DataFrame, words: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """words (key, wrong, before, after, right, cost, n_right) with n_before and n_after: how often the right word stands
    beside the same neighbours. A candidate by another edit than a confusion stays only if every neighbour knows it.

    Pairs are counted around words that compete or need context. They are right words, so at most 1 / LEAST_SHARE of them."""
    several = words.select("wrong", "right", "cost").distinct().groupBy("wrong").agg(F.collect_set("right").alias("rights"), F.max("cost").alias("cost"))  # a word has few
    asked = several.where((F.size("rights") > 1) | (F.col("cost") >= 1.0)).select(F.explode("rights").alias("right")).distinct().collect()
    pairs = written(pair_counts(df, {r["right"] for r in asked}, text), "scan-pairs")
    left = pairs.select("before", F.col("word").alias("right"), F.col("n").alias("n_before"))
    right = pairs.select(F.col("before").alias("right"), F.col("word").alias("after"), F.col("n").alias("n_after"))
    w = words.join(left, ["before", "right"], "left").join(right, ["right", "after"], "left").fillna(0, ["n_before", "n_after"])
    # neighbours that are no words (numbers, codes, the ends of the text) say nothing
    said = F.col("before").isNotNull() | F.col("after").isNotNull()
    known = (F.col("before").isNull() | (F.col("n_before") > 1)) & (F.col("after").isNull() | (F.col("n_after") > 1))
    return w.where((F.col("cost") < 1.0) | said & known)


def chosen_fixes(words: DataFrame) -> DataFrame:
    """(key, wrong, right): for each misread word of a text the candidate with the best cost, context and frequency."""
    score = F.log2(F.col("n_before") + 1) + F.log2(F.col("n_after") + 1) - F.col("cost") * 10
    return words.groupBy("key", "wrong").agg(F.max_by("right", F.struct(score, "n_right", "right")).alias("right"))


def repair(df: DataFrame, key: str = "chunk_id", text: str = "text", file: str = "source_file", page: str = "page_number") -> DataFrame:
    """(key, repaired): damaged pages as continuous paragraphs, without headers and page numbers."""
    d = damage(df, key, text, file, page)
    fixes = chosen_fixes(d["fixes"]).groupBy("key").agg(F.collect_set(F.struct("wrong", "right")).alias("fixes"))  # the words of one text
    heads = d["headers"].groupBy("key").agg(F.collect_set("line").alias("heads"))
    t = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).join(d["found"].select(F.col(key).alias("key")).distinct(), "key", "left_semi")

    @F.pandas_udf(T.StringType())
    def rebuilt(texts: pd.Series, heads: pd.Series, fixes: pd.Series) -> pd.Series:
        return pd.Series([repaired_text(t, set(h) if h is not None else set(), {f["wrong"]: f["right"] for f in x} if x is not None else {}) for t, h, x in zip(texts, heads, fixes)])

    t = t.join(heads, "key", "left").join(fixes, "key", "left")
    return t.select(F.col("key").alias(key), rebuilt("text", "heads", "fixes").alias("repaired"))


def repaired_text(text: str, heads: set[str], fixes: dict[str, str]) -> str:
    t = prepared(text)
    lines = t.split("\n")
    filled = [i for i, x in enumerate(lines) if x.strip()]
    edge = {filled[i] for i, _, place, form in page_edges([lines[i].strip() for i in filled]) if form is not None and (lines[filled[i]].strip() in heads or form == "#" and place < EDGE)}
    lines = [x for i, x in enumerate(lines) if i not in edge]
    t = _JOIN.sub("", "\n".join(lines))

    def swap(m: re.Match) -> str:
        w = m.group()
        good = fixes.get(w.lower()) or fixes.get(w[0].lower() + w[1:])
        if not good:
            return w
        return good.upper() if w.isupper() and len(w) > 1 else good[0].upper() + good[1:] if w[0].isupper() else good

    t = _WORD.sub(swap, t)
    t = re.sub(r"(?<=[.!?:]) [~'`] +(?=[A-ZÄÖÅØÉ])", " ", t)  # specks between sentences
    t = re.sub(r"(?m)^(\d+(?:\.\d+)+ [A-Z][^\n]{2,60})\n(?!\n)", r"\1\n\n", t)
    paragraphs = []
    for block in re.split(r"\n\s*\n", t):
        rows = [x.rstrip() for x in block.split("\n") if x.strip()]
        if any(x.lstrip().startswith(("|", "┌", "├", "└", "│")) or re.search(r"\.{4,}|:\s*[-\d]", x) and len(x) < 50 for x in rows):
            paragraphs.append("\n".join(rows))
        elif rows:
            paragraphs.append(re.sub(r"[ \t]+", " ", " ".join(rows)).strip())
    return "\n\n".join(paragraphs)
