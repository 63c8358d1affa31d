"""Problem 8: statistics of each document's text, and whether it is prose, a list, a table or junk.

Method. Lines are examined for vertical delimiter alignment (the same number of the same delimiter, or columns that
start at the same place), for indentation periodicity and for the autocorrelation of line lengths (records repeat their
shape). These meet word, symbol and punctuation ratios. What is a common word, and what reads as a word at all, the corpus
says itself: in one pass over every document words are counted in long lines and in short ones, and letter pairs inside
words. Common words are those that make up COMMON_SHARE of the words of long lines (each counted once a line) and are COMMON_ODDS times as frequent
there as in short ones, so no language is built in and there are at most 1 / COMMON_SHARE of them.

A document is prose if most of its characters stand in sentences: lines with enough common words, or, where the corpus does
not know the language, paragraphs that end in sentence marks and have words enough between them. It is junk if it is not
prose and neither its words nor its numbers can be read; otherwise a table if its lines align, or if their lengths repeat
with a period at which labels or shapes recur, or if they are rows of one shape; and a list if not, or if its indentation
is periodic.

Null and blank texts get kind 'empty' and zero statistics. Very long texts are read whole. Repeated rows give repeated
results; other columns pass, except that columns named like a statistic are replaced by it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

#: Least share of the words of long lines that a common word has, how much more frequent it is there than in short lines,
#: and of how many words a long line is.
COMMON_SHARE, COMMON_ODDS, LONG_LINE = 1e-4, 4.0, 8
# Delimiters of columns.
DELIMITERS = ("|", "\t", ";")
STATS = T.StructType(
    [
        T.StructField("words", T.IntegerType()),
        T.StructField("mean_word_length", T.DoubleType()),
        T.StructField("symbol_ratio", T.DoubleType()),
        T.StructField("line_end_punctuation", T.DoubleType()),
        T.StructField("common_word_share", T.DoubleType()),
        T.StructField("lines", T.IntegerType()),
        T.StructField("alignment", T.DoubleType()),
        T.StructField("indent_periodicity", T.DoubleType()),
        T.StructField("line_autocorrelation", T.DoubleType()),
        T.StructField("prose_share", T.DoubleType()),
        T.StructField("readable_share", T.DoubleType()),
        T.StructField("kind", T.StringType()),
    ]
)
LETTERS = 28  # a to z without accents, any other Latin letter, word boundary
_WORD = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"(?<![^\W_])\d{1,9}(?![^\W_])")
_END = re.compile(r"[.!?:;…。！？।][\"'”’»)\]]*\s*$")
_MARKS, _CLOSERS = ".!?:;…。！？।", "\"'”’»)]"
# the end of a sentence: its mark after a letter, or one of the marks that need no space
_SENTENCE = re.compile(r"[^\W\d_][\"'”’»)\]]*[.!?…][\"'”’»)\]]*(?=\s|$)|[。！？।؟]")
_FOREIGN = re.compile(r"[^\W\d_\x00-\u024f]")
_BLANK = re.compile(r"\n\s*\n")
# What stands before an entry; from where a series of lines counts as periodic, a length alone as steady, rows
# and lines a period apart as of one shape, and how many lines recur word for word if labels stand on lines of their own.
_LEAD = re.compile(r"^\s*(?:[-*•·–]|\[.?\]|\(?\w{1,3}[.)]|\d+(?:\.\d+)+(?=\s+[^\W\d_]))\s+")
PERIODIC, RECORDS, STEADY, ROW_SHARE, SAME_SHAPE, LABELS_RECUR = 0.3, 0.6, 0.7, 0.7, 0.8, 0.3
# Marks that ordinary text has.
_USUAL = "|.,;:-()/'’\"“”…—–•[]+%°"
_SPACE = b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
_NOT_ALNUM = bytes(b for b in range(256) if not (chr(b).isalnum() and b < 128))
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_NOT_ODD = bytes(b for b in range(128) if chr(b).isalnum() or chr(b) in _USUAL or b in _SPACE)
_LETTERS_OR_SPACE = bytes(b if b < 128 and chr(b).isalpha() else 32 for b in range(256))
_ALNUM_OR_SPACE = bytes(b if b < 128 and chr(b).isalnum() else 32 for b in range(256))
_LABEL = re.compile(r"^\s*([^\W\d_][\w .\-/]{0,28}?)\s*[:=]\s*(.{0,60})$")
_GAP = re.compile(r"\S(?: {2,}|\t+)(?=\S)")
_BULLET = re.compile(r"^\s*(?:[-*•·–]|\[[ xX]\]|\(?\d{1,3}[.)]|\d+(?:\.\d+)+|[a-z][.)])\s+")


def _letter_table() -> np.ndarray:
    t = np.full(0x110000, 27, np.uint8)
    for i in range(26):
        t[97 + i] = i
        t[65 + i] = i
    for c in range(0xC0, 0x250):
        if chr(c).isalpha():
            base = {"ø": "o", "ı": "i", "ł": "l", "đ": "d", "ß": "s", "æ": "a"}.get(chr(c).lower()) or unicodedata.normalize("NFKD", chr(c))[0].lower()
            t[c] = ord(base) - 97 if "a" <= base <= "z" else 26
    return t


def _class_table() -> np.ndarray:
    """1 for letters and what else a word has, 2 for digits, 0 for all other characters; beyond the basic plane only the
    ideographs are letters."""
    t = np.zeros(0x110000, np.uint8)
    t[:0x10000] = [(2 if c.isdecimal() else 1) if c.isalnum() else 0 for c in map(chr, range(0x10000))]
    t[0x20000:0x33480] = 1
    return t


_LETTER, _CLASS = _letter_table(), _class_table()
_VOWEL = np.isin(np.arange(LETTERS), [ord(c) - 97 for c in "aeiouy"])
COUNTS = "kind string, word string, long bigint, short bigint"


def corpus_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(kind, word, long, short): 'pair' rows count letter pairs inside words (word is left * LETTERS + right), at most
    LETTERS^2 of them; 'word' rows count how many long lines and how many others have a word without marks or digits. Every document is
    counted; tasks count first and hand on at most one row for each distinct word and flush."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(LETTERS * LETTERS, np.int64)
        long: Counter = Counter()
        short: Counter = Counter()

        def flush(last: bool) -> pa.RecordBatch:
            words = [w for w in {**long, **short} if w.isalpha()]
            at = np.flatnonzero(pairs).tolist() if last else []
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(["word"] * len(words) + ["pair"] * len(at), pa.string()),
                    pa.array(words + [str(k) for k in at], pa.string()),
                    pa.array([long[w] for w in words] + [int(pairs[k]) for k in at], pa.int64()),
                    pa.array([short[w] for w in words] + [0] * len(at), pa.int64()),
                ],
                names=["kind", "word", "long", "short"],
            )
            long.clear()
            short.clear()
            return out

        for batch in batches:
            for value in batch.column(0).to_pylist():
                s = _LETTER[np.frombuffer(f" {value} ".encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
                pairs += np.bincount(s[:-1] * LETTERS + s[1:], minlength=pairs.size)
                for x in value.lower().splitlines():
                    w = x.split()
                    # each word once a line: a stamp that fills a page is no language
                    (long if len(w) >= LONG_LINE and "|" not in x and ";" not in x and "\t" not in x else short).update(set(w))
            if len(long) + len(short) > 300_000:
                yield flush(False)
        yield flush(True)

    return df.select(text).where(F.length(text) > 0).mapInArrow(count, COUNTS).groupBy("kind", "word").agg(F.sum("long").alias("long"), F.sum("short").alias("short"))


def common_words(counts: pd.DataFrame, long: int, short: int) -> list[str]:
    """Words of counts (word, long, short) that are common; a word that is ten times as frequent from behind is none."""
    n = dict(zip(counts["word"], counts["long"]))
    rare = dict(zip(counts["word"], counts["short"]))
    often = [w for w, k in n.items() if k >= COMMON_SHARE * long and k / max(1, long) >= COMMON_ODDS * (rare[w] + 0.5) / max(1, short)]
    return sorted(w for w in often if n.get(w[::-1], 0) < 10 * n[w])


class Readable(dict):
    """Word -> the letters of it that can be read: all or none. Kept for words already seen."""

    def __init__(self, model: "CorpusModel"):
        super().__init__()
        self.model = model

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        k = len(w)
        foreign = len(_FOREIGN.findall(w))
        # letter pairs speak for Latin letters only: a word of other letters is taken as read, one of both is not, nor is
        # one word written three times or more without a space
        good = False if k >= 9 and (w + w).find(w, 1) * 3 <= k else foreign == k if foreign else (w.isupper() or w.lower() in self.model.common) if k <= 2 else self.model.fit(w) > -5.2
        got = self[w] = k * good
        return got


class Turned(Readable):
    """Word -> by how many bits its letters fit better from behind."""

    def __missing__(self, w: str) -> float:
        if len(self) > 200_000:
            self.clear()
        got = self[w] = (self.model.fit(w[::-1]) - self.model.fit(w)) * len(w)
        return got


class CorpusModel:
    def __init__(self, pairs, counts, common=()):
        n = np.full(LETTERS * LETTERS, 0.5)
        n[np.asarray(pairs, np.int64)] += np.asarray(counts, float)
        n = n.reshape(LETTERS, LETTERS)
        n[27, 27] = 0.5
        self.bits = np.log2(n / n.sum(axis=1, keepdims=True)).astype(np.float32)
        self.known: dict[str, float] = {}
        self.common = frozenset(common)
        self.readable, self.turned = Readable(self), Turned(self)

    def fit(self, word: str) -> float:
        """Mean bits of a letter given the one before it, boundaries included; natural words lie above -5."""
        got = self.known.get(word)
        if got is None:
            s = _LETTER[np.frombuffer(f" {word} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
            got = float(self.bits[s[:-1], s[1:]].mean())
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = got
        return got


def _autocorrelation(x: np.ndarray) -> tuple[float, int]:
    """The largest autocorrelation over lags up to half the series, and its lag; 1 at lag 1 for a constant series of three
    or more."""
    n = len(x)
    if n < 3:
        return 0.0, 0
    x = x - x.mean()
    var = float((x * x).mean())
    if var < 1e-9:
        return 1.0, 1
    most = max(1, n // 2)
    if n <= 32:
        r = np.correlate(x, x, "full")[n : n + most]
    else:
        size = 1 << (2 * n - 1).bit_length()
        f = np.fft.rfft(x, size)
        r = np.fft.irfft(f * np.conj(f), size)[1 : most + 1]
    r = r / np.arange(n - 1, n - 1 - most, -1)
    k = int(np.argmax(np.round(r, 9)))
    return float(r[k]) / var, k + 1


def _shape(line: str) -> str:
    """Fields of a line: N for each value with a digit, W for each run of words; a bullet or a number of the line is none."""
    fields = "".join("N" if any(map(str.isdigit, w)) else "W" for w in _LEAD.sub("", line).split())
    return re.sub("W+", "W", fields)


def _label(line: str) -> str:
    m = _LABEL.match(line) if ":" in line or "=" in line else None
    return m.group(1).lower() if m else " ".join(line.split()).lower()


def _records(lines: list[str], line_auto: float, lag: int) -> bool:
    """Whether the lines are records: line lengths of period ``lag`` at which labels recur, or lines that are words or a
    value by turns; or rows of three or more fields in one shape, two of them values."""
    n = len(lines)
    if n < 4:
        return False
    shapes = [_shape(x) for x in lines]
    shape, often = Counter(shapes).most_common(1)[0]
    if often >= ROW_SHARE * n and len(shape) >= 3 and shape.count("N") >= 2 and "W" in shape:
        return True
    if line_auto < PERIODIC or lag < 2 or n < 2 * lag:
        return False
    at = range(lag, n)
    labels = [_label(x) for x in lines]
    again = sum(labels[i] == labels[i - lag] for i in at) / len(at)
    if line_auto >= RECORDS and again >= LABELS_RECUR and len(set(labels)) >= 2 and any(":" in x or "=" in x for x in lines):
        return True
    told = [" ".join(x.split()).lower() for x in lines]
    recur = sum(told[i] == told[i - lag] for i in at) / len(at)
    alike = sum(shapes[i] == shapes[i - lag] for i in at) / len(at)
    return n >= 3 * lag and alike >= SAME_SHAPE and len(set(shapes)) >= 2 and (LABELS_RECUR <= recur < 1.0 or line_auto >= STEADY and all(len(x) <= 1 for x in shapes))


def _speakable(letters: list[str]) -> bool:
    """Whether Latin words have vowels as languages have them: for languages whose letter pairs the corpus does not know."""
    s = _LETTER[np.frombuffer(f" {' '.join(letters)} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    vowel = _VOWEL[s]
    stops = np.flatnonzero(vowel | (s == 27))
    bounds = np.flatnonzero(s == 27)
    per_word = np.add.reduceat(vowel, bounds[:-1])
    share = vowel.sum() / max(1, (s != 27).sum())
    return 0.3 <= share <= 0.6 and (per_word == 0).mean() <= 0.2 and np.diff(stops).max() <= 6


def _in_sentences(text: str, model: CorpusModel) -> int:
    """Characters of paragraphs that are sentences by their form: marks at their ends, words enough between the marks,
    next to nothing but words, and these can be read. Needs no word of the language to be known."""
    total = 0
    for block in _BLANK.split(text):
        # entries of one line each are judged each for itself
        rows = [x for x in block.split("\n") if x.strip()]
        for part in [block] if not all(_END.search(x) for x in rows) else rows:
            marks = len(_SENTENCE.findall(part))
            if not marks or not _END.search(part) or "|" in part or "\t" in part:
                continue
            letters = _WORD.findall(part)
            size = sum(map(len, letters))
            words = len(letters) if not _FOREIGN.search(part) else max(len(letters), size // 3)
            if words >= 5 * marks and size >= 0.8 * sum(map(len, part.split())) and (sum(map(model.readable.__getitem__, letters)) >= 0.6 * size or _speakable(letters)):
                total += sum(map(len, rows)) if part is block else len(part)
    return total


def statistics(text: str | None, model: CorpusModel) -> tuple:
    if text is None or not text.strip():
        return (0, 0.0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, "empty")
    lines = [x for x in text.splitlines() if x.strip()]
    told = [x.split() for x in map(str.lower, lines)]
    n_words = sum(map(len, told))
    if text.isascii():
        raw = text.encode()
        letters_only = raw.translate(_LETTERS_OR_SPACE).decode().split()
        alnum, filled = len(raw.translate(None, _NOT_ALNUM)), len(raw.translate(None, _SPACE))
        odd = len(raw.translate(None, _NOT_ODD))
        marks = filled - alnum
        numbers = sum(len(w) for w in filter(bytes.isdigit, raw.translate(_ALNUM_OR_SPACE).split()) if len(w) <= 9) if raw.translate(None, _NOT_DIGIT) else 0
    else:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _CLASS[code]
        letters_only = np.where(kinds == 1, code, 32).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").split()
        alnum, filled = int(np.count_nonzero(kinds)), sum(len(w) for x in told for w in x)
        marks, numbers = filled - alnum, sum(map(len, _NUMBER.findall(text)))
        odd = marks - sum(map(text.count, _USUAL))
    symbol_ratio = odd / filled
    ends = sum(1 for x in lines if (c := x.rstrip()[-1]) in _MARKS or c in _CLOSERS and _END.search(x)) / len(lines)
    is_common = model.common.__contains__
    hits = [sum(map(is_common, w)) for w in told]
    common = sum(hits) / n_words

    # shape of the lines
    best_align = 0.0
    for d in DELIMITERS:
        if d in text:
            counts = Counter(x.count(d) for x in lines)
            k, n = max(counts.items(), key=lambda kv: (kv[0] > 0) * kv[1])
            if k > 0:
                best_align = max(best_align, n / len(lines))
    if "  " in text:
        starts: Counter = Counter()
        gapped = 0
        for x in lines:
            at = {m.end() for m in _GAP.finditer(x.rstrip())}
            gapped += bool(at)
            starts.update(at)
        if starts:
            best_align = max(best_align, min(gapped, starts.most_common(1)[0][1] + starts.most_common(2)[-1][1] * 0.2) / len(lines))
    sizes = list(map(len, lines))
    line_auto, lag = _autocorrelation(np.log1p(sizes)) if len(lines) > 2 else (0.0, 0)
    indents = [len(x) - len(x.lstrip()) for x in lines] if any(x[0].isspace() for x in lines) else []
    indent_auto = _autocorrelation(np.array(indents, float))[0] if indents else 0.0

    # sentences: lines with enough common words that are no rows; a wrapped line counts with its paragraph
    prose, whole = 0, sum(sizes)
    for x, w, h in zip(lines, told, hits):
        k = len(w)
        if h < 2 and k < 8 or k < 4 or not (h >= 2 and h >= 0.12 * k or k >= 8 and h >= 0.08 * k):
            continue
        if x.count("|") > 1 or x.count("\t") > 1 or x.count(";") > 2 or "  " in x and len(_GAP.findall(x)) > 2:
            continue
        prose += len(x)
    prose_share = prose / whole

    # what can be read: words whose letters follow each other as they do in the corpus, and numbers
    size = sum(map(len, letters_only))
    readable_share = (sum(map(model.readable.__getitem__, letters_only)) + numbers) / max(1, alnum)
    by_form = min(1.0, _in_sentences(text, model) / whole) if prose_share < 0.5 and ends > 0 else 0.0
    prose_share = max(prose_share, by_form)
    backwards = 0.0
    if len(letters_only) >= 4 and common < 0.15:
        backwards = sum(map(model.turned.__getitem__, letters_only)) / max(1, size)
        # of a language that the corpus does not know, neither way can be read
        if backwards > 0.35 and sum(model.readable[w[::-1]] for w in letters_only) < 0.6 * size:
            backwards = 0.0
        turned_common = sum(1 for x in told for w in x if w[::-1].strip(".,;:!?") in model.common) / n_words if backwards > 0 else 0.0
        backwards = max(backwards, 1.0 if turned_common > 0.15 and turned_common > 2 * common else 0.0)

    noise = marks / filled
    same = Counter(map(str.lower, letters_only)).most_common(1)[0][1] / len(letters_only) if len(letters_only) >= 8 and 2 * len(set(letters_only)) < len(letters_only) + 2 else 0.0
    if backwards > 0.35 or same > 0.5 or symbol_ratio > 0.12 and noise > 0.2:
        kind = "junk"
    elif prose_share >= 0.5 and (readable_share >= 0.5 or by_form >= 0.5):
        kind = "prose"
    elif readable_share < 0.62 and not (alnum and sum(map(str.isdigit, text)) / alnum > 0.6 and best_align > 0.6):
        kind = "junk"
    elif best_align >= 0.6 or _records(lines, line_auto, lag):
        kind = "table"
    elif prose_share >= 0.3 and ends >= 0.5:
        kind = "prose"
    else:
        entries = sum(1 for k in sizes if k <= 80) / len(lines)
        long_run = filled / len(lines) > 100
        stepped = indent_auto >= PERIODIC and len(lines) >= 4 and max(indents) > min(indents)
        kind = "list" if entries >= 0.5 and not long_run or stepped else "prose"
    return (n_words, filled / max(1, n_words), symbol_ratio, ends, common, len(lines), best_align, indent_auto, line_auto, prose_share, readable_share, kind)


def corpus_model(df: DataFrame, text: str = "text") -> tuple[list[int], list[int], list[str]]:
    """(pairs, their counts, common words) of all documents: what CorpusModel is made of."""
    counts = written(corpus_counts(df, text), "word-counts")
    pairs = counts.where("kind = 'pair'").select("word", "long").collect()  # at most LETTERS^2 rows
    whole = counts.where("kind = 'word'").agg(F.sum("long").alias("long"), F.sum("short").alias("short")).first()
    long, short = whole["long"] or 0, whole["short"] or 0
    # each has the share: there are at most 1 / COMMON_SHARE of them
    often = counts.where("kind = 'word'").where((F.col("long") > 0) & (F.col("long") >= F.lit(COMMON_SHARE * long))).select("word", "long", "short").toPandas()
    return [int(r["word"]) for r in pairs], [r["long"] for r in pairs], common_words(often, long, short)


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns of STATS."""
    model = df.sparkSession.sparkContext.broadcast(corpus_model(df, text))

    @F.pandas_udf(STATS)
    def stats(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = CorpusModel(*model.value)
        for texts in parts:
            yield pd.DataFrame([statistics(t, m) for t in texts], columns=STATS.fieldNames())

    # else a filter on the result would be pushed below and have the texts examined twice
    stats = stats.asNondeterministic()

    df = df.drop(*[c for c in df.columns if c.lower() in {*STATS.fieldNames(), "_s"} and c != text])
    return df.withColumn("_s", stats(F.col(text))).select(*[F.col(c) for c in df.columns], "_s.*")
