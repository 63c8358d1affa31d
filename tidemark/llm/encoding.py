"""Problem 1: text that was decoded with the wrong character set.

Method. One pass counts adjacent character pairs over the whole corpus. A pair is scored by what it adds to the mutual
information of neighbours in the corpus, log2 of p(ab) log2(p(ab) / (p(a) p(b))), less the score under which RARE_SHARE of
the corpus's own pairs lie: nearly all pairs score well above zero. In each text the maximum-scoring segments of the
negated score are the improbable runs, and only inside those runs inverse mappings are tried. Pairs that stand where the
text reads as UTF-8 bytes of another page are counted apart and speak neither for nor against themselves, so a garbling
stays improbable even if it fills a third of the corpus.

* UTF-8 bytes read through a single-byte page: characters are turned back into bytes, and every valid multi-byte
  sequence is a candidate. It is taken if its character is at least as common in the corpus as the garbled pair, or if
  the text has other such sequences and nothing that contradicts the page. Repeated until nothing changes, for text that
  was garbled more than once; every round makes the text shorter.
* Bytes of one single-byte page read through another: taken for a character if the corpus holds the pairs it would
  form with its neighbours much more often than those it forms now.

U+FFFD and C1 control characters are marks of a wrong decoding in any case; what U+FFFD replaced is looked up in the
corpus (see ``restore_replacement``).

The pair table is bounded: the alphabet has SYMBOLS entries at most, so it never holds more than SYMBOLS^2 counts,
however large the corpus is. That bound is why it may go through the driver to the workers.

Null text stays null and is not garbled; so does an empty one; repeated rows give repeated results; other columns pass,
except that columns named like a result are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

# Single-byte pages by which UTF-8 text is commonly misread. cp1252 here also takes the C1 controls that
# Latin-1 has in its gaps, as browsers do.
PAGES = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251")
FORMED_PAIR_BITS = 5.0
#: Share of the corpus's pairs that count as improbable; and the least mutual information that a pair counts with.
RARE_SHARE, LEAST_BITS = 0.01, 1.0


def _page(name: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if name == "cp1252":
        for b in range(128, 160):
            out.setdefault(chr(b), b)
    return out


_TO_BYTE = {name: _page(name) for name in PAGES}
# (page of the bytes, page they were read through) -> what each character would be
_MOVES = {
    (source, page): {c: d for c, b in _TO_BYTE[page].items() if (d := bytes([b]).decode(source, "replace")) not in (c, "\ufffd")}
    for page in PAGES
    for source in PAGES
    if source != page
}


def _alphabet() -> tuple[np.ndarray, int]:
    """Code point -> symbol. ASCII and every character of a known page has its own symbol, all others share one for
    each 256 code points of the basic plane and one for the rest."""
    own = [*range(128), *sorted({ord(c) for page in _TO_BYTE.values() for c in page} | {0xFFFD, *range(0x80, 0x180), *range(0x2010, 0x2040)})]
    own = list(dict.fromkeys(own))
    symbols = np.empty(0x110000, np.int32)
    symbols[:0x10000] = len(own) + (np.arange(0x10000) >> 8)
    symbols[0x10000:] = len(own) + 256
    symbols[own] = np.arange(len(own))
    return symbols, len(own) + 257


SYMBOL_OF, SYMBOLS = _alphabet()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _as_bytes() -> re.Pattern:
    """Stretches that read as UTF-8 sequences of two to four bytes in one of the pages."""

    def chars(page: dict[str, int], low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in page.items() if low <= b <= high) + "]"

    ways = []
    for page in _TO_BYTE.values():
        tail = chars(page, 0x80, 0xBF)
        ways.append("(?:" + "|".join(f"{chars(page, a, b)}{tail}{{{n}}}" for a, b, n in ((0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3))) + ")+")
    return re.compile("|".join(ways))


AS_BYTES, ADJACENT = _as_bytes(), re.compile(r"[^\x00-\x7f]{2}")


def pair_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(pair, n, apart): counts of adjacent symbol pairs over every row of the column; pair = left * SYMBOLS + right; apart
    is how many of them stand in or at a stretch that reads as bytes of UTF-8. Counted inside each task in fixed-size
    arrays, so the shuffle carries one row for each distinct pair and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)

        def add(row: int, parts: list[str], glue: str) -> None:
            s = SYMBOL_OF[_points(glue.join(parts))]
            total[row] += np.bincount(s[:-1] * SYMBOLS + s[1:], minlength=total.shape[1])

        for batch in batches:
            texts, part, apart, size = batch.column(0).to_pylist(), [], [], 0
            for t in [*texts, None]:
                if t is not None:
                    part.append(t)
                    size += len(t)
                    if not t.isascii() and ADJACENT.search(t):
                        apart += [t[max(0, m.start() - 1) : m.end() + 1] for m in AS_BYTES.finditer(t)]
                if part and (size > 1_000_000 or t is None):
                    add(0, part, "\n")
                    if apart:
                        # no pair of the glue counts: U+0000 stands between the stretches
                        add(1, apart, "\0")
                    part, apart, size = [], [], 0
        total[1].reshape(SYMBOLS, SYMBOLS)[0, :] = 0
        total[1].reshape(SYMBOLS, SYMBOLS)[:, 0] = 0
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[0, at], pa.int64()), pa.array(total[1, at], pa.int64())], names=["pair", "n", "apart"])

    return df.select(text).where(F.length(text) > 0).mapInArrow(count, "pair long, n long, apart long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("apart").alias("apart"))


class PairModel:
    """Pair counts as a dense table; log2 joint probabilities and the improbability of each pair."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, apart: np.ndarray | None = None):
        n, clean = np.zeros(SYMBOLS * SYMBOLS), np.zeros(SYMBOLS * SYMBOLS)
        n[pairs] = counts
        clean[pairs] = counts if apart is None else np.maximum(counts - apart, 0)
        self.n, clean = n.reshape(SYMBOLS, SYMBOLS), clean.reshape(SYMBOLS, SYMBOLS)
        self.one = self.n.sum(axis=1)
        self.joint = np.log2((self.n + 0.5) / max(1.0, self.n.sum())).astype(np.float32)
        total = max(1.0, clean.sum())
        joint, single = np.log2((clean + 0.5) / total), np.log2((clean.sum(axis=1) + 0.5) / total)
        score = joint + np.log2(np.maximum(joint - single[:, None] - single[None, :], LEAST_BITS))
        order = np.argsort(score, axis=None)
        below = np.cumsum(clean.ravel()[order])
        least = score.ravel()[order[min(np.searchsorted(below, RARE_SHARE * below[-1]), len(order) - 1)]]
        self.improbable = np.clip(least - score, -6, 20).astype(np.float32)

    def bits(self, a: str, b: str) -> float:
        return float(self.joint[SYMBOL_OF[ord(a)], SYMBOL_OF[ord(b)]])

    def count(self, c: str) -> float:
        # characters that share a symbol are never known by themselves
        return float(self.one[SYMBOL_OF[ord(c)]]) if SYMBOL_OF[ord(c)] < SYMBOLS - 257 else 0.0

    def pair(self, a: str, b: str) -> float:
        return float(self.n[SYMBOL_OF[ord(a)], SYMBOL_OF[ord(b)]])


def improbable_runs(text: str, model: PairModel) -> list[tuple[int, int]]:
    """Character ranges of all maximum-scoring segments (the linear-time stack algorithm over blocks of equal sign)."""
    s = SYMBOL_OF[_points(text)]
    if len(s) < 2:
        return [(0, len(s))] if len(s) else []
    score = model.improbable[s[:-1], s[1:]]
    positive = np.flatnonzero(score > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(score)])
    cut = np.flatnonzero(np.diff(positive) > 1)
    starts, ends = positive[np.concatenate([[0], cut + 1])], positive[np.concatenate([cut, [len(positive) - 1]])] + 1
    stack: list[list[float]] = []  # start, end, sum before, sum through
    for a, b in zip(starts.tolist(), ends.tolist()):
        item = [a, b, total[a], total[b]]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= item[2]:
                j -= 1
            if j < 0 or stack[j][3] >= item[3]:
                stack.append(item)
                break
            item = [stack[j][0], item[1], stack[j][2], item[3]]
            del stack[j:]
    return [(int(a), int(b) + 1) for a, b, _, _ in stack]


_NEED = {**{b: 1 for b in range(0xC2, 0xE0)}, **{b: 2 for b in range(0xE0, 0xF0)}, **{b: 3 for b in range(0xF0, 0xF5)}}
HIGH = re.compile(r"[^\x00-\x7f]+")
MARKS = re.compile("[\x80-\x9f�]")


def _tested(text: str, model: PairModel) -> np.ndarray:
    """Where inverse mappings are tried: the improbable runs."""
    inside = np.zeros(len(text), bool)
    for a, b in improbable_runs(text, model):
        inside[a:b] = True
    return inside


def _sequences(text: str, inside: np.ndarray, page: dict[str, int]) -> tuple[list[tuple[int, int, str]], int]:
    """Valid UTF-8 sequences of two to four characters in the runs, and how many characters of the page are in none."""
    found, loose = [], 0
    for m in HIGH.finditer(text):
        i, end = m.span()
        while i < end:
            b = page.get(text[i])
            need = _NEED.get(b, 0) if b is not None else 0
            if need and i + need < end:
                tail = [page.get(c) for c in text[i + 1 : i + 1 + need]]
                if None not in tail and inside[i : i + 1 + need].all():
                    try:
                        c = bytes([b, *tail]).decode("utf-8")
                    except (UnicodeDecodeError, ValueError):
                        c = ""
                    if c:
                        found.append((i, i + 1 + need, c))
                        i += 1 + need
                        continue
            loose += b is not None and b >= 0xC2
            i += 1
    return found, loose


def _undo_utf8(text: str, inside: np.ndarray, model: PairModel) -> tuple[str, str]:
    best: tuple[float, str, list] = (0.0, "", [])
    for name in PAGES:
        found, loose = _sequences(text, inside, _TO_BYTE[name])
        if not found:
            continue
        sure = [model.count(c) >= min(model.pair(text[k], text[k + 1]) for k in range(a, b - 1)) for a, b, c in found]
        if not any(sure) and (loose or len(found) < 2):
            continue
        if loose:
            found = [f for f, ok in zip(found, sure) if ok]
        weight = sum(b - a for a, b, _ in found) + 0.01 * sum(sure)
        if weight > best[0]:
            best = (weight, name, found)
    out, at = [], 0
    for a, b, c in best[2]:
        out += [text[at:a], c]
        at = b
    return "".join([*out, text[at:]]), best[1]


def _undo_page(text: str, inside: np.ndarray, model: PairModel) -> tuple[str, str]:
    """Characters whose place in another page fits their neighbours far better."""
    at = [i for m in HIGH.finditer(text) for i in range(*m.span()) if inside[i]]
    best: tuple[float, str, str] = (0.0, "", text)
    for (source, page), moves in _MOVES.items() if at else ():
        out, gained, taken = list(text), 0.0, []
        for i in at:
            c = moves.get(text[i])
            if c is None or not model.count(c):
                continue
            left, right = (text[i - 1] if i else "\n"), (text[i + 1] if i + 1 < len(text) else "\n")
            # neighbours may be changed too: the one before as decided, the one after as it would be
            new_left, new_right = (out[i - 1] if i else "\n"), right
            if (r := moves.get(right) if right > "\x7f" else None) and model.pair(c, r) > model.pair(c, right):
                new_right = r
            if not (model.pair(new_left, c) and model.pair(c, new_right)):
                continue
            before = model.bits(new_left, c) - model.bits(left, text[i])
            after = model.bits(c, new_right) - model.bits(text[i], right)
            gain = before + after if min(before, after) >= -3 else 0.0
            if gain >= FORMED_PAIR_BITS:
                taken.append(min(before, after))
                out[i] = c
                gained += gain
        # a lone change that only one neighbour speaks for is no evidence
        if gained > best[0] and max(taken) >= 1:
            best = (gained, f"{source}>{page}", "".join(out))
    return best[2], best[1]


def undo(text: str, model: PairModel) -> tuple[str, list[str]]:
    """The text with every wrong decoding undone that can be, and the mappings that were used."""
    used: list[str] = []
    inside = _tested(text, model)
    while ADJACENT.search(text) and (got := _undo_utf8(text, inside, model))[1]:
        text = got[0]
        used.append(f"utf-8>{got[1]}")
        inside = _tested(text, model)
    text, name = _undo_page(text, inside, model)
    return text, [*used, *([name] if name else [])]


def repair_encoding(df: DataFrame, text: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """df with garbled (boolean), restored (string), mappings (array) and lost (characters that could not be restored).

    Rows of plain ASCII cannot hold such characters: a filter on the JVM side keeps them out of Python."""
    spark = df.sparkSession
    got = (counts if counts is not None else pair_counts(df, text)).toPandas()  # at most SYMBOLS^2 rows
    model = spark.sparkContext.broadcast(tuple(got[c].to_numpy(np.int64) for c in ("pair", "n", "apart")))
    schema = T.StructType([T.StructField("garbled", T.BooleanType()), T.StructField("restored", T.StringType()), T.StructField("mappings", T.ArrayType(T.StringType())), T.StructField("lost", T.IntegerType())])

    @F.pandas_udf(schema)
    def fix(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = PairModel(*model.value)
        for texts in parts:
            rows = []
            for t in texts:
                if t is None or t.isascii():
                    rows.append((False, t, [], 0))
                    continue
                fixed, used = undo(t, m)
                lost = len(MARKS.findall(fixed))
                rows.append((bool(used) or lost > 0, fixed, used, lost))
            yield pd.DataFrame(rows, columns=["garbled", "restored", "mappings", "lost"])

    # else a filter on the result would be pushed below and have the texts examined twice
    fix = fix.asNondeterministic()

    df = df.drop(*[c for c in df.columns if c.lower() in {*schema.fieldNames(), "_fix"}])
    plain = F.struct(F.lit(False).alias("garbled"), F.col(text).alias("restored"), F.array().cast("array<string>").alias("mappings"), F.lit(0).alias("lost"))
    odd = F.col(text).rlike(r"[^\x00-\x7F]")
    done = df.where(odd).withColumn("_fix", fix(F.col(text))).unionByName(df.where(~odd | odd.isNull()).withColumn("_fix", plain))
    return done.select(*[F.col(c) for c in df.columns], "_fix.garbled", "_fix.restored", "_fix.mappings", "_fix.lost")


def restore_replacement(df: DataFrame, text: str = "restored", key: str = "chunk_id") -> DataFrame:
    """(key, word, original): words with U+FFFD whose original is the only corpus word of that shape, or ten times as
    common as the next. A word's shape is the word with its non-ASCII characters replaced by U+FFFD."""
    # one pass over the texts; both sides of the join read what it wrote
    words = written(df.where(F.col(text).rlike(r"[^\x00-\x7F]")).select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(?U)([\w\x{FFFD}]*[^\x00-\x7F][\w\x{FFFD}]*)"), F.lit(1)))).alias("word")), "words")
    broken = words.where(F.col("word").contains("�"))
    whole = words.where(~F.col("word").contains("�")).groupBy("word").agg(F.count("*").alias("n"))
    shapes = whole.withColumn("shape", F.regexp_replace("word", r"[^\x00-\x7F]", "�"))
    best = shapes.groupBy("shape").agg(F.max_by("word", F.struct("n", "word")).alias("original"), F.max("n").alias("top"), F.sum("n").alias("all"))
    best = best.where((F.col("all") - F.col("top")) * 10 <= F.col("top"))
    return broken.join(best, broken["word"] == best["shape"]).select(key, "word", "original")
