"""Problem 5: freely typed values against a canonical list.

Method. Every entry of the list and every distinct typed value is expanded to its symmetric-delete keys (the strings
left after taking out up to ``edits`` characters). Equal keys give the candidates, so the bounded edit distance search is
one equi-join; which side is broadcast, if any, is left to Spark, which knows their sizes. Candidates are ranked by weighted
Damerau-Levenshtein cost, then by how often the entry is written exactly in the data, then by id. Values without a candidate
are reported with id 0.

Designations of models have a guard behind the distance: their numbers and short letter groups must agree, because another
number or suffix letter is another model; a group of four letters or more may have one slip.

Values are grouped before the search, so a value that fills a third of all rows costs no more than any other, and values
of all fields are matched in one pass.
Null and blank values are no case and give no row. Repeated rows give repeated results. The caller's other columns are
never touched: the result carries only the key, the value and the id.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

# Words that say what sort of firm or label follows, and are no part of a name.
LEGAL_WORDS = frozenset("ltd limited gmbh as asa ab ag co inc llc intl international sons and sa bv kg corp plc the div".split())
LABEL_BEFORE = re.compile(r"^\s*(?:mod\.|model\b:?|type\b:?|typ\b:?)\s*", re.I)
LABEL_AFTER = re.compile(r"(?:\s*\([^()]*\)|\s*\*+|\s*,\s*as fitted|\s+-\s+marine|\s*\b(?:mod\.|model\b:?|type\b:?))\s*$", re.I)
# Digits that are misread as letters, and the reverse.
MISREAD = str.maketrans("OISBZ", "01582")
# A group of letters in which a slip can be told, and one that ends in a Roman number.
SLIP, ROMAN = re.compile(r"[A-Z]{4}"), re.compile(r"^(.*?)[IVX]+$")
LATIN = str.maketrans({"ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ß": "ss", "đ": "d", "ł": "l", "Ł": "L"})
CONFUSED = {frozenset(p) for p in ("rn", "nm", "vy", "uv", "ce", "il", "o0", "s5", "b8", "i1", "tf", "gq", "hb")}


def plain(text: str) -> str:
    """Letters without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(LATIN)) if not unicodedata.combining(c))


def bare(value: str) -> str:
    """The value without labels such as ``Type:`` before it or ``(spare)`` after it."""
    while (cut := LABEL_AFTER.sub("", LABEL_BEFORE.sub("", value))) != value:
        value = cut
    return value


def compact(value: str) -> str:
    return re.sub(r"[^A-Z0-9]", "", plain(value).upper())


def raw_form(value: str) -> str:
    """A model designation without labels, case and punctuation."""
    return compact(bare(value))


def form_keys(raw: str, edits: int = 1) -> list[str]:
    """Keys of a designation: the whole with misread digits as digits, and, if a group of letters is long enough for a
    slip, what is left after up to ``edits`` deletions."""
    keys = {"=" + raw.translate(MISREAD)}
    if edits and SLIP.search(raw):
        keys |= deletes(raw, edits)
    return sorted(keys)


def form_cost(raw: str, entry: str, edits: int = 1) -> float:
    """Cost of reading one designation as another; more than ``edits`` means it cannot be. Numbers and groups of fewer than
    four letters must agree, and so must last letters and Roman numbers behind the same letters."""
    if raw.translate(MISREAD) == entry.translate(MISREAD):
        return 0.0
    if re.findall(r"\d+", raw) != re.findall(r"\d+", entry):
        return 9.0
    cost = 0.0
    for a, b in zip(re.split(r"\d+", raw), re.split(r"\d+", entry)):
        if a == b:
            continue
        x, y = ROMAN.match(a), ROMAN.match(b)
        if min(len(a), len(b)) < 4 or a[-1] != b[-1] or x and y and x.group(1) == y.group(1):
            return 9.0
        cost += weighted_distance(a, b, float(edits))
    return cost


def name_tokens(value: str) -> list[str]:
    value = re.sub(r"\([^()]*\)|\bGmbH\b", " ", plain(value))
    value = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value)
    return [t for t in re.split(r"[^a-z0-9]+", value.lower()) if len(t) > 1 and t not in LEGAL_WORDS]


def deletes(word: str, edits: int) -> set[str]:
    out = {word}
    for k in range(1, edits + 1):
        if len(word) - k >= 3:
            out.update("".join(c) for c in combinations(word, len(word) - k))
    return out


def weighted_distance(a: str, b: str, most: float = 3.0) -> float:
    """Damerau-Levenshtein (adjacent transpositions); look-alike letters, doubled letters and swaps cost less than one."""
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > most / 0.5:
        return most + 1
    before: list[float] = []
    last = [float(j) for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        row = [float(i)]
        for j in range(1, len(b) + 1):
            x, y = a[i - 1], b[j - 1]
            same = 0.0 if x == y else 0.5 if frozenset((x, y)) in CONFUSED else 1.0
            gap_a = 0.6 if i > 1 and x == a[i - 2] else 1.0
            gap_b = 0.6 if j > 1 and y == b[j - 2] else 1.0
            best = min(last[j - 1] + same, last[j] + gap_a, row[j - 1] + gap_b)
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, before[j - 2] + 0.8)
            row.append(best)
        before, last = last, row
        if min(row) > most:
            return most + 1
    return last[-1]


def name_keys(value: str, edits: int) -> list[str]:
    """Keys of a maker's name: those of each longer word, and those of the whole; short ones stand fewer deletions."""
    tokens = name_tokens(value)
    keys: set[str] = set()
    for t in tokens:
        if len(t) >= 4:
            keys |= deletes(t, min(edits, 2 if len(t) >= 6 else 1))
    whole = "".join(tokens)
    if len(whole) >= 3:
        keys |= {"=" + k for k in deletes(whole, min(edits, 2 if len(whole) >= 8 else 1))}
        keys.add("=" + "".join(sorted(tokens)))
    return sorted(keys)


def name_cost(value: str, name: str, also: list[str] | None) -> float:
    """Cost of reading value as name; more than 3 means it cannot be."""
    given, entry = name_tokens(value), name_tokens(name)
    whole, target = "".join(given), "".join(entry)
    if not given or not entry:
        return 9.0
    for alias in also or ():
        if whole == "".join(name_tokens(alias)):
            return 0.1
    allowed = 2.0 if len(target) >= 8 else 1.0
    cost = weighted_distance(whole, target, allowed)
    if cost <= allowed and re.sub(r"\D", "", whole) == re.sub(r"\D", "", target):
        return cost
    brand, rest = entry[0], entry[1:]
    for i, t in enumerate(given):
        near = weighted_distance(t, brand, 2.0)
        if near > (2.0 if len(brand) >= 6 else 1.0):
            continue
        others = given[:i] + given[i + 1 :]
        extra = 0.2 * (len(rest) - len(others)) if len(others) < len(rest) else 0.0
        fits = len(others) <= len(rest)
        for o in others:
            price = min([0.1 if r.startswith(o) and len(o) >= 2 else weighted_distance(o, r, 2.0) for r in rest], default=9.0)
            if price > 2.0 and "".join(rest) != o:
                fits = False
            extra += min(price, 2.0)
        if fits and near + extra <= 3.0:
            return near + extra
    # swapped and joined: DeckGearKestavo
    swapped = weighted_distance(whole, "".join(rest) + brand, allowed)
    return swapped + 0.1 if swapped <= allowed else 9.0


def _spread(df: DataFrame) -> DataFrame:
    """Distinct values laid over all cores: few rows that cost much each."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def match_names(values: DataFrame, names: DataFrame, edits: int = 2) -> DataFrame:
    """values(value) distinct; names(id, name, also, seen) -> (value, id): the best entry of each value that has one."""

    @F.pandas_udf("array<string>")
    def keys(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: name_keys(t, edits))

    @F.pandas_udf("array<string>")
    def entry_keys(name: pd.Series, also: pd.Series) -> pd.Series:
        def of(n: str, others) -> list[str]:
            first = name_tokens(n)[:1]
            brand = name_keys(first[0], edits) if first else []
            out = set(brand) | {k for k in name_keys(n, edits) if k[0] == "="}
            for o in others if others is not None else ():
                out |= {k for k in name_keys(o, edits) if k[0] == "="}
            return sorted(out)

        return pd.Series([of(n, a) for n, a in zip(name, also)])

    @F.pandas_udf("double")
    def cost(value: pd.Series, name: pd.Series, also: pd.Series) -> pd.Series:
        return pd.Series([name_cost(v, n, list(a) if a is not None else None) for v, n, a in zip(value, name, also)], dtype="float64")

    index = names.select("id", "name", "also", "seen", F.explode(entry_keys("name", "also")).alias("key"))
    found = _spread(values.select("value")).select("value", F.explode(keys("value")).alias("key")).join(index, "key").dropDuplicates(["value", "id"])
    scored = found.withColumn("cost", cost("value", "name", "also")).where("cost <= 3")
    return scored.groupBy("value").agg(F.min_by("id", F.struct("cost", -F.col("seen"), "id")).alias("id"))


def match_forms(forms: DataFrame, catalog: DataFrame, edits: int = 1) -> DataFrame:
    """forms(form) distinct designations, as raw_form gives them; catalog has catalog_id, manufacturer, model, seen ->
    (form, catalog_id, manufacturer, seen, cost) of every entry of the least cost."""

    @F.pandas_udf("array<string>")
    def keys(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: form_keys(t, edits))

    @F.pandas_udf("entry string, keys array<string>")
    def entry(models: pd.Series) -> pd.DataFrame:
        raw = models.map(raw_form)
        return pd.DataFrame({"entry": raw, "keys": raw.map(lambda t: form_keys(t, edits))})

    @F.pandas_udf("double")
    def cost(form: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([form_cost(a, b, edits) for a, b in zip(form, other)], dtype="float64")

    index = catalog.withColumn("e", entry("model")).select("catalog_id", "manufacturer", "seen", "e.entry", F.explode("e.keys").alias("key"))
    found = _spread(forms).select("form", F.explode(keys("form")).alias("key")).join(index, "key").dropDuplicates(["form", "catalog_id"])
    scored = found.withColumn("cost", cost("form", "entry")).where(F.col("cost") <= edits)
    least = scored.groupBy("form").agg(F.min("cost").alias("least"))
    return scored.join(least, "form").where(F.col("cost") == F.col("least")).select("form", "catalog_id", "manufacturer", "seen", "cost")


def _distinct(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.length(F.regexp_replace(F.col(col), r"(?U)\s+", "")) > 0).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("rows"))


def _splits(value: str, longest: int) -> list[tuple[str, str]]:
    """(form of a possible designation, text that is left for the maker), taken from either end of the value; no form is
    longer than the longest of the list can be."""
    text = bare(value)
    at = [i for i, c in enumerate(text) if compact(c)]
    forms = [compact(text[i]) for i in at]
    out: dict[tuple[str, str], None] = {}
    for k in range(1, len(at)):
        if k <= longest:
            form = "".join(forms[:k])
            if re.search(r"\d|[OISBZ]", form):
                out[(form, text[at[k] :])] = None
        if len(at) - k <= longest:
            form = "".join(forms[k:])
            if re.search(r"\d|[OISBZ]", form):
                out[(form, bare(text[: at[k]]))] = None
    return list(out)


def canonical(equipment: DataFrame | None, chunks: DataFrame | None, catalog: DataFrame, makers: DataFrame, edits: int = 2, slips: int = 1) -> dict[str, DataFrame]:
    """The distinct non-blank values of three fields with their entries, id 0 if none fits: 'maker' (value, rows, maker_id,
    exact) of equipment.manufacturer, 'model' (value, maker_value, rows, catalog_id, exact) of equipment.model with the
    manufacturer beside it, 'both' (value, rows, catalog_id, exact) of chunks.equipment_model, which holds maker and model
    in either order. exact says that the value is written as in the list.

    A designation of several makers goes by the maker's name; any other stands for itself."""
    spark = catalog.sparkSession
    text = T.StructType([T.StructField(c, T.StringType()) for c in ("manufacturer", "model", "equipment_model")])
    nothing = spark.createDataFrame([], text)
    equipment, chunks = equipment if equipment is not None else nothing, chunks if chunks is not None else nothing
    maker_values = written(_distinct(equipment, "manufacturer"), "maker-values")
    pairs = equipment.where(F.length(F.regexp_replace("model", r"(?U)\s+", "")) > 0).groupBy(F.col("model").alias("value"), F.col("manufacturer").alias("maker_value")).agg(F.count("*").alias("rows"))

    @F.pandas_udf(T.StringType())
    def raw(texts: pd.Series) -> pd.Series:
        return texts.map(raw_form)

    pairs = written(pairs.withColumn("form", raw("value")), "model-values")
    both_values = written(_distinct(chunks, "equipment_model"), "equipment-values")
    # letters of an entry are at most so many characters when they are spelled out (ae, ss)
    longest = 2 * (catalog.agg(F.max(F.length("model"))).first()[0] or 0) + slips

    @F.pandas_udf("array<struct<form: string, rest: string>>")
    def splits(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"form": a, "rest": b} for a, b in _splits(t, longest)])

    parts = written(_spread(both_values.select("value")).select("value", F.explode(splits("value")).alias("s")).select("value", "s.form", "s.rest"), "equipment-parts")
    models = pairs.groupBy("value").agg(F.sum("rows").alias("seen"))
    listed = catalog.join(models.withColumnRenamed("value", "model"), "model", "left").select("catalog_id", "manufacturer", "model", F.coalesce("seen", F.lit(0)).alias("seen"))
    forms = written(match_forms(pairs.select("form").unionByName(parts.select("form")).distinct(), listed, slips), "forms")
    hits = written(parts.join(forms, "form").where(F.length(F.regexp_replace("rest", r"(?U)\s+", "")) > 0), "equipment-hits")

    names = makers.select(F.col("maker_id").alias("id"), F.col("manufacturer").alias("name"), F.col("also_known_as").alias("also"))
    names = names.join(maker_values.withColumnRenamed("value", "name"), "name", "left").select("id", "name", "also", F.coalesce("rows", F.lit(0)).alias("seen"))
    typed = maker_values.select("value").unionByName(hits.select(F.col("rest").alias("value"))).distinct()
    equal = makers.select(F.col("manufacturer").alias("value"), F.col("maker_id").alias("exact_id"))
    named = typed.join(match_names(typed, names, edits), "value", "left").join(equal, "value", "left")
    named = written(named.select("value", F.coalesce("exact_id", "id", F.lit(0)).cast("bigint").alias("maker_id"), F.col("exact_id").isNotNull().alias("exact")), "names")
    known = named.where("maker_id > 0").join(makers.select("maker_id", F.col("manufacturer").alias("maker_name")), "maker_id").select("value", "maker_name")

    maker = maker_values.join(named, "value").select("value", "rows", "maker_id", "exact")

    own = pairs.join(forms, "form").join(known.withColumnRenamed("value", "maker_value"), "maker_value", "left")
    fits = F.col("manufacturer") == F.col("maker_name")
    own = own.groupBy("value", F.coalesce("maker_value", F.lit("")).alias("m")).agg(F.count_distinct("catalog_id").alias("entries"), F.min("catalog_id").alias("one"), F.min_by(F.when(fits, F.col("catalog_id")), F.struct(~F.coalesce(fits, F.lit(False)), -F.col("seen"), "catalog_id")).alias("own"))
    own = own.select("value", "m", F.when(F.col("entries") == 1, F.col("one")).otherwise(F.col("own")).alias("id"))
    written_so = catalog.select(F.col("model").alias("value"), F.lit(True).alias("exact")).distinct()
    model = pairs.withColumn("m", F.coalesce("maker_value", F.lit(""))).join(own, ["value", "m"], "left").join(written_so, "value", "left")
    model = model.select("value", "maker_value", "rows", F.coalesce("id", F.lit(0)).cast("bigint").alias("catalog_id"), F.coalesce("exact", F.lit(False)).alias("exact"))

    fit = hits.join(known.withColumnRenamed("value", "rest"), "rest").where(F.col("maker_name") == F.col("manufacturer"))
    fit = fit.groupBy("value").agg(F.max_by("catalog_id", F.struct(-F.col("cost"), F.length("form"), "seen", -F.col("catalog_id"))).alias("id"))
    whole = catalog.select(F.concat_ws(" ", "manufacturer", "model").alias("value"), F.lit(True).alias("exact")).distinct()
    both = both_values.join(fit, "value", "left").join(whole, "value", "left")
    both = both.select("value", "rows", F.coalesce("id", F.lit(0)).cast("bigint").alias("catalog_id"), F.coalesce("exact", F.lit(False)).alias("exact"))
    return {"maker": maker, "model": model, "both": both}


def canonical_makers(df: DataFrame, col: str, makers: DataFrame, edits: int = 2) -> DataFrame:
    """(value, rows, maker_id, exact) for every distinct non-blank value of the column; maker_id 0 if none fits."""
    catalog = df.sparkSession.createDataFrame([], "catalog_id bigint, manufacturer string, model string")
    return canonical(df.select(F.col(col).alias("manufacturer"), F.lit(None).cast("string").alias("model")), None, catalog, makers, edits)["maker"]


def canonical_models(df: DataFrame, model: str, maker: str, catalog: DataFrame, makers: DataFrame) -> DataFrame:
    """(value, maker_value, catalog_id, exact) for each distinct pair of model and maker as typed."""
    return canonical(df.select(F.col(model).alias("model"), F.col(maker).alias("manufacturer")), None, catalog, makers)["model"]


def canonical_equipment(df: DataFrame, col: str, catalog: DataFrame, makers: DataFrame) -> DataFrame:
    """(value, rows, catalog_id, exact) for values that hold maker and model together, in either order."""
    return canonical(None, df.select(F.col(col).alias("equipment_model")), catalog, makers)["both"]
