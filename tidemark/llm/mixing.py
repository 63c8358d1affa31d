"""Problem 7: one training mixture out of several sources.

Method (soft-membership mixing). A naive Bayes classifier over token ids, fitted on a bounded sample of rows whose source is
a target, gives every row the probability of each source; a row's own source name is evidence too, wrong with probability
LABEL_NOISE, so a row counts mostly, not wholly, for the source it names. The rates with which rows are repeated are fitted
by projected gradient: least squares between the expected tokens of each source and its target, with every rate between 0
and the source's max_repeats. Rows of equal membership and bound have equal rates, so they are summed into cells first; a
step is one aggregation over the cells, and only the residuals (one number for each source) reach the driver. Rates become
whole copies by carrying the tokens owed from text to text, so the same input gives the same mixture.

The total is the largest one at which only sources whose target shares add up to at most ``shortfall`` (0) stay below their
share, or ``total_tokens``. A source without rows stays at 0 and does not count. Rows of a named source that is no target
take no part. Null and empty texts weigh nothing. The report has the shares reached by membership and by name, both counted
from the copies, and whether the fit converged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .tokens import FOLDER, VOCABULARY, encoding

#: Rows of each source that the classifier is fitted on, at most; documented bound of the labelled sample.
SAMPLE_ROWS = 2_000
#: Token ids are folded to so many features; how often a source name may be wrong.
BUCKETS, LABEL_NOISE = 1 << 15, 0.01
#: Summed target share of the sources that may stay below it.
SHORTFALL = 0.0
#: Memberships are whole multiples of this step, to sum rows into cells.
STEPS = 20


def source_name(source: Column) -> Column:
    """A source in one spelling; blank is null."""
    s = F.regexp_replace(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), r"[\s\-]+", "_")
    return F.when(s != "", s)


def fit_classifier(labelled: DataFrame, names: list[str], sample_rows: int = SAMPLE_ROWS, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """(log prior, log likelihood [source, bucket]) from at most sample_rows rows of each source: those with the smallest
    hashes of their id, the same each time.

    labelled has doc_id, source, text. A threshold that about one and a half times as many pass is set from the counts, so
    only a bounded number of rows of each source is ever ordered."""
    n = {r["source"]: r["n"] for r in labelled.groupBy("source").agg(F.count("*").alias("n")).collect()}  # one row per target
    keep = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, 1.5 * sample_rows / max(1, n.get(k, 0))))])
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_007))
    part = labelled.withColumn("h", h).where(F.col("h") < keep[F.col("source")] * 1_000_000_007)
    part = part.withColumn("no", F.row_number().over(Window.partitionBy("source").orderBy("h", "doc_id"))).where(F.col("no") <= sample_rows)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, total = encoding(folder, vocabulary).encode_ordinary, np.zeros((len(names), BUCKETS), np.int64)
        at = {k: i for i, k in enumerate(names)}
        for pdf in parts:
            for source, text in zip(pdf["source"], pdf["text"]):
                total[at[source]] += np.bincount(np.array(encode(text), np.int64) % BUCKETS, minlength=BUCKETS)
        s, f = np.nonzero(total)
        yield pd.DataFrame({"s": s, "f": f, "n": total[s, f]})

    counts = part.select("source", "text").mapInPandas(count, "s int, f int, n bigint").groupBy("s", "f").agg(F.sum("n").alias("n")).toPandas()  # sources x BUCKETS at most
    table = np.full((len(names), BUCKETS), 0.1)
    table[counts["s"].to_numpy(int), counts["f"].to_numpy(int)] += counts["n"].to_numpy()
    prior = np.log(np.array([n.get(k, 0) + 0.5 for k in names]))
    return prior, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def in_steps(p: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """p as whole multiples of 1 / steps that sum to 1: largest remainders go up, ties to the first."""
    q = np.floor(p * steps + 1e-9)
    left = int(round(steps - q.sum()))
    q[np.argsort(-(p * steps - q), kind="stable")[:left]] += 1
    return q / steps


def posterior(ids: list[int], own: int, prior: np.ndarray, table: np.ndarray, noise: float = LABEL_NOISE) -> np.ndarray:
    """Probability of each source given a text's tokens and the source it names (-1: none). Tokens of a text are far from
    independent: their evidence is its mean over the text, which held-out rows bear out best. A row names a wrong source
    with probability ``noise``, and then any by its share."""
    prior = prior - np.log(np.exp(prior).sum())
    z = prior + table[:, np.array(ids, np.int64) % BUCKETS].mean(axis=1) if ids else prior
    if own >= 0 and len(z) > 1:
        z = z + np.where(np.arange(len(z)) == own, np.log(1 - noise), np.log(noise) + prior[own])
    p = np.exp(z - z.max())
    return in_steps(p / p.sum())


def memberships(docs: DataFrame, targets: DataFrame, sample_rows: int = SAMPLE_ROWS, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> tuple[DataFrame, list[str], list[float], list[int]]:
    """(doc_id, source, tokens, p, bound) of the rows that take part: p is the membership in each target."""
    spark = docs.sparkSession
    rows = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").orderBy("source").collect()  # a table of targets
    names, shares, repeats = [r[0] for r in rows], [float(r[1]) for r in rows], [int(r[2]) for r in rows]
    t = docs.select("doc_id", source_name(F.col("source")).alias("source"), "text").where(F.length("text") > 0)
    t = t.where(F.col("source").isNull() | F.col("source").isin(names))
    model = spark.sparkContext.broadcast(fit_classifier(t.where(F.col("source").isNotNull()), names, sample_rows, folder, vocabulary))

    # a text is tokenized once, for its size and its membership
    @F.pandas_udf("tokens int, p array<double>")
    def read(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encode, (prior, table) = encoding(folder, vocabulary).encode_ordinary, model.value
        at = {k: i for i, k in enumerate(names)}
        for texts, sources in parts:
            sizes, p = [], []
            for x, source in zip(texts, sources):
                ids = encode(x)
                sizes.append(len(ids))
                p.append(posterior(ids, at.get(source, -1), prior, table))
            yield pd.DataFrame({"tokens": np.array(sizes, np.int32), "p": p})

    bound = F.create_map(*[F.lit(x) for k, m in zip(names, repeats) for x in (k, m)])[F.col("source")] if names else F.lit(1)
    t = t.withColumn("r", read.asNondeterministic()("text", "source")).withColumn("bound", F.coalesce(bound, F.lit(1)).cast("double"))
    return t.select("doc_id", "source", "r.tokens", "r.p", "bound").where("tokens > 0"), names, shares, repeats


def largest_total(most: np.ndarray, share: np.ndarray, shortfall: float) -> float:
    """Tokens of the mixture; most is what each source can give with all its repeats."""
    passed = 0.0
    for i in np.argsort(np.where(share > 0, most / np.where(share > 0, share, 1.0), np.inf), kind="stable"):
        if share[i] <= 0 or most[i] <= 0:
            continue
        if passed + share[i] <= shortfall + 1e-9:
            passed += share[i]
            continue
        return float(most[i] / share[i])
    return 0.0


def fit_rates(cells: DataFrame, shares: list[float], total_tokens: float | None, shortfall: float = SHORTFALL, steps: int = 40) -> tuple[list[np.ndarray], bool]:
    """(residual history, whether it converged): projected gradient over cells (p, bound, tokens)."""
    k = len(shares)
    spark = cells.sparkSession
    room = cells.select(F.posexplode("p").alias("s", "w"), "bound", "tokens").groupBy("s").agg(F.sum(F.col("w") * F.col("tokens") * F.col("bound")).alias("room"), F.sum(F.col("w") * F.col("tokens")).alias("once")).collect()  # one row per target
    most, once = np.zeros(k), np.zeros(k)
    for r in room:
        most[r["s"]], once[r["s"]] = r["room"], r["once"]
    share = np.array(shares)
    total = total_tokens or largest_total(most, share, shortfall)
    target = share * total
    history: list[np.ndarray] = []
    converged = False
    for step in range(steps + 1):
        past = spark.sparkContext.broadcast(np.array(history).reshape(-1, k))

        def reach(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = np.zeros(k)
            for c in parts:
                if len(c):
                    p = np.stack(c["p"].to_numpy())
                    acc += (rates(p, c["bound"].to_numpy(), past.value) * c["tokens"].to_numpy()) @ p
            yield pd.DataFrame({"s": np.arange(k), "a": acc})

        got = cells.mapInPandas(reach, "s int, a double").groupBy("s").agg(F.sum("a").alias("a")).collect()  # one row per target
        reached = np.zeros(k)
        for r in got:
            reached[r["s"]] = r["a"]
        off = np.where(once > 0, (target - reached) / np.maximum(once, 1.0), 0.0)
        # a source at its bound keeps its residual for good
        open_ = np.where((reached >= most - 1e-6 * np.maximum(most, 1)) & (target > reached), 0.0, target - reached)
        converged = bool(np.abs(open_).max(initial=0.0) <= 1e-4 * max(total, 1.0))
        if step == steps or converged:
            break
        history.append(off)
    return history, converged


def rates(p: np.ndarray, bound: np.ndarray, history: np.ndarray) -> np.ndarray:
    """The rate of each cell after the steps so far: r <- clip(r + p . residual, 0, bound), from 0."""
    r = np.zeros(len(p))
    for off in history:
        r = np.clip(r + p @ off, 0.0, bound)
    return r


def whole_copies(rated: DataFrame, share_size: int = 20_000) -> DataFrame:
    """Adds copies: rates as whole numbers, so that each share's tokens stay within half its smallest text of what the
    rates ask. Shares are of one source, of about share_size rows, however many rows the source has; within a share
    texts go from long to short and the tokens owed are carried on."""
    counts = rated.groupBy("source").agg(F.count("*").alias("n")).collect()  # targets, and one for no source
    lanes = {r["source"] or "": max(1, -(-r["n"] // share_size)) for r in counts}
    of = F.create_map(*[F.lit(x) for k, v in sorted(lanes.items()) for x in (k, v)])[F.coalesce("source", F.lit(""))] if lanes else F.lit(1)

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True])
        owed, out = 0.0, []
        for size, rate in zip(pdf["tokens"], pdf["rate"]):
            sure = int(rate)
            owed += (rate - sure) * size
            extra = rate > sure and owed >= size / 2
            owed -= size * extra
            out.append(sure + int(extra))
        return pdf.assign(copies=np.array(out, "int32"))[["doc_id", "source", "tokens", "p", "bound", "rate", "copies"]]

    t = rated.withColumn("lane", F.pmod(F.xxhash64("doc_id"), of).cast("int"))
    return t.groupBy("source", "lane").applyInPandas(carry, "doc_id long, source string, tokens int, p array<double>, bound double, rate double, copies int")


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, sample_rows: int = SAMPLE_ROWS, shortfall: float = SHORTFALL) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens, rate, copies) for every row with copies > 0, and the report by source. docs has doc_id,
    source, text."""
    spark = docs.sparkSession
    members, names, shares, repeats = memberships(docs, targets, sample_rows)
    members = written(members, "mix-members")
    cells = written(members.groupBy("p", "bound").agg(F.sum("tokens").alias("tokens")), "mix-cells")
    history, converged = fit_rates(cells, shares, total_tokens, shortfall)
    past = spark.sparkContext.broadcast(np.array(history).reshape(-1, len(names)))

    @F.pandas_udf("double")
    def rate(p: pd.Series, bound: pd.Series) -> pd.Series:
        return pd.Series(rates(np.stack(p.to_numpy()), bound.to_numpy(), past.value)) if len(p) else pd.Series([], dtype="float64")

    out = members.withColumn("rate", F.round(rate("p", "bound"), 9))
    out = written(whole_copies(out), "mix-copies")
    per = out.select(F.posexplode("p").alias("s", "w"), "tokens", "copies").where("w > 0").groupBy("s").agg(F.sum(F.col("w") * F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.sum(F.col("w") * F.col("tokens")).alias("own_tokens"))
    goal = spark.createDataFrame([(i, n, float(s), int(m)) for i, (n, s, m) in enumerate(zip(names, shares, repeats))], "s int, source string, target_share double, max_repeats int")
    named = out.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("named_tokens"), F.max("copies").alias("copied"))
    report = goal.join(per, "s", "left").join(named, "source", "left").fillna(0, ["mixed_tokens", "own_tokens", "named_tokens", "copied"])
    whole = per.agg(F.sum("mixed_tokens")).first()[0] or 0.0
    reached = (F.col("mixed_tokens") / F.lit(float(whole))) if whole else F.lit(0.0)
    by_name = (F.col("named_tokens") / F.lit(float(whole))) if whole else F.lit(0.0)
    report = report.select("source", "target_share", F.round(reached, 6).alias("actual_share"), F.round(by_name, 6).alias("named_share"), F.lit(converged).alias("converged"), "max_repeats", F.col("copied").alias("most_copies"), F.round("own_tokens", 3).alias("own_tokens"), F.round("mixed_tokens", 3).alias("mixed_tokens"))
    return out.where("copies > 0").select("doc_id", "source", "tokens", "rate", "copies"), report
