import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, tokens


@pytest.mark.parametrize("n, share", [(0, 50), (1, 50), (400, 50), (3000, 20_000)])
def test_every_item_in_one_block(spark, n, share):
    rng = random.Random(n)
    sizes = [int(min(3000, rng.lognormvariate(4, 1.2))) for _ in range(n)] + ([2500, 1000, 1001, 0] if n else [])
    d = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens int")
    b = packing.pack(d, 1000, share_size=share).collect()
    used, per = {}, {}
    for r in b:
        used[r["block_id"]] = used.get(r["block_id"], 0) + r["size"]
        per.setdefault(r["doc_id"], []).append((r["start"], r["size"]))
    assert all(v <= 1000 for v in used.values())
    for i, t in enumerate(sizes):
        parts = sorted(per.get(i, []))
        assert sum(p[1] for p in parts) == t
        assert t > 1000 or len(parts) <= 1
        assert all(a[0] + a[1] == c[0] for a, c in zip(parts, parts[1:]))
    if n >= 400:
        assert sum(used.values()) / (1000 * len(used)) > 0.85


def test_oversize_and_tokens(spark):
    d = spark.createDataFrame([(1, "word " * 30, 7), (2, "word", 7), (3, None, 7), (4, "", 7)], "doc_id long, text string, tokens_before int")
    sized = {r["doc_id"]: r["tokens"] for r in tokens.with_tokens(d).collect()}
    enc = tokens.encoding()
    assert sized == {1: len(enc.encode_ordinary("word " * 30)), 2: 1, 3: 0, 4: 0}
    assert [r["doc_id"] for r in packing.oversize(d, 10).collect()] == [1]
    assert [r["doc_id"] for r in packing.oversize(d, sized[1]).collect()] == []


def documents(spark):
    rng = random.Random(5)
    words = {"manual": "valve pump bolt", "note": "crew saw today", "log": "knots wind sea"}
    rows, k = [], 0
    for source, n in (("manual", 300), ("Note", 100), ("log ", 12), ("elsewhere", 20)):
        for _ in range(n):
            w = words.get(source.lower().strip(), "other thing").split()
            rows.append((k, source, " ".join(rng.choice(w) for _ in range(rng.randrange(5, 60)))))
            k += 1
    for s in ("manual", "note"):
        for _ in range(5):
            rows.append((k, None, " ".join(rng.choice(words[s].split()) for _ in range(30))))
            k += 1
    rows += [(k, "manual", None), (k + 1, "manual", "")]
    return tokens.with_tokens(spark.createDataFrame(rows, "doc_id long, source string, text string"))


def test_shares(spark):
    targets = spark.createDataFrame([("manual", 0.5, 1), ("note", 0.3, 2), ("log", 0.19, 4), ("none", 0.01, 4)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mixture(documents(spark), targets)
    r = {x["source"]: x for x in report.collect()}
    assert r["none"]["actual_share"] == 0
    for s, t in (("manual", 0.5), ("note", 0.3), ("log", 0.19)):
        assert abs(r[s]["actual_share"] - t / 0.99) < 0.02, (s, r[s])
        assert r[s]["most_copies"] <= r[s]["max_repeats"]
    assert mix.where("source = 'elsewhere'").count() == 0
    again = mixing.mixture(documents(spark), targets)[0]
    assert sorted(map(tuple, mix.collect())) == sorted(map(tuple, again.collect()))


def test_a_tiny_source_does_not_shrink_the_mixture():
    most, share = np.array([1000.0, 1.0, 0.0, 500.0]), np.array([0.6, 0.01, 0.1, 0.29])
    assert mixing.largest_total(most, share, 0.01) == pytest.approx(1000 / 0.6)
    assert mixing.largest_total(most, share, 0.0) == pytest.approx(100.0)
    assert mixing.largest_total(np.zeros(2), np.array([0.5, 0.5]), 0.01) == 0.0


def test_rates_are_projected_gradient():
    p = np.array([[1.0, 0.0], [0.5, 0.5]])
    r = mixing.rates(p, np.array([1.0, 2.0]), np.array([[2.0, 0.0], [-0.5, 1.0]]))
    assert r.tolist() == [0.5, 1.25]


def test_held_out_accuracy(spark):
    d = documents(spark)
    targets = spark.createDataFrame([("manual", 0.6, 1), ("note", 0.4, 2)], "source string, target_share double, max_repeats int")
    members, names, *_ = mixing.memberships(d, targets)
    got = members.where("source is null").orderBy("doc_id").collect()
    right = [np.argmax(r["p"]) == names.index("manual" if i < 5 else "note") for i, r in enumerate(got)]
    assert sum(right) / len(right) >= 0.9


def test_empty(spark):
    d = tokens.with_tokens(spark.createDataFrame([], "doc_id long, source string, text string"))
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mixture(d, targets)
    assert mix.count() == 0 and report.first()["actual_share"] == 0
    assert mix.where(F.col("copies") > 0).count() == 0


@pytest.mark.parametrize("k", [1, 3, 20, 41, 100])
def test_memberships_always_sum_to_one(k):
    for p in (np.full(k, 1 / k), np.eye(k)[0], np.random.default_rng(k).dirichlet(np.ones(k))):
        q = mixing.in_steps(p)
        assert abs(q.sum() - 1) < 1e-9 and np.allclose(q * mixing.STEPS, np.round(q * mixing.STEPS))
        assert np.abs(q - p).max() < 1 / mixing.STEPS + 1e-9


def test_sample_bound_is_exact_and_repeated_texts_are_one_row_each(spark):
    rows = [(i, "a", "x") for i in range(500)] + [(1000 + i, "b", "y") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    prior, table = mixing.fit_classifier(d, ["a", "b"], 60)
    # one token a text: the likelihood gives away how many rows were read
    n = [np.exp(-table[i].min()) * 0.1 - 0.1 * mixing.BUCKETS for i in (0, 1)]
    assert 45 <= round(n[0]) <= 60 and round(n[1]) == 40


def test_a_name_is_evidence_and_the_text_too(spark):
    d = documents(spark)
    targets = spark.createDataFrame([("manual", 0.6, 1), ("note", 0.4, 2)], "source string, target_share double, max_repeats int")
    members, names, *_ = mixing.memberships(d, targets)
    own = [r["p"][names.index(r["source"])] for r in members.where("source is not null").collect()]
    assert min(own) > 0.5 and np.mean(own) > 0.9
    rng = np.random.default_rng(0)
    prior, table = np.log([0.5, 0.5]), np.log(rng.dirichlet(np.ones(mixing.BUCKETS), 2)).astype(np.float32)
    ids = [int(np.argmax(table[0] - table[1]))]
    assert mixing.posterior(ids, -1, prior, table)[0] > mixing.posterior([], -1, prior, table)[0] == 0.5
    assert mixing.posterior(ids, 1, prior, table)[1] < mixing.posterior([], 1, prior, table)[1]


def test_split_documents_are_those_the_packer_cut(spark):
    d = spark.createDataFrame([(1, 999), (2, 1000), (3, 1001), (4, 5000), (5, 0)], "doc_id long, tokens int")
    assert {r["doc_id"] for r in packing.pack(d, 1000).where("part > 0").collect()} == {3, 4}


def test_lanes_follow_the_bins(spark):
    # no loose items at all: gaps are spread over as many lanes as there are shares of bins
    d = spark.createDataFrame([(i, 600) for i in range(400)], "doc_id long, tokens int")
    assert packing.pack(d, 1000, share_size=50).groupBy("block_id").count().count() == 400
