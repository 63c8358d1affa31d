import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations as c

S = "id long, conversation_id string, user_name string, role string, content string, created_at timestamp"
T0 = datetime(2025, 1, 1, 9, 0)


def rows(spec, cid="aa-1", start=0):
    return [(start + i, cid, cid, r, t, T0 + timedelta(minutes=m) if m is not None else None) for i, (r, t, m) in enumerate(spec)]


def kept(spark, spec):
    turns, verdict, _ = c.rebuild(spark.createDataFrame(rows(spec), S))
    return [(r["turn_no"], r["id"]) for r in turns.orderBy("turn_no").collect()], [r["verdict"] for r in verdict.collect()]


Q, A = ("user", "why?", 0), ("assistant", "because", 1)


@pytest.mark.parametrize(
    "spec, ids",
    [
        ([Q, A], [0, 1]),
        ([A, Q], [1, 0]),
        ([("human", "x", 0), ("bot", "y", 200)], [0, 1]),
        ([("System", "rules", None), ("Engineer", "x", 1), ("AI", "y", 2)], [1, 2]),
        ([Q, ("user", "WHY ?", 1), ("assistant", "y", 2)], [0, 2]),
        ([Q, ("user", "why?", 200), ("assistant", "y", 400)], [0, 2]),
        ([("user", "q", 0), ("assistant", "a", 0)], [0, 1]),
        ([Q], []),
        ([("assistant", "a", 0), ("user", "q", 1)], []),
        ([Q, ("user", "other", 1), ("assistant", "y", 2)], []),
        ([Q, ("assistant", "...", 1)], []),
        ([Q, ("assistant", "[no response]", 1)], []),
        ([Q, ("assistant", "ERROR 529 overloaded", 1)], []),
        ([Q, ("assistant", "Error codes on the panel mean a broken wire.", 1)], [0, 1]),
        ([Q, ("assistant", "ok", None)], []),
        ([Q, ("unknown", "ok", 1)], []),
        ([Q, (None, "ok", 1)], []),
        ([Q, ("assistant", None, 1)], []),
    ],
)
def test_verdicts(spark, spec, ids):
    turns, _ = kept(spark, spec)
    assert [i for _, i in turns] == ids and [n for n, _ in turns] == list(range(1, len(ids) + 1))


def test_one_id_is_one_message_and_ids_in_one_spelling(spark):
    r = rows([Q, A], "AB-1")
    d = spark.createDataFrame([r[0], r[0], (r[1][0], "{ab-1}", *r[1][2:])], S)
    turns = c.rebuild(d)[0]
    assert [(x["conversation_id"], x["turn_no"]) for x in turns.orderBy("turn_no").collect()] == [("ab-1", 1), ("ab-1", 2)]


@pytest.mark.parametrize("turns_in_a_range", [25_000, 60, 5])
def test_brute_force(spark, monkeypatch, turns_in_a_range):
    monkeypatch.setattr(c, "FEW_TURNS", turns_in_a_range)
    rng = random.Random(1)
    data = []
    for k in range(120):
        spec = [(rng.choice(["user", "assistant", "user", "assistant", "system", "?"] if rng.random() < 0.3 else ["user", "assistant"]), rng.choice("ab"), rng.randrange(0, 400)) for _ in range(rng.randrange(1, 7))]
        data += rows(spec, f"c{k}", k * 10)
    # one conversation far longer than a range
    data += rows([(("user", "assistant")[i % 2], "abc"[i % 3], i // 2) for i in range(300)], "c120", 5000)
    rng.shuffle(data)
    got = {(r["conversation_id"], r["turn_no"]): r["id"] for r in c.rebuild(spark.createDataFrame(data, S))[0].collect()}
    want = {}
    for k in range(121):
        t = sorted((r for r in data if r[1] == f"c{k}" and r[3] != "system"), key=lambda r: (r[5], r[0]))
        t = [r for i, r in enumerate(t) if not (i and r[3] == t[i - 1][3] and r[4] == t[i - 1][4])]
        if t and all(r[3] == ("user", "assistant")[i % 2] for i, r in enumerate(t)) and len(t) % 2 == 0:
            want |= {(f"c{k}", i + 1): r[0] for i, r in enumerate(t)}
    assert got == want and want


def skewed(late_s, n=6, user="ann", start=0):
    """n conversations of a user whose clock is late_s seconds behind; replies take 5 to 40 s, next questions 60 to 600 s."""
    rng, out = random.Random(7 + start), []
    for k in range(n):
        at = T0 + timedelta(days=k)
        for i in range(2 * rng.randrange(1, 5)):
            role = ("user", "assistant")[i % 2]
            out.append((start + k * 20 + i, f"{user}{k}", user, role, f"text {i}", at - timedelta(seconds=late_s if role == "user" else 0)))
            at += timedelta(seconds=rng.randrange(5, 41) if i % 2 == 0 else rng.randrange(60, 600))
    return out


@pytest.mark.parametrize("late_s", [1800, -1800, 3000, 0])
def test_a_skewed_clock_is_found_and_undone(spark, late_s):
    data = skewed(late_s, 8) + skewed(0, 8, "bob", 1000)
    d = spark.createDataFrame(data, S)
    turns, verdict, offsets = c.rebuild(d)
    found = {r["sender"]: (r["offset_s"], r["applied"]) for r in offsets.collect()}
    assert {(r["conversation_id"], r["turn_no"]): r["id"] for r in turns.collect()} == {(r[1], r[0] % 20 + 1): r[0] for r in data}
    assert all(r["verdict"] == "kept" for r in verdict.collect())
    assert "bob" not in found
    if late_s:
        assert found["ann"][1] and abs(found["ann"][0] - late_s) < 60
    else:
        assert not found
    # the stored times come out as they are
    assert {r["created_at"] for r in turns.collect()} == {r[5] for r in data}


def test_beyond_the_bound_is_infeasible(spark):
    d = spark.createDataFrame([r for r in skewed(1800, 8) if r[0] % 20 < 6], S)
    turns, verdict, offsets = c.rebuild(d, max_offset_s=60.0)
    assert offsets.first()["offset_s"] <= 60.0
    assert turns.select("conversation_id").distinct().count() < 8 == verdict.count()


def test_one_broken_conversation_is_no_clock(spark):
    data = skewed(0, 8)
    broken = [(900, "ann9", "ann", "assistant", "a", T0), (901, "ann9", "ann", "user", "q", T0 + timedelta(seconds=9))]
    turns, verdict, offsets = c.rebuild(spark.createDataFrame(data + broken, S))
    r = offsets.first()
    assert (r["sender"], r["violated"], r["applied"]) == ("ann", 1, False)
    assert {x["conversation_id"] for x in turns.collect()} == {f"ann{k}" for k in range(8)}


def test_offset_is_the_least_squares_one(spark):
    data = skewed(700, 5) + [(900, "annx", "ann", "user", "q", T0), (901, "annx", "ann", "assistant", "a", T0 + timedelta(seconds=100))]
    data += [(910, "anny", "ann", "user", "q", T0), (911, "anny", "ann", "assistant", "a", T0 + timedelta(seconds=300))]
    seq = c.sequence(c.clean_messages(spark.createDataFrame(data, S)).withColumn("at", F.col("created_at")))
    got = c.clock_offsets(seq).first()["offset_s"]
    by = {}
    for r in data:
        by.setdefault((r[1], r[3]), []).append(r[5].timestamp())
    upper, lower = [], []
    for (cid, role), q in by.items():
        if role == "user":
            a = by[cid, "assistant"]
            upper += [y - x for x, y in zip(sorted(q), sorted(a))]
            lower += [y - x for x, y in zip(sorted(q)[1:], sorted(a))]

    def loss(o):
        return sum(max(0, o - u) ** 2 for u in upper) + sum(max(0, v - o) ** 2 for v in lower)

    best = min((o / 10 for o in range(-36000, 36001)), key=loss)
    assert loss(best) > 0 and abs(got - best) < 1.0


def test_texts_are_put_back(spark):
    d = spark.createDataFrame(rows([Q, ("user", "WHY ?", 1), A]), S)
    got = c.with_content(c.rebuild(d)[0], d).orderBy("turn_no").collect()
    assert [(r["turn_no"], r["role"], r["content"]) for r in got] == [(1, "user", "why?"), (2, "assistant", "because")]


def test_empty(spark):
    turns, verdict, offsets = c.rebuild(spark.createDataFrame([], S))
    assert turns.count() == 0 and verdict.count() == 0 and offsets.count() == 0
