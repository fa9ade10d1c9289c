import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timberline.llm import toxicity
from timberline.llm.toxicity import Options, evidence, fit, score_toxicity, segments, solve_lambda


def brute(s):
    """Ruzzo and Tompa's definition: take the best segment, then go on left and right of it."""
    if not len(s):
        return []
    best, at = 0.0, None
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            v = sum(s[i:j])
            if v > best or (v == best and at and j - i < at[1] - at[0]):
                best, at = v, (i, j)
    if at is None:
        return []
    i, j = at
    return brute(s[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute(s[j:])]


@given(st.lists(st.sampled_from([-7, -3, -1, 1, 2, 4, 8]), max_size=18))
def test_segments_against_definition(s):
    got = segments(np.array(s, float))
    assert sum(v for *_, v in got) == sum(sum(s[a:b]) for a, b, _ in got)
    want = brute(s)
    assert [sum(s[a:b]) for a, b in want] == [v for *_, v in got]


def test_lambda():
    assert abs(solve_lambda(np.array([-1.0, 1.0]), np.array([0.75, 0.25])) - np.log(3)) < 1e-6


def documents(n, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{min(int(r.expovariate(0.02)), 400)}" for _ in range(r.randint(5, 150))]
        toxic = r.random() < 0.2
        for _ in range(r.randint(2, 5) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(["Idiot", "SCUM,", "clown"]))
        rows.append((i, " ".join(w), 1))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out(spark):
    rows, labels = documents(1200, 1)
    d, y = spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = fit(d.where("doc_id % 3 <> 1"), y)
    got = {r.doc_id: r for r in score_toxicity(d, m).collect()}
    held = [(got[i].predicted, t) for i, t in labels if i % 3 == 1]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and bool(r.passages) == (evidence(m, 1, []) [0] < 1e9 and r.score > min(x.score for x in got.values())) for r in got.values())


def test_odd_documents(spark, odd, none):
    y = spark.createDataFrame([(10, 1), (11, 0), (12, None), (None, 1), (10, 1)], "doc_id long, toxic int")
    m = fit(odd, y)
    got = score_toxicity(odd, m, keep=("doc_id", "text")).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert score_toxicity(none, fit(none, y)).count() == 0


def test_copies_do_not_shrink_the_calibration(spark, monkeypatch):
    """The calibration sees all of few texts, however many copies and labels of other rows there are."""
    rows, labels = documents(60, 2)
    rows, labels = [(i + 60 * k, t, 1) for k in range(500) for i, t, _ in rows], [(i + 60 * k, y) for k in range(1000) for i, y in labels]
    seen, whole = [], toxicity.hash_sample
    monkeypatch.setattr(toxicity, "hash_sample", lambda *a: seen.append(whole(*a)) or seen[0])
    d, y = spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, toxic int")
    fit(d, y, o=Options(sample=50))
    assert seen[0].count() == 50


def test_every_telling_token_counts(spark):
    """A toxic token keeps its score beside any number of clean tokens of larger z."""
    clean = spark.range(60_000).select(F.concat(F.lit("c"), "id").cast("binary").alias("token"), F.lit(0).alias("y1"), F.lit(60).alias("y0"))
    toxic = spark.range(1).select(F.lit("idiot").cast("binary").alias("token"), F.lit(32).alias("y1"), F.lit(0).alias("y0"))
    told = toxicity._told(clean.union(toxic), 3.6e6, 3.6e6, Options())
    assert told.where("d > 0").count() == 1 and told.count() == 60_001
