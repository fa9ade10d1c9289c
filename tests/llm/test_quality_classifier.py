import random

import numpy as np
from pyspark.sql import functions as F

from timberline.llm import quality_classifier
from timberline.llm.quality_classifier import Model, Options, classify, evidence, features, fit, measure, posteriors, probability

SCHEMA = "doc_id long, text string, lang string, source string, quality_score string, n int"


def corpus(n, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"word{r.randint(0, 500)}" for _ in range(r.randint(15, 80))]
        bad = r.random() < 0.25
        kind = i % 3
        if bad:
            w = [x.upper() + "!!" for x in w] if kind == 0 else [x + "$$$" for x in w] if kind == 1 else w[:1] * len(w)
        rows.append((i, " ".join(w), r.choice(["en", "de"]), f"s{i % 5}", "clash", 1))
        labels.append((i, int(not bad)))
    return rows, labels


def test_held_out_and_clash(spark):
    rows, labels = corpus(900, 1)
    d = spark.createDataFrame(rows, SCHEMA)
    m = fit(measure(d.where("doc_id % 2 = 0")), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r for r in classify(d, m).collect()}
    assert np.mean([got[i].accepted == bool(y) for i, y in labels if i % 2]) > 0.97
    assert got[0].n == 1 and isinstance(got[0].quality_score, float)


def test_posterior_by_hand(spark):
    """A document's site is what its path and host say when the document itself is taken away."""
    rows, labels = corpus(200, 2)
    rows = [(*x[:3], "tiny" if x[0] == 7 else ("bad" if x[0] % 4 == 0 else "good"), *x[4:]) for x in rows]
    d = spark.createDataFrame(rows, SCHEMA)
    m = fit(measure(d), spark.createDataFrame(labels, "doc_id long, quality int"))
    e = probability(m, np.array([features(x[1]) for x in rows]))
    _, mean, upper, lower = posteriors(measure(d).withColumn("_e", evidence(m, F.col("_x"))), "_host", "_path")
    assert abs(mean - e.mean()) < 1e-9
    for r in classify(d, m).collect():
        others = [k for k in range(len(rows)) if k != r.doc_id]
        host = [e[k] for k in others if rows[k][3] == r.source]
        path = [e[k] for k in others if rows[k][2:4] == (r.lang, r.source)]
        above = np.average([mean, *host], weights=[upper, *[1] * len(host)])
        assert abs(r.site_quality - np.average([above, *path], weights=[lower, *[1] * len(path)])) < 1e-6


def test_weights_recover_known_spreads(spark):
    """Simulated sites: the weight of a host's mean is the variance in a path over that between paths of one host."""
    r = np.random.default_rng(5)
    host = np.repeat(r.normal(0.5, 0.3, 150), 4)
    path = host + r.normal(0, 0.05, 600)
    rows = [(f"h{k // 4}", f"p{k % 4}", float(x)) for k in range(600) for x in r.normal(path[k], 0.1, r.integers(10, 60))]
    _, mean, upper, lower = posteriors(spark.createDataFrame(rows, "h string, p string, _e double"), "h", "p")
    assert abs(mean - 0.5) < 0.1 and 3 < lower < 5.2  # 0.1 ** 2 / 0.05 ** 2 = 4, whatever the hosts' spread
    assert upper == 1.0  # hosts that differ so much stand for themselves


def test_odd_documents(spark, odd, none):
    y = spark.createDataFrame([(10, 1), (11, 0), (12, None), (None, 1), (10, 1)], "doc_id long, quality int")
    got = classify(odd, fit(measure(odd), y)).collect()
    assert len(got) == odd.count() and all(0 <= r.quality_score <= 1 for r in got)
    assert classify(none, fit(measure(none), y)).count() == 0
    assert all(abs(r.text_quality - 0.5) < 1e-9 for r in classify(odd, Model()).collect())


def test_copies_do_not_shrink_the_sample(spark, monkeypatch):
    """The fit sees all of few texts, however many copies and labels of other rows there are."""
    rows, labels = corpus(60, 3)
    rows, labels = [(x[0] + 60 * k, *x[1:]) for k in range(500) for x in rows], [(i + 60 * k, y) for k in range(1000) for i, y in labels]
    seen, whole = [], quality_classifier.hash_sample
    monkeypatch.setattr(quality_classifier, "hash_sample", lambda *a: seen.append(whole(*a)) or seen[0])
    fit(measure(spark.createDataFrame(rows, SCHEMA)), spark.createDataFrame(labels, "doc_id long, quality int"), o=Options(sample=50))
    assert seen[0].count() == 50
