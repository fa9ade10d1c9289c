import random
import zlib
from dataclasses import replace

import numpy as np
import pytest

from timberline.llm.language_id import Scorer, TrainOptions, _forward, fit, identify, op4_language_id, to_windows, train, training_sample

SF = "/root/testdata/sf0.001"
SYLLABLES = {"aa": "the ing and tion er on".split(), "bb": "der sch ung ein keit ö".split(), "cc": "que eau é ment tre ou".split()}


def sentence(lang, k, r):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(k))


@pytest.fixture(scope="module")
def model():
    r = random.Random(2)
    labels = [v for v in SYLLABLES for _ in range(150)]
    return train([sentence(v, 40, r).encode() for v in labels], labels, TrainOptions(epochs=4))


def test_held_out_accuracy(model):
    r = random.Random(3)
    labels = [v for v in SYLLABLES for _ in range(50)]
    got, score = Scorer(model).texts([sentence(v, 30, r) for v in labels])
    assert np.mean([a == b for a, b in zip(got, labels, strict=True)]) > 0.97
    assert ((score > 0) & (score <= 1)).all()


def test_tables_equal_the_network(model):
    r = random.Random(4)
    x, counts = to_windows([sentence("aa", 60, r).encode(), b"x", b""], model.window)
    assert counts.tolist()[1:] == [1, 0]
    assert np.allclose(Scorer(model).windows(x), _forward(model, x)[2], atol=1e-4)


def test_whole_text_counts(model):
    r = random.Random(5)
    assert Scorer(model).texts([sentence("aa", 20, r) + " " + sentence("bb", 400, r)])[0] == ["bb"]


def test_gradient_steps_lower_the_loss_as_differences_say():
    """One step of the optimizer moves every weight against the sign of its numeric gradient."""
    texts = [b"the tion erth", b"der schkeit u", b"tionthe ering"]
    labels = ["a", "b", "a"]
    o = TrainOptions(window=16, epochs=0, batch=8, rate=1e-4)
    before, after = train(texts, labels, o), train(texts, labels, replace(o, epochs=1))
    x, _ = to_windows(texts, 16)
    y = np.array([0, 1, 0])
    loss = lambda: -np.log(_forward(before, x)[2][np.arange(3), y]).mean()
    checked = 0
    for old, new in zip([before.embed, *before.filters, before.out, before.out_bias], [after.embed, *after.filters, after.out, after.out_bias], strict=True):
        flat, moved = old.reshape(-1), (new - old).reshape(-1)
        for k in np.linspace(0, flat.size - 1, 40).astype(int):
            kept, size = flat[k], 1e-5
            flat[k] = kept + size
            up = loss()
            flat[k] = kept - size
            slope = (up - loss()) / (2 * size)
            flat[k] = kept
            if abs(slope) > 1e-5:
                assert np.sign(moved[k]) == -np.sign(slope)
                checked += 1
    assert checked > 60


def test_many_languages_and_letters(spark):
    """Rare languages are learned beside a hundred others; superscripts, fractions and numerals are no letters."""
    rows = [(f"l{k:03d}", f"{chr(0x4E00 + k) * 3} {i}") for k in range(100) for i in range(6)]
    m = fit(spark.createDataFrame(rows, "lang string, text string"), o=TrainOptions(epochs=0, sample=200))
    assert len(m.languages) == 100
    assert Scorer(m).texts(["\u00b2 \u00bd \u2167 12", "\u00b2x"])[0][0] == "und"
    assert Scorer(m).texts(["\u00b2x"])[0][0] != "und"


def test_query_on_tables(spark):
    """Held-out rows by their checksum, and accuracy on them."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op4_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    told = [r for r in got if r.held_out and docs[r.doc_id].lang and docs[r.doc_id].text and len(docs[r.doc_id].text) > 30]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in told]) > 0.9


def test_odd_documents(spark, odd, none):
    m = fit(odd, o=TrainOptions(epochs=1))
    assert m.languages == ["de", "en"]
    got = identify(odd, m, keep=("doc_id", "text")).collect()
    assert len(got) == odd.count()
    for r in got:
        assert 0 <= r.score <= 1
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0)
    assert identify(none, fit(none)).count() == 0
    assert {r.lang_pred for r in identify(odd, fit(none)).collect()} == {"und"}


def test_copies_do_not_shrink_the_sample(spark):
    """Thousands of copies of few texts: all texts are taken, and their language is learned."""
    r = random.Random(6)
    few = [sentence("aa", 12, r) for _ in range(3)]
    many = [("bb", sentence("bb", 12, r)) for _ in range(900)] + [("cc", sentence("cc", 12, r)) for _ in range(60)]
    d = spark.createDataFrame([("aa", few[i % 3]) for i in range(60_000)] + many, "lang string, text string").repartition(4)
    n = training_sample(d).groupby("lang")["text"].agg(["size", "nunique"])
    assert n.loc["aa"].tolist() == [3, 3] and n.loc["bb"].tolist() == [400, 400] and n.loc["cc"].tolist() == [60, 60]
    assert fit(d, o=TrainOptions(epochs=1)).languages == ["aa", "bb", "cc"]
