import math
from collections import Counter
from itertools import product

import numpy as np
import pytest

from timberline.llm import piece_sampling as ps

TEXTS = ["", " ", "a", "the cat", "  two  spaces ", "\n\n", "日本 x\ty", "▁a▁ ▁", "a\r\nb\0c 😀 　", "x" * 3000, "naïve café " * 50, "f0e1d2c3b4", " " * 40]


def lattice(vocab, unit, alpha):
    """All segmentations of a unit with their probabilities, by recursion."""
    by = {}
    for i, raw in enumerate(vocab.raw):
        if len(raw) > 1 or i not in vocab.byte_ids:
            by[raw.decode("utf-8", "replace")] = i

    def go(s):
        if not s:
            return [((), 0.0)]
        out = []
        for k in range(1, len(s) + 1):
            if s[:k] in by and s[:k] and by[s[:k]] > 258:
                out += [((by[s[:k]], *t), alpha * vocab.log_prob[by[s[:k]]] + w) for t, w in go(s[k:])]
            elif k == 1:
                b = s[0].encode()
                out += [((*vocab.byte_ids[list(b)].tolist(), *t), -alpha * len(b) * math.log(len(vocab.raw)) + w) for t, w in go(s[1:])]
        return out

    ways = go(unit)
    total = math.log(sum(math.exp(w) for _, w in ways))
    return {t: w - total for t, w in ways}


def whole(vocab, text, alpha):
    parts = [lattice(vocab, u, alpha) for u in ps.UNIT.findall(" " + text)]
    return {tuple(x for t in c for x in t): sum(p[t] for p, t in zip(parts, c, strict=True)) for c in product(*parts)}


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip_and_distinct(text):
    s = ps.Sampler(ps.MODEL, 4, 0.7)
    got = s.batch([text, text], np.array([1, 2], "u8"))
    for samples in got:
        assert all(ps.decode_ids(s.vocab, x[3].tolist()) == text for x in samples)
        assert len({tuple(x[3].tolist()) for x in samples}) == len(samples)
        assert [x[0] for x in samples] == sorted((x[0] for x in samples), reverse=True)
        assert all(x[2] <= 0 for x in samples)


def test_all_segmentations_of_a_short_text():
    s = ps.Sampler(ps.MODEL, 500, 0.7)
    want = whole(s.vocab, "the é", 0.7)
    (got,) = s.batch(["the é"], np.array([5], "u8"))
    assert {tuple(x[3].tolist()) for x in got} == set(want)
    assert all(abs(x[1] - want[tuple(x[3].tolist())]) < 1e-6 and x[2] == 0 for x in got)


def test_distribution():
    """First samples follow the lattice's distribution; ordered pairs follow sampling without replacement."""
    s, n = ps.Sampler(ps.MODEL, 2, 0.7), 20_000
    want = whole(s.vocab, "an ox", 0.7)
    got = s.batch(["an ox"] * n, np.arange(n, dtype="u8") * np.uint64(7919))
    first = Counter(tuple(x[0][3].tolist()) for x in got)
    pairs = Counter(tuple(tuple(y[3].tolist()) for y in x) for x in got)
    p = {k: math.exp(v) for k, v in want.items()}
    for k, v in p.items():
        assert abs(first[k] / n - v) < 5 * math.sqrt(v / n) + 1e-3
    for a, b in sorted(product(p, p), key=lambda x: -p[x[0]] * p[x[1]])[:30]:
        if a != b:
            q = p[a] * p[b] / (1 - p[a])
            assert abs(pairs[a, b] / n - q) < 5 * math.sqrt(q / n) + 1e-3


def test_inclusion_scores_are_unbiased():
    """Sum of p / inclusion over the samples estimates 1 (the total probability)."""
    s, n = ps.Sampler(ps.MODEL, 3, 0.7), 4000
    got = s.batch(["an ox"] * n, np.arange(n, dtype="u8") * np.uint64(104729))
    assert abs(np.mean([sum(math.exp(x[1] - x[2]) for x in g) for g in got]) - 1) < 0.03


def test_rows_do_not_depend_on_batches(spark, odd, none):
    a = {(r.doc_id, r.text): r.samples for r in ps.sample_segmentations(odd, keep=("doc_id", "text"), k=3).collect()}
    b = ps.sample_segmentations(odd.repartition(7), keep=("doc_id", "text"), k=3).collect()
    assert len(b) == odd.count()
    for r in b:
        same = a[r.doc_id, r.text]
        assert r.round_trip and [x["ids"] for x in same] == [x["ids"] for x in r.samples]
        assert np.allclose([x[:3] for x in same], [x[:3] for x in r.samples])
        assert (r.text is None) == (len(r.samples) == 0)
    assert ps.sample_segmentations(none).count() == 0
    ids = spark.createDataFrame([(1, b[0].samples[0]["ids"] if b[0].samples else []), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in ps.decode(ids).collect()}[2] is None


def test_lattices_keep_the_units_met_most(monkeypatch):
    """A worker's lattices stay within their room, and what is drawn does not depend on what they hold."""
    vocab = ps.vocabulary(ps.MODEL)
    texts = [f"the cat w{i}x{i * 7919} sat on the mat {i * i} é日 " + "naïve " * (i % 3) for i in range(400)]
    want = ps.Sampler(ps.MODEL, 3, 0.7)
    want.lat = ps.Lattices(vocab, 0.7)
    want = want.batch(texts, np.arange(400, dtype="u8"))
    monkeypatch.setattr(ps, "MAX_STATES", 600)
    small = ps.Sampler(ps.MODEL, 3, 0.7)
    small.lat = ps.Lattices(vocab, 0.7)
    for i in range(0, 400, 20):
        got = small.batch(texts[i : i + 20], np.arange(i, i + 20, dtype="u8"))
        for a, b in zip(got, want[i : i + 20], strict=True):
            assert [x[3].tolist() for x in a] == [x[3].tolist() for x in b]
            assert np.allclose([x[:3] for x in a], [x[:3] for x in b])
        held = small.lat.states
        small.lat.starts([])
        assert small.lat.states <= 600 < held or held == small.lat.states
    assert " the" in small.lat.start and " cat" in small.lat.start


def test_units_are_those_of_the_pattern():
    """Units are cut and numbered in bulk as the pattern finds them, whatever stands before in the batch."""
    texts = [*TEXTS, " \n  \n", "a \n b", "a  b\n", "\na", "  ", "ab" * 40 + " ", "𝔘" * 50, "ab ba abab  ab"]
    lat = ps.Lattices(ps.vocabulary(ps.MODEL), 0.7)
    numbers, n = lat.starts(texts)
    want = [ps.UNIT.findall(" " + t) if t else [] for t in texts]
    assert n.tolist() == [len(x) for x in want]
    flat = [u for x in want for u in x]
    assert len(set(flat)) == len(lat.start) == len(set(zip(flat, numbers.tolist(), strict=True)))
    again = ps.Lattices(lat.vocab, 0.7)
    for t, x in zip(reversed(texts), reversed(want), strict=True):
        got, _ = again.starts([t])
        assert again.log_first[got].tolist() == lat.log_first[[numbers[flat.index(u)] for u in x]].tolist()
        assert all(u in again.start for u in x) and " never met" not in again.start


@pytest.mark.parametrize("unit", [" the", " internationalization", "x" * 1000, "𝔘" * 90, "日本" * 30, "a𝔘" * 40])
def test_probabilities_of_units_of_any_length(unit):
    """First paths have the probabilities that a sum over all ways gives; so do the steps of every state."""
    vocab = ps.vocabulary(ps.MODEL)
    lat = ps.Lattices(vocab, 0.7)
    ((number,), _) = lat.starts([unit.removeprefix(" ")])
    unit = " " + unit.removeprefix(" ")
    by = {raw.decode("utf-8", "replace"): i for i, raw in enumerate(vocab.raw) if i > 258}
    ahead = [0.0] * (len(unit) + 1)
    for i in reversed(range(len(unit))):
        ways = [0.7 * vocab.log_prob[by[unit[i : i + k]]] + ahead[i + k] for k in range(1, min(vocab.longest, len(unit) - i) + 1) if unit[i : i + k] in by]
        if unit[i] not in by:
            ways.append(-0.7 * len(unit[i].encode()) * math.log(len(vocab.raw)) + ahead[i + 1])
        ahead[i] = np.logaddexp.reduce(ways)
    path = list(lat.first_path(number))
    weight = sum(0.7 * vocab.log_prob[p] if p >= 0 else -0.7 * len(chr(-1 - p).encode()) * math.log(len(vocab.raw)) for p in lat.piece[path].tolist())
    assert lat.log_first[number] == pytest.approx(weight - ahead[0], rel=1e-9, abs=1e-9)
    cut = lat.first_edge[: lat.states]
    assert np.allclose(np.add.reduceat(np.exp(lat.log_p[: lat.edges]), cut[~lat.last[: lat.states]]), 1)


def test_most_units_are_drawn_without_steps(monkeypatch):
    """Steps are drawn for units that leave their first path; no text's samples depend on its batch, to the last bit."""
    texts = [f"the cat and the dog sat on the mat of house {i} and they said that it was a good day" for i in range(60)]
    walked, walk = [], ps.Lattices.walk
    monkeypatch.setattr(ps.Lattices, "walk", lambda self, state, *rest: walked.append(len(state)) or walk(self, state, *rest))
    s = ps.Sampler(ps.MODEL, 4, 0.7)
    got = s.batch(texts, np.arange(60, dtype="u8"))
    assert 0 < sum(walked) < sum(len(ps.UNIT.findall(" " + t)) for t in texts)
    for i in range(0, 60, 7):
        for a, b in zip(s.batch(texts[i : i + 7], np.arange(i, min(i + 7, 60), dtype="u8")), got[i : i + 7], strict=True):
            assert [(*x[:3], x[3].tolist()) for x in a] == [(*x[:3], x[3].tolist()) for x in b]


def test_largest_of_each_owner():
    s = ps.Sampler(ps.MODEL, 4, 0.7)
    r = np.random.default_rng(3)
    owner = np.sort(r.integers(0, 40, 5000))
    vals = np.round(r.normal(size=5000), 3)
    got = s._largest(np.arange(5000), owner, vals)
    for o in set(owner.tolist()):
        assert [v for v, _ in got[o]] == sorted(vals[owner == o].tolist(), reverse=True)[:5]
        assert all(owner[e] == o and vals[e] == v for v, e in got[o])


def test_a_wrong_sample_is_told():
    """Every byte counts, also of pieces longer than a word of eight, and of samples of another length."""
    vocab = ps.vocabulary(ps.MODEL)
    long_ = max((i for i, x in enumerate(vocab.raw) if len(x) > 8 and x[:1] == b" "), key=lambda i: len(vocab.raw[i]))
    text = vocab.raw[long_].decode()[1:]
    sample = [(0.0, 0.0, 0.0, np.array([long_], "i4"))]
    assert ps._exact(vocab, [text, text[:-1] + "#", text + "#"], [sample] * 3) == [True, False, False]
    assert ps._exact(vocab, [text, text[:-1] + "#"], [sample] * 2) == [True, False]
