import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timberline.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<float>, label int, code int, error string, scanned int, bounds int, _l int, _n int"


def brute(rows, o):
    """Codes, errors and codebooks by plain Lloyd rounds in Python's integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(o.scale * x) for x in v] for _, v, _ in kept]
    d = len(ints[0]) // o.parts
    part = lambda x, p: x[p * d : (p + 1) * d]
    books = [[part(x, p) for x in ints[: o.entries]] for p in range(o.parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (dist(part(x, p), books[p][e]), e)) for p in range(o.parts)] for x in ints]
    for _ in range(o.rounds):
        of = assign()
        for p in range(o.parts):
            for e in range(len(books[p])):
                mine = [part(x, p) for x, a in zip(ints, of, strict=True) if a[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for (i, _, lab), x, a in zip(kept, ints, assign(), strict=True):
        out.append((i, lab, bytes(a), min(sum(dist(part(x, p), books[p][a[p]]) for p in range(o.parts)), vc.MAX_LONG)))
    return out, ",".join(str(v) for b in books for e in b for v in e)


def key(r):
    return (r[0] is None, r[0] or 0, str(r))


def check(spark, rows, o, schema=SCHEMA):
    df = spark.createDataFrame([(*r, 1, "x", 1, 1, 1, 1) for r in rows], schema).repartition(3)
    codes, books, scanned = vc.vector_codes(df, o=o)
    got = sorted(((r.vec_id, r.label, bytes(r.code), r.error) for r in codes.collect()), key=key)
    stored = [(r.vec_id, r.embedding, r.label) for r in df.select("vec_id", "embedding", "label").collect()]
    want, text = brute(stored, o)
    assert got == sorted(want, key=key)
    assert vc.text_of(books) == text
    return codes, scanned


def rows_of(n, dims, seed, spread=1.0, ids=None):
    r = random.Random(seed)
    centres = [[r.gauss(0, spread) for _ in range(dims)] for _ in range(12)]
    out = [(i if ids is None else ids(i), [c + r.gauss(0, 0.15 * spread) for c in r.choice(centres)], r.choice([1, 1, 1, 2, None])) for i in range(n)]
    r.shuffle(out)
    return out


def test_with_nulls_ties_and_repeats(spark):
    bad = [(5000, None, 1), (5001, [None] * 8, 1), (5002, [float("nan")] + [0.0] * 7, 1), (5003, [float("-inf")] + [0.0] * 7, None)]
    rows = rows_of(300, 8, 1)
    rows += bad + rows[:20] + [(None, rows[3][1], None), (7, [0.25] * 8, 2), (7, [-0.25] * 8, None)]
    codes, scanned = check(spark, rows, vc.CodeOptions(parts=4, entries=32, rounds=4, groups=5))
    assert scanned[0] == 4 * 32 * (300 + 20 + 3)
    assert all(s < 0.7 * scanned[0] for s in scanned[1:])  # bounds spare most groups
    with_labels = vc.with_label_errors(codes).collect()
    for lab in (1, 2, None):
        mine = [r for r in with_labels if r.label == lab]
        assert {r.label_error for r in mine} == {sum(r.error for r in mine)}
    assert len(with_labels) == 323


def test_small_integers_full_of_ties(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([0.0, 1.0, 2.0]) for _ in range(4)], 1) for i in range(200)]
    check(spark, rows, vc.CodeOptions(parts=2, entries=16, rounds=3, scale=1, groups=4))


def test_fewer_rows_than_entries(spark):
    check(spark, rows_of(20, 8, 2), vc.CodeOptions())


def test_huge_components(spark):
    """Beyond 64 bits the integers are Python's; an error that no long holds is the greatest long."""
    rows = rows_of(60, 4, 3, spread=1e9) + [(99, [3e38, -3e38, 0.0, 1e-30], None)]
    codes, _ = check(spark, rows, vc.CodeOptions(parts=2, entries=6, rounds=2, groups=2))
    assert vc.with_label_errors(codes).where("label is null").first().label_error == vc.MAX_LONG


def test_empty_tables_and_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], 1)], "vec_id bigint, embedding array<float>, label int")
    codes, books, scanned = vc.vector_codes(df.limit(0))
    assert codes.count() == 0 and books is None and scanned == []
    assert vc.with_label_errors(codes).count() == 0
    no_length = df.withColumn("embedding", F.expr("cast(array() as array<float>)"))
    assert [(r.vec_id, bytes(r.code), r.error) for r in vc.vector_codes(no_length)[0].collect()] == [(1, bytes(4), 0)]
    with pytest.raises(ValueError):
        vc.vector_codes(df.unionByName(no_length))


def test_decoded_vectors_are_near(spark):
    df = spark.createDataFrame([(*r, 1, "x", 1, 1, 1, 1) for r in rows_of(300, 8, 5)], SCHEMA)
    codes, books, _ = vc.vector_codes(df, o=vc.CodeOptions(entries=64))
    both = vc.decode(codes, books).join(df.select("vec_id", "embedding"), "vec_id").collect()
    for r in both:
        gap = sum((math.floor(1024 * a) - 1024 * b) ** 2 for a, b in zip(r.embedding, r.decoded, strict=True))
        assert gap == r.error


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 9), st.sampled_from([3, 50, 4_000_000]))
def test_bounds_never_hide_the_nearest(seed, groups, far):
    """Rounds of one part: with bounds the same entries as by a full scan, ties included."""
    r = np.random.default_rng(seed)
    x, c = r.integers(-far, far, (80, 3)), r.integers(-far, far, (12, 3))
    of = vc.group_entries(c, groups)
    own, _, low, _ = vc.nearest(x, c, of)
    books = vc.Codebooks([c], [of])
    for _ in range(4):
        means = {i: (c + r.integers(-far // 3 - 1, far // 3 + 1, c.shape) * (r.random(c.shape) < 0.3))[i].tolist() for i in range(0, 12, 2)}
        books = vc.moved(books, means, vc.CodeOptions(parts=1, entries=12), False)
        c = books.entries[0]
        own, dist, low, _ = vc.nearest(x, c, of, own, low, books.drift[0])
        full = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (own == full.argmin(1)).all() and (dist == full.min(1)).all()


def test_query_names_the_codebooks(spark):
    got = vc.op13_vector_codes(spark, "/root/testdata/sf0.001")
    assert len({r.codebooks_sha256 for r in got.collect()}) == 1
    assert hashlib.sha256(b"").hexdigest() != got.first().codebooks_sha256
