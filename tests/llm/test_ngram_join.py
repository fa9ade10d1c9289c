import random
import time
from collections import defaultdict
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm.components import components
from timberline.llm.ngram_join import MAX_RANGES, Batch, _lists, boundary, candidates, ngram_components, shared_shingles, shingle_set

AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(t):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(AZ))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            n = len(s & sets[j])
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                par[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    return sorted(((d, len(sets[i]), min((x for x in ids[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=str)


def result(df, **kw):
    return sorted((tuple(r) for r in ngram_components(df, **kw).collect()), key=str)


def copies(seed, n, sizes=(4, 60)):
    r = random.Random(seed)
    rows, base = [], []
    for i in range(n):
        if not base or r.random() < 0.15:
            base.append([f"w{r.randint(0, 400)}" for _ in range(r.randint(*sizes))])
        w = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = [f"e{r.randint(0, 5)}"] * r.randint(0, 1)
        rows.append((i * 3 % n, " ".join(w) if r.random() < 0.9 else " ".join(w).upper()))
    return rows


@pytest.mark.parametrize(("seed", "sizes", "block"), [(1, (4, 30), 512), (2, (10, 80), 8)])
def test_against_brute_force(spark, seed, sizes, block):
    rows = copies(seed, 400, sizes)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=block) == brute(rows)


def boilerplate(n):
    """Unique texts that end in one of three passages: they share many shingles and link with nothing."""
    r = random.Random(5)
    passages = [" ".join(f"p{k}x{i}" for i in range(24)) for k in range(3)]
    return [(i, " ".join(f"u{r.randrange(10**9)}" for _ in range(20)) + " " + passages[i % 3]) for i in range(n)]


def mixed(n):
    """Texts of three slots out of few choices each: many share most of their shingles, some of which link."""
    r = random.Random(6)
    part = lambda k: " ".join(f"s{k}w{i}" for i in range(14))
    return [(i, " ".join([part(0), part(1), part(r.randint(2, 9)), part(r.randint(10, 14)), part(r.randint(15, 40))][: r.randint(3, 5)] + [f"e{r.randint(0, 9)}"])) for i in range(n)]


@pytest.mark.parametrize(("rows", "block"), [(boilerplate(300), 4), (mixed(300), 4), (mixed(120), 64)])
def test_large_groups_against_brute_force(spark, rows, block):
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=block) == brute(rows)


def test_shared_passages_make_no_candidates(spark):
    """Rarity is exact at every size, so passages of many documents stay out of the lists."""
    for n in (300, 1200):
        docs = spark.createDataFrame(boilerplate(n), "doc_id long, text string")
        sets = shared_shingles(docs, 4)
        assert sets.count() == n and sets.where("items is not null").count() == 0


def test_many_partly_alike_texts_grow_in_proportion(spark):
    """Texts that all share passages beyond the prefix bound: rows of candidates grow like the texts."""
    made = {}
    for n in (300, 1200):
        rows = [(i, f"{t} {t}") for i, t in boilerplate(n)]
        rows = [(i, " ".join(t.split()[:8]) + " " + " ".join(t.split()[20:44])) for i, t in rows]
        sets = shared_shingles(spark.createDataFrame(rows, "doc_id long, text string"), 4).where("items is not null").select(F.col("ref").alias("node"), "n", "items")
        lists = sets.mapInArrow(partial(_lists, least=1), "key bigint, node bigint, n int, at int")
        made[n] = candidates(lists).count()
    assert made[1200] <= 5 * max(made[300], 60)


def test_ranges_or_rows_of_shingles(spark):
    """Beyond the most ranges shingles travel as rows; both ways give the same sets, a word of all batches included."""
    rows = [(i, f"in all the same five words and {t}") for i, t in copies(4, 300, (10, 60))] + [(None, None), (None, "a b c d e f")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    get = lambda buckets: sorted(((r.doc_id, r.rk, r.hi, r.lo, r.n, r.scan, r["items"] and bytes(r["items"])) for r in shared_shingles(d, buckets).collect()), key=str)
    want = get(3)
    assert want == get(10**6) and any(x[6] for x in want)


def test_a_batch_costs_the_same_in_any_corpus():
    """Rows of a batch are bounded by its shingles and MAX_RANGES, not by the number of ranges."""
    x = np.unique(np.random.default_rng(3).integers(0, 2**64 - 1, 200_000, dtype="u8"))
    made = []
    for buckets in (6_000, MAX_RANGES, 0):
        b = Batch(1, buckets)
        for k, part in enumerate(np.array_split(x, 40)):
            b.add(k, k, part, set())
        began = time.process_time()
        made.append(b.rows().num_rows)
        assert time.process_time() - began < 3
    assert made == [6_002, MAX_RANGES + 2, len(x) + 2]


def test_odd_documents(odd):
    assert result(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_empty_table(none):
    assert result(none) == []


def test_boundary_and_short_sets():
    assert boundary({}) == 0
    assert boundary({s: (100, 100 * s) for s in range(1, 17)}) >= 5
    assert boundary({s: (100, 0) for s in range(1, 17)}) < boundary({s: (100, 10**6) for s in range(1, 17)}) == 16
    assert len(shingle_set(None)) == len(shingle_set(" \n")) == 0
    assert len(shingle_set("a b")) == 1 and len(shingle_set("a a a a a a a")) == 1


def test_components_of_a_long_chain(spark):
    n = 300
    order = np.random.default_rng(3).permutation(n).tolist()
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(n), 0) | {1000: 1000, 1001: 1000}


def test_batches_for_python_are_held_by_bytes(spark):
    """Long texts come to Python a few at a time, and the session's own setting stays."""
    import pyarrow as pa

    from timberline.sources import storage

    before = spark.conf.get(storage.MAX_BYTES, None)
    d = spark.range(0, 400, 1, 1).selectExpr("id", "repeat('x', 50000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows] * b.num_rows}, pa.schema([("n", pa.int64())]))

    most = storage.staged(d.mapInArrow(sizes, "n bigint"), "batches").agg({"n": "max"}).first()[0]
    assert most * 50_000 <= 2 * storage.BATCH_BYTES
    assert spark.conf.get(storage.MAX_BYTES, None) == before
