import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm.line_dedup import MAX_PACKED, NO_KEEPER, PerfectHash, Shard, build_arrays, dealt_keys, dedup_lines, kept_text, merged

AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_docs=5):
    held = defaultdict(list)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(AZ)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k].append(i)
    gone = {k: max((x for x in v if x is not None), default="all") for k, v in held.items() if len(k) >= 40 and len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) in (i, "all")]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def result(df, **kw):
    d = dedup_lines(df, **kw).select("doc_id", F.size("_lines"), F.size("_dropped"), kept_text())
    return sorted((tuple(r) for r in d.collect()), key=str)


def test_against_brute_force(odd):
    want = brute([(r.doc_id, r.text) for r in odd.collect()])
    assert result(odd) == want
    assert result(odd, max_broadcast=-1, shards=3) == want
    assert sum(x[2] for x in want) > 10


@pytest.mark.parametrize("how", [{}, {"shards": 7}, {"max_broadcast": -1, "shards": 5}])
def test_keys_go_through_shards(spark, how):
    """More keys than can be hot, most found in exactly 4 or 5 documents; ties, repeats in one text, null ids."""
    line = lambda k: f"  This Is Line {k} " + "x" * 40
    rows = [(i, "\n".join(line(k) + " " * (i % 3) for k in range(i % 40, 3000, 40)) + ("\n" + line(i % 40) if i % 7 == 0 else "")) for i in range(200)]
    rows += [(None, line(5)), (199, line(39)), (500, line(7)[:30]), (501, "\n"), (502, None)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **how) == brute(rows)


@pytest.mark.parametrize("how", [{}, {"max_broadcast": -1}])
def test_keys_as_rows(odd, monkeypatch, how):
    monkeypatch.setattr("timberline.llm.line_dedup.MAX_PACKED", 4)
    assert result(odd, shards=9, **how) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_a_batch_costs_the_same_in_any_corpus():
    """Rows of a batch are bounded by its keys, not by the number of shards."""
    keys = merged(*(np.random.default_rng(k).integers(0, 2**62, 100_000) for k in range(5)))
    for shards, rows in ((1_000, 1_000), (MAX_PACKED, MAX_PACKED), (MAX_PACKED + 1, 100_000), (5_000_000, 100_000)):
        began = time.process_time()
        assert dealt_keys(keys, shards, shards <= MAX_PACKED).num_rows == rows
        assert time.process_time() - began < 2


@pytest.mark.parametrize("how", [{}, {"max_broadcast": -1}])
def test_columns_of_any_name_pass_through(odd, how):
    d = odd.selectExpr("doc_id", "text", "1 as _rk", "2 as _rk2", "3 as _id2", "4 as rk", "5 as dropped", "6 as _row", "7 as _lines")
    out = dedup_lines(d, **how).select("_rk", "_rk2", "_id2", "rk", "dropped", "_row").distinct().collect()
    assert [tuple(x) for x in out] == [(1, 2, 3, 4, 5, 6)]


def test_index_is_minimal_and_perfect():
    r = np.random.default_rng(1)
    h1, h2 = (r.integers(-(2**63), 2**63 - 1, 20_000) for _ in range(2))
    h1[:50] = h1[0]  # the same first half
    h = PerfectHash(*PerfectHash.build(h1, h2))
    assert sorted(h.places(h1, h2).tolist()) == list(range(20_000))


def test_arrays_count_and_keep():
    """Keys come three times, with counts that only together reach five."""
    r = np.random.default_rng(2)
    h1, h2 = (np.tile(r.integers(-(2**63), 2**63 - 1, 5_000), 3) for _ in range(2))
    docs = np.repeat([1, 2, 1], 5_000)
    docs[:1_000] = 2  # the first thousand keys reach five
    keeper = np.concatenate([np.arange(5_000), np.full(5_000, NO_KEEPER), np.arange(5_000) * 2])
    i = build_arrays(h1, h2, docs, docs, keeper, 5)
    counts = np.frombuffer(i["counts"], "u1")
    assert i["n"] == len(counts) == 5_000 and (counts == 5).sum() == 1_000 and (counts == 4).sum() == 4_000
    assert len(i["fingerprints"]) == len(i["keepers"]) == 8 * 1_000
    found, kept = Shard(i).probe(h1[:5_000], h2[:5_000])
    assert found.sum() == found[:1_000].sum() == 1_000 and (kept[:1_000] == np.arange(1_000) * 2).all()
    assert not Shard(i).probe(h1 + 1, h2 + 1)[0].any()


def test_empty_table(none):
    assert result(none) == []
