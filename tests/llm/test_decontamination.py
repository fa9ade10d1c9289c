import re

import pytest
from pyspark.sql import functions as F

from timberline.llm.decontamination import decontaminate

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return W.findall((text or "").translate(AZ))


def brute(text, items):
    w, hit, found = tokens(text), set(), set()
    for item, t in items:
        b = tokens(t)
        for i in range(max(len(b) - 12, min(len(b), 1))):
            x = b[i : i + 13]
            for s in range(len(w) - len(x) + 1):
                if w[s : s + len(x)] == x:
                    hit |= set(range(s, s + len(x)))
                    found.add(str(item) if item is not None else "null")
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def check(docs, bench, spark, **kw):
    items = [(r[0], r[1]) for r in bench.select("item_id", "text").collect()]
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append(brute(r.text, items))
    got = {}
    for r in decontaminate(docs, bench, **kw).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r["items"], r.contaminated))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}
    return got


@pytest.mark.parametrize("max_broadcast", [2_000_000, 20])
def test_against_brute_force(spark, odd, max_broadcast):
    base = [r.text for r in odd.where("doc_id between 10 and 30").select("text").collect()]
    items = [(1, base[0]), (2, " ".join(tokens(base[1])[3:20])), (3, "one"), (4, "ΣΑΣ"), (5, ""), (6, None), (None, base[2].upper()), (7, "the of"), (8, base[0]), (8, base[0]), (9, "été")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("size", F.lit(1))
    got = check(odd, bench, spark, max_broadcast=max_broadcast)
    assert any(x[3] for v in got.values() for x in v) and any(x[1] == 0 for v in got.values() for x in v)


def test_repeats_overlaps_and_near_misses(spark):
    p = " ".join(f"p{i}" for i in range(20))
    rows = [(1, p), (2, f"x {p} y {p}"), (3, p.replace("p9", "q")), (4, " ".join(f"p{i}" for i in range(12))), (5, "p0-P1!p2 " + " ".join(f"p{i}" for i in range(3, 13))), (6, "a a a a a a a a a a a a a a a")]
    bench = [(10, p), (11, "a a a a a a a a a a a a a")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), spark)


def test_empty_tables(spark, odd, none):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate(none, spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).count() == 0
    assert {(r.n_hit, r.contaminated) for r in decontaminate(odd, bench).collect()} == {(0, False)}
