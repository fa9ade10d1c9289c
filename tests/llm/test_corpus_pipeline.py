import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_ngram_join import shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(odd, spark, tmp_path_factory):
    """The odd documents with a benchmark and labels, as a folder of tables."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(f"{path}/documents.parquet")
    text = docs.where("doc_id = 20").first().text
    spark.createDataFrame([(1, text), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(5, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    q, stages = docs.columns, dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, folder)
    assert kept.columns == q and set(rows(kept)) <= set(rows(docs)) and kept.count() > 0.5 * docs.count()
    out = stages["lines"](spark, docs, folder)
    want = [(i, t) for i, _, _, t in lines([(r.doc_id, r.text) for r in docs.collect()])]
    assert out.columns == q and rows(out.fillna({"text": ""})) == sorted(want, key=str)
    out = stages["near_duplicates"](spark, docs, folder)
    want = first_of_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert out.columns == q and same_but_ties(rows(out), want)
    out = stages["decontamination"](spark, docs, folder)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {(r.doc_id, r.text) for r in docs.collect() if contaminated(r.text, items)[3]}
    assert bad and out.columns == q and rows(out) == [x for x in rows(docs) if x not in bad]


def first_of_groups(rows):
    """For each group of near duplicates the texts that may stay: those of its least id."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, s in enumerate(sets):
        for j in range(i):
            if s and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = {}
    for (i, t), k, s in zip(rows, label, sets, strict=True):
        groups.setdefault(k if s else ("none", i, t), []).append((i is None, i or 0, i, t))
    return [{x[2:] for x in g if x[:2] == min(g, key=lambda x: x[:2])[:2]} for g in groups.values()]


def same_but_ties(got, want):
    """One row of each group, and nothing else."""
    return len(got) == len(want) and all(len(w & set(got)) >= 1 for w in want)


def test_rows_that_share_an_id_are_judged_by_their_text(spark, folder):
    """Brute force by row, with columns whose names the stages use themselves."""
    say = lambda k, n=30: " ".join(f"w{k}x{i}" for i in range(n))
    item = spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first().text
    rows_ = [(2, say(1)), (5, say(2)), (5, say(1) + " more"), (7, say(2)), (7, say(3)), (8, item), (8, say(4)), (None, say(5)), (None, say(5) + " x"), (None, say(6)), (9, None), (9, ""), (9, ""), (1, say(7))]
    docs = spark.createDataFrame([(*x, "en", "s", 1, "a", "b", "c", "d", [1]) for x in rows_], "doc_id long, text string, lang string, source string, n_chars long, _id string, _key string, row string, k string, _dropped array<int>")
    stages = dict(corpus_pipeline.STAGES)
    out = stages["near_duplicates"](spark, docs, folder)
    assert out.columns == docs.columns and same_but_ties(rows(out), first_of_groups(rows_))
    assert (5, say(1) + " more") not in rows(out) and {(5, say(2)), (7, say(3))} <= set(rows(out)) and (7, say(2)) not in rows(out)
    out = stages["decontamination"](spark, docs, folder)
    assert out.columns == docs.columns and rows(out) == sorted((x for x in rows_ if x != (8, item)), key=str)
    out = stages["lines"](spark, docs, folder).collect()
    assert len(out) == len(rows_) and {(r._id, r._key, r.row, r.k, tuple(r._dropped)) for r in out} == {("a", "b", "c", "d", (1,))}


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and all(r.round_trip for r in out)
    assert len({r.doc_id for r in out}) >= len(out) - 2  # texts that share an id, or have none


def test_run_on_tables(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert 100 < len(out) < 200 and all(r.n_samples == 4 or min(r.n_ids, default=0) < 5 for r in out)
