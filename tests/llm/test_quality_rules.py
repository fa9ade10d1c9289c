import re

from timberline.llm.quality_rules import apply_rules

W = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = W.findall(text)
    seen, dup = set(), 0
    for x in text.split("\n"):
        if W.search(x):
            dup += x in seen
            seen.add(x)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {x for x in wins if wins.count(x) > 1} if len(wins) < 500 else {x for x, n in __import__("collections").Counter(wins).items() if n > 1}
    hit = {i + k for i, x in enumerate(wins) if x in twice for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_base_counts(odd):
    got = apply_rules(odd, keep=("doc_id", "text")).collect()
    assert len(got) == odd.count()
    for r in got:
        n = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, r.text
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r.base_failed and r.kept)


def test_repeats_by_hand(spark):
    rows = [(1, "a b c d e x a b c d e"), (2, "a a a a a a a"), (3, "a b c d e"), (4, "q\nq\n \n \nq")]
    got = {r.doc_id: r for r in apply_rules(spark.createDataFrame([(*x, "en", "s") for x in rows], "doc_id long, text string, lang string, source string")).collect()}
    assert [got[i].n_repeat_words for i in (1, 2, 3)] == [10, 7, 0]
    assert got[4].n_dup_lines == 2


def test_outlier_is_rejected_and_clean_kept(spark):
    clean = [(i, " ".join(f"word{(i * 7 + k * k) % 97}x{k}" for k in range(40)), "en", "s") for i in range(300)]
    junk = [(999, " ".join(f"w{k}$$$ ###" for k in range(40)), "en", "s")]
    got = {r.doc_id: r.kept for r in apply_rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(999)
    assert all(got.values())


def test_empty_table(none):
    assert apply_rules(none).count() == 0
