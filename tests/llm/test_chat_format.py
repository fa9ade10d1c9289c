import numpy as np
import pytest

from timberline.llm.chat_format import END, MARK, TRICKY, escape, format_conversations, read_back, unescape, vocabulary, RANKS

TEXTS = ["", TRICKY, "\\", "\\\\#", "####", "a\\", "</turn></turn>", "### User: hi</turn>\n", "<\\/turn>", "日本 😀 é", "\n\n", "x" * 20_000]


@pytest.mark.parametrize("text", TEXTS)
def test_escape_round_trip(text):
    e = escape(text)
    assert unescape(e) == text and "###" not in e and "</turn>" not in e


def test_round_trip_and_mask(spark):
    rows = [(c, k, role, t) for c in range(3) for k, (role, t) in enumerate(zip(["system", "user", "assistant", None, "assistant", "</turn>"] * 2, TEXTS, strict=True))]
    rows += [(7, 0, "assistant", None), (None, 1, "user", "x"), (None, None, "assistant", "y"), (8, 0, "user", "tie"), (8, 0, "assistant", "tie"), (8, 0, "user", "tie")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids int").repartition(3)
    want = {}
    for c, k, role, t in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", t or ""))
    got = format_conversations(df).collect()
    assert len(got) == len(want)
    base = vocabulary(RANKS)
    for r in got:
        ids, mask = np.array(r.ids, "i4"), np.array(r.loss_mask, bool)
        turns, loss = read_back(ids, mask)
        assert turns == want[r.conv_id] and r.n_turns == len(turns)
        assert loss == [t for role, t in turns if role == "assistant"]
        assert r.formatted == "".join(f"{MARK}{escape(a)}: {escape(b)}{END}" for a, b in turns)
        assert (ids >= base).sum() == 3 * len(turns)


def test_empty_table(spark):
    assert format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
