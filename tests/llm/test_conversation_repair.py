import hashlib
import random
import re
from functools import lru_cache
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timberline.llm import conversation_repair as cr

CLEAN = re.compile(r"(s?(ua)+)?")


def brute(initials, faults):
    """The least (cost, audit) by trying every edit at every place, at most two inserts in a row."""

    @lru_cache(None)
    def rest(i, said, inserts):
        """said: the initials so far, as far as they matter."""
        out = [(0, "")] if i == len(initials) and CLEAN.fullmatch(said) else []
        options = []
        if inserts < 2:
            options += [(5, "I", i, x, inserts + 1) for x in "ua"]
        if i < len(initials):
            more = 5 if faults[i] == cr.TRUNCATED else 0
            options.append((2, "D", i + 1, "", 0))
            if faults[i] not in (cr.BLANK, cr.DUPLICATE):
                options += [(1 + more, "R", i + 1, x, 0) for x in "ua"] + [(more, "K", i + 1, initials[i] or "?", 0)]
        for w, letter, j, x, k in options:
            now = said + x
            if any(CLEAN.fullmatch(now + end) for end in ("", "a", "ua")):  # can still become legal
                now = now if len(now) < 3 else ("s" if now[0] == "s" else "") + "ua" * 1 + ("u" if now[-1] == "u" else "")
                cost, audit = rest(j, now, k)
                out.append((w + cost, letter + audit))
        return min(out, default=(1 << 30, ""))

    return rest(0, "", 0)


def test_every_short_conversation():
    for n in range(4):
        for initials in product("suax", repeat=n):
            for faults in product((cr.FINE, cr.BLANK, cr.TRUNCATED), repeat=n):
                assert cr.cheapest(list(initials), list(faults)) == brute(initials, faults), (initials, faults)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=14))
def test_longer_conversations(rows):
    initials, faults = [r[0] for r in rows], [r[1] for r in rows]
    assert cr.cheapest(initials, faults) == brute(tuple(initials), tuple(faults))


def expected(rows):
    """rows: (turn, role, text) of one conversation, in order. The result by plain rules and ``brute``."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append(cr.BLANK if not bare else cr.DUPLICATE if (role, text) in seen else cr.FINE if bare[-1] in ".!?" else cr.TRUNCATED)
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = brute(tuple(initials), tuple(faults))
    out, i, want = [], 0, "u"
    for x in audit:
        if x == "I":
            out.append(("user" if want == "u" else "assistant", ""))
        elif x != "D":
            out.append((rows[i][1] if x == "K" else "user" if want == "u" else "assistant", rows[i][2]))
        i += x != "I"
        if x != "D":
            want = "a" if out[-1][0][0] == "u" else "u"
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(faults.count(f) for f in (cr.BLANK, cr.DUPLICATE, cr.TRUNCATED)), illegal, cost, audit), out


def conversations(n=60, seed=3):
    r = random.Random(seed)
    out = {None: [(None, " ", " "), (0, "user", "no id."), (0, "user", "no id."), (2, "assistant", "x" * 300_000 + ".")]}
    for c in range(n):
        turns = sorted(r.sample(range(20), r.randint(1, 12)))
        out[c] = [(t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), r.choice(["Hi there.", "What?", "cut off", " \t ", "", "é!", "end \n", f"text {t}."])) for t in turns]
        if r.random() < 0.5:
            out[c].insert(0, (None, "system", "No turn."))
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = [(c, t, role if role != " " else None, text if text != " " else None, 1, "x", 1, 1, 1) for c, rs in conversations().items() for t, role, text in rs]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, audit int, plan string, digest int, there int, seq int").repartition(3)


def test_against_brute_force(table):
    """Plans, repaired rows and digests; columns of clashing names and null ids, turns, roles and texts included."""
    plans = {r[0]: tuple(r)[1:] for r in cr.plan_repairs(table).collect()}
    rows, digests = {}, {r[0]: tuple(r)[1:] for r in cr.repair_digests(table).collect()}
    for r in cr.repair_conversations(table).collect():
        rows.setdefault(r.conv_id, []).append((r.seq, r.role, r.text))
    want = {c: expected(rs) for c, rs in conversations().items()}
    assert plans == {c: p for c, (p, _) in want.items()}
    for c, (p, out) in want.items():
        assert [x[1:] for x in sorted(rows.get(c, []))] == out
        assert digests[c] == (*p, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest())


def test_rows_that_only_name_their_conversation(spark):
    t = spark.createDataFrame([(1, 0, "user", "a.", False), (2, 0, "user", "a.", True), (2, 1, "assistant", "b.", None)], "conv_id int, turn int, role string, text string, there boolean")
    got = {r.conv_id: (r.cost, r.audit, r.gaps) for r in cr.plan_repairs(t, there="there").collect()}
    assert got == {1: (0, "", 0), 2: (2, "D", 0)}


def test_empty_table(table):
    none = table.limit(0)
    assert cr.plan_repairs(none).count() == cr.repair_conversations(none).count() == cr.repair_digests(none).count() == 0


def test_one_conversation_of_many_long_rows(spark):
    """A third of all rows in one conversation: only codes of its rows meet, its texts pass by."""
    t = spark.range(6000).selectExpr("if(id % 3 = 0, -1, id) AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat(repeat(cast(id as string), 200), '.') AS text")
    got = {r.conv_id: r for r in cr.repair_digests(t).where("conv_id = -1").collect()}
    assert got[-1].audit == "K" * 2000 and got[-1].gaps == 4000 - 2


def test_damage_is_dealt_by_conversation_and_turn(spark):
    import zlib

    rows = [(c, t, "assistant", "A! b? c.") for c in (None, 0, 7) for t in (None, *range(60))]
    got = {(r.conv_id, r.turn, r.role, r.text, r.there) for r in cr.damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    want = set()
    for c, t, role, text in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want.add((c, t, "user" if f == 4 else role, "" if f == 1 else "A b c" if f == 2 else text, f != 0))
    assert got == want
