"""Repair of a conversation's structure as a shortest path through a DAG of edits.

A conversation is the sequence of its rows by turn. Its role initials must spell ``(s?(ua)+)?``; the four states of that
automaton, one layer for each place between rows, are the nodes. Arcs are edits: Keep, Rerole (to user or assistant,
whichever is legal), Delete and Insert (an empty turn of the legal role). Minimum costs from the start (forward) and to
the end (backward) tell which arcs are tight, that is on some cheapest path; a walk over the set of nodes reached so far
then takes the least letter of any tight arc at each step, which gives the least audit string of all cheapest ones.

Texts never gather: the plan of a conversation needs one byte and a 16-byte digest of each row, and the texts are then
replayed as a sorted stream beside their plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import NOT_WHITE

#: States: start, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: The one state that a user or assistant turn leads to from each state, and that turn's role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
#: What a kept initial leads to from each state; missing where it is illegal.
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
LEGAL = frozenset(("su", "ua", "au"))
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
FAR = 1 << 60
#: Bytes of text in one batch of the replay.
CHUNK = 4 << 20
PLAN = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
PLAN_NAMES = [x.split(" ")[0] for x in PLAN.split(", ")]


@dataclass(frozen=True)
class Costs:
    """Keeping costs nothing; what stays truncated costs ``truncated`` besides its edit. Inserts must cost something."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def arcs(initial: str, fault: int, state: int, c: Costs) -> list[tuple[str, int, int]]:
    """(letter, state after, cost) of every edit of a row in a state."""
    out = [("D", state, c.delete)]
    if fault not in (BLANK, DUPLICATE):
        more = c.truncated if fault == TRUNCATED else 0
        if initial in KEEP[state]:
            out.append(("K", KEEP[state][initial], more))
        out.append(("R", NEXT[state], c.rerole + more))
    return out


def _inserted(costs: list[int], insert: int) -> list[int]:
    """Forward costs within a layer once inserts are allowed; two in a row reach every state that any number does."""
    for _ in range(2):
        for s, t in enumerate(NEXT):
            costs[t] = min(costs[t], costs[s] + insert)
    return costs


def cheapest(initials: list[str], faults: list[int], c: Costs = Costs()) -> tuple[int, str]:
    """The least cost of a repair and the least of the audit strings that have it."""
    n = len(initials)
    tables: dict[tuple[str, int], list] = {}
    steps = []
    for key in zip(initials, faults, strict=True):
        if key not in tables:
            tables[key] = [arcs(*key, s, c) for s in range(4)]
        steps.append(tables[key])
    forward, backward = np.empty((n + 1, 4), "i8"), np.empty((n + 1, 4), "i8")
    now = _inserted([0, FAR, FAR, FAR], c.insert)
    forward[0] = now
    for i, step in enumerate(steps):
        new = [FAR] * 4
        for s in range(4):
            if now[s] < FAR:
                for _, t, w in step[s]:
                    new[t] = min(new[t], now[s] + w)
        now = _inserted(new, c.insert)
        forward[i + 1] = now

    def before(costs: list[int]) -> list[int]:
        for _ in range(2):
            for s, t in enumerate(NEXT):
                costs[s] = min(costs[s], costs[t] + c.insert)
        return costs

    now = before([0 if s in ENDS else FAR for s in range(4)])
    backward[n] = now
    for i in range(n - 1, -1, -1):
        now = before([min(now[t] + w for _, t, w in steps[i][s]) for s in range(4)])
        backward[i] = now

    best = int(backward[0, START])
    frontier, audit = {(0, START)}, []
    while True:
        tight: dict[str, set] = {}
        for i, s in frontier:
            reached = forward[i, s]
            if reached + c.insert + backward[i, NEXT[s]] == best:
                tight.setdefault("I", set()).add((i, NEXT[s]))
            if i < n:
                for letter, t, w in steps[i][s]:
                    if reached + w + backward[i + 1, t] == best:
                        tight.setdefault(letter, set()).add((i + 1, t))
        if not tight:
            return best, "".join(audit)
        letter = min(tight)
        audit.append(letter)
        frontier = tight[letter]


def _prepared(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, there: str | None) -> DataFrame:
    """(conv_id, turn, role, text, there, digest); nulls in role and text are one space."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), one_space(role).alias("role"), one_space(text).alias("text"), (F.coalesce(F.col(there), F.lit(False)) if there else F.lit(True)).alias("there"))
    return t.withColumn("digest", F.substring(F.unhex(F.sha2(F.concat("role", F.lit("\n"), "text"), 256)), 1, 16))


def _faults(text: Column) -> Column:
    """Of a row by itself: blank, truncated or neither."""
    last = F.right(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    return F.when(~text.rlike(NOT_WHITE), BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(TRUNCATED).cast("int")


def _plan(initials: list[str], faults: list[int], digests: list[bytes], turns: list[int], c: Costs) -> tuple:
    if digests:
        firsts = np.unique(np.frombuffer(b"".join(digests), "V16"), return_index=True)[1]
        later = np.ones(len(digests), bool)
        later[firsts] = False
        for i in np.flatnonzero(later):
            if faults[i] != BLANK:
                faults[i] = DUPLICATE
    gaps = max(turns) - min(turns) + 1 - len(np.unique(turns)) if turns else 0
    cost, audit = cheapest(initials, faults, c)
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    return gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, audit


def _plans(batches: Iterator[pa.RecordBatch], c: Costs, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", kind), *((n, pa.string() if n == "audit" else pa.int64()) for n in PLAN_NAMES)])
    key: tuple | None = None
    rows: tuple[list, list, list, list] = ([], [], [], [])
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    for b in batches:
        for conv, initial, fault, digest, turn, there in zip(*(b.column(n).to_pylist() for n in ("conv_id", "initial", "fault", "digest", "turn", "there")), strict=True):
            if key != (conv,):
                if key:
                    done.append((*key, *_plan(*rows, c)))
                key, rows = (conv,), ([], [], [], [])
            if there:
                for to, x in zip(rows, (initial, fault, digest), strict=False):
                    to.append(x)
                if turn is not None:
                    rows[3].append(turn)
        if len(done) > 1000:
            yield out()
            done.clear()
    if key:
        done.append((*key, *_plan(*rows, c)))
    if done:
        yield out()


def plan_repairs(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: str | None = None, costs: Costs = Costs()) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row for each conversation.

    Rows stand by turn, nulls first, ties by a digest of role and text. A null role or text is one space, which is no
    legal role; an empty role is none either. Rows without a conv_id form one conversation. Rows where the column
    ``there`` is not true only name their conversation, which may so have no rows: it costs nothing. Repeated rows are
    duplicates of the first. An empty table gives an empty result; other columns, also of clashing names, play no part.

    A conversation's plan is made in one task, from about 100 bytes a row however long the texts are.
    """
    t = _prepared(turns, conv_id, turn, role, text, there)
    slim = t.select("conv_id", "turn", "digest", "there", F.substring("role", 1, 1).alias("initial"), _faults(F.col("text")).alias("fault"))
    slim = slim.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "digest")
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[dict(t.dtypes)["conv_id"]]
    return slim.mapInArrow(partial(_plans, c=costs, kind=kind), f"conv_id {dict(t.dtypes)['conv_id']}, {PLAN}")


def replayed(events: Iterator[tuple[dict | None, str, str]]) -> Iterator[tuple[dict | None, str | None, str | None]]:
    """From plans, each followed by its conversation's rows (None, role, text), the plans followed by repaired rows."""
    letters, state = iter(()), START

    def inserts(until_row: bool):
        """Inserts due now, then the letter of the next row."""
        nonlocal state
        for x in letters:
            if x != "I":
                return x
            yield None, ROLE[state], ""
            state = NEXT[state]
        return None

    for plan, role, text in events:
        if plan is not None:
            yield from inserts(False)
            letters, state = iter(plan["audit"]), START
            yield plan, None, None
            continue
        x = yield from inserts(True)
        if x == "R":
            yield None, ROLE[state], text
            state = NEXT[state]
        elif x == "K":
            yield None, role, text
            state = KEEP[state][role[:1]]
    yield from inserts(False)


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(0, b.num_rows, 256):  # few texts at a time become Python strings
            cut = b.slice(i, 256)
            yield from zip(*(cut.column(n).to_pylist() for n in ("plan", "role", "text")), strict=True)


def _rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    conv, seq, size, done = None, 0, 0, []
    for plan, role, text in replayed(_events(batches)):
        if plan is not None:
            conv, seq = plan["conv_id"], 0
            continue
        done.append((conv, seq, role, text))
        seq, size = seq + 1, size + len(text)
        if size > CHUNK or len(done) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            size, done = 0, []
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)


def _digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    plan, sha, first = None, hashlib.sha256(), True
    for p, role, text in replayed(_events(batches)):
        if p is not None:
            if plan is not None:
                done.append((*(plan[f.name] for f in list(schema)[:-1]), sha.hexdigest()))
            plan, sha, first = p, hashlib.sha256(), True
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done.clear()
            continue
        sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    if plan is not None:
        done.append((*(plan[f.name] for f in list(schema)[:-1]), sha.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)


def _beside_plans(turns: DataFrame, plans: DataFrame, conv_id: str, turn: str, role: str, text: str, there: str | None) -> tuple[DataFrame, str]:
    """Every plan followed by the rows of its conversation, sorted within partitions; and the type of conv_id."""
    t = _prepared(turns, conv_id, turn, role, text, there).where("there")
    kind = dict(t.dtypes)["conv_id"]
    names = ", ".join(f"'{c}', {c}" for c in ("conv_id", *PLAN_NAMES))
    p = plans.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.expr(f"named_struct({names})").alias("plan"))
    t = t.select("conv_id", "turn", "digest", "role", "text", F.lit(None).cast(p.schema["plan"].dataType).alias("plan"))
    return p.unionByName(t).repartition("conv_id").sortWithinPartitions("conv_id", F.col("plan").isNull(), F.asc_nulls_first("turn"), "digest"), kind


def repair_conversations(turns: DataFrame, plans: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: str | None = None, costs: Costs = Costs()) -> DataFrame:
    """(conv_id, seq, role, text), the rows of the repaired conversations; see ``plan_repairs`` for what counts as what.

    Inserted turns have an empty text. A conversation of which nothing stays has no rows.
    """
    plans = plan_repairs(turns, conv_id, turn, role, text, there, costs) if plans is None else plans
    both, kind = _beside_plans(turns, plans, conv_id, turn, role, text, there)
    schema = pa.schema([("conv_id", both.limit(0).toArrow().schema.field("conv_id").type), ("seq", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return both.mapInArrow(partial(_rows, schema=schema), f"conv_id {kind}, seq bigint, role string, text string")


def repair_digests(turns: DataFrame, there: str | None = None, costs: Costs = Costs(), **columns: str) -> DataFrame:
    """The columns of ``plan_repairs`` and repaired_sha256, of the repaired ``role:text`` joined by newlines."""
    names = {"conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text", **columns}
    both, kind = _beside_plans(turns, plan_repairs(turns, there=there, costs=costs, **names), *names.values(), there)
    key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = pa.schema([("conv_id", key), *((n, pa.string() if n == "audit" else pa.int64()) for n in PLAN_NAMES), ("repaired_sha256", pa.string())])
    return both.mapInArrow(partial(_digests, schema=schema), f"conv_id {kind}, {PLAN}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with one fault or none in each row, dealt by conv_id and turn; dropped rows stay with there = false."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn")).cast("binary")) % 20
    t = turns.select("conv_id", "turn", one_space("role").alias("role"), one_space("text").alias("text"), fault.alias("f"))
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    t = t.select("conv_id", "turn", F.when(F.col("f") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("f") != 0).alias("there"), "f")
    return t.withColumn("again", F.explode(F.sequence(F.lit(1), F.when(F.col("f") == 3, 2).otherwise(1)))).drop("again", "f")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_digests(damaged(turns), there="there")


_INF = "{'c': 1000000000, 's': '', 't': []::VARCHAR[]}"


def _add(q: str, cost: str, letter: str, line: str | None = None) -> str:
    return f"{{'c': {q}.c + {cost}, 's': {q}.s || '{letter}', 't': {f'list_append({q}.t, {line})' if line else f'{q}.t'}}}"


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _row_step(q: int) -> str:
    """The state ``q`` after row b from the states of a, before inserts."""
    w = "CASE WHEN b.fault = 3 THEN 5 ELSE 0 END"
    stays = lambda c: f"CASE WHEN b.fault IN (1, 2) THEN {_INF} ELSE {c} END"
    options = [_add(f"a.q{q}", "2", "D")]
    for p in range(4):
        for initial, to in KEEP[p].items():
            if to == q:
                options.append(stays(f"CASE WHEN b.initial = '{initial}' THEN {_add(f'a.q{p}', w, 'K', 'b.line')} ELSE {_INF} END"))
        if NEXT[p] == q:
            options.append(stays(_add(f"a.q{p}", f"1 + {w}", "R", f"'{ROLE[p]}:' || b.text")))
    return _least(*options)


_INSERTED = f"""{_least("q2", *(_add(f"q{p}", "5", "I", "'user:'") for p in (0, 1, 3)))} AS q2"""
#: Another way to the same rows: cheapest prefixes with their least audit strings, row by row.
OP12_SQL = f"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v // 2, 3988292384 * (v % 2)), xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS f FROM src),
dam AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM crc, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS u(j)),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(role || chr(10) || text)) AS i FROM dam),
ord AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM num),
r AS (SELECT *, role || ':' || text AS line, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN seen > 1 THEN 2 WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 0 ELSE 3 END AS fault FROM ord),
n AS (SELECT c.conv_id, count(r.i) AS n, coalesce(max(r.turn) - min(r.turn) + 1 - count(DISTINCT r.turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (prev || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN r ON c.conv_id IS NOT DISTINCT FROM r.conv_id GROUP BY c.conv_id),
dp AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 's': '', 't': []::VARCHAR[]}} AS q0, {_INF} AS q1, {{'c': 5, 's': 'I', 't': ['user:']}} AS q2, {{'c': 10, 's': 'II', 't': ['user:', 'assistant:']}} AS q3 FROM n
    UNION ALL
    SELECT conv_id, i, q0, q1, q2, {_least('q3', _add('q2', '5', 'I', "'assistant:'"))} AS q3 FROM (SELECT conv_id, i, q0, q1, q3, {_INSERTED} FROM (
        SELECT a.conv_id, b.i, {', '.join(f'{_row_step(q)} AS q{q}' for q in range(4))} FROM dp a JOIN r b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = a.i + 1))
)
SELECT n.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(best.c AS BIGINT) AS cost, best.s AS audit, sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM n JOIN (SELECT conv_id, i, {_least('q0', 'q3')} AS best FROM dp) d ON n.conv_id IS NOT DISTINCT FROM d.conv_id AND n.n = d.i
"""
