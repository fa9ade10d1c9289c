"""Chat formatting at token level.

Every turn's text is escaped and encoded by itself; reserved ids beyond the vocabulary mark where a turn starts, where
its role ends and where the turn ends, and are spliced between the segments, so no text can produce a mark. The loss
mask comes from prefix sums over the marks. The rendered form of the same conversation, for readers, is

    ### <role>: <escaped text></turn>\n

per turn. Escaping is reversible: a backslash is doubled, ``</turn>`` becomes ``<\\/turn>`` and ``##`` becomes ``#\\#``,
so neither ``###`` nor ``</turn>`` occurs in an escaped text; a backslash always escapes the character after it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MARK, END = "### ", "</turn>\n"
#: Offsets of the reserved ids from the vocabulary's size.
TURN, TRAINED_TURN, ROLE_END, TURN_END = range(1, 5)
TURNS = "turns array<struct<turn:bigint,role:string,text:string,role_ids:array<int>,text_ids:array<int>>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("</turn>", "<\\/turn>").replace("##", "#\\#")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary(path: str) -> int:
    return max(encoding(path)._mergeable_ranks.values()) + 1


def _encode(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    e = encoding(path)
    for b in batches:
        b["role_ids"] = [e.encode_ordinary(escape(x)) for x in b["role"]]
        b["text_ids"] = [e.encode_ordinary(escape(x)) for x in b["text"]]
        yield b


def encode_turns(turns: DataFrame, path: str = RANKS, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, role_ids, text_ids), one row for each turn; null role or text is empty."""
    t = turns.select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), *(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    return t.mapInPandas(partial(_encode, path=path), "conv_id bigint, turn bigint, role string, text string, role_ids array<int>, text_ids array<int>")


def splice(turns: list, base: int, trained: frozenset) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a conversation and its loss mask: true on the text, and the closing mark, of trained roles' turns."""
    parts = []
    for t in turns:
        parts += [[base + (TRAINED_TURN if t["role"] in trained else TURN)], t["role_ids"], [base + ROLE_END], t["text_ids"], [base + TURN_END]]
    ids = np.concatenate([np.asarray(p, "i4") for p in parts]) if parts else np.zeros(0, "i4")
    starts = (ids == base + TURN) | (ids == base + TRAINED_TURN)
    turn = np.cumsum(starts) - 1
    ended = np.cumsum(ids == base + TURN_END)
    inside = np.cumsum(ids == base + ROLE_END) - np.concatenate([[0], ended[:-1]])[: len(ids)]
    return ids, (inside == 1) & (ids[starts] == base + TRAINED_TURN)[turn] & (ids != base + ROLE_END)


def read_back(ids: np.ndarray, mask: np.ndarray, path: str = RANKS) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns (role, text) and the trained texts that ids and mask hold, unescaped."""
    e, base = encoding(path), vocabulary(path)
    text = lambda x: unescape(e.decode_bytes(x.tolist()).decode("utf-8", "replace"))
    starts = np.flatnonzero((ids == base + TURN) | (ids == base + TRAINED_TURN))
    heads, ends = np.flatnonzero(ids == base + ROLE_END), np.flatnonzero(ids == base + TURN_END)
    turns = [(text(ids[s + 1 : h]), text(ids[h + 1 : t])) for s, h, t in zip(starts, heads, ends, strict=True)]
    trained = ids[mask]
    cuts = np.flatnonzero(trained == base + TURN_END)
    return turns, [text(trained[a:b]) for a, b in zip([0, *(cuts + 1)], cuts, strict=False)]


def _assemble(batches: Iterator[pd.DataFrame], path: str, trained: frozenset) -> Iterator[pd.DataFrame]:
    base = vocabulary(path)
    for b in batches:
        made = [splice(t, base, trained) for t in b["turns"]]
        yield pd.DataFrame({"conv_id": b["conv_id"], "n_turns": [len(t) for t in b["turns"]], "ids": [i for i, _ in made], "loss_mask": [m for _, m in made], "formatted": ["".join(f"{MARK}{escape(t['role'])}: {escape(t['text'])}{END}" for t in ts) for ts in b["turns"]]})


def format_conversations(turns: DataFrame, path: str = RANKS, trained: tuple[str, ...] = ("assistant",), **columns: str) -> DataFrame:
    """(conv_id, n_turns, ids, loss_mask, formatted), one row for each conversation.

    Turns are ordered by turn (null first), then role and text, so ties and repeated rows have a fixed order. Null
    roles and texts are empty. Rows without a conv_id form one conversation. An empty table gives an empty result.
    A conversation is one row of the result, so its turns meet in one task; encoding, the costly part, is done before,
    turn by turn.
    """
    t = encode_turns(turns, path, **columns)
    t = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "role_ids", "text_ids"))).alias("turns"))
    return t.mapInPandas(partial(_assemble, path=path, trained=frozenset(trained)), "conv_id bigint, n_turns bigint, ids array<int>, loss_mask array<boolean>, formatted string")


def _digest(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for b in batches:
        rows = []
        for ids, mask in zip(b["ids"], b["loss_mask"], strict=True):
            turns, loss = read_back(np.asarray(ids, "i4"), np.asarray(mask, bool), path)
            rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len("".join(loss)), sha("".join(loss))))
        n, turns_sha, loss_chars, loss_sha = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pd.DataFrame({"conv_id": b["conv_id"], "n_turns": n, "turns_sha256": turns_sha, "loss_chars": loss_chars, "loss_sha256": loss_sha, "formatted_chars": b["formatted"].str.len()})


#: A conversation whose texts hold the template's own control strings and escapes.
TRICKY = "\\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id bigint, turn bigint, role string, text string")
    digest = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return format_conversations(turns.unionByName(extra)).mapInPandas(partial(_digest, path=RANKS), digest)


OP2_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
    SELECT *, replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#') AS r2,
        replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#') AS t2
    FROM t
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(4 + length(r2) + 2 + length(t2) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
