"""Toxic passages as maximum-scoring segments over token log-odds.

Fit: Spark counts every token of the labelled documents by label. A token's score is its log-odds between the labels
under a Dirichlet prior, half a count plus the token's share of all labelled text; only tokens whose z-score reaches
``min_z`` and log-odds ``min_d`` are scored one by one, all others share one score, that of their pooled counts. ``drift`` is taken off every score, so clean text has a negative mean.

Scan: one linear pass over a document finds every maximal scoring segment (no two overlap, none can be extended).

Calibration: in clean text the best segment of n tokens follows an extreme-value law with P(S > x) = 1 - exp(-K n
exp(-lambda x)). Lambda solves sum p(s) exp(lambda s) = 1 over the clean score distribution, K is the maximum-likelihood
fit to clean documents. Segments with an expected count under ``max_expected`` are significant; a document's evidence is
-log10 of the joint tail of its significant segments, which a one-variable logistic turns into a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import distinct_count, documents, hash_sample, small_side, staged

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+(?:'[a-z]+)*")


@dataclass(frozen=True)
class Options:
    """prior: weight of the Dirichlet prior in tokens, besides half a count for each. sample: rows at most that the calibration looks at."""

    prior: float = 500.0
    min_z: float = 2.8
    min_d: float = 1.0
    drift: float = 0.02
    max_expected: float = 0.05
    sample: int = 20_000
    threshold: float = 0.7


@dataclass
class Model:
    scores: dict[bytes, float]
    rest: float
    lam: float
    k: float
    slope: float
    middle: float
    max_expected: float


def tokens(text: str | None) -> list[bytes]:
    return TOKEN.findall(text.lower().encode("utf-8", "replace")) if text else []


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, token, n): in how many documents of a batch each token occurs."""
    for b in batches:
        labels = np.array(b.column(1).to_pylist(), "i8")
        lists = [list(dict.fromkeys(tokens(t))) for t in b.column(0).to_pylist()]
        flat = pa.array([w for x in lists for w in x], pa.binary())
        t = pa.table({"label": np.repeat(labels, [len(x) for x in lists]), "token": flat}).group_by(["label", "token"]).aggregate([([], "count_all")])
        yield from pa.table({"label": t["label"], "token": t["token"], "n": t["count_all"]}).combine_chunks().to_batches()


def _contexts(batches: Iterator[pa.RecordBatch], candidates: frozenset) -> Iterator[pa.RecordBatch]:
    """(label, token, before): the candidates with the tokens that stand before them."""
    for b in batches:
        out: set = set()
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = tokens(t)
            out.update((y, x, w[i - 1] if i else b"") for i, x in enumerate(w) if x in candidates)
        cols = list(zip(*sorted(out), strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["label", "token", "before"])


def _by_label(df: DataFrame, n) -> DataFrame:
    return df.groupBy("token").agg(*(F.sum(F.when(F.col("label") == y, n).otherwise(0)).alias(f"y{y}") for y in (1, 0)))


def _told(counts: DataFrame, n1: float, n0: float, o: Options) -> DataFrame:
    """Tokens that tell the labels apart, with their log-odds d."""
    a = 0.5 + o.prior * (F.col("y1") + F.col("y0")) / (n1 + n0)
    odds = lambda y, m: F.log((y + a) / (m + o.prior - y))
    n = counts.withColumn("d", odds(F.col("y1"), n1) - odds(F.col("y0"), n0)).withColumn("z", F.col("d") / F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a)))
    return n.where((F.abs("z") >= o.min_z) & (F.abs("d") >= o.min_d))


def log_odds(labelled: DataFrame, text: str, label: str, o: Options) -> tuple[dict[bytes, float], float]:
    """Scores of the telling tokens and the common score of all others.

    Tokens are counted by documents, then the telling ones again by distinct tokens before them: in copies of one text
    a token always stands in the same place, so a much copied text makes none of its words toxic.
    """
    d = labelled.select(text, label)
    counts = _by_label(d.mapInArrow(_tokens, "label bigint, token binary, n bigint"), F.col("n"))
    counts = staged(counts, "token-counts")
    n1, n0 = (float(v or 0) for v in counts.agg(F.sum("y1"), F.sum("y0")).first())
    if not n1 or not n0:
        return {}, -o.drift
    told = frozenset(bytes(r["token"]) for r in _told(counts, n1, n0, o).select("token").collect())
    contexts = d.mapInArrow(partial(_contexts, candidates=told), "label bigint, token binary, before binary").distinct()
    told = _told(_by_label(contexts, F.lit(1)), n1, n0, o).collect()
    r1, r0 = n1 - sum(r["y1"] for r in told), n0 - sum(r["y0"] for r in told)
    rest = float(np.log((r1 + 1) / (n1 + 1)) - np.log((r0 + 1) / (n0 + 1)))
    return {bytes(r["token"]): r["d"] - o.drift for r in told}, min(rest, 0.0) - o.drift


def segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence of scores, in linear time.

    Candidates are kept in a stack; each positive score starts one, which is merged to the left for as long as some
    earlier candidate starts lower and ends lower.
    """
    total = np.concatenate([[0.0], np.cumsum(s)])
    stack: list[list] = []  # start, end, total before, total after, index of the nearest candidate that starts lower
    for i in np.flatnonzero(s > 0).tolist():
        new = [i, i + 1, total[i], total[i + 1], -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3], -1]
            del stack[j:]
    return [(a, b, float(r - l)) for a, b, l, r, _ in stack]


def token_scores(model: Model, words: list[bytes]) -> np.ndarray:
    """The score of each token; a token equal to the one before says nothing new and scores as any other."""
    get, rest, before = model.scores.get, model.rest, [b"", *words[:-1]]
    return np.array([get(w, rest) if w != b else rest for w, b in zip(words, before, strict=True)])


def scan(model: Model, words: list[bytes]) -> list[tuple[int, int, float]]:
    return segments(token_scores(model, words)) if words else []


def solve_lambda(s: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 for a negative mean; 1 where no score is positive."""
    if not (s > 0).any() or float(s @ p) >= 0:
        return 1.0
    f = lambda x: float(p @ np.exp(np.minimum(x * s, 700))) - 1
    hi = 1.0
    while f(hi) < 0:
        hi *= 2
    lo = hi / 2
    while f(lo) > 0:
        lo /= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def evidence(model: Model, n: int, found: list[tuple[int, int, float]]) -> tuple[float, list[tuple[int, int, float]]]:
    """-log10 of the chance of the significant segments in clean text of n tokens, and those segments."""
    out, kept = 0.0, []
    for a, b, x in found:
        e = model.k * max(n, 1) * np.exp(-model.lam * x)
        if e <= model.max_expected:
            kept.append((a, b, x))
            out += -np.log10(max(-np.expm1(-e), 1e-300))
    return out, kept


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", o: Options = Options()) -> Model:
    """Fits to the rows of ``docs`` that have a label; all their tokens count, the calibration takes up to ``o.sample`` distinct texts.

    Of several labels of one document the least counts; rows without an id have no label.
    """
    y = small_side(labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("bigint").alias("_y")).dropna().groupBy("_id").agg(F.min("_y").alias("_y")), "toxic-labels")
    d = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(y, "_id")
    scores, rest = log_odds(d, "_t", "_y", o)
    m = Model(scores, rest, 1.0, 1.0, 1.0, 0.0, o.max_expected)
    seen = d.mapInArrow(partial(_best, model=m), "h bigint, y bigint, n bigint, best array<double>, hist map<double,bigint>")
    seen = hash_sample(seen, "h", "y", o.sample, distinct_count(d, F.xxhash64("_t"))).collect()
    clean = [r for r in seen if r["y"] == 0]
    hist: dict[float, int] = {}
    for r in clean:
        for v, k in (r["hist"] or {}).items():
            hist[v] = hist.get(v, 0) + k
    if not hist:
        return m
    v, p = np.array(list(hist)), np.array(list(hist.values()), float)
    m.lam = solve_lambda(v, p / p.sum())
    m.k = len(clean) / max(sum(r["n"] * np.exp(-m.lam * max(r["best"], default=0.0)) for r in clean), 1e-9)
    x = np.array([evidence(m, r["n"], [(0, 0, s) for s in r["best"]])[0] for r in seen])
    m.slope, m.middle = logistic(np.log1p(x), np.array([r["y"] for r in seen], float))
    return m


def _best(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for t, y in zip(b.column("_t").to_pylist(), b.column("_y").to_pylist(), strict=True):
            w = tokens(t)
            s = token_scores(model, w) if w else np.zeros(0)
            v, k = np.unique(np.round(s, 3), return_counts=True)
            rows.append((xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "replace")) - 2**63, y, len(w), [x for _, _, x in segments(s)], list(zip(v.tolist(), k.tolist(), strict=True))))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.map_(pa.float64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["h", "y", "n", "best", "hist"])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope (at least 0.1) and midpoint of a logistic curve by damped Newton steps with a weak prior."""
    if not len(x) or y.min() == y.max():
        return 4.0, 1.0
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (q * (1 - q))[:, None]).T @ a + np.eye(2) * 1e-2
        w += np.clip(np.linalg.solve(h, a.T @ (y - q) - 1e-2 * w), -2, 2)
    slope = max(float(w[0]), 0.1)
    return slope, float(-w[1] / slope)


def _score(batches: Iterator[pa.RecordBatch], shared, threshold: float, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    m: Model = shared.value
    for b in batches:
        scores, spans = [], []
        for t in b.column("_text").to_pylist():
            w = tokens(t)
            x, kept = evidence(m, len(w), scan(m, w))
            scores.append(1 / (1 + np.exp(-np.clip(m.slope * (np.log1p(x) - m.middle), -30, 30))))
            spans.append([{"start": a, "end": e, "score": v} for a, e, v in kept])
        rest = [b.column(i) for i, n in enumerate(b.schema.names) if n != "_text"]
        score = np.array(scores, "f8")
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        yield pa.RecordBatch.from_arrays([*rest, pa.array(score), pa.array((score >= threshold).astype("i4")), pa.array(spans, span)], [*names, "score", "predicted", "passages"])


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = Options.threshold) -> DataFrame:
    """The columns ``keep`` with score, predicted and passages (token spans of significant segments) for every row.

    Null or empty text has no segments and gets the score of no evidence. Repeated rows each get a row; other columns
    are ignored; an empty table gives an empty result. In the query a null doc_id has a null ``held_out``, and its row is
    scored but not learned from.
    """
    d = docs.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields if f.name != "_text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return d.mapInArrow(partial(_score, shared=shared, threshold=threshold, names=tuple(keep)), f"{fields}, score double, predicted int, passages array<struct<start:int,end:int,score:double>>")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "text", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1).alias("held_out"))
    model = fit(d.where(~F.col("held_out")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(d, model, keep=("doc_id", "held_out")).drop("passages")
