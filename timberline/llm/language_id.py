"""Language identification with a byte convolutional network.

Texts are UTF-8 bytes cut into fixed-length windows (the last one padded with zeros). Each window goes through byte
embeddings, filters of widths 2, 3 and 4, the maximum over all positions, and a softmax layer; a document's scores are
the mean over all its windows, so the whole text counts. The network is trained in numpy on windows of a bounded
sample of labelled documents (``TrainOptions.per_language``, distinct texts dealt by hash), always in the same order from
the same seed, so a lost executor or a second run gives the same model.

For scoring, embedding and filter fold into tables: a filter's answer is a sum of entries for the byte pairs it
covers, so a window costs table look-ups only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import distinct_by, documents, small_side

WIDTHS = (2, 3, 4)
UNKNOWN = "und"


@dataclass(frozen=True)
class TrainOptions:
    """per_language and sample bound the rows to learn from: languages share ``sample`` where there are very many.
    passage is the length in characters, at a place dealt by hash, of what a document gives to the training."""

    window: int = 128
    per_language: int = 400
    sample: int = 25_600
    passage: int = 768
    embedding: int = 8
    filters: int = 8
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    seed: int = 5


@dataclass
class Model:
    languages: list[str]
    window: int
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray


def to_windows(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows x bytes, number of windows of each text); every byte of every text is in one window."""
    counts = np.array([-(-len(t) // window) for t in texts], "i8")
    padded = b"".join(t + b"\0" * (-len(t) % window) for t in texts)
    return np.frombuffer(padded, "u1").reshape(-1, window), counts


def _forward(m: Model, x: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    e = m.embed[x]
    cols, maxima, where = [], [], []
    for w, f, b in zip(WIDTHS, m.filters, m.bias, strict=True):
        c = np.concatenate([e[:, i : x.shape[1] - w + 1 + i] for i in range(w)], axis=2)
        a = c @ f + b
        k = a.argmax(1)
        cols.append(c)
        where.append(k)
        maxima.append(np.maximum(np.take_along_axis(a, k[:, None], 1)[:, 0], 0))
    h = np.concatenate(maxima, axis=1)
    z = h @ m.out + m.out_bias
    z = np.exp(z - z.max(1, keepdims=True))
    return [cols, where], h, z / z.sum(1, keepdims=True)


def train(texts: list[bytes], labels: list[str], o: TrainOptions = TrainOptions()) -> Model:
    languages = sorted(set(labels))
    r = np.random.default_rng(o.seed)
    x, counts = to_windows(texts, o.window)
    y = np.repeat(np.array([languages.index(v) for v in labels], "i8"), counts) if len(labels) else np.zeros(0, "i8")
    total = o.filters * len(WIDTHS)
    m = Model(languages, o.window, r.normal(0, 0.5, (256, o.embedding)), [r.normal(0, (w * o.embedding) ** -0.5, (w * o.embedding, o.filters)) for w in WIDTHS], [np.zeros(o.filters) for _ in WIDTHS], r.normal(0, total**-0.5, (total, max(len(languages), 1))), np.zeros(max(len(languages), 1)))
    params = [m.embed, *m.filters, *m.bias, m.out, m.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(o.epochs if len(languages) > 1 else 0):
        order = r.permutation(len(x))
        for at in range(0, len(order), o.batch):
            xb, yb = x[order[at : at + o.batch]], y[order[at : at + o.batch]]
            (cols, where), h, p = _forward(m, xb)
            p[np.arange(len(yb)), yb] -= 1
            p /= len(yb)
            gh = (p @ m.out.T) * (h > 0)
            g_embed, g_filters, g_bias = np.zeros_like(m.embed), [], []
            for i, w in enumerate(WIDTHS):
                g = gh[:, i * o.filters : (i + 1) * o.filters]
                row = np.arange(len(xb))[:, None]
                picked = cols[i][row, where[i]]  # windows x filters x (w * embedding)
                g_filters.append(np.einsum("nf,nfd->df", g, picked))
                g_bias.append(g.sum(0))
                back = (g[:, :, None] * m.filters[i].T[None]).reshape(len(xb), o.filters, w, o.embedding)
                for j in range(w):
                    np.add.at(g_embed, xb[row, where[i] + j], back[:, :, j])
            step += 1
            for k, g in enumerate([g_embed, *g_filters, *g_bias, h.T @ p, p.sum(0)]):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= o.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


class Scorer:
    """Scores texts with a model's filters unrolled into tables over byte pairs."""

    def __init__(self, m: Model):
        self.m = m
        one = [[(m.embed @ f[i * m.embed.shape[1] : (i + 1) * m.embed.shape[1]]).astype("f4") for i in range(len(f) // m.embed.shape[1])] for f in m.filters]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        two, three, four = one
        self.first = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], axis=1)
        self.later = np.concatenate([pair(three[2], np.zeros_like(three[2])), pair(four[2], four[3])], axis=1)
        self.bias = np.concatenate(m.bias).astype("f4")

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for windows (n x length)."""
        f = self.m.filters[0].shape[1]
        out = np.empty((len(x), len(self.m.out_bias)))
        for at in range(0, len(x), 256):
            b = x[at : at + 256].astype("i4")
            two = b[:, :-1] * 256 + b[:, 1:]
            a = self.first[two]
            c = self.later[np.concatenate([two[:, 2:], b[:, -1:] * 256], axis=1)]
            a[:, :-1, f : 2 * f] += c[:, :, :f]
            a[:, :-2, 2 * f :] += c[:, :-1, f:]
            h = np.concatenate([a[:, :, :f].max(1), a[:, :-1, f : 2 * f].max(1), a[:, :-2, 2 * f :].max(1)], axis=1)
            z = np.maximum(h + self.bias, 0) @ self.m.out + self.m.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            out[at : at + 256] = z / z.sum(1, keepdims=True)
        return out

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        bare = [not t or not any(map(str.isalpha, t)) for t in texts]
        x, counts = to_windows([b"" if no else t.encode("utf-8", "replace") for t, no in zip(texts, bare, strict=True)], self.m.window)
        cut = np.concatenate([[0], np.cumsum(counts)])
        p = np.concatenate([np.zeros((1, len(self.m.out_bias))), np.cumsum(self.windows(x), axis=0)]) if len(x) else np.zeros((1, len(self.m.out_bias)))
        mean = (p[cut[1:]] - p[cut[:-1]]) / np.maximum(counts, 1)[:, None]
        best = mean.argmax(1)
        no = np.array(bare, bool) | (not self.m.languages)
        return [UNKNOWN if b else self.m.languages[i] for b, i in zip(no, best, strict=True)], np.where(no, 0.0, np.clip(mean.max(1), 0, 1))


def _predict(batches: Iterator[pa.RecordBatch], model, schema_names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model.value)
    for b in batches:
        lang, score = scorer.texts(b.column("_text").to_pylist())
        rest = [b.column(i) for i, n in enumerate(b.schema.names) if n != "_text"]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*schema_names, "lang_pred", "score"])


def training_sample(docs: DataFrame, text: str = "text", lang: str = "lang", o: TrainOptions = TrainOptions()) -> pd.DataFrame:
    """At most per_language rows of every language, distinct texts dealt by hash."""
    d = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    start = F.pmod("h", F.greatest(F.length("text") - o.passage, F.lit(1))).cast("int") + 1
    d = d.select("lang", "h", F.col("text").substr(start, F.lit(o.passage)).alias("text"))
    languages = small_side(d.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")), "languages")
    each = min(o.per_language, max(1, o.sample // max(languages.count(), 1)))
    share = F.least(F.lit(1.0), F.lit(1.25 * each + 200) / F.greatest("texts", F.lit(1))) * 2**32
    at = F.pmod(F.xxhash64("h"), F.lit(2**32))
    rows = d.join(languages.select(F.col("lang").alias("_lang"), share.alias("_share")), F.col("lang") == F.col("_lang")).where(at < F.col("_share")).select("lang", "h", "text")
    rows = distinct_by(rows, "h", "lang").withColumn("at", at).toPandas()
    rows = rows.sort_values(["lang", "at", "h"]).groupby("lang").head(each)
    return rows[["lang", "text"]].reset_index(drop=True)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", o: TrainOptions = TrainOptions()) -> Model:
    s = training_sample(docs, text, lang, o)
    return train([t.encode("utf-8", "replace") for t in s["text"]], list(s["lang"]), o)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score, one row for each row of ``docs``; other columns are ignored.

    Null text, text without a letter, or a model that has seen no language gives ``und`` and score 0. Repeated rows
    each get a row; an empty table gives an empty result.
    """
    d = docs.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields if f.name != "_text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return d.mapInArrow(partial(_predict, model=shared, schema_names=tuple(keep)), f"{fields}, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has a null ``held_out``, and its row is labelled but not learned from."""
    d = documents(spark, sf_dir).select("doc_id", "text", "lang", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0).alias("held_out"))
    model = fit(d.where(~F.col("held_out")))
    return identify(d, model, keep=("doc_id", "held_out"))
