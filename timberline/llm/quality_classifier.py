"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence is a logistic model over the shape of its whole text (case, symbols, repeats, word lengths),
fitted in numpy to a bounded sample of labelled rows (``Options.sample``, distinct texts dealt by hash). Spark sums this
evidence over every path of every host and every host; each level's mean is shrunk toward the level above by a weight
that the spread of the groups around their own parents gives (method of moments), so sparse paths follow their host and
sparse hosts the corpus. A document's posterior joins its own log-odds with those of its path; it is left out of the
means of its path and its host.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import distinct_count, documents, hash_sample, small_side, staged

SYMBOLS = b"#*$%&|<>!{}[]=_~^@\\/+"
UPPERS = bytes(range(65, 91))
LOWERS = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
HIGH = bytes(range(128, 256))
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


@dataclass(frozen=True)
class Options:
    sample: int = 20_000
    ridge: float = 1.0
    threshold: float = 0.5
    max_weight: float = 1e6


@dataclass
class Model:
    """An empty model (no labelled rows) gives every document the same evidence."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(10))
    scale: np.ndarray = field(default_factory=lambda: np.ones(10))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(11))


def features(text: str | None) -> list[float]:
    t = (text or "").encode("utf-8", "replace")
    n = max(len(t), 1)
    w = WORD.findall(t)
    k = max(len(w), 1)
    count = lambda chars: len(t) - len(t.translate(None, chars))
    upper, lower = count(UPPERS), count(LOWERS)
    lines = [x for x in t.split(b"\n") if x.strip()]
    return [
        np.log1p(len(w)),
        np.log1p(len(t) / k),
        upper / max(upper + lower, 1),
        np.log1p(100 * count(SYMBOLS) / n),
        np.log1p(100 * count(DIGITS) / n),
        count(HIGH) / n,
        len(set(w)) / k,
        sum(a == b for a, b in zip(w, w[1:], strict=False)) / k,
        1 - len(set(lines)) / max(len(lines), 1),
        float(not w),
    ]


def train(x: np.ndarray, y: np.ndarray, o: Options = Options()) -> Model:
    """Ridge logistic regression by damped Newton steps."""
    if not len(y) or y.min() == y.max():
        return Model()
    m = Model(x.mean(0), x.std(0) + 1e-6)
    a = np.concatenate([(x - m.mean) / m.scale, np.ones((len(x), 1))], 1)
    w, keep = np.zeros(a.shape[1]), np.diag([*[o.ridge] * x.shape[1], 1e-3])
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + keep, a.T @ (y - q) - keep @ w)
        w += np.clip(step, -3, 3)
    m.weights = w
    return m


def probability(m: Model, x: np.ndarray) -> np.ndarray:
    z = ((x - m.mean) / m.scale) @ m.weights[:-1] + m.weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def shape(text: Column) -> Column:
    """The features of each text, as an array."""
    return F.pandas_udf(lambda s: pd.Series([features(t) for t in s], dtype=object), "array<double>")(text)


def measure(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", path: str = "lang", text: str = "text") -> DataFrame:
    """(_id, _host, _path, _hash, _x) of every document: all that fitting and the sites' sums need, written once."""
    return staged(docs.select(F.col(doc_id).alias("_id"), F.col(host).alias("_host"), F.col(path).alias("_path"), F.xxhash64(text).alias("_hash"), shape(F.col(text)).alias("_x")), "quality-features")


def fit(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", o: Options = Options()) -> Model:
    """Fits to the measured rows that have a label; of several labels the least counts."""
    y = small_side(labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).dropna().groupBy("_id").agg(F.min("_y").alias("_y")), "quality-labels")
    d = measured.join(y, "_id").select("_y", "_hash", "_x")
    rows = hash_sample(d, "_hash", "_y", o.sample, distinct_count(d, F.col("_hash"))).collect()
    return train(np.array([r["_x"] for r in rows], float).reshape(-1, 10), np.array([r["_y"] for r in rows], float), o)


def evidence(m: Model, x: Column) -> Column:
    """The chance of good quality by the text alone: the logistic model as a column expression."""
    z = F.lit(float(m.weights[-1]))
    for i, (mean, scale, w) in enumerate(zip(m.mean, m.scale, m.weights[:-1], strict=True)):
        z = z + (x[i] - float(mean)) / float(scale) * float(w)
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))))


def _weight(stats: DataFrame, o: Options) -> float:
    """Prior weight, in documents, of a parent's mean for its groups, by the method of moments.

    ``stats`` has a row (n, total, squares) for each group, with its parent's (pn, ptotal). Groups spread around their
    own parent, so what tells parents apart does not count. Each parent's shares n / pn add up to 1.
    """
    at_least_one = lambda c: F.greatest(F.col(c), F.lit(1))  # noqa: E731  (no group is empty; an empty table's plan is)
    m = F.col("total") / at_least_one("n")
    each = stats.where("n > 0").select("n", (F.col("n") / at_least_one("pn")).alias("share"), (F.col("n") * (m - F.col("ptotal") / at_least_one("pn")) ** 2).alias("between"), (F.col("squares") - F.col("total") * m).alias("within"))
    r = each.agg(F.count("*").alias("groups"), F.sum("share").alias("parents"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("share")).alias("n2"), F.sum("between").alias("between"), F.sum("within").alias("within")).first()
    free = r["groups"] - (r["parents"] or 0.0)
    if free < 0.5 or (r["n"] or 0) <= r["groups"]:
        return o.max_weight
    within = max(r["within"], 0.0) / (r["n"] - r["groups"])
    tau = (r["between"] - free * within) / (r["n"] - r["n2"])
    return float(np.clip(within / tau, 1.0, o.max_weight)) if tau > 0 else o.max_weight


def posteriors(scored: DataFrame, host: str, path: str, o: Options = Options()) -> tuple[DataFrame, float, float, float]:
    """(_h, _p, n, total, pn, ptotal) of every path and its host, the corpus mean, and the weights of corpus and host."""
    paths = staged(scored.groupBy(F.col(host).alias("_h"), F.col(path).alias("_p")).agg(F.count("*").alias("n"), F.sum("_e").alias("total"), F.sum(F.col("_e") ** 2).alias("squares")), "quality-sites")
    hosts = paths.groupBy("_h").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    all_ = hosts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    mean = (all_["total"] / all_["n"]) if all_["n"] else 0.5
    upper = _weight(hosts.withColumns({"pn": F.lit(all_["n"] or 0), "ptotal": F.lit(all_["total"] or 0.0)}), o)
    hosts = hosts.select(F.col("_h").alias("_hh"), F.col("n").alias("pn"), F.col("total").alias("ptotal"))
    paths = paths.join(hosts, F.col("_h").eqNullSafe(F.col("_hh"))).drop("_hh")
    return paths.drop("squares"), mean, upper, _weight(paths, o)


def _logit(c: Column) -> Column:
    c = F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(c / (1 - c))


def judged(d: DataFrame, measured: DataFrame, model: Model, host: str, path: str, o: Options) -> DataFrame:
    """Adds the four result columns to rows with features ``_x``; the sites' sums come from ``measured``."""
    paths, mean, upper, lower = posteriors(measured.withColumn("_e", evidence(model, F.col("_x"))), "_host", "_path", o)
    paths = paths.select("_h", "_p", F.col("n").alias("_n"), F.col("total").alias("_s"), F.col("pn").alias("_pn"), F.col("ptotal").alias("_ps"))
    d = d.withColumn("_e", evidence(model, F.col("_x")))
    d = d.join(small_side(paths, "quality-paths"), F.col(host).eqNullSafe(F.col("_h")) & F.col(path).eqNullSafe(F.col("_p")), "left")
    above = (upper * mean + F.col("_ps") - F.col("_e")) / (upper + F.col("_pn") - 1)
    site = (lower * above + F.col("_s") - F.col("_e")) / (lower + F.col("_n") - 1)
    d = d.withColumn("_site", F.greatest(F.least(site, F.lit(1.0)), F.lit(0.0)))
    z = _logit(F.col("_e")) + _logit(F.col("_site")) - _logit(F.lit(float(mean)))
    d = d.withColumns({"text_quality": F.col("_e"), "site_quality": F.col("_site"), "quality_score": 1 / (1 + F.exp(-z))})
    return d.withColumn("accepted", F.col("quality_score") >= o.threshold).drop("_e", "_h", "_p", "_n", "_s", "_pn", "_ps", "_site", "_x")


def classify(docs: DataFrame, model: Model, measured: DataFrame | None = None, host: str = "source", path: str = "lang", text: str = "text", o: Options = Options()) -> DataFrame:
    """``docs`` with text_quality (own evidence), site_quality (its path without itself), quality_score and accepted.

    Null host or path is a group of its own; null or empty text is scored by its features. Repeated rows each get a
    row; an empty table gives an empty result. All columns of ``docs`` stay, also those with clashing names, unless
    they bear the four names above, which are then replaced. A null doc_id has no label. ``measured`` saves a pass where it was made for fitting.
    """
    if measured is None:
        measured = measure(docs.withColumn("_none", F.lit(None).cast("bigint")), "_none", host, path, text)
    return judged(docs.withColumn("_x", shape(F.col(text))), measured, model, host, path, o)


def labelled(spark: SparkSession, sf_dir: str, docs: DataFrame) -> tuple[Model, DataFrame]:
    """A model fitted to the labelled rows of ``docs``, and their measures."""
    measured = measure(docs)
    return fit(measured, spark.read.parquet(f"{sf_dir}/labels.parquet")), measured


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the documents' sources, paths the languages within a source."""
    model, measured = labelled(spark, sf_dir, documents(spark, sf_dir))
    out = judged(measured, measured, model, "_host", "_path", Options())
    return out.select(F.col("_id").alias("doc_id"), "text_quality", "site_quality", "quality_score", "accepted")
