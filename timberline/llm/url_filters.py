"""URL filters: rules on hosts and paths, and for the rest a naive Bayes model over words of host and path.

Host names run words together. A unigram model of the corpus's own words splits them: every substring of a run of letters
that is a word of the corpus is an arc, unknown stretches cost by length, and Viterbi takes the likeliest split. The
multinomial naive Bayes model then learns from the pages that a rule decides, over the words of the host (its last label
says nothing of content and is left out) and the tokens of the path, and judges all other pages.

Words, hosts and runs of letters are joined as tables, so no vocabulary travels. Tokens are hashed to a fixed number of
buckets, so the model that every task gets has one size whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import az_lower, join_hot, staged

#: Letters once A-Z are lower-cased: a-z and all that is not ASCII.
LETTERS = r"[^\x00-\x60\x7B-\x7F]+"
MARKUP = r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>"
ALLOW, BLOCK = "allow", "block"
RULES = ((ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"), (BLOCK, "net/es/"), (BLOCK, "net/fr/"))
#: Words that speak against a host before any page is seen.
SEEDS = ("ads", "adult", "bet", "bets", "casino", "pills", "porn", "spam", "track", "win", "xxx")


@dataclass(frozen=True)
class UrlOptions:
    """max_word: code points of the longest word of the unigram model. seed_weight: pages that each seed word counts for."""

    max_word: int = 24
    buckets: int = 1 << 18
    smoothing: float = 1.0
    seeds: tuple[str, ...] = SEEDS
    seed_weight: float = 5.0


@dataclass
class UrlModel:
    """weights[b]: log-odds of block against allow of a token in bucket b; 0 where none was seen."""

    weights: np.ndarray
    prior: float


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return az_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, the first of equally long ones; null where none does.

    A rule is ``host/path``: it fits its host and all subdomains if the path starts with the rule's. The rules become
    one expression, so they are meant to be some hundreds, not millions.
    """
    out = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        h, slash, p = rule.partition("/")
        fits = (host == h) | host.endswith(f".{h}")
        out.append(F.when(fits & path.startswith(slash + p), F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    none = F.lit(None).cast("struct<verdict:string,rule:string>")
    return F.coalesce(*out, none)


def word_counts(texts: DataFrame, text: str, o: UrlOptions = UrlOptions()) -> DataFrame:
    """(word, n) of all words of the texts outside markup, up to ``max_word`` code points each."""
    bare = az_lower(F.regexp_replace(F.col(text), MARKUP, " "))
    words = texts.select(F.explode(F.regexp_extract_all(bare, F.lit(f"({LETTERS})"), F.lit(1))).alias("word"))
    return words.where(F.length("word") <= o.max_word).groupBy("word").agg(F.count("*").alias("n"))


def runs_of(host: Column) -> Column:
    """The runs of letters of all labels of a host but the last."""
    labels = F.split(host, r"\.")
    return F.regexp_extract_all(F.array_join(F.slice(labels, 1, F.size(labels) - 1), "."), F.lit(f"({LETTERS})"), F.lit(1))


def viterbi(run: str, arcs: list[tuple[int, int, float]], total: int) -> list[str]:
    """The likeliest split. arcs: (start, size, log probability) of the words in it; an unknown stretch of k code points
    counts as 10 / (total * 10**k). Of equal splits the one whose last word is longest stands."""
    n = len(run)
    by_end: list[list] = [[] for _ in range(n + 1)]
    for start, size, lp in arcs:
        by_end[start + size].append((size, lp))
    enter, step = math.log(10) - math.log(max(total, 1)), math.log(10)
    best, back, unknown, began = [0.0], [0], -math.inf, 0
    for i in range(1, n + 1):
        fresh = best[i - 1] + enter
        unknown, began = (fresh - step, i - 1) if fresh >= unknown else (unknown - step, began)
        top, size = unknown, i - began
        for k, lp in sorted(by_end[i], reverse=True):
            if best[i - k] + lp > top:
                top, size = best[i - k] + lp, k
        best.append(top)
        back.append(size)
    out, i = [], n
    while i:
        out.append(run[i - back[i] : i])
        i -= back[i]
    return out[::-1]


def segmented(runs: DataFrame, words: DataFrame, o: UrlOptions = UrlOptions()) -> DataFrame:
    """(run, words) of distinct ``runs`` (run), by the unigram model ``words`` (word, n).

    Arcs are found by joining substrings with words; a substring that very many runs hold, such as a single letter, meets
    a broadcast of such words alone. A run's arcs, at most ``max_word`` for each of its letters, meet in one task.
    """
    total = words.agg(F.sum("n")).first()[0] or 0
    at = runs.select("run", F.explode(F.sequence(F.lit(0), F.length("run") - 1)).alias("start"))
    sized = at.select("run", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(o.max_word), F.length("run") - F.col("start")))).alias("size"))
    parts = sized.withColumn("word", F.substring("run", F.col("start") + 1, F.col("size")))
    known = staged(parts.groupBy("word").agg(F.count("*").alias("uses")).join(words, "word"), "url-words")
    arcs = join_hot(parts, known, ["word"], "uses").where(F.col("n").isNotNull())
    arcs = arcs.groupBy("run").agg(F.collect_list(F.struct("start", "size", (F.log(F.col("n") / F.lit(float(max(total, 1))))).alias("lp"))).alias("arcs"))

    @F.pandas_udf("array<string>")
    def split(run: pd.Series, arcs: pd.Series) -> pd.Series:
        return pd.Series([viterbi(r, [] if a is None else [(x["start"], x["size"], x["lp"]) for x in a], total) for r, a in zip(run, arcs, strict=True)], dtype=object)

    return runs.join(arcs, "run", "left").select("run", split("run", "arcs").alias("words"))


def host_words(hosts: DataFrame, words: DataFrame, o: UrlOptions = UrlOptions()) -> DataFrame:
    """``hosts`` (host and others, one row each) with ``words``, the words of all its runs in order."""
    at = hosts.select("host", F.posexplode(runs_of(F.col("host"))).alias("pos", "run"))
    uses = at.groupBy("run").agg(F.count("*").alias("uses"))
    split = staged(segmented(staged(uses.select("run"), "url-runs"), words, o).join(uses, "run"), "url-runs")
    each = join_hot(at, split, ["run"], "uses").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("pos", "words"))).alias("w"))
    none = F.array().cast("array<string>")
    return hosts.join(each.select("host", F.flatten(F.col("w.words")).alias("words")), "host", "left").withColumn("words", F.coalesce("words", none))


def path_tokens(path: Column) -> Column:
    """Runs of letters and, as ``#``, runs of digits."""
    found = F.regexp_extract_all(az_lower(path), F.lit(f"([0-9]+|{LETTERS})"), F.lit(1))
    return F.transform(found, lambda x: F.when(x.rlike("^[0-9]"), "#").otherwise(x))


def bucket(kind: str, token: Column, o: UrlOptions) -> Column:
    return (F.crc32(F.concat(F.lit(f"{kind}:"), token).cast("binary")) % o.buckets).cast("int")


def fit(hosts: DataFrame, labelled: DataFrame, o: UrlOptions = UrlOptions()) -> UrlModel:
    """From hosts (words, allowed, blocked: pages decided so) and the decided pages (path, verdict)."""
    sums = lambda df: df.groupBy("b").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    of_hosts = hosts.where("allowed + blocked > 0").select(F.explode("words").alias("t"), "allowed", "blocked").select(bucket("h", F.col("t"), o).alias("b"), "allowed", "blocked")
    of_paths = labelled.select(F.explode(path_tokens(F.col("path"))).alias("t"), (F.col("verdict") == ALLOW).cast("bigint").alias("allowed"), (F.col("verdict") == BLOCK).cast("bigint").alias("blocked"))
    of_paths = of_paths.select(bucket("p", F.col("t"), o).alias("b"), "allowed", "blocked")
    counts = np.zeros((2, o.buckets))
    for r in sums(sums(of_hosts).unionByName(sums(of_paths))).collect():  # at most ``buckets`` rows
        counts[:, r["b"]] = r["allowed"], r["blocked"]
    pages = hosts.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    if o.seeds:  # as many allowed words of no name stand against them, so that seeds count even where no page is decided
        other, *seeds = hosts.sparkSession.range(1).select(*(bucket("h", F.lit(s), o) for s in ("", *o.seeds))).first()
        counts[0, other] += o.seed_weight * len(seeds)
        for b in seeds:
            counts[1, b] += o.seed_weight
    return naive_bayes(counts, pages["a"] or 0, pages["b"] or 0, o)


def naive_bayes(counts: np.ndarray, allowed: int, blocked: int, o: UrlOptions) -> UrlModel:
    seen = counts.sum(0) > 0
    totals = counts.sum(1, keepdims=True) + o.smoothing * seen.sum()
    chance = np.log((counts[:, seen] + o.smoothing) / totals)
    weights = np.zeros(o.buckets)
    weights[seen] = chance[1] - chance[0]
    return UrlModel(weights, math.log((blocked + 1) / (allowed + 1)))


def evidence(buckets: Column, m: UrlModel) -> Column:
    """The sum of the weights of an array of buckets."""
    weights = m.weights

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([math.fsum(weights[np.asarray(b, int)]) if len(b) else 0.0 for b in s], dtype=float)

    return run(buckets)


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, page_id: str = "page_id", url: str = "url", text: str = "html", o: UrlOptions = UrlOptions()) -> tuple[DataFrame, UrlModel]:
    """((page_id, host, path, rule, verdict, score, host_words), one row for each page, and the model).

    verdict is the rule's, or else ``block`` where the model's log-odds ``score`` is above 0 and ``allow`` where not. A null url or
    one without ``://`` has an empty host and path and is judged by the prior alone. Null ids and texts are allowed,
    repeated rows each have their row, an empty table gives an empty result, and other columns play no part. Without
    decided pages the seed words alone tell hosts apart.
    """
    words = staged(word_counts(pages, text, o), "url-words")
    p = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    p = p.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    by = lambda v: F.count_if(F.col("_rule.verdict") == v)
    hosts = p.groupBy("host").agg(F.count("*").alias("_n"), by(ALLOW).alias("allowed"), by(BLOCK).alias("blocked"))
    hosts = staged(host_words(staged(hosts, "url-hosts"), words, o), "url-hosts")
    model = fit(hosts, p.where(F.col("_rule").isNotNull()).select("path", F.col("_rule.verdict").alias("verdict")), o)
    scored = hosts.select("host", "_n", F.col("words").alias("host_words"), evidence(F.transform("words", lambda t: bucket("h", t, o)), model).alias("_host"))
    d = join_hot(p, staged(scored, "url-hosts"), ["host"], "_n")
    d = d.withColumn("score", model.prior + F.col("_host") + evidence(F.transform(path_tokens(F.col("path")), lambda t: bucket("p", t, o)), model))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") > 0, BLOCK).otherwise(ALLOW))
    return d.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score", "host_words"), model


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge_urls(pages)[0].drop("score").withColumn("host_words", F.array_join("host_words", " "))


def _crc_sql(k: str) -> str:
    """crc32 of a text's UTF-8 bytes, bit by bit."""
    h = f"hex(encode({k}))"
    byte = f"list_transform(range(0, CAST(length({h}) // 2 AS BIGINT)), lambda i: CAST('0x' || substr({h}, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce({byte}, lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v // 2, 3988292384 * (v % 2)), xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295)"


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SEEDS = " UNION ALL ".join([f"SELECT 'h:' AS k, {5.0 * len(SEEDS)} AS a, 0.0 AS b", *(f"SELECT 'h:{s}', 0.0, 5.0" for s in SEEDS)])
_RULE_SQL = " ".join(f"WHEN (host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}') THEN '{v} {r}'" for v, r in sorted(RULES, key=lambda x: -len(x[1])))
#: The split of every run comes letter by letter from the best splits of its beginnings.
OP11_SQL = rf"""
WITH RECURSIVE p0 AS (SELECT row_number() OVER () AS r, page_id, html, translate(regexp_extract(coalesce(url, ''), '^(?s).*?://([^/?#]*)', 1), {_LOWER}) AS host, regexp_extract(coalesce(url, ''), '^(?s).*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS (SELECT *, CASE {_RULE_SQL} END AS ruled FROM p0),
w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<[^>]*>', ' ', 'g'), {_LOWER}), '[^\x00-\x60\x7B-\x7F]+')) AS word FROM pages) WHERE length(word) <= 24 GROUP BY word),
tot AS (SELECT greatest(coalesce(sum(n), 0), 1) AS total FROM w),
h AS (SELECT host, count(*) FILTER (starts_with(ruled, 'allow')) AS a, count(*) FILTER (starts_with(ruled, 'block')) AS b, regexp_extract_all(array_to_string(list_slice(string_split(host, '.'), 1, -2), '.'), '[^\x00-\x60\x7B-\x7F]+') AS runs FROM p GROUP BY host),
runs AS (SELECT DISTINCT unnest(runs) AS run FROM h),
arcs AS (SELECT run, i, list({{'k': k, 'l': ln(n / total)}} ORDER BY k DESC) AS arcs FROM (SELECT run, i, k, substr(run, i - k + 1, k) AS word FROM runs, unnest(range(1, length(run) + 1)) AS t(i), unnest(range(1, least(24, i) + 1)) AS s(k)) JOIN w USING (word), tot GROUP BY ALL),
dp AS (
    SELECT run, CAST(0 AS BIGINT) AS i, [{{'l': CAST(0 AS DOUBLE), 'w': []::VARCHAR[]}}] AS best, CAST('-inf' AS DOUBLE) AS unk, CAST(0 AS BIGINT) AS began FROM runs
    UNION ALL
    SELECT run, i, list_append(best, list_reduce(list_transform(coalesce(arcs, []), lambda x: {{'l': best[i - x.k + 1].l + x.l, 'w': list_append(best[i - x.k + 1].w, substr(run, i - x.k + 1, x.k))}}),
        lambda y, z: CASE WHEN z.l > y.l THEN z ELSE y END, {{'l': unk, 'w': list_append(best[began + 1].w, substr(run, began + 1, i - began))}})), unk, began
    FROM (SELECT d.run, d.i + 1 AS i, d.best, greatest(d.best[d.i + 1].l + (ln(10) - ln(total)), d.unk) - ln(10) AS unk, CASE WHEN d.best[d.i + 1].l + (ln(10) - ln(total)) >= d.unk THEN d.i ELSE d.began END AS began, a.arcs
        FROM dp d CROSS JOIN tot LEFT JOIN arcs a ON a.run = d.run AND a.i = d.i + 1 WHERE d.i < length(d.run))
),
split AS (SELECT run, best[i + 1].w AS words FROM dp WHERE i = length(run)),
hw AS (SELECT h.host, any_value(a) AS a, any_value(b) AS b, coalesce(flatten(list(words ORDER BY pos) FILTER (words IS NOT NULL)), []) AS words FROM h LEFT JOIN (SELECT host, unnest(runs) AS run, unnest(range(1, len(runs) + 1)) AS pos FROM h) x USING (host) LEFT JOIN split USING (run) GROUP BY h.host),
pt AS (SELECT r, CASE WHEN regexp_matches(t, '^[0-9]') THEN '#' ELSE t END AS t FROM (SELECT r, unnest(regexp_extract_all(translate(path, {_LOWER}), '[0-9]+|[^\x00-\x60\x7B-\x7F]+')) AS t FROM p)),
ht AS (SELECT host, unnest(words) AS t FROM hw),
k AS (SELECT 'h:' || t AS k, CAST(sum(a) AS DOUBLE) AS a, CAST(sum(b) AS DOUBLE) AS b FROM ht JOIN hw USING (host) GROUP BY t UNION ALL
    SELECT 'p:' || t, CAST(count(*) FILTER (starts_with(ruled, 'allow')) AS DOUBLE), CAST(count(*) FILTER (starts_with(ruled, 'block')) AS DOUBLE) FROM pt JOIN p USING (r) GROUP BY t UNION ALL {_SEEDS}),
c AS (SELECT *, {_crc_sql('k')} % 262144 AS bucket FROM k),
f AS (SELECT bucket, sum(a) AS a, sum(b) AS b FROM c GROUP BY bucket HAVING sum(a) + sum(b) > 0),
s AS (SELECT sum(a) + count(*) AS a, sum(b) + count(*) AS b FROM f),
wt AS (SELECT DISTINCT k, ln((f.b + 1) / s.b) - ln((f.a + 1) / s.a) AS wt FROM c JOIN f USING (bucket), s),
prior AS (SELECT ln((sum(b) + 1) / (sum(a) + 1)) AS prior FROM hw),
hs AS (SELECT host, sum(wt) AS v FROM ht JOIN wt ON k = 'h:' || t GROUP BY host),
ps AS (SELECT r, sum(wt) AS v FROM pt JOIN wt ON k = 'p:' || t GROUP BY r)
SELECT page_id, p.host, path, substr(ruled, 7) AS rule, CASE WHEN ruled IS NOT NULL THEN substr(ruled, 1, 5) WHEN prior + coalesce(hs.v, 0) + coalesce(ps.v, 0) > 0 THEN 'block' ELSE 'allow' END AS verdict, array_to_string(words, ' ') AS host_words
FROM p JOIN hw ON hw.host = p.host LEFT JOIN hs ON hs.host = p.host LEFT JOIN ps USING (r), prior
"""
