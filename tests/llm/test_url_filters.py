import math
import random
import re
import zlib
from collections import Counter

import duckdb

from timberline.llm import url_filters as uf

SCHEMA = "page_id bigint, url string, html string, host string, path string, words string, run string, start int, n int, score string"
LETTERS = re.compile("[^\x00-\x60\x7b-\x7f]+")


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def pages(n=120, seed=2):
    r = random.Random(seed)
    names = ["newstoday", "free-bets", "catcasino", "www", "m", "thecatsat", "zzqxw", "überhund", "a1b2", "co", "the" * 30]
    out = [(None, None, None), (1, "", ""), (1, "", ""), (2, "no scheme/en/", "the"), (3, "://", "x"), (4, "HTTP://WWW.Example.COM/en/x?y=://z", "cat"), (5, "http://example.com", None), (6, "http://a.example.com/en/\n1#t", "dog"), (7, "x://net/fr/1", "The"), (8, "http://badnet/fr/", "cat")]
    for i in range(10, 10 + n):
        host = ".".join(r.sample(names, r.randint(0, 2)) + [r.choice(["example", "site", "Über", "net-works"]), r.choice(["com", "net", "org"])])
        url = f"{r.choice(['http', 'https'])}://{host}/{r.choice(['en', 'fr', 'es', 'EN/sport', 'de/casino'])}/{r.randint(1, 99)}{r.choice(['', '?a=b', '#top', '/x.html'])}"
        out.append((i, url, f"<p class='the'>{' '.join(r.choice(['the', 'cat', 'sat', 'News', 'today', 'casino', 'über', 'hund', 'free', 'bets', 'net', 'works', 'a', 't', 'he']) for _ in range(20))}</p><script>casinocasino</script>"))
    return out + out[-5:]


def brute(rows, o):
    """The same results by plain loops; splits by trying all of them where a run is short."""
    words = Counter()
    for _, _, html in rows:
        bare = re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ", html or "")
        words.update(w for w in LETTERS.findall(lower(bare)) if len(w) <= o.max_word)
    total = max(sum(words.values()), 1)

    def cost(part):
        known = math.log(words[part] / total) if part in words else -math.inf
        return max(known, math.log(10) - math.log(total) - len(part) * math.log(10))

    def best(run):
        """The likeliest split's probability."""
        top = [0.0] + [-math.inf] * len(run)
        for j in range(1, len(run) + 1):
            top[j] = max(top[i] + cost(run[i:j]) for i in range(j))
        return top[-1]

    def host_path(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        tail = rest[cut:]
        return lower(rest[:cut]), tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]

    def rule(host, path):
        fits = [(len(r), v, r) for v, r in uf.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return max(fits)[1:] if fits else (None, None)

    return words, total, cost, best, host_path, rule


def test_against_brute_force(spark):
    o = uf.UrlOptions()
    rows = pages()
    df = spark.createDataFrame([(*r, "c", "c", "c", "c", 1, 1, "c") for r in rows], SCHEMA).repartition(3)
    got, model = uf.judge_urls(df, o=o)
    got = got.collect()
    words, total, cost, best, host_path, rule = brute(rows, o)
    assert len(got) == len(rows)
    splits = {}
    for r in got:
        labels = r.host.split(".")
        runs = LETTERS.findall(".".join(labels[:-1]))
        assert "".join(r.host_words) == "".join(runs)
        if runs and r.host not in splits:  # as likely as the best split, run by run
            left = list(r.host_words)
            for run in runs:
                parts, size = [], 0
                while size < len(run):
                    parts.append(left.pop(0))
                    size += len(parts[-1])
                assert "".join(parts) == run and math.isclose(sum(map(cost, parts)), best(run))
        splits[r.host] = r.host_words
    # naive Bayes by the formula
    token = lambda path: ["#" if t[0].isdigit() and t[0].isascii() else t for t in re.findall("[0-9]+|[^\x00-\x60\x7b-\x7f]+", lower(path))]
    bucket = lambda kind, t: zlib.crc32(f"{kind}:{t}".encode()) % o.buckets
    tokens = lambda h, p: [bucket("h", w) for w in splits[h]] + [bucket("p", t) for t in token(p)]
    counts, n = {"allow": Counter({bucket("h", ""): o.seed_weight * len(o.seeds)}), "block": Counter({bucket("h", s): o.seed_weight for s in o.seeds})}, Counter()
    for _, url, _ in rows:
        v, _ = rule(*host_path(url))
        if v:
            counts[v].update(tokens(*host_path(url)))
            n[v] += 1
    seen = set(counts["allow"]) | set(counts["block"])
    chance = {v: {b: math.log((c[b] + 1) / (sum(c.values()) + len(seen))) for b in seen} for v, c in counts.items()}
    want = []
    for i, url, _ in rows:
        h, p = host_path(url)
        v, text = rule(h, p)
        score = math.log((n["block"] + 1) / (n["allow"] + 1)) + sum(chance["block"][b] - chance["allow"][b] for b in tokens(h, p) if b in seen)
        want.append((i, h, p, text, v or ("block" if score > 0 else "allow"), round(score, 6)))
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, round(r.score, 6)) for r in got), key=str) == sorted(want, key=str)


def test_longest_rule_wins(spark):
    urls = ["http://www.example.com/en/", "http://example.com/en/1", "http://x.example.com/en/", "http://example.com/de", "http://a.www.example.com/en/q", "http://net/fr/", "http://xnet/fr/", "http://example.net/en/", "http://example.com"]
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id int, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in uf.judge_urls(df)[0].collect()}
    assert [got[i][0] for i in range(9)] == ["www.example.com/en/", "example.com/en/", "example.com/en/", "com/", "www.example.com/en/", "net/fr/", None, None, None]
    assert [got[i][1] for i in range(6)] == ["allow", "block", "block", "allow", "allow", "block"]


def test_splits_take_words_and_mark_unknown_stretches():
    lp = lambda x: math.log(x / 1000)
    arcs = [(0, 3, lp(50)), (3, 3, lp(20)), (0, 1, lp(5)), (9, 3, lp(50))]
    assert uf.viterbi("thecatqqqthe", arcs, 1000) == ["the", "cat", "qqq", "the"]
    assert uf.viterbi("zzzz", [], 1000) == ["zzzz"]
    assert uf.viterbi("", [], 0) == []


def test_seed_words_block_where_no_page_is_decided(spark):
    df = spark.createDataFrame([(i, u, "casino win good cats play") for i, u in enumerate(["http://casinowin.org/x", "http://goodcats.org/x"])], "page_id int, url string, html string")
    got = {r.page_id: (r.verdict, r.host_words) for r in uf.judge_urls(df, rules=())[0].collect()}
    assert got == {0: ("block", ["casino", "win"]), 1: ("allow", ["good", "cats"])}


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    got, model = uf.judge_urls(df)
    assert got.count() == 0 and model.prior == 0


def test_sql_on_odd_pages(spark, tmp_path):
    """The oracle agrees on nulls, repeats, ports, other alphabets and long runs too."""
    rows = [(*r[:2], r[2]) for r in pages(seed=9)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    df = uf.op11_url_filters(spark, str(tmp_path))
    cols = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    r = con.execute(uf.OP11_SQL)
    names = [c[0] for c in r.description]
    assert sorted((tuple(x[c] for c in cols) for x in df.collect()), key=str) == sorted((tuple(x[names.index(c)] for c in cols) for x in r.fetchall()), key=str)
