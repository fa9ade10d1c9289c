import re
import time
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timberline.llm.pii import FEMALE, MALE, Contexts, alphabet, canonical, find, iban_valid, keyed_id, learn_contexts, luhn, op5_pii, permute, pseudonymize, replace, resolve_collisions, surrogate, with_tweaks

K, SF = b"k" * 32, "/root/testdata/sf0.001"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 35, 257, 1000])
def test_permutation(size):
    assert sorted(permute(K, x, size) for x in range(size)) == list(range(size))


@pytest.mark.parametrize(
    ("text", "kind", "entity"),
    [("write éan.78@mail3.example.com.", "email", "éan.78@mail3.example.com"), ("at +1 (743) 555-3824 now", "phone", "+1 (743) 555-3824"), ("from 97.51.17.173. Then", "ip", "97.51.17.173"), ("card 4111111111111111### x", "card", "4111111111111111"), ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"), ("says Mrs. Anna Weber to", "person", "Mrs. Anna Weber"), ("with Paul Müller there", "person", "Paul Müller"), ("no 123-45-6789", "ssn", "123-45-6789"), ("pay DE89 3704 0044 0532 0130 00 now", "iban", "DE89 3704 0044 0532 0130 00"), ("my name is Priya Patel, hi", "person", "Priya Patel"), ("Dear José García!", "person", "José García")],
)
def test_kinds_and_formats(text, kind, entity):
    ((a, b, k),) = find(text)
    assert (k, text[a:b]) == (kind, entity)
    new, _ = replace(text, K)
    s = new[a : b + len(new) - len(text)]
    assert entity not in new and s != entity
    form = lambda x: re.sub(r"[^\W\d_]", "x", re.sub(r"\d+" if kind == "ip" else r"\d", "0", x))
    if kind not in ("person", "secret", "iban"):
        assert form(s) == form(entity)
    if kind == "card":
        assert luhn(s)
    if kind == "person":
        first = entity.split()[0]
        assert s.split()[0] == "Mrs." and s.split()[1] in FEMALE or (s.split()[0] in MALE) == (first in MALE) and s.istitle()
    if kind == "iban":
        assert iban_valid(s) and s[:2] == "DE" and [c == " " for c in s] == [c == " " for c in entity]


def test_clean_text_is_left_alone():
    for t in ["", "No names here, 1.5 or 12345; 999.1.1.1 and 2024-01-02", "a : b = c", "The Max. of 3"]:
        assert replace(t, K) == (t, [])


def test_coreference_and_script():
    t, e = replace("A@x.com, a@X.com, +1 743 555 3824 and +1 (743) 555-3824, Herr Иванов", K)
    low = [x[2].lower() for x in e]
    assert low[0] == low[1] and re.sub(r"\D", "", low[2]) == re.sub(r"\D", "", low[3])
    assert all("Ѐ" <= c <= "ӿ" for c in e[4][2].split()[1])
    assert alphabet("é") != alphabet("e") and "é" in alphabet("é")


@settings(max_examples=30)
@given(st.sets(st.integers(0, 10**4 - 1), min_size=2, max_size=60))
def test_distinctness(xs):
    assert len({surrogate(K, "ssn", f"000-00-{x:04d}") for x in xs}) == len(xs)
    assert len({surrogate(K, "ip", f"10.0.{x >> 8}.{x & 255}") for x in xs}) == len(xs)


def test_documents(spark, odd, none):
    rows = [(i, f"mail u{i % 50}@ex{i % 3}.org from 10.0.0.{i % 200} or Frau Eva Lang{'abcdefgh'[i % 8]}") for i in range(300)]
    out = pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "a key").collect()
    one_to_one(out)
    for r in out:
        assert len(r.entities) == 3 and not any(e.entity in r.text for e in r.entities)
    got = pseudonymize(odd, "a key", keep=("doc_id", "n")).collect()
    assert len(got) == odd.count() and sum(r.text is None for r in got) == sum(r.text is None for r in odd.collect())
    assert pseudonymize(none, "a key").count() == 0
    with pytest.raises(ValueError, match="key"):
        pseudonymize(none, "")


def one_to_one(rows):
    """Brute force over all pairs: one surrogate for each entity of the corpus, and none for two."""
    seen = {(e.kind, canonical(e.kind, e.entity), canonical(e.kind, e.surrogate)) for r in rows for e in r.entities}
    assert len({x[:2] for x in seen}) == len({(x[0], x[2]) for x in seen}) == len(seen) > 0
    return seen


def test_query_is_one_to_one_and_keeps_the_rest(spark):
    """Against the texts of the table: surrogates are one to one, and all between the entities stays."""
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pseudonymize(docs, "a key").collect()
    one_to_one(rows)
    assert len(rows) == len(text)
    for r in rows:
        back, at = [], 0
        for e in r.entities:
            i = r.text.index(e.surrogate, at)
            back += [r.text[at:i], e.entity]
            at = i + len(e.surrogate)
        assert "".join([*back, (r.text or "")[at:]]) == (text[r.doc_id] or "")
    other = {e.surrogate for r in pseudonymize(docs, "another key").collect() for e in r.entities}
    assert len(other & {e.surrogate for r in rows for e in r.entities}) < 0.05 * len(other)
    assert {r.n_entities for r in op5_pii(spark, SF).collect()} == {len(r.entities) for r in rows}


def test_collisions_over_the_corpus(spark):
    """Images that are far too few: tweaks spread them, the same for the whole corpus; where there is no room, an error."""
    e = spark.createDataFrame([("ssn", f"{x:03d}", f"{x:03d}") for x in range(40)], "kind string, entity string, spelled string")
    image = lambda kind, s, tweak: f"{(int(s) // 4 * 7 + tweak * 131 * (int(s) % 4 + 1)) % 997}"
    tweaks = {r.id: r.tweak for r in resolve_collisions(e, image, K).collect()}
    assert len({image("ssn", f"{x:03d}", tweaks.get(keyed_id(K, "ssn", f"{x:03d}"), 0)) for x in range(40)}) == 40 and len(tweaks) >= 30
    with pytest.raises(RuntimeError):
        resolve_collisions(e, lambda kind, s, tweak: "same", K, rounds=3)


def test_tweaks_reach_their_texts(spark):
    """Tweaks as a table: each text gets those of its own entities, in any spelling, and null texts none."""
    rows = [(1, "mail A@x.com or b@x.com"), (2, "a@X.com"), (3, None), (4, "none"), (5, "a@X.com")]
    d = spark.createDataFrame(rows, "doc_id long, _text string").withColumn("_rk", F.xxhash64("_text"))
    ids = {s: keyed_id(K, "email", s) for s in ("a@x.com", "b@x.com", "c@x.com")}
    tweaks = spark.createDataFrame([(ids["a@x.com"], 1), (ids["c@x.com"], 2)], "id string, tweak int")
    got = {r.doc_id: r._tweaks for r in with_tweaks(d, tweaks, K, Contexts()).collect()}
    assert got == {1: {ids["a@x.com"]: 1}, 2: {ids["a@x.com"]: 1}, 3: None, 4: None, 5: {ids["a@x.com"]: 1}}
    plain, tweaked = replace("a@X.com", K)[1], replace("a@X.com", K, tweaks=got[2])[1]
    assert tweaked[0][3] == 1 and tweaked[0][2] != plain[0][2]


def test_nothing_in_clear_in_the_shared_folder(spark):
    d = spark.createDataFrame([(i, f"mail zelda{i}@qqexample.org, Frau Eva Zzlang") for i in range(50)], "doc_id long, text string")
    assert pseudonymize(d, "a key").count() == 50
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    tables = [pq.read_table(f) for f in shared.rglob("timberline/surrogates*/*.parquet")]
    assert sum(t.num_rows for t in tables) >= 51
    assert not any(w in str(t.to_pylist()).lower() for t in tables for w in ("zelda", "qqexample", "zzlang", "@"))


NAMES = [
    "Mrs Anna Maria Weber", "Anna Müller-Schmidt", "Mr O'Brien", "Dr. J. Smith", "ANNA WEBER", "Alice Smith", "Dr ALICE SMITH", "Ms Ludwig van der Berg", "Prof. Dr. Anna-Maria d'Angelo",
    "John F. Kennedy", "John F Kennedy", "MRS ANNA MARIA WEBER", "Anna Le", "Anna Li", "DR. J. SMITH", "Mr Peter\tJones", "ANNA O’BRIEN", "Frau Анна Иванова Петрова", "Karl von Weber", "Karl Weber",
]


@pytest.mark.parametrize("name", NAMES)
def test_whole_names_go(name):
    for text in (f"says {name} to", f"met {name}, who", f"{name}'s book", name):
        new, entities = replace(text, K)
        assert [e[1] for e in entities] == [name]
        own = [w for w in re.findall(r"[^\W\d_]{3,}", name) if w.lower() not in ("mrs", "prof", "frau", "van", "der", "von")]
        assert not any(re.search(rf"(?<!\w){w}(?!\w)", new) for w in own)
        s = entities[0][2]
        assert re.sub(r"[^\W\d_]+", "x", s) == re.sub(r"[^\W\d_]+", "x", name) and s.isupper() == name.isupper()


def test_names_are_one_to_one_over_spellings():
    """Brute force: spellings of a name share their image, and no two names do."""
    names = NAMES + [f"{t}{g} {f}" for t in ("", "Dr ", "DR. ") for g in ("Anna", "ANNA", "Paul", "Priya") for f in ("Li", "Le", "LE", "Dr Li", "de Li", "Martin", "Weber")]
    seen = {}
    for n in names:
        seen.setdefault(canonical("person", n), set()).add(canonical("person", surrogate(K, "person", n)))
    assert all(len(x) == 1 for x in seen.values())
    assert len({min(x) for x in seen.values()}) == len(seen)
    assert len({surrogate(K, "person", f"Anna {a}{b}").lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "abcdefghijklmnopqrstuvwxyz"}) == 676
    for names in (FEMALE, MALE):
        images = [surrogate(K, "person", f"{n} Weber").split()[0] for n in names]
        assert sorted(images) == sorted(names) and not any(a == b for a, b in zip(names, images, strict=True))


def test_overlapping_finds_are_one_name():
    assert [t for t in (replace("name is Jean Paul Müller, hi", K)[1])][0][1] == "Jean Paul Müller"
    assert [e[1] for e in replace("Frau Анна Иванова пошла домой", K)[1]] == ["Frau Анна Иванова"]
    assert [e[1] for e in replace("we saw ANNA WEBER THERE", K)[1]] == ["ANNA WEBER"]
    assert replace("MAX VALUE and MISS OUT", K)[1] == []


def test_names_from_their_context(spark):
    """Names that no list holds are found where known ones stand, and pairs elsewhere are left alone."""
    rows = [(i, f"we met {n} yesterday near New Hall and so on") for i, n in enumerate(["Anna Weber", "Paul Klein", "Emma Stone", "Karl Lang", "Nina Wolf", "Hugo Kurz", "Priya Patel"])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    c = learn_contexts(d)
    assert c == Contexts(frozenset({"met"}), frozenset({"yesterday"}))
    got = {r.doc_id: [e.entity for e in r.entities] for r in pseudonymize(d, "k").collect()}
    assert got[6] == ["Priya Patel"] and all(len(x) == 1 for x in got.values())


def test_ipv6_in_any_spelling():
    t, e = replace("from 2001:db8::1 or 2001:0DB8:0:0:0:0:0:1, not 12:30:45, std::vector or a::b", K)
    assert [x[0] for x in e] == ["ipv6", "ipv6"] and e[0][2] == e[1][2] != "2001:db8::1"
    assert t.endswith("not 12:30:45, std::vector or a::b")


def test_many_entities_in_one_text():
    text = " ".join(f"u{i}@example.org 10.{i >> 8}.{i & 255}.7" for i in range(16_000))
    began = time.process_time()
    assert len(find(text)) == 32_000
    assert time.process_time() - began < 5
    assert find("x" * 300 + "@example.org") == [(0, 312, "email")]


HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


@pytest.mark.parametrize("secret", [HEX.upper(), HEX[:20].upper() + HEX[20:], HEX[:32].upper()])
def test_bare_secret_in_any_case(secret):
    """No '=' or ':' in the text, and no 32 lower-case digits in a row."""
    new, ((kind, entity, s, _),) = replace(f"uses {secret} since", K)
    assert (kind, entity) == ("secret", secret) and secret not in new
    assert [(c.isdigit(), c.isupper()) for c in s] == [(c.isdigit(), c.isupper()) for c in secret]
    assert re.fullmatch("[0-9a-fA-F]+", s)


@pytest.mark.parametrize("n", [129, 256, 1024, 1025, 5000, 100_000])
@pytest.mark.parametrize("case", [str.lower, str.upper])
def test_secret_of_any_length(n, case):
    secret = case((HEX * (n // len(HEX) + 1))[:n])
    new, ((kind, entity, s, _),) = replace(f"uses {secret} since", K)
    assert (kind, entity) == ("secret", secret) and new == f"uses {s} since"
    assert len(s) == n and s != secret and s == case(s) and re.fullmatch("[0-9a-fA-F]+", s)
    other = secret[:-1] + case("e" if secret[-1] in "fF" else "f") if secret[-1].isalpha() else secret[:-1] + str((int(secret[-1]) + 1) % 10)
    assert surrogate(K, "secret", other) != surrogate(K, "secret", secret)


def test_assigned_secret_of_any_length():
    value = "Zq9" * 4000
    new, ((kind, entity, s, _),) = replace(f"token={value} end", K)
    assert (kind, entity) == ("secret", value) and new == f"token={s} end" and len(s) == len(value)


def test_long_strings_are_permuted(monkeypatch):
    """Piece by piece too, all strings of a format have distinct images."""
    monkeypatch.setattr("timberline.llm.pii.PIECE", 2)
    assert len({surrogate(K, "ssn", f"{x:04d}") for x in range(10_000)}) == 10_000
