"""Surrogates for personal data: keyed, type-consistent, reversible only with the key.

Detected: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, IBANs with right check digits, card-like numbers of
13 to 19 digits, social security numbers, secrets (long hex strings, values of token/password/key assignments) and
persons: after a title, from a known given name, after words that announce a name, and wherever a run of capitalised
words stands in a context that :func:`learn_contexts` found to be one of names. It counts, over the whole corpus, the
words before and after all such runs inside sentences; contexts in which enough documents have known names, and in which
these are at least half of the runs, tell unknown names too. A name has any number of words, with hyphens, apostrophes,
initials and particles. In a text of capitals, where nothing tells the end, it ends with the first word that is no given
name, initial or particle.

A surrogate is the entity's image under a keyed permutation of all strings of its format: digits stay digits, hex stays
hex, letters stay in their script and case, punctuation stays, and the format is bound into the key. So distinct entities
get distinct surrogates by construction. Luhn-valid numbers stay valid and others invalid, IBANs keep their country and
get right check digits, octets stay in 0-255, given names go to another name of the same gender, titles, particles
inside a name, country codes, top-level domains and the words that announce a secret stay. What two spellings share
(letters without case, digits without punctuation, names without titles and dots) decides, so coreference survives over
the corpus.

Collision check: :func:`resolve_collisions` groups the images of all entities of the corpus. Should two share one, all but
the first are made anew under the next tweak of the key, until no two do; every document then uses the same tweaks. What
it writes to the shared folder are keyed hashes of entities and images, which say nothing without the key.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import documents, staged

#: Where the query takes its key from; without one a new key is drawn for each run, and no surrogate can be undone.
KEY_SETTING = "spark.timberline.surrogate.key"
ROUNDS = 8
#: Characters that are permuted as one number; the cost grows with the square of their number.
PIECE = 1024
#: Characters of the texts whose surrogates are made at once.
CHARS = 4_000_000
FEMALE = "Alice Anna Barbara Carla Clara Diana Elena Emma Eva Fiona Greta Hanna Helen Ingrid Irene Julia Karen Laura Linda Lucia Maria Marie Martha Monica Nina Nora Olivia Paula Rosa Sarah Sofia Susan Teresa Ursula Vera".split()
MALE = "Adam Albert Anton Bruno Carlos Daniel David Erik Felix Frank Georg Hans Henry Hugo Ivan Jack James John Jorge Karl Leo Louis Marco Martin Max Michael Oscar Paul Peter Pierre Robert Simon Thomas Victor Walter".split()
HER, HIS = "Mrs Ms Miss Frau Madame Mme Señora Sra".split(), "Mr Herr Monsieur Señor Sr".split()
PARTICLES = "van von der den de del della di da dos das du la le zu zur zum ter ten bin ibn al el af av".split()


def _letters_of(*kinds: str) -> str:
    """A character class of the letters of these Unicode categories."""
    out: list[list[int]] = []
    for x in range(0x10000):
        if unicodedata.category(chr(x)) in kinds:
            if out and out[-1][1] == x - 1:
                out[-1][1] = x
            else:
                out.append([x, x])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


LETTER, UPPER = r"[^\W\d_]", f"[{_letters_of('Lu', 'Lt')}]"
NOT_LOWER = rf"(?![{_letters_of('Ll')}]){LETTER}"
SPACE = r"[ \t\u00a0]+"


def _word(first: str) -> str:
    """A word of two letters or more that begins so, parts after hyphens and apostrophes included; no possessive s."""
    return rf"(?:(?:[dl]|dell|dall)['’](?={UPPER}))?(?={LETTER}['’-]?{LETTER}){first}{LETTER}*(?:['’](?!S(?!\w)){UPPER}{LETTER}*|-{LETTER}+)*"


#: Words that may be names; beyond the second, scripts without capitals are not followed. I and A alone are no initials.
WORD, NEXT = _word(NOT_LOWER), _word(UPPER)
INITIAL = rf"(?:(?:{UPPER}\.(?:-?{UPPER}\.)*)|(?![AI]){UPPER}(?![\w'’-]))"
PARTICLE = rf"(?:(?:{'|'.join(sorted(PARTICLES, key=len, reverse=True))}){SPACE})"
MORE = rf"(?:{SPACE}{PARTICLE}*(?:{NEXT}|{INITIAL}))"
NAME = rf"(?:(?:{INITIAL}{SPACE})+{PARTICLE}*{WORD}|{WORD}(?:{MORE}|{SPACE}{WORD})){MORE}*"
CAPITALS = rf"{UPPER}{{2,}}(?:['’-]{UPPER}{{2,}})*|{UPPER}['’]{UPPER}{{2,}}"
EMAIL_END = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
#: Lengths of country calling codes; those not listed have three digits.
CALLING = {"1": 1, "7": 1, **dict.fromkeys("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split(), 2)}
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
IPV6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:.]*\d)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?:\.\d{1,3}){0,3}(?![\w:])")
NUMBERS = [
    ("ip", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])")),
    ("card", re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])")),
]
SECRETS = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|key)[ \t]*[=:][ \t]*[\"']?([^\s\"'&|<>]{6,})|(?<![0-9A-Za-z])([0-9a-f]{32,})(?![0-9A-Za-z])")
TITLES = (*HER, *HIS, "Dr", "Prof")
LOW_TITLES = frozenset(t.lower() for t in TITLES)
GIVEN = {n.lower(): names for names in (FEMALE, MALE) for n in names}
#: Words that mean something else where all is in capitals.
AMBIGUOUS = {"MAX", "MS", "SR", "SRA", "MISS"}
TITLE, GIVEN_NAME = "|".join(TITLES), "|".join([*FEMALE, *MALE])
CAPITAL_TITLE, CAPITAL_GIVEN = ("|".join(w for x in names if (w := x.upper()) not in AMBIGUOUS) for names in (TITLES, [*FEMALE, *MALE]))
IN_CAPITALS = rf"(?:(?:{CAPITAL_GIVEN}){SPACE})*(?:{INITIAL}{SPACE})*(?:(?:{PARTICLE}|{PARTICLE.upper().replace(SPACE.upper(), SPACE)}))*(?:{CAPITALS})"
PERSON = re.compile(
    rf"(?=[A-Z])(?<!\w)(?:(?:(?:{TITLE})\.?{SPACE})+(?:{INITIAL}{SPACE})*{PARTICLE}*{WORD}(?:{MORE}|{SPACE}{WORD})?{MORE}*"
    rf"|(?:{GIVEN_NAME})(?:-{NEXT})?(?:{MORE}+|{SPACE}{WORD})"
    rf"|(?:(?:{CAPITAL_TITLE})\.?{SPACE})+{IN_CAPITALS}|(?:{CAPITAL_GIVEN})(?:-{UPPER}+)?{SPACE}{IN_CAPITALS})(?!\w)"
)
LIKELY = re.compile(rf"(?=[A-Z])(?<!\w)(?:{TITLE}|{GIVEN_NAME}|{CAPITAL_TITLE}|{CAPITAL_GIVEN})(?!\w)")
ANNOUNCED = re.compile(rf"(?<!\w)(?:[Nn]ame is|[Nn]ame:|[Dd]ear|[Ss]igned(?: by)?|[Ss]incerely,|[Rr]egards,)\s+({NAME})(?!\w)")
ANNOUNCER = re.compile("ame is|ame:|ear |igned|incerely,|egards,")
RUN = re.compile(rf"(?<=[\w,:;] ){NAME}(?!\w)")
BEFORE, AFTER = re.compile(r"(\S{1,40}) $"), re.compile(r" (\S{1,40})")


@dataclass(frozen=True)
class Contexts:
    """Words before and after which a run of capitalised words is a name."""

    before: frozenset[str] = frozenset()
    after: frozenset[str] = frozenset()


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _email_start(text: str, at: int, floor: int) -> int:
    """Where the local part of an address begins that ends before the sign at ``at``."""
    i = at
    while i > floor and (text[i - 1].isalnum() or text[i - 1] in "_.%+-"):
        i -= 1
    return i


def iban_valid(s: str) -> bool:
    bare = s.replace(" ", "")
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _ipv6(s: str) -> int | None:
    try:
        x = int(ipaddress.IPv6Address(s))
    except ValueError:
        return None
    return x if x > 1 else None


def _around(text: str, a: int, b: int) -> tuple[str | None, str | None]:
    """The words before and after a run inside a sentence, in lower case; none at the end of another sentence."""
    before, after = BEFORE.search(text, max(0, a - 42), a), AFTER.match(text, b)
    word = before[1] if before and before[1][-1] not in ".!?" and not before[1][0].isupper() else None
    return word and word.lower(), after and after[1].lower()


def find(text: str, contexts: Contexts = Contexts()) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order, without overlap; of two that overlap the earlier kind wins.

    Persons that overlap are one.
    """
    out, persons = [], []
    if "@" in text:
        last = 0
        for m in EMAIL_END.finditer(text):
            if (a := _email_start(text, m.start(), last)) < m.start():
                out.append((a, m.end(), "email"))
            last = m.end()
    if "=" in text or ":" in text or re.search(r"[0-9a-fA-F]{32}", text):
        out += [(*m.span(1 if m[1] else 2), "secret") for m in SECRETS.finditer(text)]
    if re.search(r"[A-Z]{2}\d\d", text):
        out += [(*m.span(), "iban") for m in IBAN.finditer(text) if iban_valid(m[0])]
    if ":" in text and re.search(r"[0-9A-Fa-f:]:[0-9A-Fa-f:]", text):
        out += [(*m.span(), "ipv6") for m in IPV6.finditer(text) if _ipv6(m[0]) is not None]
    if re.search(r"\d[\d .()-]{5}", text):
        for kind, pattern in NUMBERS:
            out += [(*m.span(), kind) for m in pattern.finditer(text) if kind != "ip" or all(int(x) < 256 for x in m[0].split("."))]
    if LIKELY.search(text):
        persons += [m.span() for m in PERSON.finditer(text)]
    if ANNOUNCER.search(text):
        persons += [m.span(1) for m in ANNOUNCED.finditer(text)]
    if contexts.before or contexts.after:
        for m in RUN.finditer(text):
            before, after = _around(text, *m.span())
            if before in contexts.before or before and after in contexts.after:
                persons.append(m.span())
    end = -1
    for a, b in sorted(persons):
        if a < end:
            out[-1] = (out[-1][0], max(b, end), "person")
        else:
            out.append((a, b, "person"))
        end = out[-1][1]
    kept: list[tuple[int, int, str]] = []
    for a, b, kind in out:
        i = bisect_left(kept, (a, b, ""))
        if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or kept[i][0] >= b):
            kept.insert(i, (a, b, kind))
    return kept


def _round(key: bytes, n: int, x: int, bits: int) -> int:
    size = -(-bits // 8)
    out, block = b"", 0
    while len(out) < size:
        out += hashlib.blake2b(b"%d %d %d" % (n, block, x), key=key, digest_size=min(64, size)).digest()
        block += 1
    return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)


def permute(key: bytes, x: int, size: int) -> int:
    """A keyed permutation of range(size): a Feistel network on the next even number of bits, walked back into range."""
    if size < 2:
        return x
    half = max((size - 1).bit_length() + 1, 2) // 2
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for n in range(ROUNDS):
            a, b = b, a ^ _round(key, n, b, half)
        x = a << half | b
        if x < size:
            return x


@lru_cache(maxsize=4096)
def alphabet(c: str) -> str:
    """The lower-case letters of a letter's own script; other characters stand for themselves."""
    if c.isdigit() and c.isascii():
        return "0123456789"
    if "a" <= c <= "z":
        return "abcdefghijklmnopqrstuvwxyz"
    if not c.isalpha():
        return c
    script = unicodedata.name(c, "?").split()[0]
    start = ord(c) & ~0xFF
    same = [chr(x) for x in range(start, start + 256) if chr(x).isalpha() and unicodedata.name(chr(x), "").split()[:1] == [script] and chr(x).lower() == chr(x) and len(chr(x).upper()) == 1 and chr(x).upper().lower() == chr(x) and not chr(x).isascii()]
    return "".join(same) if c in same else c


def _image(key: bytes, kind: str, s: str, alphabets: list[str]) -> str:
    """The image of ``s`` among all strings with these alphabets; the key is bound to the kind and the format.

    Longer strings go piece by piece, each under a key bound to all that stands before it, which is a permutation too.
    """
    if len(s) > PIECE:
        before = hashlib.blake2b("|".join([kind, *alphabets]).encode(), key=key, digest_size=32)
        out = []
        for at in range(0, len(s), PIECE):
            out.append(_image(before.digest(), kind, s[at : at + PIECE], alphabets[at : at + PIECE]))
            before.update(s[at : at + PIECE].encode())
        return "".join(out)
    size = x = 1
    x = 0
    for c, a in zip(s, alphabets, strict=True):
        x, size = x * len(a) + a.index(c), size * len(a)
    own = hashlib.blake2b("|".join([kind, *alphabets]).encode(), key=key, digest_size=32).digest()
    x = permute(own, x, size)
    out = []
    for a in reversed(alphabets):
        x, k = divmod(x, len(a))
        out.append(a[k])
    return "".join(reversed(out))


def _cased(like: str, s: str) -> str:
    return "".join(c.upper() if k.isupper() and len(c.upper()) == 1 else c for k, c in zip(like, s, strict=True))


def _letters(key: bytes, kind: str, s: str) -> str:
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
    return _cased(s, _image(key, kind, low, [alphabet(c) for c in low]))


def _digits(key: bytes, kind: str, s: str, fixed: int = 0, valid=None) -> str:
    """Digits permuted within the class that ``valid`` tells, the first ``fixed`` ones and all punctuation kept."""
    d = [c for c in s if c.isdigit()]
    head, tail = d[:fixed], "".join(d[fixed:])
    want = valid and valid("".join(d))
    while True:
        tail = _image(key, kind + "".join(head), tail, ["0123456789"] * len(tail))
        if not valid or valid("".join(head) + tail) == want:
            break
    new = iter([*head, *tail])
    return "".join(next(new) if c.isdigit() else c for c in s)


def _name(key: bytes, s: str) -> str:
    """Titles and particles stay; a known given name goes to one of its gender, other words to letters of their script.

    Each word follows from its lower-case form, and the case is laid over it. A last word is no particle. Words other
    than given names have no given name, title or (before the end) particle as image, so that no two names meet.
    """
    atoms = list(re.finditer(rf"{LETTER}+", s))
    own = [m for m in atoms if not _is_title(m[0])]

    def image(m: re.Match) -> str:
        w, low = m[0], m[0].lower()
        if _is_title(w) or m is not own[-1] and low in PARTICLES:
            return w
        if low in GIVEN:
            new = _cycle(key, tuple(GIVEN[low]))[low]
            return new.upper() if w.isupper() else new if w[0].isupper() else new.lower()
        new = _letters(key, "name", w)
        while new.lower() in GIVEN or _is_title(new) or m is not own[-1] and new.lower() in PARTICLES:
            new = _letters(key, "name", new)
        return new

    out, at = [], 0
    for m in atoms:
        out += [s[at : m.start()], image(m) if own else m[0]]
        at = m.end()
    return "".join([*out, s[at:]])


@lru_cache(maxsize=256)
def _cycle(key: bytes, names: tuple[str, ...]) -> dict[str, str]:
    """Each name's successor in a keyed order, so that none is its own image."""
    order = sorted(names, key=lambda n: permute(key, names.index(n), len(names)))
    return {a.lower(): b for a, b in zip(order, [*order[1:], order[0]], strict=True)}


def _is_title(w: str) -> bool:
    return w.lower() in LOW_TITLES


def _iban(key: bytes, s: str) -> str:
    """Country and layout stay, letters stay letters, and the check digits are made right."""
    bare = s.replace(" ", "")
    country, rest = bare[:2], bare[4:]
    new = _image(key, "iban" + country, rest, ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in rest])
    check = 98 - int("".join(str(int(c, 36)) for c in f"{new}{country}00")) % 97
    made = iter(f"{country}{check:02d}{new}")
    return "".join(c if c == " " else next(made) for c in s)


def surrogate(key: bytes, kind: str, s: str) -> str:
    if kind == "email":
        local, _, domain = s.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{_letters(key, 'email', local)}@{_letters(key, 'host', host)}.{top}"
    if kind == "ip":
        x = permute(key, int.from_bytes(bytes(map(int, s.split("."))), "big"), 2**32)
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "card":
        return _digits(key, kind, s, 0, luhn)
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(permute(key, _ipv6(s) - 2, 2**128 - 2) + 2))
    if kind == "iban":
        return _iban(key, s)
    if kind == "phone":
        d = re.sub(r"\D", "", s)
        return _digits(key, kind, s, 0 if s[0] != "+" else CALLING.get(d[0]) or CALLING.get(d[:2], 3))
    if kind == "ssn":
        return _digits(key, kind, s)
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+", s):
        return _image(key, "hex", s, ["0123456789abcdef"] * len(s))
    if kind == "secret" and re.fullmatch(r"[0-9a-fA-F]{32,}", s):  # digits and letters keep their places, letters their case
        return _image(key, "hex", s, ["0123456789" if c.isdigit() else "abcdef" if c.islower() else "ABCDEF" for c in s])
    return _name(key, s) if kind == "person" else _letters(key, kind, s)


def canonical(kind: str, s: str) -> str:
    """What all spellings of an entity share."""
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(s))
    if kind in ("phone", "card", "ssn", "iban"):
        return "".join(c for c in s if c.isalnum() or c == "+")
    if kind == "person":
        return " ".join(w for w in s.replace(".", " ").replace("’", "'").split() if not _is_title(w)).lower()
    return s.lower() if kind == "email" else s


def replace(text: str, key: bytes, contexts: Contexts = Contexts(), tweaks: dict[str, int] | None = None) -> tuple[str, list[tuple[str, str, str, int]]]:
    """The text with surrogates, and (kind, entity, surrogate, tweak) of each entity in order of appearance.

    ``tweaks`` has those of entities by :func:`keyed_id`.
    """
    out, entities, at = [], [], 0
    for a, b, kind in find(text, contexts):
        s = text[a:b]
        tweak = tweaks.get(keyed_id(key, kind, canonical(kind, s)), 0) if tweaks else 0
        new = surrogate(_key(key, tweak), kind, s)
        out += [text[at:a], new]
        entities.append((kind, s, new, tweak))
        at = b
    return "".join([*out, text[at:]]), entities


@lru_cache(maxsize=64)
def _key(key: bytes, tweak: int) -> bytes:
    return hashlib.blake2b(b"%d" % tweak, key=key, digest_size=32).digest()


def _contexts_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(side, word, known, pairs): in how many documents of a batch a word stands beside a known name, and beside any pair."""
    for b in batches:
        known, pairs = Counter(), Counter()
        for t in b.column(0).to_pylist():
            names, others = set(), set()
            for m in RUN.finditer(t or ""):
                own = names if PERSON.match(m[0]) else others
                own.update((k, w) for k, w in enumerate(_around(t, *m.span())) if w)
            known.update(names)
            pairs.update(names | others)
        rows = [(k, w, known[k, w], n) for (k, w), n in pairs.items()]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["side", "word", "known", "pairs"])


def learn_contexts(docs: DataFrame, text: str = "text", min_docs: int = 5, share: float = 0.5) -> Contexts:
    """The words beside which at least ``min_docs`` documents have a known name, and which have no more other pairs.

    All documents count. The words are few, as each is beside names in half of its uses; the driver and all tasks hold them.
    """
    n = docs.select(text).mapInArrow(_contexts_in, "side int, word string, known bigint, pairs bigint")
    n = n.groupBy("side", "word").agg(F.sum("known").alias("known"), F.sum("pairs").alias("pairs"))
    rows = n.where((F.col("known") >= min_docs) & (F.col("known") >= share * F.col("pairs"))).select("side", "word").collect()
    return Contexts(*(frozenset(r["word"] for r in rows if r["side"] == k) for k in (0, 1)))


def _entities_in(batches: Iterator[pa.RecordBatch], contexts: Contexts) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = {}
        for t in b.column(0).to_pylist():
            for a, e, kind in find(t or "", contexts):
                s = t[a:e]
                found.setdefault((kind, canonical(kind, s)), s)
        cols = list(zip(*((k, c, s) for (k, c), s in found.items()), strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["kind", "entity", "spelled"])


def corpus_entities(docs: DataFrame, text: str = "text", contexts: Contexts = Contexts()) -> DataFrame:
    """(kind, entity, spelled): every distinct entity of the corpus, with one of its spellings."""
    found = docs.select(text).mapInArrow(partial(_entities_in, contexts=contexts), "kind string, entity string, spelled string")
    return found.groupBy("kind", "entity").agg(F.min("spelled").alias("spelled"))


def keyed_id(key: bytes, kind: str, s: str) -> str:
    """Stands for an entity or an image in tables; says nothing without the key."""
    return hashlib.blake2b(f"{kind} {s}".encode("utf-8", "replace"), key=key, digest_size=16).hexdigest()


def resolve_collisions(entities: DataFrame, image: Callable[[str, str, int], str], key: bytes, rounds: int = 20) -> DataFrame:
    """(id, tweak) of the entities whose ``image`` (kind, spelling, tweak) under tweak 0 another one has.

    Of those that share an image the first by id keeps it. No image stays shared: where ``rounds`` tweaks leave some, as
    where there are more entities than images, an error is raised. Entities and images are written as keyed hashes alone;
    a further round finds the entities again.
    """
    macs = F.pandas_udf(lambda k, s: pd.Series([keyed_id(key, *x) for x in zip(k, s, strict=True)], dtype=object), "string")
    made = F.pandas_udf(lambda k, s, t: pd.Series([keyed_id(key, kind, image(kind, x, tweak)) for kind, x, tweak in zip(k, s, t, strict=True)], dtype=object), "string")
    named = entities.withColumn("id", macs("kind", "entity"))
    e = staged(named.withColumn("tweak", F.lit(0)).select("id", "tweak", made("kind", "spelled", "tweak").alias("image")), "surrogates")
    for _ in range(rounds):
        shared = e.groupBy("image").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").drop("n")
        again = staged(e.join(shared, "image").where("id <> first").select("id", (F.col("tweak") + 1).alias("tweak")), "surrogates-shared")
        if not again.head(1):
            return e.where("tweak > 0").select("id", "tweak")
        moved = named.join(again, "id").select("id", "tweak", made("kind", "spelled", "tweak").alias("image"))
        e = staged(e.join(again.select("id"), "id", "left_anti").unionByName(moved), "surrogates")
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


def _ids_in(batches: Iterator[pa.RecordBatch], key: bytes, contexts: Contexts) -> Iterator[pa.RecordBatch]:
    """(rk, id) of the entities of each text."""
    for b in batches:
        rows = {(rk, keyed_id(key, kind, canonical(kind, t[a:e]))) for rk, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for a, e, kind in find(t or "", contexts)}
        rk, ids = zip(*rows, strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(rk, pa.int64()), pa.array(ids, pa.string())], ["rk", "id"])


def with_tweaks(d: DataFrame, tweaks: DataFrame, key: bytes, contexts: Contexts) -> DataFrame:
    """``d`` (_rk, _text and more) with ``_tweaks``, a map from the keyed hashes of a text's entities to their tweaks."""
    found = d.select("_rk", "_text").mapInArrow(partial(_ids_in, key=key, contexts=contexts), "rk bigint, id string").distinct()
    own = found.join(tweaks, "id").groupBy("rk").agg(F.map_from_entries(F.collect_list(F.struct("id", "tweak"))).alias("_tweaks"))
    return d.join(own.withColumnRenamed("rk", "_rk"), "_rk", "left")


def _run(batches: Iterator[pa.RecordBatch], key: bytes, contexts: Contexts, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string()), ("surrogate", pa.string()), ("tweak", pa.int32())]))
    for b in batches:
        tweaks = b.column("_tweaks").to_pylist() if "_tweaks" in b.schema.names else [None] * b.num_rows
        at, texts = 0, b.column("_text").to_pylist()
        while at < len(texts) or not texts:  # what is made at once is bounded in characters
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= CHARS):
                chars += len(texts[end] or "")
                end += 1
            made = [(None, []) if t is None else replace(t, key, contexts, w and dict(w)) for t, w in zip(texts[at:end], tweaks[at:end], strict=True)]
            entities = [[dict(zip(("kind", "entity", "surrogate", "tweak"), e, strict=True)) for e in x] for _, x in made]
            rest = [b.column(f"_keep{i}").slice(at, end - at) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([t for t, _ in made], pa.string()), pa.array(entities, kind)], [*names, "text", "entities"])
            at = end
            if not texts:
                break


def secret_key(key: str) -> bytes:
    if not key:
        raise ValueError("surrogates need a secret key")
    return hashlib.blake2b(key.encode(), digest_size=32).digest()


def pseudonymize(docs: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, text with surrogates, and the list of entities (kind, entity, surrogate, tweak).

    Null text stays null and has no entities. Repeated rows get equal results; other columns are ignored; an empty
    table gives an empty result. The same key gives the same surrogates. Keep the key and the entities as secret
    as the original texts; the tables in the shared folder hold keyed hashes.
    """
    made = secret_key(key)
    contexts = learn_contexts(docs, text)
    tweaks = resolve_collisions(corpus_entities(docs, text, contexts), lambda kind, s, tweak: canonical(kind, surrogate(_key(made, tweak), kind, s)), made)
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    d = docs.select(*(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)), F.col(text).alias("_text"))
    if tweaks.head(1):
        d = with_tweaks(d.withColumn("_rk", F.xxhash64("_text")), tweaks, made, contexts).drop("_rk")
    fields = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return d.mapInArrow(partial(_run, key=made, contexts=contexts, names=tuple(keep)), f"{fields}, text string, entities array<struct<kind:string,entity:string,surrogate:string,tweak:int>>")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymize(documents(spark, sf_dir), spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32))
    kinds = F.array_sort(F.transform("entities", lambda x: x["kind"]))
    left = F.exists("entities", lambda x: F.contains(F.col("text"), x["entity"]))
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), kinds.alias("kinds"), F.coalesce(left, F.lit(False)).alias("entity_left"))
