"""SentencePiece encoding with sampled segmentations, and exact decoding.

All segmentations of a text into pieces are paths through a lattice. A piece of rank r has the Zipf probability
1 / ((r + 3) log(V / 3)), raised to ``alpha``; a character without a piece is spelled in byte pieces. Distinct
segmentations are drawn without replacement by Gumbel top-k: each path's log-probability is perturbed by a Gumbel
variable and the k largest are kept. The variables are made top-down, so the search is A* with an exact bound: a set of
paths that share the segmentations of their first units carries the largest perturbed value within it; taking the best
set, its best path follows by drawing each unit from the conditional distribution, and what it leaves beside each unit
(the same before, other segmentations of this one) are new sets, with values drawn below its own. The (k+1)-th value is
the threshold of the inclusion scores.

Pieces hold spaces only at their start, so the lattice falls into units (spaces and the word after them). A worker keeps
the lattices of the units it has met, up to ``MAX_STATES`` states (beyond, of those met most often), and draws the units
of all texts of a batch at once. Most draws give a unit's first path, of the likeliest steps; its ids and probability are
kept, and only units that leave it are walked step by step.
Every random number is a hash of the row's key, the sample, the unit and the step, and sums are taken by unit and by text,
so results do not depend on how rows are dealt out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import documents

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNIT = re.compile(r" *[^ \n]+| +|\n")
#: States of the lattices that a worker keeps; characters of a batch, few enough that its arrays stay in the CPU's caches.
MAX_STATES = 1_000_000
BATCH_CHARS = 300_000
#: A step's value cannot exceed its log-mass by more, as -log(E) is under 37 for 53-bit uniforms.
REACH, FLOOR = 38.0, -50.0
SAMPLES = "samples array<struct<value:double,log_prob:double,log_inclusion:double,ids:array<int>>>"
_GOLD, _A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, "i8")
        self.raw: list[bytes] = [b""] * n
        known: dict[str, int] = {}
        self.log_prob = np.full(n, -np.log(n * np.log(n / 3)))
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.raw[i] = bytes([int(p[3:5], 16)])
            elif not sp.is_control(i) and not sp.is_unknown(i):
                s = p.replace("▁", " ")
                self.raw[i] = s.encode()
                if sp.get_score(i) > -1e8:
                    self.log_prob[i] = -np.log((-sp.get_score(i) + 3) * np.log(n / 3))
                if " " in s.lstrip(" ") or "\n" in s:
                    raise ValueError(f"piece {i} crosses the bounds of units")
                known[s] = i
        self.longest = max(map(len, known))
        self.size = np.array([len(x) for x in self.raw], "i8")
        width = -(-int(self.size.max()) // 8)
        padded = np.frombuffer(b"".join(x.ljust(8 * width, b"\0") for x in self.raw), "<u8").reshape(n, width)
        ones = np.frombuffer(b"".join((b"\xff" * len(x)).ljust(8 * width, b"\0") for x in self.raw), "<u8").reshape(n, width)
        #: The pieces' bytes as words of eight, and which of their bits count.
        self.words, self.masks = np.ascontiguousarray(padded.T), np.ascontiguousarray(ones.T)
        for s in list(known):
            for k in range(1, len(s)):
                known.setdefault(s[:k], -1)
        self._table(known)

    def _table(self, known: dict[str, int], bits: int = 21) -> None:
        """Open addressing over the hashes of all pieces and their prefixes (id -1: a prefix only)."""
        by_size: dict[int, list[str]] = {}
        for s in known:
            by_size.setdefault(len(s), []).append(s)
        keys, ids = [], []
        for k, group in by_size.items():
            points = _mix(_code_points("".join(group)).reshape(-1, k) + _GOLD)
            h = np.zeros(len(group), "u8")
            for c in range(k):
                h = h * _C + points[:, c]
            keys.append(h)
            ids += [known[s] for s in group]
        self.keys, self.ids = np.concatenate(keys), np.array(ids, "i4")
        self.shift, self.slots, self.probes = np.uint64(64 - bits), np.full(2**bits, -1, "i4"), 1
        for j, at in enumerate(_mix(self.keys) >> self.shift):
            n, at = 1, int(at)
            while self.slots[at] >= 0:
                n, at = n + 1, (at + 1) & (2**bits - 1)
            self.slots[at], self.probes = j, max(self.probes, n)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Table entries of hashes, -1 where unknown."""
        at = (_mix(h) >> self.shift).astype("i8")
        out = self.slots[at]
        odd = np.flatnonzero((out >= 0) & (self.keys[out] != h))
        for n in range(1, self.probes + 1):
            if not len(odd):
                break
            nxt = self.slots[(at[odd] + n) & (len(self.slots) - 1)] if n < self.probes else np.full(len(odd), -1, "i4")
            out[odd] = nxt
            odd = odd[(nxt >= 0) & (self.keys[nxt] != h[odd])]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "u4").astype("u8")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _uniform(key: np.ndarray, *parts) -> np.ndarray:
    """Uniform numbers in (0, 1) that are a function of their keys."""
    x = key
    for p in parts:
        x = _mix(x + np.atleast_1d(p).astype("u8") * _C + _GOLD)
    return ((x >> np.uint64(11)).astype("f8") + 0.5) * 2.0**-53


class Numbers:
    """Numbers of units, in order of their coming, by two hashes of 64 bits each (open addressing)."""

    def __init__(self):
        self.keys, self.n = np.zeros((2, 0), "u8"), 0
        self._deal(16)

    def __len__(self) -> int:
        return self.n

    def __contains__(self, unit: str) -> bool:
        points = _code_points(unit)
        return bool(self.find(_unit_keys(points, np.zeros(1, "i8"), np.array([len(points)])))[0] >= 0)

    def _deal(self, bits: int) -> None:
        self.shift, self.slots = np.uint64(64 - bits), np.full(2**bits, -1, "i4")
        self._insert(np.arange(self.n))

    def _insert(self, left: np.ndarray) -> None:
        at = (self.keys[0, left] >> self.shift).astype("i8")
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            on = self.slots[at] != left
            left, at = left[on], (at[on] + 1) & (len(self.slots) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the units with these keys, -1 where unknown."""
        at = (keys[0] >> self.shift).astype("i8")
        out = self.slots[at]
        on = np.flatnonzero((out >= 0) & self._differ(out, keys)) if self.n else at[:0]
        while len(on):
            at[on] = (at[on] + 1) & (len(self.slots) - 1)
            out[on] = got = self.slots[at[on]]
            on = on[(got >= 0) & self._differ(got, keys[:, on])]
        return out

    def _differ(self, numbers: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return (self.keys[0][numbers] != keys[0]) | (self.keys[1][numbers] != keys[1])

    def add(self, keys: np.ndarray) -> None:
        """Numbers units that have none yet; no two of ``keys`` agree."""
        old, self.n = self.n, self.n + keys.shape[1]
        if self.n > self.keys.shape[1]:
            self.keys = np.concatenate([self.keys[:, :old], np.zeros((2, self.n * 5 // 4 - old), "u8")], axis=1)
        self.keys[:, old : self.n] = keys
        if 2 * self.n > len(self.slots):
            self._deal(int(2 * self.n).bit_length() + 1)
        else:
            self._insert(np.arange(old, self.n))

    def keep(self, kept: np.ndarray) -> None:
        """Forgets all others; the kept ones are numbered anew."""
        self.keys, self.n = self.keys[:, kept], len(kept)
        self._deal(max(16, int(2 * self.n).bit_length() + 1))


def _unit_keys(points: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two hashes of each run of code points, of their values and places; the runs lie side by side."""
    place = np.arange(len(points)) - np.repeat(at, size)
    x = _mix((points + (place.astype("u8") << np.uint64(32))) * _C + _GOLD)
    return np.stack([_mix(np.add.reduceat(x, at)), np.add.reduceat((x ^ (x >> np.uint64(29))) * _B, at)])


def _cut(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the units begin in texts that begin at ``starts``: the bounds that ``UNIT`` finds."""
    line, space = points == 10, points == 32
    begin = line | space
    begin[1:] = line[1:] | line[:-1] | (space[1:] & ~space[:-1])
    begin[starts] = True
    return np.flatnonzero(begin)


class Lattices:
    """Lattices of units: states are character places, edges are pieces, probabilities are conditional on the state.

    An edge's ``piece`` is an id, or -1 - c for the character c spelled in bytes. A state's edges run from
    ``first_edge[state]`` to ``first_edge[state + 1]``, the likeliest first; ``cdf`` ends above 1 in each.
    ``start`` numbers the units. Of these, ``state`` has the first states, and their first paths,
    of first edges alone, have the log-probabilities ``log_first``, the probabilities ``p_first`` and ``id_size`` ids from ``id_at`` on.
    """

    def __init__(self, vocab: Vocabulary, alpha: float):
        self.vocab, self.alpha = vocab, alpha
        self.weight = np.exp(alpha * vocab.log_prob)
        self.clear()

    def clear(self) -> None:
        self.start = Numbers()
        self.states = self.edges = self.n_ids = 0
        self.hits, self.state = np.zeros(0, "i4"), np.zeros(0, "i8")
        self.log_first, self.p_first = np.zeros(0), np.zeros(0)
        self.id_at, self.id_size, self.ids = np.zeros(0, "i8"), np.zeros(0, "i4"), np.zeros(0, "i4")
        self.last, self.first_edge = np.zeros(0, bool), np.zeros(1, "i8")
        self.to, self.piece = np.zeros(0, "i4"), np.zeros(0, "i4")
        self.log_p, self.cdf = np.zeros(0), np.zeros(0)

    def _put(self, name: str, at: int, new: np.ndarray) -> None:
        """Writes ``new`` from place ``at`` of an array, which has room beyond what is used."""
        held = getattr(self, name)
        if at + len(new) > len(held):
            held = np.concatenate([held[:at], np.zeros((at + len(new)) * 5 // 4 - at, held.dtype)])
            setattr(self, name, held)
        held[at : at + len(new)] = new

    def starts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' units, which get lattices where they have none, and how many units each text has."""
        if self.states > MAX_STATES:
            self._trim()
        chars = np.array([len(t) + 1 if t else 0 for t in texts], "i8")
        if not chars.sum():
            return chars[:0], chars
        points = _code_points("".join([" " + t for t in texts if t]))
        ends = np.cumsum(chars)
        at = _cut(points, (ends - chars)[chars > 0])
        size = np.diff(at, append=len(points))
        keys = _unit_keys(points, at, size)
        out = self.start.find(keys)
        while len(odd := np.flatnonzero(out < 0)):
            new = odd[np.sort(np.unique(keys[0, odd], return_index=True)[1])]
            self._add(points[_ranges(at[new], size[new])], size[new], keys[:, new])
            out[odd] = self.start.find(keys[:, odd])
        self.hits[: len(self.start)] += np.bincount(out, minlength=len(self.start)).astype("i4")
        return out, np.diff(np.searchsorted(at, ends), prepend=0)

    def _trim(self) -> None:
        """Keeps the units that were met most often, in up to half of the room."""
        state = self.state[: len(self.start)]
        size = np.diff(np.append(state, self.states))
        order = np.argsort(-self.hits[: len(state)], kind="stable")
        kept = np.sort(order[np.cumsum(size[order]) <= MAX_STATES // 2])
        s, n = state[kept], size[kept]
        e, m = self.first_edge[s], self.first_edge[s + n] - self.first_edge[s]
        states, edges, now = _ranges(s, n), _ranges(e, m), np.cumsum(n) - n
        to, count = self.to[edges] - np.repeat(s - now, m), self.first_edge[states + 1] - self.first_edge[states]
        k = self.id_size[kept]
        ids = self.ids[_ranges(self.id_at[kept], k)]
        new = {"hits": self.hits[kept] // 2, "state": now, "id_at": np.cumsum(k) - k, "ids": ids, "last": self.last[states], "to": to}
        new |= {c: getattr(self, c)[kept] for c in ("log_first", "p_first", "id_size")} | {c: getattr(self, c)[edges] for c in ("piece", "log_p", "cdf")}
        for name, x in new.items():
            self._put(name, 0, x)
        self._put("first_edge", 1, np.cumsum(count))
        self.states, self.edges, self.n_ids = len(states), len(edges), len(ids)
        self.start.keep(kept)

    def _edges(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first edge of each character, and past the last), and each edge's source, length and piece."""
        n, v = len(points), self.vocab
        mixed = _mix(points + _GOLD)
        at, h, found = np.arange(n), np.zeros(n, "u8"), []
        for k in range(1, v.longest + 1):
            if k > 1:
                room = at + k <= ends[at]
                at, h = at[room], h[room]
            h = h * _C + mixed[at + k - 1]
            e = v.find(h)
            ok = e >= 0
            at, h, ids = at[ok], h[ok], v.ids[e[ok]]
            whole = ids >= 0
            found.append((at[whole], ids[whole]))
            if not len(at):
                break
        rare = np.ones(n, bool)
        rare[found[0][0]] = False
        odd = np.flatnonzero(rare)
        found.append((odd, (-1 - points[odd].astype("i8")).astype("i4")))
        sizes = [*range(1, len(found)), 1]
        count = np.bincount(np.concatenate([a for a, _ in found]), minlength=n)
        cut = np.concatenate([[0], np.cumsum(count)])
        src, size, piece, used = np.empty(cut[-1], "i8"), np.empty(cut[-1], "i8"), np.empty(cut[-1], "i4"), np.zeros(n, "i8")
        for k, (a, ids) in reversed(list(zip(sizes, found, strict=True))[:-1]):
            at = cut[a] + used[a]
            used[a] += 1
            src[at], size[at], piece[at] = a, k, ids
        at = cut[odd] + used[odd]
        src[at], size[at], piece[at] = odd, 1, found[-1][1]
        return cut, src, size, piece

    def _add(self, points: np.ndarray, length: np.ndarray, keys: np.ndarray) -> None:
        v, n = self.vocab, len(points)
        unit_of = np.repeat(np.arange(len(length)), length)
        ends = np.cumsum(length)[unit_of]  # of each character, where its unit ends
        cut, src, size, piece = self._edges(points, ends)
        count = np.diff(cut)
        # a unit has one state more than characters: its end, which has no edges
        state = np.arange(n) + unit_of
        to = state[src] + size
        weight = self.weight[np.maximum(piece, 0)]
        odd = np.flatnonzero(piece < 0)
        c = -1 - piece[odd]
        weight[odd] = np.exp(-self.alpha * np.log(len(v.raw)) * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)))
        mass = np.ones(n + len(length))  # of all ways from a state to its unit's end, over a scale that changes with the place
        far = ends - np.arange(n)
        by = np.argsort(far.astype("u2") if len(far) and far.max() < 2**16 else far, kind="stable")
        p = np.empty(len(src))
        steps = np.cumsum(np.bincount(far)).tolist()
        for j, (a, b) in enumerate(zip(steps[:-1], steps[1:], strict=True)):
            c = by[a:b]
            k = count[c]
            e = _ranges(cut[c], k)
            x = weight[e] * mass[to[e]]
            total = np.add.reduceat(x, np.cumsum(k) - k)
            p[e] = x / np.repeat(total, k)
            if j % 16 == 15:  # long before numbers could leave their range
                back = np.minimum(state[c][:, None] + np.arange(1, v.longest + 1), (ends[c] + unit_of[c])[:, None])
                mass[back] /= total[:, None]
                total = 1.0
            mass[state[c]] = total
        likely = np.flatnonzero(p == np.repeat(np.maximum.reduceat(p, cut[:-1]), count))
        likely = likely[np.diff(src[likely], prepend=-1) > 0]
        a, b = cut[:-1][likely != cut[:-1]], likely[likely != cut[:-1]]
        for x in (to, piece, p):
            x[a], x[b] = x[b], x[a]
        log_p, cdf = np.log(p), p
        at, more = cut[:-1], count - 1
        while len(at := at[more > 0]):
            more = more[more > 0] - 1
            at = at + 1
            cdf[at] += cdf[at - 1]
        cdf[cut[1:] - 1] = 2.0
        base, total = self.states, len(mass)
        ends_at = np.cumsum(length + 1) - 1
        last = np.zeros(total, bool)
        last[ends_at] = True
        counts = np.zeros(total, "i8")
        counts[state] = count
        self._put("last", base, last)
        self._put("first_edge", base + 1, self.edges + np.cumsum(counts))
        self._put("to", self.edges, base + to)
        for name, x in (("piece", piece), ("log_p", log_p), ("cdf", cdf)):
            self._put(name, self.edges, x)
        first = base + ends_at - length
        log_first, ids, bounds = self._spelled(*self._first_paths(first))
        self._put("hits", len(self.start), np.zeros(len(length), "i4"))
        self._put("state", len(self.start), first)
        self._put("p_first", len(self.start), np.exp(log_first))
        self.lend(log_first, ids, bounds, 0, 0)
        self.start.add(keys)
        self.states += total
        self.edges += len(src)
        self.n_ids += len(ids)

    def _first_paths(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        live, at, seen = np.arange(len(state)), state, []
        while len(live):
            e = self.first_edge[at]
            seen.append((live, e))
            at = self.to[e]
            go = ~self.last[at]
            live, at = live[go], at[go]
        return _in_order(seen, len(state))

    def _spelled(self, edges: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-probabilities of paths of ``n`` edges each, their ids, and where each path's ids begin and the last one's end."""
        cut = np.concatenate([[0], np.cumsum(n)])
        return np.minimum(np.add.reduceat(self.log_p[edges], cut[:-1]), 0.0), *self.spell(edges, cut)

    def lend(self, log_p: np.ndarray, ids: np.ndarray, bounds: np.ndarray, n_lent: int, ids_lent: int) -> None:
        """Puts segmentations behind those of the units and the ``n_lent`` lent before; they last until units are added."""
        at = len(self.start) + n_lent
        for name, x in (("log_first", log_p), ("id_at", self.n_ids + ids_lent + bounds[:-1]), ("id_size", np.diff(bounds))):
            self._put(name, at, x)
        self._put("ids", self.n_ids + ids_lent, ids)

    def first_path(self, number: int) -> tuple[int, ...]:
        s, out = self.state[number], []
        while not self.last[s]:
            out.append(int(self.first_edge[s]))
            s = self.to[out[-1]]
        return tuple(out)

    def walk(self, state: np.ndarray, key: np.ndarray, u: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges drawn from each state to its unit's end, one walk after the other, and the number of each.

        A walk of ``bound`` 1 leaves the first path where the probability of what it has followed falls to ``u`` or below;
        one of ``bound`` 0 is free.
        """
        live, at, step, seen = np.arange(len(state)), state, 0, []
        while len(live):
            step += 1
            e = self.first_edge[at]
            p = np.minimum(self.cdf[e], 1.0)
            stays = u < bound * p
            x = _uniform(key, step)
            x = np.where(stays, 0.0, np.where(bound > 0, p + (1 - p) * x, x))
            on = np.flatnonzero(x >= self.cdf[e])
            while len(on):
                e[on] += 1
                on = on[x[on] >= self.cdf[e[on]]]
            seen.append((live, e))
            at = self.to[e]
            go = ~self.last[at]
            live, at, key, u, bound = live[go], at[go], key[go], u[go], np.where(stays, bound * p, 0.0)[go]
        return _in_order(seen, len(state))

    def spell(self, edges: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the edges in order, and the places of ``cuts``, which are places among the edges, among these ids."""
        ids = self.piece[edges]
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, cuts
        spelled = [self.vocab.byte_ids[list(chr(-1 - c).encode("utf-8", "replace"))] for c in ids[odd].tolist()]
        more = np.array([len(x) - 1 for x in spelled])
        ids[odd] = [x[0] for x in spelled]
        ids = np.insert(ids, np.repeat(odd + 1, more), np.concatenate([x[1:] for x in spelled]))
        return ids, cuts + np.concatenate([[0], np.cumsum(more)])[np.searchsorted(odd, cuts)]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one range after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _in_order(seen: list[tuple[np.ndarray, np.ndarray]], n_walks: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges of walks, one walk after the other, and the number of each, from (walks, their edges) by step."""
    n = np.bincount(np.concatenate([np.zeros(0, "i8"), *(i for i, _ in seen)]), minlength=n_walks)
    off = np.cumsum(n) - n
    out = np.empty(int(n.sum()), "i8")
    for k, (i, e) in enumerate(seen):
        out[off[i] + k] = e
    return out, n


@lru_cache(maxsize=1)
def lattices(path: str, alpha: float) -> Lattices:
    """Kept by a worker from task to task: most units of a text have been met before."""
    return Lattices(vocabulary(path), alpha)


class _Turn(NamedTuple):
    """The first edges of a unit's path, where they lead, the paths that it is none of, and the masses, over exp(top), of
    what else there is and of all paths with these edges."""

    edges: tuple[int, ...]
    state: int
    barred: tuple[tuple[int, ...], ...]
    top: float
    others: float
    taken: float


class Sampler:
    """Draws up to k distinct segmentations of each text of a batch; the k-th round walks the k-th path of all texts."""

    def __init__(self, path: str, k: int, alpha: float):
        self.vocab, self.k = vocabulary(path), k
        self.lat = lattices(path, alpha)

    def batch(self, texts: list[str], seeds: np.ndarray) -> list[list[tuple[float, float, float, np.ndarray]]]:
        """For each text its samples (value, log-probability, log-inclusion, ids), best value first."""
        lat, d, k = self.lat, len(texts), self.k
        number, n_units = lat.starts(texts)
        ends = np.cumsum(n_units)
        off = ends - n_units
        p_first, n_first = lat.p_first[number], len(lat.start)
        # of every round and unit, the segmentation: its unit's number (the first path), or of a walk, numbered after all units
        paths = np.empty((k, len(number)), "i8")
        walks: list[tuple[np.ndarray, np.ndarray, int]] = []
        before, lent, ids_lent = np.empty(len(number)), 0, 0
        value = -np.log(-np.log(_uniform(seeds, 2**32, 7)))
        # the path to make in this round: as path ``parent`` before the unit ``keep``, which takes the turn
        docs, parent, keep, turns = np.arange(d), np.zeros(d, "i8"), np.full(d, -1), []
        heap: list[list[tuple]] = [[] for _ in range(d)]
        result: list[list] = [[] for _ in range(d)]
        for r in range(k):
            paths[r] = number
            for a, b, q in zip(off[docs].tolist(), (off[docs] + keep).tolist(), parent.tolist(), strict=True):
                if b > a:
                    paths[r, a:b] = paths[q, a:b]
            begin = off[docs] + keep + 1
            n = ends[docs] - begin
            fresh, owner = _ranges(begin, n), np.repeat(docs, n)
            key = _mix(seeds[owner] + np.uint64(r * 2**32) + (fresh - off[owner]).astype("u8") * _C)
            u = _uniform(key, 0)
            odd = np.flatnonzero(u >= p_first[fresh])
            where = fresh[odd]
            edges, n = self._walked(lat.state[number[where]], key[odd], u[odd], turns, seeds[docs] + np.uint64(r * 2**32) + keep.astype("u8") * _C)
            if turns:
                where = np.concatenate([where, off[docs] + keep])
            cut = np.concatenate([[0], np.cumsum(n)])
            walks.append((edges, cut, n_first + lent))
            if len(where):
                paths[r, where] = n_first + lent + np.arange(len(where))
                log_p, ids, bounds = lat._spelled(edges, n)
                lat.lend(log_p, ids, bounds, lent, ids_lent)
                lent, ids_lent = lent + len(where), ids_lent + len(ids)
            total, values, todo = [], value.tolist(), docs.tolist()
            log_p = lat.log_first[paths[r]]
            for a, b in zip(off[docs].tolist(), ends[docs].tolist(), strict=True):
                run = np.cumsum(log_p[a:b])
                before[a:b] = run - log_p[a:b]
                total.append(float(run[-1]) if b > a else 0.0)
            for i, t in zip(todo, total, strict=True):
                result[i].append((values[i], t))
            self._beside(r, docs, begin, off, ends, before, log_p, value, seeds, heap)
            if turns:
                self._same_unit(r, docs, keep, turns, before[off[docs] + keep], value, seeds, heap, edges, cut)
            if r + 1 < k:
                docs, parent, keep, turns = self._next(r, docs, off, number, paths, walks, value, seeds, heap)
        drawn = np.fromiter(map(len, result), "i8", d)
        of, q = np.repeat(np.arange(d), drawn), _ranges(np.zeros(d, "i8"), drawn)
        n = n_units[of]
        made = paths[np.repeat(q, n), _ranges(off[of], n)]
        size = lat.id_size[made]
        ids = lat.ids[_ranges(lat.id_at[made], size)]
        cut = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])].tolist()
        out, j = [], 0
        for i in range(d):
            kappa = max((x[0] for x in heap[i]), default=-math.inf)
            out.append([(v, p, log_inclusion(p, kappa), ids[cut[j + m] : cut[j + m + 1]]) for m, (v, p) in enumerate(result[i])])
            j += len(result[i])
        return out

    def _walked(self, state, key, u, turns: list, keys) -> tuple[np.ndarray, np.ndarray]:
        """Edges and sizes of the walks from ``state`` and, after them, of the turns, which walk on freely after their own edges."""
        lat = self.lat
        ends = np.array([t.state for t in turns], "i8")
        on = np.flatnonzero(~lat.last[ends])
        edges, n = lat.walk(np.concatenate([state, ends[on]]), np.concatenate([key, _mix(keys[on])]), np.concatenate([u, np.zeros(len(on))]), np.repeat([1.0, 0.0], [len(state), len(on)]))
        if not turns:
            return edges, n
        cut = np.cumsum(n)
        rest = np.zeros((2, len(turns)), "i8")
        rest[:, on] = cut[len(state) :] - n[len(state) :], cut[len(state) :]
        done = int(cut[len(state) - 1]) if len(state) else 0
        parts = [x for t, a, b in zip(turns, *rest.tolist(), strict=True) for x in (t.edges, edges[a:b])]
        sizes = np.array([len(t.edges) for t in turns]) + rest[1] - rest[0]
        return np.concatenate([edges[:done], *parts]).astype("i8"), np.concatenate([n[: len(state)], sizes])

    def _beside(self, r, docs, begin, off, ends, before, log_p, value, seeds, heap):
        """The sets beside the fresh units of the new paths; of each text the k + 1 best suffice."""

        def best(docs, begin, floor):
            n = ends[docs] - begin
            at, owner = _ranges(begin, n), np.repeat(docs, n)
            near = before[at] >= floor
            at, owner = at[near], owner[near]
            with np.errstate(divide="ignore"):
                mass = before[at] + np.log1p(-np.exp(log_p[at]))
            near = mass >= floor
            at, owner, mass = at[near], owner[near], mass[near]
            u = _uniform(seeds[owner], 1000 + r, at - off[owner])
            return self._largest(at, owner, -np.logaddexp(-value[owner], np.log(-np.log(u)) - mass))

        got = best(docs, begin, FLOOR)
        few = [j for j, i in enumerate(docs.tolist()) if len(got.get(i, ())) <= self.k or got[i][self.k][0] < FLOOR + REACH]
        if few:  # what lies below the floor could matter
            got |= best(docs[few], begin[few], np.finfo("f8").min)
        start = off.tolist()
        for i, sets in got.items():
            heap[i] += [(v, r, at - start[i], ()) for v, at in sets]

    def _same_unit(self, r, docs, keep, turns, before, value, seeds, heap, edges, cut):
        """The sets with the units before the turns, but neither the turn's segmentation nor those barred before."""
        cut = cut[-len(turns) - 1 :].tolist()
        mass, made = np.full(len(turns), -np.inf), []
        for j, t in enumerate(turns):
            made.append(tuple(edges[cut[j] : cut[j + 1]].tolist()))
            rest = made[j][len(t.edges) :]
            left = t.others + t.taken * -math.expm1(min(0.0, sum(self.lat.log_p[list(rest)].tolist()))) if rest else t.others
            if left > 0:
                mass[j] = t.top + math.log(left)
        u = _uniform(seeds[docs], 2000 + r, keep)
        vals = -np.logaddexp(-value[docs], np.log(-np.log(u)) - (mass + before))
        for j, (i, v, at) in enumerate(zip(docs.tolist(), vals.tolist(), keep.tolist(), strict=True)):
            if v > -math.inf:
                heap[i].append((v, r, at, (*turns[j].barred, made[j])))

    def _next(self, r, docs, off, number, paths, walks, value, seeds, heap):
        """The best set of each text that has one: (texts, the paths they follow, up to which unit, the turns there)."""
        u, out = _uniform(seeds[docs], 3001 + r).tolist(), []
        for i, x in zip(docs.tolist(), u, strict=True):
            heap[i].sort(key=lambda s: s[0])
            turn = None
            while heap[i] and turn is None:
                v, q, at, barred = heap[i].pop()
                place = off[i] + at
                if not barred:
                    edges, cut, n_before = walks[q]
                    w = paths[q, place] - n_before
                    barred = (self.lat.first_path(number[place]) if w < 0 else tuple(edges[cut[w] : cut[w + 1]].tolist()),)
                turn = self._turn(int(self.lat.state[number[place]]), barred, x)
            if turn is not None:
                value[i] = v
                out.append((i, q, at, turn))
        docs, parent, keep, turns = zip(*out, strict=True) if out else ((), (), (), ())
        return *(np.array(x, "i8") for x in (docs, parent, keep)), list(turns)

    def _turn(self, state: int, barred: tuple, u: float) -> _Turn | None:
        """Where a path of a unit leaves the barred ones, drawn by its probability with the uniform number ``u``."""
        lat, tree, nodes = self.lat, {}, [(state, 0.0, -1, -1)]
        for path in barred:
            node = 0
            for e in path:
                nxt = tree.get((node, e))
                if nxt is None:
                    nxt = tree[node, e] = len(nodes)
                    nodes.append((int(lat.to[e]), nodes[node][1] + float(lat.log_p[e]), node, e))
                node = nxt
        ways, logs = [], []
        for node, (s, log_p, _, _) in enumerate(nodes):
            a, b = lat.first_edge[s : s + 2].tolist()
            for e, x in enumerate(lat.log_p[a:b].tolist(), a):
                if (node, e) not in tree:
                    ways.append((node, e))
                    logs.append(log_p + x)
        if not ways:
            return None
        top = max(logs)
        mass = [math.exp(x - top) for x in logs]
        x, j = u * sum(mass), 0
        while j + 1 < len(mass) and (x := x - mass[j]) >= 0:
            j += 1
        node, e = ways[j]
        edges = [e]
        while node:
            _, _, node, e = nodes[node]
            edges.append(e)
        return _Turn(tuple(reversed(edges)), int(lat.to[ways[j][1]]), barred, top, sum(mass[:j]) + sum(mass[j + 1 :]), mass[j])

    def _largest(self, where, owner, vals) -> dict[int, list[tuple[float, int]]]:
        """The k + 1 largest values of each owner, and where they are; owners are in order."""
        if len(vals) > 64:  # what is below the (k + 1)-th largest of an owner's maxima over blocks is none of its largest
            start = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.arange(len(owner)) % 16 == 0))
            top, of = np.maximum.reduceat(vals, start), owner[start]
            order = np.lexsort((-top, of))
            first = np.flatnonzero(np.diff(of, prepend=-1))
            n = np.diff(np.append(first, len(of)))
            least = np.where(n > self.k, top[order[np.minimum(first + self.k, len(of) - 1)]], -np.inf)
            some = vals >= np.repeat(np.repeat(least, n), np.diff(np.append(start, len(vals))))
            owner, vals, where = owner[some], vals[some], where[some]
        order = np.lexsort((-vals, owner))
        owner, vals, where = owner[order], vals[order], where[order]
        bounds = [*np.flatnonzero(np.diff(owner, prepend=-1)).tolist(), len(owner)]
        return {int(owner[a]): list(zip(vals[a : min(b, a + self.k + 1)].tolist(), where[a:b].tolist(), strict=False)) for a, b in zip(bounds, bounds[1:], strict=False)}


def log_inclusion(log_prob: float, kappa: float) -> float:
    """Log of the chance that a segmentation's perturbed value exceeds the threshold."""
    x = log_prob - kappa
    return 0.0 if kappa == -math.inf else x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


def decode_ids(vocab: Vocabulary, ids) -> str:
    """The text that the ids spell: exactly the one they were made from."""
    return b"".join(map(vocab.raw.__getitem__, ids))[1:].decode("utf-8", "replace")


def _exact(vocab: Vocabulary, texts: list[str], drawn: list[list[tuple]]) -> list[bool]:
    """Whether all samples of each text spell its very bytes."""
    want = [(" " + t).encode("utf-8", "replace") if t else b"" for t in texts]
    k = [len(x) for x in drawn]
    ids = np.concatenate([np.zeros(0, "i4"), *(x[3] for samples in drawn for x in samples)])
    size = vocab.size[ids]
    ends = np.cumsum(size)
    of = np.concatenate([[0], np.cumsum([len(x[3]) for samples in drawn for x in samples])]).astype("i8")
    same = np.diff(np.concatenate([[0], ends])[of]) == np.repeat([len(w) for w in want], k)
    if same.all():  # all lengths agree, so that the bytes of all samples can be compared in place, eight at once
        text = b"".join(w * n for w, n in zip(want, k, strict=True)) + bytes(8 * len(vocab.words))
        window = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
        at = ends - size
        wrong = (window[at] ^ vocab.words[0][ids]) & vocab.masks[0][ids] != 0
        long_ = np.flatnonzero(size > 8)
        for j in range(1, len(vocab.words)):
            long_ = long_[size[long_] > 8 * j]
            wrong[long_] |= (window[at[long_] + 8 * j] ^ vocab.words[j][ids[long_]]) & vocab.masks[j][ids[long_]] != 0
        wrong = np.concatenate([[0], np.cumsum(wrong)])
        same = wrong[of[1:]] == wrong[of[:-1]]
    else:
        same = same & [b"".join(map(vocab.raw.__getitem__, x[3])) == w for w, samples in zip(want, drawn, strict=True) for x in samples]
    cut = np.concatenate([[0], np.cumsum(k)]).tolist()
    return [bool(same[a:b].all()) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _sample(batches: Iterator[pa.RecordBatch], path: str, k: int, alpha: float, seed: int, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    sampler = Sampler(path, k, alpha)
    for b in batches:
        size = pc.fill_null(pc.utf8_length(b.column("_text")), 0).to_pylist()
        at = 0
        while at < len(size):
            end, chars = at, 0
            while end < len(size) and (end == at or chars + size[end] <= BATCH_CHARS):
                chars += size[end]
                end += 1
            part = b.slice(at, end - at)
            yield _record(sampler, part, part.column("_text").to_pylist(), seed, names)
            at = end


def _record(sampler: Sampler, b: pa.RecordBatch, texts: list, seed: int, names: tuple[str, ...]) -> pa.RecordBatch:
    keys = b.column("_key").to_numpy(zero_copy_only=False).astype("i8").view("u8")
    some = [i for i, t in enumerate(texts) if t is not None]
    drawn = sampler.batch([texts[i] for i in some], _mix(keys[some] + np.uint64(seed) * _GOLD))
    flat = [x for s in drawn for x in s]
    n = np.zeros(len(texts), "i4")
    n[some] = [len(s) for s in drawn]
    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x[3]) for x in flat])]).astype("i4")), pa.array(np.concatenate([np.zeros(0, "i4"), *(x[3] for x in flat)]), pa.int32()))
    samples = pa.StructArray.from_arrays([*(pa.array(np.array([x[c] for x in flat], "f8")) for c in range(3)), ids], ["value", "log_prob", "log_inclusion", "ids"])
    ok = np.ones(len(texts), bool)
    ok[some] = _exact(sampler.vocab, [texts[i] for i in some], drawn)
    rest = [b.column(i) for i, c in enumerate(b.schema.names) if c not in ("_text", "_key")]
    return pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype("i4")), samples), pa.array(ok)], [*names, "samples", "round_trip"])


def sample_segmentations(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = MODEL, k: int = 4, alpha: float = 0.7, seed: int = 1) -> DataFrame:
    """The columns ``keep`` with samples (up to ``k`` distinct segmentations, best value first) and round_trip.

    ``key`` seeds a row's random numbers, so equal rows get equal samples. Null text has no samples; empty text has
    one, without ids; a text with fewer than k segmentations has them all, each with inclusion 1. round_trip tells that
    every sample decodes to the text. Other columns are ignored; an empty table gives an empty result.
    """
    d = docs.select(*keep, F.col(text).alias("_text"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("_key"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields if f.name not in ("_text", "_key"))
    run = partial(_sample, path=path, k=k, alpha=alpha, seed=seed, names=tuple(keep))
    return d.mapInArrow(run, f"{fields}, {SAMPLES}, round_trip boolean")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for b in batches:
        texts = [None if x is None else decode_ids(v, x) for x in b.column("_ids").to_pylist()]
        rest = [(b.column(i), n) for i, n in enumerate(b.schema.names) if n != "_ids"]
        yield pa.RecordBatch.from_arrays([*(c for c, _ in rest), pa.array(texts, pa.string())], [*(n for _, n in rest), "text"])


def decode(ids: DataFrame, column: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str = MODEL) -> DataFrame:
    """The columns ``keep`` with the text that each row's ids spell; null ids give null."""
    d = ids.select(*keep, F.col(column).alias("_ids"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.schema.fields if f.name != "_ids")
    return d.mapInArrow(partial(_decode, path=path), f"{fields}text string")


def digest(sampled: DataFrame) -> DataFrame:
    """One row for each row of the samples: how many, their sizes, scores, and a hash of each one's ids."""
    part = lambda f: F.transform("samples", f)
    return sampled.select("doc_id", F.size("samples").cast("long").alias("n_samples"), part(lambda x: F.size(x["ids"])).alias("n_ids"), part(lambda x: F.round(x["log_prob"], 6)).alias("log_prob"), part(lambda x: F.round(x["log_inclusion"], 6)).alias("log_inclusion"), part(lambda x: F.xxhash64(x["ids"])).alias("ids_hash"), "round_trip")


def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(sample_segmentations(documents(spark, sf_dir)))
