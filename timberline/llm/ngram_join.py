"""N-gram Jaccard join: a size-aware heavy-light similarity join on sets of word shingles.

Counting. One pass over the texts hashes the shingles. Packed arrays of (48-bit shingle, place of its document in a
batch) go to ranges of shingles, which count in how many documents each one occurs, and what is shared goes back to the
document. Beyond MAX_RANGES ranges the batches hand on rows instead, one for each of their distinct shingles, which Spark
counts and joins; so a batch costs the same however large the corpus is. Nothing is broadcast and nothing saturates: the
counts are exact at any size (a collision of two shingles adds to a count). A shingle of one document alone can be in no intersection, so a set of s that shares fewer than
ceil(0.8 s) shingles is done; of the others the shared shingles are kept, the rarest first.

Documents with equal sets (128-bit hash) are one node, so copies never meet as pairs.

Light: sets of s and t link where they share o(s, t) = ceil(c (s + t) / (1 + c)) shingles. For small sets the subsets of
that size are enumerated, as 128-bit hashes; two sets with a subset in common link. The boundary up to which sets are
enumerated is the one of least cost: subsets of the small sets that there are, against the lengths of the lists which
they would scan (:func:`boundary`).

Heavy: larger sets put a prefix (the s - ceil(c s) + 1 rarest shingles) into inverted lists; sets that link share a
prefix shingle. Lists of up to SHORT sets are scanned pair by pair with the bounds on length and position; in longer
lists the sets of one size band join their least node, and neighbouring bands each other. The candidate groups that come
of this are verified by scanning the lists of all their shared shingles and counting overlaps, in units bounded by
sets and by shingles. A group larger than a unit is first dealt into units by min-hash, three times over, which joins
almost all of its links; then only the nodes outside its largest component, cut into blocks by size band, meet all
blocks of sizes that can link. Pairs are never rows: a unit returns a spanning forest of its links.

Overlaps are counted on 48-bit shingles: a pair of sets of 430 has a chance of 1e-9 to be counted one too high.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import documents, join_hot, row_key, shuffle_partitions, staged
from timberline.llm.components import components

SHINGLE, NUM, DEN = 5, 80, 100
BITS = 48
#: Most sets and most shingles of a block; a unit holds two blocks. A set larger than that is a block of its own.
BLOCK, BLOCK_ITEMS = 512, 2_000_000
#: Longest list that is scanned pair by pair, largest boundary that is considered, and list rows a verified set costs.
SHORT, MAX_LIGHT, VERIFY_ROWS = 16, 16, 8
#: Shingles of a batch and of a range of shingles; documents of a batch, whose places fit in 16 bits.
BATCH, RANGE, BATCH_DOCS, MANY = 1_500_000, 1_000_000, 60_000, 65_535
#: Most ranges to which a batch sends packed arrays.
MAX_RANGES = 8192
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], "u8")
DOCS, KEYS, OWN = 0, 1, 2
PACKED = "batch bigint, mark bigint, kind tinyint, a binary, b binary, c binary, d binary"
SHINGLE_ROWS = "batch bigint, mark bigint, kind tinyint, a binary, b binary, c binary, d binary, key bigint, place int, times bigint"
SETS = "ref bigint, doc_id bigint, rk bigint, hi bigint, lo bigint, n int, scan bigint, items binary"


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.zeros(0, "u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), "u8", len(w))
    k = min(len(h), SHINGLE)
    x = sum((h[i : len(h) - k + 1 + i] * MULTIPLIERS[i] for i in range(k)), np.zeros(len(h) - k + 1, "u8") + np.uint64(k))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(x ^ (x >> np.uint64(29)))


def need(s, t):
    """Least common size of linked sets of s and t."""
    return -(-NUM * (s + t) // (NUM + DEN))


def prefix_size(s):
    return s + (-NUM * s // DEN) + 1


def light_partners(s: int, top: int) -> list[int]:
    return [t for t in range(1, top + 1) if DEN * min(s, t) >= NUM * max(s, t)]


def light_rows(s: int, top: int) -> int:
    return sum(math.comb(s, need(s, t)) for t in light_partners(s, top))


def boundary(sizes: dict[int, tuple[int, int]]) -> int:
    """The size up to which sets are enumerated, from {size: (sets, length of the lists they would scan)}.

    Sets up to b cost their subsets, larger ones their lists and their verification; the cheapest b is taken.
    """
    listed = {s: n * VERIFY_ROWS + scan for s, (n, scan) in sizes.items()}
    cost = lambda b: sum(n * light_rows(s, b) if s <= b else listed[s] for s, (n, _) in sizes.items())
    return min(range(MAX_LIGHT + 1), key=lambda b: (cost(b), b))


# Packed arrays: byte planes of differences, which Spark's own codec then shrinks.


def planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view("u1").reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), "u1")
    out[:, :width] = np.frombuffer(b, "u1").reshape(width, -1).T
    return out.view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return planes(np.diff(x, prepend=np.uint64(0)), BITS // 8)


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(from_planes(b, BITS // 8), dtype="u8")


def pack_items(x: np.ndarray) -> bytes:
    return x.astype("<u8").view("u1").reshape(-1, 8)[:, : BITS // 8].tobytes()


def unpack_items(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // (BITS // 8), 8), "u1")
    out[:, : BITS // 8] = np.frombuffer(b, "u1").reshape(-1, BITS // 8)
    return out.view("<u8").ravel()


def _record(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("mark", pa.int64()), ("kind", pa.int8()), *((c, pa.binary()) for c in "abcd")])
ROWS_ARROW = pa.schema([*list(PACKED_ARROW)[1:], ("key", pa.int64()), ("place", pa.int32()), ("times", pa.int64())])
SETS_ARROW = pa.schema([("ref", pa.int64()), ("doc_id", pa.int64()), ("rk", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("scan", pa.int64()), ("items", pa.binary())])


class Batch:
    """Documents of one task, up to about BATCH shingles, packed for the ranges that count them."""

    def __init__(self, number: int, buckets: int):
        self.number, self.buckets = number, buckets
        self.ids: list = []
        self.keys: list[int] = []
        self.nodes: list[bytes] = []
        self.sizes: list[int] = []
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, doc, key: int, x: np.ndarray, seen: set[bytes]) -> None:
        node = xxhash.xxh3_128_digest(x.tobytes())
        if len(x) and node not in seen:
            if len(seen) < 500_000:
                seen.add(node)
            self.held.append((x >> np.uint64(64 - BITS)) << np.uint64(16) | np.uint64(len(self.ids)))
            self.size += len(x)
        self.ids.append(doc)
        self.keys.append(key)
        self.nodes.append(node)
        self.sizes.append(len(x))

    def rows(self) -> pa.RecordBatch:
        """One row with the documents, one with the shingles that several of them share, one for each range.

        With no ranges (``buckets`` is 0) there is one for each distinct shingle instead.

        A shingle shared in the batch stays with the batch, and its range is told the number alone, so that a shingle
        of very many documents is no large group there.
        """
        nodes = b"".join(self.nodes)
        mark = xxhash.xxh3_64_intdigest(nodes) - 2**63
        ids = np.array([0 if i is None else i for i in self.ids], "i8")
        none = np.array([i is None for i in self.ids], "u1")
        x = np.concatenate(self.held) if self.held else np.zeros(0, "u8")
        self.held = []
        x.sort()
        place = x.astype("u2")  # the low 16 bits
        x >>= np.uint64(16)
        key = x
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, "i8")
        run = np.diff(np.append(start, len(key)))
        alone = np.repeat(run == 1, run)
        own = self.buckets + mark % self.buckets if self.buckets else None
        out = [(own, DOCS, ids.tobytes(), none.tobytes(), nodes + np.array(self.keys, "<i8").tobytes(), np.array(self.sizes, "<u4").tobytes()), (own, OWN, pack_sorted(key[~alone]), planes(place[~alone], 2), b"", b"")]
        single, at = key[alone], place[alone]
        several, times = key[start[run > 1]], run[run > 1]
        del x, key, place, alone, start, run
        if not self.buckets:
            return self._plain(mark, [x[1:] for x in out], single, at, several, times)
        edges = [-(-(b << BITS) // self.buckets) for b in range(self.buckets + 1)]
        cut, cut_more = (np.searchsorted(k, np.array(edges, "u8")) for k in (single, several))
        for b in range(self.buckets):
            i, j, k, m = cut[b], cut[b + 1], cut_more[b], cut_more[b + 1]
            if i < j or k < m:
                out.append((b, KEYS, pack_sorted(single[i:j]), planes(at[i:j], 2), pack_sorted(several[k:m]), planes(times[k:m], 4)))
        bucket, kind, a, b, c, d = zip(*out, strict=True)
        return _record([bucket, [self.number] * len(out), [mark] * len(out), kind, a, b, c, d], PACKED_ARROW)


    def _plain(self, mark: int, packed: list, single: np.ndarray, at: np.ndarray, several: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        k, n = len(packed), len(single) + len(several)
        kind, *arrays = zip(*packed, strict=True)
        none = pa.nulls(n, pa.binary())
        key = pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(np.concatenate([single, several]).astype("i8"))])
        place = pa.array(np.concatenate([at, np.full(len(several), MANY, "u8")]).astype("i4"))
        count = pa.array(np.concatenate([np.ones(len(single), "i8"), times.astype("i8")]))
        cols = [
            pa.array(np.full(k + n, self.number)), pa.array(np.full(k + n, mark)), pa.concat_arrays([pa.array(kind, pa.int8()), pa.array(np.full(n, KEYS, "i1"))]),
            *(pa.concat_arrays([pa.array(x, pa.binary()), none]) for x in arrays),
            key, pa.concat_arrays([pa.nulls(k, pa.int32()), place]), pa.concat_arrays([pa.nulls(k, pa.int64()), count]),
        ]
        return pa.RecordBatch.from_arrays(cols, schema=ROWS_ARROW)


def _deal(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    first = TaskContext.get().partitionId() << 20
    number = 0
    held = Batch(first, buckets)
    for b in batches:
        for doc, text, key in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            held.add(doc, key, shingle_set(text), seen)
            if held.size >= BATCH or len(held.ids) >= BATCH_DOCS:
                yield held.rows()
                number += 1
                held = Batch(first + number, buckets)
    if held.ids:
        yield held.rows()


def _count(t: pa.Table) -> pa.Table:
    """A range of shingles: how many documents have each one; each batch is told of its shingles that others share.

    Rows of other kinds, which are under ranges of their own, pass through.
    """
    schema = pa.schema(list(PACKED_ARROW)[1:])
    r = t.select(schema.names).to_pydict()
    if DOCS in r["kind"] or OWN in r["kind"]:
        return t.select(schema.names)
    parts = []
    for i, (a, b, c, d) in enumerate(zip(r["a"], r["b"], r["c"], r["d"], strict=True)):
        for keys, place, times in ((unpack_sorted(a), from_planes(b, 2), None), (unpack_sorted(c), None, from_planes(d, 4))):
            k = len(keys)
            parts.append((keys, np.full(k, MANY, "u2") if place is None else place.astype("u2"), np.ones(k, "u4") if times is None else times.astype("u4"), np.full(k, i, "i4")))
    key, place, times, of = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    run = np.diff(np.append(start, len(key)))
    docs = np.add.reduceat(times[order], start, dtype="i8")
    more = np.repeat(docs > 1, run)
    order, key, docs = order[more], key[more], np.repeat(docs[docs > 1], run[docs > 1])
    place, of = place[order], of[order]
    shared = np.argsort(of, kind="stable")
    cut = np.searchsorted(of[shared], np.arange(len(r["batch"]) + 1))
    out = []
    for i, (batch, mark) in enumerate(zip(r["batch"], r["mark"], strict=True)):
        at = shared[cut[i] : cut[i + 1]]
        if len(at):
            out.append((batch, mark, KEYS, pack_sorted(key[at]), planes(place[at], 2), planes(docs[at], 5), b""))
    return pa.Table.from_batches([_record(list(zip(*out, strict=True)) or [[]] * 7, schema)])


def _finish(t: pa.Table) -> pa.Table:
    """A batch: its documents, each with its shared shingles, the rarest first, where it has enough of them to link."""
    batch, marks = t["batch"][0].as_py(), t["mark"].unique()
    plain = None
    if "key" in t.column_names:
        plain, t = t.filter(t["key"].is_valid()), t.filter(t["key"].is_null())
    r = t.select(["kind", "a", "b", "c", "d"]).to_pydict()
    rows = list(zip(r["kind"], r["a"], r["b"], r["c"], r["d"], strict=True))
    if len(marks) > 1 or sum(k == DOCS for k, *_ in rows) != 1:
        raise RuntimeError("documents came in another order when a lost task ran again; write them to a table first")
    _, ids, none, nodes, sizes = next(x for x in rows if x[0] == DOCS)
    n = np.frombuffer(sizes, "<u4").astype("i8")
    told = [(unpack_sorted(a), from_planes(b, 2), from_planes(c, 5)) for k, a, b, c, _ in rows if k == KEYS]
    if plain is not None:
        told.append(tuple(plain[c].to_numpy().astype("u8") for c in ("key", "place", "docs")))
    key, place, docs = (np.concatenate([x[i] for x in told]) if told else np.zeros(0, "u8") for i in range(3))
    many = place == MANY
    known, times = key[many], docs[many]
    order = np.argsort(known)
    known, times = known[order], times[order]
    for k, a, b, _, _ in rows:
        if k == OWN and len(a):
            own = unpack_sorted(a)
            key, place, docs = np.concatenate([key[~many], own]), np.concatenate([place[~many], from_planes(b, 2)]), np.concatenate([docs[~many], times[np.searchsorted(known, own)]])
    order = np.lexsort((key, docs, place))
    key, docs = key[order], docs[order].astype("i8")
    cut = np.searchsorted(place[order], np.arange(len(n) + 1).astype("u8"))
    total = np.concatenate([[0], np.cumsum(docs)])
    shared = np.diff(cut)
    listed = np.where(shared + prefix_size(n) > n, shared + prefix_size(n) - n, 0) * (n > 0)
    scan = total[cut[:-1] + listed] - total[cut[:-1]]
    items = [pack_items(key[i:j]) if k else None for i, j, k in zip(cut[:-1].tolist(), cut[1:].tolist(), listed.tolist(), strict=True)]
    h, keys = np.frombuffer(nodes, "<i8", 2 * len(n)).reshape(-1, 2), np.frombuffer(nodes, "<i8", offset=16 * len(n))
    doc = pa.array(np.frombuffer(ids, "i8"), mask=np.frombuffer(none, "u1") > 0)
    ref = (np.int64(batch) << 16) + np.arange(len(n))
    return pa.Table.from_arrays([pa.array(ref), doc, pa.array(keys), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(n.astype("i4")), pa.array(scan), pa.array(items, pa.binary())], schema=SETS_ARROW)


def shared_shingles(docs: DataFrame, buckets: int) -> DataFrame:
    """SETS for every row of ``docs`` (doc_id, text): ``items`` has a set's shared shingles, or null where it cannot link."""
    docs = docs.select("doc_id", "text", row_key().alias("rk"))
    if buckets > MAX_RANGES:
        return _shared_by_rows(docs)
    dealt = docs.mapInArrow(partial(_deal, buckets=buckets), f"bucket int, {PACKED}")
    return dealt.groupBy("bucket").applyInArrow(_count, PACKED).groupBy("batch").applyInArrow(_finish, SETS)


def _shared_by_rows(docs: DataFrame) -> DataFrame:
    """As with ranges, but each distinct shingle of a batch is a row; a shingle of most batches is joined by broadcast."""
    dealt = staged(docs.mapInArrow(partial(_deal, buckets=0), SHINGLE_ROWS), "ngram-dealt")
    shingles = dealt.where("key is not null").select("batch", "mark", "kind", "key", "place", "times")
    docs_of = staged(shingles.groupBy("key").agg(F.sum("times").alias("docs"), F.count("*").alias("_c")).where("docs > 1"), "ngram-counts")
    told = join_hot(shingles, docs_of, ["key"], "_c").where("docs is not null").drop("times", "_c")
    back = dealt.where("key is null").drop("times").unionByName(told, allowMissingColumns=True)
    return back.groupBy("batch").applyInArrow(_finish, SETS)


def _lists(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(key, node, n, at): the prefixes of sets of at least ``least`` shingles; ``at`` counts from 0."""
    for b in batches:
        out = []
        for node, n, items in zip(*(b.column(c).to_pylist() for c in ("node", "n", "items")), strict=True):
            if n >= least:
                x = unpack_items(items)
                first = n - len(x)
                x = x[: prefix_size(n) - first]
                out.append((x.view("i8"), np.full(len(x), node), np.full(len(x), n), first + np.arange(len(x))))
        key, node, n, at = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.zeros(0, "i8")] * 4
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(n.astype("i4")), pa.array(at.astype("i4"))], ["key", "node", "n", "at"])


def _subsets(batches: Iterator[pa.RecordBatch], light: int) -> Iterator[pa.RecordBatch]:
    """(node, n, sizes, k1, k2): the subsets of shared shingles by which small sets may link."""
    for b in batches:
        out = []
        for node, n, items in zip(*(b.column(c).to_pylist() for c in ("node", "n", "items")), strict=True):
            x = np.sort(unpack_items(items)) if n <= light else None
            for t in light_partners(n, light) if n <= light else ():
                for c in combinations(range(len(x)), need(n, t)):
                    k = xxhash.xxh3_128_intdigest(x[list(c)].tobytes())
                    out.append((node, n, 1000 * min(n, t) + max(n, t), (k >> 64) - 2**63, (k & (2**64 - 1)) - 2**63))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["node", "n", "sizes", "k1", "k2"])


def light_links(subsets: DataFrame) -> DataFrame:
    """Sets that share a subset of the size their pair of sizes needs: a star for each subset."""
    key = ["sizes", "k1", "k2"]
    a, b = F.floor(F.col("sizes") / 1000), F.col("sizes") % 1000
    low = subsets.groupBy(*key).agg(F.min("node").alias("to"), F.max("node").alias("_m"), F.max(F.col("n") == a).alias("_a"), F.max(F.col("n") == b).alias("_b"))
    low = low.where((F.col("to") < F.col("_m")) & F.col("_a") & F.col("_b")).select(*key, "to")
    return subsets.join(low, key).where(F.col("node") != F.col("to")).select(F.col("node").alias("a"), F.col("to").alias("b")).distinct()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short lists -> pairs whose lengths and positions allow a link; where all pairs of a list do, a star."""
    for b in batches:
        lists = b.column(0)
        node, n, at = (lists.flatten().field(i).to_numpy(zero_copy_only=False).astype("i8") for i in range(3))
        run = np.diff(lists.offsets.to_numpy())
        start = np.concatenate([[0], np.cumsum(run)[:-1]])
        found = []
        for r in range(2, SHORT + 1):
            m = start[run == r][:, None] + np.arange(r)
            if not len(m):
                continue
            i, j = np.triu_indices(r, 1)
            x, y = m[:, i], m[:, j]
            least = need(n[x], n[y])
            fits = np.minimum(n[x] - at[x], n[y] - at[y]) >= least
            fits &= np.minimum(n[x], n[y]) >= least
            fits &= ~(fits.all(1)[:, None] & (i > 0))
            found.append(np.stack([node[x[fits]], node[y[fits]]], 1))
        p = np.concatenate(found) if found else np.zeros((0, 2), "i8")
        p = np.unique(np.sort(p, axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])


def candidates(lists: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all sets which may link through a list of ``lists`` (key, node, n, at)."""
    spread = staged(lists.groupBy("key").agg(F.count("*").alias("_c")).where("_c > 1"), "ngram-spread")
    x = join_hot(lists, spread, ["key"], "_c").where("_c > 1")
    short = x.where(F.col("_c") <= SHORT).groupBy("key").agg(F.collect_list(F.struct("node", "n", "at")).alias("sets")).select("sets").mapInArrow(_scan, "a bigint, b bigint")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(DEN / NUM)).cast("int")
    long_ = x.where(F.col("_c") > SHORT).select("key", "node", band.alias("band"))
    hubs = staged(long_.groupBy("key", "band").agg(F.min("node").alias("to"), F.count("*").alias("_c")), "ngram-hubs")
    within = join_hot(long_, hubs, ["key", "band"], "_c").select(F.col("node").alias("a"), F.col("to").alias("b"))
    above = hubs.select("key", (F.col("band") - 1).alias("band"), F.col("to").alias("a"))
    across = hubs.join(above, ["key", "band"]).select("a", F.col("to").alias("b"))
    return short.unionByName(within).unionByName(across).where("a <> b").distinct()


def _least_hashes(batches: Iterator[pa.RecordBatch], rounds: int) -> Iterator[pa.RecordBatch]:
    """(node, n, size, m): size is that of the shared part, m its min-hashes."""
    r = np.random.default_rng(11).integers(1, 2**62, rounds).astype("u8") * np.uint64(2) + np.uint64(1)
    for b in batches:
        m, size = [], []
        for items in b.column("items").to_pylist():
            x = unpack_items(items) * np.uint64(0x9E3779B97F4A7C15)
            m.append([int(((x ^ (x >> np.uint64(31))) * k).min() >> np.uint64(1)) for k in r])
            size.append(len(x))
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), pa.array(size, pa.int32()), pa.array(m, pa.list_(pa.int64()))], ["node", "n", "size", "m"])


def _parts(count, size, block: int) -> F.Column:
    """How many blocks so many sets, of so many shingles, make."""
    return F.greatest(F.ceil(count / block), F.ceil(size / BLOCK_ITEMS)).cast("int")


def dealt_units(groups: DataFrame, block: int) -> DataFrame:
    """(node, unit): a small group is a unit; the sets of a ``large`` one are dealt by each min-hash and once at random."""
    small = groups.where(~F.col("large")).select("node", F.xxhash64("component").alias("unit"))
    g = groups.where("large").select("component", "node", "size", F.posexplode(F.concat("m", F.array(F.lit(0).cast("bigint")))).alias("round", "least"))
    cell = ["component", "round", "least"]
    parts = g.groupBy(*cell).agg(F.count("*").alias("_n"), F.sum("size").alias("_s")).where("_n > 1").select(*cell, _parts(F.col("_n"), F.col("_s"), block).alias("parts"))
    g = g.join(parts, cell)
    return small.unionByName(g.select("node", F.xxhash64(*cell, F.pmod(F.xxhash64("node", "round"), F.col("parts"))).alias("unit")))


def rest_units(groups: DataFrame, block: int) -> DataFrame:
    """(node, unit) of large ``groups`` (node, n, size, component, core): blocks outside the core with all that can link."""
    g = groups.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(DEN / NUM)).cast("int"))
    parts = g.groupBy("component", "core", "band").agg(_parts(F.count("*"), F.sum("size"), block).alias("parts"))
    g = g.join(parts, ["component", "core", "band"]).withColumn("part", F.pmod(F.xxhash64("node", "core"), F.col("parts"))).select("node", "component", "core", "band", "part")
    blocks = parts.select("component", F.col("core").alias("core2"), F.col("band").alias("band2"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)).alias("part2"))
    meet = g.withColumn("band2", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1))))).join(blocks, ["component", "band2"]).where(~(F.col("core") & F.col("core2")))
    one, two = F.struct("core", "band", "part"), F.struct(F.col("core2").alias("core"), F.col("band2").alias("band"), F.col("part2").alias("part"))
    return meet.select("node", F.xxhash64("component", F.least(one, two), F.greatest(one, two)).alias("unit")).distinct()


def _common(items: list[np.ndarray]) -> np.ndarray:
    """How many items each two sets have in common: short lists by enumeration, long ones by a matrix product."""
    k = len(items)
    flat, own = np.concatenate(items), np.repeat(np.arange(k), [len(x) for x in items])
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    run = np.diff(np.concatenate([start, [len(flat)]]))
    out = np.zeros(k * k)
    for r in range(2, min(int(run.max()), 16) + 1):
        m = own[start[run == r][:, None] + np.arange(r)]
        for i, j in combinations(range(r), 2):
            out += np.bincount(m[:, i] * k + m[:, j], minlength=k * k) if len(m) * 4 > k * k else 0
            if len(m) * 4 <= k * k:
                np.add.at(out, m[:, i] * k + m[:, j], 1)
    out = out.reshape(k, k)
    long_ = np.flatnonzero(run > 16)
    for part in np.array_split(long_, max(1, len(long_) // 4096)):
        m = np.zeros((k, len(part)), "f4")
        for c, p in enumerate(part):
            m[own[start[p] : start[p] + run[p]], c] = 1
        out += np.triu(m @ m.T, 1)
    return out


def forest(nodes: list[int], sizes: list[int], items: list[np.ndarray]) -> list[tuple[int, int]]:
    """(node, least linked node) for all nodes of a unit that link to a smaller one, directly or not."""
    order = np.argsort(np.array(nodes))
    nodes, items = [nodes[i] for i in order], [items[i] for i in order]
    n = np.array(sizes)[order]
    both = _common(items)
    link = (both > 0) & (DEN * both >= NUM * (n[:, None] + n[None, :] - both))
    label = np.arange(len(nodes))
    a, b = np.nonzero(link)
    while len(a) and (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
    return [(nodes[i], nodes[x]) for i, x in enumerate(label) if x != i]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, node, n, items) sorted by unit and node -> links (a, b)."""
    unit, nodes, sizes, items = None, [], [], []
    out: list = []
    for b in batches:
        for u, node, n, x in zip(*(b.column(c).to_pylist() for c in ("unit", "node", "n", "items")), strict=True):
            if u != unit:
                out += forest(nodes, sizes, items) if len(nodes) > 1 else []
                unit, nodes, sizes, items = u, [], [], []
            if not nodes or nodes[-1] != node:
                nodes.append(node)
                sizes.append(n)
                items.append(unpack_items(x))
        yield _links(out)
        out = []
    yield _links(forest(nodes, sizes, items) if len(nodes) > 1 else [])


def _links(out: list) -> pa.RecordBatch:
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def verified(sets: DataFrame, units: DataFrame) -> DataFrame:
    """Spanning forests (a, b) of the links within the units."""
    x = sets.join(units, "node").select("unit", "node", "n", "items")
    return x.repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(_verify, "a bigint, b bigint")


def heavy_links(sets: DataFrame, least: int, block: int) -> DataFrame:
    """Links (a, b) that connect all linked sets of ``sets`` (node, n, items) of at least ``least`` shingles."""
    lists = staged(sets.mapInArrow(partial(_lists, least=least), "key bigint, node bigint, n int, at int"), "ngram-lists")
    groups = components(candidates(lists))
    about = sets.mapInArrow(partial(_least_hashes, rounds=2), "node bigint, n int, size int, m array<bigint>")
    groups = staged(groups.join(about, "node"), "ngram-groups")
    size = groups.groupBy("component").agg(F.count("*").alias("_n"), F.sum("size").alias("_s")).select("component", (_parts(F.col("_n"), F.col("_s"), block) > 1).alias("large"))
    groups = staged(groups.join(size, "component"), "ngram-groups")
    links = staged(verified(sets, dealt_units(groups, block)), "ngram-links")
    if not groups.where("large").head(1):
        return links
    large = groups.where("large").join(components(links).select("node", F.col("component").alias("joined")), "node", "left")
    large = staged(large.withColumn("joined", F.coalesce("joined", "node")), "ngram-large")
    core = large.groupBy("component", "joined").agg(F.count("*").alias("_n")).groupBy("component").agg(F.max(F.struct("_n", "joined"))["joined"].alias("most"))
    large = large.join(core, "component").select("node", "n", "size", "component", (F.col("joined") == F.col("most")).alias("core"))
    return links.unionByName(staged(verified(sets, rest_units(large, block)), "ngram-links"))


def ngram_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, row_key, group) for every row of ``docs``; other columns are ignored.

    Words are runs of non-white characters, A-Z lower-cased. Null or wordless texts have no shingles and link with
    nothing (component_id is their doc_id). Equal texts link. Repeated rows each get a row. A null doc_id never names
    a component unless all its members are null. An empty table gives an empty result. Where ids
    repeat, ``row_key`` tells rows of one id apart by their text, and ``group`` tells components with one least id apart;
    it is null without shingles. ``docs`` must give its rows in
    the same order when a lost task runs again, as tables do; where it does not, an error is raised.
    """
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    total = d.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(d.sparkSession), total // (5 * RANGE))
    index = staged(shared_shingles(d, buckets), "ngram-index")
    rows = index.select("doc_id", "rk", "hi", "lo", "n", "ref").where("n > 0")
    nodes = staged(rows.groupBy("hi", "lo").agg(F.min("ref").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("copies")), "ngram-nodes")
    sets = index.where(F.col("items").isNotNull()).join(nodes.select(F.col("node").alias("ref")), "ref", "left_semi")
    sets = staged(sets.select(F.col("ref").alias("node"), "n", "scan", "items"), "ngram-sets")
    small = sets.where(F.col("n") <= MAX_LIGHT).groupBy("n").agg(F.count("*").alias("sets"), F.sum("scan").alias("scan")).collect()  # MAX_LIGHT rows
    light = boundary({r["n"]: (r["sets"], r["scan"]) for r in small})
    subsets = sets.where(F.col("n") <= light).mapInArrow(partial(_subsets, light=light), "node bigint, n int, sizes int, k1 bigint, k2 bigint")
    links = heavy_links(sets, NUM * light // DEN + 1, block).unionByName(light_links(staged(subsets, "ngram-subsets")))
    linked = components(links).join(nodes.select("node", "hi", "lo", "least"), "node")
    first = staged(linked.groupBy("component").agg(F.min("least").alias("first"), F.count("*").alias("members")), "ngram-components")
    first = join_hot(linked, first, ["component"], "members").select("hi", "lo", "first", "component")
    nodes = staged(nodes.join(first, ["hi", "lo"], "left").select("hi", "lo", "copies", F.coalesce("first", "least").alias("component_id"), F.coalesce("component", "node").alias("group")), "ngram-classes")
    out = join_hot(rows.drop("ref"), nodes, ["hi", "lo"], "copies")
    out = out.unionByName(index.where("n = 0").select("doc_id", "rk", "hi", "lo", "n", F.lit(0).cast("bigint").alias("copies"), F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("group")))
    return out.select(F.col("doc_id").alias(doc_id), F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("rk").alias("row_key"), "group")


def ngram_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of :func:`ngram_groups`."""
    return ngram_groups(docs, doc_id, text, block).select(doc_id, "n_shingles", "component_id")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir))
