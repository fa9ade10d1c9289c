"""Line dedup: sharded minimal perfect hashes index compact fingerprint and count arrays, which documents probe.

Pass 1 hashes every line key to 128 bits. Each task sends the distinct keys of a batch of documents, with their numbers
of documents and lines and the largest doc_id, to the shards: as packed arrays, or, where there are more than MAX_PACKED
shards, as rows, so that a batch costs the same however many shards there are. The number of shards follows from the
length of the texts. A shard lays a minimal perfect hash (levels of bit arrays, as many places as keys) over all its distinct keys
and adds everything up in arrays in the hash's order: fingerprints, counts of documents, keepers.

Pass 2 probes. What a document needs of a shard is the hash, a bit for each place whether its count is large enough,
and fingerprint and keeper of those places only. If that is at most ``max_broadcast`` bytes in all, every task gets it
and documents probe it where they are, so that neither texts nor lines are moved. Beyond that, hashes of lines (never
lines) are dealt to the shards and probe there, and the numbers of the lines to drop go back to the documents. A key
with more than 1 / HOT_SHARE of all lines would crowd its shard; there are fewer than HOT_SHARE such keys, so they form
one small index that every task probes before anything is dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import documents, row_key, staged

HOT_SHARE = 2000
MIN_CHARS, MIN_DOCS = 40, 5
#: Characters of text for each shard, keys of a batch, and the most bytes of arrays that every task may get.
SHARD_CHARS, BATCH, MAX_BROADCAST = 20_000_000, 500_000, 64_000_000
WHITE_BYTES = b" \t\n\x0b\x0c\r"
#: Most shards to which a batch sends packed arrays.
MAX_PACKED = 4096
LEVELS = 40
NO_KEEPER = np.iinfo(np.int64).min
UNKNOWN, KEEP, DROP = -1, 0, 1
KEYS = "shard int, h1 binary, h2 binary, docs binary, lines binary, keepers binary"
KEY_ROWS = "shard int, h1 bigint, h2 bigint, docs bigint, lines bigint, keepers bigint"
ARRAYS = "shard int, n bigint, lines bigint, sizes binary, bits binary, fingerprints binary, counts binary, keepers binary, often binary, hot binary"
LINES = "shard int, rk bigint, doc_id bigint, line_no int, h1 bigint, h2 bigint"
PROBED = ["shard", "sizes", "bits", "often", "fingerprints", "keepers"]


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased (on UTF-8 bytes)."""
    return line.strip(WHITE_BYTES).lower()


def hashed(texts: list[bytes | None], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, line, first in its text, h1, h2) of every line that is long enough; a text and a line by its number."""
    of, no, first, h = [], [], [], []
    for k, text in enumerate(texts):
        if not text or len(text) < min_chars:
            continue
        seen = set()
        for i, line in enumerate(text.split(b"\n")):
            if len(line) >= min_chars and len(key := line_key(line)) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                d = xxhash.xxh3_128_digest(key)
                h.append(d)
                of.append(k)
                no.append(i)
                first.append(d not in seen)
                seen.add(d)
    pairs = np.frombuffer(b"".join(h), "<i8").reshape(-1, 2)
    return np.array(of, "i8"), np.array(no, "i4"), np.array(first, bool), pairs[:, 0], pairs[:, 1]


def _ids(column) -> np.ndarray:
    """Ids with null as the least value but one, which no keeper equals."""
    s = column if isinstance(column, pa.Array) else pa.array(column, from_pandas=True)
    return s.cast(pa.int64()).fill_null(int(NO_KEEPER) + 1).to_numpy(zero_copy_only=False)


def merged(h1: np.ndarray, h2: np.ndarray, docs: np.ndarray, lines: np.ndarray, keepers: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys with summed docs and lines and the largest keeper."""
    order = np.lexsort((h2, h1))
    h1, h2 = h1[order], h2[order]
    start = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])) if len(h1) else np.zeros(0, "i8")
    total = lambda x: np.add.reduceat(x[order], start) if len(start) else x
    return h1[start], h2[start], total(docs), total(lines), np.maximum.reduceat(keepers[order], start) if len(start) else keepers


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return (h1.view("u8") % np.uint64(shards)).astype("i4")


def by_shard(shard: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(shard, places) of the shards that occur."""
    order = np.argsort(shard, kind="stable")
    own, start = np.unique(shard[order], return_index=True)
    return list(zip(own.tolist(), np.split(order, start[1:]), strict=True)) if len(own) else []


def dealt_keys(keys: tuple[np.ndarray, ...], shards: int, packed: bool) -> pa.RecordBatch:
    """Distinct keys (h1, h2, docs, lines, keepers) as they go to the shards."""
    shard = shard_of(keys[0], shards)
    if not packed:
        cols = [pa.array(shard), *(pa.array(x.astype("i8")) for x in keys)]
    else:
        parts = by_shard(shard)
        cols = [pa.array([s for s, _ in parts], pa.int32()), *(pa.array([x[at].astype("<i8").tobytes() for _, at in parts], pa.binary()) for x in keys)]
    return pa.RecordBatch.from_arrays(cols, ["shard", "h1", "h2", "docs", "lines", "keepers"])


def _deal_keys(batches: Iterator[pa.RecordBatch], min_chars: int, shards: int, packed: bool) -> Iterator[pa.RecordBatch]:
    held: list = []

    def rows() -> pa.RecordBatch:
        return dealt_keys(merged(*(np.concatenate(x) for x in zip(*held, strict=True))), shards, packed)

    for b in batches:
        ids = b.column(0).cast(pa.int64()).fill_null(int(NO_KEEPER)).to_numpy(zero_copy_only=False)
        of, _, first, h1, h2 = hashed(b.column(1).cast(pa.binary()).to_pylist(), min_chars)
        held.append((h1, h2, first.astype("i8"), np.ones(len(h1), "i8"), ids[of]))
        if sum(len(x[0]) for x in held) >= BATCH:
            yield rows()
            held = []
    if held:
        yield rows()


def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h1.view("u8") ^ np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + h2.view("u8")
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype("i8")


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, the first bit lowest."""
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8, "u1")]).view("<u8")


class BitArray:
    """Bits with the number of set ones before a place."""

    def __init__(self, words: bytes):
        self.words = np.frombuffer(words, "<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype="i8")])

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype("u8")) & np.uint64(1) > 0

    def rank(self, at: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (at & 63).astype("u8")) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & below).astype("i8")


class PerfectHash:
    """Places 0 to n - 1 for n distinct 128-bit keys: at each level the keys alone in their slot are settled."""

    def __init__(self, sizes: bytes, bits: bytes):
        self.sizes, self.bits = np.frombuffer(sizes, "<i8"), BitArray(bits)

    @staticmethod
    def build(h1: np.ndarray, h2: np.ndarray) -> tuple[bytes, bytes]:
        """(sizes, bits). 40 levels settle any realistic set; keys left over are an error rather than a wrong index."""
        sizes, bits, rest = [], [], np.arange(len(h1))
        for level in range(LEVELS):
            if not len(rest):
                break
            size = 2 * len(rest)
            at = _slot(h1[rest], h2[rest], level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            rest = rest[~alone[at]]
        if len(rest):
            raise ValueError(f"{len(rest)} keys are not distinct")
        return np.array(sizes, "<i8").tobytes(), _words(np.concatenate(bits) if bits else np.zeros(0, bool)).tobytes()

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The place of each key; of a key that was not built in, any place or -1."""
        place, open_, start = np.full(len(h1), -1, "i8"), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = start + _slot(h1[open_], h2[open_], level, size)
            hit = self.bits.get(at)
            place[open_[hit]] = self.bits.rank(at[hit])
            open_ = open_[~hit]
            start += size
        return place


def build_arrays(h1: np.ndarray, h2: np.ndarray, docs: np.ndarray, lines: np.ndarray, keepers: np.ndarray, min_docs: int) -> dict:
    """The index of a shard from its keys as they came, repeated ones too.

    Counts are kept up to ``min_docs`` and no further; keepers and fingerprints only of places that reach it.
    """
    d1, d2, *_ = merged(h1, h2, docs, lines, keepers)
    sizes, bits = PerfectHash.build(d1, d2)
    at = PerfectHash(sizes, bits).places(h1, h2)
    n = len(d1)
    count, times, keeper, print_ = np.zeros(n, "i8"), np.zeros(n, "i8"), np.full(n, NO_KEEPER), np.zeros(n, "u8")
    np.add.at(count, at, docs)
    np.add.at(times, at, lines)
    np.maximum.at(keeper, at, keepers)
    print_[at] = h2.view("u8")
    often = count >= min_docs
    hot = often & (times * HOT_SHARE > times.sum())
    who = np.zeros(n, "i8")
    who[at] = np.arange(len(h1))
    hot_keys = np.stack([h1[who[hot]], h2[who[hot]], keeper[hot], times[hot]], 1).astype("<i8") if n else np.zeros((0, 4), "<i8")
    small = np.minimum(count, min_docs).astype("<u1" if min_docs < 256 else "<u4")
    return {"n": n, "lines": int(times.sum()), "sizes": sizes, "bits": bits, "fingerprints": print_[often].astype("<u8").tobytes(), "counts": small.tobytes(), "keepers": keeper[often].astype("<i8").tobytes(), "often": _words(often).tobytes(), "hot": hot_keys.tobytes()}


def _build_shard(t: pa.Table, min_docs: int) -> pa.Table:
    columns = (t[c] for c in ("h1", "h2", "docs", "lines", "keepers"))
    parts = [np.frombuffer(b"".join(c.to_pylist()), "<i8") if pa.types.is_binary(c.type) else c.to_numpy() for c in columns]
    row = {"shard": t["shard"][0].as_py(), **build_arrays(*parts, min_docs)}
    return pa.table({k: pa.array([v], pa.int32() if k == "shard" else pa.int64() if isinstance(v, int) else pa.binary()) for k, v in row.items()})


class Shard:
    """The probed part of a shard's arrays."""

    def __init__(self, row: dict):
        self.hash, self.often = PerfectHash(row["sizes"], row["bits"]), BitArray(row["often"])
        self.fingerprints, self.keepers = np.frombuffer(row["fingerprints"], "<i8"), np.frombuffer(row["keepers"], "<i8")

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counted in enough documents, keeper) of each key."""
        place = self.hash.places(h1, h2)
        found, keeper = np.zeros(len(h1), bool), np.full(len(h1), NO_KEEPER)
        some = np.flatnonzero(place >= 0)
        some = some[self.often.get(place[some])]
        at = self.often.rank(place[some])
        same = self.fingerprints[at] == h2[some]
        found[some[same]] = True
        keeper[some[same]] = self.keepers[at[same]]
        return found, keeper


def verdicts(shard: Shard, ids: np.ndarray, h1: np.ndarray, h2: np.ndarray, otherwise: int) -> np.ndarray:
    found, keeper = shard.probe(h1, h2)
    return np.where(found, np.where((keeper == ids) | (keeper == NO_KEEPER), KEEP, DROP), otherwise)


def line_arrays(d: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int | None = None) -> tuple[DataFrame, int]:
    """The shards (ARRAYS) over the lines of ``d`` (doc_id, text), and how many there may be."""
    shards = shards or int((d.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARS) + 1
    packed = shards <= MAX_PACKED
    keys = d.select("doc_id", "text").mapInArrow(partial(_deal_keys, min_chars=min_chars, shards=shards, packed=packed), KEYS if packed else KEY_ROWS)
    build = lambda t: _build_shard(t, min_docs)
    return staged(keys.groupBy("shard").applyInArrow(build, ARRAYS), "line-arrays"), shards


def probed_here(arrays: DataFrame, shards: int, min_chars: int, doc_id: Column, text: Column) -> Column:
    """Numbers of the lines to drop of each text, by the arrays of all shards, which every task gets."""
    rows = {r["shard"]: r.asDict() for r in arrays.select(*PROBED).collect()}  # at most max_broadcast bytes
    shared = arrays.sparkSession.sparkContext.broadcast(rows)

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = {k: Shard(r) for k, r in shared.value.items()}
        for ids, texts in parts:
            of, no, _, h1, h2 = hashed([None if t is None else t.encode("utf-8", "replace") for t in texts], min_chars)
            own, shard = _ids(ids)[of], shard_of(h1, shards)
            drop = np.zeros(len(of), bool)
            for s, at in by_shard(shard):
                drop[at] = verdicts(known[s], own[at], h1[at], h2[at], KEEP) == DROP
            of, no = of[drop], no[drop]
            cut = np.searchsorted(of, np.arange(len(texts) + 1))
            yield pd.Series([no[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], dtype=object)

    return run(doc_id, text)


def _deal_lines(batches: Iterator[pa.RecordBatch], min_chars: int, shards: int, hot: dict) -> Iterator[pa.RecordBatch]:
    """(shard, rk, doc_id, line_no, h1, h2) of lines; those with hot keys are judged here: dropped ones have shard -1."""
    index = Shard(hot)
    for b in batches:
        of, no, _, h1, h2 = hashed(b.column(2).cast(pa.binary()).to_pylist(), min_chars)
        ids = b.column(1).cast(pa.int64())
        v = verdicts(index, _ids(ids)[of], h1, h2, UNKNOWN)
        stay = v != KEEP
        cols = [np.where(v == DROP, -1, shard_of(h1, shards)).astype("i4"), b.column(0).to_numpy()[of], ids.take(pa.array(of)), no, h1, h2]
        yield pa.RecordBatch.from_arrays([(pa.array(c) if isinstance(c, np.ndarray) else c).filter(pa.array(stay)) for c in cols], ["shard", "rk", "doc_id", "line_no", "h1", "h2"])


def _probe_shard(index: pa.Table, lines: pa.Table) -> pa.Table:
    lines = lines.combine_chunks()
    if not index.num_rows or not lines.num_rows:
        return lines.slice(0, 0).select(["rk", "doc_id", "line_no"])
    v = verdicts(Shard(index.to_pylist()[0]), _ids(lines["doc_id"].combine_chunks()), lines["h1"].to_numpy(), lines["h2"].to_numpy(), KEEP)
    return lines.filter(pa.array(v == DROP)).select(["rk", "doc_id", "line_no"])


def probed_apart(d: DataFrame, arrays: DataFrame, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    """(rk, doc_id, dropped: sorted line numbers) for the rows of ``d`` (rk, doc_id, text) that lose lines."""
    total = arrays.agg(F.sum("lines")).first()[0] or 0
    found = np.frombuffer(b"".join(r["hot"] for r in arrays.select("hot").where(F.length("hot") > 0).collect()), "<i8").reshape(-1, 4)
    found = found[found[:, 3] * HOT_SHARE > total]
    hot = build_arrays(found[:, 0].copy(), found[:, 1].copy(), np.full(len(found), min_docs), found[:, 3].copy(), found[:, 2].copy(), min_docs)
    lines = staged(d.select("rk", "doc_id", "text").mapInArrow(partial(_deal_lines, min_chars=min_chars, shards=shards, hot=hot), LINES), "line-hashes")
    cold = lines.where("shard >= 0")
    there = arrays.select(*PROBED).groupBy("shard").cogroup(cold.groupBy("shard")).applyInArrow(_probe_shard, "rk bigint, doc_id bigint, line_no int")
    out = there.unionByName(lines.where("shard < 0").select("rk", "doc_id", "line_no"))
    return out.groupBy("rk", "doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int | None = None, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` with two columns more: ``_lines`` (all lines of the text) and ``_dropped`` (numbers of those to drop).

    A line's key is stripped of white space and A-Z lower-cased; keys of at least ``min_chars`` code points found in at
    least ``min_docs`` documents lose all lines except in the largest doc_id holding them. Null or empty text is one
    empty line. Every row counts as a document, repeated rows too; rows that share the largest doc_id all keep. A null
    doc_id ranks below all others; where all are null nothing is dropped. Other columns pass through, but for columns of
    the two new names, which are replaced. An empty table gives an empty result.
    """
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text).alias("rk"))
    arrays, shards = line_arrays(plain, min_chars, min_docs, shards)
    size = sum((F.length(c) for c in PROBED[1:]), F.lit(0))
    if (arrays.agg(F.sum(size)).first()[0] or 0) <= max_broadcast:
        d = docs.withColumn("_dropped", probed_here(arrays, shards, min_chars, F.col(doc_id).cast("bigint"), F.col(text)))
    else:
        drops = probed_apart(plain, arrays, shards, min_chars, min_docs)
        d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(doc_id).cast("bigint").alias("_id"), row_key(doc_id, text).alias("_rk"))
        d = d.join(drops, (F.col("_rk") == F.col("rk")) & F.col("_id").eqNullSafe(F.col("doc_id")), "left")
        d = d.select(*(F.col("_row")[c].alias(c) for c in docs.columns if c not in ("_lines", "_dropped")), F.col("dropped").alias("_dropped"))
    return d.withColumns({"_lines": F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), "_dropped": F.coalesce("_dropped", F.array().cast("array<int>"))})


def kept_text():
    """The lines that stay, joined by line feeds; needs the columns of :func:`dedup_lines`."""
    kept = F.filter("_lines", lambda x, i: ~F.array_contains("_dropped", i))
    return F.when(F.size("_dropped") == 0, F.array_join("_lines", "\n")).otherwise(F.array_join(kept, "\n"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), F.size("_dropped").cast("long").alias("n_dropped"), F.sha2(kept_text(), 256).alias("kept_sha256"))
