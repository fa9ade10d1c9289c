"""Compression of vectors to codes: product quantisation with codebooks trained by Yinyang Lloyd rounds.

Components become integers, vectors are cut into equal parts, and each part position has a codebook of at most 256
entries. A round assigns every part to its nearest entry and moves every entry to the mean of its parts. The entries are
clustered into groups once; for each part and group a row keeps one lower bound of its distance to the group's entries
other than its own. A round lowers the bound by the group's drift, the farthest that any of its entries moved, and scans
only groups whose bound then fails against the exact distance to the row's own entry. Bounds are rounded down, so a skipped
entry is strictly farther and cannot even tie. Distances that lie within the rounding of floats are compared again
in integers, so ties go to the lower index, exactly.

Rows and their bounds are written once a round, next to each other, so no round shuffles vectors. What meets is sums: a
row for each entry from each task. Only the codebooks, of a size that the parameters give, travel to every task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import join_hot, shared_dir

#: Above this size of a component sums of squares may leave 64 bits; integers of any size take over.
NARROW = 1 << 27
MAX_LONG = (1 << 63) - 1
#: Rows worked on at a time.
CHUNK = 2048
#: Rounding of a float distance, as a part of the squared lengths that go into it.
FLOAT_ERROR = 2.0**-40


@dataclass(frozen=True)
class CodeOptions:
    """entries is at most 256, as a code's index is one byte. groups is about a tenth of entries, as is usual."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    groups: int = 24


@dataclass
class Codebooks:
    """entries[p] holds the integer entries of part p, drift[p] how far each group moved, groups[p] each entry's group."""

    entries: list[np.ndarray]
    groups: list[np.ndarray]
    drift: list[np.ndarray] | None = None


def integers(x: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x), as 64-bit or, where wide, as Python's integers."""
    if not wide:
        return np.floor(x.astype("f8") * scale).astype("i8")
    return np.array([[int(scale * v // 1) if abs(v) < 2.0**900 else int(v) * scale for v in row] for row in x.astype("f8").tolist()], object).reshape(x.shape)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows that stand side by side."""
    d = x - c
    return (d * d).sum(axis=1)


def group_entries(c: np.ndarray, groups: int, steps: int = 5) -> np.ndarray:
    """The group of every entry, by a few Lloyd steps from entries spread over the codebook."""
    x = c.astype("f8")
    g = max(1, min(groups, len(x)))
    centres = x[np.linspace(0, len(x) - 1, g).astype(int)] if len(x) else x
    of = np.zeros(len(x), int)
    for _ in range(steps):
        of = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1) if len(x) else of
        centres = np.array([x[of == i].mean(0) if (of == i).any() else centres[i] for i in range(len(centres))])
    return np.unique(of, return_inverse=True)[1].reshape(-1)


def nearest(x: np.ndarray, c: np.ndarray, groups: np.ndarray, own: np.ndarray | None = None, bounds: np.ndarray | None = None, drift: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, exact squared distance, new bounds, entries scanned) of integer rows ``x``.

    ``own`` and ``bounds`` come from the round before; without them every group is scanned.
    """
    n, k, t = len(x), len(c), int(groups.max()) + 1
    xf, cf = x.astype("f8"), c.astype("f8")
    xx, cc = (xf * xf).sum(1), (cf * cf).sum(1)
    slack = FLOAT_ERROR * (xx + cc.max())
    d = np.full((n, k), np.inf)
    if own is None:
        scan = np.ones((n, t), bool)
        lower = np.zeros((n, t))
    else:
        d[np.arange(n), own] = at_own = squared(x, c[own]).astype("f8")
        upper = np.sqrt(at_own + slack) * (1 + 1e-9)
        lower = bounds.astype("f8") - drift
        scan = lower <= upper[:, None]
    scanned = np.zeros(n, "i4")
    for g in range(t):
        rows, members = np.flatnonzero(scan[:, g]), np.flatnonzero(groups == g)
        if len(rows):
            scanned[rows] += len(members)
            d[np.ix_(rows, members)] = xx[rows, None] - 2 * (xf[rows] @ cf[members].T) + cc[members]
    best = d.argmin(1)
    close = d <= (d[np.arange(n), best] + 2 * slack)[:, None]
    for i in np.flatnonzero(close.sum(1) > 1):
        e = np.flatnonzero(close[i])
        best[i] = e[np.argmin(squared(np.broadcast_to(x[i], (len(e), x.shape[1])), c[e]))]  # the first of equals
    others = d.copy()
    others[np.arange(n), best] = np.inf
    for g in range(t):
        members = np.flatnonzero(groups == g)
        seen = np.sqrt(np.maximum(others[:, members].min(1) - slack, 0))
        lower[:, g] = np.where(scan[:, g], seen, np.minimum(lower[:, g], seen))
    down = np.nextafter(lower.astype("f4"), np.float32(-np.inf))
    return best, squared(x, c[best]), np.minimum(down, np.finfo("f4").max), scanned


def _matrix(b: pa.RecordBatch, name: str, n: int) -> np.ndarray:
    values = b.column(name).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(n, len(values) // n)


def _binary(a: np.ndarray) -> pa.Array:
    """Rows of fixed-size values as binary values."""
    a = np.ascontiguousarray(a)
    size = a.shape[1] * a.itemsize
    offsets = np.arange(len(a) + 1, dtype="i4") * size
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(a.tobytes())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, CHUNK):
            yield b.slice(i, CHUNK)


def _assign(batches: Iterator[pa.RecordBatch], books: Codebooks, o: CodeOptions, wide: bool, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
    sizes = [int(g.max()) + 1 for g in books.groups]
    for b in _cut(batches):
        n = b.num_rows
        x = integers(_matrix(b, "embedding", n), o.scale, wide)
        d = x.shape[1] // o.parts
        if not first:
            own = np.frombuffer(b"".join(b.column("code").to_pylist()), "u1").reshape(n, o.parts)
            bounds = np.frombuffer(b"".join(b.column("bounds").to_pylist()), "f4").reshape(n, -1)
        code, lower, error, scanned, at = np.empty((n, o.parts), "u1"), [], 0, 0, 0
        for p in range(o.parts):
            was = (None, None, None) if first else (own[:, p].astype(int), bounds[:, at : at + sizes[p]], books.drift[p])
            best, dist, low, seen = nearest(x[:, p * d : (p + 1) * d], books.entries[p], books.groups[p], *was)
            code[:, p], error, scanned, at = best, error + dist, scanned + seen, at + sizes[p]
            lower.append(low)
        keep = [b.column("vec_id"), b.column("label")]
        if last:
            error = pa.array([min(int(e), MAX_LONG) for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([*keep, _binary(code), error, pa.array(scanned)], names=["vec_id", "label", "code", "error", "scanned"])
        else:
            yield pa.RecordBatch.from_arrays([*keep, b.column("embedding"), _binary(code), _binary(np.concatenate(lower, 1)), pa.array(scanned)], names=["vec_id", "label", "embedding", "code", "bounds", "scanned"])


def _sums(batches: Iterator[pa.RecordBatch], o: CodeOptions, wide: bool) -> Iterator[pa.RecordBatch]:
    """(slot, n, sums as text) of a task's rows; a slot is an entry of a part."""
    total = count = None
    for b in _cut(batches):
        x = integers(_matrix(b, "embedding", b.num_rows), o.scale, wide)
        x = x.reshape(b.num_rows, o.parts, x.shape[1] // o.parts)
        slot = np.frombuffer(b"".join(b.column("code").to_pylist()), "u1").reshape(-1, o.parts) + np.arange(o.parts) * o.entries
        if total is None:
            total, count = np.zeros((o.parts * o.entries, x.shape[2]), object if wide else "i8"), np.zeros(o.parts * o.entries, "i8")
        np.add.at(total, slot.reshape(-1), x.reshape(len(slot) * o.parts, x.shape[2]))
        count += np.bincount(slot.reshape(-1), minlength=len(count))
    if total is not None:
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array([[str(v) for v in total[i].tolist()] for i in used], pa.list_(pa.string()))], names=["slot", "n", "sums"])


def _means(d: pd.DataFrame) -> pd.DataFrame:
    n = int(d["n"].sum())
    return pd.DataFrame({"slot": d["slot"].iloc[:1], "mean": [[str(sum(map(int, col)) // n) for col in zip(*d["sums"], strict=True)]]})


def moved(books: Codebooks, means: dict[int, list[int]], o: CodeOptions, wide: bool) -> Codebooks:
    """The codebooks with used entries at their means, and how far each group drifted at most (rounded up)."""
    entries, drift = [], []
    for p, (old, of) in enumerate(zip(books.entries, books.groups, strict=True)):
        new = old.copy()
        for i in range(len(old)):
            if (mean := means.get(p * o.entries + i)) is not None:
                new[i] = mean
        far = np.sqrt(squared(new, old).astype("f8")) * (1 + 1e-9)
        entries.append(new)
        drift.append(np.array([far[of == g].max() for g in range(int(of.max()) + 1)]))
    return Codebooks(entries, books.groups, drift)


class _Table:
    """A round's rows in the shared folder; dropped once the next round has its own."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, f"{shared_dir(df.sparkSession)}/timberline/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def kept_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = "label") -> DataFrame:
    """(vec_id, label, embedding) of the rows whose vector is there, with finite components only."""
    v = vectors.select(F.col(vec_id).alias("vec_id"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"), F.col(embedding).alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))


def first_books(v: DataFrame, o: CodeOptions, wide: bool) -> Codebooks:
    """Parts of the vectors of least vec_id, nulls last; of one id the least vector first."""
    rows = [r["embedding"] for r in v.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(o.entries).collect()]
    x = integers(np.array(rows), o.scale, wide)
    parts = np.split(x, o.parts, axis=1)
    return Codebooks(parts, [group_entries(p, o.groups) for p in parts])


def text_of(books: Codebooks) -> str:
    return ",".join(str(int(v)) for part in books.entries for entry in part for v in entry)


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = "label", o: CodeOptions = CodeOptions()) -> tuple[DataFrame, Codebooks | None, list[int]]:
    """((vec_id, label, code, error, scanned) of every kept vector, the final codebooks, entries scanned in each round).

    code is one byte for each part, error the exact squared distance to what it stands for (at most 2**63 - 1). A vector that is
    null or holds a null or non-finite component is left out; of repeated rows each has its row. A null vec_id or label is
    kept, and comes last among those that start the codebooks. Fewer rows than entries give smaller codebooks; no rows
    give an empty table and no codebooks. Other columns play no part. All vectors must have one length that
    the parts divide; else a ValueError says so.
    """
    v = kept_vectors(vectors, vec_id, embedding, label)
    sizes = v.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("far")).first()
    types = {f.name: f.dataType.simpleString() for f in v.schema}
    out = f"vec_id {types['vec_id']}, label {types['label']}, code binary, error bigint, scanned int"
    if sizes["low"] is None:
        return v.sparkSession.createDataFrame([], out), None, []
    if sizes["low"] != sizes["high"] or sizes["low"] % o.parts:
        raise ValueError(f"vectors have {sizes['low']} to {sizes['high']} components; they must have one length, a multiple of {o.parts}")
    wide = float(sizes["far"] or 0) * o.scale >= NARROW
    books = first_books(v, o, wide)
    state = f"vec_id {types['vec_id']}, label {types['label']}, embedding {types['embedding']}, code binary, bounds binary, scanned int"
    table, scanned = None, []
    for r in range(o.rounds):
        rows = v if table is None else table.df
        new = _Table(rows.mapInArrow(partial(_assign, books=books, o=o, wide=wide, first=table is None, last=False), state), "vector-codes")
        if table is not None:
            table.drop()
        table = new
        means = table.df.select("embedding", "code").mapInArrow(partial(_sums, o=o, wide=wide), "slot int, n bigint, sums array<string>").groupBy("slot").applyInPandas(_means, "slot int, mean array<string>")
        books = moved(books, {m["slot"]: list(map(int, m["mean"])) for m in means.collect()}, o, wide)
        scanned.append(table.df.agg(F.sum("scanned")).first()[0])
    last = _Table((v if table is None else table.df).mapInArrow(partial(_assign, books=books, o=o, wide=wide, first=table is None, last=True), out), "vector-codes")
    if table is not None:
        table.drop()
    scanned.append(last.df.agg(F.sum("scanned")).first()[0])
    return last.df, books, scanned


def decode(codes: DataFrame, books: Codebooks, o: CodeOptions = CodeOptions()) -> DataFrame:
    """``codes`` with ``decoded``, the vector that each code stands for."""
    flat = [c.astype("f8") / o.scale for c in books.entries]

    @F.pandas_udf("array<double>")
    def run(code: pd.Series) -> pd.Series:
        return code.map(lambda c: None if c is None else np.concatenate([e[i] for e, i in zip(flat, c, strict=True)]))

    return codes.withColumn("decoded", run("code"))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over the rows of equal label, nulls together."""
    d = codes.withColumn("_l", F.when(F.col("label").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("label").cast("string"))))
    sums = d.groupBy("_l").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"), F.count("*").alias("_n"))
    sums = sums.select("_l", F.least("_sum", F.lit(MAX_LONG)).cast("bigint").alias("label_error"), "_n")
    return join_hot(d, sums, ["_l"], "_n").drop("_l", "_n")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books, _ = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sha = hashlib.sha256(text_of(books).encode()).hexdigest() if books else ""
    return with_label_errors(codes).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _nearest_sql(r: int) -> str:
    return f"""
a{r} AS MATERIALIZED (SELECT v.r, v.p, min(CAST(xx - 2 * list_inner_product(x, c) + cc AS BIGINT) * 256 + e) AS best FROM v JOIN b{r} USING (p) GROUP BY v.r, v.p)"""


def _moved_sql(r: int) -> str:
    return f"""{_nearest_sql(r)},
m{r} AS (SELECT p, e, list(m ORDER BY k) AS c FROM (SELECT a.p, a.best % 256 AS e, k, floor(sum(v.x[k]) / count(*)) AS m FROM a{r} a JOIN v USING (r, p), unnest(range(1, len(v.x) + 1)) AS u(k) GROUP BY ALL) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT p, e, c, list_inner_product(c, c) AS cc FROM (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (p, e)))"""


OP13_SQL = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS y FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, p, x, list_inner_product(x, x) AS xx FROM (SELECT r, p, y[p * len(y) // 4 + 1 : (p + 1) * len(y) // 4] AS x FROM k, unnest(range(0, 4)) AS t(p))),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c, xx AS cc FROM v WHERE r <= 256),{','.join(_moved_sql(r) for r in range(4))},{_nearest_sql(4)},
s AS (SELECT sha256(string_agg(CAST(CAST(c[k] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, k)) AS codebooks_sha256 FROM b4, unnest(range(1, len(c) + 1)) AS u(k)),
o AS (SELECT r, string_agg(lower(printf('%02x', best % 256)), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a4 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN o USING (r), s
"""
