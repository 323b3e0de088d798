"""Operator 11: embedding whitening by bit-sliced scatter matrices."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.llm.store import cut, discard

#: Fixed values of the integer scale: x = floor(SCALE * entry) + ORIGIN.
SCALE, ORIGIN = 64, 1_000_000
#: Components returned, rows that are bit-sliced at a time, and the least share of the largest eigenvalue that counts as above 0.
COMPONENTS, BLOCK, RANK = 16, 8192, 1e-13
_LIMIT = 2**62
_HALF = 30      # sums travel as (value >> 30, value & (2**30 - 1)), so that Spark's long sums stay exact


def integer_vectors(df: DataFrame, vector: str = "embedding") -> Column:
    """``array<long>`` of each row's x; null where the vector is null or empty or has an unusable entry.

    Unusable are null, NaN and infinite entries, and those whose x would not fit a long.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c) < F.lit(float(_LIMIT // SCALE)), F.lit(False)))  # NaN is above all
    return F.when(fine & (F.size(v) > 0), F.transform(v, lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(ORIGIN)))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each vector length in an Arrow column of lists."""
    values, ends = np.asarray(column.values), np.asarray(column.offsets)
    size = np.diff(ends)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, values[ends[:-1][rows][:, None] + np.arange(d)]


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes, dimension, bit): plane p holds bit ``bit[p]`` of ``dimension[p]`` of all rows, 64 rows in a word.

    ``y``: rows x dimensions, not negative.  Planes above a dimension's highest set bit are left out.
    """
    rows, dims = y.shape
    t = np.ascontiguousarray(y.T).astype(np.uint64)
    highest = [int(m).bit_length() for m in t.max(axis=1)]
    words = -(-rows // 64)
    planes, dimension, bit = [], [], []
    for b in range(max(highest, default=0)):
        has = np.flatnonzero(np.array(highest) > b)
        packed = np.zeros((len(has), words * 8), np.uint8)
        packed[:, :-(-rows // 8)] = np.packbits(((t[has] >> np.uint64(b)) & np.uint64(1)).astype(bool), axis=1)
        planes.append(packed.view(np.uint64))
        dimension.append(has)
        bit.append(np.full(len(has), b))
    if not planes:
        return np.zeros((0, words), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(planes), np.concatenate(dimension), np.concatenate(bit)


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, products) of the rows of ``x`` about ORIGIN, exact (whole numbers of any size).

    Each dimension is shifted by its least value; a product is the sum over
    pairs of bit planes of 2**(a + b) times the popcount of their AND, and
    the shifts are put back afterwards.
    """
    rows, dims = x.shape
    low = x.min(axis=0)
    planes, dimension, bit = bit_planes(x - low)
    both = np.zeros((len(planes), len(planes)), np.int64)
    for p in range(len(planes)):
        both[p, p:] = both[p:, p] = np.bitwise_count(planes[p:] & planes[p]).sum(axis=1, dtype=np.int64)
    top = int(bit.max(initial=0)) + 1
    far = max(abs(int(low.min()) - ORIGIN), abs(int(low.max()) - ORIGIN)) + (1 << top)
    kind = np.int64 if rows * far * far < _LIMIT else object
    weight = np.zeros((dims, len(planes)), kind)
    weight[dimension, np.arange(len(planes))] = [kind(1) << kind(b) if kind is np.int64 else 1 << int(b) for b in bit]
    both = both.astype(kind)
    y, yy = weight @ np.diagonal(both), weight @ both @ weight.T
    base = low.astype(kind) - kind(ORIGIN) if kind is np.int64 else np.array([int(v) - ORIGIN for v in low], object)
    shift = np.outer(base, y)
    return y + rows * base, yy + shift + shift.T + rows * np.outer(base, base)


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per vector length of the task: its row count, sums and upper products, in two halves."""
    total: dict[int, list] = {}
    for batch in batches:
        for _, x in _matrices(batch.column(0)):
            for at in range(0, len(x), BLOCK):
                part = x[at:at + BLOCK]
                s, g = cross_products(part)
                have = total.setdefault(x.shape[1], [0, 0, 0])
                have[0] += len(part)
                have[1] = have[1] + s.astype(object)
                have[2] = have[2] + g[np.triu_indices(len(g))].astype(object)
    for dims, (n, s, g) in total.items():
        values = [n, *s, *g]
        yield pa.RecordBatch.from_pydict({
            "dims": pa.array([dims], pa.int32()),
            "hi": pa.array([[int(v) >> _HALF for v in values]], pa.list_(pa.int64())),
            "lo": pa.array([[int(v) & ((1 << _HALF) - 1) for v in values]], pa.list_(pa.int64()))})


@dataclass
class Space:
    """The fit of one vector length: ``basis`` has a unit eigenvector per column, ``values`` their eigenvalues."""

    n: int
    sums: list[int]         # about ORIGIN
    basis: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0


def eigen(scatter: list[list[int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of ``scatter / n**2`` (whole numbers).

    eigh starts in double precision; two steps of refinement in extended
    precision make small eigenvalues accurate beside large ones.
    """
    high = np.array([[float(v) for v in row] for row in scatter])
    rest = np.array([[float(v - int(h)) for v, h in zip(row, hs, strict=True)] for row, hs in zip(scatter, high, strict=True)])
    v = (high.astype(np.longdouble) + rest) / np.longdouble(n) / np.longdouble(n)
    q = np.linalg.eigh(v.astype(np.float64))[1].astype(np.longdouble)
    for _ in range(2):
        r, s = np.eye(len(v), dtype=np.longdouble) - q.T @ q, q.T @ v @ q
        lam = np.diagonal(s) / (1 - np.diagonal(r))
        gap = lam[None, :] - lam[:, None]
        near = np.abs(gap) <= 1e-14 * np.abs(lam).max(initial=0)
        step = np.where(near, r / 2, (s + lam[None, :] * r) / np.where(near, 1, gap))
        q = q + q @ step
    order = np.argsort(-lam, kind="stable")
    q = q[:, order]
    return lam[order].astype(np.float64), (q / np.sqrt((q * q).sum(axis=0))).astype(np.float64)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Space]:
    """Whitening of the distinct integer vectors in the only column of ``vectors``, by vector length.

    The products are summed by entry in Spark; only dims**2 numbers of each
    length come to the driver, whatever the rows.  Components whose
    eigenvalue is 0 are left out.
    """
    parts = vectors.mapInArrow(_scatter, "dims int, hi array<long>, lo array<long>")
    entry = parts.select("dims", F.posexplode(F.arrays_zip("hi", "lo")).alias("pos", "v"))
    rows = entry.groupBy("dims", "pos").agg(F.sum("v.hi").alias("hi"), F.sum("v.lo").alias("lo")).collect()
    spaces, found = {}, {}
    for r in rows:
        found.setdefault(r.dims, {})[r.pos] = (r.hi << _HALF) + r.lo
    for d, values in found.items():
        n, s = values[0], [values[1 + i] for i in range(d)]
        at = iter(range(1 + d, len(values)))
        g = [[0] * d for _ in range(d)]
        for i in range(d):
            for j in range(i, d):
                g[i][j] = g[j][i] = n * values[next(at)] - s[i] * s[j]
        lam, q = eigen(g, n)
        trace = sum(g[i][i] for i in range(d)) / (n * n)
        k = int(np.sum(lam[:components] > RANK * max(lam.max(initial=0), 0.0))) if trace > 0 else 0
        spaces[d] = Space(n, s, q[:, :k], lam[:k], lam[:k] / trace if k else lam[:0])
    return spaces


def _project(x: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """(deviation, whitened) of integer vectors; a deviation beyond a long is None."""
    far = space.n * (np.abs(x.astype(np.float64) - ORIGIN).max(initial=0) + 1) + max(map(abs, space.sums), default=0)
    kind = np.int64 if far * far * x.shape[1] < _LIMIT else object
    d = (x.astype(kind) - ORIGIN) * space.n - np.array(space.sums, kind)
    dev = (d * d).sum(axis=1)
    if kind is object:
        dev = np.array([int(v) if v < 2**63 else None for v in dev], object)
    return dev, (d.astype(np.float64) / space.n) @ space.basis / np.sqrt(space.values)


def _spread(spaces: dict[int, Space]):
    """Sums of the whitened fit vectors and of their products, per vector length and task."""
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                w = _project(x, spaces[x.shape[1]])[1]
                part = np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))
                total[x.shape[1]] = total.get(x.shape[1], 0) + part
        for d, v in total.items():
            yield pa.RecordBatch.from_pydict({"dims": pa.array([d], pa.int32()), "v": pa.array([v], pa.list_(pa.float64()))})
    return run


def measure(vectors: DataFrame, spaces: dict[int, Space]) -> dict[int, Space]:
    """Set each space's ``identity_error`` from the whitened fit vectors themselves."""
    entry = vectors.mapInArrow(_spread(spaces), "dims int, v array<double>").select("dims", F.posexplode("v").alias("pos", "v"))
    found: dict[int, dict] = {}
    for r in entry.groupBy("dims", "pos").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r.dims, {})[r.pos] = r.v
    for d, v in found.items():
        s, k = spaces[d], len(spaces[d].values)
        mean = np.array([v[i] for i in range(k)]) / s.n
        cov = np.array([v[k + i] for i in range(k * k)]).reshape(k, k) / s.n - np.outer(mean, mean)
        s.identity_error = float(np.abs(cov - np.eye(k)).max(initial=0))
    return spaces


def whiten(df: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",),
           components: int = COMPONENTS) -> DataFrame:
    """``keep``, n, deviation, whitened array, explained array, identity_error of every usable vector.

    Entries become whole numbers first; the fit counts each distinct vector
    once, all rows are projected.  Rows whose vector is null, empty or has a
    null, NaN or infinite entry (or one beyond 2**56) are left out; repeated
    rows and null ids are kept.  Vectors of different lengths are whitened
    apart, each length with its own n.  Equal vectors only: empty arrays.  An
    empty table: no rows.  Other columns of ``df`` are not read, so their
    names can't clash.
    """
    names = [f"k{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)],
                     integer_vectors(df, vector).alias("x")).where("x IS NOT NULL")
    distinct = cut(rows.select("x").distinct())
    spaces = measure(distinct, fit(distinct, components))
    discard(distinct)
    kept = rows.select(*names).schema
    floats = pa.list_(pa.float64())

    def run(batches):
        for batch in batches:
            for at, x in _matrices(batch.column(len(names))):
                s = spaces[x.shape[1]]
                dev, w = _project(x, s)
                m, k = len(at), len(s.values)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).take(pa.array(at)) for i in range(len(names))],
                     pa.array([s.n] * m, pa.int64()), pa.array(dev, pa.int64()),
                     pa.ListArray.from_arrays(np.arange(0, m * k + 1, k, dtype=np.int32) if k else np.zeros(m + 1, np.int32), w.ravel()),
                     pa.array([s.explained] * m, floats), pa.array([s.identity_error] * m, pa.float64())],
                    names=[*names, "n", "deviation", "whitened", "explained", "identity_error"])

    fields = [*[f"{f.name} {f.dataType.simpleString()}" for f in kept.fields],
              "n long", "deviation long", "whitened array<double>", "explained array<double>", "identity_error double"]
    out = rows.mapInArrow(run, ", ".join(fields))
    return out.withColumnsRenamed(dict(zip(names, keep, strict=True)))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """Up to 16 whitened components of every embedding."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    both = F.posexplode(F.arrays_zip("whitened", "explained")).alias("_i", "_v")
    return out.select("vec_id", "n", "deviation", "identity_error", both).select(
        "vec_id", (F.col("_i") + 1).alias("component"), "n", "deviation", F.col("_v.whitened").alias("whitened"),
        F.col("_v.explained").alias("explained"), "identity_error")
