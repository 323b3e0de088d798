"""Sums of products of many columns in Arrow batches (M1, A15 for wide designs).

``p`` columns have ``p (p + 1) / 2`` products: as SQL aggregates some
hundreds of columns are past what Spark compiles.  Here a batch's columns
are one matrix and its products one matrix multiplication per person; a task
adds them up per person, emits each person's sums once (or whenever its
table of sums is full), and Spark sorts and adds the tasks' rows in order.
A person costs one row per task from the first shuffle on, however many
rows it has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

HELD = 4_000_000        # sums (doubles) that a task holds before it emits them
PIECE = 1_000_000       # sums of neighbouring rows that are added up at a time


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    """The columns from ``first`` on as rows x columns; nulls are NaN."""
    out = np.empty((batch.num_rows, batch.num_columns - first))
    for j in range(first, batch.num_columns):
        out[:, j - first] = batch.column(j).to_numpy(zero_copy_only=False)
    return out


def _per_key(batches: Iterator[pa.RecordBatch], schema: pa.Schema, one: bool) -> Iterator[pa.RecordBatch]:
    """Partial (key, n, g): column 0 is the key, the others the factors."""
    held: dict = {}

    def emit():
        keys = pa.array(list(held), schema.field(0).type)
        rows = pa.array([v[0] for v in held.values()], pa.int64())
        sums = pa.array([v[1] for v in held.values()], pa.list_(pa.float64()))
        held.clear()
        return pa.RecordBatch.from_arrays([keys, rows, sums], schema=schema)

    upper = None
    for batch in batches:
        x = _matrix(batch, 1)
        if one:
            x = np.concatenate((np.ones((len(x), 1)), x), axis=1)
        upper = np.triu_indices(x.shape[1]) if upper is None else upper
        place: dict = {}
        code = np.array([place.setdefault(v, len(place)) for v in batch.column(0).to_pylist()], np.int64)
        order = np.argsort(code, kind="stable")
        edges = np.searchsorted(code[order], np.arange(len(place) + 1))
        for key, at in place.items():
            part = x[order[edges[at]:edges[at + 1]]]
            have = held.setdefault(key, [0, 0.0])
            have[0] += len(part)
            have[1] = have[1] + (part.T @ part)[upper]
            if len(held) * len(upper[0]) > HELD:
                yield emit()
    if held:
        yield emit()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of (key, n, g) whose sums are about PIECE."""
    for batch in batches:
        step = max(1, PIECE // max(1, len(batch.column(2)[0]))) if batch.num_rows else 1
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


def _runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Adds up neighbouring rows of one key; rows come sorted by key, and are taken some PIECE sums at a time."""
    last = None
    for batch in _pieces(batches):
        keys = batch.column(0).to_pylist()
        n = batch.column(1).to_numpy()
        lists = batch.column(2)
        g = lists.flatten().to_numpy().reshape(len(keys), -1)
        starts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]]
        rows, sums = np.add.reduceat(n, starts), np.add.reduceat(g, starts, axis=0)
        out = [[keys[s], int(r), v] for s, r, v in zip(starts, rows, sums, strict=True)]
        if last is not None:
            if last[0] == out[0][0]:
                out[0][1] += last[1]
                out[0][2] = out[0][2] + last[2]
            else:
                out.insert(0, last)
        last = out.pop()
        if out:
            yield _batch(out, schema)
    if last is not None:
        yield _batch([last], schema)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(3)], schema=schema)


def gram_by_key(df: DataFrame, key: str, columns: Sequence[str], one: bool = False) -> DataFrame:
    """(key, n, g): rows and the upper triangle, row by row, of each key's sums of products of ``columns``.

    ``one``: a column of ones comes first.  All columns must be present
    (drop rows that lack one before).  A null key is a key.
    """
    kind = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n", T.LongType()),
                         T.StructField("g", T.ArrayType(T.DoubleType()))])
    arrow = pa.schema([pa.field(key, to_arrow_type(df.schema[key].dataType)), pa.field("n", pa.int64()), pa.field("g", pa.list_(pa.float64()))])
    rows = df.select(key, *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    part = rows.mapInArrow(lambda batches: _per_key(batches, arrow, one), kind)
    part = part.repartition(key).sortWithinPartitions(key)
    return part.mapInArrow(lambda batches: _runs(batches, arrow), kind)


def _pair_sums(batches: Iterator[pa.RecordBatch], centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per pair of columns: rows with both, and sums of a, b, aa, bb, ab over these, about ``centre``."""
    total = 0.0
    for batch in batches:
        x = _matrix(batch, 0)
        present = np.stack([np.asarray(batch.column(j).is_valid()) for j in range(batch.num_columns)], 1).astype(float)
        x = np.where(present > 0, x - centre, 0.0)
        cross = x.T @ present
        square = (x * x).T @ present
        total = total + np.stack([present.T @ present, cross, cross.T, square, square.T, x.T @ x])
    if np.ndim(total):
        i, j = np.triu_indices(total.shape[1], 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(t[i, j]) for t in total]],
                                         names=["i", "j", "n", "a", "b", "aa", "bb", "ab"])


def pairwise_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(var1, var2, r, n): Pearson correlations over the rows that have both columns.

    Sums are taken about the columns' means, so they lose nothing to large
    means.  r is null where a column doesn't vary over the rows.
    """
    columns = list(columns)
    x = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    centre = np.array([0.0 if v is None else v for v in x.agg(*[F.avg(c) for c in x.columns]).first()])
    part = x.mapInArrow(lambda batches: _pair_sums(batches, centre),
                        "i int, j int, n double, a double, b double, aa double, bb double, ab double")
    s = part.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")])
    n = F.col("n")
    vary = (n * F.col("aa") - F.col("a") ** 2) * (n * F.col("bb") - F.col("b") ** 2)
    r = F.when(vary > 0, (n * F.col("ab") - F.col("a") * F.col("b")) / F.sqrt(vary))
    name = F.array(*[F.lit(c) for c in columns])
    return s.select(F.get(name, F.col("i")).alias("var1"), F.get(name, F.col("j")).alias("var2"), r.alias("r"), n.cast("long").alias("n"))
