"""Dense products of row matrices with small parameter matrices, and their gradients."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

VECTOR = ArrayType(DoubleType())


def to_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column as rows of a matrix; no copy where the batch allows it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _given(column: pa.Array) -> np.ndarray:
    """Array columns as matrices, others as vectors."""
    return to_matrix(column) if pa.types.is_list(column.type) else column.to_numpy(zero_copy_only=False)


def to_column(m: np.ndarray) -> pa.Array:
    n, d = m.shape
    flat = pa.array(np.ascontiguousarray(m, dtype=np.float64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)), flat) if d else pa.array([[]] * n, pa.list_(pa.float64()))


def map_rows(df: DataFrame, fn: Callable[..., dict[str, np.ndarray]], inputs: list[str], outputs: list[str], keep: list[str]) -> DataFrame:
    """Runs fn over Arrow batches: input columns come as matrices (arrays) or vectors, outputs are new array columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = fn(*(_given(batch[c]) for c in inputs))
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *(to_column(got[c]) for c in outputs)], [*keep, *outputs])

    fields = [df.schema[c] for c in keep] + [StructField(c, VECTOR) for c in outputs]
    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, StructType(fields))


def matmul(x: DataFrame, w: np.ndarray, feat: str = "feat", transpose_x: bool = False, transpose_w: bool = False, factor: float = 1.0) -> DataFrame:
    """factor * X W, rows (vid, feat) by a parameter matrix, with all four transpose cases.

    X W and X W' stay row by row: blocks of rows go through one BLAS call. X' W needs W as rows too: see gram(). The
    parameter matrix is layer sizes squared, whatever the data."""
    if transpose_x:
        raise ValueError("X' G is gram(); both operands are rows of the data")
    m = (w.T if transpose_w else w) * factor
    return map_rows(x, lambda a: {feat: a @ m}, [feat], [feat], [c for c in x.columns if c != feat])


def gram(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(i, j, val): A' B summed over all rows; a block product in each task, then a sum of as many small matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = to_matrix(batch[a]).T @ to_matrix(batch[b])
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "val"])

    return rows.select(a, b).mapInArrow(run, "i int, j int, val double").groupBy("i", "j").agg(F.sum("val").alias("val"))


def gram_sums(rows: DataFrame, inputs: list[str], pairs: Callable[..., dict[int, tuple[np.ndarray, np.ndarray]]]) -> dict[int, np.ndarray]:
    """Sums A' B over all rows for several pairs of matrices at once, each made by pairs() from the input columns of a
    block. Every task sends one small matrix a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for k, (a, b) in pairs(*(_given(batch[c]) for c in inputs)).items():
                    total[k] = total[k] + a.T @ b if k in total else a.T @ b
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), pa.array([total[k].shape[1] for k in keys], pa.int32()), pa.array([total[k].ravel() for k in keys], pa.list_(pa.float64()))], ["k", "cols", "m"]
            )

    parts = rows.select(*inputs).mapInArrow(run, "k int, cols int, m array<double>")
    flat = parts.select("k", "cols", F.posexplode("m").alias("at", "v")).groupBy("k", "cols", "at").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    got: dict[int, list] = {}
    for r in flat.collect():  # as many rows as the parameters have elements
        got.setdefault(r["k"], []).append((r["at"], r["v"], r["cols"]))
    for k, entries in got.items():
        entries.sort()
        out[k] = np.array([v for _, v, _ in entries]).reshape(-1, entries[0][2])
    return out


def collect_matrix(entries: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """(i, j, val) of a parameter-sized matrix to the driver."""
    out = np.zeros(shape)
    for r in entries.collect():
        out[r["i"], r["j"]] = r["val"]
    return out


def to_long(df: DataFrame, feat: str = "feat", key: str = "vid") -> DataFrame:
    return df.select(key, F.posexplode(feat).alias("i", "val"))


def transpose(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "val")


def sum_all(entries: DataFrame) -> DataFrame:
    """One row: plain sum and sum of absolute values (the checksum)."""
    return entries.agg(F.sum("val").alias("total"), F.sum(F.abs("val")).alias("abs_total"))
