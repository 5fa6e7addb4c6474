"""Embedding whitening from an exact integer scatter."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyplan.llm import common

SCALE = 256
COMPONENTS = 4
#: Partial scatters are added up in so many shares of the partitions before all meet.
SHARES = 32
_LONG = np.iinfo(np.int64)


class Whitening(NamedTuple):
    """What the fit list says: its length, the sums of its vectors, and the components by falling eigenvalue."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def integers(vectors: pa.Array, scale: int = SCALE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x as int64) of the vectors that are neither null nor empty and have finite entries only, one length at a time.

    What doesn't fit into a long becomes the nearest long.
    """
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        flat = vectors.take(pa.array(rows)).flatten()
        entries = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, size)
        good = np.isfinite(entries).all(axis=1)
        with np.errstate(over="ignore"):
            x = np.floor(entries[good] * scale)
        high, low = x >= 2.0**63, x < -(2.0**63)
        x = np.where(high | low, 0, x).astype(np.int64)
        x[high], x[low] = _LONG.max, _LONG.min
        yield rows[good], x


def pack(x: np.ndarray) -> Iterator[pa.Array]:
    """Vectors as bytes, each with the narrowest integers that hold it, whose width is the first byte: equal vectors, equal bytes."""
    low, high = x.min(axis=1), x.max(axis=1)
    width = np.full(len(x), 8)
    for w in (4, 2, 1):
        bounds = np.iinfo(f"i{w}")
        width[(low >= bounds.min) & (high <= bounds.max)] = w
    for w in np.unique(width).tolist():
        some = x[width == w].astype(f"<i{w}")
        data = np.concatenate([np.full((len(some), 1), w, np.uint8), some.view(np.uint8).reshape(len(some), -1)], axis=1)
        offsets = np.arange(len(some) + 1, dtype=np.int64) * data.shape[1]
        yield pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def unpack(packed: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The vectors of ``size`` entries again, those of one width at a time."""
    lengths = pc.binary_length(packed).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths).tolist():
        some = packed.filter(pa.array(lengths == length))
        data = np.frombuffer(b"".join(some.to_pylist()), np.uint8).reshape(len(some), length)
        yield np.ascontiguousarray(data[:, 1:]).view(f"<i{(length - 1) // size}").astype(np.int64)


def _limbs(y: np.ndarray, room: int) -> list[np.ndarray]:
    """Summands of whole numbers, the k-th to be shifted by k * room bits; all but the last are below 2^room and not negative."""
    out = []
    while len(y) and max(int(y.max()), -int(y.min())) >> room:
        out.append(y & ((1 << room) - 1))
        y = y >> room
    return [*out, y]


def products(y: np.ndarray) -> np.ndarray:
    """The exact sum of y yᵀ over the rows, as Python integers: float products of limbs so small that none is rounded."""
    limbs = _limbs(y, room := (52 - len(y).bit_length()) // 2)
    parts = [part.astype(np.float64) for part in limbs]
    out = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            out += (a.T @ b).astype(np.int64).astype(object) * (1 << room * (i + j))
    return out


def squares(y: np.ndarray) -> np.ndarray:
    """The exact sum of squares of each row, as int64 where all fit and else as Python integers."""
    limbs = _limbs(y, room := (62 - int(y.shape[1]).bit_length()) // 2)
    limbs = [part.astype(np.int64) for part in limbs]
    if len(limbs) == 1:
        return (limbs[0] * limbs[0]).sum(axis=1)
    out = np.zeros(len(y), dtype=object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out += (a * b).sum(axis=1).astype(object) * (1 << room * (i + j))
    return out


def minus(x: np.ndarray, shift: list[int], times: int = 1) -> np.ndarray:
    """times * x - shift, exactly: int64 where that is large enough, else Python integers."""
    most = max(int(x.max()), -int(x.min())) if x.size else 0
    if most * times + max(map(abs, shift)) < 1 << 63:
        return x * times - np.array(shift, dtype=np.int64)
    return x.astype(object) * times - np.array(shift, dtype=object)


def _row(key: int, numbers: Iterable[int]) -> tuple[int, str]:
    return key, ",".join(map(str, numbers))


def _rows(rows: list[tuple[int, str]]) -> pa.RecordBatch:
    keys, texts = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(texts, pa.string())], ["line", "numbers"])


def _scatter(size: int, shift: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1), dtype=object)
        for batch in batches:
            for x in unpack(batch.column("x"), size):
                y = minus(x, shift)
                total += products(np.concatenate([np.ones((len(y), 1), y.dtype), y], axis=1))  # count and sums come with the cross-products
        if total[0, 0]:
            yield _rows([_row(k, line) for k, line in enumerate(total)])

    return run


def _adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, list[int]] = {}
    for batch in batches:
        for key, text in zip(batch.column("line").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
            numbers = list(map(int, text.split(",")))
            totals[key] = [a + b for a, b in zip(totals[key], numbers, strict=True)] if key in totals else numbers
    yield _rows([_row(k, v) for k, v in totals.items()])


def scatter(fit: DataFrame, size: int, shift: list[int]) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums of x, n XᵀX - S Sᵀ) of the table ``fit(x)``, all exact. The driver gets one row for each dimension.

    The last one doesn't depend on the shift, which only keeps the numbers small.
    """
    kind = "line int, numbers string"
    shares = fit.select("x").mapInArrow(_scatter(size, shift), kind).withColumn("share", F.spark_partition_id() % SHARES).repartition("line", "share").select("line", "numbers")
    lines = {r["line"]: list(map(int, r["numbers"].split(","))) for r in shares.mapInArrow(_adding, kind).repartition("line").mapInArrow(_adding, kind).collect()}
    n, *sums = lines[0]
    exact = [[n * v - sums[i] * sums[j] for j, v in enumerate(lines[i + 1][1:])] for i in range(size)]
    return n, [s + n * a for s, a in zip(sums, shift, strict=True)], exact


def decompose(n: int, sums: list[int], exact: list[list[int]], components: int = COMPONENTS) -> Whitening:
    """Eigenvectors of V = (n XᵀX - S Sᵀ) / n², whose entries are rounded once; an eigenvector's largest entry is positive."""
    v = np.array([[m / (n * n) for m in line] for line in exact], dtype=np.float64)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(sum(exact[i][i] for i in range(len(exact))) / (n * n))
    none = len(values) * np.finfo(np.float64).eps * max(values[0], 0.0)
    values = np.where(values > none, values, 0.0)[:components]
    vectors = vectors[:, :components]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Whitening(n, sums, vectors * np.where(signs == 0, 1, signs), values, values / trace if trace else np.zeros(len(values)))


def whitened(x: np.ndarray, fit: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """(n x - S exactly, its projections over n and the root of the eigenvalue); NaN for components without variance."""
    exact = minus(x, fit.sums, fit.n)
    with np.errstate(divide="ignore", invalid="ignore"):
        scores = (exact.astype(np.float64) / fit.n) @ fit.vectors / np.sqrt(fit.values)
    return exact, np.where(fit.values > 0, scores, np.nan)


def _moments(size: int, fit: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fit.values)
        sums, cross = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for x in unpack(batch.column("x"), size):
                w = np.nan_to_num(whitened(x, fit)[1])
                sums, cross = sums + w.sum(axis=0), cross + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([sums, cross.ravel()]).reshape(1, -1).tolist(), pa.list_(pa.float64()))], ["moments"])

    return run


def identity_error(fit_list: DataFrame, size: int, fit: Whitening) -> float:
    """The largest absolute entry of the fit list's whitened covariance minus the identity, over components with variance."""
    k = len(fit.values)
    parts = fit_list.select("x").mapInArrow(_moments(size, fit), "moments array<double>")
    m = np.array(parts.agg(*(F.sum(F.col("moments")[i]).alias(f"m{i}") for i in range(k + k * k))).first(), dtype=np.float64) / fit.n
    covariance = m[k:].reshape(k, k) - np.outer(m[:k], m[:k])
    some = fit.values > 0
    return float(np.abs(covariance - np.eye(k))[some][:, some].max()) if some.any() else 0.0


def _packed(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in integers(batch.column(0), scale):
                if len(x):
                    for packed in pack(x):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), x.shape[1], np.int32)), packed], ["size", "x"])

    return run


def _projected(size: int, fit: Whitening, error: float, scale: int, names: list[str]):
    k = len(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in integers(batch.column(1), scale):
                if x.shape[1] != size or not len(x):
                    continue
                exact, scores = whitened(x, fit)
                far = squares(exact)
                wide = far.dtype == object and any(v > _LONG.max for v in far)
                short = pa.array([v if v <= _LONG.max else None for v in far], pa.int64()) if wide else pa.array(far.astype(np.int64))
                digits = pa.array([str(v) if v > _LONG.max else None for v in far], pa.string()) if wide else pa.nulls(len(rows), pa.string())
                each = pa.array(np.repeat(np.arange(len(rows)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(each), fit.n, np.int64)), short.take(each),
                        pc.if_else(pa.array(np.tile(fit.values > 0, len(rows))), pa.array(scores.ravel()), None), pa.array(np.tile(fit.explained, len(rows))), pa.array(np.full(len(each), error)), digits.take(each),
                    ],
                    names,
                )

    return run


def whiten(rows: DataFrame, identity: str, vector: str, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """The leading whitened components of every row's vector, fitted on the distinct integer vectors floor(scale * c).

    Result: a row for each row and component with ``identity``, component (from 1 by falling eigenvalue), n (distinct vectors),
    deviation (sum of (n x - S)^2, exact; null beyond a long, then deviation_digits has it), whitened, explained and
    identity_error. Repeated rows and identities are kept, each counts in the fit but once for its vector; a null identity
    is one like any other. Rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are those
    of another length than most distinct vectors have (of ties, the longest). Entries beyond a long become the nearest long.
    A component without variance has a null ``whitened`` and explains 0; with one distinct vector that holds for all. There
    are as many components as dimensions if these are fewer. A table without such vectors gives no rows. Other columns are
    not read. The driver holds one row per dimension, up to some thousands of them, and never a vector of each row.
    """
    names = [identity, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"]
    kind = T.StructType([T.StructField(identity, rows.schema[identity].dataType)]).add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double").add("deviation_digits", "string")
    distinct = rows.select(F.col(vector)).mapInArrow(_packed(scale), "size int, x binary").distinct()
    every = common.materialize(distinct, "fit-list")
    lengths = every.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None:
        return rows.sparkSession.createDataFrame([], kind)
    size = lengths["size"]
    fit_list = every.where(F.col("size") == size)
    near = next(unpack(pa.array([bytes(fit_list.select("x").first()["x"])], pa.binary()), size))[0]
    n, sums, exact = scatter(fit_list, size, [int(v) if abs(int(v)) < 1 << 40 else 0 for v in near])
    fit = decompose(n, sums, exact, components)
    error = identity_error(fit_list, size, fit)
    common.discard(every)
    return rows.select(identity, vector).mapInArrow(_projected(size, fit, error, scale, names), kind)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitening of all embeddings; see whiten()."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
