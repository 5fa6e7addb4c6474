"""Whitening against plain arithmetic with fractions and numpy."""

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tallyplan.llm import whitening as W

DATA = "/root/testdata/sf0.001"


def plain(vectors, components=4):
    """(x by row, n, sums, V from fractions) of a list of vectors."""
    x = [None if v is None or not v or any(c is None or not np.isfinite(c) for c in v) else tuple(int(np.floor(256 * c)) for c in v) for v in vectors]
    fit = sorted({v for v in x if v})
    n, size = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(size)]
    mean = [Fraction(s, n) for s in sums]
    cov = np.array([[float(sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in fit) / n) for j in range(size)] for i in range(size)])
    return x, n, sums, cov


def check(rows, vectors, ids):
    x, n, sums, cov = plain(vectors)
    size = len(sums)
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(4, size)
    assert sorted((r["vec_id"], r["component"]) for r in rows) == sorted((i, c) for i, v in zip(ids, x, strict=True) if v for c in range(1, k + 1))
    by = {}
    for r in rows:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    for i, v in zip(ids, x, strict=True):
        if not v:
            continue
        far = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        for c in range(k):
            for r in by[i, c + 1]:
                assert r["n"] == n and r["explained"] == pytest.approx(values[c] / np.trace(cov), rel=1e-9, abs=1e-12)
                assert r["deviation"] == far if far < 1 << 63 else (r["deviation"] is None and r["deviation_digits"] == str(far))
                assert r["identity_error"] < 1e-9
                want = float(np.array([float(Fraction(n * a - s, n)) for a, s in zip(v, sums, strict=True)]) @ basis[:, c]) / np.sqrt(values[c])
                sign = signs.setdefault(c, np.sign(want) * np.sign(r["whitened"]) if abs(want) > 1e-6 else 1)
                assert r["whitened"] == pytest.approx(sign * want, rel=1e-7, abs=1e-9)


def test_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    check(W.op11_whitening(spark, DATA).collect(), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    vectors = [*rng.normal(size=(30, 3)).tolist(), None, [], [1.0, None, 2.0], [nan, 0.0, 1.0], [inf, 0.0, 0.0], [1.0, 2.0], *([[0.5, -0.25, 3.0]] * 40)]
    ids = list(range(len(vectors)))
    df = spark.createDataFrame(list(zip(ids, vectors, ["t"] * len(ids), ["c"] * len(ids), strict=True)), "vec_id long, embedding array<double>, n string, component string").repartition(5)
    vectors[35] = None  # of another length than the rest
    check(W.whiten(df, "vec_id", "embedding").collect(), vectors, ids)


def test_huge_numbers(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(25, 5)) * 10.0 ** rng.integers(0, 15, size=5)).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    rows = W.whiten(df, "vec_id", "embedding").collect()
    x, n, sums, _ = plain(vectors)
    for r in rows:
        far = sum((n * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums, strict=True))
        assert (r["deviation"] == far) if far < 1 << 63 else (r["deviation"] is None and r["deviation_digits"] == str(far))
    assert len(rows) == 100


def test_no_variance_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    rows = W.whiten(df, "vec_id", "embedding").collect()
    assert len(rows) == 6 and all(r["n"] == 1 and r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] == 0 for r in rows)
    assert W.whiten(df.limit(0), "vec_id", "embedding").count() == 0
    assert W.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"), "vec_id", "embedding").columns == df.select("vec_id").columns + ["component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"]


@pytest.mark.parametrize("top", [1, 1 << 20, 1 << 40, 1 << 62])
def test_exact_sums(top):
    rng = np.random.default_rng(top % 97)
    y = rng.integers(-top, top, size=(300, 7), endpoint=True)
    assert W.products(y).tolist() == [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(7)] for i in range(7)]
    assert list(W.squares(y)) == [sum(int(a) ** 2 for a in row) for row in y]
    packed = pa.concat_arrays(list(W.pack(y)))
    assert sorted(map(tuple, np.concatenate(list(W.unpack(packed, 7))).tolist())) == sorted(map(tuple, y.tolist()))


def test_far_entries():
    rows, x = next(W.integers(pa.array([[1e300, -1e300, -0.001]], pa.list_(pa.float64()))))
    assert x.tolist() == [[(1 << 63) - 1, -(1 << 63), -1]]
    assert W.minus(x, [5, 5, 5]).tolist() == [[(1 << 63) - 6, -(1 << 63) - 5, -6]]
