"""T2 against numpy, its quantiles against published points."""

import numpy as np
import pytest

from millrace.operators import channels as C


@pytest.mark.parametrize("p, d1, d2, want", [(0.99, 2, 10, 7.559), (0.95, 5, 20, 2.711), (0.99, 1, 1, 4052.2), (0.95, 10, 10, 2.978), (0.99, 3, 120, 3.949), (0.99, 12, 10**9, 26.217 / 12)])
def test_f_quantiles(p, d1, d2, want):
    assert C.f_quantile(p, d1, d2) == pytest.approx(want, rel=3e-4)


def test_beta_share():
    assert C.beta_share(2, 3, 0.5) == pytest.approx(0.6875) and C.beta_share(0.5, 0.5, 0.25) == pytest.approx(1 / 3)
    assert C.beta_share(3, 4, 0) == 0 and C.beta_share(3, 4, 1) == 1


def data(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 2))
    x = np.column_stack([base[:, 0], base[:, 0] * 2 + 0.1 * rng.standard_normal(n), base[:, 1] - 5e6, base[:, 1] * 3 + 0.1 * rng.standard_normal(n), rng.standard_normal(n), rng.standard_normal(n) * 1e-3])
    return x, [f"c{i}" for i in range(x.shape[1])]


def test_model_and_flags(spark):
    x, names = data()
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + [(-1, None, *map(float, x[0][1:]))]
    wide = spark.createDataFrame(rows, "row_no long, " + ", ".join(f"{c} double" for c in names)).repartition(7)
    n, mean, cross = C.moments(wide, names)
    assert n == len(x) and np.allclose(mean, x.mean(0)) and np.allclose(cross / (n - 1), np.cov(x, rowvar=False), rtol=1e-6, atol=1e-9)
    model = C.principal_model(wide, names)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(z, rowvar=False))
    rng = np.random.default_rng(9)
    noise = np.mean([np.linalg.eigvalsh(np.cov(rng.standard_normal((n, 6)), rowvar=False)) for _ in range(60)], axis=0)[::-1]
    k = len(model.values)
    assert 2 <= k < 6 and (values[::-1][:k] > noise[:k] - 0.01).all() and values[::-1][k] < noise[k] + 0.01  # two pairs of channels move together
    scores = z @ vectors[:, ::-1][:, :k]
    t2 = (scores**2 / values[::-1][:k]).sum(1)
    limit = k * (n - 1) * (n + 1) / (n * (n - k)) * C.f_quantile(0.99, k, n - k)
    got = {r.row_no: (r.t2, r.flag) for r in C.hotelling(wide, names, model).collect()}
    assert model.limit == pytest.approx(limit) and got[-1] == (None, False)
    assert all(got[i][0] == pytest.approx(t, rel=1e-6) and got[i][1] == (t > limit) for i, t in enumerate(t2))
    assert 0.003 < np.mean(t2 > limit) < 0.02


def test_random_values_follow_samples():
    rng = np.random.default_rng(5)
    drawn = np.mean([np.linalg.eigvalsh(np.cov(rng.standard_normal((40, 4)), rowvar=False))[::-1] for _ in range(2000)], axis=0)
    assert np.allclose(C.random_values(40, 4, 2000), drawn, rtol=0.03)
    assert np.allclose(C.random_values(10**9, 4), 1, atol=1e-3)


def test_too_few_rows_constants_and_detection(spark):
    names = ["a", "b"]
    with pytest.raises(ValueError, match="too few"):
        C.principal_model(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), names)
    flat = spark.createDataFrame([(float(i % 5), 7.0) for i in range(50)], "a double, b double")
    model = C.principal_model(flat, names)
    assert C.hotelling(flat, names, model).where("flag").count() == 0
    flags = spark.createDataFrame([(1, i, i in (2, 6, 7)) for i in range(10)] + [(2, i, False) for i in range(4)], "run long, row_no long, flag boolean")
    got = {r.run: r for r in C.detection(flags, spark.createDataFrame([(1, 5)], "run long, fault_row long")).collect()}
    assert (got[1].detected, got[1].delay_rows, got[1].rate_after, got[1].false_rate) == (True, 1, 0.4, 0.2)
    assert (got[2].detected, got[2].rate_after, got[2].false_rate) == (False, None, 0.0)
