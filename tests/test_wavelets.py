import numpy as np
import pytest
from pyspark.sql import functions as F

from driftcurve.functions.filters import WAVELETS, high_pass, low_pass, usable_levels
from driftcurve.operators import wavelets as W


def plain_level(x, f):
    """Tap by tap, with reflected ends."""
    n, taps, out = len(x), len(f), []
    for i in range((n + taps - 1) // 2):
        total = 0.0
        for j in range(taps):
            k = 2 * i + 2 - taps + j
            while not 0 <= k < n:
                k = -k - 1 if k < 0 else 2 * n - 1 - k
            total += x[k] * f[taps - 1 - j]
        out.append(total)
    return out


@pytest.mark.parametrize("wavelet", WAVELETS)
@pytest.mark.parametrize("n", [3, 16, 33, 64])
def test_maps_equal_the_plain_transform(spark, wavelet, n):
    x = np.random.default_rng(n).normal(size=n)
    low, high = W.level_maps(n, wavelet)
    assert np.allclose(low @ x, plain_level(x, low_pass(wavelet))) and np.allclose(high @ x, plain_level(x, high_pass(wavelet)))
    if n != 33:
        rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "id int, pos bigint, x double")
        got = W.dwt_level(rows, wavelet).orderBy("k").collect()
        assert np.allclose([r.approx for r in got], low @ x) and np.allclose([r.detail for r in got], high @ x)


def test_filters_are_orthonormal_and_levels_as_expected():
    for w in WAVELETS:
        assert np.dot(low_pass(w), low_pass(w)) == pytest.approx(1) and np.dot(low_pass(w), high_pass(w)) == pytest.approx(0, abs=1e-9)
    assert [usable_levels(64, w) for w in WAVELETS] == [6, 3, 2, 1, 3]
    with pytest.raises(ValueError):
        low_pass("bior")


def test_energy_and_ranges():
    x = np.random.default_rng(0).normal(size=(20, 64))
    got = dict(zip(W.feature_names(levels=5), W.statistics(x).T, strict=True))
    assert np.allclose(got["norm_wv_haar_total_energy"], (x**2).sum(axis=1))
    assert all(((got[f"norm_wv_{w}_detail_ratio"] >= 0) & (got[f"norm_wv_{w}_detail_ratio"] <= 1)).all() for w in WAVELETS)
    assert (got["norm_wv_db6_d3_energy"] == 0).all() and len(got) == 230 and len(W.feature_names(levels=6)) == 270
    assert np.allclose(W.statistics(np.zeros((1, 50))), 0)


def test_short_null_and_irregular_series(spark):
    rows = [(1, [0.0, 1.0, 2.0], [0.0, 1.0, 2.0]), (2, None, None), (3, [float(i) for i in range(9)], [float(i % 2) for i in range(9)]), (4, [5.0] * 9, [float(i % 3) for i in range(9)]), (5, [float(i) for i in range(9)], [float("nan")] * 9)]
    got = {r.id: r for r in W.wavelet_features(spark.createDataFrame(rows, "id int, mjd array<double>, norm array<double>")).collect()}
    assert all(got[k].norm_wv_haar_total_energy == 0 for k in (1, 2, 5)) and all(got[k].norm_wv_haar_total_energy > 0 for k in (3, 4))


def test_grid_equals_interpolation(spark):
    rng = np.random.default_rng(3)
    t, x = np.sort(rng.uniform(0, 10, 25)), rng.normal(size=25)
    rows = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, x, strict=True))], "id int, pos bigint, mjd double, norm double")
    got = W.resampled(rows).orderBy("k").collect()
    assert [r.k for r in got] == list(range(64)) and np.allclose([r.x for r in got], W.regular(x, t))
    assert W.resampled(rows.withColumn("mjd", F.lit(1.0))).count() == 0


@pytest.mark.parametrize("wavelet", [*(f"{k}{n}" for k in ("db", "sym") for n in range(2, 21)), *(f"coif{n}" for n in range(1, 6))])
def test_computed_filters_are_orthogonal_and_have_vanishing_moments(wavelet):
    family, order = wavelet.rstrip("0123456789"), int(wavelet.lstrip("dbsymcoif"))
    h, g = (np.array(f(wavelet)) for f in (low_pass, high_pass))
    n = len(h)
    assert n == order * (6 if family == "coif" else 2) and h.sum() == pytest.approx(2**0.5, abs=1e-12)
    for m in range(0, n, 2):
        assert h[: n - m] @ h[m:] == pytest.approx(float(m == 0), abs=1e-11) and h[: n - m] @ g[m:] == pytest.approx(0, abs=1e-11)
    at = (np.arange(n) - n / 2) / n
    for k in range(2 * order if family == "coif" else order):
        assert abs((g * at**k).sum()) < 1e-9
    if family == "coif":
        centre = np.argmax(h)
        assert all(abs((h * (np.arange(n) - centre) ** k).sum()) < 1e-5 * n**k for k in range(1, 2 * order))


def test_computed_filters_equal_the_fixed_ones():
    from driftcurve.functions import filters as L

    for name, own in (("haar", L.daubechies(1)), ("db4", L.daubechies(4)), ("db6", L.daubechies(6)), ("sym4", L.symlet(4)), ("coif3", L.coiflet(3))):
        assert np.abs(np.array(own) - L.LOW_PASS[name]).max() < 1e-10
    root = 3**0.5
    assert low_pass("db2") == pytest.approx([(1 - root) / 32**0.5, (3 - root) / 32**0.5, (3 + root) / 32**0.5, (1 + root) / 32**0.5])


def test_features_of_any_filter(spark):
    rows = spark.createDataFrame([(i, [float(v) for v in np.random.default_rng(i).normal(size=64)]) for i in range(3)], "id int, x array<double>")
    got = W.wavelet_features(rows, "x", None, ("db10", "coif1"), 2, "").collect()
    x = np.array([r.x for r in rows.collect()])
    assert np.allclose([r["wv_db10_total_energy"] for r in got], W.statistics(x, ("db10",), 2)[:, 0])
    assert [f for f in got[0].asDict() if "coif1_d2" in f] and usable_levels(64, "db10") == 1
    for wrong in ("db21", "coif6", "sym1", "db0", "bior2.2"):
        with pytest.raises(ValueError):
            W.wavelet_features(rows, "x", None, (wrong,))
