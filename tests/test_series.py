import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftcurve.functions import families as fam
from driftcurve.operators import sequences as seq, series as ser
from driftcurve.operators.features import extract_all


def long(spark, rows: dict, magerr=0.1):
    data = [(k, i, 58000.0 + i, float(v), magerr) for k, vs in rows.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(data, "id string, pos bigint, mjd double, mag double, magerr double")


def mags(df, key="a"):
    return [r.mag for r in df.where(F.col("id") == key).orderBy("pos").collect()]


@pytest.mark.parametrize(
    ("values", "expected", "flag"),
    [
        ([15, 15.1, 15.2, 14.9, 15, 25, 15.1, 14.8, 15, 15.2], 15.05, True),
        ([15, 15.1, 15.2, 14.9, 15, 15.1, 14.8, 15, 15.2], None, False),
        ([15, 25, 15.2, 14.9, 5, 15.1, 14.8, 15, 15.2], None, False),
        ([25, 15.1, 15.2, 14.9, 15, 15.1, 14.8, 15, 15.2], 15.1, True),
        ([15, 15.1, 15.2, 14.9, 15, 15.1, 14.8, 15, 25], 15.0, True),
        ([15, 25], None, False),
    ],
)
def test_single_outliers(spark, values, expected, flag):
    got = ser.clean_outlier(long(spark, {"a": values}).withColumn("class", F.lit(1)), k=3)
    assert got.where("class = 1 AND had_od").count() == (len(values) if flag else 0)
    want = list(map(float, values))
    if flag:
        want[want.index(25)] = expected
    assert mags(got) == pytest.approx(want)
    assert len(mags(ser.drop_outlier(long(spark, {"a": values}), k=3))) == len(values) - flag


def test_norm_with_zero_errors(spark):
    s = long(spark, {"a": [15, 16, 18]}, magerr=0.0)
    assert [r.norm for r in ser.with_norm(s).collect()] == [None] * 3
    assert sorted(r.norm for r in ser.with_norm(s, "centre").collect()) == [-1, 0, 2]
    with pytest.raises(Exception, match="median magerr is 0"):
        ser.with_norm(s, "raise").collect()
    assert [r.norm for r in ser.with_norm(long(spark, {"a": [15]})).collect()] == [0.0]


def test_round_trip_of_arrays(spark):
    nested = spark.createDataFrame([("a", 1, [1.0, 2.0], [3.0, 4.0]), ("b", 0, [], [])], "id string, class int, mjd array<double>, mag array<double>")
    back = ser.implode_series(ser.explode_series(nested), keep=("class",)).select(nested.columns).orderBy("id").collect()
    assert [tuple(r) for r in back] == [("a", 1, [1.0, 2.0], [3.0, 4.0]), ("b", 0, [], [])]


def stats_of(x):
    x = np.array(x, float)
    n, d = len(x), np.diff(x)
    srt = np.sort(x)
    m = x - x.mean()
    m2 = (m**2).mean()
    return {
        "mean": x.mean(), "std": x.std(ddof=1) if n > 1 else None, "median": np.median(x), "q25": srt[math.floor((n - 1) * 0.25 + 0.5)], "q75": srt[math.floor((n - 1) * 0.75 + 0.5)], "first": x[0], "last": x[-1],
        "arg_min": x.argmin(), "arg_max": x.argmax(), "n_unique": len(set(x)), "trend_changes": int((np.sign(d[1:]) != np.sign(d[:-1])).sum()), "skewness": (m**3).mean() / m2**1.5 if m2 else None, "kurtosis": (m**4).mean() / m2**2 - 3 if m2 else None,
    }


def test_main_stats_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = {f"s{k}": np.round(rng.normal(size=n), 1) for k, n in enumerate((1, 2, 3, 10, 40, 41, 42, 43))}
    rows["flat"] = [2.0] * 6
    got = {r["id"]: r for r in fam.apply(long(spark, rows), fam.main_stats("mag")).collect()}
    for k, x in rows.items():
        for name, want in stats_of(x).items():
            have = got[k][f"mag_{name}"]
            assert (have is None and want is None) or have == pytest.approx(want, abs=1e-9), (k, name)
    assert got["flat"]["mag_entropy"] == pytest.approx(math.log(6))


def longest(flags):
    best = run = 0
    for f in flags:
        run = run + 1 if f else 0
        best = max(best, run)
    return best


def test_shape_against_loops(spark):
    rng = np.random.default_rng(1)
    rows = {f"s{k}": np.round(rng.normal(size=n) * 2, 1) for k, n in enumerate((1, 2, 3, 20, 61))}
    got = {r["id"]: r for r in fam.apply(long(spark, rows), fam.shape("mag", times="mjd")).collect()}
    for k, x in rows.items():
        n, d, r = len(x), np.diff(x), got[k]
        assert r.mag_max_consecutive_below_2sigma == longest(x < -2) and r.mag_max_consecutive_above_1sigma == longest(x > 1)
        assert r.mag_longest_monotonic_increase == longest(d > 0) and r.mag_longest_monotonic_decrease == longest(d < 0)
        assert r.mag_n_local_minima == sum(d[i] < 0 < d[i + 1] for i in range(n - 2)) and r.mag_n_zero_crossings == sum(np.sign(x[i]) * np.sign(x[i - 1]) < 0 for i in range(1, n))
        assert r.mag_n_isolated_below_2sigma == sum(x[i] < -2 and (i == 0 or x[i - 1] >= -2) and (i == n - 1 or x[i + 1] >= -2) for i in range(n))
        assert r.mag_n_runs_below_2sigma == sum(x[i] < -2 and (i == 0 or x[i - 1] >= -2) for i in range(n))
        half = n // 2
        assert r.mag_first_second_half_diff == pytest.approx(x[:half].mean() - x[n - half :].mean() if half else 0)
        assert r.mag_rise_decay_idx_ratio == pytest.approx((x.argmin() + 1) / (n - x.argmin())) and r.mjd_span == n - 1


def test_split_lengths(spark):
    s = ser.with_steps(long(spark, {"a": [1, 2, 10, 3, 4]}))
    got = fam.apply(s, *(fam.split_stats("mag", side, w) for side in ("to", "from") for w in ("argmin", "argmax")), fam.split_stats("velocity", "from", "argmax", steps=True), fam.split_stats("velocity", "to", "argmax", steps=True)).first()
    assert (got.mag_to_argmax_len, got.mag_from_argmax_len, got.mag_to_argmin_len, got.mag_from_argmin_len) == (2, 3, 0, 5)
    assert (got.velocity_to_argmax_len, got.velocity_from_argmax_len) == (2, 3)
    assert got.mag_to_argmin_mean is None and got.mag_to_argmin_energy == 0
    with pytest.raises(ValueError):
        fam.split_stats("mag", "before", "argmin")


def test_channels_and_padding(spark):
    s = long(spark, {"a": [15, 14, 16], "b": [15]})
    got = seq.with_channels(s, list(seq.CHANNELS)).where("id = 'a'").orderBy("pos").collect()
    assert [r.t_since_peak for r in got] == [-1, 0, 1] and [r.vel for r in got] == [0, -1, 2]
    assert got[0].detrended == pytest.approx(15 - (15 + 15 + 14) / 3)
    with pytest.raises(ValueError, match="unknown channel"):
        seq.with_channels(s, ["nope"])
    padded = {r.id: r for r in seq.padded(seq.stacked(seq.preprocessed(s), ("mjd", "mag")), 2).collect()}
    assert len(padded["b"].sequence) == 3 and padded["b"].length == 1 and padded["b"].sequence[2] == [0.0, 0.0]


def test_extract_all_has_its_columns_and_needs_one_shuffle(spark):
    rng = np.random.default_rng(2)
    s = long(spark, {f"s{k}": 15 + rng.normal(size=30) for k in range(5)} | {"tiny": [15.0], "flat": [15.0] * 9}).withColumn("class", F.lit(0))
    got = extract_all(s)
    assert len(got.columns) == 494 and {t for c, t in got.dtypes if c.startswith("norm_wv")} == {"float"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    rows = got.collect()
    assert len(rows) == 7 and all(r.norm_wv_haar_total_energy == 0 for r in rows if r.id in ("tiny", "flat"))


def test_fractions_need_their_counts(spark):
    with pytest.raises(ValueError):
        fam.with_fractions(spark.createDataFrame([(1, 2)], "id int, npoints int"))


def test_column_groups_of_the_whole_table_are_complete(spark):
    """Statistics, shapes, split statistics and fractions: all columns that the wavelets and the row's own ones leave."""
    import __spark_entry__ as entry
    from driftcurve.operators.features import extract_all
    from driftcurve.sources.curves import curves

    sf = "/root/testdata/sf0.001"
    sizes = {n: len(entry.queries()[f"all_features_{n}"](spark, sf).columns) - 1 for n in ("shape", "split", "fractions")}
    assert sizes == {"shape": 68, "split": 108, "fractions": 4}
    whole = [c for c in extract_all(curves(spark, sf)).columns if "_wv_" not in c]
    assert len(whole) == sum(sizes.values()) + 79 + len({"id", "class", "had_od", "npoints", "ts"})


def differing(spark, folder, name: str, events: list[tuple]) -> int:
    """Rows of a query over these (event_id, ts, user_id, value) that its SQL twin does not give."""
    import duckdb

    import __spark_entry__ as entry

    df = spark.createDataFrame(events, "event_id bigint, ts string, user_id bigint, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(f"{folder}/events.parquet")
    entry.queries()[name](spark, str(folder)).write.parquet(f"{folder}/out")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    got, want = f"SELECT * FROM '{folder}/out/*.parquet'", entry.oracle_sql()[name]
    return con.execute(f"SELECT count(*) FROM (({got}) EXCEPT ALL ({want}) UNION ALL (({want}) EXCEPT ALL ({got})))").fetchone()[0]


def test_channels_equal_their_twin_where_time_stands_still(spark, tmp_path):
    """Steps of mag over no time are of 1e9 to 1e12."""
    events = [(k, "2024-01-01 00:00:11.172425", 1, round(0.37 * (k * k % 1000), 2)) for k in range(300)]
    assert differing(spark, tmp_path, "seq_channels", events) == 0


def test_times_equal_their_twin_at_half_milliseconds(spark, tmp_path):
    """A day number may miss a microsecond, so half a millisecond may go either way."""
    events = [(k, f"2024-01-30 {k % 24:02d}:{k % 60:02d}:{k * 7 % 60:02d}.{k % 1000:03d}{499 + k % 3}", k, 1.0) for k in range(3000)]
    assert differing(spark, tmp_path, "series_ts", events) == 0


def test_wavelets_run_only_where_their_columns_are_used(spark):
    s = long(spark, {f"s{k}": 15.0 + np.arange(12) % 5 for k in range(3)}).withColumn("class", F.lit(0))
    got = extract_all(s, float32=False)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan(got.select("id", "norm_mean")) and "InArrow" not in plan(got.select("id", "norm_mean"))
    assert "ArrowEvalPython" in plan(got.select("id", "norm_wv_haar_entropy"))


def test_all_features_keep_their_partitions(spark):
    """Few bytes cost much time here, so adaptive execution must not merge tasks down to the number of cores; the rows stay the same."""
    import __spark_entry__ as entry
    from driftcurve.sources.curves import curves, parts

    few, many = curves(spark, "/root/testdata/sf0.001"), curves(spark, "/root/testdata/sf0.001", spread=True)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    queries = entry.queries()
    for q in ("extract_all_features", "all_features_fractions"):
        got = queries[q](spark, "/root/testdata/sf0.001")
        assert got.rdd.getNumPartitions() == parts(spark) >= 4 * spark.sparkContext.defaultParallelism, q
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
