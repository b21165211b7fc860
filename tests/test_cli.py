import pytest
from pyspark.sql import functions as F

from driftcurve import cli


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cli") / "in")
    seq = lambda e: F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: e(i))
    df = spark.range(12).select(F.col("id").alias("row_index"), seq(lambda i: i * 1.0).alias("mjd"), seq(lambda i: 15 + F.sin(i * 1.0 + F.col("id"))).alias("mag"), seq(lambda i: F.lit(0.1)).alias("magerr"))
    df.write.parquet(path)
    return path


def test_features_and_wavelets(spark, table, tmp_path):
    out = f"{tmp_path}/f"
    cli.main(["features", table, out, "--from-row", "2", "--to-row", "7", "--wavelets", "haar", "--max-level", "2", "--argmax", "--no-additional", "--outlier-k", "0"], spark)
    got = spark.read.parquet(out)
    assert got.count() == 5 and {"norm_wv_haar_d2_mad", "mag_to_argmax_len"} <= set(got.columns) and "mag_to_argmax_energy" not in got.columns and dict(got.dtypes)["mag_mean"] == "float"
    cli.main(["wavelets", table, f"{tmp_path}/w", "--no-interpolate", "--float64"], spark)
    assert len(spark.read.parquet(f"{tmp_path}/w").columns) == 271


def test_sample(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("row_index"), (F.col("id") / 100).alias("flare_prob")).write.parquet(f"{tmp_path}/p")
    cli.main(["sample", f"{tmp_path}/p", f"{tmp_path}/s", "--min-prob", "0.5", "--max-prob", "0.9", "-n", "10"], spark)
    got = [r.flare_prob for r in spark.read.parquet(f"{tmp_path}/s").collect()]
    assert len(got) == 10 and all(0.5 <= p <= 0.9 for p in got)


@pytest.mark.parametrize("argv", [["features"], ["sample", "a", "b", "--min-prob", "0.9", "--max-prob", "0.1", "-n", "1"], ["features", "a", "b", "--wavelets", "bior"]])
def test_bad_arguments(argv, monkeypatch):
    monkeypatch.delenv("DRIFTCURVE_INPUT", raising=False)
    with pytest.raises(SystemExit):
        cli.main(argv)
