import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from driftcurve.operators import labels as lab, loop
from driftcurve.sources import tables
from driftcurve.streaming import labels as stream


def test_scan_prunes_columns_and_rows(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("row_index"), (F.col("id") * 2).alias("x"), F.lit("s").alias("y")).write.parquet(f"{tmp_path}/t")
    got = tables.scan(spark, f"{tmp_path}/t", ("x", "absent"), (10, 20))
    assert got.columns == ["x"] and got.count() == 10 and tables.count_rows(spark, f"{tmp_path}/*") == 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row_index,10)" in plan and "ReadSchema: struct<row_index:bigint,x:bigint>" in plan
    assert tables.scan(spark, f"{tmp_path}/t", rows=(90, None)).count() == 10


def test_cached_results(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(5)

    for _ in range(2):
        assert tables.cached(spark, str(tmp_path), "p", 5, make, least=1).count() == 5
    assert len(made) == 1
    tables.cached(spark, str(tmp_path), "p", 5, make, least=6)
    assert len(made) == 2
    spark.range(7).write.parquet(f"{tmp_path}/old")
    assert tables.cached(spark, str(tmp_path), "q", 7, make, legacy=f"{tmp_path}/old", least=1).count() == 7 and len(made) == 2


def test_float32_at_the_sink(spark, tmp_path):
    tables.write(spark.range(3).withColumn("x", F.lit(0.1)), f"{tmp_path}/t", float32=True)
    assert dict(spark.read.parquet(f"{tmp_path}/t").dtypes) == {"id": "bigint", "x": "float"}


def test_label_log(spark, tmp_path):
    tables.append_label_log(spark, f"{tmp_path}/log", 1, [1, 2], [3])
    tables.append_label_log(spark, f"{tmp_path}/log", 2, [2], [])
    (tmp_path / "log" / "odd.json").write_text('\n   \n{"pos": [9\n' + json.dumps({"pos": [5], "neg": [5]}) + "\n")
    got = sorted((r.row_index, r.label) for r in tables.read_label_log(spark, f"{tmp_path}/log").collect())
    assert got == [(1, 1), (2, 1), (2, 1), (3, 0), (5, 0), (5, 1)]
    assert {(r.row_index, r.label) for r in lab.resolve_expert(tables.read_label_log(spark, f"{tmp_path}/log")).collect()} == {(1, 1), (2, 1), (3, 0)}


def test_image_names(spark, tmp_path):
    for i, name in enumerate(("iter2/a/added_SRC1_MJD58000.5_row7_P97.5pct_cleaned.png", "iter1/a/removed_SRC1_MJD58000.5_row7_P3pct_cleaned.png", "iter1/a/plain.png")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(bytes(i))
    got = {r.source_id: r for r in tables.discover_images(spark, str(tmp_path)).collect()}
    assert set(got) == {"SRC1_MJD58000.5", None} and (got["SRC1_MJD58000.5"].iteration, got["SRC1_MJD58000.5"].probability, got["SRC1_MJD58000.5"].row_index) == (1, 3.0, 7)


def test_streamed_verdicts_equal_the_batch(spark, tmp_path):
    tables.append_label_log(spark, f"{tmp_path}/log", 1, [1, 2], [3])
    for _ in range(2):
        stream.append_verdicts(spark, f"{tmp_path}/log", f"{tmp_path}/table", f"{tmp_path}/check", once=True).awaitTermination()
        tables.append_label_log(spark, f"{tmp_path}/log", 2, [4], [])
    assert sorted(r.row_index for r in spark.read.parquet(f"{tmp_path}/table").collect()) == [1, 2, 3, 4]


def test_streamed_windows(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 1L AS id, 2.0D AS mag UNION ALL SELECT timestamp'2024-01-01 00:50:00', 1L, 4.0D UNION ALL SELECT timestamp'2024-01-01 01:10:00', 1L, 5.0D").write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("ts timestamp, id bigint, mag double").parquet(f"{tmp_path}/in")
    q = stream.activity(events).writeStream.format("memory").queryName("activity_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, r["mean"], r.lowest) for r in spark.table("activity_test").collect()) == [(1, 5.0, 5.0), (2, 3.0, 2.0)]


def test_loop_keeps_its_books(spark, tmp_path):
    pool = spark.range(400).select(F.col("id").alias("row_index"), (F.col("id") % 97 / 97.0).alias("a"), (F.col("id") % 89 / 89.0).alias("b"))
    known = spark.range(40).select(F.col("id").alias("row_index"), (3 + F.col("id") % 7 / 7.0).alias("a"), (3 + F.col("id") % 5 / 5.0).alias("b"))
    expert = spark.createDataFrame([(399, 1)], "row_index bigint, label int")
    config = loop.Config(train_neg=60, validation_neg=60, held_out_neg=30, members=0, booster=loop.tr.Booster(rounds=3), max_iterations=1)
    job = loop.SelfTraining(spark, pool, known, ["a", "b"], config, expert)
    result = job.run()
    assert result["reason"] == "MAX_ITERATIONS" and len(result["history"]) == 1
    rows = result["samples"].collect()
    assert len({(r.row_index, r.from_known) for r in rows}) == len(rows) and any(r.source == "expert_pos" for r in rows)
    roles = {(r.row_index, r.from_known): r.role for r in result["roles"].collect()}
    assert all(roles.get((r.row_index, r.from_known)) in (None, "train") for r in rows if r.source.startswith("pseudo"))
    job.save(str(tmp_path / "out"), result)
    assert spark.read.parquet(f"{tmp_path}/out/probabilities").count() == 400


def test_too_small_a_pool_is_an_error(spark):
    pool = spark.range(5).select(F.col("id").alias("row_index"), F.lit(1.0).alias("a"))
    with pytest.raises(ValueError, match="fewer"):
        loop.SelfTraining(spark, pool, pool, ["a"], loop.Config(train_neg=10)).split()


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10


def test_chunks_that_are_complete_are_not_made_again(spark, tmp_path):
    from driftcurve.sources import tables

    df = spark.range(100).withColumnRenamed("id", "id")
    made = []

    def make(part):
        made.append(1)
        return part.selectExpr("id", "id * 2 AS x")

    got = tables.in_chunks(df, str(tmp_path), "f", 3, make)
    assert sorted(r.x for r in got.collect()) == list(range(0, 200, 2)) and len(made) == 3
    (tmp_path / "f_chunk_0001.parquet" / "_SUCCESS").unlink()
    again = tables.in_chunks(df, str(tmp_path), "f", 3, make)
    assert len(made) == 4 and sorted(r.x for r in again.collect()) == list(range(0, 200, 2))


def test_chunks_read_the_input_once_and_go_on_after_a_cut(spark, tmp_path):
    from pyspark.sql import functions as F

    source = tmp_path / "source"
    spark.range(300).selectExpr("id % 50 AS id", "id AS v").write.parquet(str(source))
    df = spark.read.parquet(str(source))
    seen = []

    def make(part):
        seen.append(part.inputFiles())
        if len(seen) == 3:
            raise RuntimeError("cut")
        return part.groupBy("id").agg(F.sum("v").alias("v"))

    with pytest.raises(RuntimeError):
        tables.in_chunks(df, str(tmp_path), "g", 4, make)
    assert all("g_input" in f for files in seen for f in files)
    done = {k: (tmp_path / f"g_chunk_000{k}.parquet" / "_SUCCESS").stat().st_mtime_ns for k in (0, 1)}
    for f in source.iterdir():  # what is left comes from the part that was dealt out
        f.unlink()
    got = {r.id: r.v for r in tables.in_chunks(df, str(tmp_path), "g", 4, make).collect()}
    assert got == {i: sum(range(i, 300, 50)) for i in range(50)} and len(seen) == 5
    assert done == {k: (tmp_path / f"g_chunk_000{k}.parquet" / "_SUCCESS").stat().st_mtime_ns for k in (0, 1)}
    assert not (tmp_path / "g_input").exists()
    assert tables.in_chunks(df, str(tmp_path), "g", 4, make).count() == 50 and len(seen) == 5
