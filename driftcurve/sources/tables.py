"""Reading and writing tables: pruned scans, cached results, label logs, file names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

LABEL_LOG = "iteration int, ts string, pos array<bigint>, neg array<bigint>"


def scan(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None, rows: tuple[int, int | None] | None = None, index: str = "row_index", split: str | None = None) -> DataFrame:
    """A Parquet table, pruned: of `columns` those that it has, rows whose `index` lies in [from, to), one split (a subfolder)."""
    df = spark.read.parquet(f"{path}/{split}" if split else path)
    if rows:
        df = df.where(F.col(index) >= rows[0])
        if rows[1] is not None:
            df = df.where(F.col(index) < rows[1])
    return df.select(*(c for c in columns if c in df.columns)) if columns else df


def count_rows(spark: SparkSession, glob: str) -> int:
    """Rows of all files that a pattern matches, from a scan without columns."""
    return spark.read.parquet(glob).count()


def write(df: DataFrame, path: str, mode: str = "overwrite", float32: bool = False) -> None:
    """Parquet in zstd; with `float32` double columns are narrowed on the way out."""
    if float32:
        df = df.select(*(F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(old)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).rename(p, jvm.org.apache.hadoop.fs.Path(new))


def cached(spark: SparkSession, folder: str, prefix: str, n: int, make: Callable[[], DataFrame], legacy: str | None = None, least: int = 10_000) -> DataFrame:
    """A result kept under features_{prefix}_{n}.parquet: read if it is there and complete, else made and written.

    A legacy folder is adopted if it has n rows. Results of under `least` rows are not kept. Whether a
    table is complete is told by the marker that the committer writes last.
    """
    if n < least:
        return make()
    path = f"{folder}/features_{prefix}_{n}.parquet"
    if not exists(spark, f"{path}/_SUCCESS") and legacy and exists(spark, legacy) and count_rows(spark, legacy) == n:
        rename(spark, legacy, path)
    if not exists(spark, f"{path}/_SUCCESS"):
        write(make(), path)
    return spark.read.parquet(path)


def in_chunks(df: DataFrame, folder: str, prefix: str, chunks: int, make: Callable[[DataFrame], DataFrame], key: str = "id", spread: int = 8) -> DataFrame:
    """`make(df)` computed and kept chunk by chunk under {folder}/{prefix}_chunk_NNNN.parquet, so that a run that was cut short goes on where it ended.

    A row's chunk follows from its key's hash, so rows of one key are computed together. The input is read once: it is
    dealt out to {folder}/{prefix}_input/chunk=N, in at most `spread` files a chunk, and each chunk reads its own part.
    The manifest is the markers that the committer writes last: an input that has one is not read again, a chunk that
    has one is not computed again. The dealt input goes when all chunks are there.
    """
    spark, staged = df.sparkSession, f"{folder}/{prefix}_input"
    paths = [f"{folder}/{prefix}_chunk_{k:04d}.parquet" for k in range(chunks)]
    missing = [k for k in range(chunks) if not exists(spark, f"{paths[k]}/_SUCCESS")]
    chunk = F.pmod(F.xxhash64(key), F.lit(chunks))
    if missing:
        if not exists(spark, f"{staged}/_SUCCESS"):
            wanted = df if len(missing) == chunks else df.where(chunk.isin(missing))
            hashed = [c for c, t in df.dtypes if "map<" not in t][:4]
            dealt = wanted.withColumn("__chunk", chunk).repartition(min(chunks * spread, 4096), "__chunk", F.pmod(F.xxhash64(*hashed), F.lit(spread)))
            dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("__chunk").parquet(staged)
        for k in missing:
            part = f"{staged}/__chunk={k}"
            # a chunk that was not dealt out has no rows, or was complete at that time
            rows = spark.read.schema(df.schema).parquet(part) if exists(spark, part) else df.where(chunk == k)
            write(make(rows.select(df.columns)), paths[k])
        remove(spark, staged)
    return spark.read.parquet(*paths)


def parse_label_log(lines: DataFrame) -> DataFrame:
    """(line, iteration, ts, row_index, label) of JSON lines in a column `value`; blank and malformed ones are skipped."""
    r = F.from_json("value", LABEL_LOG, {"mode": "PERMISSIVE"})
    rows = lines.where(F.trim("value") != "").withColumn("r", r).where(F.col("r").isNotNull() & (F.col("r.pos").isNotNull() | F.col("r.neg").isNotNull()))
    each = lambda c, label: F.transform(F.coalesce(F.col(f"r.{c}"), F.array().cast("array<bigint>")), lambda i: F.struct(i.alias("row_index"), F.lit(label).alias("label")))
    keep = [c for c in lines.columns if c != "value"]
    return rows.select(*keep, F.col("r.iteration").alias("iteration"), F.col("r.ts").alias("ts"), F.inline(F.concat(each("pos", 1), each("neg", 0))))


def read_label_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_label_log(spark.read.text(path))


def append_label_log(spark: SparkSession, path: str, iteration: int, pos: list[int], neg: list[int]) -> None:
    """Append one session's record; its ids are what a person entered."""
    row = spark.createDataFrame([(iteration, pos, neg)], "iteration int, pos array<bigint>, neg array<bigint>")
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    row.select("iteration", stamp.alias("ts"), "pos", "neg").coalesce(1).write.mode("append").json(path)


#: Fixed patterns of image names.
NAME_PATTERNS = {"iteration": r"iter(\d+)", "probability": r"_P(\d+\.?\d*)pct_", "source_id": r"(?:added_|removed_)?([A-Z0-9]+_MJD[\d.]+)_row", "row_index": r"_row(\d+)_"}


def name_metadata(path: Column) -> dict[str, Column]:
    """What an image's path tells: iteration, probability in per cent, source id, row index; null where it does not."""
    name = F.element_at(F.split(path, "/"), -1)
    part = lambda k, text: F.nullif(F.regexp_extract(text, NAME_PATTERNS[k], 1), F.lit(""))
    return {
        "iteration": part("iteration", path).try_cast("bigint"), "probability": part("probability", name).try_cast("double"),
        "source_id": part("source_id", name), "row_index": part("row_index", name).try_cast("bigint"),
    }


def image_files(files: DataFrame) -> DataFrame:
    """Of a table with `path` one file per source id, the first by iteration and name; files without a source id are all kept."""
    df = files.withColumns(name_metadata(F.col("path")))
    key = F.coalesce(F.col("source_id"), F.col("path"))
    first = W.partitionBy(key).orderBy(F.col("iteration").asc_nulls_first(), "path")
    return df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def discover_images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """Image files under a folder, by listing alone: contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return image_files(listed.select("path", "modificationTime", "length"))
