"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftcurve.llm.storage import Scratch, free_prefix

RATIO = 0.1
#: A line that no other page has is nobody's boilerplate. The ratio alone would empty every host of fewer than ten pages.
MIN_PAGES = 2


def line_keys(text: Column) -> Column:
    """For each line of a text the 128-bit key of its trimmed form, as a string, whose repeats a hash set finds; null for a blank line."""

    def key(line: Column) -> Column:
        bare = F.trim(line, F.lit(" \t\r"))
        return F.when(bare != "", F.md5(bare.cast("binary")))

    return F.transform(F.split(text, "\n"), key)


def line_dedup(docs: DataFrame, scratch: Scratch, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Drop from each text the lines that at least `min_pages` and over `ratio` of its host's pages contain.

    Returns the input's columns with `text` (and `n_chars`, if present) replaced, plus n_lines_dropped
    (replacing a column of that name). Lines are compared trimmed of space, tab and carriage return;
    blank lines never count and always stay. A page counts once for a line however often it repeats it.

    Defined cases: a null text stays null and its row counts as a page; null hosts form one host;
    repeated rows each count as a page; an empty table gives an empty one; a text all of whose lines go
    becomes ''. All other columns pass through untouched.

    Distribution: counts are pre-aggregated by (host, line key) before their shuffle, so a host or line
    with a third of all pages sends one row per task. The lines that are dropped number at most
    (mean lines per page / ratio) per host, are written as a table and joined back by a join whose
    inputs adaptive execution may split; the texts are shuffled once.
    """
    site = F.col("__host")
    keyed = docs.select(F.col("doc_id").alias("__doc"), F.col(host).alias("__host"), F.array_distinct(F.array_compact(line_keys(F.col("text")))).alias("__keys"))
    pages = docs.groupBy(F.col(host).alias("__site")).agg(F.count("*").alias("__pages"))
    lines = keyed.select("__doc", "__host", F.explode("__keys").alias("__key"))
    counts = lines.groupBy("__host", "__key").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_pages)
    boiler = counts.join(pages, site.eqNullSafe(F.col("__site"))).where(F.col("__n") > F.lit(ratio) * F.col("__pages")).select(F.col("__host").alias("__bh"), F.col("__key").alias("__bk"))
    boiler = scratch.table(boiler, "boilerplate")
    hits = lines.join(boiler, site.eqNullSafe(F.col("__bh")) & (F.col("__key") == F.col("__bk")))
    p = free_prefix(docs)
    own = lambda name: F.col(p + name)
    hits = hits.groupBy(F.col("__doc").alias(p + "doc"), F.col("__host").alias(p + "host")).agg(F.collect_set("__key").alias(p + "drop"))
    hits = scratch.table(hits, "hits")
    joined = docs.join(hits, docs["doc_id"].eqNullSafe(own("doc")) & docs[host].eqNullSafe(own("host")), "left")
    split = F.split(F.col("text"), "\n")
    stay = F.filter(F.arrays_zip(split.alias("line"), line_keys(F.col("text")).alias("key")), lambda x: x["key"].isNull() | ~F.array_contains(own("drop"), x["key"]))
    joined = joined.withColumn(p + "left", F.when(own("drop").isNotNull(), stay))
    text = F.when(own("left").isNull(), F.col("text")).otherwise(F.array_join(own("left")["line"], "\n"))
    gone = F.when(own("left").isNull(), F.lit(0)).otherwise(F.size(split) - F.size(own("left")))
    joined = joined.withColumns({p + "text": text, p + "gone": gone.cast("bigint")})
    plain = {"text": own("text"), "n_chars": F.length(own("text")).cast("bigint")}
    columns = [plain.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns if c != "n_lines_dropped"]
    return joined.select(*columns, own("gone").alias("n_lines_dropped"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, their sources as hosts; nulls, empties and repeated rows as `line_dedup` says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return line_dedup(docs, Scratch(spark, "line-dedup"))


OP1_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, source, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d
), k AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l
), n AS (
  SELECT source, bare, count(DISTINCT r) AS n FROM k WHERE bare <> '' GROUP BY source, bare
), p AS (
  SELECT source, count(*) AS pages FROM d GROUP BY source
), b AS (
  SELECT n.source, n.bare FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source WHERE n.n >= {MIN_PAGES} AND n.n > {RATIO} * p.pages
), s AS (
  SELECT k.r, string_agg(k.line, chr(10) ORDER BY k.pos) AS text, count(*) AS n
  FROM k LEFT JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.bare = b.bare WHERE b.bare IS NULL GROUP BY k.r
)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(s.text, '') END AS text,
       CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(d.lines) - coalesce(s.n, 0) END AS BIGINT) AS n_lines_dropped
FROM d LEFT JOIN s USING (r)
"""
