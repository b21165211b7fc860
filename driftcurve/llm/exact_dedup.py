"""Exact dedup against a persistent digest index that is bucketed and sorted by digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftcurve.llm.storage import Scratch

#: Parts in which the query deals a collection to its index.
BATCHES = 2
#: The share of all rows from which on a text is too common for one task, and the rows that no task minds.
HOT, FEW = 0.001, 64


def normalised(text: Column) -> Column:
    """Null as the empty string; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """Two tables of (digest, keep_id, n_rows), bucketed and sorted by digest, that outlive their session.

    The first has one row per distinct text: the smallest id of the batch that brought it, and its rows
    there. The second has a row for each later batch that brought the text again. The bucketing is what
    makes growth cheap: new data is aggregated by digest, shuffled once into the same number of buckets
    and merged with the index by sort-merge joins that read the index in place, with no shuffle of what
    is already there. Only texts not yet present are appended to the first table.
    """

    def __init__(self, spark: SparkSession, table: str, path: str | None = None, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.texts, self.again = f"{table}_texts", f"{table}_again"

    def attach(self) -> None:
        """Register the index in this session: a new one, or one that lies at `path` from an earlier session."""
        for name in (self.texts, self.again):
            where = f"LOCATION '{self.path}/{name.rsplit('_', 1)[1]}'" if self.path else ""
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, n_rows BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS {where}"
            )

    def drop(self) -> None:
        """Take the index out of the catalog; files at a `path` of its own stay."""
        for name in (self.texts, self.again):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def known(self) -> DataFrame:
        return self.spark.table(self.texts)

    def split(self, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of `fresh` (digest, keep_id, n_rows) that the index lacks, by a sort-merge anti-join, and the others."""
        dealt = fresh.repartition(self.buckets, "digest")
        held = self.known().select("digest").hint("merge")
        return dealt.join(held, "digest", "left_anti"), dealt.join(held, "digest", "left_semi")

    def append(self, keyed: DataFrame, scratch: Scratch, batch: str = "0") -> None:
        """Add the digests of `keyed` (doc_id, digest): new texts under their smallest id, known ones as repeats."""
        self.attach()
        fresh = scratch.table(keyed.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n_rows")), f"fresh-{batch}")
        new, old = (scratch.table(df, f"{kind}-{batch}") for kind, df in zip(("new", "old"), self.split(fresh), strict=True))
        for name, df in ((self.texts, new), (self.again, old)):
            rows = df.repartition(self.buckets, "digest").select("digest", "keep_id", "n_rows")
            writer = rows.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet")
            (writer.option("path", f"{self.path}/{name.rsplit('_', 1)[1]}") if self.path else writer).saveAsTable(name)
            self.spark.catalog.refreshTable(name)
        for kind in ("fresh", "new", "old"):
            scratch.drop(f"{kind}-{batch}")

    def groups(self) -> DataFrame:
        """(held, first_id, least_id, n_rows) of every text, all its batches taken together, without a shuffle."""
        more = self.spark.table(self.again).groupBy(F.col("digest").alias("of")).agg(F.min("keep_id").alias("least"), F.sum("n_rows").alias("more"))
        both = self.known().hint("merge").join(more, F.col("digest") == F.col("of"), "left")
        return both.select(F.col("digest").alias("held"), F.col("keep_id").alias("first_id"), F.least("keep_id", "least").alias("least_id"), (F.col("n_rows") + F.coalesce("more", F.lit(0))).alias("n_rows"))


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("text")).alias("digest"))


def resolved(keyed: DataFrame, index: DigestIndex, scratch: Scratch, keep: str) -> DataFrame:
    """Each row of the table `keyed` (doc_id, digest) with its text's group; `keep` names the id that stays.

    Rows of texts that make up HOT of all rows or more, and FEW at least, meet a broadcast table of them, which has 1 / HOT rows at
    most; all others are shuffled to the index, which is read in place.
    """
    total = keyed.count()
    groups = index.groups().select("held", F.col(keep).alias("keep_id"), "n_rows")
    hot = keyed.groupBy(F.col("digest").alias("common")).agg(F.count("*").alias("n")).where(F.col("n") >= F.lit(max(FEW, HOT * total))).select("common")
    hot = scratch.table(hot, "hot")
    known = scratch.table(groups.join(F.broadcast(hot), F.col("held") == F.col("common")).drop("common"), "hot-groups")
    marked = keyed.join(F.broadcast(known.withColumnRenamed("held", "common")), F.col("digest") == F.col("common"), "left")
    first = marked.where(F.col("common").isNotNull())
    rest = keyed.join(F.broadcast(hot), F.col("digest") == F.col("common"), "left_anti").repartition(index.buckets, "digest")
    rest = rest.join(groups.hint("merge"), F.col("digest") == F.col("held"))
    columns = ["doc_id", "keep_id", F.col("n_rows").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    return first.select(columns).unionByName(rest.select(columns))


def exact_dedup(docs: DataFrame, index: DigestIndex, scratch: Scratch) -> DataFrame:
    """Deduplicate `docs` as one batch against `index` and add to it what is new.

    Every input row comes back once with doc_id, keep_id (the row that keeps the text: the one of an earlier
    batch if the index knew the text, else the smallest doc_id of this batch), group_size (rows of that text
    in all batches so far), kept and text_sha256.

    Defined cases: null text counts as the empty text; rows that repeat the same doc_id and text each
    come back and each is `kept` when it is the kept id; a null doc_id is never the kept one unless its
    group has no other id, then keep_id is null and kept is true; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    keyed = scratch.table(digests(docs), "digests")
    index.append(keyed, scratch)
    return resolved(keyed, index, scratch, "first_id")


def exact_dedup_whole(docs: DataFrame, index: DigestIndex, scratch: Scratch, batches: int = BATCHES) -> DataFrame:
    """As exact_dedup over a whole collection that comes in `batches` parts, by a hash of the id, each of which meets what the parts before it left in the index.

    Here keep_id is the smallest doc_id of the text in all parts, and group_size counts all of them.
    """
    keyed = scratch.table(digests(docs).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), "digests")
    for k in range(batches):
        index.append(keyed.where(F.col("batch") == k), scratch, str(k))
    return resolved(keyed.drop("batch"), index, scratch, "least_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, in two batches, against an index that is new at the start; the index leaves the catalog at the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scratch = Scratch(spark, "exact-dedup")
    name = "digest_index_" + scratch.root.rsplit("-", 1)[1]
    index = DigestIndex(spark, name, scratch.path("index"), max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    try:
        return scratch.table(exact_dedup_whole(docs, index, scratch), "result")
    finally:
        index.drop()
        scratch.drop("index")
        scratch.drop("digests")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
