"""From raw documents to piece ids: five stages, each an operator of the llm subpackage over all that the one before it kept.

1. The quality classifier drops the documents that it rejects.
2. Line dedup drops lines that many pages of a source share.
3. SimHash near-dedup keeps one document of each group: five-word shingles, fingerprints of 256 bits,
   pairs at 56 or fewer differing bits, links where the shingles' exact Jaccard similarity is 0.8 or more.
4. Mixing reads every source at least once and none more than twice.
5. Piece segmentation encodes each document of the mix.

All stages but the last return the columns of their input; texts change in the second alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftcurve.llm import line_dedup, mixing, pieces, quality, simhash
from driftcurve.llm.storage import Scratch


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more; the classifier learns from the labels of those not held out.

    Null and empty texts are judged as texts without bytes, repeated rows alike; an empty table stays empty.
    """
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate on their source.

    Null texts stay null and count as pages, null sources are one source, repeated rows each count; a text all of
    whose lines go becomes empty; an empty table stays empty.
    """
    return line_dedup.line_dedup(docs, Scratch(spark, "lines")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Documents without an id take part, too; of rows that share an id one stays, by a defined order. Null and
    empty texts are copies of one another; an empty table stays empty. See `simhash.one_of_each`.
    """
    return simhash.one_of_each(docs, Scratch(spark, "near"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for each time that they are read.

    Null and empty texts cost one token, null sources are one source; rows that share id and source are read alike; an
    empty table stays empty.
    """
    return mixing.mixed_documents(docs, Scratch(spark, "mix"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and the next best segmentations of each document.

    Null and empty texts have no pieces; repeated rows each come back; an empty table stays empty.
    """
    return pieces.encode_documents(docs)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("sentencepiece encoding", encode),
]

ORACLE_SQL = None  # SQL expresses neither the network nor the search over piece lattices


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; what each returns is written to the shared folder and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.table(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return STAGES[-1][1](spark, docs, sf_dir)
