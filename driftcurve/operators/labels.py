"""Assembling label sets from several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftcurve.operators.ordering import hash_ranked


def resolve_expert(labels: DataFrame) -> DataFrame:
    """One label per row_index of (row_index, label) votes: rows labelled both ways go by majority if their votes are odd, else go out."""
    votes = labels.groupBy("row_index").agg(F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"))
    one = (F.col("n_pos") == 0) | (F.col("n_neg") == 0)
    odd = (F.col("n_pos") + F.col("n_neg")) % 2 == 1
    return votes.where(one | odd).select("row_index", (F.col("n_pos") > F.col("n_neg")).cast("int").alias("label"))


def union_of(*sets: DataFrame) -> DataFrame:
    """Distinct row_index of several sets."""
    out = sets[0].select("row_index")
    for s in sets[1:]:
        out = out.union(s.select("row_index"))
    return out.distinct()


def reconciled(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """(row_index, label): positives win where both sets have a row. One aggregate instead of an intersection and a difference."""
    both = pos.select("row_index", F.lit(1).alias("label")).union(neg.select("row_index", F.lit(0).alias("label")))
    return both.groupBy("row_index").agg(F.max("label").alias("label"))


def conflicts(pos: DataFrame, neg: DataFrame) -> DataFrame:
    return pos.select("row_index").intersect(neg.select("row_index"))


def index_column(df: DataFrame) -> tuple[DataFrame, str]:
    """The column that identifies rows: row_index, else index, else numbers in an order by the hash of all columns."""
    for c in ("row_index", "index"):
        if c in df.columns:
            return df, c
    numbered = hash_ranked(df, 0, tuple(df.columns))
    return numbered.withColumn("row_index", (F.col("__rank") - 1).cast("bigint")).drop("__rank", "__n"), "row_index"


def labelled_set(pool: DataFrame, known: DataFrame | None, pos: dict[str, DataFrame], neg: dict[str, DataFrame]) -> DataFrame:
    """Known positives and the pool's labelled rows as one table: class, source, _dataset, _orig_idx and all features of either.

    `pos` and `neg` are sets of row_index by the name of their source. A row that both have is positive;
    of several sources on its side the first by name counts.
    """
    pool, key = index_column(pool)
    votes = None
    for label, sets in ((1, pos), (0, neg)):
        for name, s in sets.items():
            one = s.select(F.col("row_index").alias("__i"), F.lit(label).alias("class"), F.lit(name).alias("source"))
            votes = one if votes is None else votes.union(one)
    parts = []
    if known is not None:
        known, own = index_column(known)
        parts.append(known.drop("class", "source").withColumns({"class": F.lit(1), "source": F.lit("known"), "_dataset": F.lit("known"), "_orig_idx": F.col(own).cast("bigint")}))
    if votes is not None:
        chosen = votes.groupBy("__i").agg(F.max(F.struct("class")).getField("class").alias("class"), F.min(F.when(F.col("class") == 1, F.col("source"))).alias("p"), F.min(F.when(F.col("class") == 0, F.col("source"))).alias("n"))
        chosen = chosen.select("__i", "class", F.when(F.col("class") == 1, F.col("p")).otherwise(F.col("n")).alias("source"))
        mine = pool.drop("class", "source").join(chosen, F.col(key) == F.col("__i")).drop("__i")
        parts.append(mine.withColumns({"_dataset": F.lit("pool"), "_orig_idx": F.col(key).cast("bigint")}))
    if not parts:
        raise ValueError("neither known positives nor labels")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def merge_expert(samples: DataFrame, expert: DataFrame, iteration: int) -> DataFrame:
    """Labelled samples after an expert's verdicts (row_index, label): the same label changes nothing, a different one replaces the sample, a new one adds one."""
    e = expert.select(F.col("row_index").alias("__e"), F.col("label").alias("__l"))
    mine = (F.col("row_index") == F.col("__e")) & ~F.col("from_known")
    kept = samples.join(e, mine, "left").where(F.col("__l").isNull() | (F.col("__l") == F.col("label"))).drop("__e", "__l")
    same = samples.where(~F.col("from_known")).select(F.col("row_index").alias("__s"), F.col("label").alias("__k"))
    fresh = e.join(same, (F.col("__e") == F.col("__s")) & (F.col("__l") == F.col("__k")), "left_anti")
    source = F.when(F.col("__l") == 1, "expert_pos").otherwise("expert_neg")
    added = fresh.select(F.col("__e").alias("row_index"), F.col("__l").alias("label"), F.lit(1.0).alias("weight"), source.alias("source"), F.lit(iteration).alias("added_iter"), F.lit(1.0).alias("confidence"), F.lit(1.0).alias("consensus_score"), F.lit(False).alias("from_known"))
    return kept.unionByName(added)


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = ("id", "class", "ts", "index", "row_index", "source", "_dataset", "_orig_idx")) -> list[str]:
    """Numeric and boolean columns that are features."""
    return [c for c, t in df.dtypes if c not in exclude and (t in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal"))]


def warm_up(columns: list[str], iteration: int, start: str = "wv_", every: int = 20, share: float = 0.1) -> list[str]:
    """The features in use at an iteration: those whose names contain `start`, then a tenth more of the rest at every 20th."""
    first = sorted(c for c in columns if start in c)
    if not first:
        raise ValueError(f"no feature contains {start!r}")
    rest = sorted(set(columns) - set(first))
    n = min(len(rest), round(len(rest) * share * (iteration // every)))
    return first + rest[:n]


def matrix_rows(features: DataFrame, columns: list[str]) -> DataFrame:
    """Feature columns scrubbed of undefined and infinite values."""
    from driftcurve.operators.sequences import scrubbed

    return features.select(*(F.col(c) for c in features.columns if c not in columns), *(scrubbed(F.col(c).cast("double")).alias(c) for c in columns))


def with_sequences(samples: DataFrame, pool_sequences: DataFrame, known_sequences: DataFrame, width: int) -> DataFrame:
    """Each sample's sequence by (_dataset, _orig_idx); one point of zeros where there is none."""
    tagged = pool_sequences.select(F.lit("pool").alias("__d"), F.col("id").alias("__i"), "sequence").unionByName(known_sequences.select(F.lit("known").alias("__d"), F.col("id").alias("__i"), "sequence"))
    zero = F.array(F.array(*[F.lit(0.0)] * width).cast(samples.sparkSession.createDataFrame([], tagged.schema).schema["sequence"].dataType.elementType))
    joined = samples.join(tagged, (F.col("_dataset") == F.col("__d")) & (F.col("_orig_idx") == F.col("__i")), "left").drop("__d", "__i")
    return joined.withColumn("sequence", F.coalesce("sequence", zero))

