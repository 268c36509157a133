"""Reproducible stratified draws: counts follow the rule, membership follows a hash rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.operators.order import hash_rank

#: Hex digits of the hash by which a stratum is cut into bins that are ranked apart.
BIN_DIGITS = 3


def ranked(df: DataFrame, strata: list[str], key: str, seed: int) -> DataFrame:
    """``_size`` of the row's stratum and its ``_rank`` in it by hash, nulls being a stratum.

    A stratum may hold most of the rows, so it is cut into bins by the first digits of the
    hash: the sizes of the bins give the rank at which each begins, and only rows of one bin meet in a task.
    """
    keys = [f"_s{i}" for i in range(len(strata))]
    rows = df.withColumn("_h", hash_rank(seed, key)).withColumn("_bin", F.substring("_h", 1, BIN_DIGITS))
    w = W.partitionBy(*keys)
    bins = rows.groupBy(*[F.col(c).alias(k) for c, k in zip(strata, keys)], F.col("_bin").alias("_b")).agg(F.count("*").alias("_in"))
    bins = bins.withColumn("_size", F.sum("_in").over(w)).withColumn("_before", F.coalesce(F.sum("_in").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_in")
    same = F.col("_bin") == F.col("_b")
    for c, k in zip(strata, keys):
        same = same & F.col(c).eqNullSafe(F.col(k))
    rows = rows.join(bins, same)
    inner = F.row_number().over(W.partitionBy(*strata, "_bin").orderBy("_h", key))
    return rows.withColumn("_rank", F.col("_before") + inner).drop("_h", "_bin", "_b", "_before", *keys)


def stratified(df: DataFrame, strata: list[str], key: str, wanted: Column, seed: int = 42) -> DataFrame:
    """The first ``wanted`` rows of each stratum by hash rank; ``_size`` is the stratum's size in that expression."""
    return ranked(df, strata, key, seed).where(F.col("_rank") <= wanted).drop("_size", "_rank")


def proportional(df: DataFrame, strata: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all): each stratum its rounded share and at least one, then trimmed or topped up by hash rank.

    The last step is a top-n, which every task applies to its own rows first.
    """
    whole = df.agg(F.count("*").alias("_pool"))
    share = F.least(F.col("_size"), F.greatest(F.lit(1), F.bround(F.col("_size") * n / F.col("_pool")).cast("long")))
    rows = ranked(df, strata, key, seed).join(F.broadcast(whole))
    rows = rows.withColumn("_out", (F.col("_rank") > share).cast("int")).withColumn("_h", hash_rank(seed + 1, key))
    return rows.orderBy("_out", "_h", key).limit(n).drop("_pool", "_size", "_rank", "_out", "_h")


def top_up(pool: DataFrame, strata: list[str], key: str, preferred: Column, need: str, seed: int = 42) -> DataFrame:
    """Rows drawn for each stratum until ``need`` (a column, equal within a stratum) is met.

    From its preferred rows alone if they are enough, else from all of its rows, as many as there are.
    """
    rows = pool.where(F.col(need) > 0).withColumn("_good", F.coalesce(preferred, F.lit(False)))
    counts = rows.groupBy(*strata).agg(F.count_if("_good").alias("_n_good"))
    rows = rows.join(counts, strata)
    rows = rows.where(F.col("_good") | (F.col("_n_good") < F.col(need))).drop("_n_good", "_good")
    return ranked(rows, strata, key, seed).where(F.col("_rank") <= F.col(need)).drop("_size", "_rank")


def every_kth(df: DataFrame, ordinal: str, n: int, most: int) -> DataFrame:
    """About ``most`` rows at equal steps of a dense ordinal from 0, of ``n`` rows in all."""
    return df.where((F.col(ordinal) % max(1, n // most) == 0) & (F.col(ordinal) < max(1, n // most) * most))
