"""Joins that check what they join, and keys with several candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that come more than once; null keys join with nothing and do not count."""
    rows = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of two tables whose keys are unique; the job fails with the key if one is not.

    Each side becomes one row a key before the join, so a hot key fails and does not multiply.
    Rows of the left with a null in the key stay as they are and join with nothing.
    """
    out = []
    known = " and ".join(f"`{k}` is not null" for k in keys)
    for side, df in (("left", left.where(known)), ("right", right.where(known))):
        rest = [c for c in df.columns if c not in keys]
        one = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct(F.lit(0).alias("_0"), *rest)).alias("_r"))
        fail = F.raise_error(F.concat(F.lit(f"key repeated on the {side}: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
        one = one.withColumn("_r", F.when(F.col("_n") > 1, fail).otherwise(F.col("_r")))
        out.append(one.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]))
    return out[0].join(out[1], keys, "left").unionByName(left.where(f"not ({known})"), allowMissingColumns=True)


def resolve_candidates(left: DataFrame, right: DataFrame, id_col: str, key: str, text: str, size: str) -> DataFrame:
    """(id, candidates, method, resolved): the text that the rows of the right with the same key agree on.

    One candidate is taken. Of several, those with the left's text count if there are any with
    one distinct text among them, else those of its size if they agree, else all if they agree;
    else the key is ambiguous and gives null. The right is one row a key, text and size
    before the join, so repeated candidates cost nothing.
    """
    options = right.where(F.col(key).isNotNull()).groupBy(key, F.col(text).alias("_t"), F.col(size).alias("_s")).agg(F.count("*").alias("_n"))
    rows = left.select(id_col, key, text, size).join(options, key, "left")
    shown = F.coalesce("_t", F.lit("?"))  # a text that is null is a text of its own
    there = F.col("_n").isNotNull()
    steps = [("body_exact", there & F.col("_t").eqNullSafe(F.col(text))), ("word_count_derived", there & F.col("_s").eqNullSafe(F.col(size))), ("candidates_identical", there)]
    counts = [x for name, test in steps for x in (F.count_distinct(F.when(test, shown)).alias(f"n_{name}"), F.min(F.when(test, shown)).alias(f"t_{name}"))]
    found = rows.groupBy(id_col).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("candidates"), *counts)
    method, taken = F.when(F.col("candidates") == 0, "no match").when(F.col("candidates") == 1, "single"), F.when(F.col("candidates") == 1, F.col("t_candidates_identical"))
    for name, _ in steps:
        agreed = F.col(f"n_{name}") == 1
        method = method.when(agreed, name)
        taken = taken.when((F.col("candidates") > 1) & agreed, F.col(f"t_{name}"))
    return found.select(id_col, "candidates", method.otherwise("ambiguous").alias("method"), F.nullif(taken, F.lit("?")).alias("resolved"))
