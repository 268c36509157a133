"""Ordinals, running sums and sequential plans without one task for all rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_total(df: DataFrame, by: list[str], order: str, value: Column, name: str, width: int = 10_000) -> DataFrame:
    """``name``: the sum of ``value`` up to and including the row, in the order of a whole-number column.

    Ranges of ``width`` order values are summed first, and only those sums are accumulated
    in one place, so no task sorts a whole group. Equal order values share one sum.
    """
    df = df.withColumn("_v", value).withColumn("_r", F.floor(F.col(order) / width))
    sums = df.groupBy(*by, "_r").agg(F.sum("_v").alias("_s"))
    sums = sums.withColumn("_b", F.sum("_s").over(W.partitionBy(*by).orderBy("_r").rowsBetween(W.unboundedPreceding, -1))).drop("_s")
    df = df.join(sums, [*by, "_r"])
    return df.withColumn(name, F.coalesce("_b", F.lit(0)) + F.sum("_v").over(W.partitionBy(*by, "_r").orderBy(order))).drop("_v", "_r", "_b")


def dense_ordinal(df: DataFrame, by: list[str], order: str, name: str, start: int = 0, width: int = 10_000) -> DataFrame:
    """Consecutive numbers from ``start`` in the order of a unique whole-number column."""
    return running_total(df, by, order, F.lit(1), name, width).withColumn(name, (F.col(name) + (start - 1)).cast("long"))


def _starts(sizes: list[int], target: int) -> tuple[list[int], list[int]]:
    """For a chunk that begins at each item: how much of the last chunk is filled at the end, and how many chunks there are."""
    n = len(sizes)
    left, number = [0] * n, [0] * n
    total, stop = 0, 0  # the chunk from item p holds the items before ``stop``
    follow = [0] * n
    for p in range(n):
        if stop <= p:
            stop, total = p + 1, sizes[p]
        while stop < n and not (total > 0 and total + sizes[stop] > target):
            total += sizes[stop]
            stop += 1
        follow[p], left[p] = stop, total
        total -= sizes[p]
    for p in reversed(range(n)):
        q = follow[p]
        number[p] = 1 + (number[q] if q < n else 0)
        left[p] = left[q] if q < n else left[p]
    return left, number


def _summary(sizes: list[int], target: int) -> list[tuple[int | None, int, int]]:
    """(open total above which it holds, total left open at the end, chunks begun) of a range of items.

    The first row, with null, is for an open chunk that is still empty. Where a chunk begins soon
    does not matter any more to where the last one does, so few rows differ.
    """
    left, number = _starts(sizes, target)
    rows: list[tuple[int | None, int, int]] = []
    before = 0
    for p, size in enumerate(sizes):
        before += size
        above = target - before
        if rows and rows[-1][0] == above:  # an empty item: the earlier one begins the chunk
            continue
        if rows and rows[-1][1:] == (left[p], number[p]):
            rows.pop()
        rows.append((above, left[p], number[p]))
    return [(None, left[0], number[0] - 1), *rows]


def greedy_chunks(df: DataFrame, by: list[str], order: str, size: str, target: int, width: int = 10_000) -> DataFrame:
    """``chunk``: contiguous chunks of at most ``target``, a single larger item being a chunk of its own.

    One fold over each group in the order of a unique whole-number column: a chunk begins when
    the next item would overflow it. Ranges of ``width`` order values are summed up first, for
    every total that may be open where they begin; one task a group folds these few rows, and
    each range is then folded from its own beginning. Items without an order value come last, in
    no order of their own; a size that is null is 0.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    keys = "".join(f"{c} {kinds[c]}, " for c in by)
    ranged = df.withColumn("_at", F.coalesce(F.col(order).cast("long"), F.lit(2**62))).withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    ranged = ranged.withColumn("_range", F.floor(F.col("_at") / width).cast("long"))

    def head(frame: pd.DataFrame, rows: dict) -> pd.DataFrame:
        return pd.DataFrame({c: [frame[c].iloc[0]] * len(next(iter(rows.values()))) for c in by} | rows)

    def summarise(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = frame.sort_values("_at", kind="stable")["_size"].tolist()
        rows = _summary(sizes, target)
        return head(frame, {"_range": [int(frame["_range"].iloc[0])] * len(rows), "_all": [sum(sizes)] * len(rows), "_above": pd.array([r[0] for r in rows], dtype="Int64"), "_left": [r[1] for r in rows], "_begun": [r[2] for r in rows]})

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        out: dict = {"_range": [], "_open": [], "_chunk": []}
        total, number = 0, 0
        for r, rows in frame.groupby("_range", sort=True):
            for c, v in zip(out, (int(r), total, number)):
                out[c].append(v)
            if total == 0:
                row = rows[rows["_above"].isna()].iloc[0]
            else:
                some = rows[rows["_above"] < total]
                row = None if some.empty else some.loc[some["_above"].idxmax()]
            total, number = (total + int(rows["_all"].iloc[0]), number) if row is None else (int(row["_left"]), number + int(row["_begun"]))
        return head(frame, out)

    def run(frame: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if frame.empty:
            return frame.assign(chunk=[])
        frame, total, number, out = frame.sort_values("_at", kind="stable"), int(state["_open"].iloc[0]), int(state["_chunk"].iloc[0]), []
        for n in frame["_size"].tolist():
            if total > 0 and total + n > target:
                total, number = 0, number + 1
            total += n
            out.append(number)
        return frame.assign(chunk=out)

    sums = ranged.groupBy(*by, "_range").applyInPandas(summarise, f"{keys}_range long, _all long, _above long, _left long, _begun long")
    states = sums.groupBy(*by).applyInPandas(fold, f"{keys}_range long, _open long, _chunk long")
    both = ranged.groupBy(*by, "_range").cogroup(states.groupBy(*by, "_range"))
    return both.applyInPandas(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", _at long, _size long, _range long, chunk int").drop("_at", "_size", "_range")


def first_row(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group, null keys being one group."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def hash_rank(seed: int, key: str) -> Column:
    """A reproducible random order that other engines can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}#"), F.col(key).cast("string")))
