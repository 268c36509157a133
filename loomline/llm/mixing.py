"""Mixing sources so that each holds its target share of the total size.

The total is cut into blocks of equal tokens, which are dealt to the sources by the
highest quotients of Sainte-Laguë (found as a common divisor, so the number of blocks does
not matter); a source whose repeats do not allow its blocks gets all its records as often as
they allow, and the others keep their proportions. A source's blocks are dealt to its shards in
the same way. Within a shard whole passes are taken first; then its records, in a seeded order,
are cut into blocks of equal tokens, of which those that fit are taken in that order. What is left
is filled record by record, by repeats as far as they are allowed, and at last by exchanging
chosen records for longer ones, until less than a block is left or no exchange helps.

Defined results: records without id, source or tokens are not used, nor are sources without a
target. Targets without records are reported with a share of 0; null or negative targets
count as 0, null repeats as 1. Without a total, the mix is as large as all records of sources with
a target. Ties of quotients go to the larger target, then to the name. Empty tables give an empty
mix and a report of zeros. ``quota_filled``: the source holds its target share of the total asked
for, within a block and a hundredth; ``met``: the share reached of what was mixed is as near to
the target from either side; ``unfilled_tokens``: what its blocks lack.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.runtime import stage, unstage

MAX_SOURCES = 100_000


@dataclass
class Mix:
    """``records``: (id, source, tokens, copies) with copies > 0; ``report``: one row a target source."""

    records: DataFrame
    report: DataFrame
    total: int


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients w / (2 n + 1), at most ``caps`` each."""
    w, caps = np.asarray(weights, dtype=float), np.asarray(caps, dtype=np.int64)
    seats = int(min(seats, caps[w > 0].sum())) if len(w) else 0
    out = np.zeros(len(w), dtype=np.int64)
    if seats <= 0:
        return out
    at = lambda f: np.where(w > 0, np.minimum(np.floor(w * f + 0.5), caps), 0).astype(np.int64)
    lo, hi = 0.0, seats / w.sum()
    while at(hi).sum() < seats:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if at(mid).sum() < seats else (lo, mid)
    out = at(lo)
    for _ in range(seats - int(out.sum())):  # the seats of equal quotients
        quotient = np.where((out < caps) & (w > 0), w / (2 * out + 1), -1.0)
        out[int(quotient.argmax())] += 1
    return out


def fill(tokens: list[int], copies: list[int], rest: int, most: int, enough: int, block: int) -> tuple[list[int], int]:
    """Add copies, at most ``most`` of a record, until ``rest`` is below ``enough`` or no step makes it smaller.

    The records stand in their seeded order: blocks of ``block`` tokens that fit are taken
    first, then records, then exchanges of chosen records for a longer one.
    """
    copies, lo = copies[:], 0
    while lo < len(tokens) and rest >= block:
        hi, size = lo, 0
        while hi < len(tokens) and size < block:
            size += tokens[hi]
            hi += 1
        if size <= rest and all(c < most for c in copies[lo:hi]):
            rest -= size
            for i in range(lo, hi):
                copies[i] += 1
        lo = hi
    while rest:
        before = rest
        for i, n in enumerate(tokens):
            if n <= rest and copies[i] < most:
                copies[i] += 1
                rest -= n
        if rest == before and (rest < enough or not (swap := _exchange(tokens, copies, rest, most))):
            break
        if rest == before:
            copies, rest = swap
    return copies, rest


def _exchange(tokens: list[int], copies: list[int], rest: int, most: int) -> tuple[list[int], int] | None:
    """One record more and shorter ones less, so that less is left; null if no such step is found."""
    chosen = sorted((j for j, c in enumerate(copies) for _ in range(c)), key=tokens.__getitem__)
    sizes = [tokens[j] for j in chosen]
    freed = [0, *accumulate(sizes)]
    for i in sorted((i for i, n in enumerate(tokens) if copies[i] < most and n > rest), key=tokens.__getitem__):
        need = tokens[i] - rest
        one, many = bisect_left(sizes, need), bisect_left(freed, need)
        if one < len(sizes) and sizes[one] < tokens[i]:
            gone, left = chosen[one : one + 1], sizes[one] - need
        elif many < len(freed) and freed[many] < tokens[i]:
            gone, left = chosen[:many], freed[many] - need
        else:
            continue
        out = copies[:]
        for j in gone:
            out[j] -= 1
        out[i] += 1
        return out, left
    return None


def mix(items: DataFrame, id_col: str, source_col: str, tokens_col: str, targets: DataFrame, share_col: str, repeats_col: str, total: int | None = None, block_tokens: int = 512, shard_items: int = 20_000, seed: int = 20250810) -> Mix:
    """Mix ``items`` (id, source, tokens) to the shares of a small table of targets with the same source column."""
    spark = items.sparkSession
    kind = dict(items.dtypes)[source_col]
    goal = targets.select(F.col(source_col).alias("source"), F.coalesce(F.greatest(F.col(share_col).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("share"), F.coalesce(F.col(repeats_col).cast("long"), F.lit(1)).alias("repeats"))
    rows = stage(items.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(tokens_col).cast("long").alias("tokens")).where("id is not null and source is not null and tokens > 0"), "mix-items")
    sums = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    table = goal.where("source is not null").join(sums, "source", "left").fillna(0, ["tokens", "n"]).orderBy(F.desc("share"), "source").limit(MAX_SOURCES + 1).toPandas()  # as long as the targets
    if len(table) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    share, have, repeats = table["share"].to_numpy(float), table["tokens"].to_numpy(float), table["repeats"].clip(lower=0).to_numpy()
    live = (share > 0) & (have > 0) & (repeats > 0)
    if total is None:
        total = int(have[share > 0].sum())
    most = np.where(live, np.ceil(have * repeats / block_tokens), 0).astype(np.int64)
    dealt = sainte_lague(np.maximum(share, 0), int(round(min(share.sum(), 1.0) * total / block_tokens)), np.full(len(share), 2**62 // max(len(share), 1)))
    seats = np.minimum(dealt, most)
    table["blocks"], table["dealt"] = seats, dealt
    table["shards"] = np.maximum(1, -(-table["n"].to_numpy() // shard_items))
    known = spark.createDataFrame([(r.source, int(r.blocks), int(r.repeats), int(r.shards)) for r in table.itertuples() if r.blocks > 0], f"source {kind}, blocks long, repeats long, shards long")

    mine = rows.join(F.broadcast(known), "source").withColumn("shard", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("shards")))
    sizes = mine.groupBy("source", "shard").agg(F.sum("tokens").alias("size"), F.first("blocks").alias("blocks"), F.first("repeats").alias("repeats"))

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        """One row a shard of one source."""
        frame = frame.sort_values("shard")
        room = frame["size"].to_numpy(float) * frame["repeats"].to_numpy()
        blocks = int(frame["blocks"].iloc[0])
        if blocks * block_tokens >= room.sum():  # the repeats bind: everything
            frame["quota"] = np.ceil(room / block_tokens).astype(np.int64)
        else:
            frame["quota"] = sainte_lague(frame["size"].to_numpy(float), blocks, np.floor(room / block_tokens + 1).astype(np.int64))
        return frame[["source", "shard", "size", "repeats", "quota"]]

    quotas = sizes.groupBy("source").applyInPandas(deal, f"source {kind}, shard long, size long, repeats long, quota long")
    kinds = f"id {dict(items.dtypes)[id_col]}, source {kind}, tokens long, copies int"

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        """The copies of the records of one shard; a shard has about ``shard_items`` of them."""
        frame = frame.sort_values(["draw", "id"])
        size, repeats = int(frame["size"].iloc[0]), int(frame["repeats"].iloc[0])
        want = min(int(frame["quota"].iloc[0]) * block_tokens, size * repeats)
        passes, rest = divmod(want, size)
        copies, _ = fill(frame["tokens"].tolist(), [passes] * len(frame), rest, repeats, block_tokens, block_tokens)
        copies = np.array(copies, dtype=np.int32)
        return frame.assign(copies=copies)[["id", "source", "tokens", "copies"]][copies > 0]

    placed = mine.select("id", "source", "tokens", "shard", F.xxhash64("id", F.lit(seed + 1)).alias("draw")).join(quotas, ["source", "shard"])
    chosen = placed.groupBy("source", "shard").applyInPandas(choose, kinds)
    chosen = stage(chosen, "mix-chosen")
    unstage(rows)

    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    wide = [(r.source, float(r.share), int(r.repeats), int(r.tokens), int(r.blocks), int(r.dealt)) for r in table.itertuples()]
    base = spark.createDataFrame(wide, f"source {kind}, target_share double, max_repeats long, available_tokens long, blocks long, dealt long")
    report = base.join(F.broadcast(got), "source", "left").fillna(0, ["mixed_tokens", "most_copies"])
    whole = got.agg(F.sum("mixed_tokens")).first()[0] or 0
    actual = F.col("mixed_tokens") / F.lit(max(whole, 1))
    report = report.withColumn("actual_share", actual).withColumn("difference", F.col("actual_share") - F.col("target_share"))
    near = lambda have, want, block: F.abs(have - want) <= 0.01 * want + block
    report = report.withColumn("unfilled_tokens", F.greatest(F.lit(0).cast("long"), F.lit(block_tokens) * F.col("dealt") - F.col("mixed_tokens"))).drop("dealt")
    report = report.withColumn("quota_filled", near(F.col("mixed_tokens"), F.col("target_share") * total, F.lit(block_tokens)))
    report = report.withColumn("met", near(F.col("actual_share"), F.col("target_share"), F.lit(block_tokens / max(whole, 1))))
    return Mix(chosen.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("tokens").alias(tokens_col), "copies"), report.withColumnRenamed("source", source_col), total)
