"""Filling containers of fixed capacity with items of varying size.

Linear grouping: the large items of a shard are sorted and cut into groups of equal
cardinality, each rounded up to its largest item. Over these few sizes a configuration
programme is solved by column generation; its whole part is filled with actual items, and
the rest and the small items follow by best fit, largest first, also into the room that
rounding left. Where best fit alone needs no more containers, a shard takes its packing.

Shards are made by the hash of the item, of about ``shard_items`` items each, so that no
task grows with the data; a shard leaves at most one container much emptier than needed.

Defined results: an item larger than a container gives as many full containers as it
fills and one piece for the rest; no other item is split. Items of size 0 take no room and
have no container (null). Items without an id or a size are left out; repeated ids are
items of their own. No items give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items up to this share of the capacity are small.
SMALL = 0.1
#: Groups of the large items, about 1 / SMALL squared.
GROUPS = 100
#: Steps of the capacity by which the configuration programme measures sizes, rounded up.
STEPS = 1024
#: Shares of the capacity up to which room in the container of a configuration is tried as good; below 0, none is.
LOOSE = (1.0, 0.01, 0.002, 0.0, -1.0)
MAX_PLANS = 1_000


def patterns(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, by column generation on the relaxed programme.

    ``sizes`` are distinct and at most ``capacity``. A revised simplex keeps as many columns
    as sizes; a knapsack finds the column to enter, until none has a price above one. Steps that
    gain nothing may turn in a circle; after as many of them as there are sizes, squared, it stops.
    """
    k = len(sizes)
    basis = np.diag(np.floor(capacity / sizes))
    need = counts.astype(float)
    knapsack = _knapsack(sizes, capacity)
    least, idle = np.inf, 0
    while idle <= k * k:
        try:
            inverse = np.linalg.inv(basis)
        except np.linalg.LinAlgError:
            break
        price, level = inverse.sum(axis=0), inverse @ need
        if level.sum() < least - 1e-9:
            least, idle = level.sum(), 0
        else:
            idle += 1
        enter = knapsack(price)
        if price @ enter <= 1 + 1e-7:
            break
        step = inverse @ enter
        ratio = np.where(step > 1e-9, np.maximum(level, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = enter
    level = np.linalg.solve(basis, need)
    return [(basis[:, i].astype(int), float(level[i])) for i in np.argsort(-level) if level[i] > 1e-9]


def _knapsack(sizes: np.ndarray, capacity: int):
    """A function from prices to the dearest configuration that fits.

    Sizes are measured in at most STEPS steps of the capacity, so the time does not grow with it.
    Layer n has the best configurations of n items for every room.
    """
    unit = -(-capacity // STEPS)
    s, room = -(-sizes // unit), capacity // unit
    most = int(room // s.min())
    before = np.arange(room + 1)[None, :] - s[:, None]
    fits, before = before >= 0, np.maximum(before, 0)

    def run(price: np.ndarray) -> np.ndarray:
        best, last = np.zeros(room + 1), []
        for _ in range(most):
            gain = np.where(fits, best[before] + price[:, None], -np.inf)
            item = gain.argmax(axis=0)
            top = gain[item, np.arange(room + 1)]
            item = np.where(top > best + 1e-12, item, -1)
            if (item < 0).all():
                break
            best = np.maximum(best, top)
            last.append(item)
        out, c = np.zeros(len(sizes)), room
        for item in reversed(last):
            if (g := item[c]) >= 0:
                out[g] += 1
                c -= s[g]
        return out

    return run


def pack(sizes: np.ndarray, capacity: int, small: float = SMALL, groups: int = GROUPS) -> np.ndarray:
    """Container number of each item; every size is from 1 to ``capacity``.

    Containers of configurations are kept up to a room left in them; what the others hold is
    packed by best fit with the rest. Of several such rooms, none being best fit alone, the best packing counts.
    """
    order = np.argsort(-sizes, kind="stable")
    filled = configurations(sizes, order[sizes[order] > small * capacity], capacity, groups)
    room = [capacity - int(sizes[c].sum()) for c in filled]
    best = None
    for share in LOOSE:
        kept = [c for c, r in zip(filled, room) if r <= share * capacity]
        where, n = best_fit(sizes, order, kept, capacity)
        if best is None or n < best[1]:
            best = where, n
    return best[0]


def configurations(sizes: np.ndarray, large: np.ndarray, capacity: int, groups: int) -> list[list[int]]:
    """Containers of large items (in descending order) by the whole part of the configuration programme."""
    if not len(large) or groups < 1:
        return []
    cut = np.array_split(large, min(groups, len(large)))
    tops = np.array([sizes[g[0]] for g in cut])
    kinds = np.unique(tops)[::-1]
    stock = [np.concatenate([g for g, t in zip(cut, tops) if t == kind]).tolist()[::-1] for kind in kinds]
    out = []
    for config, times in patterns(kinds, np.array([len(s) for s in stock]), capacity):
        for _ in range(int(times + 1e-6)):
            got = [stock[g].pop() for g in range(len(kinds)) for _ in range(config[g]) if stock[g]]
            if not got:
                break
            out.append(got)
    return out


def best_fit(sizes: np.ndarray, order: np.ndarray, filled: list[list[int]], capacity: int) -> tuple[np.ndarray, int]:
    """(container of each item, number of containers): the items not yet in a container go, in their order, where least room is left."""
    where = np.full(len(sizes), -1, dtype=np.int64)
    # containers by room, and a bit set of the rooms there are
    by_room: dict[int, list[int]] = {}
    mask = 0
    for c, got in enumerate(filled):
        where[got] = c
        if room := capacity - int(sizes[got].sum()):
            by_room.setdefault(room, []).append(c)
            mask |= 1 << room
    n = len(filled)
    for i in order[where[order] < 0].tolist():
        size = int(sizes[i])
        above = mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            c = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            c, room, n = n, capacity, n + 1
        where[i] = c
        if left := room - size:
            by_room.setdefault(left, []).append(c)
            mask |= 1 << left
    return where, n


def pack_items(items: DataFrame, id_col: str, size_col: str, plans: DataFrame, plan_col: str, capacity_col: str, shard_items: int = 25_000) -> DataFrame:
    """(plan, container, id, piece, size, unused) for every plan of a small table and every item.

    ``items`` is read twice (its count gives the number of shards): stage it if it is dear.
    ``unused`` is the room left in the row's container.
    """
    listed = plans.select(F.col(plan_col).alias("p"), F.col(capacity_col).cast("long").alias("c")).where("p is not null and c > 0").orderBy("p").limit(MAX_PLANS + 1).collect()
    if len(listed) > MAX_PLANS:
        raise ValueError(f"more than {MAX_PLANS} plans")
    kind, plan_kind = dict(items.dtypes)[id_col], dict(plans.dtypes)[plan_col]
    schema = f"plan {plan_kind}, container long, id {kind}, piece int, size long, unused long"
    rows = items.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("size")).where("id is not null and size >= 0")
    if not listed:
        return items.sparkSession.createDataFrame([], f"{plan_col} {plan_kind}, container long, {id_col} {kind}, piece int, tokens long, unused long")
    shards = max(1, -(-rows.count() // shard_items))
    each = F.array(*[F.struct(F.lit(r["p"]).cast(plan_kind).alias("plan"), F.lit(r["c"]).alias("capacity")) for r in listed])
    spread = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(shards))).withColumn("x", F.explode(each)).select("x.plan", "x.capacity", "shard", "id", "size")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        capacity, shard = int(frame["capacity"].iloc[0]), int(frame["shard"].iloc[0])
        size = frame["size"].to_numpy()
        full, rest = size // capacity, size % capacity
        n_full = int(full.sum())
        at = np.repeat(np.arange(len(frame)), full)
        piece = np.arange(n_full) - np.repeat(np.cumsum(full) - full, full)
        left = np.flatnonzero(rest > 0)
        box = pack(rest[left], capacity)
        used = np.bincount(box, weights=rest[left], minlength=1).astype(np.int64) if len(left) else np.zeros(1, dtype=np.int64)
        none = np.flatnonzero(size == 0)
        rows_at = np.concatenate([at, left, none])
        container = np.concatenate([np.arange(n_full), n_full + box, np.zeros(len(none), dtype=np.int64)]) + (shard << 36)
        out = pd.DataFrame(
            {
                "plan": frame["plan"].to_numpy()[rows_at],
                "container": pd.array(container, dtype="Int64"),
                "id": frame["id"].to_numpy()[rows_at],
                "piece": np.concatenate([piece, full[left], np.zeros(len(none), dtype=np.int64)]).astype(np.int32),
                "size": np.concatenate([np.full(n_full, capacity), rest[left], np.zeros(len(none), dtype=np.int64)]),
                "unused": pd.array(np.concatenate([np.zeros(n_full, dtype=np.int64), capacity - used[box] if len(left) else np.empty(0, dtype=np.int64), np.zeros(len(none), dtype=np.int64)]), dtype="Int64"),
            }
        )
        if len(none):
            out.loc[len(out) - len(none) :, ["container", "unused"]] = pd.NA
        return out

    # a task a shard and plan: by size alone, the few numbers of many shards would meet in one task
    packed = spread.repartition(min(shards * len(listed), 20_000), "plan", "shard").groupBy("plan", "shard").applyInPandas(run, schema)
    return packed.select(F.col("plan").alias(plan_col), "container", F.col("id").alias(id_col), "piece", F.col("size").alias("tokens"), "unused")
