"""A sample that matches target proportions of categories, by the cube method.

Flight phases on the indicators of the category cells run per bucket of records: within a
cell two records trade their inclusion probabilities until one of them is decided, which
keeps every cell's expected count exactly. Undecided records (one a cell and bucket at most)
merge upward by cell; the last ones, one a cell, fly once more under the marginal totals
of each category field, and the landing phase drops those constraints one by one.

The buckets are those of a hash of the record, as many as the number of records asks for, so
the same records are drawn on any cluster.

Defined results: a record with a null in a category field is in no cell. A record that
comes several times counts once a cell; for the draw it is in the cell of its latest
row (ties: the larger cell). Targets without records get no rows and a report line;
cells without a target are not sampled. Empty tables give an empty sample and a report of
zero pools. Only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.runtime import stage, unstage

#: Targets are a small table; the operator refuses more cells than this.
MAX_CELLS = 1_000_000
#: Records that fly in one bucket.
BUCKET_ROWS = 500_000


@dataclass
class BalancedSample:
    """``sample`` (id, cell fields) and ``report`` (one row a target cell)."""

    sample: DataFrame
    report: DataFrame
    sample_size: int


def allocate(pool: np.ndarray, share: np.ndarray, least: np.ndarray, size: int) -> np.ndarray:
    """Expected rows per cell: share x a common factor, between min(least, pool) and pool, adding up to ``size`` where the bounds allow."""
    low = np.minimum(least, pool).astype(float)
    at = lambda f: np.clip(share * f, low, pool)
    if not len(pool) or at(0.0).sum() >= size:
        return low
    lo, hi = 0.0, float(max(size, 1))
    while at(hi).sum() < size and hi < 1e18:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if at(mid).sum() < size else (lo, mid)
    return at(hi)


def _draws(ids: np.ndarray, seed: int) -> np.ndarray:
    """A uniform number per record that depends on nothing but the record and the seed."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53


def flight(frames: Iterator[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    """Cube flight on cell indicators over a stream of (bucket, key, cell, p) ordered by bucket, in bounded memory.

    With indicators of exclusive cells as constraints, the kernel has a basis of vectors
    on two records of one cell; each step moves along such a vector to the border of the
    unit cube. Decided records are passed on with p 0 or 1, at the end of a bucket one a cell is left.
    """
    open_: dict[int, tuple[int, float]] = {}
    here = None

    def table(rows: list[tuple[int, int, float]]) -> pd.DataFrame:
        k, c, p = zip(*rows) if rows else ((), (), ())
        return pd.DataFrame({"key": np.array(k, dtype=np.int64), "cell": np.array(c, dtype=np.int64), "p": np.array(p, dtype=np.float64)})

    for frame in frames:
        out: list[tuple[int, int, float]] = []
        for b, k, c, p, u in zip(*(frame[n].tolist() for n in ("bucket", "key", "cell", "p")), _draws(frame["key"].to_numpy(), seed).tolist()):
            if b != here:
                out += [(k_, c_, p_) for c_, (k_, p_) in open_.items()]
                open_, here = {}, b
            if p <= 0.0 or p >= 1.0:
                out.append((k, c, p))
                continue
            if (held := open_.get(c)) is None:
                open_[c] = (k, p)
                continue
            other, q = held
            total = p + q
            if total < 1.0:  # one takes all, the other drops out
                stays, goes, left, done = (k, other, total, 0.0) if u * total < p else (other, k, total, 0.0)
            else:  # one is taken, the other keeps the rest
                left, done = total - 1.0, 1.0
                stays, goes = (other, k) if u * (2.0 - total) < 1.0 - q else (k, other)
            out.append((goes, c, done))
            if left < 1e-9 or left > 1 - 1e-9:
                out.append((stays, c, float(round(left))))
                del open_[c]
            else:
                open_[c] = (stays, left)
        yield table(out)
    yield table([(k, c, p) for c, (k, p) in open_.items()])


def cube(p: np.ndarray, marks: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cube method for records of which each is in a few exclusive categories.

    ``marks`` (records x fields) are numbers of categories, those of the most important field
    the smallest; the totals of all categories are the constraints. A step needs only as many
    records, taken in the order of their categories, as they have categories among them and one
    more, so it is small however many categories there are. When no such records are left, the
    landing drops first the categories with a single open record, which nothing can balance, and
    then the least important one, and goes on.
    """
    p, eps = p.astype(float).copy(), 1e-9
    free = [i for i in np.lexsort(marks.T).tolist() if eps < p[i] < 1 - eps]
    own = [set(row) for row in marks.tolist()]
    gone: set[int] = set()
    start = 0
    while free:
        window, active = [], set()
        for at in range(start, len(free)):
            window.append(free[at])
            active |= own[free[at]] - gone
            if len(window) > len(active):
                break
        else:
            if start:
                start = 0
                continue
            counts = Counter(c for i in free for c in own[i] - gone)
            single = {c for c, n in counts.items() if n == 1}
            gone |= single or {max(counts)}
            continue
        columns = sorted(active)
        m = np.array([[c in own[i] for i in window] for c in columns], dtype=float).reshape(len(columns), len(window))
        u = np.linalg.qr(m.T, mode="complete")[0][:, -1] if columns else np.ones(1)  # orthogonal to every row of m
        some = np.array(window)
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 1e-9, (1 - p[some]) / u, np.where(u < -1e-9, -p[some] / u, np.inf)).min()
            down = np.where(u > 1e-9, p[some] / u, np.where(u < -1e-9, (p[some] - 1) / u, np.inf)).min()
        p[some] = p[some] + up * u if rng.random() < down / (up + down) else p[some] - down * u
        p[some] = np.where(p[some] < eps, 0, np.where(p[some] > 1 - eps, 1, p[some]))
        kept = [i for i in window if 0 < p[i] < 1]
        free[start : start + len(window)] = kept
        start = max(0, start - 1) if kept else start
        if start >= len(free):
            start = 0
    return np.round(p)


def balanced_sample(df: DataFrame, targets: DataFrame, id_col: str, cell_cols: list[str], share_col: str, min_col: str, order_col: str | None = None, fraction: tuple[int, int] = (1, 10), seed: int = 20250810) -> BalancedSample:
    """Draw ``fraction`` of the distinct records so that each cell has its target share.

    ``order_col`` picks the latest cell of a record that is in several. A cell falls short
    if its pool is below its minimum or below share x sample size (not rounded).
    """
    spark = df.sparkSession
    if dict(df.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("ids must be whole numbers")
    names = [f"c{i}" for i in range(len(cell_cols))]
    rows = df.select(F.col(id_col).cast("long").alias("key"), *[F.col(c).alias(n) for c, n in zip(cell_cols, names)], *([F.col(order_col).alias("o")] if order_col else [F.lit(0).alias("o")]))
    rows = rows.where(" and ".join(f"{n} is not null" for n in ["key", *names]))
    units = stage(rows.groupBy("key", *names).agg(F.max("o").alias("o")), "sample-units")
    size = units.select("key").distinct().count() * fraction[0] // fraction[1]

    goal = targets.select(*[F.col(c).alias(n) for c, n in zip(cell_cols, names)], F.col(share_col).cast("double").alias("share"), F.coalesce(F.col(min_col), F.lit(0)).cast("long").alias("least"))
    draw = units.groupBy("key").agg(F.max_by(F.struct(*names), F.struct(F.col("o").isNotNull(), "o", *names)).alias("c")).select("key", *[F.col(f"c.{n}").alias(n) for n in names])
    pools = units.groupBy(*names).agg(F.count("*").alias("pool"))
    drawable = draw.groupBy(*names).agg(F.count("*").alias("drawable"))
    plan = goal.join(pools, names, "left").join(drawable, names, "left").fillna(0, ["pool", "drawable"]).orderBy(*names)
    table = plan.limit(MAX_CELLS + 1).toPandas()  # the targets table, bounded just below
    if len(table) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} target cells")
    table["cell"] = np.arange(len(table), dtype=np.int64)
    table["expected"] = allocate(table["drawable"].to_numpy(), table["share"].fillna(0).to_numpy(), table["least"].to_numpy(), size) if len(table) else 0.0
    table["p"] = np.where(table["drawable"] > 0, table["expected"] / table["drawable"].clip(lower=1), 0.0)
    types = {f.name: f.dataType.simpleString() for f in plan.schema}
    fields = [*names, "cell", "share", "least", "pool", "expected", "p"]
    kinds = ", ".join(f"{n} {types.get(n, 'long' if n == 'cell' else 'double')}" for n in fields)
    whole = {n for n in fields if types.get(n, "long" if n == "cell" else "double") in ("tinyint", "smallint", "int", "bigint", "long")}
    plain = lambda n, v: None if pd.isna(v) else int(v) if n in whole else v  # noqa: E731  (a null makes whole numbers floats)
    cells = spark.createDataFrame([tuple(plain(n, v) for n, v in zip(fields, row)) for row in table[fields].astype(object).itertuples(index=False)], kinds)

    run = lambda it: flight(it, seed)
    schema = "key long, cell long, p double"
    order = ["bucket", F.xxhash64("key", F.lit(seed)), "key"]
    buckets = max(1, -(-int(table["drawable"].sum()) // BUCKET_ROWS))
    first = draw.join(F.broadcast(cells.where("p > 0").select(*names, "cell", "p")), names).select(F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(buckets)).alias("bucket"), "key", "cell", "p")
    first = stage(first.repartitionById(min(buckets, 20_000), F.col("bucket").cast("int")).sortWithinPartitions(*order).mapInPandas(run, schema), "sample-flight")
    decided, merge = first.where("p >= 1"), first.where("p > 0 and p < 1")
    # at most one record a cell and bucket merges upward; all of a cell meet in one task
    merge = merge.withColumn("bucket", F.lit(0)).select("bucket", "key", "cell", "p")
    second = stage(merge.repartition("cell").sortWithinPartitions(*order).mapInPandas(run, schema), "sample-merge")

    # categories are numbered field by field, the field with the fewest first, after the one of all records
    codes = sorted((pd.factorize(table[n])[0] for n in names), key=lambda c: c.max(initial=-1))
    marks, base = [np.zeros(len(table), dtype=np.int64)], 1
    for c in codes:
        marks.append(c + base)
        base += int(c.max(initial=-1)) + 1
    marks = np.column_stack(marks)

    def land(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = pd.concat([*frames, pd.DataFrame({"key": [], "cell": [], "p": []})]).astype({"key": "int64", "cell": "int64", "p": "float64"}).sort_values("cell")
        if len(rest):
            rest["p"] = cube(rest["p"].to_numpy(), marks[rest["cell"].to_numpy()], np.random.default_rng(seed))
        yield rest[["key", "cell", "p"]]

    last = second.where("p > 0 and p < 1").coalesce(1).mapInPandas(land, "key long, cell long, p double")
    taken = stage(decided.unionByName(second.where("p >= 1")).unionByName(last.where("p >= 1")).select("key", "cell"), "sample-taken")
    for done in (units, first, second):
        unstage(done)
    named = F.broadcast(cells)
    sample = taken.join(named, "cell").select(F.col("key").alias(id_col), *[F.col(n).alias(c) for n, c in zip(names, cell_cols)])
    report = cells.join(taken.groupBy("cell").agg(F.count("*").alias("selected")), "cell", "left").fillna(0, ["selected"])
    report = report.select(
        *[F.col(n).alias(c) for n, c in zip(names, cell_cols)], "pool", F.col("share").alias("target_share"), F.col("least").alias("min_rows"),
        (F.col("share") * size).alias("target_rows"), F.col("expected").alias("expected_rows"), F.col("selected").alias("selected_rows"),
        (F.col("selected") - F.col("share") * size).alias("residual_rows"),
        F.coalesce((F.col("pool") < F.col("least")) | (F.col("pool") < F.col("share") * size), F.lit(False)).alias("short"),
    )
    return BalancedSample(sample, report, size)
