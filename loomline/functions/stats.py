"""Agreement and contingency statistics from counts, and the tails that SQL lacks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def agreement(n: Column, yy: Column, nn: Column, a: Column, b: Column) -> dict[str, Column]:
    """Raw agreement, kappa, alpha, the highest kappa of the margins and PABAK.

    ``yy`` and ``nn``: both yes, both no; ``a`` and ``b``: yes of each rater. Null where
    chance agreement is 1.
    """
    po, pa, pb = (yy + nn) / n, a / n, b / n
    pe, pool = pa * pb + (1 - pa) * (1 - pb), (a + b) / (2 * n)
    scott = pool * pool + (1 - pool) * (1 - pool)
    defined = lambda e: F.abs(1 - e) > 1e-8 + 1e-5
    return {
        "raw_agreement": po,
        "kappa": F.when(defined(pe), (po - pe) / F.nullif(1 - pe, F.lit(0.0))),
        "alpha": F.when(defined(scott), 1 - (2 * n - 1) / (2 * n) * (1 - (po - scott) / F.nullif(1 - scott, F.lit(0.0)))),
        "kappa_max": F.when(defined(pe), (1 - F.abs(pa - pb) - pe) / F.nullif(1 - pe, F.lit(0.0))),
        "pabak": 2 * po - 1,
    }


def chi_square(counts: DataFrame, by: list[str], row: str, col: str, n: str = "n") -> DataFrame:
    """One row per group of ``by``: n, rows, cols, dof, chi2 (uncorrected), chi2_yates, cramers_v, expected_min.

    Cells of 0 may be missing. Yates' correction only touches 2 x 2 tables; a group with
    fewer than two non-empty rows or columns has no result.
    """
    cells = counts.where(F.col(n) > 0).groupBy(*by, F.col(row).alias("_row"), F.col(col).alias("_col")).agg(F.sum(n).alias("_o"))
    rows, cols = cells.groupBy(*by, "_row").agg(F.sum("_o").alias("_r")), cells.groupBy(*by, "_col").agg(F.sum("_o").alias("_c"))
    whole = rows.groupBy(*by).agg(F.sum("_r").alias("n"), F.count("*").alias("n_rows")).join(cols.groupBy(*by).agg(F.count("*").alias("n_cols")), by).where("n_rows > 1 and n_cols > 1")
    grid = rows.join(cols, by).join(whole, by).join(cells, [*by, "_row", "_col"], "left").fillna(0, ["_o"])
    e = F.col("_r") * F.col("_c") / F.col("n")
    off = F.abs(F.col("_o") - e)
    yates = F.when((F.col("n_rows") == 2) & (F.col("n_cols") == 2), off - F.least(off, F.lit(0.5))).otherwise(off)
    out = grid.groupBy(*by, "n", "n_rows", "n_cols").agg(F.sum(off * off / e).alias("chi2"), F.sum(yates * yates / e).alias("chi2_yates"), F.min(e).alias("expected_min"))
    return out.withColumn("dof", (F.col("n_rows") - 1) * (F.col("n_cols") - 1)).withColumn("cramers_v", F.sqrt(F.col("chi2") / (F.col("n") * (F.least("n_rows", "n_cols") - 1))))


def chi2_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution: the regularised incomplete gamma function, by series or continued fraction."""
    a, z = dof / 2, x / 2
    if z <= 0:
        return 1.0
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= z / k
            total += term
        return 1 - total * scale
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= (step := d * c)
        if abs(step - 1) < 1e-15:
            break
    return scale * h


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of a 2 x 2 table: all tables of its margins that are no likelier."""
    r, s, t = a + b, c + d, a + c
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = np.exp([log(r, k) + log(s, t - k) - log(r + s, t) for k in range(max(0, t - s), min(r, t) + 1)])
    own = p[a - max(0, t - s)]
    return float(min(1.0, p[p <= own * (1 + 1e-7)].sum()))


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) or pd.isna(k) else chi2_tail(float(v), int(k)) for v, k in zip(x, dof)], dtype="float64")


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher(*map(int, x)) for x in zip(a, b, c, d)], dtype="float64")


def _kappas(yy: np.ndarray, nn: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    po, pa, pb = (yy + nn) / n, a / n, b / n
    pe = pa * pb + (1 - pa) * (1 - pb)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isclose(pe, 1), np.nan, (po - pe) / (1 - pe))


def bootstrap_kappa(cells: DataFrame, by: str, resamples: int = 2000, seed: int = 20250810) -> DataFrame:
    """Percentile interval of kappa per group from the four cell counts (yy, yn, ny, nn).

    Resampling items with replacement is a multinomial draw of the cell counts, so a task
    handles four numbers a group, however many items there are. Null below 3 items or with
    fewer than half of the resamples defined.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        c = frame[["yy", "yn", "ny", "nn"]].iloc[0].to_numpy(np.int64)
        n, lo, hi = int(c.sum()), None, None
        if n >= 3:
            x = np.random.default_rng(seed).multinomial(n, c / n, size=resamples)
            k = _kappas(x[:, 0], x[:, 3], x[:, 0] + x[:, 1], x[:, 0] + x[:, 2], n)
            k = k[~np.isnan(k)]
            if len(k) >= resamples / 2:
                lo, hi = (float(v) for v in np.percentile(k, [2.5, 97.5]))
        return pd.DataFrame({by: [frame[by].iloc[0]], "n": [n], "kappa_low": pd.Series([lo], dtype="float64"), "kappa_high": pd.Series([hi], dtype="float64")})

    return cells.groupBy(by).applyInPandas(run, f"{by} {dict(cells.dtypes)[by]}, n long, kappa_low double, kappa_high double")
