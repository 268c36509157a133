import random

import pytest
from pyspark.sql import functions as F

from loomline.functions import json_text, stats


def test_alpha_closed_form(spark):
    """The closed form equals the coincidence matrix on random raters; constant raters are undefined."""
    rng, rows, want = random.Random(1), [], {}
    for i in range(60):
        n = rng.randint(3, 40)
        a, b = [rng.random() < 0.4 for _ in range(n)], [rng.random() < 0.5 for _ in range(n)]
        yy, nn = sum(x and y for x, y in zip(a, b)), sum(not x and not y for x, y in zip(a, b))
        rows.append((i, n, yy, nn, sum(a), sum(b)))
        ones = sum(a) + sum(b)
        exp = 2 * ones * (2 * n - ones) / (2 * n - 1)
        want[i] = 1 - (2 * (n - yy - nn)) / exp if exp else None
    df = spark.createDataFrame([*rows, (99, 5, 5, 0, 5, 5), (98, 4, 2, 2, 2, 2)], "i int, n int, yy int, nn int, a int, b int")
    s = stats.agreement(*(F.col(c) for c in ("n", "yy", "nn", "a", "b")))
    got = {r["i"]: r for r in df.select("i", *[c.alias(k) for k, c in s.items()]).collect()}
    for i, v in want.items():
        assert (got[i]["alpha"] is None) if v is None else got[i]["alpha"] == pytest.approx(v, abs=1e-9)
    assert got[99]["kappa"] is None and got[99]["alpha"] is None and got[98]["kappa"] == 1


def test_tails():
    assert stats.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi2_tail(0, 3) == 1
    assert stats.fisher(3, 1, 1, 3) == pytest.approx(0.485714, abs=1e-6)
    assert stats.fisher(10, 0, 0, 10) == pytest.approx(2 / 184756, rel=1e-9)


def test_chi_square(spark):
    rows = [("t", "a", "y", 10), ("t", "a", "n", 20), ("t", "b", "y", 30), ("t", "b", "n", 5), ("w", "a", "y", 5), ("w", "b", "y", 7), ("z", "a", "y", 3), ("z", "a", "n", 4), ("z", "b", "y", 0), ("z", "b", "n", 0)]
    got = {r["g"]: r for r in stats.chi_square(spark.createDataFrame(rows, "g string, r string, c string, n long"), ["g"], "r", "c").collect()}
    assert set(got) == {"t"}  # one column, or one row that is not empty: no result
    assert got["t"]["chi2"] == pytest.approx(18.726190, abs=1e-5) and got["t"]["chi2_yates"] < got["t"]["chi2"]


def test_bootstrap(spark):
    """The interval against resampling the items one by one; too few items, and raters without variety, have none."""
    import numpy as np

    cells = {"a": (40, 10, 5, 45), "b": (3, 1, 1, 1), "few": (1, 0, 0, 1), "flat": (9, 0, 0, 0)}
    df = spark.createDataFrame([(k, *v) for k, v in cells.items()], "g string, yy long, yn long, ny long, nn long")
    got = {r["g"]: (r["n"], r["kappa_low"], r["kappa_high"]) for r in stats.bootstrap_kappa(df, "g").collect()}
    assert got["few"] == (2, None, None) and got["flat"] == (9, None, None)
    rng = np.random.default_rng(3)
    for k in ("a", "b"):
        pairs = np.repeat([[1, 1], [1, 0], [0, 1], [0, 0]], cells[k], axis=0)
        kappas = []
        for _ in range(4000):
            x, y = pairs[rng.integers(0, len(pairs), len(pairs))].T
            pe = x.mean() * y.mean() + (1 - x.mean()) * (1 - y.mean())
            if not np.isclose(pe, 1):
                kappas.append(((x == y).mean() - pe) / (1 - pe))
        assert got[k][1:] == pytest.approx(np.percentile(kappas, [2.5, 97.5]), abs=0.04)


def test_json_search():
    assert json_text.outermost('x {"a": {"b": 1}} y {"c": 2} z') == '{"c": 2}'
    assert json_text.outermost("none {") is None and json_text.outermost(None) is None
    assert json_text.shallowest('{"x": [{"frames": {"k": 1}}]}', "frames") == '{"k": 1}'
    assert json_text.script_payload('<script>const DATA = {"a": "}\\"", "b": {}};</script>') == '{"a": "}\\"", "b": {}}'
    assert json_text.script_payload("<script>x</script>") is None
