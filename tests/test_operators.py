import random

from pyspark.sql import functions as F

from loomline.operators import order, sampling
from loomline.runtime import broadcast_if_small, expand_pairs, stage
from loomline.sources import files


def fold(sizes, target):
    total, number, out = 0, 0, []
    for n in sizes:
        if total > 0 and total + n > target:
            total, number = 0, number + 1
        total += n
        out.append(number)
    return out


def test_greedy_chunks(spark):
    """One fold over a group, however it is cut into ranges; with empty and oversized items, gaps and a null key."""
    rng = random.Random(8)
    rows, want = [], {}
    for key, sizes in (("a", [400, 500, 300, 900, 100, 5000, 10]), ("b", [rng.choice([0, 0, 1, 5, 30, 300, 999, 1000, 1001, 4000]) for _ in range(3000)]), ("c", [0] * 40 + [2000, 0, 3]), (None, [7] * 400)):
        at = sorted(rng.sample(range(40_000), len(sizes)))
        rows += [(key, i, s) for i, s in zip(at, sizes)]
        want |= {(key, i): c for i, c in zip(at, fold(sizes, 1000))}
    df = spark.createDataFrame(rows, "k string, i long, s long").repartition(5)
    for width in (7, 500, 10_000, 10**6):
        got = {(r["k"], r["i"]): r["chunk"] for r in order.greedy_chunks(df, ["k"], "i", "s", 1000, width).collect()}
        assert got == want, width
    assert order.greedy_chunks(df.where("false"), ["k"], "i", "s", 1000).count() == 0


def test_running_total_and_ordinal(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.randint(0, 9)) for i in rng.sample(range(100_000), 300)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {r["i"]: (r["t"], r["n"]) for r in order.dense_ordinal(order.running_total(df, ["k"], "i", F.col("v"), "t"), ["k"], "i", "n").collect()}
    for key in "ab":
        total = 0
        for n, (_, i, v) in enumerate(sorted(r for r in rows if r[0] == key)):
            total += v
            assert got[i] == (total, n)


def test_expand_pairs(spark):
    rows = [("x", i) for i in range(40)] + [("x", 3), ("y", 1), (None, 5), (None, 6), ("z", 7), ("z", 8), ("z", None)]
    df = stage(spark.createDataFrame(rows, "k string, i long"), "t")
    got = [tuple(r) for r in expand_pairs(df, "k", "i", fragment=8).collect()]
    want = {("x", a, b) for a in range(40) for b in range(a + 1, 40)} | {("z", 7, 8)}
    assert len(got) == len(want) and set(got) == want
    assert expand_pairs(df.where("false"), "k", "i").count() == 0
    assert broadcast_if_small(df, rows=1).count() == len(rows)


def test_sampling(spark):
    df = spark.createDataFrame([(i, "a" if i < 75 else "b" if i < 99 else "c") for i in range(100)], "i long, s string")
    got = sampling.stratified(df, ["s"], "i", F.greatest(F.lit(1), F.bround(F.col("_size") * 0.1)).cast("long")).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {"a": 8, "b": 2, "c": 1}
    assert sampling.proportional(df, ["s"], "i", 20).count() == 20 and sampling.proportional(df, ["s"], "i", 500).count() == 100


def test_sampling_against_one_ranking(spark, monkeypatch):
    """Ranks by bins equal ranks over whole strata, with a null stratum and one that holds most rows."""
    import hashlib

    rows = [(i, None if i % 11 == 0 else "hot" if i % 5 else "cold") for i in range(900)]
    df = spark.createDataFrame(rows, "i long, s string")
    got = {r["i"]: (r["_size"], r["_rank"]) for r in sampling.ranked(df, ["s"], "i", 42).collect()}
    for s in (None, "hot", "cold"):
        ids = sorted((i for i, x in rows if x == s), key=lambda i: hashlib.md5(f"42#{i}".encode()).hexdigest())
        assert [got[i] for i in ids] == [(len(ids), n) for n in range(1, len(ids) + 1)]


def test_top_up(spark):
    rows = [(i, "rich" if i < 50 else "poor", i % 2 == 0, 5) for i in range(56)] + [(100, "none", True, 0), (101, "few", False, 9), (102, "few", None, 9)]
    got = sampling.top_up(spark.createDataFrame(rows, "i long, s string, good boolean, need long"), ["s"], "i", F.col("good"), "need").collect()
    assert len([r for r in got if r["s"] == "rich"]) == 5 and all(r["good"] for r in got if r["s"] == "rich")
    assert len([r for r in got if r["s"] == "poor"]) == 5 and {r["i"] for r in got if r["s"] == "few"} == {101, 102} and not [r for r in got if r["s"] == "none"]


def test_every_kth(spark):
    assert [r["id"] for r in sampling.every_kth(spark.range(105), "id", 105, 20).collect()] == list(range(0, 100, 5))
    assert sampling.every_kth(spark.range(3), "id", 3, 20).count() == 3


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\r\nb", None), (2, ' "q", ', ""), (3, None, "é")], "i long, a string, b string")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), "i long, a string, b string").collect())) == sorted(map(tuple, df.collect()))
    files.write_lines(df, str(tmp_path / "j"))
    (tmp_path / "j" / "bad.txt").write_text("no json\n")
    back = files.read_lines(spark, str(tmp_path / "j"), "i long, a string, b string")
    assert back.count() == 3 and files.verify_written(df, back, ["i"]).count() == 0
