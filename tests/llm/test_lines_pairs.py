"""Operators on texts against brute force, with nulls, empty texts, ties, repeats and empty tables."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from loomline.llm import copy_ledger, near_duplicates, repeated_lines
from loomline.runtime import expand_pairs, stage


def test_repeated_lines(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        lines = [f"eigen zin {i} nummer {rng.randint(0, 10**6)} x{j}{'q' * (i % 7)}{i}" for j in range(3)]
        lines.insert(rng.randint(0, 3), rng.choice(["Lees  ook: 12 stukken", "lees ook:  7 stukken\r", "", "***"]))
        rows.append((i, rng.choice(["a", "b", None]), rng.choice(["\n".join(lines), "\n".join(lines), None, ""]), "clash"))
    rows += [(900 + i, "tiny", "zelfde regel", "clash") for i in range(8)] + [(950 + i, "few", "zeven keer", "clash") for i in range(7)]
    df = spark.createDataFrame(rows, "id long, source string, text string, block string")
    found = repeated_lines.repeated_lines(df, "id", "source", "text")
    fold = lambda s: re.sub(r"\d+", "0", re.sub(r"\s+", "", s.lower()))
    docs, where = defaultdict(set), defaultdict(set)
    for i, s, t, _ in rows:
        if s and t:
            docs[s].add(i)
            for n, line in enumerate(t.split("\n")):
                if re.search(r"[^\W\d_]", line):
                    where[s, fold(line)].add((i, n))
    want = {x for (s, _), v in where.items() if len({i for i, _ in v}) >= 8 and len({i for i, _ in v}) * 20 >= len(docs[s]) for x in v}
    assert {(r["id"], r["line_no"]) for r in found.occurrences.collect()} == want and want
    clean = {r["id"]: r for r in found.clean().collect()}
    assert len(clean) == len(rows)
    for i, _, t, _ in rows:
        keep = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want)
        assert clean[i]["text"] == keep
    monkeypatch.setattr(repeated_lines, "BROADCAST_ROWS", 0)
    assert {r["id"]: r for r in found.clean().collect()} == clean
    assert repeated_lines.repeated_lines(df.where("false"), "id", "source", "text").occurrences.count() == 0


def test_repeated_lines_of_one_id(spark):
    """Rows with the same id are documents of their own, in one source or in two."""
    rows = [(i % 5, "a", f"vaste regel\neigen {'xyz'[i % 3] * i} zin") for i in range(10)] + [(3, "b", "vaste regel")]
    found = repeated_lines.repeated_lines(spark.createDataFrame(rows, "id long, s string, t string"), "id", "s", "t")
    assert sorted((r["id"], r["source"], r["line_no"]) for r in found.occurrences.collect()) == sorted((i % 5, "a", 0) for i in range(10))
    got = sorted((r["t"], r["lines_removed"]) for r in found.clean().collect())
    assert got == sorted([(t.split("\n")[1], 1) for _, s, t in rows if s == "a"] + [("vaste regel", 0)])


def _near_rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(60)]
        for k in range(rng.randint(1, 4)):
            own = base[:]
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), rng.choice([None, "Titel hier"]), " ".join(own) + rng.choice(["", "!", " ."])))
    return rows + [(1000, "a b", None), (1001, "a b", ""), (1002, None, "een twee"), (1003, None, "een, twee drie"), (1004, None, "EEN twee: drie"), (1005, "x", "lang " * 20_000)]


def test_near_duplicates(spark, monkeypatch):
    rows = _near_rows()
    sets = {}
    for i, t, b in rows:
        w = re.findall(r"[^\W_]+", f"{t or ''} {b or ''}".lower())
        if b and len(w) > 2:
            sets[i] = set(zip(w, w[1:], w[2:]))
    want = {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "id long, t string, b string").withColumn("set_id", F.lit("clash"))
    found = near_duplicates.near_duplicates(df, "id", "t", "b", words=3, threshold=(1, 2), blocks=64)
    links = {(r["a"], r["b"]) for r in near_duplicates.linked_pairs(found).collect()}
    assert links == want and len(want) > 50
    monkeypatch.setattr(near_duplicates, "CLASS_MEMBERS", 1)
    monkeypatch.setattr(near_duplicates, "FILTER_BITS", 1 << 16)
    text = near_duplicates.near_duplicates(df.select(F.concat(F.lit("x"), F.lpad("id", 6, "0")).alias("id"), "t", "b"), "id", "t", "b", words=3, threshold=(1, 2), blocks=64)
    assert {(int(r["a"][1:]), int(r["b"][1:])) for r in near_duplicates.linked_pairs(text).collect()} == links
    groups = {r["id"]: r["group_id"] for r in near_duplicates.groups(found).collect()}
    assert all(groups[a] == groups[b] for a, b in want)
    empty = near_duplicates.near_duplicates(df.where("false"), "id", "t", "b")
    assert near_duplicates.linked_pairs(empty).count() == 0


def test_copies_of_a_class(spark, monkeypatch):
    """Records with one set of shingles and different keys, more of them than a task lists at once."""
    monkeypatch.setattr(near_duplicates, "CLASS_MEMBERS", 8)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, None, " ".join(words)) for i in range(50)] + [(100 + i, None, " ".join(words[:39] + ["anders"])) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, t string, b string")
    same = near_duplicates.near_duplicates(df, "id", "t", "b", copy_ledger.canonical_key("t", "b"), words=3, threshold=(1, 2), blocks=16)
    assert {tuple(r) for r in near_duplicates.linked_pairs(same).collect()} == {(a, b) for a in range(50) for b in range(100, 120)}
    apart = near_duplicates.near_duplicates(df, "id", "t", "b", words=3, threshold=(1, 2), blocks=16)
    assert near_duplicates.linked_pairs(apart).count() == 70 * 69 // 2


def test_bloom_filter(spark):
    df = spark.range(5_000).select(F.xxhash64("id").alias("h"))
    bits = near_duplicates.bloom_filter(df, "h", 5_000)
    hashes = spark.range(20_000).select(F.xxhash64("id").alias("h")).toPandas()["h"].to_numpy()
    hit = near_duplicates.may_contain(bits, hashes)
    assert hit[:5_000].all() and hit[5_000:].mean() < 0.02


def test_large_blocks(spark):
    """More sets in a block than one task pairs: the fragments find every pair."""
    base = [f"u{k}" for k in range(120)]
    rows = [(i, None, " ".join(base[:60] + [f"v{i}"] + base[60:])) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, t string, b string")
    found = near_duplicates.near_duplicates(df, "id", "t", "b", words=3, threshold=(1, 2), blocks=16)
    assert near_duplicates.linked_pairs(found).count() == 90 * 89 // 2

def test_buckets(monkeypatch):
    """Pairs and rows for the fragments together are all pairs of a block, also where a bucket is more than a task holds."""
    import pyarrow as pa

    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "b", "c"]) + str(rng.randrange(6)) for _ in range(9)) for _ in range(150)] + ["kort", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), *[pa.array([0] * len(texts))] * 2, pa.nulls(len(texts), pa.string()), pa.array(texts)], names=["id", "k1", "k2", "t", "b"])
    marks = list(near_duplicates.fingerprint(2, 8, 1, 1, 3)(iter([batch.slice(0, 70), batch.slice(70)])))
    table = pa.Table.from_batches(marks).sort_by("bucket")
    where = defaultdict(set)
    for payload in table.column("payload").drop_null().to_pylist():
        for n in range(0, len(payload), 16):
            where[payload[n : n + 8]].add(int.from_bytes(payload[n + 8 : n + 16], "little", signed=True))
    pairs = lambda sets: {(x, y) for s in sets for x in s for y in s if x < y}
    for held, members in ((8_000_000, 64), (8_000_000, 3), (200, 64), (1, 64)):
        monkeypatch.setattr(near_duplicates, "HELD_PAIRS", held)
        monkeypatch.setattr(near_duplicates, "BLOCK_MEMBERS", members)
        out = pa.Table.from_batches(near_duplicates.block_pairs(8)(iter(table.to_batches(max_chunksize=40))))
        rows = out.select(["block", "a", "b", "id"]).to_pylist()
        open_ = defaultdict(set)
        for r in rows:
            if r["block"] is not None:
                open_[r["block"]].add(r["a"])
        assert {tuple(sorted((r["a"], r["b"]))) for r in rows if r["b"] is not None} | pairs(open_.values()) == pairs(where.values())
        assert sorted(r["id"] for r in rows if r["id"] is not None) == list(range(150)) and bool(open_) == (members == 3 or held < 8_000_000)



def test_copies(spark):
    rows = [
        (1, "Titel", "Rubriek: A b | Plaats: C\nTekst, hier.", "2020-01-02"), (2, " TITEL!", "Plaats: C / Rubriek: a B\ntekst hier", "2020-01-01"), (3, "Titel", "Rubriek: A b | Plaats: D\nTekst, hier.", "2020-01-01"),
        (4, None, "x y", "2021-01-01"), (5, "", "X\tY", None), (6, "z", None, "2020-01-01"), (7, "z", "", "2020-01-01"), (8, None, "Straße", "2020-05-05"), (9, None, "STRASSE", "2020-05-05"), (10, None, "x y", "2019-01-01"),
    ]
    df = spark.createDataFrame(rows, "id long, t string, b string, at string").withColumn("copies", F.lit("clash"))
    found = copy_ledger.collapse(df.withColumn("at", F.to_timestamp("at")), "id", "t", "b", "at")
    pairs = {(r["a"], r["b"]) for r in expand_pairs(stage(found.keys.select(F.struct("k1", "k2").alias("k"), "id"), "t"), "k", "id").collect()}
    assert pairs == {(1, 2), (4, 5), (4, 10), (5, 10), (8, 9)}
    assert {(r["first_id"], r["copies"]) for r in found.ledger.collect()} == {(2, 2), (3, 1), (10, 3), (8, 2)}
    text = copy_ledger.collapse(df.withColumn("at", F.to_timestamp("at")).withColumn("id", F.concat(F.lit("x"), F.lpad("id", 3, "0"))), "id", "t", "b", "at")
    assert {(r["first_id"], r["copies"]) for r in text.ledger.collect()} == {("x002", 2), ("x003", 1), ("x010", 3), ("x008", 2)}
    assert copy_ledger.collapse(df.where("false").withColumn("at", F.to_timestamp("at")), "id", "t", "b", "at").ledger.count() == 0


def test_marks_and_composition(spark):
    """The composed and the decomposed form of a letter are one; signs that are part of a word count."""
    rows = [(1, None, "Café één"), (2, None, "cafe\u0301 e\u0301e\u0301n"), (3, None, "cafe een"), (4, "कि", "x"), (5, "का", "x"), (6, None, "한글"), (7, None, "\u1112\u1161\u11ab\u1100\u1173\u11af")]
    keys = {r["id"]: r["k"] for r in copy_ledger.composed(spark.createDataFrame(rows, "id long, t string, b string"), "t", "b").select("id", copy_ledger.canonical_key("t", "b").alias("k")).collect()}
    assert keys[1] == keys[2] != keys[3] and keys[4] != keys[5] and keys[6] == keys[7]


def test_ledger_opens_again(spark, tmp_path):
    """A ledger that is opened again goes on; a small batch writes only its buckets; a failed batch leaves no trace."""
    folder = f"file://{tmp_path}/ledger"
    rows = [(k, -k, "2020-01-02 00:00:00", 1000 + k) for k in range(200)]
    batch = lambda rs: spark.createDataFrame(rs, "k1 long, k2 long, at string, id long").withColumn("at", F.to_timestamp("at"))
    ledger = copy_ledger.CopyLedger.open(spark, folder, bucket_rows=10)
    assert len(ledger.add(batch(rows))) == ledger.buckets == 16 and ledger.rows == 200
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "ledger").rglob("*.parquet")}
    again = copy_ledger.CopyLedger.open(spark, folder, bucket_rows=10)
    assert again.add(batch([(3, -3, "2020-01-01 00:00:00", 7), (19, -19, None, 8), (19, 5, "2021-01-01 00:00:00", 9)])) == [3] and again.rows == 201
    left = {p for p in files if p.exists() and p.stat().st_mtime_ns == files[p]}
    assert {p.parent.name for p in files.keys() - left} == {"bucket=3"}
    assert again.add(batch([])) == [] and again.version == 2
    (tmp_path / "ledger" / "manifest" / "draft-00000003").write_text("{")
    third = copy_ledger.CopyLedger.open(spark, folder, bucket_rows=10)
    got = {(r["k1"], r["k2"]): (r["copies"], r["first_id"]) for r in third.table().collect()}
    assert len(got) == 201 and got[3, -3] == (2, 7) and got[19, -19] == (2, 1019) and got[19, 5] == (1, 9) and got[0, 0] == (1, 1000)
    assert third.add(batch([(k, k, None, k) for k in range(1_000, 1_300)])) and third.buckets == 32 and third.table().count() == 501 == third.rows
