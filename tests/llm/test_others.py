import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import balanced_sample, canonical_values, mixing, packing, tokens, wrong_encoding
from loomline.llm.queries import SPELLING


def test_balanced_sample(spark):
    rows = [(i, "a" if i % 3 else "b", i % 2 == 0, "2020-01-01", "x") for i in range(600)] + [(5, "a", False, "2021-01-01", "x"), (7, None, True, "2020-01-01", "x"), (None, "a", True, "2020-01-01", "x")]
    df = spark.createDataFrame(rows, "id long, s string, t boolean, o string, pool string")
    goal = spark.createDataFrame([("a", True, 0.5, 2), ("a", False, 0.2, 2), ("b", True, 0.2, 2), ("b", False, 0.1, 150), ("c", True, 0.0, 1), ("c", False, None, None)], "s string, t boolean, share double, least int")
    got = balanced_sample.balanced_sample(df, goal, "id", ["s", "t"], "share", "least", "o")
    report = {(r["s"], r["t"]): r for r in got.report.collect()}
    assert got.sample_size == 60
    assert {k for k, r in report.items() if r["short"]} == {("b", False), ("c", True)}
    for r in report.values():
        assert abs(r["selected_rows"] - r["expected_rows"]) < 1
    sample = got.sample.collect()
    assert len({r["id"] for r in sample}) == len(sample)
    none = balanced_sample.balanced_sample(df.where("false"), goal, "id", ["s", "t"], "share", "least", "o")
    assert none.sample.count() == 0 and none.report.count() == 6


def test_cube_keeps_totals():
    rng = np.random.default_rng(0)
    p = np.full(40, 0.3)
    marks = np.column_stack([np.zeros(40, dtype=int), 1 + np.arange(40) % 2])
    for _ in range(20):
        s = balanced_sample.cube(p, marks, rng)
        assert set(s) <= {0.0, 1.0} and s.sum() == 12 and s[1::2].sum() == 6


def test_cube_balances_marginals():
    """Fields with many and few categories: totals that are whole are kept, the others to the next whole number or so."""
    rng = np.random.default_rng(1)
    outlet, year, flag = np.array([(o, y, f) for o in range(120) for y in range(10) for f in range(2)]).T
    p = rng.uniform(0.05, 0.95, len(outlet))
    p *= 1200 / p.sum()
    p = np.clip(p, 0, 1)
    marks = np.column_stack([np.zeros(len(p), dtype=int), 1 + flag, 3 + year, 13 + outlet])
    s = balanced_sample.cube(p, marks, rng)
    assert set(s) <= {0.0, 1.0} and abs(s.sum() - p.sum()) < 1
    for field, most in ((flag, 1), (year, 2), (outlet, 2)):
        assert np.abs(np.bincount(field, weights=s) - np.bincount(field, weights=p)).max() <= most
    assert balanced_sample.cube(np.array([]), np.empty((0, 2), dtype=int), rng).tolist() == []


def test_cube_keeps_probabilities():
    """Each record is drawn as often as its probability says."""
    p = np.array([0.2, 0.7, 0.5, 0.9, 0.4, 0.3])
    marks = np.column_stack([np.zeros(6, dtype=int), 1 + np.array([0, 0, 1, 1, 2, 2])])
    mean = np.mean([balanced_sample.cube(p, marks, np.random.default_rng(i)) for i in range(3000)], axis=0)
    assert np.abs(mean - p).max() < 0.04


def test_balanced_sample_on_any_cluster(spark, monkeypatch):
    """The same records are drawn however the rows are spread, with one bucket and with several; every cell is within one, marginals and size are kept."""
    rng = np.random.default_rng(2)
    rows = [(i, f"s{rng.integers(12)}", int(rng.integers(2014, 2024)), bool(rng.random() < 0.6)) for i in range(8_000)] + [(9_000 + i, "hot", 2020, True) for i in range(4_000)]
    df = spark.createDataFrame(rows, "id long, s string, y int, t boolean")
    cells = df.groupBy("s", "y", "t").count().withColumn("share", F.col("count") / 12_000).withColumn("least", F.lit(1))
    for bucket_rows in (10**6, 1_000):
        monkeypatch.setattr(balanced_sample, "BUCKET_ROWS", bucket_rows)
        got = [balanced_sample.balanced_sample(df.repartition(n), cells, "id", ["s", "y", "t"], "share", "least") for n in (2, 7)]
        a, b = ({r["id"] for r in g.sample.collect()} for g in got)
        assert a == b and len(a) == got[0].sample_size == 1_200
        report = got[0].report.toPandas()
        assert (report["selected_rows"] - report["expected_rows"]).abs().max() < 1
        for field in ("s", "y", "t"):
            sums = report.groupby(field)[["selected_rows", "expected_rows"]].sum()
            assert (sums["selected_rows"] - sums["expected_rows"]).abs().max() <= 2


REFERENCE = [("Merelander", "De Merelander", "MRL", "Merelkerke"), ("Tarnse Courant", "Tarnse Courant", "TRC", "Tarn"), ("Zeeëndijker", "De Zeeëndijker", "ZED", "Zee")]


def test_canonical_values(spark):
    ref = spark.createDataFrame(REFERENCE, "e string, f string, c string, p string")
    want = {"  de merelnader": "Merelander", "Courant, Tarnse": "Tarnse Courant", "D3 M3r31and3r": "Merelander", "www.tarnse-courant.nl": "Tarnse Courant", "Merelan.": "Merelander", "M.R.L.": "Merelander", "zeeendyker": "Zeeëndijker", "TRC/on": "Tarnse Courant", "Tarnse Courant, editie Zuid": "Tarnse Courant", "Merelkerke Merelander": "Merelander", "Merelander (Merelkerke) online": "Merelander", "Merelander Tarn": None, "De Merelgids": None, "test": None, "": None, "???": None, "Tarnse Tijding": None}
    want |= {"De Merenlder": "Merelander", "tarnes curant": "Tarnse Courant", "Merenldr": None}
    df = spark.createDataFrame([(v, "x") for v in [*want, *want, None]], "v string, entry string")
    got = {r["v"]: r["entry"] for r in canonical_values.map_values(df, "v", ref, "e", ["e", "f", "c"], "p", SPELLING).collect()}
    assert got == want
    plain = {r["v"]: r["entry"] for r in canonical_values.map_values(df, "v", ref, "e", ["e", "f", "c"], "p").collect()}
    assert plain["  de merelnader"] == "Merelander" and plain["D3 M3r31and3r"] is None and plain["TRC/on"] is None
    assert canonical_values.map_values(df, "v", ref.where("false"), "e", ["e", "f", "c"], "p").where("n_entries > 0").count() == 0


def test_canonical_values_all_entries(spark, monkeypatch):
    """An exact hit does not hide its neighbours; any script; a list in pieces gives the same rows."""
    names = ["veldpost", "veldpist", "Østersøen", "Ведомости", "朝日新聞", "हिन्दी समाचार", *(f"blad nummer{i:03d}" for i in range(60))]
    ref = spark.createDataFrame([(n,) for n in [*names, None, "???"]], "e string")
    df = spark.createDataFrame([(v,) for v in ["veldpost", "VELDPAST", "ostersoen", "ведомостн", "朝日新聞", "हिन्दी समाचार", "blad nummer007"]], "v string")
    rows = lambda: {r["v"]: (r["entry"], [(e["distance"], e["entry"]) for e in r["entries"]]) for r in canonical_values.map_values(df, "v", ref, "e", ["e"]).collect()}
    got = rows()
    assert got["veldpost"] == ("veldpost", [(0, "veldpost"), (1, "veldpist")]) and got["VELDPAST"][0] is None and len(got["VELDPAST"][1]) == 2
    assert [got[v][0] for v in ("ostersoen", "ведомостн", "朝日新聞", "हिन्दी समाचार")] == names[2:6]
    assert got["blad nummer007"][0] == "blad nummer007" and len(got["blad nummer007"][1]) > 10
    monkeypatch.setattr(canonical_values, "PIECE_ENTRIES", 20)
    assert rows() == got


def test_automaton_against_brute_force():
    import random

    rng, names = random.Random(4), ["kwelderbode", "hoogmeerstijding", "veldpost", "grensgalmen", "veldpist"]
    trie = canonical_values.Trie([(i, n, "") for i, n in enumerate(names)])

    def osa(a, b):
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    for _ in range(300):
        k = rng.randrange(len(names))
        s = list(names[k])
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(s))
            s[i : i + 1] = rng.choice([[], [rng.choice("xqz")], [s[i], s[i]]])
        typed = "".join(s)
        limit = lambda n: min(canonical_values.allowed(len(n)), canonical_values.allowed(len(typed)))
        assert trie.search(typed) == {i: d for i, n in enumerate(names) if (d := osa(typed, n)) <= limit(n)}, typed


@pytest.mark.parametrize("capacity", [50, 512, 5_000])
@pytest.mark.parametrize("largest", [0.3, 0.6, 1.0])
def test_pack(capacity, largest):
    rng = np.random.default_rng(1)
    sizes = np.concatenate([rng.integers(1, int(capacity * largest) + 1, 900), rng.integers(1, max(2, capacity // 10), 300)])
    box = packing.pack(sizes, capacity)
    room = np.bincount(box, weights=sizes)
    assert room.max() <= capacity and room.min() > 0 and (box >= 0).all()
    plain = packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), [], capacity)[1]
    assert len(room) <= plain


def test_configurations():
    """Every container of a configuration fits, and thirds, which best fit on halves would part, are put together."""
    sizes = np.array([334, 333, 333] * 50 + [501] * 20 + [499] * 20)
    order = np.argsort(-sizes, kind="stable")
    filled = packing.configurations(sizes, order, 1_000, 100)
    assert all(sizes[c].sum() <= 1_000 for c in filled) and len({i for c in filled for i in c}) == sum(map(len, filled))
    assert packing.pack(sizes, 1_000).max() + 1 == 70
    assert packing.pack(np.array([], dtype=np.int64), 10).tolist() == [] and packing.pack(np.array([7, 7, 7]), 7).max() == 2


def test_pack_items(spark):
    items = spark.createDataFrame([(1, 1200), (2, 300), (3, 0), (4, 512), (5, None), (6, 200), (6, 200)], "id long, n long")
    plans = spark.createDataFrame([("p", 512), ("q", None)], "plan string, c long")
    rows = packing.pack_items(items, "id", "n", plans, "plan", "c").collect()
    assert sorted((r["id"], r["piece"], r["tokens"]) for r in rows) == [(1, 0, 512), (1, 1, 512), (1, 2, 176), (2, 0, 300), (3, 0, 0), (4, 0, 512), (6, 0, 200), (6, 0, 200)]
    assert all((r["container"] is None) == (r["tokens"] == 0) for r in rows)
    assert packing.pack_items(items.where("false"), "id", "n", plans, "plan", "c").count() == 0


def test_sainte_lague():
    assert mixing.sainte_lague(np.array([53, 24, 23]), 7, np.full(3, 99)).tolist() == [3, 2, 2]
    assert mixing.sainte_lague(np.array([50.0, 50.0]), 3, np.array([1, 9])).tolist() == [1, 2]
    assert mixing.sainte_lague(np.array([]), 3, np.array([])).tolist() == []


def test_mix(spark):
    items = spark.createDataFrame([(i, "a" if i < 500 else "b" if i < 700 else "c" if i < 705 else "d", 10 + i % 90) for i in range(800)] + [(None, "a", 5), (900, None, 5), (901, "a", None), (902, "a", 0)], "id long, s string, n long")
    goal = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.15, 2), ("gone", 0.05, 2)], "s string, share double, most int")
    got = mixing.mix(items, "id", "s", "n", goal, "share", "most", total=20_000, block_tokens=50)
    report = {r["s"]: r for r in got.report.collect()}
    assert report["a"]["quota_filled"] and report["b"]["quota_filled"] and not report["c"]["quota_filled"] and not report["gone"]["quota_filled"]
    assert not report["a"]["met"] and report["c"]["unfilled_tokens"] > 0  # c and gone fall short, so a has more than its share of what was mixed
    assert abs(report["a"]["mixed_tokens"] - 10_000) <= 100 and report["c"]["most_copies"] == 2
    assert all(r["copies"] <= {"a": 2, "b": 3, "c": 2}[r["s"]] for r in got.records.collect())
    assert mixing.mix(items.where("false"), "id", "s", "n", goal, "share", "most").records.count() == 0


def test_mix_fills_quotas(spark):
    """Source a has less than a block, b is bound by its repeats, c has a text longer than its quota."""
    sizes = {"a": [7, 8, 9], "b": [33] * 7, "c": [10] * 20 + [500]}
    items = spark.createDataFrame([(i, s, n) for s, ns in sizes.items() for i, n in enumerate(ns, 1000 * ord(s))], "id long, s string, n long")
    goal = spark.createDataFrame([("a", 0.25, 2), ("b", 0.5, 3), ("c", 0.25, 3)], "s string, share double, most int")
    got = mixing.mix(items, "id", "s", "n", goal, "share", "most", total=1_800, block_tokens=50)
    report = {r["s"]: r["mixed_tokens"] for r in got.report.collect()}
    assert report == {"a": 2 * 24, "b": 3 * 231, "c": 450}
    assert all(r["copies"] == {"a": 2, "b": 3}[r["s"]] for r in got.records.where("s < 'c'").collect())
    assert max(r["copies"] for r in got.records.where("s = 'c'").collect()) <= 3


def test_mix_beside_a_giant(spark):
    """A text longer than the quota does not keep the others from being repeated; sources without a target do not add to the total."""
    sizes = {"a": [25_000, *[100] * 101], "b": [100] * 400, "none": [1_000] * 100}
    items = spark.createDataFrame([(i, s, n) for s, ns in sizes.items() for i, n in enumerate(ns, 1_000 * ord(s[0]))], "id long, s string, n long")
    goal = spark.createDataFrame([("a", 0.4, 3), ("b", 0.6, 3)], "s string, share double, most int")
    got = mixing.mix(items, "id", "s", "n", goal, "share", "most", block_tokens=64)
    report = {r["s"]: r for r in got.report.collect()}
    assert got.total == 75_100 and report["a"]["met"] and report["b"]["met"] and abs(report["a"]["mixed_tokens"] - 30_040) < 128
    small = mixing.mix(items, "id", "s", "n", goal, "share", "most", total=50_000, block_tokens=64)
    report = {r["s"]: r["mixed_tokens"] for r in small.report.collect()}
    assert abs(report["a"] - 20_000) < 128 and abs(report["b"] - 30_000) < 128


def test_fill_exchanges():
    assert mixing.fill([40, 30, 45], [0, 0, 0], 75, 1, 1, 10_000) == ([0, 1, 1], 0)
    assert mixing.fill([5_000] * 3, [0, 0, 0], 2_000, 9, 1, 512) == ([0, 0, 0], 2_000)
    assert mixing.fill([], [], 5, 1, 1, 1) == ([], 5)


def test_tokens():
    import base64

    import tiktoken

    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    count = tokens.counter()
    for t in ["a b", " a", "a ", "a  b", "a   b\n c", "x\n y\t z", "\n \ny", "it's 12,5 € z", " ", "  ", "a \n", "één  \n\n twee"]:
        assert count(t) == len(whole.encode_ordinary(t)), repr(t)


def test_wrong_encoding(spark):
    clean = ["De coöperatieve caféhouder uit Zeeëndijk vindt één ding “belangrijk” en dat is € 5,2 mln", "L’été à la côte est très agréable, près de la forêt", "Für die große Maßnahme gibt es über € 3 – mehr als nötig", "PÂTURAGE FERMÉ, SÃO, zie § 12"]
    rows = [(i, clean[i % 4] + f" {i}") for i in range(400)]
    bad = {1000 + k: wrong_encoding.garble(clean[k % 3], chain) for k, chain in enumerate(["utf_8>cp1252", "utf_8>latin_1", "utf_8>mac_roman", "utf_8>cp437", "utf_8>cp850", "utf_8>cp1252>utf_8>cp1252", "cp1252>mac_roman", "cp1252>cp850"])}
    rows += [*bad.items(), (2000, "v��r"), (2001, None), (2002, ""), (2003, "ascii"), (2004, (clean[0] + " ") * 500 + bad[1000])]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: r for r in wrong_encoding.find_wrong_encoding(df, "id", "text").collect()}
    assert set(got) == {*bad, 2000, 2004}
    assert all(got[1000 + k]["restored_text"] == clean[k % 3] for k in range(len(bad)))
    assert got[2000]["restored_runs"] == 0 and got[2004]["restored_text"] == (clean[0] + " ") * 500 + clean[0]


@pytest.fixture(scope="module")
def encoding_model():
    """A model of Latin texts only."""
    from collections import Counter

    counts, seen = Counter(), Counter()
    for i in range(400):
        text = ["De coöperatieve caféhouder uit Zeeëndijk vindt één ding “belangrijk” en dat is € 5,2 mln", "L’été à la côte est très agréable, près de la forêt", "Für die große Maßnahme gibt es über € 3 – mehr als nötig"][i % 3]
        for w in dict.fromkeys(w for *_, w in wrong_encoding.windows(f"{text} {i}")):
            counts[w] += 1
            seen.update(set(wrong_encoding._parts(w)[1]))
    return wrong_encoding.train(counts, seen)


@pytest.mark.parametrize("depth", range(1, 7))
def test_wrong_encoding_in_layers(encoding_model, depth):
    bad = clean = "De coöperatieve caféhouder uit Zeeëndijk"
    for _ in range(depth):
        bad = wrong_encoding.garble(bad, "utf_8>cp1252")
    found, restored, _, text = wrong_encoding.repair(encoding_model, bad)
    assert found == restored == 3 and text == clean


@pytest.mark.parametrize("text", ["Привет мир", "Ελληνικά νέα", "朝日新聞が伝えた", "środę będzie więcej świeżych żółtych", "한국어 신문"])
@pytest.mark.parametrize("codec", ["cp1252", "latin_1", "mac_roman"])
def test_wrong_encoding_of_other_scripts(encoding_model, text, codec):
    """Words of scripts that the model was not trained on come back, and are clean as they are."""
    bad = wrong_encoding.garble(text, f"utf_8>{codec}")
    assert wrong_encoding.repair(encoding_model, bad)[3] == text
    assert wrong_encoding.repair(encoding_model, text) == (0, 0, None, text)


def test_wrong_encoding_names_one_chain(encoding_model):
    """Runs that several chains could have made are given to the chain of the whole text."""
    text = "vindt één ding “belangrijk”, dat is € 5, près de la forêt"
    for clean, chain in ((f"{text}; zuschuß“, zegt hij", "utf_8>cp1252"), (f"{text}; zuschuß“, zegt hij", "utf_8>mac_roman"), (text, "utf_8>cp850"), (text, "cp1252>mac_roman")):
        found, restored, named, text = wrong_encoding.repair(encoding_model, wrong_encoding.garble(clean, chain))
        assert (named, text) == (chain, clean) and found == restored


@pytest.mark.parametrize("chain", ["cp1252>cp850", "cp1252>mac_roman"])
def test_wrong_encoding_of_many_copies(spark, chain):
    clean = ["De coöperatieve caféhouder uit Zeeëndijk vindt één ding heel belangrijk", "L’été à la côte est très agréable, près de la forêt", "Für die große Maßnahme gibt es mehr als nötig"]
    bad = wrong_encoding.garble(clean[0], chain)
    rows = [(i, clean[i % 3] + f" {i}") for i in range(400)] + [(1000 + i, bad) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: r["restored_text"] for r in wrong_encoding.find_wrong_encoding(df, "id", "text").collect()}
    assert got == dict.fromkeys(range(1000, 1200), clean[0])


def test_wrong_encoding_is_fitted_on_all_texts(spark):
    """The counts of the model are those of all distinct texts, each once, however many there are."""
    from collections import Counter

    words = ["één", "café", "naïef", "Zeeëndijk", "garçon", "straße", wrong_encoding.garble("belangrijk “café”", "utf_8>cp1252")]
    texts = [f"{words[i % 7]} {i}" for i in range(45_000)]
    counts, seen = Counter(), Counter()
    for t in texts:
        for w in dict.fromkeys(w for *_, w in wrong_encoding.windows(t)):
            counts[w] += 1
            if wrong_encoding._clean(w):
                seen.update(set(wrong_encoding._parts(w)[1]))
    whole = wrong_encoding.train(counts, seen)
    model = wrong_encoding.fit(spark.createDataFrame([(t,) for t in texts + texts[:700] + ["ascii", None]], "text string"), "text")
    assert (model.log_p == whole.log_p).all() and (model.log_c == whole.log_c).all() and model.known == whole.known and model.names == whole.names
    none = wrong_encoding.fit(spark.createDataFrame([("ascii",), (None,)], "text string"), "text")
    assert none.known == frozenset() and wrong_encoding.repair(none, "v�r")[0] == 1


def test_features_of_many_windows():
    windows = ["a \x02é\x03 b", "\x02é\x03", "x\x02“”\x03", "\x02世界\x03!"]
    row, one = np.zeros(wrong_encoding.BUCKETS), np.zeros(wrong_encoding.BUCKETS)
    wrong_encoding.add_features(row, windows, np.array([1.0, 2.0, 3.0, 4.0]))
    for n, w in enumerate(windows, 1):
        np.add.at(one, wrong_encoding._features(w), n)
    assert (row == one).all()
