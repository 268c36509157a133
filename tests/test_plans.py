from loomline.operators.labels import COLUMNS
from loomline.plans import catalog


def run(spark, folder, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    return catalog.queries()[name](spark, str(folder))


def test_duplicate_pair_compare(spark, tmp_path):
    """Rows of one key that differ in one label each time, in case and blanks, and in a null."""
    base = dict.fromkeys(COLUMNS, "yes")
    rows = [(i, "A", 1, *{**base, c: v}.values()) for i, c in enumerate(COLUMNS) for v in ("yes", "no")]
    rows += [(100, "A", 1, *base.values()), (100, "A", 1, *{**base, COLUMNS[-1]: " Yes "}.values()), (101, "A", 1, *base.values()), (101, "A", 1, *{**base, COLUMNS[-1]: None}.values()), (102, "A", 1, *base.values()), (102, "A", 1, *base.values())]
    schema = "article_idx long, prompt_variant string, run_number int, " + ", ".join(f"{c} string" for c in COLUMNS)
    got = {r["article_idx"]: (r["rows_left"], r["same"]) for r in run(spark, tmp_path, "duplicate_pair_compare", annotated=(rows, schema)).collect()}
    assert got == {**dict.fromkeys(range(len(COLUMNS)), (2, False)), 100: (2, True), 101: (2, False)}


def test_significance_suite(spark, tmp_path):
    """Every kind of grouping is tested; one topic's 2 x 2 table against chi-square by hand."""
    kinds = [("climate", "climate", "x"), ("migration", "migration", "y"), ("migration", "intersection", " z  z"), ("migration", "migration", "w"), ("migration", "migration", "NOISE"), ("migration", "migration", None)]
    idx = {i: kinds[i % 6] for i in range(240)}
    yes = lambda i: ("yes", "no")[i % 6 == 1 if i % 4 else i % 8 == 0]
    rows = [(i, "o%d" % (i % 5), 2014 + i % 7, c, k, None, "A", 1, *[yes(i)] * len(COLUMNS)) for i, (c, k, _) in idx.items()]
    schema = "article_idx long, outlet_clean string, year int, corpus string, corpus_type string, skipped_reason string, prompt_variant string, run_number int, " + ", ".join(f"{c} string" for c in COLUMNS)
    got = run(spark, tmp_path, "significance_suite", annotated=(rows, schema), preprocess_final=([(i, m) for i, (_, _, m) in idx.items()], "row_idx long, meta string")).where("frame = 'agency'").collect()
    assert {(r["grouping_column"], r["scope"], r["category"]) for r in got} == {
        ("corpus", None, None), ("corpus_type", None, None), ("outlet_clean", None, None), ("year", None, None),
        *((k, c, None) for k in ("outlet_clean", "year") for c in ("climate", "migration")),
        *(("meta", "migration", m) for m in ("w", "y", "z z")),
    }
    r = next(r for r in got if r["category"] == "y")
    side = lambda topic, v: sum(yes(i) == v and (m == "y") == topic for i, (c, _, m) in idx.items() if c == "migration" and m not in (None, "NOISE"))
    a, b, c, d = side(True, "yes"), side(True, "no"), side(False, "yes"), side(False, "no")
    n = a + b + c + d
    assert (r["n"], r["dof"]) == (n, 1) and abs(r["chi2"] - n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))) < 1e-9
