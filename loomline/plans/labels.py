"""Prevalence, agreement and contingency queries over the label table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions import stats
from loomline.functions.text import collapse_blanks, yes_no
from loomline.operators.labels import COLUMNS, LABELS, label_table, long_labels, pass_table, percent, prevalence
from loomline.plans.registry import Tables, query, sql_collapse, sql_yes_no
from loomline.runtime import stage

_KEEP = ["article_idx", "outlet_clean", "year", "corpus", "corpus_type", "prompt_variant", "run_number"]

_LONG = f"""
  w AS (SELECT DISTINCT {", ".join(_KEEP)}, {", ".join(COLUMNS)} FROM annotated WHERE skipped_reason IS NULL),
  l AS (SELECT {", ".join(_KEEP)}, replace(col, '_present', '') AS frame, raw, {sql_yes_no("raw")} AS present FROM w UNPIVOT INCLUDE NULLS (raw FOR col IN ({", ".join(COLUMNS)})))"""
_PCT = "round_even(100.0 * n_present / n_applicable, 4)"
_COUNTS = "CAST(count(present) AS BIGINT) AS n_applicable, CAST(count(*) FILTER (present = 'yes') AS BIGINT) AS n_present"


def long(t: Tables) -> DataFrame:
    return long_labels(t.annotated.where("skipped_reason is null"), _KEEP)


@query(f"WITH {_LONG} SELECT *, {_PCT} AS pct FROM (SELECT corpus, outlet_clean, frame, {_COUNTS} FROM l WHERE outlet_clean IS NOT NULL GROUP BY ALL) WHERE n_applicable > 0")
def prevalence_by_outlet(t: Tables) -> DataFrame:
    return prevalence(long(t).where("outlet_clean is not null"), ["corpus", "outlet_clean"])


@query(f"""WITH {_LONG}, m AS (SELECT row_idx, {sql_collapse("meta")} AS meta FROM preprocess_final)
SELECT *, {_PCT} AS pct, n_applicable < 10 AS thin FROM (SELECT corpus, meta, frame, {_COUNTS} FROM l JOIN m ON article_idx = row_idx WHERE meta IS NOT NULL AND NOT (corpus = 'climate' AND meta = 'NOISE') GROUP BY ALL) WHERE n_applicable > 0""")
def prevalence_by_topic(t: Tables) -> DataFrame:
    meta = t.preprocess_final.select(F.col("row_idx").alias("article_idx"), collapse_blanks(F.col("meta")).alias("meta"))
    rows = long(t).join(meta, "article_idx").where("meta is not null and not (corpus = 'climate' and meta = 'NOISE')")
    return prevalence(rows, ["corpus", "meta"]).withColumn("thin", F.col("n_applicable") < 10)


@query(f"""WITH {_LONG} SELECT *, {_PCT} AS pct FROM (
  SELECT corpus, year, frame, outlet_clean, CASE WHEN grouping(outlet_clean) = 1 THEN 'all_outlets' ELSE 'by_outlet' END AS level, {_COUNTS}
  FROM l WHERE outlet_clean IS NOT NULL AND year IS NOT NULL GROUP BY GROUPING SETS ((corpus, year, frame), (corpus, year, frame, outlet_clean))) WHERE n_applicable > 0""")
def prevalence_by_year_rollup(t: Tables) -> DataFrame:
    rows = long(t).where("outlet_clean is not null and year is not null")
    sets = rows.groupingSets([["corpus", "year", "frame"], ["corpus", "year", "frame", "outlet_clean"]], "corpus", "year", "frame", "outlet_clean")
    out = sets.agg(F.grouping("outlet_clean").alias("g"), F.count("present").alias("n_applicable"), F.count_if(F.col("present") == "yes").alias("n_present"))
    level = F.when(F.col("g") == 1, "all_outlets").otherwise("by_outlet")
    return out.where("n_applicable > 0").select("corpus", "year", "frame", "outlet_clean", level.alias("level"), "n_applicable", "n_present", percent(F.col("n_present"), F.col("n_applicable")).alias("pct"))


@query(f"""WITH {_LONG}, c AS (SELECT corpus, year, frame, {_COUNTS} FROM l GROUP BY ALL),
  grid AS (SELECT corpus, frame, CAST(y AS INTEGER) AS year FROM (SELECT DISTINCT corpus, frame FROM l), range(2014, 2024) AS r(y))
SELECT corpus, frame, year, CASE WHEN n_applicable > 0 THEN {_PCT} END AS pct FROM grid LEFT JOIN c USING (corpus, frame, year)""")
def prevalence_dense_years(t: Tables) -> DataFrame:
    rows = long(t)
    counts = rows.groupBy("corpus", "year", "frame").agg(F.count("present").alias("n_applicable"), F.count_if(F.col("present") == "yes").alias("n_present"))
    grid = rows.select("corpus", "frame").distinct().withColumn("year", F.explode(F.sequence(F.lit(2014), F.lit(2023))))
    return grid.join(counts, ["corpus", "frame", "year"], "left").select("corpus", "frame", "year", percent(F.col("n_present"), F.when(F.col("n_applicable") > 0, F.col("n_applicable"))).alias("pct"))


_SHARED = [s for s, p in LABELS if p in ("pass1", "pass4")]


@query(f"""WITH {_LONG}, c AS (SELECT corpus, year, frame, {_COUNTS} FROM l WHERE frame IN ({", ".join(repr(s) for s in _SHARED)}) AND year IS NOT NULL GROUP BY ALL)
SELECT *, {_PCT} AS pct, CAST(row_number() OVER (PARTITION BY corpus, year ORDER BY {_PCT} DESC, frame) AS INTEGER) AS place FROM c WHERE n_applicable > 0""")
def cross_corpus_prevalence(t: Tables) -> DataFrame:
    rows = prevalence(long(t).where(F.col("frame").isin(_SHARED) & F.col("year").isNotNull()), ["corpus", "year"])
    return rows.withColumn("place", F.row_number().over(W.partitionBy("corpus", "year").orderBy(F.desc("pct"), "frame")))


@query(f"""WITH {_LONG}, g AS (SELECT corpus, y AS year, f AS frame FROM (SELECT DISTINCT corpus FROM l), (SELECT DISTINCT year AS y FROM l WHERE year IS NOT NULL), (SELECT DISTINCT frame AS f FROM l))
SELECT corpus, year, frame, CAST(count(l.article_idx) AS BIGINT) AS n FROM g LEFT JOIN l USING (corpus, year, frame) GROUP BY ALL HAVING count(l.article_idx) <> 1""")
def completeness_grid(t: Tables) -> DataFrame:
    rows = long(t)
    grid = rows.select("corpus").distinct().join(F.broadcast(rows.where("year is not null").select("year").distinct().groupBy().agg(F.collect_set("year").alias("ys"))))
    grid = grid.withColumn("year", F.explode("ys")).drop("ys").withColumn("frame", F.explode(F.array(*[F.lit(s) for s, _ in LABELS])))
    counts = rows.groupBy("corpus", "year", "frame").agg(F.count("*").alias("n"))
    return grid.join(counts, ["corpus", "year", "frame"], "left").fillna(0, ["n"]).where("n != 1")


@query(f"""WITH {_LONG} SELECT frame, raw, CAST(count(*) AS BIGINT) AS n FROM l WHERE raw IS NOT NULL AND raw NOT IN ('yes', 'no') GROUP BY ALL""")
def audit_encoding(t: Tables) -> DataFrame:
    return long(t).where("raw not in ('yes', 'no')").groupBy("frame", "raw").agg(F.count("*").alias("n"))


_DIMS = "p(corpus_type, pass_name) AS (VALUES ('climate','pass1'),('climate','pass3'),('climate','pass4'),('migration','pass1'),('migration','pass2'),('migration','pass4'),('intersection','pass1'),('intersection','pass2'),('intersection','pass3'),('intersection','pass4')), d(frame, pass_name) AS (VALUES " + ", ".join(f"('{a}','{b}')" for a, b in LABELS) + ")"


@query(f"""WITH {_LONG}, {_DIMS}
SELECT frame, CAST(count(*) FILTER (applies) AS BIGINT) AS expected, CAST(count(present) AS BIGINT) AS actual, CAST(count(*) FILTER (applies AND present IS NULL) AS BIGINT) AS missing, CAST(count(present) FILTER (NOT applies) AS BIGINT) AS beyond
FROM (SELECT l.*, p.pass_name IS NOT NULL AS applies FROM l JOIN d USING (frame) LEFT JOIN p ON p.corpus_type = l.corpus_type AND p.pass_name = d.pass_name) GROUP BY frame""")
def audit_nulls(t: Tables) -> DataFrame:
    rows = long(t).join(F.broadcast(label_table(t.spark)), "frame").join(F.broadcast(pass_table(t.spark).withColumn("yes", F.lit(True))), ["corpus_type", "pass_name"], "left").withColumn("applies", F.col("yes").isNotNull())
    return rows.groupBy("frame").agg(F.count_if("applies").alias("expected"), F.count("present").alias("actual"), F.count_if(F.col("applies") & F.col("present").isNull()).alias("missing"), F.count_if(~F.col("applies") & F.col("present").isNotNull()).alias("beyond"))


# ---- two raters: the label as given, and one that differs by a fixed rule on the hash of the cell ----

_SECOND = "CASE WHEN substr(md5(article_idx || '#' || frame), 1, 1) IN ('0', '1', '2') THEN CASE present WHEN 'yes' THEN 'no' WHEN 'no' THEN 'yes' END WHEN substr(md5(article_idx || '#' || frame), 1, 1) = 'f' THEN NULL ELSE present END"
_PAIR = f"{_LONG}, r AS (SELECT *, present AS a, {_SECOND} AS b FROM l)"


def raters(t: Tables) -> DataFrame:
    h = F.substring(F.md5(F.concat(F.col("article_idx").cast("string"), F.lit("#"), F.col("frame"))), 1, 1)
    flip = F.when(F.col("present") == "yes", "no").when(F.col("present") == "no", "yes")
    return long(t).withColumn("a", F.col("present")).withColumn("b", F.when(h.isin("0", "1", "2"), flip).when(h != "f", F.col("present")))


def _tally(rows: DataFrame, *by: str) -> DataFrame:
    both = rows.where("a is not null and b is not null")
    yes = lambda c: F.col(c) == "yes"
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(yes("a") & yes("b")).alias("yy"), F.count_if(yes("a") & ~yes("b")).alias("yn"), F.count_if(~yes("a") & yes("b")).alias("ny"), F.count_if(~yes("a") & ~yes("b")).alias("nn"))


def _stats(tally: DataFrame) -> DataFrame:
    s = stats.agreement(F.col("n"), F.col("yy"), F.col("nn"), F.col("yy") + F.col("yn"), F.col("yy") + F.col("ny"))
    return tally.select("*", *[F.round(c, 6).alias(k) for k, c in s.items()])


_TALLY = "count(*) AS n, count(*) FILTER (a='yes' AND b='yes') AS yy, count(*) FILTER (a='yes' AND b='no') AS yn, count(*) FILTER (a='no' AND b='yes') AS ny, count(*) FILTER (a='no' AND b='no') AS nn"
_STAT = """
  s AS (SELECT *, (yy + nn) / n AS po, (yy + yn) / n AS pa, (yy + ny) / n AS pb, (2 * yy + yn + ny) / (2 * n) AS pool FROM c),
  e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe, pool * pool + (1 - pool) * (1 - pool) AS ps FROM s),
  v AS (SELECT *, round(po, 6) AS raw_agreement, CASE WHEN abs(1 - pe) > 1e-8 + 1e-5 THEN round((po - pe) / (1 - pe), 6) END AS kappa,
          CASE WHEN abs(1 - ps) > 1e-8 + 1e-5 THEN round(1 - (2 * n - 1) / (2 * n) * (1 - (po - ps) / (1 - ps)), 6) END AS alpha,
          CASE WHEN abs(1 - pe) > 1e-8 + 1e-5 THEN round((1 - abs(pa - pb) - pe) / (1 - pe), 6) END AS kappa_max, round(2 * po - 1, 6) AS pabak FROM e)"""


@query(f"WITH {_PAIR}, c AS (SELECT frame, {_TALLY} FROM r WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY frame), {_STAT} SELECT frame, n, yy, yn, ny, nn, raw_agreement, kappa, alpha, kappa_max, pabak FROM v")
def agreement_per_label(t: Tables) -> DataFrame:
    return _stats(_tally(raters(t), "frame"))


@query(f"""WITH {_PAIR}, c AS (SELECT frame, prompt_variant, run_number, {_TALLY} FROM r WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL), {_STAT}
SELECT frame, prompt_variant, round(min(kappa), 6) AS kappa_min, round(max(kappa), 6) AS kappa_max, round(max(kappa) - min(kappa), 6) AS kappa_spread, round(max(raw_agreement) - min(raw_agreement), 6) AS raw_spread, round(max(alpha) - min(alpha), 6) AS alpha_spread, CAST(count(*) AS BIGINT) AS runs,
  max(kappa) FILTER (run_number = 1) AS run1, max(kappa) FILTER (run_number = 2) AS run2, max(kappa) FILTER (run_number = 3) AS run3 FROM v GROUP BY ALL""")
def agreement_run_spread(t: Tables) -> DataFrame:
    rows = _stats(_tally(raters(t), "frame", "prompt_variant", "run_number"))
    run = lambda k: F.max(F.when(F.col("run_number") == k, F.col("kappa"))).alias(f"run{k}")
    return rows.groupBy("frame", "prompt_variant").agg(F.min("kappa").alias("kappa_min"), F.max("kappa").alias("kappa_max"), *[F.round(F.max(c) - F.min(c), 6).alias(n) for c, n in (("kappa", "kappa_spread"), ("raw_agreement", "raw_spread"), ("alpha", "alpha_spread"))], F.count("*").alias("runs"), run(1), run(2), run(3))


@query(f"""WITH {_PAIR}, c AS (SELECT prompt_variant, frame, {_TALLY} FROM r WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL), {_STAT}, m AS (SELECT prompt_variant, round(avg(kappa), 5) AS macro_kappa FROM v GROUP BY ALL),
  c2 AS (SELECT prompt_variant, CAST(sum(n) AS BIGINT) AS n, CAST(sum(yy) AS BIGINT) AS yy, CAST(sum(yn) AS BIGINT) AS yn, CAST(sum(ny) AS BIGINT) AS ny, CAST(sum(nn) AS BIGINT) AS nn FROM c GROUP BY ALL),
  p AS (SELECT *, (yy + yn) / n * (yy + ny) / n + (nn + ny) / n * (nn + yn) / n AS pe FROM c2)
SELECT prompt_variant, n AS n_cells, round(((yy + nn) / n - pe) / (1 - pe), 6) AS pooled_kappa, macro_kappa FROM p JOIN m USING (prompt_variant)""")
def agreement_pooled_macro(t: Tables) -> DataFrame:
    tally = _tally(raters(t), "prompt_variant", "frame")
    macro = _stats(tally).groupBy("prompt_variant").agg(F.round(F.avg("kappa"), 5).alias("macro_kappa"))
    pooled = _stats(tally.groupBy("prompt_variant").agg(*[F.sum(c).alias(c) for c in ("n", "yy", "yn", "ny", "nn")]))
    return pooled.select("prompt_variant", F.col("n").alias("n_cells"), F.col("kappa").alias("pooled_kappa")).join(macro, "prompt_variant")


# Tiers of reliability and their reasons.
_SMALL = " (aggravated by small subsample n=%d, wide CI)"
_CEILING = "base-rate ceiling: kappa_max=%.3f < 0.6, so 0.6 is unreachable given marginals (%.2f vs %.2f)"
_FLOOR = "prevalence floor: only %d positive cases at n=%d; kappa unstable at any feasible benchmark size"
_DIVERGE = "kappa_max=%.3f permits >=0.6, so the marginals are not the constraint — the two coders disagree about which articles qualify"


def _plain(text: str) -> str:
    """The text for numbers that are formatted already."""
    return text.replace("%.3f", "%s").replace("%.2f", "%s")


def _printf(text: str, *args: str) -> str:
    return "printf('" + text + "', " + ", ".join(args) + ")"


@query(f"""WITH {_PAIR}, c AS (SELECT frame, outlet_clean, {_TALLY} FROM r WHERE a IS NOT NULL AND b IS NOT NULL AND outlet_clean IS NOT NULL GROUP BY ALL), {_STAT},
  x AS (SELECT *, CASE WHEN n <= 40 THEN {_printf(_SMALL, "n")} ELSE '' END AS small FROM v)
SELECT frame, outlet_clean, n, kappa, CASE WHEN kappa >= 0.6 THEN 'clears 0.6' WHEN kappa_max < 0.6 OR yy + yn <= 6 THEN 'below 0.6 — structural' ELSE 'below 0.6 — unresolved' END AS tier,
  CASE WHEN kappa >= 0.6 THEN '' WHEN kappa_max < 0.6 THEN {_printf(_CEILING, "kappa_max", "round(pa, 6)", "round(pb, 6)")} || small WHEN yy + yn <= 6 THEN {_printf(_FLOOR, "yy + yn", "n")} ELSE {_printf(_DIVERGE, "coalesce(kappa_max, 'nan'::DOUBLE)")} || small END AS reason FROM x""")
def reliability_tiers(t: Tables) -> DataFrame:
    """Tier and reason of each label and outlet; a small sample is named where it adds to a reason that it may add to."""
    c = F.col
    s = _stats(_tally(raters(t).where("outlet_clean is not null"), "frame", "outlet_clean"))
    small = F.when(c("n") <= 40, F.format_string(_SMALL, "n")).otherwise("")
    clears, ceiling, floor = c("kappa") >= 0.6, c("kappa_max") < 0.6, c("yy") + c("yn") <= 6
    # format_number rounds the binary value half-even, format_string its decimal form half-up
    share = lambda k: F.format_number(F.round((c("yy") + c(k)) / c("n"), 6), 2)
    most = F.coalesce(F.format_number("kappa_max", 3), F.lit("nan"))
    tier = F.when(clears, "clears 0.6").when(F.coalesce(ceiling, F.lit(False)) | floor, "below 0.6 — structural").otherwise("below 0.6 — unresolved")
    reason = F.when(clears, "").when(ceiling, F.concat(F.format_string(_plain(_CEILING), most, share("yn"), share("ny")), small)).when(floor, F.format_string(_FLOOR, c("yy") + c("yn"), c("n")))
    return s.select("frame", "outlet_clean", "n", "kappa", tier.alias("tier"), reason.otherwise(F.concat(F.format_string(_plain(_DIVERGE), most), small)).alias("reason"))


@query(f"""WITH {_PAIR} SELECT frame, CASE WHEN a IS NULL AND b IS NULL THEN 'both null' WHEN a IS NULL THEN 'first null' ELSE 'second null' END AS reason, CAST(count(*) AS BIGINT) AS n FROM r WHERE a IS NULL OR b IS NULL GROUP BY ALL""")
def noncomparable_breakdown(t: Tables) -> DataFrame:
    reason = F.when(F.col("a").isNull() & F.col("b").isNull(), "both null").when(F.col("a").isNull(), "first null").otherwise("second null")
    return raters(t).where("a is null or b is null").groupBy("frame", reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {_PAIR} SELECT frame, CAST(count(*) FILTER (a = 'no' AND b = 'yes') AS BIGINT) AS no_yes, CAST(count(*) FILTER (a = 'yes' AND b = 'no') AS BIGINT) AS yes_no, round(avg(CASE WHEN a = 'yes' THEN 1.0 ELSE 0.0 END), 6) AS rate_a, round(avg(CASE WHEN b = 'yes' THEN 1.0 ELSE 0.0 END), 6) AS rate_b,
  greatest(avg(CASE WHEN a = 'yes' THEN 0.5 ELSE 0.0 END + CASE WHEN b = 'yes' THEN 0.5 ELSE 0.0 END), 1 - avg(CASE WHEN a = 'yes' THEN 0.5 ELSE 0.0 END + CASE WHEN b = 'yes' THEN 0.5 ELSE 0.0 END)) >= 0.85 AS skewed
FROM r WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY frame""")
def base_rates(t: Tables) -> DataFrame:
    one = lambda c: F.when(F.col(c) == "yes", 1.0).otherwise(0.0)
    pool = F.avg(one("a") / 2 + one("b") / 2)
    both = raters(t).where("a is not null and b is not null")
    return both.groupBy("frame").agg(F.count_if((F.col("a") == "no") & (F.col("b") == "yes")).alias("no_yes"), F.count_if((F.col("a") == "yes") & (F.col("b") == "no")).alias("yes_no"), F.round(F.avg(one("a")), 6).alias("rate_a"), F.round(F.avg(one("b")), 6).alias("rate_b"), (F.greatest(pool, 1 - pool) >= 0.85).alias("skewed"))


@query(f"""WITH {_PAIR} SELECT article_idx, CAST(count(*) FILTER (a <> b) AS BIGINT) AS disagreements FROM r GROUP BY article_idx""")
def disagreements_per_article(t: Tables) -> DataFrame:
    return raters(t).groupBy("article_idx").agg(F.count_if(F.col("a") != F.col("b")).alias("disagreements"))


_CELLS = "SELECT frame, corpus, present, count(*) AS n FROM l WHERE present IS NOT NULL GROUP BY ALL"


@query(f"WITH {_LONG} SELECT frame, corpus, CAST(count(*) FILTER (present = 'yes') AS BIGINT) AS yes, CAST(count(*) FILTER (present = 'no') AS BIGINT) AS no FROM l WHERE present IS NOT NULL GROUP BY ALL")
def crosstab(t: Tables) -> DataFrame:
    return long(t).where("present is not null").groupBy("frame", "corpus").pivot("present", ["yes", "no"]).agg(F.count(F.lit(1))).fillna(0, ["yes", "no"])


def _chi_sql(key: str) -> str:
    return f"""WITH {_LONG}, o AS (SELECT frame, {key} AS g, present, count(*) AS o FROM l WHERE present IS NOT NULL AND {key} IS NOT NULL GROUP BY ALL),
  r AS (SELECT frame, g, sum(o) AS r FROM o GROUP BY ALL), k AS (SELECT frame, present, sum(o) AS c FROM o GROUP BY ALL),
  m AS (SELECT frame, sum(r) AS n, count(*) AS nr FROM r GROUP BY ALL), x AS (SELECT frame, count(*) AS nc FROM k GROUP BY ALL),
  e AS (SELECT r.frame, n, nr, nc, coalesce(o, 0) AS o, r * c / n AS e FROM r JOIN k USING (frame) JOIN m USING (frame) JOIN x USING (frame) LEFT JOIN o USING (frame, g, present) WHERE nr > 1 AND nc > 1)
SELECT frame, CAST(n AS BIGINT) AS n, CAST((nr - 1) * (nc - 1) AS BIGINT) AS dof, round(sum((o - e) * (o - e) / e), 5) AS chi2,
  round(sum(pow(abs(o - e) - CASE WHEN nr = 2 AND nc = 2 THEN least(abs(o - e), 0.5) ELSE 0 END, 2) / e), 5) AS chi2_yates,
  round(sqrt(sum((o - e) * (o - e) / e) / (n * (least(nr, nc) - 1))), 6) AS cramers_v, round(min(e), 6) AS expected_min, min(e) >= 5 AS valid
FROM e GROUP BY frame, n, nr, nc"""


def _chi(t: Tables, key: str) -> DataFrame:
    counts = long(t).where(F.col("present").isNotNull() & F.col(key).isNotNull()).groupBy("frame", F.col(key).alias("g"), "present").agg(F.count("*").alias("n"))
    return stats.chi_square(counts, ["frame"], "g", "present")


def _chi_out(df: DataFrame) -> DataFrame:
    return df.select("frame", "n", "dof", F.round("chi2", 5).alias("chi2"), F.round("chi2_yates", 5).alias("chi2_yates"), F.round("cramers_v", 6).alias("cramers_v"), F.round("expected_min", 6).alias("expected_min"), (F.col("expected_min") >= 5).alias("valid"))


@query(_chi_sql("corpus"))
def chi2_by_corpus(t: Tables) -> DataFrame:
    return _chi_out(_chi(t, "corpus"))


@query(_chi_sql("outlet_clean"))
def chi2_by_outlet(t: Tables) -> DataFrame:
    return _chi_out(_chi(t, "outlet_clean"))


def _tail_sql(x: str, dof: str) -> str:
    """Upper tail of chi-square by the series of the incomplete gamma function."""
    term = f"exp(({dof} / 2.0 + i) * ln({x} / 2.0) - {x} / 2.0 - lgamma({dof} / 2.0 + i + 1))"
    last = f"CAST({x} / 2.0 + 40 * sqrt({x} / 2.0) + 200 AS BIGINT)"
    return f"CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, {last}), lambda i: {term}))) END"


_SUITE = f"""WITH {_LONG}, y AS (SELECT * FROM l WHERE present IS NOT NULL), m AS (SELECT DISTINCT row_idx, {sql_collapse("meta")} AS meta FROM preprocess_final WHERE meta IS NOT NULL),
  tp AS (SELECT corpus, meta, frame, present, count(*) AS n FROM y JOIN m ON row_idx = article_idx WHERE corpus IS NOT NULL AND meta <> 'NOISE' GROUP BY ALL),
  tw AS (SELECT corpus, frame, present, sum(n) AS n FROM tp GROUP BY ALL), tc AS (SELECT DISTINCT corpus, meta, frame FROM tp),
  side AS (SELECT corpus, meta, frame, tw.present, coalesce(tp.n, 0) AS n, tw.n AS whole FROM tc JOIN tw USING (corpus, frame) LEFT JOIN tp USING (corpus, meta, frame, present)),
  cell AS ({" UNION ALL ".join([f"SELECT '{k}' AS k, '' AS scope, '' AS category, frame, CAST({k} AS VARCHAR) AS g, present, count(*) AS o FROM y GROUP BY ALL" for k in ("corpus", "corpus_type", "outlet_clean", "year")] + [f"SELECT '{k}', corpus, '', frame, CAST({k} AS VARCHAR), present, count(*) FROM y WHERE corpus IS NOT NULL GROUP BY ALL" for k in ("outlet_clean", "year")])}
    UNION ALL SELECT 'meta', corpus, meta, frame, 'focal', present, n FROM side UNION ALL SELECT 'meta', corpus, meta, frame, 'rest', present, whole - n FROM side),
  o AS (SELECT k, scope, category, frame, g, present, sum(o) AS o FROM cell WHERE g IS NOT NULL AND o > 0 GROUP BY ALL),
  r AS (SELECT k, scope, category, frame, g, sum(o) AS r FROM o GROUP BY ALL), c AS (SELECT k, scope, category, frame, present, sum(o) AS c FROM o GROUP BY ALL),
  rn AS (SELECT k, scope, category, frame, sum(r) AS n, count(*) AS nr FROM r GROUP BY ALL), cn AS (SELECT k, scope, category, frame, count(*) AS nc FROM c GROUP BY ALL),
  e AS (SELECT k, scope, category, frame, n, nr, nc, coalesce(o, 0) AS o, r * c / n AS e FROM r JOIN c USING (k, scope, category, frame) JOIN rn USING (k, scope, category, frame) JOIN cn USING (k, scope, category, frame) LEFT JOIN o USING (k, scope, category, frame, g, present) WHERE nr > 1 AND nc > 1),
  x AS (SELECT k, scope, category, frame, n, nr, nc, (nr - 1) * (nc - 1) AS dof, sum((o - e) * (o - e) / e) AS chi2, sum(pow(abs(o - e) - CASE WHEN nr = 2 AND nc = 2 THEN least(abs(o - e), 0.5) ELSE 0 END, 2) / e) AS chi2_yates, min(e) AS em FROM e GROUP BY ALL)
SELECT k AS grouping_column, nullif(scope, '') AS scope, nullif(category, '') AS category, frame, CAST(n AS BIGINT) AS n, CAST(nr AS BIGINT) AS n_rows, CAST(nc AS BIGINT) AS n_cols, round(chi2, 9) AS chi2, round(chi2_yates, 9) AS chi2_yates, round(em, 9) AS expected_min, CAST(dof AS BIGINT) AS dof,
  round(sqrt(chi2 / (n * (least(nr, nc) - 1))), 9) AS cramers_v, round({_tail_sql("chi2", "dof")}, 9) AS p, round({_tail_sql("chi2_yates", "dof")}, 9) AS p_yates FROM x"""


@query(_SUITE)
def significance_suite(t: Tables) -> DataFrame:
    """Chi-square with both corrections and its p-values, for five groupings of every label.

    Corpus and the three corpus types over both corpora; year and outlet over both (``scope`` null) and within
    each corpus; each topic (``category``) against the other known topics of its corpus, NOISE left out.
    """
    keys = ["corpus", "corpus_type", "outlet_clean", "year"]
    rows = long(t).where("present is not null")
    meta = t.preprocess_final.select(F.col("row_idx").alias("article_idx"), collapse_blanks(F.col("meta")).alias("meta")).where("meta is not null and meta != 'NOISE'").distinct()
    none, scope = F.array().cast("array<string>"), F.array("corpus")
    sets = [(k, none) for k in keys] + [("outlet_clean", scope), ("year", scope)]
    groups = F.explode(F.array(*[F.struct(F.lit(k).alias("grouping_column"), s.alias("scope"), none.alias("category"), F.col(k).cast("string").alias("g")) for k, s in sets]))
    counts = rows.groupBy(*keys, "frame", "present").agg(F.count("*").alias("n")).select(groups.alias("x"), "frame", "present", "n").select("x.*", "frame", "present", "n")
    counts = counts.where("g is not null and (size(scope) = 0 or scope[0] is not null)").groupBy("grouping_column", "scope", "category", "g", "frame", "present").agg(F.sum("n").alias("n"))

    topics = stage(rows.where("corpus is not null").join(meta, "article_idx").groupBy("corpus", "meta", "frame", "present").agg(F.count("*").alias("n")), "suite-topics")
    whole = topics.groupBy("corpus", "frame", "present").agg(F.sum("n").alias("all"))
    cells = topics.select("corpus", "meta", "frame").distinct().join(whole, ["corpus", "frame"]).join(topics, ["corpus", "meta", "frame", "present"], "left").fillna(0, ["n"])
    sides = F.explode(F.array(F.struct(F.lit("focal").alias("g"), F.col("n")), F.struct(F.lit("rest").alias("g"), (F.col("all") - F.col("n")).alias("n"))))
    cells = cells.select(F.lit("meta").alias("grouping_column"), F.array("corpus").alias("scope"), F.array("meta").alias("category"), "frame", "present", sides.alias("x")).select("grouping_column", "scope", "category", "x.g", "frame", "present", "x.n")

    out = stats.chi_square(stage(counts.unionByName(cells), "suite-cells"), ["grouping_column", "scope", "category", "frame"], "g", "present")
    out = out.withColumn("scope", F.get("scope", F.lit(0))).withColumn("category", F.get("category", F.lit(0)))
    out = out.withColumn("p", stats.chi2_p("chi2", "dof")).withColumn("p_yates", stats.chi2_p("chi2_yates", "dof"))
    return out.select(*[F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


_LOG_CHOOSE = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
_LOG_P = lambda k: f"{_LOG_CHOOSE('(a + b)', k)} + {_LOG_CHOOSE('(c + d)', f'(a + c - {k})')} - {_LOG_CHOOSE('(a + b + c + d)', '(a + c)')}"


@query(f"""WITH {_LONG}, t AS (SELECT frame, count(*) FILTER (corpus = 'climate' AND present = 'yes') AS a, count(*) FILTER (corpus = 'climate' AND present = 'no') AS b, count(*) FILTER (corpus = 'migration' AND present = 'yes') AS c, count(*) FILTER (corpus = 'migration' AND present = 'no') AS d FROM l WHERE present IS NOT NULL GROUP BY frame),
  p AS (SELECT *, exp({_LOG_P("a")}) AS own, list_transform(range(greatest(0, a - d), least(a + b, a + c) + 1), lambda k: exp({_LOG_P("k")})) AS ps FROM t)
SELECT frame, a, b, c, d, round(least(1.0, list_sum(list_filter(ps, lambda x: x <= own * (1 + 1e-7)))), 9) AS p_fisher FROM p""")
def fisher_by_corpus(t: Tables) -> DataFrame:
    """Exact test of each label between two corpora."""
    rows = long(t).where("present is not null").groupBy("frame").agg(*[F.count_if((F.col("corpus") == c) & (F.col("present") == p)).alias(n) for n, c, p in (("a", "climate", "yes"), ("b", "climate", "no"), ("c", "migration", "yes"), ("d", "migration", "no"))])
    return rows.withColumn("p_fisher", F.round(stats.fisher_p("a", "b", "c", "d"), 9))


@query()
def bootstrap_ci(t: Tables) -> DataFrame:
    return stats.bootstrap_kappa(_tally(raters(t), "frame").drop("n"), "frame")


@query(f"""WITH {_LONG} SELECT article_idx, prompt_variant, run_number, array_to_string(list_sort(list(frame) FILTER (present = 'yes')), '; ') AS frames FROM l GROUP BY ALL HAVING count(*) FILTER (present = 'yes') > 0""")
def sparse_payload(t: Tables) -> DataFrame:
    """Only the labels present, one row an article and run."""
    rows = long(t).where("present = 'yes'").groupBy("article_idx", "prompt_variant", "run_number")
    return rows.agg(F.array_join(F.array_sort(F.collect_list("frame")), "; ").alias("frames"))


@query(f"""WITH x AS (SELECT DISTINCT * FROM annotated), y AS (SELECT article_idx, prompt_variant, run_number, {", ".join(f"{sql_yes_no(c)} AS {c}" for c in COLUMNS)} FROM x)
SELECT article_idx, prompt_variant, run_number, CAST(count(*) AS BIGINT) AS rows_left, {" AND ".join(f"count(DISTINCT coalesce({c}, '')) = 1" for c in COLUMNS)} AS same FROM y GROUP BY ALL HAVING count(*) > 1""")
def duplicate_pair_compare(t: Tables) -> DataFrame:
    """Keys with several different rows, and whether all their normalised labels agree."""
    labels = F.struct(*[F.coalesce(yes_no(F.col(c)), F.lit("")).alias(c) for c in COLUMNS])
    rows = t.annotated.distinct().groupBy("article_idx", "prompt_variant", "run_number").agg(F.count("*").alias("rows_left"), (F.count_distinct(labels) == 1).alias("same"))
    return rows.where("rows_left > 1")


@query(f"""WITH {_LONG}, b AS (SELECT article_idx, frame, max(present) AS old FROM l WHERE prompt_variant = 'A' GROUP BY ALL), n AS (SELECT article_idx, frame, max(present) AS new FROM l WHERE prompt_variant = 'B' GROUP BY ALL)
SELECT article_idx, frame, old, coalesce(new, old) AS merged, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'kept' WHEN old <> new THEN 'revised' ELSE 'same' END AS kind FROM b FULL JOIN n USING (article_idx, frame)""")
def snapshot_merge(t: Tables) -> DataFrame:
    """A newer snapshot laid over an older one, with the kind of each change."""
    one = lambda v, c: long(t).where(F.col("prompt_variant") == v).groupBy("article_idx", "frame").agg(F.max("present").alias(c))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "kept").when(F.col("old") != F.col("new"), "revised").otherwise("same")
    return one("A", "old").join(one("B", "new"), ["article_idx", "frame"], "full_outer").select("article_idx", "frame", "old", F.coalesce("new", "old").alias("merged"), kind.alias("kind"))


@query(f"SELECT corpus_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT article_idx) AS BIGINT) AS articles, CAST(count(skipped_reason) AS BIGINT) AS skipped FROM annotated GROUP BY ALL")
def corpus_type_census(t: Tables) -> DataFrame:
    return t.annotated.groupBy("corpus_type").agg(F.count("*").alias("n"), F.count_distinct("article_idx").alias("articles"), F.count("skipped_reason").alias("skipped"))
