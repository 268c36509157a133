"""Gates by terms, top-up of thin cells, and joins that are checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import text
from loomline.operators.joins import one_to_one, repeated_keys, resolve_candidates
from loomline.operators.sampling import stratified, top_up
from loomline.plans.corpus import _BODY, _CELL, _KEY, _U, _WORDS, OFF_TOPIC, cells, match_key, units
from loomline.plans.registry import Tables, query, sql_strip
from loomline.runtime import broadcast_if_small, stage

_WELL_FORMED = r"""'^\s*\[\s*(''[^'']*''\s*(,\s*''[^'']*''\s*)*)?\]\s*$'"""
_LIST_TERMS = f"SELECT DISTINCT term FROM (SELECT unnest(list_transform(regexp_extract_all(matched_keywords_all, '''([^'']*)''', 1), lambda x: {sql_strip('x')})) AS term FROM preprocess_final WHERE regexp_matches(matched_keywords_all, {_WELL_FORMED})) WHERE length(term) > 0"


def _hits(c: str) -> str:
    return f"(SELECT coalesce(CAST(sum((length(lower(coalesce({c}, ''))) - length(replace(lower(coalesce({c}, '')), lower(term), ''))) // length(term)) AS BIGINT), 0) FROM terms)"


_ON_TOPIC = f"terms AS ({_LIST_TERMS}), h AS (SELECT row_idx, corpus, meta, CASE WHEN corpus = 'climate' THEN {_hits('title')} END AS title_hits, CASE WHEN corpus = 'climate' THEN {_hits('body')} END AS body_hits FROM preprocess_final)"


def terms(t: Tables) -> DataFrame:
    """One row: the distinct terms of all well-formed lists, the longest first. A vocabulary, not a table of rows."""
    each = t.preprocess_final.select(F.explode(text.parse_list(F.col("matched_keywords_all"))).alias("term")).where("length(term) > 0")
    longest = F.array_sort(F.collect_set(F.struct((-F.length("term")).alias("n"), "term")))
    return each.distinct().agg(F.transform(longest, lambda x: x["term"]).alias("terms"))


@query(f"WITH {_ON_TOPIC} SELECT row_idx, title_hits, body_hits, title_hits || ' title hits / ' || body_hits || ' body hits' AS raw, title_hits >= 1 OR body_hits >= 2 AS on_topic FROM h WHERE corpus = 'climate'")
def keyword_hits(t: Tables) -> DataFrame:
    """Hits of the terms of all keyword lists in title and body, and the threshold on them."""
    rows = t.preprocess_final.where("corpus = 'climate'").select("row_idx", "title", "body").join(F.broadcast(terms(t)))
    rows = rows.select("row_idx", text.count_hits(F.col("title"), F.col("terms")).alias("title_hits"), text.count_hits(F.col("body"), F.col("terms")).alias("body_hits"))
    return rows.withColumn("raw", F.concat(F.col("title_hits"), F.lit(" title hits / "), F.col("body_hits"), F.lit(" body hits"))).withColumn("on_topic", F.expr("title_hits >= 1 or body_hits >= 2"))


@query(f"WITH {_ON_TOPIC} SELECT row_idx, corpus, CASE WHEN corpus = 'climate' THEN title_hits >= 1 OR body_hits >= 2 ELSE coalesce({sql_strip('meta')} NOT IN ({', '.join(map(repr, OFF_TOPIC))}), true) END AS on_topic FROM h")
def on_topic_flag(t: Tables) -> DataFrame:
    """The gate of either corpus: hits of terms, or a topic that is not off topic (a null one is on topic)."""
    other = t.preprocess_final.where("corpus != 'climate'").select("row_idx", "corpus", F.coalesce(~text.strip(F.col("meta")).isin(*OFF_TOPIC), F.lit(True)).alias("on_topic"))
    return keyword_hits(t).select("row_idx", F.lit("climate").alias("corpus"), "on_topic").unionByName(other)


@query(f"WITH terms AS ({_LIST_TERMS}) SELECT term, CAST(row_number() OVER (ORDER BY length(term) DESC, term) AS INTEGER) AS place FROM terms")
def terms_by_length(t: Tables) -> DataFrame:
    """The vocabulary, longest terms first."""
    return terms(t).select(F.posexplode("terms").alias("place", "term")).select("term", (F.col("place") + 1).cast("int").alias("place"))


# ---- cells and their top-up ----

_THIN = "coalesce(on_topic < greatest(1, round_even(greatest(1, round_even(share * n / 10, 0)) * 0.5, 0)), false)"


@query(f"""WITH {_CELL}, g AS (SELECT outlet_clean, year, sum(target_share) AS share FROM strata_targets GROUP BY ALL), w AS (SELECT 100.0 * sum(off_topic) / sum(total) AS whole, CAST(sum(total) AS BIGINT) AS n FROM c)
SELECT outlet_clean, year, CASE WHEN share IS NOT NULL THEN CAST(greatest(1, round_even(share * n / 10, 0)) AS BIGINT) END AS target_n, abs(100.0 * off_topic / total - whole) > 15.0 AS flagged, {_THIN} AS thin,
  CASE WHEN {_THIN} THEN 'THIN' WHEN abs(100.0 * off_topic / total - whole) > 15.0 THEN 'FLAGGED' ELSE 'ok' END AS status FROM c LEFT JOIN g USING (outlet_clean, year), w""")
def strata_flags(t: Tables) -> DataFrame:
    """Cells that deviate from the whole or are thin against their target of at least one; a cell without a target is not thin."""
    c = cells(t)
    whole = c.agg((100.0 * F.sum("off_topic") / F.sum("total")).alias("whole"), F.sum("total").alias("n"))
    goal = t.strata_targets.groupBy("outlet_clean", "year").agg(F.sum("target_share").alias("share"))
    rows = c.join(F.broadcast(goal), ["outlet_clean", "year"], "left").join(F.broadcast(whole))
    rows = rows.withColumn("target_n", F.when(F.col("share").isNotNull(), F.greatest(F.lit(1), F.bround(F.col("share") * F.col("n") / 10))).cast("long"))
    rows = rows.withColumn("flagged", F.abs(100.0 * F.col("off_topic") / F.col("total") - F.col("whole")) > 15.0)
    thin = F.coalesce(F.col("on_topic") < F.when(F.col("target_n").isNotNull(), F.greatest(F.lit(1), F.bround(F.col("target_n") * 0.5))), F.lit(False))
    return rows.select("outlet_clean", "year", "target_n", "flagged", thin.alias("thin"), F.when(thin, "THIN").when(F.col("flagged"), "FLAGGED").otherwise("ok").alias("status"))


_TOPUP = f"""{_U}, k AS (SELECT u.*, coalesce(date, 'nan') || '|' || coalesce(lower({sql_strip('title')}), 'nan') AS k FROM u JOIN preprocess_final USING (row_idx)),
  s AS (SELECT * EXCLUDE (size, n) FROM (SELECT u.*, count(*) OVER (PARTITION BY outlet_clean, year) AS size, row_number() OVER (PARTITION BY outlet_clean, year ORDER BY md5('42#' || row_idx), row_idx) AS n FROM u) WHERE n <= greatest(1, round_even(0.1 * size, 0))),
  goal AS (SELECT outlet_clean, year, greatest(1, round_even(0.1 * count(*), 0)) AS target FROM u GROUP BY ALL),
  c AS (SELECT outlet_clean, year, count(*) AS total, count(*) FILTER (on_topic) AS on_topic FROM s GROUP BY ALL), w AS (SELECT 100.0 * (sum(total) - sum(on_topic)) / sum(total) AS whole FROM c),
  need AS (SELECT outlet_clean, year, CAST(target - on_topic AS BIGINT) AS need FROM c JOIN goal USING (outlet_clean, year), w WHERE (on_topic < greatest(1, round_even(target * 0.5, 0)) OR abs(100.0 * (total - on_topic) / total - whole) > 15.0) AND target > on_topic),
  taken AS (SELECT DISTINCT k FROM k WHERE row_idx IN (SELECT row_idx FROM s)),
  pool AS (SELECT k.row_idx, outlet_clean, year, coalesce(on_topic, false) AS good, need FROM k JOIN need USING (outlet_clean, year) WHERE k.k NOT IN (SELECT k FROM taken)),
  good AS (SELECT outlet_clean, year, count(*) FILTER (good) AS n_good FROM pool GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY outlet_clean, year ORDER BY md5('42#' || row_idx), row_idx) AS n FROM pool JOIN good USING (outlet_clean, year) WHERE good OR n_good < need),
  drawn AS (SELECT row_idx, outlet_clean, year, good FROM ranked WHERE n <= need)"""


def _sampled(t: Tables) -> DataFrame:
    return stratified(units(t), ["outlet_clean", "year"], "row_idx", F.greatest(F.lit(1), F.bround(F.col("_size") * 0.1)).cast("long"))


def _need(t: Tables) -> DataFrame:
    """(cell, need) of cells whose sample is thin or deviates: on-topic rows that its tenth still lacks."""
    c = _sampled(t).groupBy("outlet_clean", "year").agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col("on_topic"), F.lit(False))).alias("on_topic"))
    goal = units(t).groupBy("outlet_clean", "year").agg(F.greatest(F.lit(1), F.bround(F.count("*") * 0.1)).cast("long").alias("target"))
    whole = c.agg((100.0 * (F.sum("total") - F.sum("on_topic")) / F.sum("total")).alias("whole"))
    rows = c.join(goal, ["outlet_clean", "year"]).join(F.broadcast(whole)).withColumn("need", F.col("target") - F.col("on_topic"))
    off = F.abs(100.0 * (F.col("total") - F.col("on_topic")) / F.col("total") - F.col("whole")) > 15.0
    return rows.where(((F.col("on_topic") < F.greatest(F.lit(1), F.bround(F.col("target") * 0.5))) | off) & (F.col("need") > 0)).select("outlet_clean", "year", "need")


@query(f"WITH {_TOPUP} SELECT row_idx, outlet_clean, year, good AS on_topic FROM drawn")
def topup_draw(t: Tables) -> DataFrame:
    """Rows drawn for the cells that lack some, without articles whose date and title are sampled already."""
    key = F.concat(F.coalesce("date", F.lit("nan")), F.lit("|"), F.coalesce(F.lower(text.strip(F.col("title"))), F.lit("nan")))
    names = t.preprocess_final.select("row_idx", key.alias("k"))
    need = stage(_need(t), "topup-need")
    sampled = _sampled(t).select("row_idx").distinct().join(names, "row_idx").select("k").distinct()
    pool = units(t).join(broadcast_if_small(need), ["outlet_clean", "year"]).join(names, "row_idx").join(sampled, "k", "left_anti")
    pool = pool.select("row_idx", "outlet_clean", "year", F.coalesce("on_topic", F.lit(False)).alias("on_topic"), "need")
    return top_up(pool, ["outlet_clean", "year"], "row_idx", F.col("on_topic"), "need").select("row_idx", "outlet_clean", "year", "on_topic")


@query(f"WITH {_TOPUP} SELECT outlet_clean, year, need, CAST(count(row_idx) AS BIGINT) AS drawn, CASE WHEN count(row_idx) = 0 THEN 'pool exhausted' ELSE 'ok' END AS status FROM need LEFT JOIN drawn USING (outlet_clean, year) GROUP BY ALL")
def topup_need(t: Tables) -> DataFrame:
    """What each cell lacks, and what was drawn for it."""
    drawn = topup_draw(t).groupBy("outlet_clean", "year").agg(F.count("*").alias("drawn"))
    return _need(t).join(drawn, ["outlet_clean", "year"], "left").fillna(0, ["drawn"]).withColumn("status", F.when(F.col("drawn") == 0, "pool exhausted").otherwise("ok"))


# ---- joins ----

_RAW = f"""raw AS (SELECT row_idx, {_KEY} AS k, md5({sql_strip('body')}) AS m, {_WORDS} AS w FROM preprocess_final WHERE corpus = 'migration'),
  have AS (SELECT row_idx, {_KEY} AS k, md5({sql_strip('body')}) AS m, word_count AS w FROM preprocess_final WHERE corpus = 'climate' UNION ALL SELECT row_idx, {_KEY}, md5({_BODY}), word_count + row_idx % 2 FROM preprocess_final WHERE corpus = 'migration')"""


@query(f"""WITH {_RAW}, c AS (SELECT h.row_idx, count(r.k) AS n, count(DISTINCT coalesce(r.m, '?')) FILTER (r.k IS NOT NULL AND r.m IS NOT DISTINCT FROM h.m) AS same, count(DISTINCT coalesce(r.m, '?')) FILTER (r.k IS NOT NULL AND r.w IS NOT DISTINCT FROM h.w) AS long, min(coalesce(r.m, '?')) FILTER (r.k IS NOT NULL AND r.w IS NOT DISTINCT FROM h.w) AS long_m,
    count(DISTINCT coalesce(r.m, '?')) FILTER (r.k IS NOT NULL) AS total, min(coalesce(r.m, '?')) FILTER (r.k IS NOT NULL) AS total_m, any_value(h.m) AS own FROM have h LEFT JOIN raw r USING (k) GROUP BY h.row_idx)
SELECT row_idx, CAST(n AS BIGINT) AS candidates, CASE WHEN n = 0 THEN 'no match' WHEN n = 1 THEN 'single' WHEN same = 1 THEN 'body_exact' WHEN long = 1 THEN 'word_count_derived' WHEN total = 1 THEN 'candidates_identical' ELSE 'ambiguous' END AS method,
  nullif(CASE WHEN n = 1 THEN total_m WHEN n > 1 THEN CASE WHEN same = 1 THEN coalesce(own, '?') WHEN long = 1 THEN long_m WHEN total = 1 THEN total_m END END, '?') AS resolved FROM c""")
def ambiguous_key_resolution(t: Tables) -> DataFrame:
    """Cleaned articles looked up among the raw ones by outlet, day and title, and what several candidates agree on."""
    p = t.preprocess_final
    own = F.md5(text.strip(F.col("body"))).alias("m")
    raw = p.where("corpus = 'migration'").select(match_key().alias("k"), own, text.word_count(F.col("body")).alias("w"))
    clean = p.where("corpus = 'migration'").select("row_idx", match_key().alias("k"), F.md5(text.drop_export_lines(F.col("body"))).alias("m"), (F.col("word_count") + F.col("row_idx") % 2).alias("w"))
    other = p.where("corpus = 'climate'").select("row_idx", match_key().alias("k"), own, F.col("word_count").alias("w"))
    return resolve_candidates(other.unionByName(clean), raw, "row_idx", "k", "m", "w")


@query("SELECT p.row_idx, p.corpus, c.year, c.on_topic FROM preprocess_final p LEFT JOIN (SELECT row_idx, max(year) AS year, bool_or(on_topic_flag) AS on_topic FROM check_strata GROUP BY row_idx) c USING (row_idx)")
def one_to_one_join(t: Tables) -> DataFrame:
    """A left join that fails if a key comes twice on either side."""
    right = t.check_strata.groupBy("row_idx").agg(F.max("year").alias("year"), F.bool_or("on_topic_flag").alias("on_topic"))
    return one_to_one(t.preprocess_final.select("row_idx", "corpus"), right, ["row_idx"])


@query("SELECT row_idx, year, CAST(count(*) AS BIGINT) AS n FROM check_strata WHERE row_idx IS NOT NULL AND year IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def audit_one_to_one(t: Tables) -> DataFrame:
    """Keys by which such a join would fail."""
    return repeated_keys(t.check_strata, ["row_idx", "year"])


@query("""SELECT 'check_strata' AS step, (SELECT count(*) FROM check_strata) AS before, (SELECT count(*) FROM check_strata c LEFT JOIN token_usage u ON u.article_idx = c.row_idx) AS after""")
def audit_row_count(t: Tables) -> DataFrame:
    """Rows before and after a left join whose right side repeats keys; no row where the number stays."""
    left, right = t.check_strata.select("row_idx"), t.token_usage.select(F.col("article_idx").alias("row_idx"))
    before, after = left.agg(F.count("*").alias("before")), left.join(right, "row_idx", "left").agg(F.count("*").alias("after"))
    return before.join(F.broadcast(after)).where("before != after").select(F.lit("check_strata").alias("step"), "before", "after")
