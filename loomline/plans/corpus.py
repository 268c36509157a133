"""Cleaning, deduplication, gating and sampling queries over the articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions import text
from loomline.operators.labels import percent
from loomline.operators.order import dense_ordinal, first_row
from loomline.operators.sampling import proportional, stratified
from loomline.plans.registry import Tables, query, sql_collapse, sql_strip

#: Topics that do not count for the second corpus (a parameter of the gate).
OFF_TOPIC = ("Sport", "Cultuur & Media", "Zorg", "Overig")
FIRST, LAST = "2014-01-01 00:00:00", "2023-12-31 00:00:00"

_DATE = "coalesce(try_strptime(date, '%Y-%m-%d %H:%M:%S'), try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%d-%m-%Y'))"
_TITLE = f"CASE WHEN length(title) > 0 AND ({sql_strip('left(title, length(title) // 2)')} = {sql_strip('substr(title, length(title) // 2 + 1)')} OR {sql_strip('left(title, length(title) // 2 + 1)')} = {sql_strip('substr(title, length(title) // 2 + 1)')}) THEN {sql_strip('left(title, length(title) // 2)')} ELSE {sql_strip('title')} END"
_BODY = sql_strip(r"regexp_replace(regexp_replace(body, '(?mi)" + "|".join(text.EXPORT_LINES) + r"', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
_WORDS = "CAST(len(regexp_extract_all(coalesce(body, ''), '[^\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x{85}\\p{Z}]+')) AS BIGINT)"


@query(f"SELECT row_idx, {_TITLE} AS title FROM preprocess_final")
def fix_doubled_title(t: Tables) -> DataFrame:
    return t.preprocess_final.select("row_idx", text.undouble(F.col("title")).alias("title"))


@query(f"SELECT row_idx, md5({_BODY}) AS body_md5, length({_BODY}) AS n_chars FROM preprocess_final")
def clean_text(t: Tables) -> DataFrame:
    body = text.drop_export_lines(F.col("body"))
    return t.preprocess_final.select("row_idx", F.md5(body).alias("body_md5"), F.length(body).cast("long").alias("n_chars"))


@query(f"SELECT row_idx, {_WORDS} AS words FROM preprocess_final WHERE {_WORDS} >= 100")
def word_count_filter(t: Tables) -> DataFrame:
    return t.preprocess_final.select("row_idx", text.word_count(F.col("body")).alias("words")).where("words >= 100")


@query(f"""SELECT term, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(list_transform(regexp_extract_all(matched_keywords_all, '''([^'']*)''', 1), lambda x: {sql_strip('x')})) AS term FROM preprocess_final
WHERE regexp_matches(matched_keywords_all, '^\\s*\\[\\s*(''[^'']*''\\s*(,\\s*''[^'']*''\\s*)*)?\\]\\s*$')) GROUP BY term""")
def keyword_list(t: Tables) -> DataFrame:
    """Terms of well-formed list literals; the malformed ones are skipped."""
    return t.preprocess_final.select(F.explode(text.parse_list(F.col("matched_keywords_all"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"SELECT row_idx, coalesce({sql_strip('meta')} NOT IN ({', '.join(map(repr, OFF_TOPIC))}), true) AS on_topic FROM preprocess_final WHERE corpus = 'migration'")
def null_safe_not_in(t: Tables) -> DataFrame:
    """A null topic is on topic."""
    return t.preprocess_final.where("corpus = 'migration'").select("row_idx", F.coalesce(~text.strip(F.col("meta")).isin(*OFF_TOPIC), F.lit(True)).alias("on_topic"))


@query(f"WITH v AS (SELECT meta AS raw, {sql_collapse('meta')} AS topic, count(*) AS n FROM preprocess_final WHERE meta IS NOT NULL GROUP BY meta) SELECT topic, raw, CAST(n AS BIGINT) AS n FROM v WHERE topic IN (SELECT topic FROM v GROUP BY topic HAVING count(*) > 1)")
def whitespace_variants(t: Tables) -> DataFrame:
    v = t.preprocess_final.where("meta is not null").groupBy(F.col("meta").alias("raw")).agg(F.count("*").alias("n")).withColumn("topic", text.collapse_blanks(F.col("raw")))
    return v.join(v.groupBy("topic").count().where("count > 1").select("topic"), "topic", "left_semi").select("topic", "raw", "n")


@query(f"SELECT row_idx, {_DATE} AS at, CAST(year({_DATE}) AS INTEGER) AS year, strftime({_DATE}, '%Y-%m-%d') AS day FROM preprocess_final WHERE {_DATE} BETWEEN TIMESTAMP '{FIRST}' AND TIMESTAMP '{LAST}'")
def date_clip(t: Tables) -> DataFrame:
    """Readable dates of the closed range; times after midnight of the last day are beyond it."""
    rows = t.preprocess_final.select("row_idx", text.parse_date(F.col("date")).cast("timestamp_ntz").alias("at"))
    return rows.where(f"at between timestamp_ntz'{FIRST}' and timestamp_ntz'{LAST}'").select("row_idx", F.col("at").cast("timestamp").alias("at"), F.year("at").alias("year"), F.date_format("at", "yyyy-MM-dd").alias("day"))


_EDITION = "coalesce(nullif(regexp_extract(outlet, '(Online|Print)', 1), ''), 'other')"


def editions(t: Tables) -> DataFrame:
    edition = F.coalesce(F.nullif(F.regexp_extract("outlet", "(Online|Print)", 1), F.lit("")), F.lit("other"))
    return t.preprocess_final.where("corpus = 'migration'").select("row_idx", "outlet_clean", text.parse_date(F.col("date")).alias("at"), "title", "body", edition.alias("edition"))


@query(f"SELECT row_idx, edition FROM (SELECT row_idx, {_EDITION} AS edition, row_number() OVER (PARTITION BY outlet_clean, {_DATE}, title ORDER BY {_EDITION}, row_idx) AS n FROM preprocess_final WHERE corpus = 'migration') WHERE n = 1")
def dedup_priority(t: Tables) -> DataFrame:
    """One row a (outlet, date, title), nulls equal: Online before Print before other, then the smaller id."""
    return first_row(editions(t), ["outlet_clean", "at", "title"], [F.col("edition"), F.col("row_idx")]).select("row_idx", "edition")


@query("SELECT min(row_idx) AS row_idx, CAST(count(*) AS BIGINT) AS copies FROM preprocess_final GROUP BY md5(body)")
def dedup_exact_body(t: Tables) -> DataFrame:
    """The earliest row of each body; a hash goes through the shuffle, not the text."""
    return t.preprocess_final.select("row_idx", F.md5("body").alias("m")).groupBy("m").agg(F.min("row_idx").alias("row_idx"), F.count("*").alias("copies")).drop("m")


_KEY = f"outlet_clean || '|' || strftime({_DATE}, '%Y-%m-%d') || '|' || lower({sql_strip('title')})"


def match_key() -> F.Column:
    return F.concat(F.col("outlet_clean"), F.lit("|"), F.date_format(text.parse_date(F.col("date")), "yyyy-MM-dd"), F.lit("|"), F.lower(text.strip(F.col("title"))))


@query(f"WITH k AS (SELECT row_idx, corpus, {_KEY} AS k FROM preprocess_final), b AS (SELECT k FROM k WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT corpus) > 1) SELECT row_idx, coalesce(k IN (SELECT k FROM b), false) AS overlap FROM k")
def overlap_flag(t: Tables) -> DataFrame:
    """Articles whose outlet, day and title stand in both corpora; a null in the key overlaps with nothing."""
    k = t.preprocess_final.select("row_idx", "corpus", match_key().alias("k"))
    keyed = k.where("k is not null")
    both = keyed.groupBy("k").agg(F.count_distinct("corpus").alias("n")).where("n > 1").select("k", F.lit(True).alias("hit"))
    # rows without a key stay out of the join, where they would all meet in one task
    hits = keyed.join(both, "k", "left").select("row_idx", F.coalesce("hit", F.lit(False)).alias("overlap"))
    return hits.unionByName(k.where("k is null").select("row_idx", F.lit(False).alias("overlap")))


@query(f"SELECT row_idx, r.outlet_clean FROM preprocess_final p LEFT JOIN (SELECT outlet_clean, unnest([outlet_clean, full_name]) AS name FROM outlet_reference) r ON {sql_strip('''regexp_replace(outlet, '\\s*\\((Online|Print)\\)$', '')''')} = r.name QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY r.outlet_clean) = 1")
def outlet_map(t: Tables) -> DataFrame:
    """The plain lookup of an outlet's name without its edition; unmapped ones are null."""
    names = t.outlet_reference.select("outlet_clean", F.explode(F.array("outlet_clean", "full_name")).alias("name")).distinct().groupBy("name").agg(F.min("outlet_clean").alias("outlet_clean"))
    return t.preprocess_final.select("row_idx", text.strip(F.regexp_replace("outlet", r"\s*\((Online|Print)\)$", "")).alias("name")).join(F.broadcast(names), "name", "left").select("row_idx", "outlet_clean")


@query("SELECT corpus, coalesce(outlet_clean, 'none') AS outlet, CAST(count(*) AS BIGINT) AS n, min(word_count) AS least, max(word_count) AS most, round(avg(word_count), 4) AS mean, median(word_count) AS median FROM preprocess_final GROUP BY ALL")
def summary_stats(t: Tables) -> DataFrame:
    return t.preprocess_final.groupBy("corpus", F.coalesce("outlet_clean", F.lit("none")).alias("outlet")).agg(F.count("*").alias("n"), F.min("word_count").alias("least"), F.max("word_count").alias("most"), F.round(F.avg("word_count"), 4).alias("mean"), F.median("word_count").alias("median"))


@query(f"SELECT {sql_strip('meta')} AS topic, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, {sql_strip('meta')}) AS INTEGER) AS place FROM preprocess_final WHERE meta IS NOT NULL GROUP BY 1")
def frequency_table(t: Tables) -> DataFrame:
    """Topics and their place by size; the ranking in one task has a row a topic."""
    rows = t.preprocess_final.where("meta is not null").groupBy(text.strip(F.col("meta")).alias("topic")).agg(F.count("*").alias("n"))
    return rows.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "topic")))


_RX = "(?i)\\b(gemeente|provincie|waterschap|minister)\\b"


@query(f"SELECT row_idx, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(body, '{_RX}'), lambda x: lower(x))))[1:3], '; '), '') AS found, coalesce(regexp_matches(body, '{_RX}'), false) AS any_hit FROM preprocess_final")
def regex_found_sets(t: Tables) -> DataFrame:
    return t.preprocess_final.select("row_idx", text.found_set(F.col("body"), _RX, 3).alias("found"), F.coalesce(F.col("body").rlike(_RX), F.lit(False)).alias("any_hit"))


_FLAT = "replace(title, chr(10), ' ')"


@query(f"""SELECT row_idx, CASE WHEN length({_FLAT}) > 40 THEN left({_FLAT}, 40) || '…' ELSE {_FLAT} END AS excerpt, regexp_replace(title, '[\\x{{2010}}-\\x{{2015}}]', '-', 'g') AS dashes,
  replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html, split_part(outlet, ' (', 1) AS kind FROM preprocess_final""")
def text_helpers(t: Tables) -> DataFrame:
    c = F.col("title")
    return t.preprocess_final.select("row_idx", text.excerpt(c, 40).alias("excerpt"), text.dashes(c).alias("dashes"), text.html_escape(c).alias("html"), F.substring_index("outlet", " (", 1).alias("kind"))


_FLAGS = "CASE WHEN title IS NULL THEN 'no title; ' ELSE '' END || CASE WHEN regexp_matches(coalesce(body, ''), 'Load-Date') THEN 'export line; ' ELSE '' END || CASE WHEN coalesce(length(body), 0) < 300 THEN 'short; ' ELSE '' END"


@query(f"SELECT * FROM (SELECT row_idx, rtrim({_FLAGS}, '; ') AS flags FROM preprocess_final) WHERE flags <> ''")
def review_flags(t: Tables) -> DataFrame:
    """An ordered unique list of the rules that a row meets."""
    rules = F.array(F.when(F.col("title").isNull(), "no title"), F.when(F.col("body").rlike("Load-Date"), "export line"), F.when(F.coalesce(F.length("body"), F.lit(0)) < 300, "short"))
    return t.preprocess_final.select("row_idx", F.array_join(F.array_distinct(F.array_compact(rules)), "; ").alias("flags")).where("flags != ''")


@query("""SELECT flag, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(rtrim(CASE WHEN title IS NULL THEN 'no title; ' ELSE '' END || CASE WHEN coalesce(length(body), 0) < 300 THEN 'short; ' ELSE '' END, '; '), '; ')) AS flag FROM preprocess_final) WHERE flag <> '' GROUP BY flag""")
def flag_counts(t: Tables) -> DataFrame:
    rules = F.array_join(F.array_compact(F.array(F.when(F.col("title").isNull(), "no title"), F.when(F.coalesce(F.length("body"), F.lit(0)) < 300, "short"))), "; ")
    return t.preprocess_final.select(F.explode(F.split(rules, "; ")).alias("flag")).where("flag != ''").groupBy("flag").agg(F.count("*").alias("n"))


# ---- strata ----

_U = "u AS (SELECT row_idx, outlet_clean, year, max(corpus) AS corpus, bool_or(on_topic_flag) AS on_topic FROM check_strata WHERE outlet_clean IS NOT NULL AND year IS NOT NULL GROUP BY ALL)"


def units(t: Tables) -> DataFrame:
    rows = t.check_strata.where("outlet_clean is not null and year is not null")
    return rows.groupBy("row_idx", "outlet_clean", "year").agg(F.max("corpus").alias("corpus"), F.bool_or("on_topic_flag").alias("on_topic"))


_CELL = f"{_U}, c AS (SELECT outlet_clean, year, count(*) AS total, count(*) FILTER (on_topic) AS on_topic, count(*) FILTER (NOT coalesce(on_topic, false)) AS off_topic FROM u GROUP BY ALL)"


def cells(t: Tables) -> DataFrame:
    yes = F.coalesce(F.col("on_topic"), F.lit(False))
    return units(t).groupBy("outlet_clean", "year").agg(F.count("*").alias("total"), F.count_if(yes).alias("on_topic"), F.count_if(~yes).alias("off_topic"))


@query(f"WITH {_CELL} SELECT *, round_even(100.0 * off_topic / total, 4) AS off_topic_pct, round_even(100.0 * on_topic / total, 4) AS on_topic_pct FROM c")
def cell_stats(t: Tables) -> DataFrame:
    pct = lambda c: F.bround(100.0 * F.col(c) / F.col("total"), 4)
    return cells(t).withColumn("off_topic_pct", pct("off_topic")).withColumn("on_topic_pct", pct("on_topic"))


@query(f"WITH {_U} SELECT row_idx FROM (SELECT row_idx, count(*) OVER (PARTITION BY outlet_clean, year) AS size, row_number() OVER (PARTITION BY outlet_clean, year ORDER BY md5('42#' || row_idx), row_idx) AS n FROM u) WHERE n <= greatest(1, round_even(0.1 * size, 0))")
def stratified_sample(t: Tables) -> DataFrame:
    return stratified(units(t), ["outlet_clean", "year"], "row_idx", F.greatest(F.lit(1), F.bround(F.col("_size") * 0.1)).cast("long")).select("row_idx")


@query(f"""WITH {_U}, r AS (SELECT row_idx, count(*) OVER () AS pool, count(*) OVER (PARTITION BY outlet_clean, year) AS size, row_number() OVER (PARTITION BY outlet_clean, year ORDER BY md5('42#' || row_idx), row_idx) AS n FROM u)
SELECT row_idx FROM r ORDER BY n > least(size, greatest(1, round_even(size * 100.0 / pool, 0))), md5('43#' || row_idx), row_idx LIMIT 100""")
def proportional_draw(t: Tables) -> DataFrame:
    """Exactly 100 rows in proportion to the strata."""
    return proportional(units(t), ["outlet_clean", "year"], "row_idx", 100).select("row_idx")


@query(f"WITH {_U}, a AS (SELECT count(*) FILTER (corpus = 'climate') AS c, count(*) AS n FROM u) SELECT CAST(round_even(100.0 * c / n, 0) AS BIGINT) AS climate, CAST(100 - round_even(100.0 * c / n, 0) AS BIGINT) AS migration FROM a")
def corpus_allocation(t: Tables) -> DataFrame:
    a = units(t).agg(percent(F.count_if(F.col("corpus") == "climate"), F.count("*"), 0).cast("long").alias("climate"))
    return a.withColumn("migration", 100 - F.col("climate"))


@query("SELECT row_idx, kw FROM (SELECT row_idx, coalesce(max(title_keyword_count), 0) + coalesce(max(body_keyword_count), 0) AS kw FROM check_strata GROUP BY row_idx) ORDER BY kw DESC, row_idx LIMIT 25")
def topk_boundary(t: Tables) -> DataFrame:
    """The 25 rows with the most keywords, nulls as 0."""
    rows = t.check_strata.groupBy("row_idx").agg((F.coalesce(F.max("title_keyword_count"), F.lit(0)) + F.coalesce(F.max("body_keyword_count"), F.lit(0))).cast("long").alias("kw"))
    return rows.orderBy(F.desc("kw"), "row_idx").limit(25)


# ---- joins and sets ----


@query("SELECT row_idx FROM preprocess_final p WHERE NOT EXISTS (SELECT 1 FROM check_strata c WHERE c.row_idx = p.row_idx)")
def anti_resume(t: Tables) -> DataFrame:
    return t.preprocess_final.select("row_idx").join(t.check_strata.select("row_idx").distinct(), "row_idx", "left_anti")


@query("SELECT DISTINCT row_idx FROM check_strata WHERE row_idx IN (SELECT article_idx FROM annotated) ")
def semi_requests(t: Tables) -> DataFrame:
    return t.check_strata.select("row_idx").join(t.annotated.select(F.col("article_idx").alias("row_idx")), "row_idx", "left_semi").distinct()


@query("SELECT row_idx, 'both' AS kind FROM (SELECT row_idx FROM check_strata INTERSECT SELECT article_idx FROM annotated) UNION ALL SELECT row_idx, 'left' FROM (SELECT row_idx FROM check_strata EXCEPT SELECT article_idx FROM annotated) UNION ALL SELECT row_idx, 'right' FROM (SELECT article_idx AS row_idx FROM annotated EXCEPT SELECT row_idx FROM check_strata)")
def set_operations(t: Tables) -> DataFrame:
    a, b = t.check_strata.select("row_idx"), t.annotated.select(F.col("article_idx").alias("row_idx"))
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.subtract(b).withColumn("kind", F.lit("left"))).unionByName(b.subtract(a).withColumn("kind", F.lit("right")))


@query("SELECT row_idx AS id, corpus, outlet_clean, CAST(NULL AS VARCHAR) AS lang FROM preprocess_final UNION ALL SELECT doc_id, corpus, NULL, lang FROM documents")
def union_lenient(t: Tables) -> DataFrame:
    return t.preprocess_final.select(F.col("row_idx").alias("id"), "corpus", "outlet_clean").unionByName(t.documents.select(F.col("doc_id").alias("id"), "corpus", "lang"), allowMissingColumns=True)


@query("SELECT coalesce(c.row_idx, a.article_idx) AS id, CASE WHEN a.article_idx IS NULL THEN 'left_only' WHEN c.row_idx IS NULL THEN 'right_only' ELSE 'both' END AS side FROM (SELECT DISTINCT row_idx FROM check_strata) c FULL JOIN (SELECT DISTINCT article_idx FROM annotated) a ON c.row_idx = a.article_idx")
def full_outer_indicator(t: Tables) -> DataFrame:
    a, b = t.check_strata.select(F.col("row_idx").alias("id"), F.lit(1).alias("l")).distinct(), t.annotated.select(F.col("article_idx").alias("id"), F.lit(1).alias("r")).distinct()
    return a.join(b, "id", "full_outer").select("id", F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").otherwise("both").alias("side"))


@query("SELECT row_idx, CAST(count(*) AS BIGINT) AS n FROM check_strata GROUP BY row_idx HAVING count(*) > 1")
def audit_unique_key(t: Tables) -> DataFrame:
    """Keys that would break a one-to-one join."""
    return t.check_strata.groupBy("row_idx").agg(F.count("*").alias("n")).where("n > 1")


@query("""WITH o AS (SELECT row_idx, row_number() OVER (PARTITION BY corpus ORDER BY row_idx) - 1 AS n, corpus FROM preprocess_final) SELECT a.row_idx AS left_idx, b.row_idx AS right_idx, CAST(n AS BIGINT) AS n FROM o a JOIN o b USING (n) WHERE a.corpus = 'climate' AND b.corpus = 'migration'""")
def positional_join(t: Tables) -> DataFrame:
    """The n-th row of one corpus beside the n-th of the other."""
    o = dense_ordinal(t.preprocess_final.select("row_idx", "corpus"), ["corpus"], "row_idx", "n")
    return o.where("corpus = 'climate'").select(F.col("row_idx").alias("left_idx"), "n").join(o.where("corpus = 'migration'").select(F.col("row_idx").alias("right_idx"), "n"), "n")


@query("SELECT outlet_clean, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM preprocess_final WHERE outlet_clean IS NOT NULL GROUP BY outlet_clean")
def share_of_total(t: Tables) -> DataFrame:
    """Shares of the whole; the sum in one task has a row an outlet."""
    c = t.preprocess_final.where("outlet_clean is not null").groupBy("outlet_clean").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 6))


@query("SELECT outlet_clean, CAST(min(year) AS INTEGER) AS first, CAST(max(year) AS INTEGER) AS last, CAST(count(*) AS BIGINT) AS years FROM (SELECT *, year - row_number() OVER (PARTITION BY outlet_clean ORDER BY year) AS g FROM (SELECT DISTINCT outlet_clean, year FROM check_strata WHERE outlet_clean IS NOT NULL AND year IS NOT NULL AND NOT on_topic_flag)) GROUP BY outlet_clean, g")
def year_runs(t: Tables) -> DataFrame:
    """Runs of successive years (gaps and islands)."""
    y = t.check_strata.where("outlet_clean is not null and year is not null and not on_topic_flag").select("outlet_clean", "year").distinct()
    g = y.withColumn("g", F.col("year") - F.row_number().over(W.partitionBy("outlet_clean").orderBy("year")))
    return g.groupBy("outlet_clean", "g").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.count("*").alias("years")).drop("g")
