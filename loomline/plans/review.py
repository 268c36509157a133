"""Disagreements and what they are, merged snapshots, ledgers with nested rows, and rules that data must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions import text
from loomline.operators.annotator import gate
from loomline.operators.labels import LABELS, label_table, pass_table, percent
from loomline.operators.sampling import proportional
from loomline.plans.annotation import FALLBACK_OUT, WEIGHT_IN, WEIGHT_OUT
from loomline.plans.corpus import _U, units
from loomline.plans.labels import _COUNTS, _DIMS, _LONG, _PAIR, long, raters
from loomline.plans.registry import Tables, query, sql_collapse, sql_yes_no
from loomline.plans.selection import _sampled

# ---- cells of two raters ----

_SCOPED = f"{_PAIR}, {_DIMS}, x AS (SELECT r.*, p.pass_name IS NOT NULL AS in_scope FROM r JOIN d USING (frame) LEFT JOIN p ON p.corpus_type = r.corpus_type AND p.pass_name = d.pass_name)"
_CLASS = "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'comparable' WHEN a IS NOT NULL THEN 'B. first only' WHEN b IS NOT NULL THEN 'C. second only' WHEN in_scope THEN 'D. both blank in scope' ELSE 'A. structural' END"


def scoped(t: Tables) -> DataFrame:
    """Cells of both raters, and whether the label applies to the article's corpus type."""
    applies = F.broadcast(pass_table(t.spark).withColumn("in_scope", F.lit(True)))
    return raters(t).join(F.broadcast(label_table(t.spark)), "frame").join(applies, ["corpus_type", "pass_name"], "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))


@query(f"WITH {_SCOPED} SELECT {_CLASS} AS class, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (a = b) AS BIGINT) AS equal FROM x GROUP BY ALL")
def cell_census(t: Tables) -> DataFrame:
    """Comparable cells, and the others by scope and by who left them blank."""
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    kind = F.when(a & b, "comparable").when(a, "B. first only").when(b, "C. second only").when(F.col("in_scope"), "D. both blank in scope").otherwise("A. structural")
    return scoped(t).groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("equal"))


@query(f"WITH {_PAIR} SELECT coalesce(frame, 'ALL') AS frame, CAST(count(*) FILTER (a = 'no' AND b = 'yes') AS BIGINT) AS no_yes, CAST(count(*) FILTER (a = 'yes' AND b = 'no') AS BIGINT) AS yes_no, CAST(count(*) FILTER (a <> b) AS BIGINT) AS disagreements FROM r GROUP BY GROUPING SETS ((frame), ())")
def disagreement_direction(t: Tables) -> DataFrame:
    """Which way the raters differ, by label and over all."""
    rows = raters(t).groupBy("frame").agg(F.count_if((F.col("a") == "no") & (F.col("b") == "yes")).alias("no_yes"), F.count_if((F.col("a") == "yes") & (F.col("b") == "no")).alias("yes_no"), F.count_if(F.col("a") != F.col("b")).alias("disagreements"))
    sums = [F.sum(c).alias(c) for c in ("no_yes", "yes_no", "disagreements")]
    return rows.unionByName(rows.agg(*sums).withColumn("frame", F.lit("ALL")))


@query(f"WITH {_PAIR} SELECT article_idx, frame, first_value, second_value FROM (SELECT article_idx, frame, a AS first_value, b AS second_value, row_number() OVER (PARTITION BY article_idx, frame ORDER BY prompt_variant, run_number, a, b) AS n FROM r WHERE a <> b) WHERE n = 1")
def disagreement_rows(t: Tables) -> DataFrame:
    """One row an article and label that the raters differ on: that of the first run in which they do."""
    first = F.min(F.struct("prompt_variant", "run_number", "a", "b")).alias("x")
    return raters(t).where("a != b").groupBy("article_idx", "frame").agg(first).select("article_idx", "frame", F.col("x.a").alias("first_value"), F.col("x.b").alias("second_value"))


@query(f"WITH {_PAIR} SELECT outlet_clean, frame, printf('%.2f%% (%d/%d)', round(100.0 * count(*) FILTER (a = 'yes') / count(a), 4), count(*) FILTER (a = 'yes'), count(a)) AS focal FROM r WHERE a IS NOT NULL AND outlet_clean IS NOT NULL GROUP BY ALL")
def focal_share(t: Tables) -> DataFrame:
    """The share of a group as it is printed: per cent, and the counts behind it."""
    rows = long(t).where("present is not null and outlet_clean is not null").groupBy("outlet_clean", "frame").agg(F.count_if(F.col("present") == "yes").alias("k"), F.count("*").alias("n"))
    share = F.regexp_replace(F.format_number(F.round(100.0 * F.col("k") / F.col("n"), 4), 2), ",", "")
    return rows.select("outlet_clean", "frame", F.format_string("%s%% (%d/%d)", share, F.col("k"), F.col("n")).alias("focal"))


@query(f"WITH {_LONG} SELECT corpus, year, frame, CAST(sum(CASE present WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END) AS BIGINT) AS ones, CASE WHEN count(present) <= 2 THEN 'grey' WHEN count(present) < 10 THEN 'hollow' ELSE 'solid' END AS marker FROM l WHERE year IS NOT NULL GROUP BY ALL")
def marker_tiers(t: Tables) -> DataFrame:
    """Labels as numbers, and how a point of so many articles is drawn."""
    one = F.when(F.col("present") == "yes", 1).when(F.col("present") == "no", 0)
    rows = long(t).where("year is not null").groupBy("corpus", "year", "frame").agg(F.sum(one).alias("ones"), F.count("present").alias("n"))
    return rows.select("corpus", "year", "frame", "ones", F.when(F.col("n") <= 2, "grey").when(F.col("n") < 10, "hollow").otherwise("solid").alias("marker"))


@query(f"WITH {_LONG}, c AS (SELECT corpus, outlet_clean, frame, {_COUNTS} FROM l WHERE outlet_clean IS NOT NULL GROUP BY ALL) SELECT corpus, outlet_clean, CAST(n_applicable AS BIGINT) AS articles FROM c WHERE frame = '{LABELS[0][0]}'")
def selection_totals(t: Tables) -> DataFrame:
    """Articles of each selection, by the first label, which applies to all of them."""
    rows = long(t).where((F.col("frame") == LABELS[0][0]) & F.col("outlet_clean").isNotNull())
    return rows.groupBy("corpus", "outlet_clean").agg(F.count("present").alias("articles"))


@query(f"WITH {_LONG}, c AS (SELECT corpus, year, frame, {_COUNTS} FROM l WHERE year IS NOT NULL GROUP BY ALL) SELECT corpus, frame, array_to_string(list(year || ':' || n_present || '/' || n_applicable ORDER BY year), ' ') AS series FROM c GROUP BY ALL")
def series_payload(t: Tables) -> DataFrame:
    """The years of a label as one list, made of two that belong together by place."""
    c = long(t).where("year is not null").groupBy("corpus", "year", "frame").agg(F.count("present").alias("n"), F.count_if(F.col("present") == "yes").alias("k"))
    lists = c.groupBy("corpus", "frame").agg(F.sort_array(F.collect_list(F.struct("year", "k", "n"))).alias("x"))
    zipped = F.arrays_zip(F.col("x.year").alias("year"), F.transform("x", lambda v: F.concat_ws("/", v["k"], v["n"])).alias("value"))
    return lists.select("corpus", "frame", F.array_join(F.transform(zipped, lambda z: F.concat_ws(":", z["year"], z["value"])), " ").alias("series"))


# ---- snapshots ----

_LAYERS = f"""{_LONG}, o AS (SELECT article_idx, frame, max(present) FILTER (prompt_variant = 'A') AS old, max(present) FILTER (prompt_variant = 'B' AND run_number = 1) AS shown, max(present) FILTER (prompt_variant = 'B' AND run_number > 1) AS revised FROM l GROUP BY ALL),
  g AS (SELECT article_idx, CASE WHEN substr(md5(CAST(article_idx AS VARCHAR)), 1, 1) < '4' THEN 'none' WHEN substr(md5(CAST(article_idx AS VARCHAR)), 1, 1) < '8' THEN 'state' END AS kind FROM (SELECT DISTINCT article_idx FROM l)),
  m AS (SELECT o.*, coalesce(revised, shown, old) AS merged, CASE WHEN frame = 'agency' AND kind IS NOT NULL THEN CASE WHEN kind = 'none' THEN 'no' ELSE 'yes' END END AS derived, kind FROM o JOIN g USING (article_idx))"""


def layers(t: Tables) -> DataFrame:
    """An older snapshot, values shown and revised in a worksheet, and one label that follows from a type."""
    at = lambda c: F.max(F.when(c, F.col("present")))
    b = F.col("prompt_variant") == "B"
    o = long(t).groupBy("article_idx", "frame").agg(at(F.col("prompt_variant") == "A").alias("old"), at(b & (F.col("run_number") == 1)).alias("shown"), at(b & (F.col("run_number") > 1)).alias("revised"))
    h = F.substring(F.md5(F.col("article_idx").cast("string")), 1, 1)
    kind = F.when(h < "4", "none").when(h < "8", "state")
    o = o.withColumn("kind", kind).withColumn("merged", F.coalesce("revised", "shown", "old"))
    return o.withColumn("derived", F.when((F.col("frame") == "agency") & (F.col("kind") == "none"), "no").when((F.col("frame") == "agency") & F.col("kind").isNotNull(), "yes"))


@query(f"""WITH {_LAYERS} SELECT article_idx, frame, old AS before, merged AS after, CASE WHEN revised IS NOT NULL THEN 'explicit revision' ELSE 'affirmation of worksheet value' END AS kind FROM m WHERE coalesce(revised, shown) IS NOT NULL AND merged IS DISTINCT FROM old
UNION ALL SELECT article_idx, frame, merged, derived, 'derivation (agency_type=''' || kind || ''')' FROM m WHERE derived IS NOT NULL AND derived IS DISTINCT FROM merged""")
def change_log(t: Tables) -> DataFrame:
    """Every value that a layer changed, what it was, and by which layer."""
    m = layers(t)
    sheet = m.where("coalesce(revised, shown) is not null and not (merged <=> old)").select("article_idx", "frame", F.col("old").alias("before"), F.col("merged").alias("after"), F.when(F.col("revised").isNotNull(), "explicit revision").otherwise("affirmation of worksheet value").alias("kind"))
    rule = m.where("derived is not null and not (derived <=> merged)").select("article_idx", "frame", F.col("merged").alias("before"), F.col("derived").alias("after"), F.concat(F.lit("derivation (agency_type='"), "kind", F.lit("')")).alias("kind"))
    return sheet.unionByName(rule)


# ---- ledgers ----

_LEDGER = """k AS (SELECT o_orderkey AS chunk, o_custkey % 50 AS owner, o_orderstatus AS status, 20 + o_orderkey % 30 AS requests, CASE WHEN o_orderstatus = 'F' THEN 20 + o_orderkey % 30 - o_orderkey % 4 ELSE 0 END AS completed FROM orders),
  mk AS (SELECT l_orderkey AS chunk, count(*) FILTER (l_returnflag = 'R') AS parts, sum(l_linenumber % 3) FILTER (l_returnflag = 'R') AS completed FROM lineitem WHERE l_linenumber < 3 GROUP BY ALL)"""


def ledger(t: Tables) -> DataFrame:
    """Chunks with their makeups as an array of structs, as a job ledger nests them."""
    n = 20 + F.col("o_orderkey") % 30
    chunks = t.orders.select(F.col("o_orderkey").alias("chunk"), (F.col("o_custkey") % 50).alias("owner"), F.col("o_orderstatus").alias("status"), n.alias("requests"), F.when(F.col("o_orderstatus") == "F", n - F.col("o_orderkey") % 4).otherwise(0).alias("completed"))
    makeup = F.struct(F.when(F.col("l_returnflag") == "R", "completed").otherwise("failed").alias("status"), (F.col("l_linenumber") % 3).alias("completed"))
    makeups = t.lineitem.where("l_linenumber < 3").groupBy(F.col("l_orderkey").alias("chunk")).agg(F.collect_list(makeup).alias("makeups"))
    return chunks.join(makeups, "chunk", "left").withColumn("makeups", F.coalesce("makeups", F.array().cast("array<struct<status: string, completed: int>>")))


def _made_up() -> F.Column:
    done = F.filter("makeups", lambda m: m["status"] == "completed")
    return F.aggregate(done, F.lit(0).cast("long"), lambda n, m: n + m["completed"])


@query(f"WITH {_LEDGER} SELECT chunk, owner, CAST(requests - k.completed - coalesce(mk.completed, 0) AS BIGINT) AS outstanding FROM k LEFT JOIN mk USING (chunk) WHERE status = 'F' AND requests - k.completed - coalesce(mk.completed, 0) > 0")
def outstanding(t: Tables) -> DataFrame:
    """Finished chunks with requests that neither they nor their makeups completed."""
    rows = ledger(t).withColumn("outstanding", F.col("requests") - F.col("completed") - _made_up())
    return rows.where("status = 'F' and outstanding > 0").select("chunk", "owner", F.col("outstanding").cast("long").alias("outstanding"))


@query(f"""WITH {_LEDGER} SELECT owner, CAST(count(*) AS BIGINT) AS chunks, CAST(count(*) FILTER (status = 'F') AS BIGINT) AS finished, CAST(count(*) FILTER (status = 'O') AS BIGINT) AS open, CAST(count(*) FILTER (status = 'P') AS BIGINT) AS partial, CAST(sum(requests) AS BIGINT) AS requests,
  CAST(sum(k.completed + coalesce(mk.completed, 0)) AS BIGINT) AS done, round_even(100.0 * sum(k.completed + coalesce(mk.completed, 0)) / sum(requests), 4) AS pct FROM k LEFT JOIN mk USING (chunk) GROUP BY owner""")
def ledger_rollup(t: Tables) -> DataFrame:
    """A histogram of states per owner, and how many requests are done, makeups included."""
    rows = ledger(t).withColumn("done", F.col("completed") + _made_up())
    is_ = lambda s: F.count_if(F.col("status") == s)
    sums = rows.groupBy("owner").agg(F.count("*").alias("chunks"), is_("F").alias("finished"), is_("O").alias("open"), is_("P").alias("partial"), F.sum("requests").cast("long").alias("requests"), F.sum("done").cast("long").alias("done"))
    return sums.withColumn("pct", percent(F.col("done"), F.col("requests")))


@query(f"WITH {_LEDGER} SELECT owner, CAST(count(*) + coalesce(sum(parts), 0) AS BIGINT) AS parts, CAST(sum(k.completed + coalesce(mk.completed, 0)) AS BIGINT) AS lines, CAST(sum(requests) AS BIGINT) AS requests FROM k LEFT JOIN mk USING (chunk) GROUP BY owner HAVING lines <> sum(requests)")
def part_reconciliation(t: Tables) -> DataFrame:
    """Owners whose parts (chunks and completed makeups) do not hold a line for every request."""
    rows = ledger(t).select("owner", "requests", (F.col("completed") + _made_up()).alias("lines"), (F.size(F.filter("makeups", lambda m: m["status"] == "completed")) + 1).alias("parts"))
    sums = rows.groupBy("owner").agg(*[F.sum(c).cast("long").alias(c) for c in ("parts", "lines", "requests")])
    return sums.where("lines != requests")


@query("SELECT owner, chunk, requests FROM (SELECT o_custkey % 50 AS owner, o_orderkey AS chunk, 20 + o_orderkey % 30 AS requests, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') WHERE n = 1")
def next_chunk(t: Tables) -> DataFrame:
    """The first chunk of each owner that is still to be sent."""
    return ledger(t).where("status = 'O'").groupBy("owner").agg(F.min(F.struct("chunk", "requests")).alias("x")).select("owner", "x.chunk", "x.requests")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS done, CAST(epoch(max(ts)) - epoch(min(ts)) AS BIGINT) AS elapsed, CAST(round_even((epoch(max(ts)) - epoch(min(ts))) / count(*) * 500, 0) AS BIGINT) AS remaining FROM (SELECT event_type, date_trunc('second', ts) AS ts FROM events) GROUP BY event_type")
def time_left(t: Tables) -> DataFrame:
    """Seconds taken so far, and what 500 more would take at that rate."""
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = t.events.groupBy("event_type").agg(F.count("*").alias("done"), (F.max(second) - F.min(second)).alias("elapsed"))
    return rows.withColumn("remaining", F.bround(F.col("elapsed") / F.col("done") * 500).cast("long"))


@query("""WITH e AS (SELECT outlet_clean, count(*) AS n, count(*) FILTER (topic_central_flag IS NOT TRUE) AS excluded FROM check_strata WHERE on_topic_flag AND outlet_clean IS NOT NULL GROUP BY ALL) SELECT outlet_clean, CAST(excluded AS BIGINT) AS excluded, round_even(100.0 * excluded / n, 4) AS pct FROM e""")
def exclusion_share(t: Tables) -> DataFrame:
    """How much of each outlet's on-topic rows a second gate excludes; an unknown flag excludes too."""
    rows = t.check_strata.where("on_topic_flag and outlet_clean is not null").groupBy("outlet_clean").agg(F.count("*").alias("n"), F.count_if(~F.coalesce("topic_central_flag", F.lit(False))).alias("excluded"))
    return rows.select("outlet_clean", "excluded", percent(F.col("excluded"), F.col("n")).alias("pct"))


@query("SELECT row_idx FROM check_strata WHERE coalesce(on_topic_flag, false) AND coalesce(topic_central_flag, false) GROUP BY row_idx")
def eligible_rows(t: Tables) -> DataFrame:
    """Rows for which both flags are true; null is not."""
    return t.check_strata.where("coalesce(on_topic_flag, false) and coalesce(topic_central_flag, false)").select("row_idx").distinct()


@query("SELECT row_idx, CASE WHEN overlap THEN 'intersection' ELSE lower(trim(corpus)) END AS corpus_type FROM (SELECT row_idx, corpus, coalesce(row_idx IN (SELECT article_idx FROM annotated WHERE corpus_type = 'intersection'), false) AS overlap FROM preprocess_final)")
def corpus_type(t: Tables) -> DataFrame:
    """The third type is that of rows in both corpora; an unknown flag is not an overlap."""
    both = t.annotated.where("corpus_type = 'intersection'").select(F.col("article_idx").alias("row_idx"), F.lit(True).alias("overlap")).distinct()
    rows = t.preprocess_final.select("row_idx", "corpus").join(both, "row_idx", "left")
    return rows.select("row_idx", F.when(F.coalesce("overlap", F.lit(False)), "intersection").otherwise(F.lower(F.trim("corpus"))).alias("corpus_type"))


_SPECIAL = "SELECT DISTINCT outlet, outlet_clean FROM preprocess_final WHERE outlet IS NOT NULL AND outlet_clean IS NOT NULL"


@query(f"WITH m AS ({_SPECIAL}), one AS (SELECT outlet, min(outlet_clean) AS outlet_clean FROM m GROUP BY outlet HAVING count(*) = 1), f AS (SELECT full_name AS outlet, outlet_clean FROM outlet_reference ANTI JOIN one ON one.outlet = full_name) SELECT outlet, outlet_clean, 'recovered' AS origin FROM one UNION ALL SELECT outlet, outlet_clean, 'fallback' FROM f")
def recovered_map(t: Tables) -> DataFrame:
    """The map of an earlier output, where it is unambiguous, and a literal one for the names it lacks."""
    m = t.preprocess_final.where("outlet is not null and outlet_clean is not null").select("outlet", "outlet_clean").distinct()
    one = m.groupBy("outlet").agg(F.min("outlet_clean").alias("outlet_clean"), F.count("*").alias("n")).where("n = 1").drop("n")
    rest = t.outlet_reference.select(F.col("full_name").alias("outlet"), "outlet_clean").join(one.select("outlet"), "outlet", "left_anti")
    return one.withColumn("origin", F.lit("recovered")).unionByName(rest.withColumn("origin", F.lit("fallback")))


@query("""WITH x AS (SELECT DISTINCT * FROM annotated) SELECT article_idx, prompt_variant, run_number, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY ALL""")
def drop_duplicates(t: Tables) -> DataFrame:
    """Rows left a key once whole rows that repeat are gone."""
    return t.annotated.distinct().groupBy("article_idx", "prompt_variant", "run_number").agg(F.count("*").alias("n"))


@query(f"WITH {_PAIR}, s AS (SELECT article_idx, frame, CASE WHEN a IS NULL AND b IS NULL THEN 'both null' WHEN a IS NULL THEN 'first null' ELSE 'second null' END AS reason FROM r WHERE a IS NULL OR b IS NULL) SELECT DISTINCT article_idx, frame, reason FROM s WHERE reason NOT LIKE '%both%'")
def seen_once(t: Tables) -> DataFrame:
    """Each reason once an article and label, without those that say nothing about a rater."""
    reason = F.when(F.col("a").isNull() & F.col("b").isNull(), "both null").when(F.col("a").isNull(), "first null").otherwise("second null")
    rows = raters(t).where("a is null or b is null").select("article_idx", "frame", reason.alias("reason"))
    return rows.where(~F.col("reason").contains("both")).dropDuplicates(["article_idx", "frame", "reason"])


@query(f"WITH {_LONG} SELECT article_idx, prompt_variant, run_number, '{{' || string_agg('\"' || frame || '\":\"' || present || '\"', ',' ORDER BY frame) || '}}' AS present FROM (SELECT DISTINCT article_idx, prompt_variant, run_number, frame, present FROM l WHERE present = 'yes') GROUP BY ALL")
def sparse_map(t: Tables) -> DataFrame:
    """Only the labels that are present, as a map in one column."""
    rows = long(t).where("present = 'yes'").select("article_idx", "prompt_variant", "run_number", "frame", "present").distinct()
    entries = F.sort_array(F.collect_list(F.struct("frame", "present")))
    return rows.groupBy("article_idx", "prompt_variant", "run_number").agg(F.to_json(F.map_from_entries(entries)).alias("present"))


def _stub(body: str) -> str:
    """A stand-in for a model that answers by the number of its input's letters, and fails on some."""
    if len(body) % 7 == 3:
        raise ValueError("busy")
    return "geen object" if len(body) % 11 == 5 else f'Antwoord: {{"central": "{"Yes" if len(body) % 2 else "no"} ", "reason": "n={len(body)}"}}'


@query("""WITH c AS (SELECT row_idx, bool_or(on_topic_flag) AS on_topic FROM check_strata GROUP BY row_idx), x AS (SELECT row_idx, coalesce(on_topic, false) AS on_topic, length(title) AS n FROM c JOIN preprocess_final USING (row_idx) WHERE title IS NOT NULL)
SELECT row_idx, CASE WHEN NOT on_topic THEN false WHEN n % 7 = 3 OR n % 11 = 5 THEN NULL ELSE n % 2 = 1 END AS flag, CASE WHEN NOT on_topic THEN 'excluded before' WHEN n % 7 = 3 THEN 'ERROR: ValueError: busy' WHEN n % 11 = 5 THEN 'ERROR: no object' ELSE 'n=' || n END AS reason FROM x""")
def centrality_gate(t: Tables) -> DataFrame:
    """A second gate by a pluggable annotator; rows that the first gate excludes are not asked."""
    flags = t.check_strata.groupBy("row_idx").agg(F.bool_or("on_topic_flag").alias("on_topic"))
    rows = flags.join(t.preprocess_final.where("title is not null").select("row_idx", "title"), "row_idx")
    return gate(rows, "row_idx", "title", "on_topic", _stub, wait=0.0)


# ---- rules that data must keep: each query gives the rows that break one ----


@query(f"WITH {_LONG} SELECT corpus_type, frame, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY ALL HAVING count(present) = 0")
def audit_applicable(t: Tables) -> DataFrame:
    """Groups in which a label applies to nothing, so that its share would have no denominator."""
    return long(t).groupBy("corpus_type", "frame").agg(F.count("*").alias("n"), F.count("present").alias("k")).where("k = 0").drop("k")


@query("SELECT outlet_clean, CAST(count(*) AS BIGINT) AS n FROM annotated WHERE outlet_clean IS NOT NULL AND outlet_clean NOT IN (SELECT outlet_clean FROM outlet_reference WHERE news_brand < 'M') GROUP BY ALL")
def audit_known_domain(t: Tables) -> DataFrame:
    """Values that are not in the list of known ones (here: a part of the reference list)."""
    known = t.outlet_reference.where("news_brand < 'M'").select("outlet_clean")
    return t.annotated.where("outlet_clean is not null").groupBy("outlet_clean").agg(F.count("*").alias("n")).join(F.broadcast(known), "outlet_clean", "left_anti")


@query("SELECT outlet, CAST(count(DISTINCT outlet_clean) AS BIGINT) AS n FROM preprocess_final WHERE outlet IS NOT NULL GROUP BY outlet HAVING count(DISTINCT outlet_clean) <> 1")
def audit_constant(t: Tables) -> DataFrame:
    """Groups in which a value that should be one is not."""
    return t.preprocess_final.where("outlet is not null").groupBy("outlet").agg(F.count_distinct("outlet_clean").alias("n")).where("n != 1")


@query("SELECT * FROM (VALUES ('label', 'only left'), ('matched_keywords_all', 'only left'), ('meta', 'only left'), ('outlet', 'only left'), ('news_brand', 'only left'), ('date', 'only left'), ('title', 'only left'), ('body', 'only left'), ('word_count', 'only left'), ('ingested_at', 'only left'), ('year', 'only right'), ('published', 'only right'), ('title_keyword_count', 'only right'), ('body_keyword_count', 'only right'), ('on_topic_flag_raw', 'only right'), ('on_topic_flag', 'only right'), ('topic_central_flag', 'only right'), ('flagged_at', 'only right')) AS x(field, side)")
def audit_schema(t: Tables) -> DataFrame:
    """Columns (names with types) that only one of two tables has, which a strict union would refuse."""
    a, b = dict(t.preprocess_final.dtypes), dict(t.check_strata.dtypes)
    rows = [(n, "only left" if n in a and n not in b else "only right" if n not in a else "type") for n in sorted(a | b) if a.get(n) != b.get(n)]
    return t.spark.createDataFrame(rows, "field string, side string")


@query("SELECT corpus_type, CAST(count(*) AS BIGINT) AS expected, CAST(count(*) FILTER (NOT rep) AS BIGINT) AS actual FROM (SELECT corpus_type, row_number() OVER (PARTITION BY article_key, prompt_variant, run_number) > 1 AS rep FROM annotated) GROUP BY corpus_type HAVING count(*) <> count(*) FILTER (NOT rep)")
def audit_expected_rows(t: Tables) -> DataFrame:
    """Groups whose number of rows is not that of their keys."""
    rows = t.annotated.groupBy("corpus_type", "article_key", "prompt_variant", "run_number").agg(F.count("*").alias("n"))
    return rows.groupBy("corpus_type").agg(F.sum("n").alias("expected"), F.count("*").alias("actual")).where("expected != actual")


@query("SELECT home_place AS value, CAST(count(*) AS BIGINT) AS n FROM (SELECT left(home_place, 1) AS home_place FROM outlet_reference) GROUP BY ALL HAVING count(*) > 1")
def audit_unique_value(t: Tables) -> DataFrame:
    """Values (a colour of a chart, here a first letter) that stand for several entries."""
    return t.outlet_reference.groupBy(F.left("home_place", F.lit(1)).alias("value")).agg(F.count("*").alias("n")).where("n > 1")


@query(f"""WITH {_U}, r AS (SELECT row_idx, count(*) OVER () AS pool, count(*) OVER (PARTITION BY outlet_clean, year) AS size, row_number() OVER (PARTITION BY outlet_clean, year ORDER BY md5('42#' || row_idx), row_idx) AS n FROM u),
  a AS (SELECT row_idx FROM r ORDER BY n > least(size, greatest(1, round_even(size * 100.0 / pool, 0))), md5('43#' || row_idx), row_idx LIMIT 100)
SELECT DISTINCT row_idx FROM a WHERE row_idx IN (SELECT row_idx FROM r WHERE n <= greatest(1, round_even(0.1 * size, 0)))""")
def audit_disjoint_draws(t: Tables) -> DataFrame:
    """Rows of one draw that another one holds too."""
    other = proportional(units(t), ["outlet_clean", "year"], "row_idx", 100).select("row_idx")
    return other.join(_sampled(t).select("row_idx"), "row_idx", "left_semi").distinct()


@query(f"SELECT topic, n FROM (SELECT {sql_collapse('meta')} AS topic, CAST(count(*) AS BIGINT) AS n FROM preprocess_final WHERE meta IS NOT NULL GROUP BY 1) ORDER BY n DESC, topic")
def sorted_groups(t: Tables) -> DataFrame:
    """Topics in the order of their size, the largest first, equal ones by name."""
    rows = t.preprocess_final.where("meta is not null").groupBy(text.collapse_blanks(F.col("meta")).alias("topic")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "topic")


@query(f"WITH k AS (SELECT frame, kappa FROM (VALUES ('conflict', 0.71::DOUBLE), ('economic', 0.64), ('human-interest', 0.52), ('agency', -0.03)) AS x(frame, kappa)) SELECT l.frame, kappa, CAST(count(*) AS BIGINT) AS n FROM (WITH {_LONG} SELECT * FROM l) l LEFT JOIN k ON regexp_replace(k.frame, '[-‐-―]', '_', 'g') = l.frame GROUP BY ALL")
def reliability_lookup(t: Tables) -> DataFrame:
    """A published figure looked up for each label, whose names are written with other dashes."""
    k = t.spark.createDataFrame([("conflict", 0.71), ("economic", 0.64), ("human-interest", 0.52), ("agency", -0.03)], "name string, kappa double")
    k = k.select(F.regexp_replace(text.dashes(F.col("name")), "-", "_").alias("frame"), "kappa")
    return long(t).groupBy("frame").agg(F.count("*").alias("n")).join(F.broadcast(k), "frame", "left").select("frame", "kappa", "n")


_PAIRS = [f"{s}_present" for s, _ in LABELS]


@query(f"""WITH x AS (SELECT DISTINCT article_idx, {", ".join(_PAIRS)} FROM annotated), y AS (SELECT article_idx // 2 AS pair, article_idx % 2 AS side, {", ".join(f"{sql_yes_no(c)} AS {c}" for c in _PAIRS)} FROM x)
SELECT a.pair, CAST({" + ".join(f"CAST(a.{c} IS NOT DISTINCT FROM b.{c} AS INTEGER)" for c in _PAIRS)} AS INTEGER) AS equal FROM y a JOIN y b ON a.pair = b.pair AND a.side = 0 AND b.side = 1""")
def row_pair_compare(t: Tables) -> DataFrame:
    """Two rows under one key beside one another: on how many of their labels they agree, nulls being equal."""
    rows = t.annotated.select("article_idx", *_PAIRS).distinct()
    each = rows.select(F.floor(F.col("article_idx") / 2).alias("pair"), (F.col("article_idx") % 2).alias("side"), F.array(*[text.yes_no(F.col(c)) for c in _PAIRS]).alias("v"))
    left, right = (each.where(F.col("side") == s).select("pair", F.col("v").alias(n)) for s, n in ((0, "a"), (1, "b")))
    same = F.aggregate(F.arrays_zip("a", "b"), F.lit(0), lambda n, z: n + z["a"].eqNullSafe(z["b"]).cast("int"))
    return left.join(right, "pair").select("pair", same.alias("equal"))


#: Words of places of government and of measuring, for the two rules below.
_OFFICES, _FIGURES = r"(?i)\b(gemeente|provincie|waterschap|minister|raad)\b", r"(?i)\b(procent|cijfers|aantal|rapport|monitor)\b"
_HITS = lambda rx: f"list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(body, ''), '{rx}'), lambda x: lower(x))))"


@query(f"""SELECT row_idx, concat_ws('; ', CASE WHEN len({_HITS(_OFFICES)}) >= 2 THEN 'offices: ' || array_to_string({_HITS(_OFFICES)}[1:4], ', ') END, CASE WHEN len({_HITS(_FIGURES)}) >= 3 THEN 'figures: ' || array_to_string({_HITS(_FIGURES)}[1:4], ', ') END) AS why
FROM preprocess_final WHERE len({_HITS(_OFFICES)}) >= 2 OR len({_HITS(_FIGURES)}) >= 3""")
def recheck_flags(t: Tables) -> DataFrame:
    """Rows to look at again: rules on the number of distinct matches of a pattern, with the first of them as the reason."""
    rows = t.preprocess_final.select("row_idx", text.found_list(F.col("body"), _OFFICES).alias("a"), text.found_list(F.col("body"), _FIGURES).alias("b"))
    shown = lambda c, least, name: F.when(F.size(c) >= least, F.concat(F.lit(f"{name}: "), F.array_join(F.slice(c, 1, 4), ", ")))
    return rows.where((F.size("a") >= 2) | (F.size("b") >= 3)).select("row_idx", F.concat_ws("; ", shown("a", 2, "offices"), shown("b", 3, "figures")).alias("why"))


@query("SELECT row_idx AS id FROM check_strata UNION SELECT article_idx FROM annotated")
def union_distinct(t: Tables) -> DataFrame:
    """The ids of either table, each once."""
    return t.check_strata.select(F.col("row_idx").alias("id")).union(t.annotated.select("article_idx")).distinct()


@query(f"WITH {_LONG} SELECT year, frame, CAST(count(present) AS BIGINT) AS n_applicable, CAST(count(*) FILTER (present = 'yes') AS BIGINT) AS n_present FROM l WHERE corpus = 'migration' AND outlet_clean = 'Rietgorzer' AND year IS NOT NULL GROUP BY ALL")
def outlet_series(t: Tables) -> DataFrame:
    """The yearly series of one selected corpus and outlet."""
    rows = long(t).where("corpus = 'migration' and outlet_clean = 'Rietgorzer' and year is not null")
    return rows.groupBy("year", "frame").agg(F.count("present").alias("n_applicable"), F.count_if(F.col("present") == "yes").alias("n_present"))


@query(f"""WITH {_LEDGER}, x AS (SELECT chunk, owner, status, requests, requests - k.completed - coalesce(mk.completed, 0) AS short, coalesce(parts, 0) AS parts FROM k LEFT JOIN mk USING (chunk))
SELECT chunk, owner, CASE WHEN status = 'P' THEN 'chunk ' || chunk || ' [P]' ELSE 'chunk ' || chunk || ' finished but ' || short || ' of ' || requests || ' requests are missing' || CASE WHEN parts > 0 THEN ' (after ' || parts || ' makeups)' ELSE '' END END AS problem FROM x WHERE status = 'P' OR (status = 'F' AND short > 0)""")
def ledger_problems(t: Tables) -> DataFrame:
    """Chunks that should stop a run: those in a bad state, and finished ones that lack requests."""
    done = F.size(F.filter("makeups", lambda m: m["status"] == "completed"))
    rows = ledger(t).withColumn("short", F.col("requests") - F.col("completed") - _made_up()).withColumn("parts", done)
    missing = F.concat(F.format_string("chunk %d finished but %d of %d requests are missing", "chunk", "short", "requests"), F.when(F.col("parts") > 0, F.format_string(" (after %d makeups)", "parts")).otherwise(""))
    problem = F.when(F.col("status") == "P", F.format_string("chunk %d [P]", "chunk")).when((F.col("status") == "F") & (F.col("short") > 0), missing)
    return rows.select("chunk", "owner", problem.alias("problem")).where("problem is not null")


#: What a run may cost, in weighted tokens, and the part of it at which it stops.
BUDGET, STOP_AT = 2_000_000, 0.9


@query(f"WITH c AS (SELECT corpus_type, CAST(sum({WEIGHT_IN} * prompt_tokens + {WEIGHT_OUT} * coalesce(completion_tokens, {FALLBACK_OUT})) AS DOUBLE) AS projected FROM token_usage GROUP BY ALL) SELECT corpus_type, projected FROM c WHERE projected > {STOP_AT} * {BUDGET}")
def audit_budget(t: Tables) -> DataFrame:
    """Runs whose projected cost comes too near to the budget."""
    cost = WEIGHT_IN * F.col("prompt_tokens") + WEIGHT_OUT * F.coalesce("completion_tokens", F.lit(FALLBACK_OUT))
    return t.token_usage.groupBy("corpus_type").agg(F.sum(cost).alias("projected")).where(F.col("projected") > STOP_AT * BUDGET)


@query("SELECT DISTINCT article_idx FROM annotated WHERE article_idx NOT IN (SELECT article_idx FROM token_usage WHERE completion_tokens IS NOT NULL)")
def audit_wanted(t: Tables) -> DataFrame:
    """Ids that were asked for and not found."""
    found = t.token_usage.where("completion_tokens is not null").select("article_idx")
    return t.annotated.select("article_idx").distinct().join(found, "article_idx", "left_anti")


@query("""WITH p AS (SELECT CAST(row_number() OVER (ORDER BY outlet_clean) AS INTEGER) AS panel, '<div id="chart"><script>const DATA = ["' || outlet_clean || '"];</script></div>' AS html FROM outlet_reference)
SELECT panel, replace(html, 'id="chart"', 'id="p' || panel || '-chart"') AS html, true AS same_data FROM p""")
def assembled_page(t: Tables) -> DataFrame:
    """Panels of one page, whose element ids are told apart and whose data must stay as they are."""
    page = F.format_string('<div id="chart"><script>const DATA = ["%s"];</script></div>', "outlet_clean")
    p = t.outlet_reference.select((F.row_number().over(W.orderBy("outlet_clean"))).alias("panel"), page.alias("html"))
    own = F.regexp_replace("html", F.lit(r'\bid="(\w+)"'), F.concat(F.lit('id="p'), "panel", F.lit('-$1"')))
    data = lambda c: F.regexp_extract(c, r"const DATA = (.*?);</script>", 1)
    return p.select("panel", own.alias("html"), (data(own) == data("html")).alias("same_data"))


@query(f"WITH {_LAYERS}, b AS (SELECT article_idx, frame, coalesce(derived, merged) AS present FROM m) PIVOT b ON frame IN ({', '.join(repr(s) for s, _ in LABELS)}) USING first(present) GROUP BY article_idx")
def snapshot_grid(t: Tables) -> DataFrame:
    """The merged snapshot with all its layers, one wide row an article."""
    rows = layers(t).select("article_idx", "frame", F.coalesce("derived", "merged").alias("present"))
    return rows.groupBy("article_idx").pivot("frame", [s for s, _ in LABELS]).agg(F.first("present"))
