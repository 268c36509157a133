"""Model answers: from response lines to labels, with the rules that derive them.

The answers are made from the token table by rules on a hash, so that SQL can state what must
come out without parsing anything: some hold prose or broken braces before the object, some
two objects, some nest the labels deep, and some have no labels or no object at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import json_text, stats
from loomline.operators.labels import LABELS, label_table, long_labels, pass_table
from loomline.plans.registry import Tables, query, sql_yes_no
from loomline.runtime import by_shuffle

#: Fields that a label may have beside presence and indicators.
EXTRA = {"othering": "othering_type", "agency": "agency_type"}
# The kinds of actor that a label may name.
AGENCY_TYPES = ("individual", "collective", "state", "corporations", "none")

_SLUGS = {p: [s for s, q in LABELS if q == p] for p in ("pass1", "pass2", "pass3", "pass4")}


def _digit(i: int | str) -> str:
    return f"substr(d, {i}, 1)"


def _indicator(f: int | str, j: int) -> str:
    return f"CASE WHEN {_digit(f'5 * {f} + {j}')} < '6' THEN 'yes' ELSE 'no' END"


def _stated(f: int | str) -> str:
    c = _digit(f"5 * {f} + 5")
    return f"CASE WHEN {c} < '2' THEN 'Yes ' WHEN {c} < '8' THEN 'yes' ELSE 'no' END"


_AGENCY = f"CASE WHEN {_digit(27)} < '4' THEN 'individual' WHEN {_digit(27)} < '7' THEN 'Collective' WHEN {_digit(27)} < 'a' THEN 'state' WHEN {_digit(27)} < 'c' THEN 'corporations' WHEN {_digit(27)} < 'e' THEN 'none' WHEN {_digit(27)} = 'e' THEN 'structural' END"
_OTHERING = f"CASE WHEN {_digit(28)} < '8' THEN 'cultural' END"


def _marks(f: int | str) -> str:
    """The indicators as a JSON object; three of them where digit 26 is f."""
    parts = [f"'\"q{j}\": \"' || {_indicator(f, j)} || '\"'" for j in (1, 2, 3)]
    return "'{' || " + " || ', ' || ".join(parts) + f" || CASE WHEN {_digit(26)} = 'f' THEN '' ELSE ', \"q4\": \"' || {_indicator(f, 4)} || '\"' END || '}}'"


#: The labels of a pass as a JSON object, over ``slugs`` and their places f.
_OBJECT = f"""'"' || slug || '": {{"present": "' || {_stated("f")} || '", "indicators": ' || {_marks("f")}
  || CASE WHEN slug = 'othering' THEN coalesce(', "othering_type": "' || ({_OTHERING}) || '"', '') WHEN slug = 'agency' THEN coalesce(', "agency_type": "' || ({_AGENCY}) || '"', '') ELSE '' END || '}}'"""
_FRAMES = f"'{{' || array_join(transform(slugs, (slug, f) -> {_OBJECT}), ', ') || '}}'"
_SHAPE = _digit(32)
_CONTENT = f"""CASE {_SHAPE} WHEN '0' THEN 'geen antwoord' WHEN '1' THEN 'Zeker: {{"result": {{"deep": [{{"frames": ' || f || '}}]}}}} einde' WHEN '2' THEN '{{"frames": {{"old": {{}}}}}} en daarna {{"frames": ' || f || '}}'
  WHEN '3' THEN 'kapot {{"frames": [ en dan {{"frames": ' || f || ', "note": "een }} in tekst"}}' WHEN '4' THEN '{{"labels": ' || f || '}}' WHEN '5' THEN '{{"items": [1, {{"frames": ' || f || '}}]}}' ELSE '{{"frames": ' || f || '}}' END"""
_STATE = f"CASE {_SHAPE} WHEN '0' THEN 'no_object' WHEN '4' THEN 'no_frames' WHEN '6' THEN 'missing' WHEN '7' THEN 'error' ELSE 'ok' END"

_DISTINCT = "r AS (SELECT *, md5(article_idx || '#' || pass_name) AS d FROM (SELECT DISTINCT article_idx, pass_name FROM token_usage))"
_EACH = " UNION ALL ".join(
    f"SELECT article_idx, pass_name, '{s}' AS frame, {_stated(f)} AS stated, {_marks(f)} AS indicators, {_digit(26)} = 'f' AS three, ({_indicator(f, 1)}) AS i1, ({_indicator(f, 2)}) AS i2, ({_indicator(f, 3)}) AS i3, CASE WHEN {_digit(26)} <> 'f' THEN ({_indicator(f, 4)}) END AS i4, {_AGENCY if s == 'agency' else 'CAST(NULL AS VARCHAR)'} AS agency_type, {_OTHERING if s == 'othering' else 'CAST(NULL AS VARCHAR)'} AS othering_type FROM r WHERE pass_name = '{p}' AND {_STATE} = 'ok'"
    for p, slugs in _SLUGS.items() for f, s in enumerate(slugs)
)
_DERIVED = f"""{_DISTINCT}, e AS ({_EACH}), v AS (SELECT *, CASE WHEN frame = 'othering' AND NOT three THEN CASE WHEN i1 = 'yes' AND 'yes' IN (i2, i3, i4) THEN 'yes' ELSE 'no' END
  WHEN frame = 'agency' AND lower(agency_type) IN ('individual', 'collective', 'state', 'corporations', 'none') THEN CASE WHEN lower(agency_type) = 'none' THEN 'no' ELSE 'yes' END END AS derived FROM e)"""


def response_lines(t: Tables) -> DataFrame:
    """JSON lines as a service returns them: an id, and a response or an error; some requests have no line."""
    rows = t.token_usage.select("article_idx", "pass_name").distinct().withColumn("d", F.md5(F.concat("article_idx", F.lit("#"), "pass_name")))
    slugs = F.create_map(*[x for p, names in _SLUGS.items() for x in (F.lit(p), F.array(*map(F.lit, names)))])[F.col("pass_name")]
    rows = rows.withColumn("slugs", slugs).withColumn("f", F.expr(_FRAMES)).where(f"{_SHAPE} != '6'")
    message = F.struct(F.lit("assistant").alias("role"), F.expr(_CONTENT).alias("content"))
    body = F.struct(F.struct(F.array(F.struct(F.lit(0).alias("index"), message.alias("message"))).alias("choices")).alias("body"))
    failed = F.expr(f"{_SHAPE} = '7'")
    line = F.struct(F.concat_ws("-", F.lit("x"), "article_idx", "pass_name").alias("custom_id"), F.when(failed, F.lit("rate limit")).alias("error"), F.when(~failed, body).alias("response"))
    return rows.select(F.to_json(line).alias("line"))


def results(t: Tables) -> DataFrame:
    """(article_idx, pass_name, state, labels) of every request: its line is looked up, and its content searched for labels."""
    lines = response_lines(t).select(F.get_json_object("line", "$.custom_id").alias("custom_id"), F.get_json_object("line", "$.error").alias("error"), F.get_json_object("line", "$.response.body.choices[0].message.content").alias("content"))
    parts = F.split("custom_id", "-", 3)
    lines = lines.select(F.get(parts, F.lit(1)).try_cast("long").alias("article_idx"), F.get(parts, F.lit(2)).alias("pass_name"), "error", json_text.outermost_json("content").alias("object"))
    lines = lines.withColumn("labels", json_text.labels_list("object"))
    found = F.when(F.col("error").isNotNull(), "error").when(F.col("object").isNull(), "no_object").when(F.col("labels").isNull(), "no_frames").otherwise("ok")
    lines = lines.select("article_idx", "pass_name", found.alias("state"), "labels")
    wanted = t.token_usage.select("article_idx", "pass_name").distinct()
    return wanted.join(by_shuffle(lines), ["article_idx", "pass_name"], "left").withColumn("state", F.coalesce("state", F.lit("missing")))


@query(f"WITH {_DISTINCT} SELECT article_idx, pass_name, {_STATE} AS state FROM r")
def response_state(t: Tables) -> DataFrame:
    """What became of each request."""
    return results(t).select("article_idx", "pass_name", "state")


@query(f"WITH {_DERIVED} SELECT article_idx, pass_name, CAST(count(*) AS BIGINT) AS n_frames, string_agg(frame, '; ' ORDER BY frame) AS frames FROM e GROUP BY ALL")
def find_nested_frames(t: Tables) -> DataFrame:
    """The labels of each answer, at whatever depth they stand."""
    rows = results(t).where("state = 'ok'")
    return rows.select("article_idx", "pass_name", F.size("labels").cast("long").alias("n_frames"), F.array_join(F.array_sort(F.transform("labels", lambda x: x["frame"])), "; ").alias("frames"))


def labelled(t: Tables) -> DataFrame:
    """One row a label of a parsed answer: ``stated``, ``present`` by rule where there is one, and whether that overrides."""
    wanted = F.broadcast(label_table(t.spark))
    rows = results(t).where("state = 'ok'").select("article_idx", "pass_name", F.explode("labels").alias("x")).select("article_idx", "pass_name", "x.*").join(wanted, ["frame", "pass_name"], "left_semi")
    yes = lambda c: F.lower(F.trim(c)) == "yes"
    marks = F.transform("marks", lambda m: yes(m["answer"]))
    othering = F.when((F.col("frame") == "othering") & (F.size("marks") == 4), F.get(marks, F.lit(0)) & F.exists(F.slice(marks, 2, 3), lambda b: b))
    kind = F.lower(F.trim(F.col("extra")["agency_type"]))
    agency = F.when((F.col("frame") == "agency") & kind.isin(*AGENCY_TYPES), kind != "none")
    rule = F.coalesce(othering, agency)
    rows = rows.withColumn("derived", F.when(rule, "yes").when(~rule, "no"))
    overridden = F.coalesce(F.lower(F.trim("stated")) != F.col("derived"), F.lit(False))
    return rows.withColumn("present", F.coalesce("derived", "stated")).withColumn("overridden", overridden)


@query(f"WITH {_DERIVED} SELECT article_idx, frame, stated, coalesce(derived, stated) AS present, coalesce(lower(trim(stated)) <> derived, false) AS overridden FROM v WHERE frame IN ('othering', 'agency')")
def derive_presence(t: Tables) -> DataFrame:
    """Two labels follow from their indicators or their type; an unexpected shape keeps what the model stated."""
    return labelled(t).where("frame in ('othering', 'agency')").select("article_idx", "frame", "stated", "present", "overridden")


@query(f"""WITH {_DERIVED} SELECT article_idx, pass_name, frame, coalesce(derived, stated) AS present, CASE WHEN lower(trim(stated)) <> derived THEN stated END AS present_model_stated, indicators, agency_type, othering_type FROM v""")
def flatten_response(t: Tables) -> DataFrame:
    """The fields of each label; what the model stated only where a rule overrides it."""
    extra = [F.col("extra")[c].alias(c) for c in EXTRA.values()]
    return labelled(t).select("article_idx", "pass_name", "frame", "present", F.when(F.col("overridden"), F.col("stated")).alias("present_model_stated"), "indicators", *extra)


_INDICATOR_LINES = "'[' || i1 || ']  q1' || chr(10) || '[' || i2 || ']  q2' || chr(10) || '[' || i3 || ']  q3' || coalesce(chr(10) || '[' || i4 || ']  q4', '')"


@query(f"WITH {_DERIVED} SELECT article_idx, frame, {_INDICATOR_LINES} AS lines FROM v")
def indicator_lines(t: Tables) -> DataFrame:
    """Indicators for reading, a line each in their order; the raw text where it is no object."""
    shown = F.array_join(F.transform("marks", lambda m: F.concat(F.lit("["), m["answer"], F.lit("]  "), m["question"])), "\n")
    return labelled(t).select("article_idx", "frame", F.when(F.size("marks") > 0, shown).otherwise(F.col("indicators")).alias("lines"))


_PASSES = "p(corpus_type, pass_name) AS (VALUES ('climate','pass1'),('climate','pass3'),('climate','pass4'),('migration','pass1'),('migration','pass2'),('migration','pass4'),('intersection','pass1'),('intersection','pass2'),('intersection','pass3'),('intersection','pass4'))"
_GATED = f"""{_PASSES}, g AS (SELECT row_idx, coalesce(bool_or(on_topic_flag), true) AS on_topic, coalesce(bool_or(topic_central_flag), true) AS central FROM check_strata GROUP BY row_idx),
  a AS (SELECT article_idx, corpus_type, coalesce(on_topic, true) AS on_topic, coalesce(central, true) AS central FROM (SELECT DISTINCT article_idx, corpus_type FROM annotated) LEFT JOIN g ON row_idx = article_idx)"""
_REASON = f"""{_DISTINCT}, {_GATED}, s AS (SELECT article_idx, corpus_type, on_topic, central, count(*) FILTER (state = 'no_frames') AS no_frames, count(*) FILTER (state IS DISTINCT FROM 'ok') AS bad
  FROM a JOIN p USING (corpus_type) LEFT JOIN (SELECT article_idx, pass_name, {_STATE} AS state FROM r) x USING (article_idx, pass_name) GROUP BY ALL),
  q AS (SELECT article_idx, corpus_type, CASE WHEN NOT on_topic THEN 'off_topic_keyword_flag' WHEN NOT central THEN 'not_topic_central' WHEN no_frames > 0 THEN 'frames_key_not_found' WHEN bad > 0 THEN 'batch_parse_error' END AS reason FROM s)"""


def reasons(t: Tables) -> DataFrame:
    """(article_idx, corpus_type, reason): why an article has no labels, null if it has them. An unknown flag counts as true."""
    flags = t.check_strata.groupBy(F.col("row_idx").alias("article_idx")).agg(F.bool_or("on_topic_flag").alias("on_topic"), F.bool_or("topic_central_flag").alias("central"))
    rows = t.annotated.select("article_idx", "corpus_type").distinct().join(by_shuffle(flags), "article_idx", "left")
    rows = rows.join(F.broadcast(pass_table(t.spark)), "corpus_type").join(by_shuffle(results(t).drop("labels")), ["article_idx", "pass_name"], "left")
    rows = rows.groupBy("article_idx", "corpus_type", "on_topic", "central").agg(F.count_if(F.col("state") == "no_frames").alias("no_frames"), F.count_if(~F.col("state").eqNullSafe("ok")).alias("bad"))
    reason = F.when(~F.coalesce("on_topic", F.lit(True)), "off_topic_keyword_flag").when(~F.coalesce("central", F.lit(True)), "not_topic_central").when(F.col("no_frames") > 0, "frames_key_not_found").when(F.col("bad") > 0, "batch_parse_error")
    return rows.select("article_idx", "corpus_type", reason.alias("reason"))


@query(f"WITH {_REASON} SELECT article_idx, corpus_type, reason FROM q")
def skip_reason(t: Tables) -> DataFrame:
    """The first reason that holds: off topic, not central, an answer without labels, an answer missing or unreadable."""
    return reasons(t)


@query(f"""WITH {_REASON}, {_DERIVED.removeprefix(_DISTINCT + ", ")} SELECT q.article_idx, q.corpus_type, reason, {", ".join(f"max(coalesce(derived, stated)) FILTER (frame = '{s}' AND reason IS DISTINCT FROM 'off_topic_keyword_flag' AND reason IS DISTINCT FROM 'not_topic_central' AND p.pass_name IS NOT NULL) AS {s}_present" for s, _ in LABELS)}
  FROM q LEFT JOIN v ON v.article_idx = q.article_idx LEFT JOIN p ON p.corpus_type = q.corpus_type AND p.pass_name = v.pass_name GROUP BY ALL""")
def annotated_rows(t: Tables) -> DataFrame:
    """One wide row an article: its labels, null for passes that do not apply or failed, and the reason if it was skipped."""
    rows = labelled(t).select("article_idx", "pass_name", "frame", "present")
    q = reasons(t)
    open_ = q.where("reason is null or reason not in ('off_topic_keyword_flag', 'not_topic_central')")
    rows = open_.join(by_shuffle(rows), "article_idx").join(F.broadcast(pass_table(t.spark)), ["corpus_type", "pass_name"], "left_semi")
    wide = rows.groupBy("article_idx", "corpus_type").agg(*[F.max(F.when(F.col("frame") == s, F.col("present"))).alias(f"{s}_present") for s, _ in LABELS])
    return q.join(by_shuffle(wide), ["article_idx", "corpus_type"], "left")


_HUMAN = f"""h AS (SELECT article_idx, replace(col, '_present', '') AS frame, max({sql_yes_no("raw")}) AS human FROM (SELECT * FROM annotated WHERE skipped_reason IS NULL) UNPIVOT INCLUDE NULLS (raw FOR col IN ({", ".join(f"{s}_present" for s, _ in LABELS)})) GROUP BY ALL)"""


@query(f"""WITH {_DERIVED}, {_HUMAN}, k AS (SELECT frame, human, CAST(i1 = 'yes' AS INTEGER) + CAST(i2 = 'yes' AS INTEGER) + CAST(i3 = 'yes' AS INTEGER) + CAST(coalesce(i4, 'no') = 'yes' AS INTEGER) AS k FROM v JOIN h USING (article_idx, frame) WHERE human IS NOT NULL AND lower(trim(coalesce(derived, stated))) IN ('yes', 'no')),
  c AS (SELECT coalesce(frame, 'POOLED') AS frame, m AS threshold, count(*) AS n, count(*) FILTER (human = 'yes') AS a, count(*) FILTER (k >= m) AS b, count(*) FILTER ((k >= m) = (human = 'yes')) AS same FROM k, range(1, 4) AS x(m) GROUP BY GROUPING SETS ((frame, m), (m))),
  s AS (SELECT *, same / n AS po, a / n * (b / n) + (1 - a / n) * (1 - b / n) AS pe FROM c)
SELECT frame, CAST(threshold AS INTEGER) AS threshold, n, round(po, 6) AS raw, CASE WHEN abs(1 - pe) > 1e-8 + 1e-5 THEN round((po - pe) / (1 - pe), 6) END AS kappa FROM s""")
def threshold_counterfactual(t: Tables) -> DataFrame:
    """Agreement of a label with at least 1, 2 or 3 of its indicators, for each label and over all; answers without indicators do not count."""
    human = long_labels(t.annotated.where("skipped_reason is null"), ["article_idx"]).groupBy("article_idx", "frame").agg(F.max("present").alias("human"))
    model = labelled(t).where((F.size("marks") > 0) & F.lower(F.trim("present")).isin("yes", "no"))
    model = model.select("article_idx", "frame", F.size(F.filter("marks", lambda m: F.lower(F.trim(m["answer"])) == "yes")).alias("k"))
    rows = human.where("human is not null").join(model, ["article_idx", "frame"]).groupBy("frame", "human", "k").agg(F.count("*").alias("c"))
    rows = rows.withColumn("threshold", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    a, b = F.col("human") == "yes", F.col("k") >= F.col("threshold")
    of = lambda c, name: F.sum(F.when(c, F.col("c")).otherwise(0)).alias(name)
    sets = rows.groupingSets([["frame", "threshold"], ["threshold"]], "frame", "threshold").agg(F.sum("c").alias("n"), of(a & b, "yy"), of(~a & ~b, "nn"), of(a, "a"), of(b, "b"))
    s = stats.agreement(*(F.col(c) for c in ("n", "yy", "nn", "a", "b")))
    return sets.select(F.coalesce("frame", F.lit("POOLED")).alias("frame"), "threshold", "n", F.round(s["raw_agreement"], 6).alias("raw"), F.round(s["kappa"], 6).alias("kappa"))
