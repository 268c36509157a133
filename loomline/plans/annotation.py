"""Requests, answers and ledgers of an annotation run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import json_text
from loomline.operators.labels import pass_table
from loomline.operators.order import greedy_chunks, running_total
from loomline.plans.registry import Tables, query
from loomline.streaming.replay import hourly_events

_PASSES = "p(corpus_type, pass_name) AS (VALUES ('climate','pass1'),('climate','pass3'),('climate','pass4'),('migration','pass1'),('migration','pass2'),('migration','pass4'),('intersection','pass1'),('intersection','pass2'),('intersection','pass3'),('intersection','pass4'))"
_ELIGIBLE = "a AS (SELECT DISTINCT article_idx, corpus, corpus_type FROM annotated WHERE skipped_reason IS NULL)"


def requests(t: Tables) -> DataFrame:
    """One row an eligible article and pass that applies to it."""
    a = t.annotated.where("skipped_reason is null").select("article_idx", "corpus", "corpus_type").distinct()
    rows = a.join(F.broadcast(pass_table(t.spark)), "corpus_type")
    return rows.withColumn("custom_id", F.concat_ws("-", "corpus", "article_idx", "pass_name"))


@query(f"WITH {_PASSES}, {_ELIGIBLE} SELECT corpus_type, article_idx, corpus, pass_name, corpus || '-' || article_idx || '-' || pass_name AS custom_id FROM a JOIN p USING (corpus_type)")
def pass_expansion(t: Tables) -> DataFrame:
    return requests(t)


@query(f"WITH {_PASSES}, {_ELIGIBLE} SELECT corpus, article_idx, pass_name FROM a JOIN p USING (corpus_type)")
def custom_id_roundtrip(t: Tables) -> DataFrame:
    """An id taken apart again: its first part, its number, and all the rest."""
    parts = F.split("custom_id", "-")
    return requests(t).select(parts[0].alias("corpus"), F.try_element_at(parts, F.lit(2)).try_cast("long").alias("article_idx"), F.array_join(F.slice(parts, 3, 100), "-").alias("pass_name"))


#: The text of a request; its fields are the pass, the place of the article and the head of its title.
PROMPT = "Pass %s\nArticle %d\nTitle: %s\nAnswer with one JSON object."
_HEAD = "coalesce(left(regexp_replace(title, '[\x00-\x1F\"\\\\]', ' ', 'g'), 40), '')"
_CONTENT = f"'Pass ' || pass_name || chr(10) || 'Article ' || article_idx || chr(10) || 'Title: ' || {_HEAD} || chr(10) || 'Answer with one JSON object.'"
_REQUESTS = f"{_PASSES}, {_ELIGIBLE}, q AS (SELECT a.corpus, pass_name, a.corpus || '-' || article_idx || '-' || pass_name AS custom_id, {_CONTENT} AS content FROM a JOIN p USING (corpus_type) JOIN preprocess_final ON row_idx = article_idx)"
_LINE = """'{"custom_id":"' || custom_id || '","method":"POST","body":{"temperature":0.0,"max_tokens":1000,"messages":[{"role":"user","content":"' || replace(content, chr(10), '\\n') || '"}]}}'"""


def prompts(t: Tables) -> DataFrame:
    """(corpus, pass_name, custom_id, content) of every request."""
    head = F.coalesce(F.left(F.regexp_replace("title", r'[\x00-\x1F"\\]', " "), F.lit(40)), F.lit(""))
    titles = t.preprocess_final.select(F.col("row_idx").alias("article_idx"), head.alias("head"))
    text = F.format_string(PROMPT, "pass_name", "article_idx", "head")
    return requests(t).join(titles, "article_idx").select("corpus", "pass_name", "custom_id", text.alias("content"))


@query(f"WITH {_REQUESTS} SELECT custom_id, {_LINE} AS line FROM q")
def request_generation(t: Tables) -> DataFrame:
    """Requests as JSON lines, the text made from a template."""
    message = F.struct(F.lit("user").alias("role"), "content")
    body = F.struct(F.lit(0.0).alias("temperature"), F.lit(1000).alias("max_tokens"), F.array(message).alias("messages"))
    return prompts(t).select("custom_id", F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), body.alias("body"))).alias("line"))


#: Requests and bytes of a file, at most.
MOST_REQUESTS, MOST_BYTES = 1_000, 500_000


@query(f"WITH {_REQUESTS} SELECT corpus, CAST(count(*) AS BIGINT) AS n, CAST(sum(strlen({_LINE}) + 1) AS BIGINT) AS bytes, count(*) > {MOST_REQUESTS} OR sum(strlen({_LINE}) + 1) > {MOST_BYTES} AS beyond FROM q GROUP BY corpus")
def request_limits(t: Tables) -> DataFrame:
    """Requests and bytes of each file, and whether it is beyond a limit."""
    rows = request_generation(t).select(F.substring_index("custom_id", "-", 1).alias("corpus"), (F.octet_length("line") + 1).alias("b"))
    return rows.groupBy("corpus").agg(F.count("*").alias("n"), F.sum("b").alias("bytes")).withColumn("beyond", (F.col("n") > MOST_REQUESTS) | (F.col("bytes") > MOST_BYTES))


def estimated_tokens(text: F.Column) -> F.Column:
    """Tokens of a message by the length of its text, with what each message takes beside; a tokenizer may stand in its place."""
    return (F.ceil(F.length(text) / 4) + 8).cast("long")


@query(f"WITH {_REQUESTS} SELECT custom_id, CAST(ceil(length(content) / 4) + 8 AS BIGINT) AS tokens FROM q")
def request_tokens(t: Tables, count=estimated_tokens) -> DataFrame:
    """Tokens of each request, by any function of its text."""
    return prompts(t).select("custom_id", count(F.col("content")).alias("tokens"))


#: Tokens of a chunk: four fifths of what a queue of this size takes.
QUEUE_TOKENS = 25_000
CHUNK_TOKENS = int(QUEUE_TOKENS * 0.80)
_USE = "u AS (SELECT DISTINCT article_idx, corpus_type, pass_name, prompt_tokens, completion_tokens FROM token_usage), o AS (SELECT corpus_type, article_idx, CAST(sum(prompt_tokens) AS BIGINT) AS tokens FROM u GROUP BY ALL)"


def loads(t: Tables) -> DataFrame:
    u = t.token_usage.select("article_idx", "corpus_type", "pass_name", "prompt_tokens", "completion_tokens").distinct()
    return u.groupBy("corpus_type", "article_idx").agg(F.sum("prompt_tokens").alias("tokens"))


@query(f"""WITH RECURSIVE {_USE}, n AS (SELECT *, row_number() OVER (PARTITION BY corpus_type ORDER BY article_idx) AS k FROM o),
  f AS (SELECT corpus_type, k, article_idx, tokens, tokens AS total, 0 AS chunk FROM n WHERE k = 1
    UNION ALL SELECT n.corpus_type, n.k, n.article_idx, n.tokens, CASE WHEN f.total > 0 AND f.total + n.tokens > {CHUNK_TOKENS} THEN n.tokens ELSE f.total + n.tokens END, CASE WHEN f.total > 0 AND f.total + n.tokens > {CHUNK_TOKENS} THEN f.chunk + 1 ELSE f.chunk END
    FROM f JOIN n ON n.corpus_type = f.corpus_type AND n.k = f.k + 1)
SELECT corpus_type, CAST(chunk AS INTEGER) AS chunk, min(article_idx) AS first_idx, max(article_idx) AS last_idx, CAST(count(*) AS BIGINT) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM f GROUP BY ALL""")
def chunk_plan(t: Tables) -> DataFrame:
    """Contiguous chunks of at most ``CHUNK_TOKENS``, one fold over each corpus type."""
    rows = greedy_chunks(loads(t), ["corpus_type"], "article_idx", "tokens", CHUNK_TOKENS)
    return rows.groupBy("corpus_type", "chunk").agg(F.min("article_idx").alias("first_idx"), F.max("article_idx").alias("last_idx"), F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query(f"WITH {_USE} SELECT corpus_type, article_idx, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(tokens) OVER (PARTITION BY corpus_type ORDER BY article_idx) AS used FROM o) WHERE used <= 150000")
def capacity_admission(t: Tables) -> DataFrame:
    """Items in order until the first that would exceed the capacity."""
    return running_total(loads(t), ["corpus_type"], "article_idx", F.col("tokens"), "used").where("used <= 150000").select("corpus_type", "article_idx", "used")


@query("""SELECT pass_name, CAST(count(*) AS BIGINT) AS calls, round(avg(prompt_tokens), 4) AS mean_in, round(avg(completion_tokens), 4) AS mean_out, CAST(sum(prompt_tokens) AS BIGINT) AS tokens_in, CAST(sum(completion_tokens) AS BIGINT) AS tokens_out FROM token_usage GROUP BY pass_name""")
def token_means(t: Tables) -> DataFrame:
    return t.token_usage.groupBy("pass_name").agg(F.count("*").alias("calls"), F.round(F.avg("prompt_tokens"), 4).alias("mean_in"), F.round(F.avg("completion_tokens"), 4).alias("mean_out"), F.sum("prompt_tokens").alias("tokens_in"), F.sum("completion_tokens").alias("tokens_out"))


#: Output tokens of a call where a group has none measured; what a token read and a token written weigh.
FALLBACK_OUT, WEIGHT_IN, WEIGHT_OUT = 1_300.0, 1, 4


@query(f"""WITH g AS (SELECT corpus_type, pass_name, CASE WHEN corpus_type = 'intersection' AND pass_name = 'pass2' THEN NULL ELSE completion_tokens END AS out, prompt_tokens AS inp FROM token_usage),
  r AS (SELECT corpus_type, pass_name, sum(out) / count(out) AS rate FROM g GROUP BY ALL)
SELECT corpus_type, pass_name, CAST(count(*) AS BIGINT) AS n, CAST(count(out) AS BIGINT) AS measured, CAST(sum({WEIGHT_IN} * inp + {WEIGHT_OUT} * out) FILTER (out IS NOT NULL) AS BIGINT) AS actual, round(sum({WEIGHT_IN} * inp + {WEIGHT_OUT} * coalesce(out, rate, {FALLBACK_OUT})), 2) AS projected FROM g JOIN r USING (corpus_type, pass_name) GROUP BY ALL""")
def cost_estimate(t: Tables) -> DataFrame:
    """Weighted tokens so far and in all: measured where there is a measure, else by the group's rate, else by a fixed one."""
    out = F.when(~((F.col("corpus_type") == "intersection") & (F.col("pass_name") == "pass2")), F.col("completion_tokens"))
    g = t.token_usage.select("corpus_type", "pass_name", out.alias("out"), F.col("prompt_tokens").alias("inp"))
    rate = g.groupBy("corpus_type", "pass_name").agg((F.sum("out") / F.nullif(F.count("out"), F.lit(0))).alias("rate"))
    rows = g.join(F.broadcast(rate), ["corpus_type", "pass_name"])
    cost = lambda o: WEIGHT_IN * F.col("inp") + WEIGHT_OUT * o
    return rows.groupBy("corpus_type", "pass_name").agg(F.count("*").alias("n"), F.count("out").alias("measured"), F.sum(cost(F.col("out"))).alias("actual"), F.round(F.sum(cost(F.coalesce("out", "rate", F.lit(FALLBACK_OUT)))), 2).alias("projected"))


#: Bytes of a token of an answer, and of what surrounds it.
TOKEN_BYTES, ENVELOPE_BYTES = 5, 550


@query(f"SELECT corpus_type, CAST(sum(completion_tokens) * {TOKEN_BYTES} + count(*) * {ENVELOPE_BYTES} AS BIGINT) AS bytes FROM token_usage GROUP BY corpus_type")
def size_estimate(t: Tables) -> DataFrame:
    """Bytes that the answers will take."""
    return t.token_usage.groupBy("corpus_type").agg((F.coalesce(F.sum("completion_tokens"), F.lit(0)) * TOKEN_BYTES + F.count("*") * ENVELOPE_BYTES).alias("bytes"))


@query("""WITH r AS (SELECT corpus_type, sum(completion_tokens) / sum(prompt_tokens) AS ratio FROM token_usage WHERE completion_tokens IS NOT NULL GROUP BY ALL)
SELECT corpus_type, CAST(count(*) AS BIGINT) AS n, round(sum(coalesce(completion_tokens, prompt_tokens * ratio)), 2) AS tokens_out FROM token_usage JOIN r USING (corpus_type) GROUP BY ALL""")
def projected_output(t: Tables) -> DataFrame:
    """Measured output where there is one, else the input times the group's measured ratio."""
    r = t.token_usage.where("completion_tokens is not null").groupBy("corpus_type").agg((F.sum("completion_tokens") / F.sum("prompt_tokens")).alias("ratio"))
    rows = t.token_usage.join(F.broadcast(r), "corpus_type")
    return rows.groupBy("corpus_type").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("completion_tokens", F.col("prompt_tokens") * F.col("ratio"))), 2).alias("tokens_out"))


@query(f"WITH {_PASSES}, {_ELIGIBLE}, r AS (SELECT article_idx, pass_name FROM a JOIN p USING (corpus_type)) SELECT article_idx, pass_name FROM r WHERE NOT EXISTS (SELECT 1 FROM token_usage u WHERE u.article_idx = r.article_idx AND u.pass_name = r.pass_name AND u.completion_tokens IS NOT NULL)")
def makeup_selection(t: Tables) -> DataFrame:
    """Requests without a complete answer."""
    return requests(t).select("article_idx", "pass_name").join(t.token_usage.where("completion_tokens is not null").select("article_idx", "pass_name"), ["article_idx", "pass_name"], "left_anti")


@query(f"WITH {_PASSES}, {_ELIGIBLE}, w AS (SELECT corpus_type, pass_name, count(DISTINCT article_idx) AS expected FROM a JOIN p USING (corpus_type) GROUP BY ALL), d AS (SELECT corpus_type, pass_name, count(DISTINCT article_idx) AS written FROM token_usage WHERE completion_tokens IS NOT NULL GROUP BY ALL) SELECT corpus_type, pass_name, CAST(expected AS BIGINT) AS expected, CAST(coalesce(written, 0) AS BIGINT) AS written, CASE WHEN coalesce(written, 0) = 0 THEN 'not started' WHEN written >= expected THEN 'done' ELSE round_even(100.0 * written / expected, 0) || '%' END AS status FROM w LEFT JOIN d USING (corpus_type, pass_name)".replace("round_even(100.0 * written / expected, 0) || '%'", "CAST(CAST(round_even(100.0 * written / expected, 0) AS BIGINT) AS VARCHAR) || '%'"))
def progress_matrix(t: Tables) -> DataFrame:
    want = requests(t).groupBy("corpus_type", "pass_name").agg(F.count_distinct("article_idx").alias("expected"))
    done = t.token_usage.where("completion_tokens is not null").groupBy("corpus_type", "pass_name").agg(F.count_distinct("article_idx").alias("written"))
    rows = want.join(done, ["corpus_type", "pass_name"], "left").fillna(0, ["written"])
    share = F.concat(F.bround(100.0 * F.col("written") / F.col("expected")).cast("long").cast("string"), F.lit("%"))
    return rows.withColumn("status", F.when(F.col("written") == 0, "not started").when(F.col("written") >= F.col("expected"), "done").otherwise(share))


# ---- answers ----


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def parse_json_path(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT doc_id, n_chars AS n, 'het } teken' AS note FROM documents WHERE n_chars IS NOT NULL")
def parse_outermost_json(t: Tables) -> DataFrame:
    """The object that ends last, after prose, a broken brace and another object, with braces inside its strings."""
    text = F.format_string('Zo: {kapot {"n": 0} "slot" {"n": %d, "note": "het } teken", "in": {"n": -1}} einde.', F.col("n_chars"))
    rows = t.documents.where("n_chars is not null").select("doc_id", json_text.outermost_json(text).alias("j"))
    return rows.select("doc_id", F.get_json_object("j", "$.n").cast("long").alias("n"), F.get_json_object("j", "$.note").alias("note"))


@query("SELECT doc_id, n_chars AS n FROM documents WHERE n_chars IS NOT NULL")
def html_payload(t: Tables) -> DataFrame:
    """The object inlined in a page's last script, found among braces inside strings."""
    page = F.format_string('<html><script>var a = {};</script><script>const DATA = {"n": %d, "s": "} \\" {"};</script></html>', F.col("n_chars"))
    rows = t.documents.where("n_chars is not null").select("doc_id", json_text.html_payload(page).alias("j"))
    return rows.select("doc_id", F.get_json_object("j", "$.n").cast("long").alias("n"))


@query("SELECT doc_id, lang, source, CAST(count(*) OVER (PARTITION BY lang, source) AS BIGINT) AS shown FROM documents WHERE lang = 'nl' AND source = 'rietgorzer'")
def article_filter(t: Tables) -> DataFrame:
    """Rows of a selection with their number."""
    rows = t.documents.where("lang = 'nl' and source = 'rietgorzer'").select("doc_id", "lang", "source")
    return rows.join(F.broadcast(rows.agg(F.count("*").alias("shown"))))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round_even(value * 100, 0) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def stream_hourly(t: Tables) -> DataFrame:
    """The events table as a stream that processes what is there and stops."""
    import uuid

    return hourly_events(t.spark, t.folder, uuid.uuid4().hex)
