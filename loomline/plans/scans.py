"""Sources and sinks, each written and read back, and slices of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.order import dense_ordinal, hash_rank
from loomline.operators.sampling import every_kth
from loomline.plans.registry import Tables, query, sql_strip
from loomline.sources import files


@query("SELECT row_idx, corpus, outlet, title, body FROM preprocess_final")
def csv_roundtrip(t: Tables) -> DataFrame:
    """Written as quoted CSV with line feeds in fields and read back with a schema."""
    cols = ["row_idx", "corpus", "outlet", "title", "body"]
    path = t.scratch("csv")
    files.write_csv(t.preprocess_final.select(*cols), path)
    return files.read_csv(t.spark, path, "row_idx long, corpus string, outlet string, title string, body string")


@query("SELECT row_idx, outlet FROM preprocess_final")
def csv_to_parquet(t: Tables) -> DataFrame:
    """A CSV converted once into a format that splits."""
    source = t.scratch("convert")
    files.write_csv(t.preprocess_final.select("row_idx", "outlet"), source)
    return files.as_parquet(t.spark, source, t.scratch("converted"), "row_idx long, outlet string")


@query(f"SELECT CAST(row_idx AS VARCHAR) AS row_idx, nullif({sql_strip('outlet')}, '') AS outlet, nullif({sql_strip('meta')}, '') AS meta FROM preprocess_final")
def string_scan(t: Tables) -> DataFrame:
    """A CSV read as text only, stripped, with nothing as null."""
    path = t.scratch("strings")
    files.write_csv(t.preprocess_final.select("row_idx", "outlet", "meta"), path)
    return files.read_strings(t.spark, path, ["row_idx", "outlet", "meta"])


@query("SELECT row_idx, corpus, outlet, label AS topic_label, meta AS topic_meta FROM preprocess_final")
def shaped_scan(t: Tables) -> DataFrame:
    """Columns dropped and renamed where they are there; others of the lists are passed over."""
    rows = t.preprocess_final.select("row_idx", "corpus", "outlet", "label", "meta", "word_count", "ingested_at")
    return files.shaped(rows, ["word_count", "ingested_at", "Unnamed: 0"], {"label": "topic_label", "meta": "topic_meta", "absent": "x"})


@query("SELECT row_idx, title, outlet FROM preprocess_final")
def jsonl_roundtrip(t: Tables) -> DataFrame:
    path = t.scratch("jsonl")
    files.write_lines(t.preprocess_final.select("row_idx", "title", "outlet"), path)
    return files.read_lines(t.spark, path, "row_idx long, title string, outlet string")


@query("SELECT outlet_clean, full_name, news_brand, home_place FROM outlet_reference")
def json_document(t: Tables) -> DataFrame:
    """A small table as one JSON document and back."""
    path = t.scratch("document")
    files.write_document(t.outlet_reference, path)
    return files.read_document(t.spark, path, "outlet_clean string, full_name string, news_brand string, home_place string")


@query("SELECT CAST(n AS INTEGER) AS n, line FROM (SELECT 0 AS n, '| corpus | n |' AS line UNION ALL SELECT 1, '|---|---|' UNION ALL SELECT 1 + row_number() OVER (ORDER BY corpus), '| ' || corpus || ' | ' || count(*) || ' |' FROM preprocess_final GROUP BY corpus)")
def markdown_report(t: Tables) -> DataFrame:
    """Lines of a report table."""
    return files.markdown(t.preprocess_final.groupBy("corpus").agg(F.count("*").alias("n")))


@query("""SELECT '<script>const DATA = [' || string_agg('{"outlet_clean":"' || outlet_clean || '"}', ',' ORDER BY outlet_clean) || '];</script>' AS html FROM outlet_reference""")
def inlined_page(t: Tables) -> DataFrame:
    """A page with its data inlined."""
    return files.page("<script>const DATA = __DATA__;</script>", t.outlet_reference.select("outlet_clean"))


@query("SELECT row_idx, CAST(n AS BIGINT) AS n FROM (SELECT row_idx, row_number() OVER (ORDER BY row_idx) - 1 AS n FROM preprocess_final) WHERE n >= 500 AND n < 900")
def line_range(t: Tables) -> DataFrame:
    """A half-open range of the lines of a file."""
    return files.slice_lines(dense_ordinal(t.preprocess_final.select("row_idx"), [], "row_idx", "n"), "n", 500, 900)


@query("SELECT row_idx, n FROM (SELECT row_idx, CAST(row_number() OVER (ORDER BY row_idx) - 1 AS BIGINT) AS n, count(*) OVER () AS total FROM preprocess_final) WHERE n % greatest(1, total // 20) = 0 AND n < 20 * greatest(1, total // 20)")
def every_kth_line(t: Tables) -> DataFrame:
    """At most 20 lines at equal steps, to look into a file."""
    rows = t.preprocess_final.select("row_idx")
    return every_kth(dense_ordinal(rows, [], "row_idx", "n"), "n", rows.count(), 20)


@query(f"SELECT CAST(part AS INTEGER) AS part, row_idx, title FROM (SELECT 0 AS part, row_idx, title FROM preprocess_final WHERE corpus = 'climate' UNION ALL SELECT 1, row_idx, title FROM preprocess_final WHERE corpus = 'migration') WHERE length({sql_strip('title')}) > 0")
def file_concatenation(t: Tables) -> DataFrame:
    """Parts one after another, without blank lines."""
    rows = t.preprocess_final.select("row_idx", "corpus", "title")
    return files.concatenated([rows.where(F.col("corpus") == c) for c in ("climate", "migration")], "row_idx", "title")


@query("SELECT row_idx FROM preprocess_final ORDER BY md5('7#' || row_idx), row_idx LIMIT 13")
def fixed_sample(t: Tables) -> DataFrame:
    """Exactly 13 rows by hash rank."""
    return t.preprocess_final.select("row_idx").orderBy(hash_rank(7, "row_idx"), "row_idx").limit(13)


@query("SELECT CAST(row_idx AS VARCHAR) AS value FROM preprocess_final WHERE title IS NULL")
def id_list(t: Tables) -> DataFrame:
    """Ids of failed rows as a plain list, one a line."""
    path = t.scratch("list")
    files.write_list(t.preprocess_final.where("title is null").select("row_idx"), path)
    return t.spark.read.text(path)


@query("SELECT row_idx FROM preprocess_final WHERE row_idx % 97 = 3")
def audit_write_verified(t: Tables) -> DataFrame:
    """Rows that a broken write lost, found by reading it again."""
    path = t.scratch("verify")
    t.preprocess_final.select("row_idx").where("row_idx % 97 != 3").write.parquet(path)
    return files.verify_written(t.preprocess_final, t.spark.read.parquet(path), ["row_idx"])


@query("SELECT CAST(row_idx AS VARCHAR) AS id, row_idx % 83 = 1 AS cut FROM preprocess_final WHERE row_idx % 83 IN (1, 2)")
def audit_download(t: Tables) -> DataFrame:
    """Lines of a download that are cut off or have no id, which the whole file is searched for."""
    line = F.to_json(F.struct(F.col("row_idx").cast("string").alias("custom_id"), F.lit("x").alias("body")))
    cut, bare = F.col("row_idx") % 83 == 1, F.col("row_idx") % 83 == 2
    broken = F.when(cut, F.left(line, F.length(line) - 3)).when(bare, F.regexp_replace(line, "custom_id", "id")).otherwise(line)
    path = t.scratch("download")
    t.preprocess_final.select(broken.alias("value")).write.text(path)
    bad = files.malformed_lines(t.spark.read.text(path), "custom_id")
    return bad.select(F.regexp_extract("value", r'"(\d+)"', 1).alias("id"), (~F.col("value").endswith("}")).alias("cut"))


@query("SELECT row_idx, corpus FROM preprocess_final")
def append_batches(t: Tables) -> DataFrame:
    """Two appends to one table, as rows finish."""
    path, rows = t.scratch("append"), t.preprocess_final.select("row_idx", "corpus")
    for corpus in ("climate", "migration"):
        rows.where(F.col("corpus") == corpus).write.mode("append").parquet(path)
    return t.spark.read.schema(rows.schema).parquet(path)
