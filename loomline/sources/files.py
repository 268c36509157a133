"""Text formats at the edges: CSV, JSON lines and documents, plain lists, report tables and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions.text import strip

_CSV = {"header": True, "multiLine": True, "escape": '"', "quote": '"', "lineSep": "\n", "nullValue": "\\N", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Quoted fields may hold line feeds; nulls are written as \\N, apart from empty strings."""
    df.write.mode(mode).options(**{k: str(v) for k, v in _CSV.items() if k != "multiLine"}, quoteAll=True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**_CSV).csv(path)


def as_parquet(spark: SparkSession, source: str, target: str, schema: str) -> DataFrame:
    """A CSV with line feeds in fields, which one task a file must read, written once as Parquet, which splits."""
    read_csv(spark, source, schema).write.mode("overwrite").option("compression", "zstd").parquet(target)
    return spark.read.schema(schema).parquet(target)


def read_strings(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A CSV with every column as text: stripped, and null where nothing is left."""
    df = read_csv(spark, path, ", ".join(f"`{n}` string" for n in names))
    return df.select([F.nullif(strip(F.col(n)), F.lit("")).alias(n) for n in names])


def shaped(df: DataFrame, drop: list[str], rename: dict[str, str]) -> DataFrame:
    """Without the columns of a list and with new names for others; names that are not there are passed over."""
    return df.drop(*drop).withColumnsRenamed(rename)


def union_strict(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both tables one after the other; different names or types are an error."""
    if left.dtypes != right.select(left.columns).dtypes or set(left.columns) != set(right.columns):
        raise ValueError(f"schemas differ: {sorted(set(left.dtypes) ^ set(right.dtypes))}")
    return left.unionByName(right)


def write_document(df: DataFrame, path: str) -> None:
    """A small table (a ledger, a schema) as one JSON document: an object with its rows."""
    rows = df.agg(F.collect_list(F.struct(*df.columns)).alias("rows"))
    rows.select(F.to_json(F.struct("rows")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of such a document."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"rows array<struct<{schema}>>").alias("d"))
    return rows.select(F.inline("d.rows"))


def slice_lines(df: DataFrame, ordinal: str, first: int, stop: int) -> DataFrame:
    """The lines of a half-open range of their ordinals."""
    return df.where((F.col(ordinal) >= first) & (F.col(ordinal) < stop))


def concatenated(parts: list[DataFrame], ordinal: str, line: str) -> DataFrame:
    """Lines of several parts, without blank ones: (part, ordinal, line), whose order is that of the parts."""
    out = None
    for n, part in enumerate(parts):
        rows = part.where(F.length(strip(F.col(line))) > 0).select(F.lit(n).alias("part"), ordinal, line)
        out = rows if out is None else out.unionByName(rows)
    return out


def markdown(df: DataFrame) -> DataFrame:
    """The rows of a small table as lines of a Markdown table, numbered from its head: (n, line)."""
    cells = F.concat_ws(" | ", *[F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns])
    head = df.sparkSession.createDataFrame([(0, f"| {' | '.join(df.columns)} |"), (1, "|" + "---|" * len(df.columns))], "n int, line string")
    body = df.select((F.row_number().over(W.orderBy(*df.columns)) + 1).alias("n"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    return head.unionByName(body)


def page(template: str, payload: DataFrame, mark: str = "__DATA__") -> DataFrame:
    """A page with the rows of a small table, in the order of its columns, inlined as JSON in place of a mark: one row, ``html``."""
    data = payload.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*payload.columns)))).alias("json"))
    return data.select(F.replace(F.lit(template), F.lit(mark), F.replace("json", F.lit("</"), F.lit("<\\/"))).alias("html"))


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row, nulls left out."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that are no JSON are skipped."""
    rows = spark.read.text(path).select(F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.select("r.*").where("_bad is null").drop("_bad")


def write_list(df: DataFrame, path: str) -> None:
    """The values of the first column, one a line."""
    df.select(F.col(df.columns[0]).cast("string").alias("value")).where("value is not null").write.mode("overwrite").text(path)


def verify_written(df: DataFrame, back: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has; no rows if the write was whole."""
    return df.select(*keys).exceptAll(back.select(*keys)).unionByName(back.select(*keys).exceptAll(df.select(*keys)))


def malformed_lines(lines: DataFrame, field: str) -> DataFrame:
    """Lines that are no JSON object or lack a field."""
    return lines.where(F.length(strip(F.col("value"))) > 0).where(F.get_json_object("value", f"$.{field}").isNull())
