"""The label dimension and the wide and long forms of label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.text import yes_no

# Label, pass in which it is asked.
LABELS = (
    ("conflict", "pass1"), ("human_interest", "pass1"), ("economic", "pass1"), ("deservingness", "pass1"), ("responsibility", "pass1"),
    ("humanitarian", "pass2"), ("security", "pass2"), ("policy", "pass2"),
    ("scientific", "pass3"), ("crisis", "pass3"), ("solutions", "pass3"), ("victim", "pass3"), ("skepticism", "pass3"),
    ("securitization", "pass4"), ("othering", "pass4"), ("agency", "pass4"),
)
# Corpus type, pass that applies to it.
PASSES = (
    ("climate", "pass1"), ("climate", "pass3"), ("climate", "pass4"),
    ("migration", "pass1"), ("migration", "pass2"), ("migration", "pass4"),
    ("intersection", "pass1"), ("intersection", "pass2"), ("intersection", "pass3"), ("intersection", "pass4"),
)
COLUMNS = [f"{slug}_present" for slug, _ in LABELS]


def label_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELS), "frame string, pass_name string")


def pass_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PASSES), "corpus_type string, pass_name string")


def long_labels(wide: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, frame, raw, present) of every distinct row and label, nulls included.

    Repeated rows go while they are wide; the long rows are then aggregated where they arise
    and never shuffled one by one.
    """
    long = wide.select(*keep, *COLUMNS).distinct().unpivot(keep, COLUMNS, "column", "raw")
    return long.select(*keep, F.regexp_replace("column", "_present$", "").alias("frame"), "raw", yes_no(F.col("raw")).alias("present"))


def prevalence(long: DataFrame, by: list[str]) -> DataFrame:
    """n_applicable, n_present and pct (half-even, 4 digits) per group and frame; no row without an applicable label."""
    counts = long.groupBy(*by, "frame").agg(F.count("present").alias("n_applicable"), F.count_if(F.col("present") == "yes").alias("n_present"))
    return counts.where("n_applicable > 0").withColumn("pct", percent(F.col("n_present"), F.col("n_applicable")))


def percent(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.bround(F.try_divide(F.lit(100.0) * part, whole), digits)
