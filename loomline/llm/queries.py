"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import balanced_sample, canonical_values, copy_ledger, mixing, near_duplicates, packing, repeated_lines, tokens, wrong_encoding
from loomline.runtime import expand_pairs, stage


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, d: str) -> repeated_lines.RepeatedLines:
    return repeated_lines.repeated_lines(_read(spark, d, "preprocess_final"), "row_idx", "outlet_clean", "body", min_docs=8, min_share=(1, 20))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).occurrences.select(F.col("id").alias("row_idx"), "line_no")


def p1_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of lines that follow one another, by outlet."""
    blocks = _lines(spark, d).blocks.groupBy(F.col("source").alias("outlet_clean"), "block")
    return blocks.agg(F.count("*").alias("block_lines"), F.max("support").alias("max_support"), F.min("support").alias("min_support")).drop("block")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every body without the repeated lines."""
    return _lines(spark, d).clean()


def _balanced(spark: SparkSession, d: str) -> balanced_sample.BalancedSample:
    return balanced_sample.balanced_sample(_read(spark, d, "check_strata"), _read(spark, d, "strata_targets"), "row_idx", ["outlet_clean", "year", "on_topic_flag"], "target_share", "min_rows", "flagged_at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _balanced(spark, d).report.where("short").select("outlet_clean", "year", F.col("on_topic_flag").cast("int").alias("on_topic"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _balanced(spark, d).report


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return _balanced(spark, d).sample


#: How outlets are typed: editions and addresses around a name, digits for letters, letters that sound alike.
SPELLING = canonical_values.Spelling(
    before=("www", "krant", "editie"),
    after=("online", "print", "digitaal", "zaterdag", "editiezuid", "nl", "on", "pr"),
    digits={"3": "e", "0": "o", "1": "l", "4": "a", "5": "s", "7": "t"},
    sounds=(("ij", "y"), ("oe", "u"), ("k", "c")),
    ands=("en", "and"),
)


def _mapped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    unknown = _read(spark, d, "preprocess_final").where("outlet_clean is null").select("row_idx", "outlet")
    return unknown, canonical_values.map_values(unknown, "outlet", _read(spark, d, "outlet_reference"), "outlet_clean", ["outlet_clean", "full_name", "news_brand"], "home_place", SPELLING)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    unknown, mapped = _mapped(spark, d)
    return unknown.join(mapped.where("entry is not null"), "outlet").select("row_idx", F.col("entry").alias("outlet_clean"))


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    unknown, mapped = _mapped(spark, d)
    return unknown.join(mapped, "outlet", "left").where("entry is null").groupBy("outlet").agg(F.count("*").alias("n_rows"), F.coalesce(F.max("n_entries"), F.lit(0)).alias("n_entries"))


def _near(spark: SparkSession, d: str) -> near_duplicates.NearDuplicates:
    articles = copy_ledger.composed(_read(spark, d, "preprocess_final").select("row_idx", "title", "body"), "title", "body")
    return near_duplicates.near_duplicates(articles, "row_idx", "title", "body", copy_ledger.canonical_key("title", "body"), words=3, threshold=(1, 2), blocks=64, rows=4)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.linked_pairs(_near(spark, d)).select(F.col("a").alias("row_idx_a"), F.col("b").alias("row_idx_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups(_near(spark, d)).withColumnRenamed("id", "row_idx")


def _copies(spark: SparkSession, d: str) -> copy_ledger.Copies:
    return copy_ledger.collapse(_read(spark, d, "preprocess_final"), "row_idx", "title", "body", "ingested_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    copies = _copies(spark, d)
    several = copies.ledger.where("copies > 1").select("k1", "k2")
    members = copies.keys.join(several, ["k1", "k2"], "left_semi").select(F.struct("k1", "k2").alias("k"), "id")
    return expand_pairs(stage(members, "copy-members"), "k", "id").select(F.col("a").alias("row_idx_a"), F.col("b").alias("row_idx_b"))


def p5_ledger(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d).ledger.select(F.col("first_id").alias("row_idx"), "copies", F.col("first_at").alias("first_ingested_at"))


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return stage(tokens.count_tokens(_read(spark, d, "documents"), "doc_id", "text", ("source",)), "document-tokens")


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_items(_counted(spark, d), "doc_id", "tokens", _read(spark, d, "pack_capacity"), "plan_name", "capacity_tokens")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers and unused room of each plan, beside the fewest containers that its tokens could fill."""
    rows = p6_pack(spark, d).where("container is not null")
    each = rows.groupBy("plan_name", "container").agg(F.sum("tokens").alias("tokens"), F.max("unused").alias("unused"))
    plan = each.groupBy("plan_name").agg(F.count("*").alias("containers"), F.max(F.col("tokens") + F.col("unused")).alias("capacity"), F.sum("tokens").alias("tokens"), F.sum("unused").alias("unused"))
    plan = plan.withColumn("containers_at_least", F.ceil(F.col("tokens") / F.col("capacity")))
    return plan.withColumn("excess", F.col("containers") - F.col("containers_at_least")).withColumn("unused_share", F.round(F.col("unused") / (F.col("unused") + F.col("tokens")), 6))


def _mixed(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.mix(_counted(spark, d), "doc_id", "source", "tokens", _read(spark, d, "mix_targets"), "target_share", "max_repeats")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).records


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).report


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_repaired(spark, d).select("doc_id")


def p8_repaired(spark: SparkSession, d: str) -> DataFrame:
    return wrong_encoding.find_wrong_encoding(_read(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}
