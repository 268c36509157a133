"""Lines repeated across the documents of one source.

Nodes are lines (compared without letter case, white space and digit values) with the
number of distinct documents of the source that hold them, edges are consecutive lines.
Nodes and edges of high support stay; connected components are boilerplate blocks, and
every occurrence of a line of a block goes.

Defined results: null source, null or empty text and texts without letters have no
repeated lines; a cleaned null text is null, an empty one empty. Ties do not arise, the
thresholds are inclusive. Every row is a document, also one whose id comes again, and is
counted, listed and cleaned for itself. Lines without letters stand in no block: two lines are
consecutive if only such lines are between them. Other columns are not read, so names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.runtime import BROADCAST_ROWS, broadcast_if_small, stage, unstage

#: White space of any kind but the line feed, with the format characters that show as none.
_BLANK = r"[\t\x0B\f\r\x1C-\x1F\x85\p{Z}\x{200B}\x{2060}\x{FEFF}]+"
#: Keys over which a source is spread where its texts are joined by shuffle.
SALTS = 64


@dataclass
class RepeatedLines:
    """``occurrences`` (id, line_no, source, block), ``blocks`` (source, h, g, support, block), ``edges``; ``clean()``."""

    source_df: DataFrame
    id_col: str
    source_col: str
    text_col: str
    lines: DataFrame
    blocks: DataFrame
    n_blocks: int
    edges: DataFrame

    @property
    def occurrences(self) -> DataFrame:
        each = self.lines.select("id", "source", F.explode("lines").alias("l")).select("id", "source", F.col("l.n").alias("line_no"), F.col("l.h").alias("h"), F.col("l.g").alias("g"))
        return each.join(broadcast_if_small(self.blocks.select("source", "h", "g", "block"), known=self.n_blocks), ["source", "h", "g"]).select("id", "line_no", "source", "block")

    def clean(self) -> DataFrame:
        """(id, text without the repeated lines, number of lines removed) of every row."""
        df = self.source_df.select(F.col(self.id_col).alias("id"), F.col(self.source_col).alias("source"), F.col(self.text_col).alias("text"))
        # a source has at most 1 / min_share times its mean number of lines of them, so the array of one source is small
        drop = self.blocks.groupBy("source").agg(F.collect_set(F.struct("h", "g")).alias("drop"))
        if self.n_blocks <= BROADCAST_ROWS:
            df = df.join(F.broadcast(drop), "source", "left")
        else:  # the same join by shuffle, each source spread over SALTS keys
            drop = drop.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            df = df.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(drop, ["source", "salt"], "left")
        keyed = F.arrays_zip(F.split("text", "\n").alias("t"), F.split(fold_text("text"), "\n").alias("k"))
        kept = F.filter(keyed, lambda x: ~(x["k"].rlike(r"\p{L}") & F.array_contains("drop", _hashes(x["k"]))))
        kept = F.transform(kept, lambda x: x["t"])
        text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
        removed = F.when(F.col("drop").isNull() | F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n")) - F.size(kept))
        return df.select(F.col("id").alias(self.id_col), text.alias(self.text_col), removed.cast("int").alias("lines_removed"))


def fold_text(text: str) -> Column:
    """The text in lower case, without white space but line feeds, each run of digits as one 0."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.col(text)), _BLANK, ""), r"\p{Nd}+", "0")


def _hashes(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def _components(edges: pd.DataFrame) -> pd.DataFrame:
    """Union-find over the kept edges of one source.

    Each edge stands in at least ``min_share`` of the source's documents, so a source has
    at most 1 / min_share times its mean number of lines of them, whatever its size.
    """
    parent: dict = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for h1, g1, h2, g2 in edges[["h1", "g1", "h2", "g2"]].itertuples(index=False):
        a, b = (int(h1), int(g1)), (int(h2), int(g2))
        for x in (a, b):
            parent.setdefault(x, x)
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    rows = [(edges["source"].iloc[0], *x, find(x)[0]) for x in parent]
    return pd.DataFrame(rows, columns=["source", "h", "g", "root"])


def repeated_lines(df: DataFrame, id_col: str, source_col: str, text_col: str, min_docs: int = 8, min_share: tuple[int, int] = (1, 20)) -> RepeatedLines:
    """Find lines that stand in ``min_docs`` documents and a ``min_share`` (a fraction) of the documents of their source.

    The texts are read and folded once into a staged table of line keys (12 bytes a line).
    Support is counted over keys made distinct within a document and combined before the
    shuffle, so a source with a third of all rows costs its mappers no more than any other.
    """
    num, den = min_share
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("source").isNotNull() & (F.length("text") > 0))
    keys = F.filter(F.transform(F.split(fold_text("text"), "\n"), lambda x, i: F.struct(i.alias("n"), F.xxhash64(x).alias("h"), F.hash(x).alias("g"), x.rlike(r"\p{L}").alias("real"))), lambda x: x["real"])
    lines = F.transform(keys, lambda x: F.struct(x["n"].alias("n"), x["h"].alias("h"), x["g"].alias("g")))
    lines = stage(rows.select("id", "source", lines.alias("lines")), "line-keys")

    docs = lines.groupBy("source").agg(F.count("*").alias("docs"))
    once = lines.select("source", F.explode(F.array_distinct(F.transform("lines", lambda x: F.struct(x["h"].alias("h"), x["g"].alias("g"))))).alias("k"))
    support = once.groupBy("source", F.col("k.h").alias("h"), F.col("k.g").alias("g")).agg(F.count("*").alias("support")).where(F.col("support") >= min_docs)
    nodes = support.join(docs, "source").where(F.col("support") * den >= F.col("docs") * num)
    nodes = stage(nodes.select("source", "h", "g", "support", "docs"), "line-nodes")
    n = nodes.count()
    few = broadcast_if_small(nodes, known=n)

    after = F.arrays_zip(F.slice("lines", 1, F.greatest(F.size("lines") - 1, F.lit(0))).alias("a"), F.slice("lines", 2, F.size("lines")).alias("b"))
    follow = F.array_distinct(F.transform(after, lambda x: F.struct(x["a"]["h"].alias("h1"), x["a"]["g"].alias("g1"), x["b"]["h"].alias("h2"), x["b"]["g"].alias("g2"))))
    pairs = lines.where(F.size("lines") > 1).select("source", F.explode(follow).alias("e")).select("source", "e.*")
    pairs = pairs.join(few.select("source", F.col("h").alias("h1"), F.col("g").alias("g1"), "docs"), ["source", "h1", "g1"])
    pairs = pairs.join(few.select("source", F.col("h").alias("h2"), F.col("g").alias("g2")), ["source", "h2", "g2"], "left_semi")
    edges = pairs.groupBy("source", "h1", "g1", "h2", "g2").agg(F.count("*").alias("support"), F.first("docs").alias("docs"))
    edges = stage(edges.where((F.col("support") >= min_docs) & (F.col("support") * den >= F.col("docs") * num)).drop("docs"), "line-edges")

    source_type = dict(lines.dtypes)["source"]
    roots = edges.groupBy("source").applyInPandas(_components, f"source {source_type}, h long, g int, root long")
    blocks = nodes.join(roots, ["source", "h", "g"], "left").select("source", "h", "g", "support", F.coalesce("root", "h").alias("block"))
    blocks = stage(blocks, "line-blocks")
    unstage(nodes)
    return RepeatedLines(df, id_col, source_col, text_col, lines, blocks, n, edges)

