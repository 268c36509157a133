"""Duplicates hidden by formatting, counted in an incremental ledger.

Records are equal if only letters, their marks and digits, regardless of case, are compared
(in the composed form of Unicode). The fields of a head line (``name: value`` pairs on the
first line) count in any order. The ledger keeps one row per canonical key, in buckets of
the key: its number of copies and its earliest record. Each batch is aggregated,
full-outer-joined with the buckets that its keys fall into, the counts are added and the
earlier representative stays; the other buckets are neither read nor written.

The ledger is a folder: a folder for each version with the buckets written by it, and a
manifest for each version that names the folder of every bucket. A batch counts once its
manifest is there, so a failed one leaves the ledger as it was. The number of buckets follows
the number of rows; it doubles when a bucket would have more than twice ``bucket_rows``.

Defined results: a null title equals an empty one; rows with a null or empty body are no
records and get no key; rows without an arrival time come after all others; among equal
times the smaller id is the earliest. A repeated id counts as often as it comes. An empty
batch leaves the ledger as it is. Only the named columns are read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.runtime import file_system, remove, stage, unstage, work_dir

_NAME = r"\p{L}[\p{L}\p{N}_-]*\s*:"
#: A first line, ended by a line feed, that opens with a field and has another one.
HEAD_LINE = r"^\s*" + _NAME + r"[^\n]*[^\n\p{L}\p{N}_-]" + _NAME + r"[^\n]*\n"
_BETWEEN = r"(?<![\p{L}\p{N}_-])(?=" + _NAME + ")"
_OTHER = r"[^\p{L}\p{M}\p{N}]+"
#: What composition may change: marks, and the letters of Korean that are composed without any.
_COMPOSABLE = r"[\p{M}\x{1100}-\x{11FF}]"


def composed(df: DataFrame, *cols: str) -> DataFrame:
    """The table with text columns in the composed form of Unicode (NFC), by the library that Spark compares strings with.

    A step of its own: Spark would evaluate the call again wherever a column is used.
    """
    of = lambda c: F.when(F.col(c).rlike(_COMPOSABLE), F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.col(c), F.lit(False))).otherwise(F.col(c))
    return df.withColumns({c: of(c) for c in cols})


def letters(text: Column) -> Column:
    """Letters, marks and digits only, in lower case; the sharp s is the two letters that its upper case is."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), _OTHER, "")


def canonical_key(title: str, body: str) -> Column:
    """struct<k1, k2> of two independent 64-bit hashes of :func:`composed` texts; null for a null or empty body."""
    t, b = F.coalesce(F.col(title), F.lit("")), F.col(body)
    first = F.substring_index(b, "\n", 1)
    fields = F.array_sort(F.filter(F.transform(F.split(first, _BETWEEN), letters), lambda x: x != ""))
    headed = F.concat_ws("\x02", F.concat_ws("\x01", fields), letters(F.substring(b, F.length(first) + 1, 1 << 30)))
    plain = F.concat(letters(t), F.lit("\x03"), F.when(b.rlike(HEAD_LINE), headed).otherwise(letters(b)))
    # bound to a variable, as the text would be made for each hash apart
    keys = F.transform(F.array(plain), lambda x: F.struct(F.xxhash64(x).alias("k1"), F.xxhash64(F.lit(17), x).alias("k2")))
    return F.when(F.length(b) > 0, F.get(keys, F.lit(0)))


@dataclass
class CopyLedger:
    """A ledger in a folder; one writer at a time."""

    spark: SparkSession
    folder: str
    bucket_rows: int = 3_000_000  # about 128 MB
    id_type: str = "long"
    version: int = 0
    buckets: int = 0
    at: dict[int, tuple[int, int]] = field(default_factory=dict)  # bucket -> (version that wrote it, its rows)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, bucket_rows: int = 3_000_000, id_type: str = "long") -> CopyLedger:
        """The ledger as its latest manifest tells it, or an empty one; ids may be of any type that can be ordered."""
        ledger = cls(spark, folder.rstrip("/"), bucket_rows, id_type)
        fs, path = file_system(spark, f"{ledger.folder}/manifest")
        if fs.exists(path):
            names = [n for s in fs.listStatus(path) if (n := s.getPath().getName()).startswith("v")]
            if names:
                text = spark.read.text(f"{ledger.folder}/manifest/{max(names)}", wholetext=True).first()[0]
                known = json.loads(text)
                if known["id_type"] != id_type:
                    raise ValueError(f"the ledger has ids of type {known['id_type']}, not {id_type}")
                ledger.version, ledger.buckets = known["version"], known["buckets"]
                ledger.at = {int(b): (v, n) for b, (v, n) in known["at"].items()}
        return ledger

    @property
    def schema(self) -> str:
        return f"k1 long, k2 long, copies long, first_at timestamp, first_id {self.id_type}"

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.at.values())

    def table(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The ledger, or the buckets asked for."""
        want = self.at if buckets is None else [b for b in buckets if b in self.at]
        paths = [f"{self.folder}/v{self.at[b][0]:08d}/bucket={b}" for b in want]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def add(self, batch: DataFrame) -> list[int]:
        """Merge a batch of (k1, k2, at, id) rows and return the buckets that were written."""
        fresh = batch.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct(F.col("at").isNull().alias("late"), "at", "id")).alias("f"))
        fresh = stage(fresh.select("k1", "k2", "n", F.col("f.at").alias("at"), F.col("f.id").alias("id")), "ledger-batch")
        home = lambda n: F.pmod(F.col("k1"), F.lit(n)).cast("int").alias("bucket")
        buckets = max(self.buckets, 1)
        sizes = {r[0]: r[1] for r in fresh.groupBy(home(buckets)).count().collect()}  # at most ``buckets`` numbers
        if not sizes:
            unstage(fresh)
            return []
        while self.rows + sum(sizes.values()) > 2 * buckets * self.bucket_rows:
            buckets *= 2
        split = buckets != self.buckets
        touched, bucket = list(range(buckets)) if split else sorted(sizes), home(buckets)
        old = self.table() if split else self.table(touched)
        both = fresh.join(old, ["k1", "k2"], "full_outer")
        earlier = F.least(
            F.when(F.col("copies").isNotNull(), F.struct(F.col("first_at").isNull().alias("late"), F.col("first_at").alias("at"), F.col("first_id").alias("id"))),
            F.when(F.col("n").isNotNull(), F.struct(F.col("at").isNull().alias("late"), F.col("at").alias("at"), F.col("id").alias("id"))),
        )
        merged = both.select("k1", "k2", (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"), earlier.alias("f"))
        merged = merged.select("k1", "k2", "copies", F.col("f.at").alias("first_at"), F.col("f.id").alias("first_id"), bucket)
        version = self.version + 1
        path = f"{self.folder}/v{version:08d}"
        # one file a bucket; what a failed attempt at this version left is overwritten
        merged.repartition(len(touched), "bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)
        written = {r[0]: (version, r[1]) for r in self.spark.read.schema(f"{self.schema}, bucket int").parquet(path).groupBy("bucket").count().collect()}
        stale = [(b, v) for b, (v, _) in self.at.items() if split or b in sizes]
        kept = {b: x for b, x in self.at.items() if not (split or b in sizes)}
        self.version, self.buckets, self.at = version, buckets, kept | written
        self._note()
        unstage(fresh)
        for b, v in stale:  # named by no manifest but older ones
            remove(self.spark, f"{self.folder}/v{v:08d}/bucket={b}")
        return sorted(written)

    def _note(self) -> None:
        """Write the manifest under another name first, so that it is there as a whole or not at all."""
        fs, path = file_system(self.spark, f"{self.folder}/manifest/v{self.version:08d}")
        _, draft = file_system(self.spark, f"{self.folder}/manifest/draft-{self.version:08d}")
        out = fs.create(draft, True)
        out.write(json.dumps({"version": self.version, "buckets": self.buckets, "id_type": self.id_type, "at": self.at}).encode())
        out.close()
        fs.rename(draft, path)


@dataclass
class Copies:
    """``keys``: (id, k1, k2) of every record; ``ledger``: one row per distinct record."""

    keys: DataFrame
    ledger: DataFrame


def collapse(df: DataFrame, id_col: str, title_col: str, body_col: str, at_col: str, batches: int = 3, folder: str | None = None) -> Copies:
    """Collapse records equal but for formatting, arriving in batches by ``at_col``.

    The texts are read once; batches are equal spans of the arrival times, merged one
    after another into the ledger as separate loads would be. A ledger in ``folder`` goes on
    from what it holds and stays there; without a folder it goes when the application ends.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(at_col).cast("timestamp").alias("at"), F.col(title_col).alias("t"), F.col(body_col).alias("b"))
    # where the key is not null; asked of the key, it would be made once for the question and once more
    rows = composed(rows.where(F.length("b") > 0), "t", "b").select("id", "at", canonical_key("t", "b").alias("k"))
    keys = stage(rows.select("id", "at", "k.k1", "k.k2"), "copy-keys")
    lo, hi = keys.agg(F.min(F.unix_micros("at")), F.max(F.unix_micros("at"))).first()
    ledger = CopyLedger.open(spark, folder or f"{work_dir(spark)}/copy-ledger-{uuid.uuid4().hex}", id_type=dict(df.dtypes)[id_col])
    span = max(1, ((hi or 0) - (lo or 0)) // batches + 1)
    number = F.coalesce(F.floor((F.unix_micros("at") - F.lit(lo or 0)) / span), F.lit(batches - 1))
    for n in range(batches):
        ledger.add(keys.where(number == n))
    return Copies(keys, ledger.table())
