"""Session helpers: shared work folder, staged tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a staged table of narrow rows (a few longs) may be broadcast, and bytes of its files.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20

_cleanup: set[str] = set()
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, for those that do not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    path = f"{work_dir(spark)}/loomline.zip"
    fs, at = file_system(spark, path)
    out = fs.create(at, True)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def work_dir(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``; a local one only where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("loomline.work.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("loomline.work.dir", base)
    path = f"{base.rstrip('/')}/loomline-{spark.sparkContext.applicationId}"
    if path not in _cleanup:
        _cleanup.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM may be gone already
        pass


def file_system(spark: SparkSession, path: str):
    """(file system, path) of a name in the shared file system."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    fs, jvm_path = file_system(spark, path)
    fs.delete(jvm_path, True)


def stage(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage and survives the loss of any executor; later steps re-read the
    files instead of recomputing. The folder goes when the application ends. ``free``
    lets the driver notice now that the shuffle files behind the table are not needed any more.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if free:
        spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table whose last reader has been written."""
    if path := getattr(df, "_staged_at", None):
        remove(df.sparkSession, path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, known: int | None = None) -> DataFrame:
    """Broadcast hint for a staged table of at most ``rows`` rows and BROADCAST_BYTES, else the table as it is.

    Beyond the bound Spark joins by shuffle; the rows are the same either way.
    """
    n = df.count() if known is None else known
    return F.broadcast(df) if n <= rows and plan_bytes(df) <= BROADCAST_BYTES else df


def by_shuffle(df: DataFrame) -> DataFrame:
    """A hint that a growing table is joined by sorted shuffle.

    Spark estimates its size from compressed files, whatever is parsed, exploded or made of their rows,
    and would send it through the driver's memory on that estimate.
    """
    return df.hint("merge")


def plan_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of a table: for a staged one, of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def expand_pairs(members: DataFrame, key: str, item: str, fragment: int = 256) -> DataFrame:
    """All pairs ``a < b`` of ``item`` within equal ``key`` without one task per group.

    A group of n members is cut into ceil(n / fragment) fragments by the hash of the
    item; each pair of fragments is one join key, so a key holding a third of all rows
    is spread over many tasks of about ``fragment`` squared pairs each.
    Null keys and null items pair with nothing. Repeated (key, item) rows count once.
    """
    rows = members.where(F.col(key).isNotNull() & F.col(item).isNotNull()).select(F.col(key).alias("_k"), F.col(item).alias("_i")).distinct()
    sizes = rows.groupBy("_k").agg(F.count("*").alias("_n")).where("_n > 1").select("_k", F.ceil(F.col("_n") / fragment).cast("int").alias("_f"))
    rows = rows.join(sizes, "_k").withColumn("_b", F.pmod(F.xxhash64("_i"), F.col("_f")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("_f") - 1), lambda o: F.struct(F.least(o, F.col("_b")).alias("lo"), F.greatest(o, F.col("_b")).alias("hi")))
    spread = rows.select("_k", "_i", "_b", F.explode(cells).alias("_c"))
    left = spread.where("_b = _c.lo").select("_k", F.col("_c.lo").alias("_lo"), F.col("_c.hi").alias("_hi"), F.col("_i").alias("_l"))
    right = spread.where("_b = _c.hi").select("_k", F.col("_c.lo").alias("_lo"), F.col("_c.hi").alias("_hi"), F.col("_i").alias("_r"))
    pairs = left.join(right, ["_k", "_lo", "_hi"]).where((F.col("_lo") < F.col("_hi")) | (F.col("_l") < F.col("_r")))
    return pairs.select(F.col("_k").alias(key), F.least("_l", "_r").alias("a"), F.greatest("_l", "_r").alias("b"))
