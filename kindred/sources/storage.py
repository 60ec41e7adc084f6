"""Shared storage for cut lineage and for the engine's own files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster. Only where that is unset
    and the session is a local one (tests) a temporary folder is chosen and
    remembered in the session; on a cluster executors would not see it, which
    is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kindred-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return path.getFileSystem(conf).makeQualified(path).toString().rstrip("/")  # a path alone means the cluster's own file system


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kindred/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Delete every table and file that this application wrote to the shared folder, once their results are no longer read."""
    _delete(spark, f"{shared_dir(spark)}/kindred/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage with replicated storage behind it, so that a lost
    executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")  # the table replaces the shuffle files it was made from
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kindred_path = path  # remembered for discard()
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that no later plan reads."""
    path = getattr(df, "_kindred_path", None)
    if path:
        _delete(df.sparkSession, path)


def spread_join(big: DataFrame, keyed: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which a key that very many rows of ``big`` hold can be split over tasks.

    ``keyed`` has at most one row a key and often comes straight from an
    aggregation by it. Its partitioning would then be used as it is, and Spark
    splits skewed partitions only between two fresh exchanges; a second key
    that follows from the first asks for these.
    """
    tag = F.xxhash64(*keys)
    return big.withColumn("_tag", tag).join(keyed.withColumn("_tag", tag), [*keys, "_tag"], how).drop("_tag")


#: Parts that the rows of one key are dealt to.
SALTS = 16


def salted_join(big: DataFrame, keyed: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Inner join with a small ``keyed`` table, at most one row a key, where few keys may hold most rows of ``big``.

    Rows of a key are dealt to :data:`SALTS` parts by their ``by`` column and
    ``keyed`` is repeated for each, so no part depends on adaptive splitting.
    """
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    every = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(every, [*keys, "_salt"]).drop("_salt")
