"""Helpers shared by the operators: table reading and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark (Java regex) class of the white space that separates words: [\x20\x09-\x0D].
SPACE = r"[ \t-\r]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def optional_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """The table, or None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return table(spark, sf_dir, name) if sf_dir and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where none is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="utterloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts lineage and survives the loss of executors. The folder goes when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/utterloom-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialise that no plan reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(c):
    """A-Z to a-z, all other characters unchanged."""
    return F.translate(c, UPPER, LOWER)


def without_space(c):
    return F.translate(c, SPACE_CHARS, "")


def words_of(c):
    """Words `[^\\x20\\x09-\\x0D]+` of a text column; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), f"{SPACE}+"), "")


#: Bytes of text for each partition of an exchange of digests.
PART_BYTES = 32 << 20


def parts_for(spark: SparkSession, size: int) -> int:
    """Partitions for an exchange over size bytes of text: the session's number, more where a share would exceed PART_BYTES."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


@dataclass
class Census:
    """Rows and bytes of text, smallest and largest id, and whether ids are missing or repeat."""

    rows: int
    size: int
    low: int
    high: int
    plain: bool


def per_id(d: DataFrame) -> DataFrame:
    """doc_id, n, b: rows and bytes of text of each id of d (doc_id, raw)."""
    return d.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("raw")).alias("b"))


def census(d: DataFrame) -> Census:
    odd = (F.col("n") > 1) | F.col("doc_id").isNull()
    r = per_id(d).agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.when(odd, 1)).alias("odd")).first()
    return Census(int(r["n"] or 0), int(r["b"] or 0), int(r["low"] or 0), int(r["high"] or 0), not r["odd"])


def keyed(d: DataFrame, c: Census) -> DataFrame:
    """key, doc_id, raw, copies: a number for each different (id, text) of d (doc_id, raw), and how many rows there are of it.

    The key is the id where all ids are there and differ. Else rows without an id, or with one that
    repeats, get numbers beyond all ids, from a written table of their ids and 128-bit text digests.
    """
    if c.plain:
        return d.select(F.col("doc_id").alias("key"), "doc_id", "raw", F.lit(1).cast("long").alias("copies"))
    odd = per_id(d).filter((F.col("n") > 1) | F.col("doc_id").isNull()).select(F.col("doc_id").alias("id"))
    marked = d.withColumn("digest", F.unhex(F.md5(F.coalesce("raw", F.lit("").cast("binary")))))
    mine = marked.join(odd, marked["doc_id"].eqNullSafe(odd["id"])).groupBy("id", "digest").agg(F.count("*").alias("copies"))
    #: Below all ids if there is no room above them.
    number = F.lit(c.high + 1) + F.monotonically_increasing_id() if c.high < 1 << 62 else F.lit(c.low - 1) - F.monotonically_increasing_id()
    mine = materialise(mine.select("id", F.col("digest").alias("own"), "copies", number.alias("number")), "keys")
    out = marked.join(mine, marked["doc_id"].eqNullSafe(mine["id"]) & (marked["digest"] == mine["own"]), "left")
    return out.select(F.coalesce("number", "doc_id").alias("key"), "doc_id", "raw", F.coalesce("copies", F.lit(1)).alias("copies"))
