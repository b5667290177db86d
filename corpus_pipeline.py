"""From raw documents to token digests: quality, exact and near duplicates, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run writes each result as Parquet to the shared folder and reads it
again. Stages decide on the rows they get, whatever other columns those have. No stage takes
rows for one because of their ids: ids may be null or repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterloom.llm import oddsketch, piece_bpe, raking, recipes, weaksup
from utterloom.llm.queries import tokenizer_path
from utterloom.llm.util import materialise, optional_table, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A verdict is the text's own, so rows that repeat an id or have none each get theirs."""
    good = weaksup.good_rows(docs, optional_table(spark, sf_dir, "labels")).withColumnRenamed("doc_id", "__id").withColumnRenamed("__text", "__digest")
    return docs.join(good, docs["doc_id"].eqNullSafe(good["__id"]) & (weaksup.text_digest() == good["__digest"]), "left_semi")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with `__row`, a number of its own for each row. Written, since a second run may number rows otherwise."""
    return materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed")


def _order() -> list:
    """Which of equal rows stays: the smallest id, null ids last, then the row's number."""
    return [F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row")]


def _only(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of keyed whose number is in rows (column row), as they came in."""
    return keyed.join(rows, keyed["__row"] == rows["row"], "left_semi").drop("__row")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    groups = recipes.exact_groups(keyed.select("text", F.struct(*_order()).alias("key")), id_col="key")
    return _only(keyed, groups.filter("kept").select("doc_id.row"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    groups = oddsketch.near_groups(keyed, width=5, percent=80, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
    first = keyed.select("doc_id", "__row").join(groups, "__row").groupBy("component_id").agg(F.min(F.struct(*_order())).alias("key"))
    return _only(keyed, first.select("key.row"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return raking.sample(docs, optional_table(spark, sf_dir, "labels"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_digests(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing sources", mixture),
    ("piece encoding", encoding),
]

#: SQL has no piece encoding; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs
