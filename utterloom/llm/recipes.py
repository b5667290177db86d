"""Exact deduplication by content-defined chunk recipes.

Each normalised text falls into short units that end with punctuation or certain letters. A
chunk ends where the digest of two units in a row has a certain remainder: at places that the
text around them sets and nothing else, so that texts which share a passage share its chunks
wherever it stands. A chunk's 64-bit digest is its identifier once a table of distinct
(digest, chunk) pairs has shown that no other chunk has it. Texts are equal when their ordered
identifier lists are. Only distinct chunks are moved, once; after that the lists stand for the
texts. Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import materialise, without_space

#: Units: up to UNIT characters, the last of ENDS: punctuation, and two letters that end one in about twenty Latin characters.
#: Few kinds, since every character is tested for them: with all Unicode punctuation and letters of five scripts this took three times as long.
UNIT, ENDS = 128, ".,;:!?bv、-。"
#: One in EVERY places ends a chunk; a text without such places is one chunk.
EVERY = 32


def chunks_of(c, every: int = EVERY):
    """Chunks of a text column, in order; together they are the text."""
    units = F.regexp_extract_all(c, F.lit(rf"(?s)[^{ENDS}]{{0,{UNIT - 1}}}[{ENDS}]|[^{ENDS}]{{1,{UNIT}}}"), F.lit(0))

    #: A lambda's argument is computed once, however often it is read.
    return F.get(F.transform(F.array(units), lambda u: F.get(F.transform(F.array(_ends(u, every)), lambda e: _joined(u, e)), 0)), 0)


def _ends(u, every: int):
    """Number of units up to the end of each chunk."""
    end = lambda x, i: (F.pmod(F.xxhash64(F.get(u, i - 1), x), F.lit(every)) == 0) | (i == F.size(u) - 1)
    return F.filter(F.transform(u, lambda x, i: F.when(end(x, i), i + 1)), lambda e: e.isNotNull())


def _joined(u, ends):
    before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
    return F.transform(ends, lambda e, i: F.array_join(F.slice(u, before(i) + 1, e - before(i)), ""))


def clashing(chunks: DataFrame) -> DataFrame:
    """Digests that two different chunks share (columns id, chunk in; id out)."""
    return chunks.select("id", "chunk").distinct().groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null counts as empty, so
    null, empty and blank texts form one group. The row with the most code points
    in its original text stays, then the smallest id (null ids last), of rows that
    are alike in both any one. Rows that repeat an id count as rows of the group.
    Other input columns are ignored. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = base.select("doc_id", F.length("t").alias("n_code"), without_space(F.col("t")).alias("norm"))
    cut = base.select("doc_id", "n_code", "norm", chunks_of(F.col("norm")).alias("chunks"))
    pairs = cut.select(F.explode("chunks").alias("chunk")).select(digest("chunk").alias("id"), "chunk")
    #: Normally empty: the check that makes identifiers verified ones.
    doubtful = clashing(pairs).limit(1).count() > 0
    one = (lambda c: F.concat_ws(":", digest(c).cast("string"), F.sha2(c, 512))) if doubtful else (lambda c: digest(c))
    rows = cut.select("doc_id", "n_code", F.transform("chunks", one).alias("recipe"), F.sha2("norm", 256).alias("text_sha256"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "recipes")
    best = F.min(F.struct((-F.col("n_code")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row"))
    groups = rows.groupBy("recipe").agg(F.count("*").alias("group_size"), best.alias("best"))
    #: A table of its own: the join can then split the rows of a very large group.
    groups = materialise(groups.select(F.col("recipe").alias("r"), "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row")), "groups")
    out = rows.join(groups, rows["recipe"] == groups["r"])
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
