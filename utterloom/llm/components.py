"""Connected components of an edge table, by DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import discard, materialise


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of the edges (columns a, b).

    Each round links every node's neighbours to the smallest one (larger ones first, then all),
    which halves the distances; partial sums keep a node with very many edges spread out. The
    number of rounds grows with the logarithm of the longest path. Tables go to the shared folder.
    """
    now = materialise(_clean(edges), "edges")
    for _ in range(most_rounds):
        large = _star(now, larger=True)
        small = _star(large, larger=False)
        new = materialise(small, "edges")
        # stable: every edge leads to a smallest node that leads nowhere
        odd = new.join(new.select(F.col("a").alias("b"), F.lit(1).alias("x")).distinct(), "b", "left_semi").limit(1).count()
        discard(now)
        now = new
        if not odd:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
    raise RuntimeError("components did not settle")


def _clean(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller node, once each."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """larger: each node's larger neighbours are linked to its smallest (itself included); else its smaller ones and itself."""
    if larger:
        near = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
    else:
        near = edges.select(F.col("a").alias("n"), F.col("b").alias("m"))
    least = near.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("to"))
    both = near.join(least, "n")
    if larger:
        out = both.filter("m > n").select(F.col("m").alias("a"), F.col("to").alias("b"))
    else:
        out = both.select(F.col("m").alias("a"), F.col("to").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("to").alias("b")))
    return _clean(out)
