"""Help for the optimiser."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(c: Column) -> Column:
    """c, computed once per row.

    The optimiser copies a column's expression into filters it pushes down (an explode alone brings
    one) and so into the lambdas of later expressions, where it runs once per element. A condition that
    always holds but is not deterministic keeps it where it is.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c computed once however often use reads it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def spread(df: DataFrame) -> DataFrame:
    """df evenly over all cores: for rows that are few but take long.

    A file may have more splits than cores and all its rows in one of them (a Parquet file with one row group has).
    """
    cores = max(1, df.sparkSession.sparkContext.defaultParallelism)
    #: Whole rounds: one task more than cores would take as long as twice the cores.
    return df.repartition(cores * max(1, -(-df.rdd.getNumPartitions() // cores)))
