"""Rows that were delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_delivery(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first by ``order``, which should end in the columns that differ.

    Rows with a null in the key are kept, each as a row of its own: without an identifier
    nothing shows that they are copies. The limit of one row a key is applied before the
    shuffle too, so an identifier that was delivered very often doesn't fill one task.
    """
    known = F.lit(True)
    for c in key:
        known = known & F.col(c).isNotNull()
    w = Window.partitionBy(*key).orderBy(*order)
    nth = "__nth"
    while nth in df.columns:
        nth += "_"
    ranked = df.filter(known).withColumn(nth, F.row_number().over(w)).filter(F.col(nth) == 1).drop(nth)
    nullable = any(df.schema[c].nullable for c in key)
    return ranked.unionByName(df.filter(~known)) if nullable else ranked
