"""Distinct rows without a table of all of a task's rows before the exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame


def once(df: DataFrame) -> DataFrame:
    """df.distinct(), with rows dealt by all columns first. Lifted or compressed input gives one task millions of rows that
    hardly repeat: a hash table of them before the exchange is as large as the task's rows and spares nothing."""
    return df.repartition(*df.columns).distinct()
