"""Joins to a table whose keys may be very unevenly held."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than one row in so many are hot; there can't be more than so many of them.
HOT = 10_000


def counted_join(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined to `table`, in which `key` is unique and `count` tells how many of rows hold it.

    A key held by more than one row in HOT goes by broadcast, and there are at most HOT of these; all others are shuffled, so no task
    holds a key of more rows than that. table should be a checkpoint, since it is read several times.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = table.where(F.col(count) * HOT > total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(table.where(F.col(count) * HOT <= total), key))
