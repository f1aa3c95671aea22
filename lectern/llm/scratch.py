"""Tables in shared storage, and which of them are small enough to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.storage import discard, folder, stored

__all__ = ["discard", "folder", "joined", "small", "stored"]


#: Bytes of a table that is sent whole to every executor, at most.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, rows: int, width: int) -> DataFrame:
    """df marked for broadcast if its counted rows, of so many bytes each, are within BROADCAST_BYTES; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


#: Rows of a key from which its row is sent to the rows instead of the rows to it; a table has its rows over this many such keys at most.
HOT_ROWS = 100_000


def joined(rows: DataFrame, table: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """rows joined to table, which has one row a key and in column n how many rows the key has.

    Keys of more than HOT_ROWS rows are broadcast, so that no task gets all rows of one; the other keys are shuffled. how: inner or left.
    """
    hot = F.col("n") > HOT_ROWS
    many = F.broadcast(table.where(hot))
    rest = rows.join(F.broadcast(table.where(hot).select(*key)), key, "left_anti")
    return rows.join(many, key).unionByName(rest.join(table.where(~hot), key, how))
