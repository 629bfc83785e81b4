"""Left joins with a table of one row a key, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is a hub with more rows than ``MANY`` and than one in ``HUBS`` of all, so there are fewer than ``HUBS`` of them.
MANY, HUBS = 1000, 1000


def hub_bound(total: int) -> int:
    """Rows of a key beyond which it is a hub."""
    return max(MANY, total // HUBS)


def looked_up(rows: DataFrame, table: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a key at most), null where the key is not there.

    ``size`` is the column of ``table`` with the number of rows of a key among
    the ``total`` of ``rows``; it is not returned.  Hubs are broadcast, which
    are fewer than ``HUBS`` rows; all other keys meet in a join by shuffle.
    Rows whose (first) key is null are not shuffled.
    """
    keys, bound = [key] if isinstance(key, str) else key, hub_bound(total)
    added = [c for c in table.columns if c not in (*keys, size)]
    hubs = table.where(F.col(size) > bound).select(*keys, *(F.col(c).alias(f"{c}__hub") for c in added), F.lit(True).alias("is__hub"))
    marked = rows.join(F.broadcast(hubs), keys, "left")
    there = marked.where(F.col("is__hub") | F.col(keys[0]).isNull()).select(*rows.columns, *(F.col(f"{c}__hub").alias(c) for c in added))
    rest = marked.where(F.col("is__hub").isNull() & F.col(keys[0]).isNotNull()).select(*rows.columns)
    few = table.where(F.col(size) <= bound).drop(size)
    return there.unionByName(rest.join(few.hint("merge"), keys, "left").select(*there.columns))
