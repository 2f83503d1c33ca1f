"""Joins whose keys may hold a large part of all rows.

Keys with more than their share of the rows are dealt over several salts.  There
are at most ``KEYS_A_TASK`` such keys for each shuffle partition, however the
rows lie, so their list may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it has more than one part in this many of an average task's rows.
KEYS_A_TASK = 4
SALT = "__salt"


def hot_keys(counts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``keys`` and ``salts`` of the hot ones; ``counts`` has a column ``count`` for each key, ``total`` is the sum of all."""
    tasks = KEYS_A_TASK * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, total // tasks)
    hot = counts.where(F.col("count") > share)
    return F.broadcast(hot.select(*keys, F.ceil(F.col("count") / share).cast("int").alias("salts")))


def dealt(rows: DataFrame, hot: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``rows`` with a salt that spreads each hot key by a hash of the columns ``by``."""
    marked = rows.join(hot, keys, "left")
    return marked.withColumn(SALT, F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("salts")).cast("int"))).drop("salts")


def copied(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (one for each key) once for each salt that :func:`dealt` may give its key."""
    marked = rows.join(hot, keys, "left")
    return marked.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
