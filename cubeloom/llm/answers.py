"""Answers brought back to the rows that asked, though one key may hold a third of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with this share of all rows or more is hot. So many keys are hot at most, which bounds what is broadcast.
HOT_SHARE = 100_000


def answered(rows: DataFrame, answers: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows with the columns of answers (one row for each key at most; null keys meet), null where there is none.

    weight: the column of answers with the number of rows of its key, total the number of all rows. Hot keys, of which there are
    HOT_SHARE at most, are broadcast; all others have few rows each and meet in a shuffled join.
    """
    own = [c for c in answers.columns if c != key]
    named = answers.withColumnRenamed(key, "__key")
    is_hot = F.col(weight) * HOT_SHARE >= total
    meets = F.col(key).eqNullSafe(F.col("__key"))
    hot, rest = F.broadcast(named.where(is_hot)), named.where(~is_hot)
    warm = rows.join(hot, meets, "inner").select(*rows.columns, *own)
    cold = rows.join(hot, meets, "left_anti").join(rest, meets, "left").select(*rows.columns, *own)
    return warm.unionByName(cold)
