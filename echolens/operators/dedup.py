"""Exact deduplication.

Only (md5, id) pairs are shuffled, combined on the map side, so a text copied millions of times
costs one row per task. The full rows meet nothing but the list of repeated texts; when that
list is small AQE broadcasts it and no text moves, and when it is large a hot text is split by
the skew join.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_key(text: Column) -> Column:
    """md5 of the raw text; null texts share one key."""
    return F.coalesce(F.md5(text), F.lit(""))


def duplicate_groups(df: DataFrame, text="text", id_col="msg_id") -> DataFrame:
    """``(key, n, first_id)`` of every text that occurs more than once."""
    return (df.select(text_key(F.col(text)).alias("key"), id_col)
              .groupBy("key").agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"))
              .where(F.col("n") > 1))


def flag_duplicates(df: DataFrame, text="text", id_col="msg_id", out="is_dup") -> DataFrame:
    """Mark all rows of a text but one: one with the lowest id stays, a null id being the lowest.

    Rows that share text and lowest id, such as messages sent again, are numbered among themselves; no
    other row is ever sorted.
    """
    key, first, is_tied = (_unused(df, c) for c in ("_key", "_first", "_tied"))
    per_id = (df.select(text_key(F.col(text)).alias(key), F.col(id_col).alias("_id"))
                .groupBy(key, "_id").agg(F.count("*").alias("_n")))
    groups = (per_id.groupBy(key).agg(F.sum("_n").alias("_all"),
                                      F.min(F.struct("_id", "_n")).alias("_least"))
                    .where(F.col("_all") > 1)
                    .select(key, F.col("_least._id").alias(first),
                            (F.col("_least._n") > 1).alias(is_tied)))
    keyed = df.withColumn(key, text_key(F.col(text)))
    lowest = F.col(first).eqNullSafe(F.col(id_col))
    among = Window.partitionBy(key).orderBy(key)
    clear = (keyed.join(groups, key, "left")
                  .where(F.col(is_tied).isNull() | ~F.col(is_tied) | ~lowest)
                  .withColumn(out, F.col(is_tied).isNotNull() & ~lowest))
    tied = (keyed.join(groups.where(is_tied), key).where(lowest)
                 .withColumn(out, F.row_number().over(among) > 1))
    return clear.unionByName(tied).drop(key, first, is_tied)


def _unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def dedup_exact(df: DataFrame, text="text", id_col="msg_id") -> DataFrame:
    """Keep one row per text, one with the lowest id; a table without the column is unchanged."""
    if text not in df.columns:
        return df
    flag = _unused(df, "_dup")
    return flag_duplicates(df, text, id_col, flag).where(~F.col(flag)).drop(flag)


def duplicate_count(df: DataFrame, text="text") -> DataFrame:
    """Rows that repeat an earlier value; distinct texts are counted by key, in two steps."""
    per_key = (df.select(text_key(F.col(text)).alias("key")).groupBy("key")
                 .agg(F.count("*").alias("n")))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                       F.count("*").alias("n_distinct"),
                       F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))
