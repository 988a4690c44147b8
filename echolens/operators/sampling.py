"""Exact, repeatable samples and splits.

Rows are ranked by md5(seed, id) within a stratum; a null label is a stratum of its own. A rank is never computed by
sorting a stratum in one task. The table is read once for a narrow table of labels and hashes. On that, a histogram by
hash prefix tells in which bucket a quota ends, and only that bucket is refined, level by level, until it is
small enough to be ranked; how many digits a level adds follows from the rows still inside. What remains is one
threshold per stratum, and choosing the rows is a comparison while the table is read a second time.
Rows with equal ids have equal hashes and stay or go together.
"""

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolens.sources.shared import write_and_read

HASH_DIGITS = 32
LEVEL_DIGITS = 3   # most digits a level adds, for 4096 buckets in one window
LEAST = 4096       # rows that are ranked without another level


def hash_key(id_col: str, seed) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def hash_keys(df: DataFrame, id_col: str, *columns: str, seed=42) -> DataFrame:
    """``(columns, _h)`` of all rows, written once."""
    return write_and_read(df.select(*columns, hash_key(id_col, seed).alias("_h")), "keys")


def hash_cutoffs(keys: DataFrame, stratum: str, quotas: DataFrame, least=LEAST) -> DataFrame:
    """``(stratum, cut, cutoff)``: the hash of the quota-th row of each stratum of ``hash_keys``.

    ``quotas(stratum, cut, quota)`` holds one row per label and cut, with quotas no larger than the stratum.
    A level's histogram has a row per bucket of the quotas' own buckets, at most 4096 per label and cut.
    """
    edges = quotas.where("quota > 0").select(F.col(stratum).alias("_s"), "cut", F.lit("").alias("_prefix"),
                                             F.col("quota").alias("_rank"))
    inside, digits = keys.groupBy(stratum).count().agg(F.max("count")).first()[0] or 0, 0
    while digits < HASH_DIGITS:
        more = min(LEVEL_DIGITS, ceil(log(inside / least, 16))) if inside > least else HASH_DIGITS
        rows = keys.join(edges, keys[stratum].eqNullSafe(edges["_s"])
                         & (F.substring("_h", 1, digits) == F.col("_prefix")))
        digits = min(digits + more, HASH_DIGITS)
        before = Window.partitionBy("_s", "cut").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        buckets = (rows.groupBy("_s", "cut", "_rank", F.substring("_h", 1, digits).alias("_next"))
                   .agg(F.count("*").alias("_n"))
                   .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
        edges = write_and_read(
            buckets.where((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_n")))
            .select("_s", "cut", F.col("_next").alias("_prefix"), (F.col("_rank") - F.col("_before")).alias("_rank"),
                    "_n"), "edges")
        inside = edges.agg(F.max("_n")).first()[0] or 0
    return edges.select(F.col("_s").alias(stratum), "cut", F.col("_prefix").alias("cutoff"))


def mark_cuts(df: DataFrame, id_col: str, stratum: str, cutoffs: DataFrame, cuts: dict[str, str], seed=42) -> DataFrame:
    """Add a flag for each cut in ``cuts``, which names its column: true for the rows inside it."""
    limits = cutoffs.groupBy(F.col(stratum).alias("_s")).agg(*[
        F.max(F.when(F.col("cut") == cut, F.col("cutoff"))).alias(f"_limit_{cut}") for cut in cuts])
    return (df.join(limits, df[stratum].eqNullSafe(limits["_s"]), "left")
              .withColumns({out: F.coalesce(hash_key(id_col, seed) <= F.col(f"_limit_{cut}"), F.lit(False))
                            for cut, out in cuts.items()})
              .drop("_s", *[f"_limit_{cut}" for cut in cuts]))


def _sizes(df: DataFrame, stratum: str) -> DataFrame:
    """Rows per stratum and in total; one row per label from here on."""
    everything = Window.partitionBy(F.lit(1))
    return (df.groupBy(stratum).agg(F.count("*").alias("n"))
              .withColumn("total", F.sum("n").over(everything)))


def mark_priority(df: DataFrame, id_col="msg_id", ratio=0.20, seed=42) -> DataFrame:
    """Add ``stratum`` and ``in_sample``: all urgent claims, half of the medium claims (at least 50), and other messages up to the
    ratio (at least 50). When only low-urgency claims exist, 100 of them are taken.

    Claims are told by ``is_claim = 'oui'``; the original compares the same column with 1 and 0
    and never selects by stratum.
    """
    claim = F.col("is_claim") == "oui"
    stratum = (F.when(claim & (F.col("urgence") == "haute"), "urgent")
                .when(claim & (F.col("urgence") == "moyenne"), "medium")
                .when(claim, "low").otherwise("rest"))
    tagged = df.withColumn("stratum", stratum)
    everything = Window.partitionBy(F.lit(1))
    of = lambda name, col: F.sum(F.when(F.col("stratum") == name, F.col(col))
                                 .otherwise(0)).over(everything)
    n = F.col("n")
    half = F.least(F.greatest(F.floor(n / 2), F.lit(50)), n)
    keys = hash_keys(tagged, id_col, "stratum", seed=seed)
    quotas = (_sizes(keys, "stratum")
              .withColumn("first", F.when(F.col("stratum") == "urgent", n)
                                    .when(F.col("stratum") == "medium", half).otherwise(0))
              .withColumn("taken", F.sum("first").over(everything))
              .withColumn("others", of("urgent", "n") + of("medium", "n") + of("rest", "n"))
              .select("stratum", F.lit("sample").alias("cut"),
                      F.when(F.col("stratum") == "rest", F.least(n, F.greatest(
                          F.floor(F.col("total") * F.lit(ratio)) - F.col("taken"), F.lit(50))))
                       .when(F.col("stratum") == "low",
                             F.when(F.col("others") == 0, F.least(n, F.lit(100))).otherwise(0))
                       .otherwise(F.col("first")).alias("quota")))
    cutoffs = hash_cutoffs(keys, "stratum", quotas)
    return mark_cuts(tagged, id_col, "stratum", cutoffs, {"sample": "in_sample"}, seed)


def sample_priority(df: DataFrame, id_col="msg_id", ratio=0.20, seed=42) -> DataFrame:
    return mark_priority(df, id_col, ratio, seed).where("in_sample").drop("in_sample")


def mark_diverse(df: DataFrame, id_col="msg_id", ratio=0.20, minimum=100, seed=42) -> DataFrame:
    """Add ``stratum`` and ``in_sample``: ``max(minimum, ratio * n)`` rows: claims first, then equal shares per sentiment, then any.

    Ties are cut by hash, so the result is the same on every run. Rows without a sentiment are one more kind, with
    a null ``stratum``.
    """
    tagged = df.withColumn("stratum", F.when(F.col("is_claim") == "oui", "claim")
                           .otherwise(F.concat(F.lit("s:"), F.col("sentiment"))))
    keys = hash_keys(tagged, id_col, "stratum", "sentiment", seed=seed)
    everything = Window.partitionBy(F.lit(1))
    # the share counts every sentiment present, claims included
    kinds = keys.groupBy("sentiment").count().agg(F.count("*").alias("kinds"))
    n, size = F.col("n"), F.col("size")
    sizes = (_sizes(keys, "stratum")
             .withColumn("size", F.greatest(F.lit(minimum), F.floor(F.col("total")
                                                                    * F.lit(ratio))))
             .withColumn("claims", F.sum(F.when(F.col("stratum") == "claim", n).otherwise(0))
                         .over(everything)))
    share = F.floor(F.greatest(size - F.col("claims"), F.lit(0)) / kinds.scalar())
    sizes = (sizes.withColumn("quota", F.when(F.col("stratum") == "claim", F.least(n, size))
                              .otherwise(F.least(n, share)))
                  .withColumn("missing", size - F.sum("quota").over(everything)))
    quotas = sizes.select("stratum", F.lit("sample").alias("cut"), "quota")
    cutoffs = hash_cutoffs(keys, "stratum", quotas)
    # fill from what is left, as one stratum
    limits = cutoffs.select(F.col("stratum").alias("_s"), F.col("cutoff").alias("_limit"))
    rest = (keys.join(limits, keys["stratum"].eqNullSafe(limits["_s"]), "left")
            .where(F.col("_limit").isNull() | (F.col("_h") > F.col("_limit")))
            .select(F.lit("fill").alias("fill"), "_h"))
    fill_quota = (sizes.agg(F.max("missing").alias("missing"),
                            F.sum(n - F.col("quota")).alias("left"))
                       .select(F.lit("fill").alias("fill"), F.lit("fill").alias("cut"),
                               F.least("missing", "left").alias("quota")))
    fill = hash_cutoffs(rest, "fill", fill_quota).agg(F.max("cutoff")).scalar()
    filled = F.coalesce(hash_key(id_col, seed) <= fill, F.lit(False))
    return (mark_cuts(tagged, id_col, "stratum", cutoffs, {"sample": "_in"}, seed)
            .withColumn("in_sample", F.col("_in") | filled).drop("_in"))


def sample_diverse(df: DataFrame, id_col="msg_id", ratio=0.20, minimum=100, seed=42) -> DataFrame:
    return mark_diverse(df, id_col, ratio, minimum, seed).where("in_sample").drop("in_sample")


def stratified_split(df: DataFrame, id_col: str, label: str, train=0.70, validation=0.15,
                     seed=42) -> DataFrame:
    """Add ``split``: exact shares of every label, by hash order; a null label is a label."""
    keys = hash_keys(df, id_col, label, seed=seed)
    share = lambda s: F.round(F.col("n") * F.lit(s)).cast("bigint")
    quotas = keys.groupBy(label).agg(F.count("*").alias("n")).select(label, F.inline(F.array(
        F.struct(F.lit("train").alias("cut"), share(train).alias("quota")),
        F.struct(F.lit("validation").alias("cut"),
                 share(train + validation).alias("quota")))))
    marked = mark_cuts(df, id_col, label, hash_cutoffs(keys, label, quotas),
                       {"train": "_train", "validation": "_validation"}, seed)
    return (marked.withColumn("split", F.when(F.col("_train"), "train")
                              .when(F.col("_validation"), "validation").otherwise("test"))
                  .drop("_train", "_validation"))
