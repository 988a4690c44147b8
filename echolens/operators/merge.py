"""Putting the tiers together: overlay, backfill, confidence, result cache, report."""

import hashlib
import time
from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from echolens.functions.text import clean_messages
from echolens.sources.shared import write_and_read

OVERLAY = {"topics": "categorie", "incident": "incident", "confidence": "score_confiance",
           "is_claim": "is_claim"}
REQUIRED = {"sentiment": "neutre", "is_claim": "non", "urgence": "faible", "topics": "autre",
            "incident": "autre", "confidence": 0.5}
CACHE_BUCKETS = 64
TEMPORARY = ("preliminary", "mistral_", "bert_confidence")


def clean_on_demand(df: DataFrame, column="text_cleaned", source="text") -> DataFrame:
    """Add the cleaned text unless the table has it."""
    return df if column in df.columns else clean_messages(df, source, out=column)


def merge_tier_results(base: DataFrame, sampled: DataFrame, id_col="msg_id") -> DataFrame:
    """Overlay the results of a sampled tier by id; rows without one keep their values.

    No size is assumed for the sample: AQE broadcasts it when it turns out small, and ids are
    unique on both sides, so the shuffle join has no hot key.
    """
    present = {to: src for to, src in OVERLAY.items() if src in sampled.columns}
    over = sampled.select(id_col, *[F.col(src).alias(f"_{to}") for to, src in present.items()])
    out = base.join(over, id_col, "left")
    return (out.withColumns({to: F.coalesce(f"_{to}", to) if to in base.columns
                             else F.col(f"_{to}") for to in present})
               .drop(*[f"_{to}" for to in present]))


def backfill_prelim(df: DataFrame) -> DataFrame:
    """Take topic and incident of the rule tier where nothing better came."""
    return df.withColumns({c: F.coalesce(c, f"{c}_preliminary") if c in df.columns
                           else F.col(f"{c}_preliminary") for c in ("topics", "incident")})


def aggregate_confidence(df: DataFrame, model="bert_confidence",
                         llm="mistral_confidence") -> DataFrame:
    """Mean of the scores at hand: model, rules (0.85 for a claim, else 0.70), language model.

    The claim test reads oui/non; the original compares with 1, which never holds.
    """
    scores = [F.col(c) for c in (model, llm) if c in df.columns]
    if "is_claim" in df.columns:
        scores.append(F.when(F.col("is_claim") == "oui", 0.85).otherwise(0.70))
    if not scores:
        return df.withColumn("confidence", F.lit(0.70))
    known = reduce(add, [s.isNotNull().cast("int") for s in scores])
    total = reduce(add, [F.coalesce(s, F.lit(0.0)) for s in scores])
    return df.withColumn("confidence", F.when(known == 0, 0.70).otherwise(total / known))


def complete_columns(df: DataFrame) -> DataFrame:
    """Add missing indicator columns with their defaults and drop helper columns."""
    helpers = [c for c in df.columns if any(part in c for part in TEMPORARY)]
    return (df.withColumns({c: F.lit(v) for c, v in REQUIRED.items() if c not in df.columns})
              .drop(*helpers))


def cache_key(text, model: str, version="v2"):
    return F.md5(F.concat(F.lit(f"{model}:{version}:"), F.coalesce(text, F.lit(""))))


def open_cache(spark: SparkSession, path: str, values: str, buckets=CACHE_BUCKETS) -> str:
    """Name of the cache table at ``path``, which is made if there is none; ``values`` are its columns besides key and run.

    The table is bucketed by key, so it is joined and grouped without being shuffled, and outlives the session:
    any later one opens the same path with the same number of buckets.
    """
    name = "cache_" + hashlib.md5(path.encode()).hexdigest()
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (key STRING, {values}, run BIGINT) USING parquet "
              f"CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.sql(f"REFRESH TABLE {name}")
    return name


def cache_buckets(spark: SparkSession, cache: str) -> int:
    return int(spark.sql(f"DESCRIBE EXTENDED {cache}").where("col_name = 'Num Buckets'").first().data_type)


def cache_entries(spark: SparkSession, cache: str) -> DataFrame:
    """One row per key; of entries that two runs have added, the later one."""
    rows = spark.table(cache)
    values = [c for c in rows.columns if c not in ("key", "run")]
    return (rows.groupBy("key").agg(F.max_by(F.struct(*values), "run").alias("_entry"))
                .select("key", "_entry.*"))


def look_up(df: DataFrame, cache: str, model: str, text="text") -> DataFrame:
    """``(key, n, text, hit, values)``: a row per distinct key, with what the cache holds for it.

    A text is looked up once however often it occurs: keys are grouped, with map-side combining, before they
    meet the cache bucket by bucket. Only the wanted keys are shuffled, to as many partitions as there are
    buckets, whatever the session's number.
    """
    spark = df.sparkSession
    wanted = (df.select(cache_key(F.col(text), model).alias("key"), F.col(text).alias("text"))
                .groupBy("key").agg(F.count("*").alias("n"), F.first("text").alias("text"))
                .repartition(cache_buckets(spark, cache), "key"))
    known = cache_entries(spark, cache).withColumn("_hit", F.lit(True))
    values = [c for c in known.columns if c not in ("key", "_hit")]
    return (wanted.join(known.hint("merge"), "key", "left")
                  .select("key", "n", "text", F.coalesce("_hit", F.lit(False)).alias("hit"), *values))


def append_cache(results: DataFrame, cache: str, run: int) -> None:
    """Add new ``(key, values)`` rows, a file a bucket."""
    spark = results.sparkSession
    table = spark.table(cache)
    (results.withColumn("run", F.lit(run).cast("bigint")).select(table.columns)
            .repartition(cache_buckets(spark, cache), "key").write.insertInto(cache))
    spark.catalog.refreshTable(cache)


def score_with_cache(df: DataFrame, cache: str, model: str, scorer: Callable[[DataFrame], DataFrame], run: int,
                     text="text") -> DataFrame:
    """``(key, n, hit, values)`` of every distinct text: from the cache, else from ``scorer``, whose results
    join the cache. ``scorer`` turns rows ``(key, text)`` into ``(key, values)``.

    The look-up is written once, so that the table may grow while its result is in use.
    """
    found = write_and_read(look_up(df, cache, model, text), "lookup")
    values = [c for c in found.columns if c not in ("key", "n", "text", "hit")]
    new = write_and_read(scorer(found.where("not hit").select("key", "text")).select("key", *values), "scored")
    append_cache(new, cache, run)
    missed = found.where("not hit").select("key", "n", "hit").join(new, "key")
    return found.where("hit").select("key", "n", "hit", *values).unionByName(missed)


def cache_statistics(found: DataFrame) -> DataFrame:
    """Rows served and not served by the cache, and the hit rate in percent."""
    served = lambda hit: F.coalesce(F.sum(F.when(F.col("hit") == hit, F.col("n"))), F.lit(0))
    s = found.agg(served(True).alias("hits"), served(False).alias("misses"))
    lookups = F.col("hits") + F.col("misses")
    return s.select("hits", "misses", F.when(lookups > 0, F.round(
        F.col("hits") * 100.0 / lookups, 4)).otherwise(0.0).alias("hit_rate"))


def classification_report(df: DataFrame) -> DataFrame:
    """One row: totals, shares, distinct counts, confidence range and label maps.

    One pass over the rows; the grouping sets yield one row per label, and only those are
    gathered into maps.
    """
    labels = ["sentiment", "urgence", "topics", "incident"]
    bits = {c: 15 - (8 >> i) for i, c in enumerate(labels)}
    g = (df.groupingSets([[], *[[c] for c in labels]], *labels)
           .agg(F.grouping_id().alias("gid"), F.count("*").alias("n"),
                F.count_if(F.col("is_claim") == "oui").alias("claims"),
                F.avg("confidence").alias("avg"), F.min("confidence").alias("low"),
                F.max("confidence").alias("high")))
    total = F.col("gid") == 15
    whole = lambda c: F.max(F.when(total, F.col(c)))
    count = lambda c, v: F.coalesce(F.max(F.when((F.col("gid") == bits[c]) & (F.col(c) == v),
                                                 F.col("n"))), F.lit(0))
    pct = lambda x: F.round(x * 100.0 / whole("n"), 4)
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.when(
        (F.col("gid") == bits[c]) & F.col(c).isNotNull(), F.struct(c, "n"))))
        ).alias(f"{c}_distribution") for c in labels]
    kinds = [F.count_if((F.col("gid") == bits[c]) & F.col(c).isNotNull()).alias(f"{c}_count")
             for c in ("topics", "incident")]
    return g.agg(whole("n").alias("total"), whole("claims").alias("claims_count"),
                 pct(whole("claims")).alias("claims_percentage"),
                 pct(count("sentiment", "positif")).alias("sentiment_positif_pct"),
                 pct(count("sentiment", "negatif")).alias("sentiment_negatif_pct"),
                 count("urgence", "haute").alias("urgence_haute_count"), *kinds,
                 F.round(whole("avg"), 4).alias("confidence_avg"),
                 whole("low").alias("confidence_min"), whole("high").alias("confidence_max"),
                 *maps)


def run_metrics(df: DataFrame, phases, mode: str, target=2634) -> DataFrame:
    """Run named phases on a table and report rows, seconds and rates in one row.

    ``phases`` is a list of (name, DataFrame -> DataFrame); each result is consumed completely
    without being kept, and its rows are counted on the way.
    """
    seconds, rows, errors = {}, 0, 0
    for name, phase in phases:
        seen, start = Observation(name), time.perf_counter()
        try:
            phase(df).observe(seen, F.count("*").alias("n")).write.format("noop") \
                .mode("overwrite").save()
            rows = max(rows, seen.get["n"])
        except Exception:
            errors += 1
        seconds[name] = time.perf_counter() - start
    total = sum(seconds.values())
    entries = [x for k, v in seconds.items() for x in (F.lit(k), F.lit(v))]
    return df.sparkSession.range(1).select(
        F.lit(mode).alias("mode"), F.lit(rows).cast("bigint").alias("total_rows"),
        F.lit(total).alias("total_seconds"),
        F.lit(rows / total if total else 0.0).alias("rows_per_second"),
        F.create_map(*entries).alias("phase_seconds"), F.lit(errors).alias("errors_count"),
        F.lit(total / rows * target if rows else 0.0).alias("seconds_for_target"))
