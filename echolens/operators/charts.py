"""The tables behind the charts: small grouped results, no drawing."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolens.functions import lexicon as L
from echolens.functions.match import any_term, first_label
from echolens.operators.kpi import clean_value, is_true, percent, value_counts

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def date_column(df: DataFrame, name="date") -> str | None:
    """The date column under its own or an alternative name."""
    return next((c for c in [name, *L.ALIASES["date"]] if c in df.columns), None)


def as_timestamp(df: DataFrame, col: str) -> Column:
    """The column as a timestamp; text that is no date becomes null."""
    kind = df.schema[col].dataType.typeName()
    return F.try_to_timestamp(F.col(col)) if kind == "string" else F.col(col)


def sentiment_share(df: DataFrame) -> DataFrame:
    return value_counts(df, "sentiment")


def sentiment_buckets(df: DataFrame) -> DataFrame:
    """Three normalised buckets, each present even when empty."""
    s, n = clean_value(F.col("sentiment")), F.count("*")
    counts = df.agg(n.alias("total"),
                    F.count_if(s.isin(*L.NEGATIVE_WORDS)).alias("negatif"),
                    F.count_if(s.isin(*L.NEUTRAL_WORDS)).alias("neutre"),
                    F.count_if(s.isin(*L.POSITIVE_WORDS)).alias("positif"))
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(b).alias("label"), F.col(b).alias("n"),
                 percent(F.col(b), F.col("total"), 2).alias("pct"))
        for b in ("negatif", "neutre", "positif")])))


def daily_volume(df: DataFrame, date="date") -> DataFrame:
    """Rows per day, in total (``sentiment`` = 'all') and per sentiment; unreadable dates are
    left out."""
    day = F.to_date(as_timestamp(df, date_column(df, date)))
    dated = df.select(day.alias("day"), "sentiment").where("day is not null")
    g = (dated.groupingSets([["day"], ["day", "sentiment"]], "day", "sentiment")
              .agg(F.grouping("sentiment").alias("whole"), F.count("*").alias("n")))
    return (g.where((F.col("whole") == 1) | F.col("sentiment").isNotNull())
             .select("day", F.when(F.col("whole") == 1, "all").otherwise(F.col("sentiment"))
                     .alias("sentiment"), "n"))


def activity_heatmap(df: DataFrame, date="date") -> DataFrame:
    """Rows per weekday (Monday first) and hour, one column per hour, zero filled."""
    ts = as_timestamp(df, date_column(df, date))
    cells = df.select(F.date_format(ts, "EEEE").alias("day"), F.hour(ts).alias("hour")) \
              .where("day is not null")
    wide = cells.groupBy("day").pivot("hour", list(range(24))).agg(F.count(F.lit(1)))
    named = wide.select("day", *[F.coalesce(F.col(f"`{h}`"), F.lit(0)).alias(f"h{h:02d}")
                                 for h in range(24)])
    order = first_label([(F.lit(i), F.col("day") == d) for i, d in enumerate(WEEKDAYS)],
                        F.lit(7))
    return named.orderBy(order)


def top_values(df: DataFrame, col: str, n=10) -> DataFrame:
    """The ``n`` most frequent values with their share of all rows."""
    return value_counts(df, col).orderBy(F.desc("n"), "label").limit(n)


def top_themes(df: DataFrame, n=10) -> DataFrame:
    col = next(c for c in ("Thème principal", "category", "incident", "theme", "topics")
               if c in df.columns)
    return top_values(df, col, n)


def incident_share(df: DataFrame) -> DataFrame:
    col = next(c for c in ("Incident principal", "incident", "category") if c in df.columns)
    return value_counts(df, col)


def incident_severity(col: Column) -> Column:
    """none, info, real or other: by exact name, else by the first name that holds the value or
    is held by it."""
    value = clean_value(col)
    exact = [(kind, value == name) for name, kind in L.INCIDENT_SEVERITY]
    partial = [(kind, F.contains(value, F.lit(name)) | F.contains(F.lit(name), value))
               for name, kind in L.INCIDENT_SEVERITY]
    return first_label(exact + partial, "other")


def category_satisfaction(df: DataFrame, n=6) -> DataFrame:
    """Satisfaction index of the ``n`` most frequent categories, in one aggregation."""
    s = F.lower(F.coalesce(F.col("sentiment"), F.lit("")))
    pos = F.count_if(any_term(s, ["positive", "positif"]))
    neg = F.count_if(any_term(s, ["negative", "négatif", "negatif"]))
    return (df.where(F.col("category").isNotNull()).groupBy("category")
              .agg(F.count("*").alias("n"), F.round((pos - neg) / F.count("*") * 50 + 50, 4)
                   .alias("satisfaction"))
              .orderBy(F.desc("n"), "category").limit(n))


def urgency_levels(df: DataFrame) -> DataFrame:
    """Rows per level; the three levels are always present, unknown values count as low."""
    value = clean_value(F.col("urgence"))
    level = first_label([(to, value.isin(*words)) for to, words in L.URGENCY_LEVELS.items()],
                        "FAIBLE")
    counts = df.groupBy(level.alias("level")).agg(F.count("*").alias("n"))
    levels = df.sparkSession.range(1).select(F.explode(F.array(
        *[F.lit(x) for x in L.URGENCY_LEVELS])).alias("level"))
    return (levels.join(F.broadcast(counts), "level", "left")   # at most one row per level
                  .select("level", F.coalesce("n", F.lit(0)).alias("n")))


def priority_counts(df: DataFrame) -> DataFrame:
    """Rows per raw priority, else per urgent flag."""
    if "priority" in df.columns:
        return value_counts(df, "priority")
    return value_counts(df.withColumn("_urgent", F.when(F.col("is_urgent"), "Urgent")
                                      .otherwise("Non Urgent")), "_urgent")


def topic_tokens(df: DataFrame, col="topics", n=10) -> DataFrame:
    """The most frequent entries of comma-separated topic lists."""
    return (df.where(F.col(col).isNotNull())
              .select(F.explode(F.split(F.col(col), ",")).alias("t"))
              .groupBy(F.trim("t").alias("label")).agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), "label").limit(n))


def confidence_histogram(df: DataFrame, col="confidence", bins=20) -> DataFrame:
    """Rows per bin between the smallest and the largest value; the largest is in the last bin.

    Equal values are grouped first; the range and the bins both come from that one grouping.
    """
    values = df.groupBy(F.col(col).alias("v")).agg(F.count(col).alias("n")).where("n > 0")
    span = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    placed = values.withColumn("_s", span)
    lo, hi = F.col("_s.lo"), F.col("_s.hi")
    bucket = F.when(hi > lo, F.least(F.width_bucket(F.col("v"), lo, hi, F.lit(bins)),
                                     F.lit(bins))).otherwise(1)
    return placed.groupBy(bucket.cast("int").alias("bin")).agg(F.sum("n").alias("n"))


def time_ordered(df: DataFrame, date="date", id_col="msg_id") -> DataFrame:
    """Rows in time order: a range-partitioned sort."""
    col = date_column(df, date)
    return df.withColumn("time", as_timestamp(df, col)).where("time is not null") \
             .orderBy("time", id_col)


def claim_split(df: DataFrame) -> DataFrame:
    n, claims = F.count("*"), F.count_if(is_true(F.col("is_claim")))
    return df.agg(n.alias("total"), claims.alias("c")).select(F.inline(F.array(
        F.struct(F.lit("claim").alias("label"), F.col("c").alias("n"),
                 percent(F.col("c"), F.col("total"), 2).alias("pct")),
        F.struct(F.lit("no claim").alias("label"), (F.col("total") - F.col("c")).alias("n"),
                 percent(F.col("total") - F.col("c"), F.col("total"), 2).alias("pct")))))


def detail_table(df: DataFrame, text="text") -> DataFrame:
    """The columns of the detail view that the table has."""
    wanted = [text, "sentiment", "is_claim", "urgence", "topics", "incident", "confidence"]
    return df.select(*[c for c in wanted if c in df.columns])


def distinct_labels(df: DataFrame, columns=("topics", "incident"), approximate=False) -> DataFrame:
    """Number of distinct labels; nulls count as one label, as in the captions."""
    if approximate:
        return df.agg(*[F.approx_count_distinct(c).alias(f"{c}_count") for c in columns])
    sets = df.groupingSets([[c] for c in columns], *columns).agg(F.grouping_id().alias("gid"))
    full = 2 ** len(columns) - 1
    return sets.agg(*[F.count_if(F.col("gid") == full - 2 ** (len(columns) - 1 - i))
                      .alias(f"{c}_count") for i, c in enumerate(columns)])


def claims_by_topic(df: DataFrame) -> DataFrame:
    """Rows and claims per topic, with the margin over all topics as 'all'."""
    return (df.groupingSets([[], ["topics"]], "topics")
              .agg(F.grouping("topics").alias("whole"), F.count("*").alias("n"),
                   F.count_if(is_true(F.col("is_claim"))).alias("claims"))
              .select(F.when(F.col("whole") == 1, "all").otherwise(F.col("topics"))
                      .alias("topic"), "n", "claims",
                      percent(F.col("claims"), F.col("n")).alias("claim_pct")))


def urgency_trend(df: DataFrame, date="date", days=7) -> DataFrame:
    """Urgent share per day with its moving mean; the window runs over one row per day."""
    day = F.to_date(as_timestamp(df, date_column(df, date)))
    urgent = clean_value(F.col("urgence")).isin(*L.HIGH_URGENCY_WORDS)
    daily = (df.groupBy(day.alias("day"))
               .agg(F.count("*").alias("n"), F.count_if(urgent).alias("urgent"))
               .where("day is not null"))
    recent = Window.orderBy("day").rowsBetween(1 - days, 0)
    share = F.col("urgent") * 100.0 / F.col("n")
    return daily.select("day", "n", "urgent", F.round(share, 4).alias("urgent_pct"),
                        F.round(F.avg(share).over(recent), 4).alias("moving_pct"))
