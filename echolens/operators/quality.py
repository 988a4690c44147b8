"""Profiling, validation and cleaning of message tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.functions.match import clamp
from echolens.functions.text import CleanOptions, clean_messages
from echolens.operators.dedup import flag_duplicates, text_key

RECOMMENDED = ["text", "author", "date", "retweet_count", "favorite_count"]


def column_profile(df: DataFrame, columns=None) -> DataFrame:
    """``(column, n_rows, n_columns, valid, avg_length, duplicates)`` per string column.

    Texts are reduced to (column, md5, counts) before the shuffle; lengths skip nulls.
    """
    columns = columns or [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns])))
    per_value = (long.groupBy("column", text_key(F.col("v")).alias("key"))
                     .agg(F.count("*").alias("n"), F.count("v").alias("valid"),
                          F.sum(F.length("v")).alias("chars")))
    return per_value.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.sum("valid").alias("valid"),
        F.round(F.sum("chars") / F.sum("valid"), 4).alias("avg_length"),
        F.sum(F.col("n") - 1).alias("duplicates"))


def _text_measures(df: DataFrame, text: str) -> DataFrame:
    per_key = (df.groupBy(text_key(F.col(text)).alias("key"))
                 .agg(F.count("*").alias("n"), F.count(text).alias("valid"),
                      F.max(F.length(text)).alias("len")))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("n") - F.col("valid")), F.lit(0)).alias("n_null"),
        F.min("len").alias("min_length"), F.max("len").alias("max_length"),
        (F.sum(F.col("len") * F.col("valid")) / F.sum("valid")).alias("avg_length"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def quality_score_of(measures: DataFrame, columns) -> Column:
    n = F.col("n_rows")
    score = (F.lit(100.0) - F.col("n_null") / n * 30 - F.col("n_duplicates") / n * 20
             - F.when(F.col("avg_length") < 10, 20).when(F.col("avg_length") < 20, 10)
                .otherwise(0)
             + 5 * sum(c in columns for c in RECOMMENDED))
    return F.when(n == 0, 0.0).otherwise(F.round(clamp(score, 0, 100), 4))


def quality_score(df: DataFrame, text="text") -> DataFrame:
    """0 to 100: minus nulls, duplicates and short texts, plus recommended columns present."""
    m = _text_measures(df, text)
    return m.select(quality_score_of(m, df.columns).alias("quality_score"))


def validate_structure(df: DataFrame, text="text") -> DataFrame:
    """One row: measures, ``valid`` and the warnings joined by '; '."""
    if text not in df.columns:
        return df.sparkSession.sql(
            "select false as valid, 'missing column: text' as warnings").limit(1)
    missing = [c for c in RECOMMENDED if c not in df.columns]
    m = _text_measures(df, text)
    number = lambda c: F.col(c).cast("string")
    warnings = F.filter(F.array(
        F.lit("missing recommended: " + ", ".join(missing) if missing else None).cast("string"),
        F.when(F.col("n_null") > 0, F.concat(number("n_null"), F.lit(" empty texts"))),
        F.when(F.col("min_length") < 5, "texts shorter than 5"),
        F.when(F.col("max_length") > 1000, "texts longer than 1000"),
        F.when(F.col("avg_length") < 10, "very low average length"),
        F.when(F.col("n_rows") > 10000, F.concat(F.lit("large file: "), number("n_rows")))
         .when(F.col("n_rows") < 10, "fewer than 10 rows"),
        F.when(F.col("n_duplicates") > 0, F.concat(number("n_duplicates"),
                                                   F.lit(" duplicates")))),
        lambda w: w.isNotNull())
    return m.select(F.lit(True).alias("valid"), "n_rows",
                    F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
                    F.array_join(warnings, "; ").alias("warnings"),
                    quality_score_of(m, df.columns).alias("quality_score"))


def validate_text(text: Column) -> Column:
    """Struct(valid, error, text): trimmed length 3 to 1000."""
    trimmed = F.regexp_replace(text, r"^[\t-\r\x1C-\x20\x85\p{Z}]+|[\t-\r\x1C-\x20\x85\p{Z}]+$",
                               "")
    error = (F.when(F.coalesce(text, F.lit("")) == "", "invalid text")
              .when(F.length(trimmed) < 3, "too short").when(F.length(trimmed) > 1000,
                                                             "too long"))
    return F.struct(error.isNull().alias("valid"), error.alias("error"),
                    F.when(error.isNull(), trimmed).alias("text"))


def clean_flagged(df: DataFrame, text="text", id_col="msg_id",
                  options=CleanOptions()) -> DataFrame:
    """All rows with ``is_null``, ``is_dup``, the cleaned text and ``is_empty``.

    Nulls are dropped before duplicates are counted, so a null is never a duplicate.
    """
    flagged = flag_duplicates(df, text, id_col)
    flagged = flagged.withColumns({"is_null": F.col(text).isNull(),
                                   "is_dup": F.col("is_dup") & F.col(text).isNotNull()})
    out = clean_messages(flagged, text, options=options)
    return out.withColumn("is_empty", F.col(f"{text}_cleaned") == "")


def clean_dataset(df: DataFrame, text="text", id_col="msg_id",
                  options=CleanOptions()) -> DataFrame:
    """Drop nulls, exact duplicates and texts that clean to nothing; add the cleaned text."""
    if text not in df.columns:
        return df
    kept = df.where(F.col(text).isNotNull())
    kept = flag_duplicates(kept, text, id_col, "_dup").where(~F.col("_dup")).drop("_dup")
    return where_computed(clean_messages(kept, text, options=options),
                          F.col(f"{text}_cleaned") != "")


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on a costly computed column without computing it twice.

    A plain filter is pushed below the projection and repeats its expressions there; it does not
    cross a projection with a non-deterministic column.
    """
    return (df.withColumn("_row", F.monotonically_increasing_id())
              .where(condition & (F.col("_row") >= 0)).drop("_row"))


def cleaning_stats(flagged: DataFrame, text="text") -> DataFrame:
    """One row of counts and average lengths from ``clean_flagged``, in one aggregation."""
    first = ~F.col("is_null") & ~F.col("is_dup")
    kept = F.count_if(first & ~F.col("is_empty"))
    total = F.count("*")
    return flagged.agg(
        total.alias("total_original"), F.count_if("is_null").alias("empty_texts"),
        F.count_if("is_dup").alias("duplicates_removed"), kept.alias("total_cleaned"),
        (total - kept).alias("removed"),
        F.coalesce(F.round(F.try_divide((total - kept) * 100.0, total), 4), F.lit(0.0))
        .alias("reduction_pct"),
        F.round(F.avg(F.when(first, F.length(text))), 4).alias("avg_length_before"),
        F.round(F.avg(F.when(first, F.length(f"{text}_cleaned"))), 4).alias("avg_length_after"))


def filter_corpus(df: DataFrame, text="text", id_col="doc_id", language="fr", lang_col="lang",
                  min_length=10, max_length=500) -> DataFrame:
    """Rows of one language within the length bounds, exact duplicates removed."""
    kept = df.where((F.col(lang_col) == language)
                    & F.length(text).between(min_length, max_length))
    return flag_duplicates(kept, text, id_col, "_dup").where(~F.col("_dup")).drop("_dup")


def quality_distribution(df: DataFrame, text="text", id_col="msg_id", bins=10) -> DataFrame:
    """Histogram of a score per message: 100, minus 30 if null, 20 if duplicate, 20 or 10 if
    shorter than 10 or 20 characters."""
    length = F.length(F.coalesce(F.col(text), F.lit("")))
    score = (F.lit(100) - F.when(F.col(text).isNull(), 30).otherwise(0)
             - F.when(F.col("is_dup"), 20).otherwise(0)
             - F.when(length < 10, 20).when(length < 20, 10).otherwise(0))
    return (flag_duplicates(df, text, id_col)
            .select(F.least(F.width_bucket(score.cast("double"), F.lit(0.0), F.lit(100.0),
                                           F.lit(bins)), F.lit(bins)).cast("int").alias("bin"))
            .groupBy("bin").agg(F.count("*").alias("n")))


def preview(df: DataFrame, columns, id_col="msg_id", n=10) -> DataFrame:
    """The first rows by id; each task keeps ``n`` rows."""
    return df.orderBy(id_col).limit(n).select(*[c for c in columns if c in df.columns])


