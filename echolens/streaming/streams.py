"""The batch operators on streaming DataFrames.

The classifiers are column expressions and run unchanged on a stream. Times are cast to
``timestamp`` because a watermark needs a point in time.

Windows and sessions that are still open belong to the result: ``run_merged`` keeps them in a keyed table
that each micro-batch updates. The batch with number ``k`` reads what was open after ``k - 1``, merges its
own rows into it and writes the outcome below ``batch=k``: rows that can still change and, once, those that
cannot. So a batch costs its own rows and the open ones, never the table, and a repeated batch replaces
what it wrote before.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from echolens.functions import lexicon as L
from echolens.operators.kpi import clean_value, is_true
from echolens.sources.shared import shared_folder


def read_stream(spark: SparkSession, folder: str, pattern="*", files_per_trigger=None,
                schema=None) -> DataFrame:
    """Stream of the parquet files of a folder."""
    schema = schema or spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


MERGE_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def run_available(stream: DataFrame, name: str, mode="append") -> DataFrame:
    """Process what has arrived, then stop; returns the sink's table.

    Sink and state live in the shared folder, so a lost executor or driver resumes there.
    Sessions are merged on the map side, so a busy author arrives as sessions, not as rows.
    """
    spark = stream.sparkSession
    path = shared_folder(spark, name)
    before = spark.conf.get(MERGE_SESSIONS, "false")
    spark.conf.set(MERGE_SESSIONS, "true")
    try:
        query = (stream.writeStream.format("parquet").outputMode(mode)
                 .option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
                 .trigger(availableNow=True).start())
    finally:
        spark.conf.set(MERGE_SESSIONS, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def run_merged(stream: DataFrame, name: str, merge: Callable[[DataFrame, DataFrame], DataFrame],
               start: str, end: str, delay="1 hour", mode="update",
               partial: Callable[[DataFrame], DataFrame] = lambda batch: batch, path=None) -> DataFrame:
    """Process what has arrived, then stop; returns all rows by key, open ones as they are now.

    ``partial`` turns a micro-batch into keyed rows with the times ``start`` and ``end``, and ``merge(open, new)``
    merges such rows. A row is open until its end lies ``delay`` before the latest start. Calling it again with
    the same ``path`` goes on where the last run stopped.
    """
    spark = stream.sparkSession
    path = path or shared_folder(spark, name)
    columns = partial(spark.createDataFrame([], stream.schema)).schema
    flagged = StructType([*columns, StructField("_open", BooleanType())])

    def after(batch_id: int) -> DataFrame:
        """What was open after a batch."""
        return (spark.read.schema(flagged).parquet(f"{path}/table/batch={batch_id}")
                .where("_open").drop("_open"))

    def step(batch: DataFrame, batch_id: int) -> None:
        new = f"{path}/new/batch={batch_id}"
        partial(batch).write.mode("overwrite").parquet(new)  # read twice below, computed once
        both = after(batch_id - 1), spark.read.schema(columns).parquet(new)
        latest = both[0].select(start).unionAll(both[1].select(start)).agg(F.max(start)).scalar()
        (merge(*both).withColumn("_open", F.col(end) >= latest - F.expr(f"interval {delay}"))
         .write.mode("overwrite").parquet(f"{path}/table/batch={batch_id}"))

    spark.createDataFrame([], flagged).write.mode("ignore").parquet(f"{path}/table/batch=-1")
    query = (stream.writeStream.foreachBatch(step).outputMode(mode)
             .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    table = (spark.read.schema(StructType([*flagged, StructField("batch", LongType())]))
             .parquet(f"{path}/table"))
    last = table.agg(F.max("batch")).scalar()  # the row with the latest start is open, so no batch is without one
    return table.where(~F.col("_open") | (F.col("batch") == last)).drop("_open", "batch")


def latest_by_key(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Merge of rows that each replace the one with the same key."""
    def merge(before: DataFrame, new: DataFrame) -> DataFrame:
        values = F.struct(*[c for c in new.columns if c not in keys])
        both = before.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        return both.groupBy(*keys).agg(F.max_by(values, "_new").alias("_row")).select(*keys, "_row.*")
    return merge


def merge_sessions(author="author") -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Merge of sessions ``(author, session_start, session_end, n)``: those that overlap become one."""
    def merge(before: DataFrame, new: DataFrame) -> DataFrame:
        along = Window.partitionBy(author).orderBy("session_start", "session_end")
        reach = F.max("session_end").over(along.rowsBetween(Window.unboundedPreceding, -1))
        apart = F.when(F.col("session_start") <= reach, 0).otherwise(1)
        return (before.unionByName(new).withColumn("_apart", apart)
                .withColumn("_island", F.sum("_apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
                .groupBy(author, "_island").agg(F.min("session_start").alias("session_start"),
                                                F.max("session_end").alias("session_end"), F.sum("n").alias("n"))
                .select(*new.columns))
    return merge


def event_time(df: DataFrame, col="ts") -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp"))


def stream_classify(messages: DataFrame, classifier: Callable[[DataFrame], DataFrame]) \
        -> DataFrame:
    """Any stateless classifier of this package."""
    return classifier(messages)


def stream_dedup(messages: DataFrame, text="text", ts="ts", id_col="msg_id", delay="7 days",
                 salts=16) -> DataFrame:
    """First arrival of each text within the lateness bound; null texts are dropped.

    A streaming deduplication has no map-side combining, so a text that makes up much of the
    stream would meet in one task. It is therefore removed per (text, salt) first, which spreads
    it over ``salts`` tasks, and the at most ``salts`` survivors per text meet in a second step.
    """
    keyed = (event_time(messages, ts).where(F.col(text).isNotNull())
             .withColumns({"text_md5": F.md5(text),
                           "_salt": F.pmod(F.xxhash64(id_col), F.lit(salts))})
             .withWatermark(ts, delay))
    return (keyed.dropDuplicatesWithinWatermark(["text_md5", "_salt"])
                 .dropDuplicatesWithinWatermark(["text_md5"]).drop("_salt"))


def urgent_claim() -> Column:
    return is_true(F.col("is_claim")) & clean_value(F.col("urgence")).isin(*L.HIGH_URGENCY_WORDS)


def kpi_windows(classified: DataFrame, ts="ts", delay="1 hour", length="1 day",
                slide=None) -> DataFrame:
    """Claims, negative and urgent messages per tumbling or sliding window.

    Works on batch and stream; on a stream rows later than the delay are dropped.
    """
    df = event_time(classified, ts)
    if df.isStreaming:
        df = df.withWatermark(ts, delay)
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return (df.groupBy(window).agg(
                F.count("*").alias("n"), F.count_if(is_true(F.col("is_claim"))).alias("claims"),
                F.count_if(clean_value(F.col("sentiment")).isin(*L.NEGATIVE_WORDS))
                 .alias("negative"),
                F.count_if(urgent_claim()).alias("urgent"))
              .select(F.col("window.start").alias("window_start"),
                      F.col("window.end").alias("window_end"), "n", "claims", "negative",
                      "urgent"))


def author_sessions(messages: DataFrame, author="author", ts="ts", gap="1 hour",
                    delay="1 hour") -> DataFrame:
    """Bursts of messages per author, ended by a pause of ``gap``."""
    df = event_time(messages, ts)
    if df.isStreaming:
        df = df.withWatermark(ts, delay)
    return (df.groupBy(author, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
              .select(author, F.col("session_window.start").alias("session_start"),
                      F.col("session_window.end").alias("session_end"), "n"))


def kpi_window_table(classified: DataFrame, name: str, ts="ts", delay="1 hour", length="1 day",
                     slide=None, path=None) -> DataFrame:
    """``kpi_windows`` of a stream up to now, open windows included."""
    return run_merged(kpi_windows(classified, ts, delay, length, slide), name,
                      latest_by_key(["window_start", "window_end"]), "window_start", "window_end", delay,
                      path=path)


def author_session_table(messages: DataFrame, name: str, author="author", ts="ts", gap="1 hour",
                         delay="1 hour", path=None) -> DataFrame:
    """``author_sessions`` of a stream up to now, open sessions included.

    Session windows know no update mode, so each micro-batch's sessions are computed as a batch and merged
    with the open ones. A message so late that its session was closed counts as a session of its own.
    """
    return run_merged(messages.select(author, ts), name, merge_sessions(author), "session_start",
                      "session_end", delay, "append", lambda batch: author_sessions(batch, author, ts, gap),
                      path)


def alerts(classified: DataFrame) -> DataFrame:
    """Urgent claims, as they arrive."""
    return classified.where(urgent_claim())


def alert_windows(windows: DataFrame, threshold: int) -> DataFrame:
    """Windows with at least ``threshold`` urgent claims."""
    return windows.where(F.col("urgent") >= threshold)
