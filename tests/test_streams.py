"""Streams in several batches against the batch operators: every message counts, open windows included."""

import datetime
import random

from pyspark.sql import functions as F

from echolens.streaming import streams

START = datetime.datetime(2024, 1, 1)
SCHEMA = "msg_id bigint, author string, ts timestamp_ntz, is_claim string, sentiment string, urgence string"


def messages(n, late=0.0, seed=3):
    rng, rows, at = random.Random(seed), [], START
    for i in range(n):
        at += datetime.timedelta(minutes=rng.choice([0, 1, 7, 20, 55, 60, 61, 190]))
        back = datetime.timedelta(minutes=rng.randint(0, 50)) if rng.random() < late else datetime.timedelta()
        rows.append((i, rng.choice(["hot", "hot", "a", "b", None]), at - back, rng.choice(["oui", "non"]),
                     rng.choice(["negatif", "positif"]), rng.choice(["haute", "basse"])))
    return rows


def written(spark, rows, folder, batches):
    """One file a batch, in the order of the rows."""
    size = -(-len(rows) // batches)
    for k in range(batches):
        part = spark.createDataFrame(rows[k * size:(k + 1) * size], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(folder)
    return spark.read.schema(SCHEMA).parquet(folder)


def stream_of(spark, folder):
    return streams.read_stream(spark, folder, files_per_trigger=1, schema=spark.read.schema(SCHEMA).parquet(folder).schema)


def equal(a, b):
    assert sorted(map(repr, a.select(sorted(a.columns)).collect())) == sorted(map(repr, b.select(sorted(b.columns)).collect()))


def test_windows_and_sessions_in_batches(spark, tmp_path):
    folder = f"{tmp_path}/in"
    given = written(spark, messages(400, late=0.3), folder, 5)
    for slide in (None, "30 minutes"):
        got = streams.kpi_window_table(stream_of(spark, folder), "w", length="2 hours", slide=slide, delay="1 hour")
        equal(got, streams.kpi_windows(given, length="2 hours", slide=slide))
    got = streams.author_session_table(stream_of(spark, folder), "s")
    equal(got, streams.author_sessions(given))
    assert got.agg(F.sum("n")).first()[0] == 400


def test_goes_on_where_it_stopped(spark, tmp_path):
    rows, folder = messages(300), f"{tmp_path}/in"
    for part in (rows[:120], rows[120:121], rows[121:]):
        given = written(spark, part, folder, 2 if len(part) > 1 else 1)
        windows = streams.kpi_window_table(stream_of(spark, folder), "w", path=f"{tmp_path}/w")
        sessions = streams.author_session_table(stream_of(spark, folder), "s", path=f"{tmp_path}/s")
        equal(windows, streams.kpi_windows(given))
        equal(sessions, streams.author_sessions(given))
    again = streams.kpi_window_table(stream_of(spark, folder), "w", path=f"{tmp_path}/w")  # nothing new
    equal(again, streams.kpi_windows(given))


def test_open_rows_only_are_carried_on(spark, tmp_path):
    folder = f"{tmp_path}/in"
    written(spark, messages(400), folder, 4)
    streams.author_session_table(stream_of(spark, folder), "s", path=f"{tmp_path}/s")
    table = spark.read.parquet(f"{tmp_path}/s/table")
    for r in table.groupBy("batch").agg(F.count_if("_open").alias("still"), F.count("*").alias("n")).collect():
        assert 0 < r.still < r.n / 2


def test_repeated_batch_replaces(spark, tmp_path):
    """What a batch wrote before it failed is written anew."""
    folder = f"{tmp_path}/in"
    given = written(spark, messages(100), folder, 2)
    junk = streams.author_sessions(given).withColumn("_open", F.lit(True))
    for part in ("new", "table"):
        (junk if part == "table" else junk.drop("_open")).write.parquet(f"{tmp_path}/s/{part}/batch=1")
    got = streams.author_session_table(stream_of(spark, folder), "s", path=f"{tmp_path}/s")
    equal(got, streams.author_sessions(given))


def test_stream_without_rows(spark, tmp_path):
    folder = f"{tmp_path}/in"
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    assert streams.author_session_table(stream_of(spark, folder), "s").count() == 0
    assert streams.kpi_window_table(stream_of(spark, folder), "w").count() == 0
