"""Batches that go to Python workers are bounded in bytes, whatever the length of the rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from echolens.llm import bpe, decontaminate, ngram_join, quality_rules, tables
from echolens.llm.queries import tokenizer_file


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows]), "size": pa.array([batch.nbytes])})


def long_rows(spark):
    return spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))


def test_long_rows_come_in_small_batches(spark):
    spark.conf.unset(tables.BATCH_SETTING)
    got = tables.in_batches(long_rows(spark), sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 3000 and max(r.size for r in got) <= 1.1 * tables.BATCH_BYTES
    spark.conf.set(tables.BATCH_SETTING, "1m")  # the session's own bound stays
    got = tables.in_batches(long_rows(spark), sizes, "n long, size long").collect()
    assert max(r.size for r in got) <= 1.1 * (1 << 20)
    spark.conf.unset(tables.BATCH_SETTING)


def test_operators_bound_their_batches(spark):
    for operator in (lambda d: bpe.round_trip(d, tokenizer_file("byte_bpe_50k.json")),
                     lambda d: quality_rules.profiles(d.select("doc_id", F.col("text").cast("binary"))),
                     lambda d: ngram_join._measure(d.select("doc_id", F.col("text").cast("binary")), 3),
                     lambda d: decontaminate.drop_contaminated(d, d.limit(1), item_col="doc_id")):
        spark.conf.unset(tables.BATCH_SETTING)
        operator(long_rows(spark))
        assert spark.conf.get(tables.BATCH_SETTING, None) == str(tables.BATCH_BYTES)


def test_cached_words_share_their_numbers():
    coder = bpe.coder(tokenizer_file("byte_bpe_50k.json"))
    ids = [i for w in (" something", " something else", "Unusual-Words") for i in coder._word(w)]
    assert all(i is coder.one[i] for i in ids)
