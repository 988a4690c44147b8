"""License scans against a plain search, against the SQL, and on planted notices."""

import random
import re
import time

import duckdb
from pyspark.sql import functions as F

from echolens.llm import license_scan
from echolens.llm.queries import SQL
from tests.compare import normal
from tests.llm.test_operators import docs_of, empty, lower, odd, rows_of, same  # noqa: F401

NOTICE = dict((label, text) for label, least, text in license_scan.NOTICES if least < 100)


def base(i, text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    found = [(k, label) for label, phrase in license_scan.PHRASES for k in range(len(words))
             if words[k:k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in found]
    return (i, len(words), len(found), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in found})))


def licensed():
    rng = random.Random(7)
    some = ["GNU", "General", "public", "License", "cc", "BY", "mit", "apache", "licensed under the", "version 2.0", "é", "日本", "9"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    filler = "word " * (license_scan.BLOCK - 2)
    texts += [filler + k * "x " + "GNU General-Public   LICENSE, CC/BY" for k in range(7)]
    texts += [filler * 3 + "mit license " + filler + "apache_license", "cc-by" * 9000, "the mit license" + "\n" * 9000 + "MIT License"]
    for text in NOTICE.values():
        words = text.split()
        texts += [text.upper(), " ".join(words[:5] + ["put", "in"] + words[5:]), " ".join(words[:9] + words[11:]),
                  " ".join(words[:len(words) // 4]), filler + text]
    return texts


def test_license_scan(spark, odd, empty):  # noqa: F811
    rows = [(i, t) for i, t in enumerate(licensed())] + [(None, "mit license"), (None, "mit license"), (3, "cc by"), (3, "cc by")]
    planted = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, _key string, n long, hash long")
    for df in (*docs_of(spark, odd).values(), planted):
        got = license_scan.scan(df)
        same(got.drop("labels", "score").collect(), [base(i, t) for i, t in rows_of(df)])
        con = duckdb.connect()
        con.register("documents", df.select("doc_id", "text").toArrow())
        cur = con.execute(SQL["op13_license_scan"])
        assert normal(got.columns, [tuple(r) for r in got.collect()]) == normal([c[0] for c in cur.description], cur.fetchall())
    assert license_scan.scan(empty).count() == 0


def test_edited_notices(spark):
    rows = []
    for k, (label, text) in enumerate(NOTICE.items()):
        words = text.split()
        rows += [(10 * k, label, text), (10 * k + 1, label, " ".join(words[:6] + ["really", "so"] + words[6:])),
                 (10 * k + 2, label, "intro " * 50 + " ".join(words[:7] + words[8:])),
                 (10 * k + 3, None, " ".join(reversed(words))), (10 * k + 4, None, " ".join(words[-(len(words) // 3):]))]
    df = spark.createDataFrame(rows, "doc_id long, label string, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for i, label, _ in rows:
        found = got[i].labels.split(",")
        assert (label in found) if label else not got[i].labels, (i, label, got[i])
        assert got[i].n_base or (got[i].score >= 0.6) == bool(label)


def test_scattered_words_make_no_notice(spark):
    words = NOTICE["bsd"].split()
    grams = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)]
    far = " ".join(g + " filler" * 9 for g in grams)
    got = license_scan.scan(spark.createDataFrame([(1, far), (2, " ".join(reversed(grams)))], "doc_id long, text string"))
    assert {r.labels for r in got.collect()} == {""} and got.agg(F.max("score")).first()[0] < 0.6


def test_hot_text(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"),
                                  F.lit("under the MIT license or CC BY 4.0").alias("text"))
    got = license_scan.scan(df).groupBy("n_words", "n_base", "first_word", "last_word", "base_labels", "labels").count().collect()
    assert [tuple(r) for r in got] == [(9, 2, 2, 5, "cc-by,mit", "cc-by,mit", 3000)]


def test_word_characters(spark):
    """Every character is in a word or between words as the contract says, before and after A-Z is lower-cased."""
    some = [*range(0x300), 0x212A, 0x3000, 0xD7FF, 0xE000, 0xFFFD, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF]
    df = spark.createDataFrame([(i, f"x{chr(i)}x {chr(i)}") for i in some], "doc_id long, text string")
    got = license_scan.scan(df).select("doc_id", "n_words").collect()
    count = lambda text: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)))
    assert sorted(map(tuple, got)) == [(i, count(f"x{chr(i)}x {chr(i)}")) for i in some]
    raw = df.select("doc_id", F.size(license_scan.words(F.col("text")))).collect()
    assert sorted(map(tuple, raw)) == [(i, count(f"x{chr(i)}x {chr(i)}")) for i in some]


def test_words_are_found_fast(spark):
    """A negated class of the same characters takes at least 3 times as long, on several cores more."""
    text = F.concat(F.repeat(F.lit("Some words of é text, in one row. "), 50), F.col("id").cast("string"))
    df = spark.range(0, 4000, 1, 4).select(F.translate(text, license_scan.UPPER, license_scan.LOWER).alias("text"))

    def seconds(found):
        begun = time.perf_counter()
        assert df.agg(F.sum(F.size(found))).first()[0] == 4000 * (8 * 50 + 1)
        return time.perf_counter() - begun

    negated = F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"), F.lit(0))
    now, plain = (min(seconds(x) for _ in range(2)) for x in (license_scan.words(F.col("text")), negated))
    assert now < 0.7 * plain, (now, plain)
