"""License scans: places of license phrases and edited copies of license notices, by diagonal voting.

Templates are short phrases and longer notices. A text's words are maximal runs of ASCII letters, digits and characters
beyond ASCII, A-Z lower-cased. All rolling word grams of all texts, of two words for phrases and of three for
notices, meet the templates' grams by their hashes; a pair of equal words at ``place`` in the text and at ``position``
in a template votes for the diagonal ``place - position``. Votes are summed per text, template and diagonal as a bit set
of positions, on the map side first.

* A phrase stands where a diagonal holds all its positions.
* Words put in or left out move a notice's later words to a diagonal close by, so diagonals at most ``GAP`` apart are
  merged to one span. A span is verified on the words that its grams matched: their share of the notice is its
  score, and it counts as the notice's label from the share on that the notice asks for. A span over more than twice
  as many words as the notice holds, made of scattered votes, is none.

Templates are fixed values of at most 62 words, so their grams, some hundreds, go to every task. A text is cut into
blocks of ``BLOCK`` words before its grams are made, and no text is shuffled: votes carry the text's key. Only
columns and functions of the JVM are used.

One row per input row. Null and empty texts have no words and no labels. Rows with equal ids and texts are scanned
as one and get the same result each; a null id is an id like others. Other columns are left out, whatever their names.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: phrases that decide the base labels
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

# fixed values: label, least share of the words in percent, and the notice as the licenses ask to put it
NOTICES = (
    ("gpl-3.0", 100, "licensed under the gnu general public license version 3"),
    ("gpl-2.0", 100, "licensed under the gnu general public license version 2"),
    ("lgpl", 100, "gnu lesser general public license"),
    ("agpl", 100, "gnu affero general public license"),
    ("apache-2.0", 100, "licensed under the apache license version 2 0"),
    ("cc-by-4.0", 100, "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", 100, "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", 100, "licensed under cc by nc 4 0"),
    ("gpl", 60, "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                "general public license as published by the free software foundation"),
    ("apache-2.0", 60, "licensed under the apache license version 2 0 the license you may not use this file except "
                       "in compliance with the license you may obtain a copy of the license at"),
    ("mit", 60, "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                "associated documentation files the software to deal in the software without restriction"),
    ("bsd", 60, "redistribution and use in source and binary forms with or without modification are permitted "
                "provided that the following conditions are met"),
    ("isc", 60, "permission to use copy modify and or distribute this software for any purpose with or without fee "
                "is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", 60, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", 80, "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", 60, "this is free and unencumbered software released into the public domain"),
)

PHRASE_GRAM, NOTICE_GRAM = 2, 3
GAP = 4
BLOCK = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# characters of a word are listed, upper case too, and not excluded by [^...]: such classes take some 3 times as long on one core and
# some 11 times on four, as the tasks of one JVM slow each other down in them
WORD, BETWEEN = r"[\p{Alnum}\x{80}-\x{10FFFF}]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{WORD}++"), F.lit(0))


def blocks(text: Column) -> Column:
    """The text in pieces of ``BLOCK`` words each, the last one of what is left."""
    return F.regexp_extract_all(text, F.lit(f"(?:{WORD}++{BETWEEN}*+){{1,{BLOCK}}}+"), F.lit(0))


def _grams(found: Column) -> Column:
    """Each word with the two behind it, where there are any."""
    behind = lambda n: F.slice(found, n + 1, F.greatest(F.size(found) - n, F.lit(0)))
    return F.arrays_zip(found.alias("a"), behind(1).alias("b"), behind(2).alias("c"))


def _hash(k: int, *parts: str) -> Column:
    return F.xxhash64(F.lit(k), *parts)


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """``(template, label, gram, least, n, position, ha, hb, hc, hash)``: a row for each gram of each template."""
    assert all(len(text.split()) <= 62 for *_, text in (*phrases, *notices)), "a bit set holds 62 words"
    given = [(label, PHRASE_GRAM, 100, text) for label, text in phrases]
    given += [(label, NOTICE_GRAM, least, text) for label, least, text in notices]
    rows = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(gram).alias("gram"),
                              F.lit(least).alias("least"), F.lit(text).alias("text"))
                     for k, (label, gram, least, text) in enumerate(given)])
    found = spark.range(1).select(F.inline(rows)).withColumn("words", words(F.col("text")))
    return (found.select("template", "label", "gram", "least", F.size("words").alias("n"),
                         F.posexplode(_grams(F.col("words"))).alias("position", "x"))
            .where(F.col("position") <= F.col("n") - F.col("gram"))
            .select("template", "label", "gram", "least", "n", "position", F.col("x.a").alias("ha"),
                    F.col("x.b").alias("hb"), F.when(F.col("gram") == 3, F.col("x.c")).alias("hc"))
            .withColumn("hash", F.when(F.col("gram") == 3, _hash(3, "ha", "hb", "hc")).otherwise(_hash(2, "ha", "hb"))))


def votes(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``(_key, template columns, diagonal, mask)`` of rows ``(_key, _text)``: the positions that vote for a diagonal."""
    head = f"^(?:{WORD}++{BETWEEN}*+){{1,{NOTICE_GRAM - 1}}}+"
    pieces = docs.withColumn("_blocks", blocks(F.translate(F.col("_text"), UPPER, LOWER))).select("_key", F.posexplode(F.transform(
        "_blocks", lambda piece, i: F.struct(piece.alias("own"), F.regexp_extract(
            F.coalesce(F.get("_blocks", i + 1), F.lit("")), head, 0).alias("next")))).alias("block", "piece"))
    grams = (pieces.select("_key", "block", words(F.concat("piece.own", "piece.next")).alias("words"))
             .select("_key", "block", F.posexplode(_grams(F.col("words"))).alias("at", "x"))
             .where(f"at < {BLOCK} and x.b is not null")
             .select("_key", (F.col("block") * F.lit(BLOCK).cast("long") + F.col("at")).alias("place"),
                     F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("x.c").alias("c"))
             .select("*", F.explode(F.array(_hash(2, "a", "b"), _hash(3, "a", "b", "c"))).alias("hash")))
    equal = (F.col("a") == F.col("ha")) & (F.col("b") == F.col("hb")) & (F.col("hc").isNull() | (F.col("c") == F.col("hc")))
    return (grams.join(F.broadcast(known), "hash").where(equal)
            .groupBy("_key", "template", "label", "gram", "least", "n", (F.col("place") - F.col("position")).alias("diagonal"))
            .agg(F.bit_or(F.expr("shiftleft(1L, position)")).alias("mask")))


def spans(found: DataFrame) -> DataFrame:
    """``(_key, label, gram, least, first, last, score)``: the places of a span's first and last word, and the share of
    the template's words that it holds. A phrase's diagonals are spans of their own."""
    along = Window.partitionBy("_key", "template").orderBy("diagonal")
    phrase = F.col("gram") == PHRASE_GRAM
    near = ~phrase & (F.col("diagonal") - F.lag("diagonal").over(along) <= GAP)
    covered = F.bit_count(F.col("mask").bitwiseOR(F.shiftleft("mask", 1)).bitwiseOR(
        F.when(phrase, F.lit(0)).otherwise(F.shiftleft("mask", 2))))
    lowest, highest = F.expr("bit_count((mask & -mask) - 1)"), F.length(F.bin("mask")) - 1
    return (found.withColumn("start", F.when(near, 0).otherwise(1))
            .withColumn("span", F.sum("start").over(along.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("_key", "template", "label", "gram", "least", "n", "span")
            .agg(F.min(F.col("diagonal") + lowest).alias("first"),
                 F.max(F.col("diagonal") + highest + F.col("gram") - 1).alias("last"), F.bit_or("mask").alias("mask"))
            .where(F.col("last") - F.col("first") < 2 * F.col("n"))
            .select("_key", "label", "gram", "least", "first", "last", (covered / F.col("n")).alias("score")))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` of every row: the number of phrase
    places, their smallest and largest start, and the labels, sorted and comma-joined. ``score`` is 1 for a text
    with a phrase, else the largest share of a notice's words that a span holds."""
    text = F.col(text_col).cast("string")
    docs = df.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).alias("_key"), text.alias("_text"))
    found = votes(docs, templates(df.sparkSession, phrases, notices))
    base = F.col("gram") == PHRASE_GRAM
    place = F.when(base, F.col("first"))
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    verdict = spans(found).where(~base | (F.col("score") == 1)).groupBy("_key").agg(
        F.count_if(base).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        joined(base).alias("base_labels"), joined(100 * F.col("score") >= F.col("least")).alias("labels"),
        F.max("score").alias("score"))
    counted = docs.withColumn("_blocks", blocks(F.col("_text"))).select("_key", F.coalesce(
        F.greatest(F.size("_blocks") - 1, F.lit(0)).cast("long") * BLOCK + F.size(words(F.get("_blocks", F.size("_blocks") - 1))),
        F.lit(0)).cast("long").alias("n_words"))
    return (counted.join(verdict, "_key", "left")
            .select(F.col("_key.id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
                    "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
                    F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")))
