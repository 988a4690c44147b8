"""Batches for a language model: positions, prompts, and reading the replies back."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolens.functions import lexicon as L

BLOCK = 1 << 12
GROUP = 1 << 12   # blocks per group of blocks
HASH_BLOCKS = 1 << 20   # for rows without an id, behind all blocks of ids

RESULT_SCHEMA = ("struct<results: array<struct<index: int, sentiment: string, categorie: string, "
                 "score_confiance: double, confidence: double, is_claim: string, "
                 "urgence: string, topics: string, incident: string>>>")
RESULT_FIELDS = ["sentiment", "categorie", "score_confiance", "confidence", "is_claim", "urgence",
                 "topics", "incident"]

PROMPT = (
    "Classe les %1$d messages clients ci-dessous. Réponds par un seul objet JSON "
    '{"results": [...]}, un objet par message, dans l\'ordre, avec les clés index, sentiment, '
    "categorie, score_confiance, is_claim, urgence, topics, incident.\n"
    f"sentiment: {', '.join(L.SENTIMENTS)}\n"
    f"categorie: {', '.join(L.CATEGORIES)}\n"
    f"is_claim: {', '.join(L.CLAIMS)}\n"
    f"urgence: {', '.join(L.URGENCIES)}\n"
    f"topics: {', '.join(L.TOPICS)}\n"
    f"incident: {', '.join(L.INCIDENTS)}\n"
    "score_confiance: nombre de 0.0 à 1.0\n"
    "Messages:\n%2$s")


def number_rows(df: DataFrame, id_col="msg_id", block=BLOCK, out="position") -> DataFrame:
    """Add the 0-based position in the order of a unique integer id; rows without an id come last, in the order of
    a hash of their columns.

    Rows are numbered inside blocks of ``block`` consecutive ids, so no task ever holds more
    than ``block`` rows; blocks are chained by a running sum of their sizes. With sparse ids
    choose a larger block. Rows without an id are dealt to ``HASH_BLOCKS`` blocks by the hash.
    """
    hashed = F.xxhash64(*[f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")])
    blocked = df.withColumn("_block", F.coalesce(
        F.floor(F.col(id_col) / block), F.lit(1 << 52) + F.pmod(hashed, F.lit(HASH_BLOCKS))))
    sizes = blocked.groupBy("_block").agg(F.count("*").alias("_n"))
    inside = Window.partitionBy("_block").orderBy(id_col, hashed)
    return (blocked.join(_block_offsets(sizes), "_block")
                   .withColumn(out, F.col("_offset") + F.row_number().over(inside) - 1)
                   .drop("_block", "_offset"))


def _block_offsets(sizes: DataFrame) -> DataFrame:
    """``(_block, _offset)``: rows in the blocks before each block. The running sum is taken
    inside groups of blocks and over the groups, so that a trillion rows still mean tasks of
    some thousand entries."""
    sizes = sizes.withColumn("_group", F.floor(F.col("_block") / GROUP))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    running = lambda w: F.coalesce(F.sum("_n").over(before(w)), F.lit(0))
    inner = Window.partitionBy("_group").orderBy("_block")
    groups = (sizes.groupBy("_group").agg(F.sum("_n").alias("_n"))
                   .select("_group", running(Window.orderBy("_group")).alias("_base")))
    return (sizes.withColumn("_inner", running(inner)).join(groups, "_group")
                 .select("_block", (F.col("_base") + F.col("_inner")).alias("_offset")))


def make_batches(df: DataFrame, id_col="msg_id", size=50, block=BLOCK) -> DataFrame:
    """Add ``batch_id`` and ``pos``: consecutive batches of ``size`` rows in id order."""
    return (number_rows(df, id_col, block, "_position")
            .withColumns({"batch_id": F.floor(F.col("_position") / size),
                          "pos": (F.col("_position") % size).cast("int")})
            .drop("_position"))


def build_prompts(batches: DataFrame, text="text", template=PROMPT) -> DataFrame:
    """One prompt per batch; a group holds no more rows than a batch."""
    line = F.concat(F.col("pos").cast("string"), F.lit(": "), F.coalesce(F.col(text), F.lit("")),
                    F.lit("\n"))
    lines = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]),
        "")
    return (batches.groupBy("batch_id").agg(F.count("*").cast("int").alias("n"),
                                            lines.alias("lines"))
                   .select("batch_id", "n", F.format_string(template, "n", "lines")
                           .alias("prompt")))


def parse_reply(reply: Column) -> Column:
    """The results array inside a free-text reply; null when no valid JSON object holds one."""
    json = F.regexp_extract(reply, r'(?s)\{.*"results".*\}', 0)
    return F.from_json(json, RESULT_SCHEMA)["results"]


def parse_responses(replies: DataFrame, reply="reply") -> DataFrame:
    return replies.withColumn("results", parse_reply(F.col(reply)))


def pad_responses(batches: DataFrame, parsed: DataFrame) -> DataFrame:
    """One result per input row: missing positions are null, surplus ones are ignored.

    ``answered`` is false for a batch without a readable reply. Both sides meet on the batch
    number, at most one batch of rows per key.
    """
    joined = batches.join(parsed.select("batch_id", "results"), "batch_id", "left")
    result = F.get("results", F.col("pos"))
    return (joined.withColumns({f: result[f] for f in RESULT_FIELDS})
                  .withColumn("answered", F.col("results").isNotNull()).drop("results"))


def tag_provenance(df: DataFrame, method: str, model: str, timestamp: str) -> DataFrame:
    """Who classified the rows and when; ``confidence`` repeats the score."""
    return df.withColumns({"confidence": F.col("score_confiance"),
                           "classification_method": F.lit(method), "model_name": F.lit(model),
                           "classification_timestamp": F.lit(timestamp)})


def classification_stats(df: DataFrame) -> DataFrame:
    """Long form ``(measure, label, value)``: total, label counts and the score's range."""
    g = (df.groupingSets([[], ["sentiment"], ["categorie"]], "sentiment", "categorie")
           .agg(F.grouping_id().alias("gid"), F.count("*").cast("double").alias("n"),
                F.round(F.avg("score_confiance"), 4).alias("avg"),
                F.min("score_confiance").alias("low"), F.max("score_confiance").alias("high")))
    row = lambda m, label, v: F.struct(F.lit(m).alias("measure"), label.alias("label"),
                                       v.alias("value"))
    none = F.lit("")
    return g.select(F.inline(
        F.when(F.col("gid") == 3, F.array(
            row("total_classified", none, F.col("n")), row("avg_confidence", none, F.col("avg")),
            row("min_confidence", none, F.col("low")),
            row("max_confidence", none, F.col("high"))))
         .when(F.col("gid") == 1, F.array(row("sentiment", F.col("sentiment"), F.col("n"))))
         .otherwise(F.array(row("categorie", F.col("categorie"), F.col("n"))))))
