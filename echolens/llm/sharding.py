"""Sharding by sampled splitters: near-equal bytes per shard, equal texts side by side.

Records are ordered by the hash of their text, so copies of a text are neighbours, then by id.

1. A sample in which a record's chance grows with its size is drawn by a hash of its id, so it is the same
   in every run. Quantiles of its keys, computed as one bounded sketch, are the splitters.
2. Records are dealt to the ranges between splitters. A key sits in the cell of its leading bits, and the
   ranges that touch a cell are found by an equality join with a table of fixed size.
3. Exact bytes of every range show which are overfull, as a text with very many copies makes them; these
   are subdivided by a hash of the id into parts of the intended size.
4. Running sums within each part, on top of the sums of the parts before, give each record's exact place in
   the whole order. A record goes to the shard in which the middle of its bytes falls.

So shards differ from an equal share by at most about one record. Only ids, hashes and sizes are shuffled,
never texts.

Rows: one per input row. A null text has no bytes; its size is the fixed charge alone, its checksum that of
the empty text. Null ids and repeated rows are placed like all others, in any order among equals.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolens.llm.tables import written

RANGES_PER_SHARD = 32
SAMPLE_PER_RANGE = 200     # expected sampled records
CHARGE = 8                 # bytes counted for each record besides its text
CELL_BITS = 14             # leading key bits by which records meet ranges


def splitters(records: DataFrame, n_ranges: int, total: int) -> DataFrame:
    """One row ``(cuts array<bigint>)``: quantile boundaries of a size-weighted sample of the keys."""
    wanted = n_ranges * SAMPLE_PER_RANGE
    draw = F.pmod(F.xxhash64(F.lit("draw"), "id", "key"), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))
    sample = records.where(draw * F.lit(float(max(total, 1))) < F.col("size") * F.lit(float(wanted)))
    points = [k / n_ranges for k in range(1, n_ranges)]
    return sample.agg(F.percentile_approx("key", points, 10_000).alias("cuts"))


def shards(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` of every row; slots count from 0 in each shard."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    records = written(df.select(
        F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + F.lit(CHARGE)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key")), "records")
    total = records.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_ranges = n_shards * RANGES_PER_SHARD

    # ranges by splitter; range r holds keys from cut r on, and meets the cells of its first to last key
    cell = lambda key: F.shiftright(key, 64 - CELL_BITS)
    lowest, highest = F.lit(-(1 << 63)).cast("long"), F.lit((1 << 63) - 1).cast("long")
    bounds = (splitters(records, n_ranges, total)
              .select(F.explode(F.array_union(F.array(lowest), F.coalesce(
                  F.array_sort(F.array_distinct("cuts")), F.array().cast("array<bigint>")))).alias("low")))
    order = Window.orderBy("low")  # over at most n_ranges rows
    ranges = (bounds.select(F.row_number().over(order).alias("range"), "low",
                            F.lead("low").over(order).alias("next"))
              .withColumn("cell", F.explode(F.sequence(
                  cell(F.col("low")), cell(F.coalesce(F.col("next") - 1, highest))))))
    dealt = (records.withColumn("cell", cell(F.col("key")))
             .join(F.broadcast(ranges), "cell")  # at most n_ranges + 2 ** CELL_BITS rows
             .where((F.col("key") >= F.col("low")) & (F.col("next").isNull() | (F.col("key") < F.col("next"))))
             .select("id", "size", "crc", "key", "range"))

    # overfull ranges are subdivided
    target = max(total // n_ranges, 1)
    parts_of = (dealt.groupBy("range").agg(F.sum("size").alias("bytes"))
                .select("range", F.ceil(F.col("bytes") / F.lit(2 * target)).alias("parts")))
    split = written(
        dealt.join(F.broadcast(parts_of), "range")  # one row per range
        .withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")))
                    .otherwise(F.lit(0)))
        .select("id", "size", "crc", "key", "range", "part"), "ranges")

    # sums before each part: there are at most 3 * n_ranges / 2 + 1 parts
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = (split.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
            .select("range", "part",
                    F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                    F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before")))
    inside = Window.partitionBy("range", "part").orderBy("key", "id", "size", "crc")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = (2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")).cast("decimal(38,0)")
    placed = written(
        split.withColumn("upto", F.sum("size").over(running)).withColumn("n", F.row_number().over(inside))
        .join(F.broadcast(base), ["range", "part"])
        .select("id", "size", "crc", (F.col("rows_before") + F.col("n") - 1).alias("place"),
                F.least(F.floor(middle * n_shards / F.lit(2 * max(total, 1)).cast("decimal(38,0)")),
                        F.lit(n_shards - 1)).cast("int").alias("shard")), "placed")
    start = placed.groupBy("shard").agg(F.min("place").alias("start"))
    return (placed.join(F.broadcast(start), "shard")  # one row per shard
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
                    (F.col("place") - F.col("start")).alias("slot")))
