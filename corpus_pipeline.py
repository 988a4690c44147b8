"""Corpus cleaning in five stages; each reads what the one before it has written as Parquet.

Rows with the same ``doc_id`` count as one document in the near-duplicate stage and stay or go together there; all
other stages judge row by row. Null texts fail the quality rules. Tables with further columns keep them.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.llm import bpe, decontaminate, line_dedup, ngram_join, quality_rules
from echolens.llm.queries import tokenizer_file
from echolens.llm.tables import read, written

SHINGLE_WORDS, SIMILARITY = 5, (8, 10)


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the base rules and the language-model threshold."""
    return quality_rules.keep_good(docs, read(spark, folder, "labels"))


def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without repeated passages of lines; a document of which nothing is left goes."""
    cut = line_dedup.cut_passages(docs).where((F.col("removed_chunks") == 0) | (F.trim("text") != ""))
    changed = F.col("removed_chunks") > 0
    new = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text")).otherwise(F.col("row")["n_chars"])
           if "n_chars" in docs.columns else None}
    return cut.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("row")[c]).alias(c)
                        for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates."""
    found = ngram_join.classes(docs, SHINGLE_WORDS, *SIMILARITY)
    gone = written(found.where("doc_id != component_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that contain no test item."""
    return decontaminate.drop_contaminated(docs, read(spark, folder, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Digests of the token ids of every document and of the text that they decode to."""
    return bpe.round_trip(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", benchmark), ("BPE encoding and decoding", tokens)]

ORACLE_SQL = None  # fitted ratios, content-defined chunks and tokens are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
