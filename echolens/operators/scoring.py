"""Model scoring on Arrow batches, with a pluggable scorer, and the trainable text baseline."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, StringIndexer, \
    VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.functions import lexicon as L
from echolens.operators.guards import calibrate_sentiment, collapse_stars
from echolens.sources.shared import shared_folder, write_and_read

# A loader runs once per Python worker task and returns the function that scores one batch:
# texts -> five logits per text.
ScorerLoader = Callable[[], Callable[[pd.Series], np.ndarray]]


def term_scorer() -> Callable[[pd.Series], np.ndarray]:
    """Default scorer: five logits from the numbers of positive and negative terms."""
    def score(texts: pd.Series) -> np.ndarray:
        texts = texts.str.lower()
        count = lambda terms: sum(texts.str.contains(t, regex=False).astype("int64")
                                  for t in terms).to_numpy(dtype="float64")
        balance = np.clip(count(L.SCORED_POSITIVE) - count(L.SCORED_NEGATIVE), -2, 2)
        return -np.abs(balance[:, None] - np.arange(-2.0, 3.0)[None, :])
    return score


def score_logits(loader: ScorerLoader):
    """Pandas UDF text -> logits. A batch that fails yields nulls; a loader that fails ends the job."""
    @F.pandas_udf("array<double>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = loader()
        for texts in batches:
            try:
                yield pd.Series(list(score(texts.fillna(""))), index=texts.index)
            except Exception:
                yield pd.Series([None] * len(texts), index=texts.index)
    return udf


def score_batches(df: DataFrame, text="text", loader: ScorerLoader = term_scorer,
                  calibrate=True) -> DataFrame:
    """Add ``sentiment, sentiment_detail, sentiment_confidence`` from a five-class scorer, and ``scorer_failed``: rows of
    a batch that the scorer failed on read as neutral and can be counted.

    Only the scorer runs in Python; softmax, the step from five classes to three and the
    calibration are column expressions. The batch size is
    ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    stars = (df.withColumn("_logits", score_logits(loader)(F.col(text)))
               .withColumn("_s", collapse_stars(F.col("_logits"))))
    failed = F.col("_logits").isNull()
    neutral = lambda value, default: F.when(failed, default).otherwise(value)
    out = stars.withColumns({
        "scorer_failed": failed,
        "sentiment": neutral(F.col("_s.sentiment"), "neutre"),
        "sentiment_detail": neutral(F.col("_s.label"), "neutre"),
        "sentiment_confidence": neutral(F.col("_s.confidence"), 0.5)})
    if calibrate:
        out = calibrate_sentiment(out, text, "sentiment", "sentiment_confidence")
        out = out.withColumns({"sentiment": neutral(F.col("sentiment"), "neutre"),
                               "sentiment_confidence": neutral(F.col("sentiment_confidence"),
                                                               0.5)})
    return out.drop("_logits", "_s")


def overlap_theme_scorer() -> Callable[[pd.Series], pd.DataFrame]:
    """Default theme scorer: the candidate whose theme has most terms in the text."""
    themes = dict(L.SCORED_THEME)

    def score(texts: pd.Series) -> pd.DataFrame:
        texts = texts.str.lower()
        hits = np.column_stack([
            sum(texts.str.contains(t, regex=False).astype("int64") for t in themes[theme])
            if theme in themes else np.zeros(len(texts), dtype="int64")
            for _, theme in L.THEME_CANDIDATES])
        best, total = hits.argmax(axis=1), hits.sum(axis=1)
        best[total == 0] = len(L.THEME_CANDIDATES) - 1
        share = np.where(total > 0, hits.max(axis=1) / np.maximum(total, 1), 0.5)
        return pd.DataFrame({"candidate": [L.THEME_CANDIDATES[i][0] for i in best],
                             "score": share})
    return score


def zero_shot_theme(df: DataFrame, text="text", loader=overlap_theme_scorer) -> DataFrame:
    """Add ``theme, theme_score`` from a scorer over candidate sentences; reads whole texts."""
    @F.pandas_udf("candidate string, score double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = loader()
        for texts in batches:
            yield score(texts.fillna(""))

    names = F.create_map(*[F.lit(x) for kv in L.THEME_CANDIDATES for x in kv])
    return (df.withColumn("_z", udf(F.col(text)))
              .withColumns({"theme": F.coalesce(F.try_element_at(names, F.col("_z.candidate")),
                                                F.lit("AUTRE")),
                            "theme_score": F.col("_z.score")}).drop("_z"))


def text_baseline(label: str, text="text", max_features=5000, iterations=30) -> Pipeline:
    """TF-IDF over word 1- and 2-grams with logistic regression, as a Spark ML pipeline.

    Term counts are aggregated by Spark; what reaches the driver is the vocabulary, bounded by
    ``max_features``, and the coefficients.
    """
    half = max_features // 2
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip",
                      stringOrderType="frequencyDesc"),
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}_]+",
                       minTokenLength=2),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        CountVectorizer(inputCol="_words", outputCol="_tf1", vocabSize=max_features - half),
        CountVectorizer(inputCol="_pairs", outputCol="_tf2", vocabSize=half),
        VectorAssembler(inputCols=["_tf1", "_tf2"], outputCol="_tf"),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(labelCol="_label", featuresCol="_features", maxIter=iterations,
                           regParam=0.01)])


def train_text_baseline(train: DataFrame, test: DataFrame, label: str, id_col: str, text="text",
                        max_features=5000) -> DataFrame:
    """Fit on ``train`` and return ``(id, label, prediction)`` for ``test`` as strings.

    Each stage that is fitted passes over its input, the regression many times. Words are therefore written
    to the shared folder once, and so are the term counts, instead of being found again in every pass. The
    model is saved there too and loaded again: a freshly fitted one drags its training summary,
    and with it the session, into the scoring tasks.
    """
    known = F.col(text).isNotNull() & F.col(label).isNotNull()
    indexer, tokenizer, *counters, idf, regression = text_baseline(label, text, max_features).getStages()
    words = write_and_read(tokenizer.transform(train.where(known).select(id_col, text, label))
                           .select(label, tokenizer.getOutputCol()), "train")
    counted = Pipeline(stages=[indexer, *counters]).fit(words)
    counts = write_and_read(counted.transform(words).select("_label", idf.getInputCol()), "counts")
    fitted = Pipeline(stages=[idf, regression]).fit(counts)
    path = shared_folder(words.sparkSession, "model")
    labels, *terms = counted.stages
    PipelineModel([labels, tokenizer, *terms, *fitted.stages]).write().save(path)
    model = PipelineModel.load(path)
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    scored = model.transform(test.where(known).select(id_col, text, label))
    return scored.select(id_col, F.col(label).cast("string").alias("label"),
                         F.element_at(names, F.col("prediction").cast("int") + 1)
                          .alias("prediction"))
