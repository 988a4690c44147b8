"""Document filter: base rules, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into ``BINS`` bins. Two multinomials over the bins, each with additive
smoothing, are estimated: the target from trusted documents (labelled as good and not toxic), the raw
one from all documents. A document's score is the sum of log(target / raw) over its words and pairs,
divided by their number. A mean over a whole text hides a few bad words, so a second score, the word score, is the
mean of the lowest ``TAIL_PERCENT`` of the ratios of single words, in ``WORD_BINS`` bins of their own. Every document
is kept or dropped by one fixed threshold on each score; nothing is drawn at random.

Both thresholds are read off exact histograms of held-out scores: the trusted documents are dealt to two halves by their
id, and each half that passes the base rules is scored by the counts of the other. The word score's threshold is the
``LOSS`` quantile, the mean score's lies ``MARGIN`` below it.

The classifier is fitted on all trusted documents, whose packed bins are written and counted by halves. The ids meet
the documents in a shuffled semi-join, for which each text travels once, since ids grow with the labels. Corpus counts cover all documents; each task sends one packed partial sum, and these are added in two
steps. What reaches the driver is one table of ``BINS + WORD_BINS`` numbers.

Rows: one per input row. A null text has no words, a text without words scores 0; both fail the base rules. A document with
several label rows is trusted if all of them call it good and not toxic; a null ``toxic`` counts as not toxic, a null
``quality`` as not good. Without trusted documents in both halves there is no verdict to give and the base rules
decide alone.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.tables import batch_of, in_batches, tree_sum, written
from echolens.llm.words import Texts, mix, parts, windows

BINS_LOG2 = 14
BINS = 1 << BINS_LOG2
WORD_BINS_LOG2 = 20  # so that rare words hardly share one with common words
WORD_BINS = 1 << WORD_BINS_LOG2
TAIL_PERCENT = 1
SMOOTHING = 0.5
LOSS = 0.005         # the word threshold is this quantile of the held-out scores, the other MARGIN below it
MARGIN = 0.05
STEPS = 1024         # histogram steps per unit of score
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS)] = 1
_CHARACTER = np.ones(256, np.int64)         # 1 for the first byte of a character that is no space
_CHARACTER[[9, 10, 11, 12, 13, 32, *range(0x80, 0xC0)]] = 0

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _sums(table: np.ndarray, texts: Texts) -> np.ndarray:
    """Sum of a byte table over each text."""
    out = np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        out[i] = table[texts.data[texts.offsets[i]:texts.offsets[i + 1] - 1]].sum()
    return out


def repeated_words(words: np.ndarray, n: int = 3) -> int:
    """Words that lie in an n-word window found at least twice, the first one included."""
    found = windows(words, n)
    if len(found) < 2:
        return 0
    _, where, counts = np.unique(found, return_inverse=True, return_counts=True)
    twice = counts[where] > 1
    if not twice.any():
        return 0
    covered = np.zeros(len(words), bool)
    for k in range(n):
        covered[k:k + len(found)] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def bins(words: np.ndarray) -> np.ndarray:
    """Bins of the words and word pairs of one text."""
    grams = np.concatenate((mix(words), windows(words, 2)))
    return (grams >> np.uint64(64 - BINS_LOG2)).astype(np.int64)


def word_bins(words: np.ndarray) -> np.ndarray:
    return (mix(words) >> np.uint64(64 - WORD_BINS_LOG2)).astype(np.int64)


def pack(found: np.ndarray) -> bytes:
    """Bins of a text in ascending order, as differences, their low bytes first."""
    steps = np.diff(np.sort(found), prepend=0).astype("<u4")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.cumsum(steps, dtype=np.int64)


def all_bins(words: np.ndarray) -> np.ndarray:
    """Bins of words and pairs, and behind them those of single words."""
    return np.concatenate((bins(words), BINS + word_bins(words)))


def _bins_of_texts(batch: pa.RecordBatch):
    for part in parts([batch]):
        texts = Texts([t or b"" for t in part.column(1).to_pylist()])
        for i in range(len(texts)):
            yield all_bins(texts.words(i))


def _bins_of_profiles(batch: pa.RecordBatch):
    return map(unpack, batch.column(1).to_pylist())


def corpus_counts(rows: DataFrame, bins_of=_bins_of_texts) -> np.ndarray:
    """Counts by bin over rows ``(id, text as binary)`` or over profiles."""
    size = BINS + WORD_BINS

    def counts(batches):
        held, n_held = [], 0
        for batch in batches:
            for found in bins_of(batch):
                held.append(found)
                n_held += len(found)
                if n_held >= size:  # counted together, since each count goes over all bins
                    yield np.bincount(np.concatenate(held), minlength=size)
                    held, n_held = [], 0
        if n_held:
            yield np.bincount(np.concatenate(held), minlength=size)

    total = tree_sum(rows, counts, np.int64)
    return np.zeros(size, np.int64) if total is None else total


def fails(words: np.ndarray) -> bool:
    return len(words) < MIN_WORDS or 100 * repeated_words(words) > REPEAT_PERCENT * len(words)


def profiles(docs: DataFrame) -> DataFrame:
    """``(failed, found, _id)`` of rows ``(_id, text as binary)``: the base rules' verdict and the packed bins."""
    out = pa.schema([("failed", pa.bool_()), ("found", pa.binary()), ("_id", pa.int64())])

    def run(batches):
        for part in parts(batches):
            texts = Texts([t or b"" for t in part.column(1).to_pylist()])
            words = [texts.words(i) for i in range(len(texts))]
            yield batch_of(out, [[fails(w) for w in words], [pack(all_bins(w)) for w in words], part.column(0)])

    return in_batches(docs, run, "failed boolean, found binary, _id long")


def mean_score(found: np.ndarray, ratio: np.ndarray) -> float:
    return float(ratio[found].mean()) if len(found) else 0.0


def word_score(found: np.ndarray, ratio: np.ndarray) -> float:
    """Mean of the lowest ratios of the words."""
    if not len(found):
        return 0.0
    k = len(found) * TAIL_PERCENT // 100
    return float(np.partition(ratio[found], k)[:k + 1].mean())


def profile_scores(rows: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``(mean, word)``: both scores of each profile."""
    out = pa.schema([("mean", pa.float64()), ("word", pa.float64())])

    def run(batches):
        for batch in batches:
            found = list(_bins_of_profiles(batch))
            at = [int(np.searchsorted(x, BINS)) for x in found]
            yield batch_of(out, [[mean_score(x[:k], ratios[:BINS]) for x, k in zip(found, at)],
                                 [word_score(x[k:] - BINS, ratios[BINS:]) for x, k in zip(found, at)]])

    return in_batches(rows, run, "mean double, word double")


def _table(total: np.ndarray) -> np.ndarray:
    """Smoothed log probabilities, of the two kinds of bins each by itself."""
    return np.concatenate([np.log((t + SMOOTHING) / (t + SMOOTHING).sum()) for t in (total[:BINS], total[BINS:])])


def _low_quantile(scored: DataFrame, score: str) -> float:
    """The ``LOSS`` quantile of a score, by an exact histogram; without any score below all numbers."""
    steps = sorted((r[0], r[1]) for r in scored.groupBy(
        F.floor(F.col(score) * STEPS).cast("long").alias("step")).count().collect())
    total, seen = sum(n for _, n in steps), 0
    for step, n in steps:  # scores lie within twice log(bins * words), so the steps are few
        seen += n
        if seen > LOSS * total:
            return step / STEPS
    return -math.inf


def _base_failed() -> F.Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def measure(docs: DataFrame, ratio: np.ndarray, word_ratio: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """``(id, base columns, score, word_score)`` of rows ``(id, text as binary)``; map-only."""
    fields = [(id_col, pa.int64())] + [(b, pa.int64()) for b in BASE] + [("score", pa.float64()), ("word_score", pa.float64())]
    out = pa.schema(fields)

    def run(batches):
        for part in parts(batches):
            raw = [t or b"" for t in part.column(1).to_pylist()]
            texts = Texts(raw)
            words = [texts.words(i) for i in range(len(texts))]
            scores = [mean_score(bins(w), ratio) for w in words]
            lowest = [word_score(word_bins(w), word_ratio) for w in words]
            yield batch_of(out, [part.column(0), [len(w) for w in words], _sums(_CHARACTER, texts),
                                 _sums(_SYMBOL, texts), [duplicate_lines(t) for t in raw],
                                 [repeated_words(w) for w in words], scores, lowest])

    return in_batches(docs, run, f"`{id_col}` long, " + ", ".join(f"{b} long" for b in BASE)
                           + ", score double, word_score double")


def trusted_ids(labels: DataFrame, most: int | None = None) -> DataFrame:
    """``_id`` of all trusted documents, or of more than ``most`` those with the lowest hashes."""
    good = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    trusted = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id"))
               .agg(F.bool_and(good).alias("good")).where("good").select("_id", F.xxhash64("_id").alias("_hash")))
    if most is None:
        return trusted.select("_id")
    n = trusted.count()
    if n > 2 * most:  # so that little more than ``most`` rows are sorted, however many there are
        trusted = trusted.where(F.col("_hash") < int((1 << 64) * 1.2 * most / n) - (1 << 63))
    return trusted.orderBy("_hash", "_id").limit(most).select("_id")


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id",
        text_col: str = "text") -> tuple[np.ndarray, float, np.ndarray, float]:
    """Log ratios per bin and the threshold, of the mean score and of the word score; what reaches the driver has a
    fixed size."""
    docs = _plain(df, id_col, text_col)
    ids = trusted_ids(labels).hint("shuffle_hash")  # not broadcast, at any size
    good = written(profiles(docs.join(ids, "_id", "left_semi"))
                   .select("failed", "found", F.pmod(F.xxhash64("_id"), F.lit(2)).alias("half")), "trusted")
    raw = _table(corpus_counts(docs))
    halves = [corpus_counts(good.where(F.col("half") == k).select("failed", "found"), _bins_of_profiles) for k in (0, 1)]
    ratios = _table(halves[0] + halves[1]) - raw
    threshold = word_threshold = -math.inf
    if all(h.any() for h in halves):
        held_out = [profile_scores(good.where((F.col("half") == k) & ~F.col("failed")).select("failed", "found"),
                                   _table(halves[1 - k]) - raw) for k in (0, 1)]
        scored = written(held_out[0].unionAll(held_out[1]), "scores")
        threshold, word_threshold = _low_quantile(scored, "mean") - MARGIN, _low_quantile(scored, "word")
    return ratios[:BINS], threshold, ratios[BINS:], word_threshold


def _plain(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("_id"),
                     F.col(text_col).cast("string").cast("binary").alias("_text"))


def apply_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``(id, base columns, score, word_score, base_failed, kept)`` of every row.

    ``labels`` holds ``(doc_id, quality, toxic)`` of some documents; rows with null ids are ignored.
    """
    ratio, threshold, word_ratio, word_threshold = fit(df, labels, id_col, text_col)
    return (measure(_plain(df, id_col, text_col), ratio, word_ratio, "_id").withColumnRenamed("_id", id_col)
            .withColumn("base_failed", _base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(float(threshold)))
                        & (F.col("word_score") >= F.lit(float(word_threshold)))))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``df``, all columns as they are; map-only after fitting."""
    ratio, threshold, word_ratio, word_threshold = fit(df, labels, id_col, text_col)
    place = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts, mask = batch.column(place).cast(pa.binary()), []
            for part in parts([pa.RecordBatch.from_arrays([texts, texts], ["a", "b"])]):
                of = Texts([t or b"" for t in part.column(1).to_pylist()])
                for i in range(len(of)):
                    w = of.words(i)
                    mask.append(not fails(w) and mean_score(bins(w), ratio) >= threshold
                                and word_score(word_bins(w), word_ratio) >= word_threshold)
            yield batch.filter(pa.array(mask, pa.bool_()))

    return in_batches(df, run, df.schema)
