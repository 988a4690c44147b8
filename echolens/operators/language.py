"""Language detection by character trigrams: a fitted table of log probabilities, applied map-side.

Texts are lower-cased, everything but letters of the basic plane becomes one blank, and each run of three characters,
blanks around words included, falls into one of ``BINS`` bins by its code points. A model holds, per language, the smoothed
log probability of each bin in thousandths, as whole numbers: sums are exact, whatever their order. A text's language is
the one with the largest sum; the later code wins a tie. Texts without letters are ``unknown``.

Fitting sums counts per task, by language and bin. The model is a table with one row per language, at most
``MOST_LANGUAGES``. Texts are reduced to letters by column expressions; trigrams are counted and scored over whole Arrow
batches by numpy, map-only.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.functions.match import _once
from echolens.functions.text import lower_text

BINS = 8192
SMOOTHING = 0.5
UNKNOWN = "unknown"
MOST_LANGUAGES = 300
PIECE = 1 << 20  # characters scored at a time
NO_LETTERS = r"[[^\p{L}]\x{10000}-\x{10FFFF}]+"


def padded_letters(text: Column) -> Column:
    """The words of a text between blanks; empty without letters."""
    letters = F.trim(F.regexp_replace(lower_text(text), NO_LETTERS, " "))
    return _once(letters, lambda x: F.when(x != "", F.concat(F.lit(" "), x, F.lit(" "))).otherwise(""))


def trigram_bins(text: Column) -> Column:
    """The bin of each trigram of a text, in order, as a column expression; empty without letters."""
    codes = F.transform(F.split(padded_letters(text), ""), F.ascii)
    return _once(codes, lambda c: F.transform(
        F.slice(c, 3, F.greatest(F.size(c) - 2, F.lit(0))),
        lambda third, i: (F.get(c, i) * 961 + F.get(c, i + 1) * 31 + third) % BINS))


def _trigrams(texts: pa.Array):
    """``(texts, bins, starts)``: the numbers of some texts with letters, the bins of their trigrams and the place of the
    first one of each; pieces of bounded size, a single longer text alone."""
    values = texts.to_pylist()
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    at = 0
    while at < len(values):
        end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), PIECE, side="right")) + at)
        some = np.flatnonzero(sizes[at:end]) + at
        if len(some):
            codes = np.frombuffer("".join(values[at:end]).encode("utf-16-le"), "<u2").astype(np.int32)
            bins = (codes[:-2] * 961 + codes[1:-1] * 31 + codes[2:]) % BINS
            ends = np.cumsum(sizes[some])
            inside = np.ones(len(codes), bool)
            inside[ends - 1] = inside[ends - 2] = False  # no trigram begins with the last two characters
            yield some, bins[inside[:-2]], ends - sizes[some] - 2 * np.arange(len(some))
        at = end


def _counted(batches):
    """``(lang, bin, n)`` of batches ``(lang, padded letters)``, summed up per task."""
    counts = {}

    def rows():
        for lang, n in counts.items():
            found = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int32()),
                                              pa.array(n[found], pa.int64())], names=["lang", "bin", "n"])
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for some, bins, starts in _trigrams(batch.column(1)):
            for k, piece in zip(some, np.split(bins, starts[1:])):
                if langs[k] not in counts:
                    if len(counts) == MOST_LANGUAGES:
                        yield from rows()
                        counts.clear()
                    counts[langs[k]] = np.zeros(BINS, np.int64)
                counts[langs[k]] += np.bincount(piece, minlength=BINS)
    yield from rows()


def fit_language_model(df: DataFrame, language="lang", text="text") -> DataFrame:
    """``(lang, weights array<int>)``: the model of labelled texts; rows without a label or text are left out."""
    counts = (df.where(F.col(language).isNotNull())
              .select(F.col(language).cast("string").alias("lang"), padded_letters(F.col(text)).alias("padded"))
              .mapInArrow(_counted, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    # one row per language and bin from here on
    dense = (totals.select("lang", "total", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
             .join(counts, ["lang", "bin"], "left"))
    chance = (F.coalesce("n", F.lit(0)) + SMOOTHING) / (F.col("total") + SMOOTHING * BINS)
    weight = F.round(F.log(chance) * 1000).cast("int")
    entries = F.array_sort(F.collect_list(F.struct("bin", weight.alias("weight"))))
    return dense.groupBy("lang").agg(F.transform(entries, lambda e: e["weight"]).alias("weights"))


def detect_language(df: DataFrame, model: DataFrame, text="text", out="language") -> DataFrame:
    """Add the language of each text by a fitted model."""
    languages = model.orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"a model holds at most {MOST_LANGUAGES} languages")
    names = [r.lang for r in languages]
    weights = [np.array(r.weights, np.int64) for r in languages]

    @F.arrow_udf("string")
    def best(texts: pa.Array) -> pa.Array:
        found = np.full(len(texts), UNKNOWN, object)
        for some, bins, starts in _trigrams(texts):
            scores = np.stack([np.add.reduceat(w[bins], starts) for w in weights])
            winner = len(names) - 1 - np.argmax(scores[::-1], axis=0)  # the later code wins a tie
            found[some] = np.array(names, object)[winner]
        return pa.array(found, pa.string())

    return df.withColumn(out, best(padded_letters(F.col(text))) if weights else F.lit(UNKNOWN))
