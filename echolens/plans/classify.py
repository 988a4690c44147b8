"""End-to-end plans: tiers combined into a classified table, and the report on it."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.functions.match import first_label
from echolens.functions.text import preprocess_text
from echolens.operators import batches, fallback, guards, merge, rules, sampling, scored
from echolens.sources.shared import write_and_read

Tier = Callable[[DataFrame, str], DataFrame]


def term_sentiment(df: DataFrame, text="text_cleaned") -> DataFrame:
    """Model tier without a model: term counts in the canonical vocabulary, calibrated."""
    out = scored.score_sentiment(df.withColumn("_clean", preprocess_text(F.col(text))), "_clean")
    s = F.col("sentiment")
    out = out.withColumns({
        "sentiment": first_label([("positif", s == "POSITIF"), ("negatif", s == "NEGATIF")],
                                 "neutre"),
        "bert_confidence": F.col("sent_conf")}).drop("sent_conf", "_clean")
    return guards.calibrate_sentiment(out, text, "sentiment", "bert_confidence")


def base_tiers(df: DataFrame, text="text_cleaned", scorer: Tier = term_sentiment) -> DataFrame:
    """Model sentiment and rules for every row; rule topic and incident are preliminary."""
    out = scorer(merge.clean_on_demand(df, text), text)
    out = rules.classify_rules(out, text)
    return out.withColumnsRenamed({"topics": "topics_preliminary",
                                   "incident": "incident_preliminary"})


def ask_tier(base: DataFrame, text: str, tier: Tier) -> DataFrame:
    """Run the costly tier on every row of ``base`` and overlay its answer in place.

    The answer is a set of columns of the same row, so nothing is joined.
    """
    packed = base.select(text, F.struct(*base.columns).alias("_base"))
    return tier(packed, text).select(
        *[F.col(f"_base.{c}") for c in base.columns if c != "is_claim"], "is_claim",
        F.col("categorie").alias("topics"), "incident",
        F.col("score_confiance").alias("mistral_confidence"))


def classify(df: DataFrame, text="text_cleaned", mode="balanced", id_col="msg_id",
             scorer: Tier = term_sentiment, llm: Tier = fallback.fallback_local,
             marker=sampling.mark_priority, llm_results: DataFrame | None = None) -> DataFrame:
    """Classify messages; ``mode`` tells which rows the costly tier sees.

    fast: none. balanced: an exact sample. precise: all. Answers that were produced elsewhere
    come in as ``llm_results`` by id and are joined instead. In balanced mode the first tiers
    are written to the shared folder, because the sampler passes over them three times and needs
    three narrow columns only.
    """
    base = base_tiers(df, text, scorer)
    if llm_results is not None:
        merged = merge.merge_tier_results(base, llm_results, id_col) \
            .withColumnRenamed("confidence", "mistral_confidence")
    elif mode == "fast":
        merged = base
    elif mode == "precise":
        merged = ask_tier(base, text, llm)
    elif mode == "balanced":
        marked = marker(write_and_read(base, "tiers"), id_col).drop("stratum")
        chosen, others = marked.where("in_sample"), marked.where("not in_sample")
        merged = ask_tier(chosen.drop("in_sample"), text, llm).unionByName(
            others.drop("in_sample"), allowMissingColumns=True)
    else:
        raise ValueError(f"unknown mode: {mode}")
    merged = merge.aggregate_confidence(merge.backfill_prelim(merged))
    return merge.complete_columns(guards.enforce_consistency(merged, text))


def classify_replies(df: DataFrame, replies: DataFrame, text="text", provider="cloud",
                     id_col="msg_id") -> DataFrame:
    """Classify from language-model replies, one per batch of rows.

    Rows of a batch without a readable reply take the fallback rules. The local model reads the
    text as it is, and only its own answers are guarded. The cloud model reads the preprocessed
    text, its answers are guarded on that, and all rows once more on the original text.
    """
    labels = ["sentiment", "categorie", "score_confiance", "is_claim", "urgence", "topics",
              "incident"]
    given = batches.pad_responses(batches.make_batches(df, id_col),
                                  batches.parse_responses(replies))
    if provider == "local":
        seen, validate, guard, rule_tier = (text, guards.validate_strict, guards.guard_local,
                                            fallback.fallback_local)
    else:
        given = given.withColumn("_seen", preprocess_text(F.col(text)))
        seen, validate, guard, rule_tier = ("_seen", guards.validate_synonyms,
                                            guards.guard_cloud, fallback.fallback_cloud)
    answered = guard(validate(given), seen)
    both = rule_tier(answered.withColumn("_answer", F.struct(*labels)).drop(*labels), seen)
    out = both.withColumns({c: F.when(F.col("answered"), F.col(f"_answer.{c}"))
                            .otherwise(F.col(c)) for c in labels}).drop("_answer")
    return out if provider == "local" else guard(out, text).drop("_seen")
