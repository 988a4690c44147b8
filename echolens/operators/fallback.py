"""Three self-contained rule classifiers used when no model answer is available.

They take the text as it is (null counts as empty) and add
``sentiment, categorie, score_confiance, is_claim, urgence, topics, incident``.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.functions import lexicon as L
from echolens.functions.match import (Hits, any_term, count_terms, first_label, first_term_label,
                                      largest, round_half_even, term_index)
from echolens.functions.text import lower_text


def fallback_local(df: DataFrame, text="text") -> DataFrame:
    """First-match lists; confidence 0.75, or 0.50 when nothing was recognised."""
    t, sent, cat, claim = (F.col(c) for c in ("_text", "sentiment", "categorie", "is_claim"))
    return (df.withColumn("_text", lower_text(F.col(text)))
              .withColumns({
                  "sentiment": first_term_label(t, [("positif", L.LOCAL_POSITIVE),
                                                    ("negatif", L.LOCAL_NEGATIVE)], "neutre"),
                  "categorie": first_term_label(t, L.LOCAL_CATEGORIES, "autre")})
              .withColumns({
                  "score_confiance": F.when((sent == "neutre") & (cat == "autre"), 0.50)
                                      .otherwise(0.75),
                  "is_claim": F.when((sent == "negatif") | F.contains(t, F.lit("panne")), "oui")
                               .otherwise("non")})
              .withColumns({
                  "urgence": first_label([("haute", any_term(t, L.LOCAL_URGENT)),
                                          ("moyenne", claim == "oui")], "faible"),
                  "topics": cat,
                  "incident": first_term_label(
                      t, L.LOCAL_INCIDENTS,
                      F.when(claim == "non", "aucun").otherwise("non_specifie"))})
              .drop("_text"))


CLOUD_LISTS = [L.CLOUD_POSITIVE, L.CLOUD_NEGATIVE, L.CLOUD_URGENT, L.CLOUD_CLAIM, *(
    terms for rules in (L.CLOUD_CATEGORIES, L.CLOUD_TOPICS, L.CLOUD_INCIDENTS)
    for _, terms in rules)]


def fallback_cloud(df: DataFrame, text="text") -> DataFrame:
    """Count-based lists; confidence grows with the evidence, 0.5 to 0.95."""
    sent, cat, claim = (F.col(c) for c in ("sentiment", "categorie", "is_claim"))
    t = Hits(F.col("_hits"))
    pos, neg, base = F.col("_pos"), F.col("_neg"), F.col("_base")
    categories = [(label, count_terms(t, terms)) for label, terms in L.CLOUD_CATEGORIES]
    graded = lambda n: F.least(F.lit(0.75) + n * F.lit(0.05), F.lit(0.95))
    by_category = first_label([("service_client", cat == "service"),
                               ("support_technique", cat == "support"),
                               ("promotion", cat == "promotion")], cat)
    return (df.withColumn("_hits", term_index(lower_text(F.col(text)), *CLOUD_LISTS))
              .withColumns({"_pos": count_terms(t, L.CLOUD_POSITIVE),
                            "_neg": count_terms(t, L.CLOUD_NEGATIVE),
                            "categorie": largest(categories, "autre"),
                            "_urgent": any_term(t, L.CLOUD_URGENT),
                            "_claim": any_term(t, L.CLOUD_CLAIM)})
              .withColumns({
                  "sentiment": first_label([("positif", pos > neg), ("negatif", neg > 0)],
                                           "neutre"),
                  "_base": F.when(pos > neg, graded(pos)).when(neg > 0, graded(neg))
                            .otherwise(0.60)})
              .withColumns({
                  "_base": base + F.when(cat != "autre", 0.10).otherwise(0.0),
                  "topics": first_term_label(t, L.CLOUD_TOPICS, by_category),
                  "is_claim": F.when((sent == "negatif") | F.col("_claim"), "oui")
                               .otherwise("non")})
              .withColumns({
                  "urgence": F.when(claim == "non", "faible").when(F.col("_urgent"), "haute")
                              .otherwise("moyenne"),
                  "_base": base + F.when((claim == "oui") & F.col("_urgent"), 0.05)
                                   .otherwise(0.0),
                  "incident": F.when(claim == "non", "aucun").otherwise(
                      first_term_label(t, L.CLOUD_INCIDENTS, "non_specifie"))})
              .withColumn("score_confiance", round_half_even(
                  F.greatest(F.lit(0.5), F.least(F.lit(0.95), base)), 2))
              .drop("_hits", "_pos", "_neg", "_urgent", "_claim", "_base"))


def fallback_basic(df: DataFrame, text="text") -> DataFrame:
    """Last resort; fixed confidence 0.75 and its own incident names."""
    t, claim = F.col("_text"), F.col("is_claim")
    return (df.withColumn("_text", lower_text(F.col(text)))
              .withColumn("is_claim", F.when(any_term(t, L.BASIC_CLAIM), "oui").otherwise("non"))
              .withColumns({
                  "sentiment": first_term_label(t, [("positif", L.BASIC_POSITIVE),
                                                    ("negatif", L.BASIC_NEGATIVE)], "neutre"),
                  "urgence": first_label([("haute", any_term(t, L.BASIC_URGENT)),
                                          ("moyenne", claim == "oui")], "faible"),
                  "topics": first_term_label(t, L.BASIC_TOPICS, "autre"),
                  "incident": first_term_label(t, L.BASIC_INCIDENTS, "autre"),
                  "confidence": F.lit(0.75)})
              .drop("_text"))
