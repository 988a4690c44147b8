"""Rule tier: claim, urgency, topic and incident from term lists.

The column functions expect lower-cased, non-null text (``lower_text``); the DataFrame functions
take the raw column. All work is one narrow stage.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.functions import lexicon as L
from echolens.functions.match import (Hits, any_duration, any_term, any_word, count_terms,
                                      duration_terms, first_label, largest, term_index)
from echolens.functions.text import lower_text


# every list of the tier; its terms are looked for together
RULE_LISTS = [L.CLAIM_TERMS, L.URGENCY_HIGH_TERMS, duration_terms(L.URGENCY_HIGH_DURATIONS),
              L.URGENCY_MEDIUM_TERMS, L.TOPIC_FIBRE_TERMS, L.TOPIC_MOBILE_TERMS,
              L.TOPIC_INVOICE_TERMS, *(words for _, words in L.INCIDENT_WORDS)]


def claim_flag(hits: Hits) -> Column:
    return any_term(hits, L.CLAIM_TERMS).cast("int")


def urgency_label(text: Column, hits: Hits) -> Column:
    high = (any_term(hits, L.URGENCY_HIGH_TERMS)
            | any_duration(text, L.URGENCY_HIGH_DURATIONS, hits))
    return first_label([("haute", high), ("moyenne", any_term(hits, L.URGENCY_MEDIUM_TERMS))],
                       "basse")


def topic_label(fibre: Column, mobile: Column, invoice: Column) -> Column:
    """Topic from the number of distinct terms hit per list; ties favour mobile, then invoice."""
    return first_label([("fibre", (fibre > mobile) & (fibre > invoice)),
                        ("mobile", mobile > invoice), ("facture", invoice > 0)], "autre")


def incident_label(text: Column, hits: Hits) -> Column:
    return first_label([(label, any_word(text, words, hits)) for label, words in L.INCIDENT_WORDS],
                       "aucun")


def classify_rules(df: DataFrame, text="text", extended=True) -> DataFrame:
    """Add ``is_claim, urgence, topics`` and, when extended, ``incident`` with claim as oui/non."""
    t, hits = F.col("_text"), Hits(F.col("_hits"))
    counts = {"_fibre": count_terms(hits, L.TOPIC_FIBRE_TERMS),
              "_mobile": count_terms(hits, L.TOPIC_MOBILE_TERMS),
              "_invoice": count_terms(hits, L.TOPIC_INVOICE_TERMS)}
    claim = claim_flag(hits)
    out = (df.withColumn("_text", lower_text(F.col(text)))
             .withColumn("_hits", term_index(t, *RULE_LISTS))
             .withColumns({"is_claim": F.when(claim == 1, "oui").otherwise("non")
                           if extended else claim,
                           "urgence": urgency_label(t, hits), **counts,
                           **({"incident": incident_label(t, hits)} if extended else {})})
             .withColumn("topics", topic_label(F.col("_fibre"), F.col("_mobile"),
                                               F.col("_invoice"))))
    return out.drop("_text", "_hits", "_fibre", "_mobile", "_invoice")


def rule_statistics(df: DataFrame) -> DataFrame:
    """Totals, claim share and label counts in long form ``(measure, label, value)``.

    Claims are counted on the oui/non form; summing the strings, as the original report does,
    has no meaning. One pass: the grouping sets share a single partial aggregation.
    """
    g = (df.groupingSets([[], ["urgence"], ["topics"]], "urgence", "topics")
           .agg(F.grouping_id().alias("gid"), F.count("*").alias("n"),
                F.count_if(F.col("is_claim") == "oui").alias("claims")))
    total = [("total", "", F.col("n").cast("double")),
             ("claims_count", "", F.col("claims").cast("double")),
             ("claims_percentage", "", F.round(F.col("claims") * 100.0 / F.col("n"), 4))]
    rows = F.when(F.col("gid") == 3, F.array(*[
        F.struct(F.lit(m).alias("measure"), F.lit(k).alias("label"), v.alias("value"))
        for m, k, v in total])).otherwise(F.array(F.struct(
            F.when(F.col("gid") == 1, "urgence").otherwise("topics").alias("measure"),
            F.coalesce("urgence", "topics").alias("label"),
            F.col("n").cast("double").alias("value"))))
    return g.select(F.inline(rows))


def classify_by_lexicon(df: DataFrame, rule_set: str, text="text", out=None, hits: Hits | None = None) -> DataFrame:
    """Label with the most distinct terms hit; ties and no hit follow the rule set's order.

    ``hits`` of an index over the set's lists replace the scans of the text.
    """
    counts = [(label, count_terms(hits or F.col("_text"), terms))
              for label, terms in L.RULE_SETS[rule_set]]
    return (df.withColumn("_text", lower_text(F.col(text)))
              .withColumn(out or rule_set, largest(counts, L.RULE_SET_DEFAULTS[rule_set]))
              .drop("_text"))


def lexicon_hits(text: Column) -> Column:
    """Index of the terms of all rule sets, for ``Hits``."""
    return term_index(lower_text(text), *(terms for rules in L.RULE_SETS.values() for _, terms in rules))


def term_hits(df: DataFrame, id_col: str, rule_set: str, text="text") -> DataFrame:
    """One row per message and matched term: the explanation of a label."""
    terms = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(t).alias("term"))
                      for label, ts in L.RULE_SETS[rule_set] for t in ts])
    return (df.select(id_col, lower_text(F.col(text)).alias("_text"))
              .select(id_col, F.inline(F.filter(terms, lambda x: F.contains(F.col("_text"),
                                                                            x["term"])))))


def term_frequency(hits: DataFrame, min_frequency=5) -> DataFrame:
    """Messages per label and term, rare terms left out."""
    return (hits.groupBy("label", "term").agg(F.count("*").alias("n"))
                .where(F.col("n") >= min_frequency))
