"""Scored tier: several weighted factors per message, in an upper-case vocabulary.

Sentiment here is the term-count form; model scores come from ``scoring.py`` and a polarity
column can be used through ``polarity_sentiment``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.functions import lexicon as L
from echolens.functions.match import (Hits, any_term, count_terms, first_label, first_term_label,
                                      round_half_even, term_index)
from echolens.functions.text import preprocess_text

# every list of the tier; its terms are looked for together
SCORED_LISTS = [L.SCORED_POSITIVE, L.SCORED_NEGATIVE, L.SCORED_CLAIM, L.SCORED_QUESTION,
                L.SCORED_ACTION, L.SCORED_OUTAGE, L.SCORED_SLOW, L.SCORED_SUPPORT, ["factur"],
                *(terms for rules in (L.SCORED_URGENCY, L.SCORED_THEME) for _, terms in rules)]


def score_sentiment(df: DataFrame, clean="clean", hits: Hits | None = None) -> DataFrame:
    """Add ``sentiment`` and ``sent_conf``: 0 for empty text, 0.6 decided, 0.5 tied.

    ``hits`` of an index over the tier's lists replace the scans of the text, here and below.
    """
    c = F.col(clean)
    terms = hits or c
    pos, neg = F.col("_pos"), F.col("_neg")
    return (df.withColumns({"_pos": count_terms(terms, L.SCORED_POSITIVE),
                            "_neg": count_terms(terms, L.SCORED_NEGATIVE)})
              .withColumns({"sentiment": first_label([("POSITIF", pos > neg),
                                                      ("NEGATIF", neg > pos)], "NEUTRE"),
                            "sent_conf": F.when(c == "", 0.0).when(pos != neg, 0.6)
                                          .otherwise(0.5)})
              .drop("_pos", "_neg"))


def polarity_sentiment(polarity: Column) -> Column:
    """Struct(label, score) from a polarity in -1..1."""
    label = first_label([("POSITIF", polarity > 0.1), ("NEGATIF", polarity < -0.1)], "NEUTRE")
    score = F.when(F.abs(polarity) > 0.1, F.abs(polarity)).otherwise(0.5)
    return F.struct(label.alias("label"), score.alias("score"))


def score_claim(df: DataFrame, raw="text", clean="clean", hits: Hits | None = None) -> DataFrame:
    """Add ``claim_conf`` and ``reclamation``; needs ``sentiment``. Above 0.4 it is a claim.

    The factors are summed in this order as doubles, so that sums on the threshold fall on the
    same side as in the original.
    """
    c = F.col(clean)
    terms = hits or c
    claims = count_terms(terms, L.SCORED_CLAIM)
    question = F.contains(F.coalesce(F.col(raw), F.lit("")), F.lit("?")) \
        | any_term(terms, L.SCORED_QUESTION)
    total = (F.least(claims * F.lit(0.3), F.lit(0.6))
             + F.when(F.col("sentiment") == "NEGATIF", 0.3).otherwise(0.0)
             + F.when(question, 0.15).otherwise(0.0)
             + F.when(any_term(terms, L.SCORED_ACTION), 0.2).otherwise(0.0))
    return (df.withColumn("claim_conf", F.when(c == "", 0.0).otherwise(F.least(total,
                                                                               F.lit(1.0))))
              .withColumn("reclamation", F.when(F.col("claim_conf") > 0.4, "OUI")
                          .otherwise("NON")))


def score_urgency(clean: Column | Hits, is_claim: Column) -> Column:
    """First level with a term, critical first; claims without one are medium.

    "pas urgent" holds the critical term "urgent" and is therefore critical.
    """
    return F.when(~is_claim, "FAIBLE").otherwise(
        first_term_label(clean, L.SCORED_URGENCY, "MOYENNE"))


def score_theme(clean: Column | Hits) -> Column:
    return first_term_label(clean, L.SCORED_THEME, "AUTRE")


def theme_confidence(theme: Column) -> Column:
    return F.when(theme == "AUTRE", 0.5).otherwise(0.7)


def infer_incident(raw: Column, clean: Column | Hits, theme: Column) -> Column:
    return first_label([
        ("PANNE", any_term(clean, L.SCORED_OUTAGE)),
        ("LENTEUR", any_term(clean, L.SCORED_SLOW)),
        ("FACTURATION", (theme == "FACTURE") | any_term(clean, ["factur"])),
        ("PROCESSUS_SAV", any_term(clean, L.SCORED_SUPPORT)),
        ("INFO", F.contains(raw, F.lit("?")))], "AUTRE")


def infer_team(theme: Column, incident: Column) -> Column:
    return first_label([
        ("TECHNIQUE", incident.isin("PANNE", "LENTEUR")),
        ("COMMERCIAL", (theme == "FACTURE") | (incident == "FACTURATION")),
        ("RESEAU", theme == "RESEAU")], "AUTRE")


def global_confidence(sent: Column, claim: Column, theme: Column) -> Column:
    return round_half_even(sent * F.lit(0.25) + claim * F.lit(0.40) + theme * F.lit(0.35), 2)


def classify_scored(df: DataFrame, text="text") -> DataFrame:
    """All scored columns; a null or empty message gets the neutral row with confidence 0."""
    raw = F.coalesce(F.col(text), F.lit(""))
    blank = F.col("_blank")
    theme, incident = F.col("theme"), F.col("type_incident")
    hits = Hits(F.col("_hits"))
    out = (df.withColumns({"clean": preprocess_text(F.col(text)), "_blank": raw == ""})
             .withColumn("_hits", term_index(F.col("clean"), *SCORED_LISTS)))
    out = score_claim(score_sentiment(out, hits=hits), raw=text, hits=hits)
    out = (out.withColumns({"urgence": score_urgency(hits,
                                                     F.col("reclamation") == "OUI"),
                            "theme": score_theme(hits)})
              .withColumns({"theme_conf": F.when(blank, None)
                                           .otherwise(theme_confidence(theme)),
                            "type_incident": infer_incident(raw, hits, theme)})
              .withColumns({"responsable": infer_team(theme, incident),
                            "confiance": F.when(blank, 0.0).otherwise(global_confidence(
                                F.col("sent_conf"), F.col("claim_conf"),
                                F.col("theme_conf"))),
                            "error": F.when(blank, "empty_text")}))
    return (out.withColumns({k: F.when(~blank, F.col(k)) for k in ("sent_conf", "claim_conf")})
               .drop("clean", "_blank", "_hits"))


def classify_scored_record(df: DataFrame, text="text", out="record") -> DataFrame:
    """The scored columns as one struct with a metadata map."""
    kept = df.columns
    flat = classify_scored(df, text)
    metadata = F.map_filter(F.create_map(
        F.lit("sent_conf"), F.col("sent_conf"), F.lit("reclam_conf"), F.col("claim_conf"),
        F.lit("theme_conf"), F.col("theme_conf")), lambda k, v: v.isNotNull())
    return flat.select(*kept, F.struct(
        "sentiment", "reclamation", "urgence", "theme", "type_incident", "responsable",
        "confiance", "error", metadata.alias("metadata")).alias(out))
