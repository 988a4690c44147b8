"""Validation of model answers and the correction passes.

A pass is defined as ordered steps, later ones overwriting earlier ones. Here each output column is
one CASE with the last step first, so a pass is two projections: term tests, then results. Chains
of overwritten columns would multiply when a later filter on them is pushed down.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.functions import lexicon as L
from echolens.functions.match import (any_term, clamp, first_label, round_half_even,
                                      translate_values)
from echolens.functions.text import lower_text

NO_INCIDENT = ("aucun", "non_specifie")


def _term_flags(df: DataFrame, text: str, flags: dict) -> DataFrame:
    return (df.withColumn("_text", lower_text(F.col(text)))
              .withColumns({f"_{name}": any_term(F.col("_text"), terms)
                            for name, terms in flags.items()})
              .drop("_text"))


def _field(col: Column, default) -> Column:
    """A field as the model gave it, lower-cased and trimmed; null takes the default."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.trim(F.lower(col.cast("string"))), default)


def _one_of(col: Column, values, otherwise) -> Column:
    return F.when(col.isin(*values), col).otherwise(otherwise)


def _topic_and_incident(df: DataFrame) -> DataFrame:
    cat, claim = F.col("categorie"), F.col("is_claim")
    no_incident = F.when(claim == "non", "aucun").otherwise("non_specifie")
    return df.withColumns({
        "topics": _one_of(_field(F.col("topics"), cat), L.TOPICS,
                          _one_of(cat, L.TOPICS, "autre")),
        "incident": _one_of(_field(F.col("incident"), no_incident), L.INCIDENTS, no_incident)})


def validate_strict(df: DataFrame) -> DataFrame:
    """Unknown labels fall back to defaults; score from two keys, default 0.6, 0.4 to 0.99."""
    sent, claim = F.col("sentiment"), F.col("is_claim")
    from_sentiment = F.when(sent == "negatif", "oui").otherwise("non")
    score = F.coalesce(F.col("score_confiance"),
                       F.col("confidence") if "confidence" in df.columns else F.lit(None),
                       F.lit(0.6))
    out = (df.withColumns({
                "sentiment": _one_of(_field(sent, "neutre"), L.SENTIMENTS, "neutre"),
                "categorie": _one_of(_field(F.col("categorie"), "autre"), L.CATEGORIES, "autre"),
                "score_confiance": round_half_even(clamp(score, 0.4, 0.99), 2)})
             .withColumn("is_claim", _one_of(_field(claim, from_sentiment), L.CLAIMS,
                                             from_sentiment))
             .withColumn("urgence", _one_of(
                 _field(F.col("urgence"), "faible"), L.URGENCIES,
                 F.when(claim == "oui", "moyenne").otherwise("faible"))))
    return _topic_and_incident(out)


def _synonym(col: Column, default, groups, otherwise) -> Column:
    raw = _field(col, default)
    return first_label([(to, raw.isin(*words)) for to, words in groups.items()], otherwise)


def validate_synonyms(df: DataFrame) -> DataFrame:
    """Spellings are mapped first; score default 0.5, 0 to 1; urgency inferred when unknown."""
    sent, claim = F.col("sentiment"), F.col("is_claim")
    score = F.coalesce(F.col("score_confiance"), F.lit(0.5))
    out = (df.withColumns({
                "sentiment": _synonym(sent, "neutre", L.SENTIMENT_SYNONYMS, "neutre"),
                "categorie": _synonym(F.col("categorie"), "autre", L.CATEGORY_SYNONYMS, "autre"),
                "score_confiance": round_half_even(clamp(score, 0.0, 1.0), 2)})
             .withColumn("is_claim", _synonym(
                 claim, "non", L.CLAIM_SYNONYMS,
                 F.when(sent == "negatif", "oui").otherwise("non")))
             .withColumn("urgence", _synonym(
                 F.col("urgence"), "faible", L.URGENCY_SYNONYMS,
                 first_label([("haute", (claim == "oui") & (sent == "negatif")),
                              ("moyenne", claim == "oui")], "faible"))))
    return _topic_and_incident(out)


def _claim_and_urgency(claim_flag: Column, urgent_flag: Column) -> dict:
    """Negative sentiment, claim terms and urgent terms only ever raise claim and urgency."""
    raised = (F.col("sentiment") == "negatif") | claim_flag
    urgency = F.col("urgence")
    return {"is_claim": F.when(raised | urgent_flag, "oui").otherwise(F.col("is_claim")),
            "urgence": F.when(urgent_flag, "haute")
                        .when(raised & (urgency == "faible"), "moyenne").otherwise(urgency),
            "score_confiance": clamp(F.col("score_confiance"), 0.4, 0.99)}


def guard_local(df: DataFrame, text="text") -> DataFrame:
    """Correct answers of the local model from the text; service terms override network terms,
    which override billing terms for the topic."""
    names = ("claim", "urgent", "bill", "net", "svc", "box")
    claim, urgent, bill, net, svc, box = (F.col(f"_{n}") for n in names)
    incident, topic = F.col("incident"), F.col("topics")
    flagged = _term_flags(df, text, {
        "claim": L.GUARD_LOCAL_CLAIM, "urgent": L.GUARD_LOCAL_URGENT, "bill": L.BILLING_TERMS,
        "net": [*L.MOBILE_TERMS, "connexion", "wifi"], "svc": L.SERVICE_TERMS,
        "box": L.BOX_TERMS})
    raised = flagged.withColumns(_claim_and_urgency(claim, urgent))
    return raised.withColumns({
        "topics": F.when(svc, "service_client").when(net, "reseau").when(bill, "facture")
                   .otherwise(topic),
        "incident": F.when(bill, "probleme_facturation")
                     .when(net & incident.isin(*NO_INCIDENT), "panne_connexion")
                     .when((incident == "aucun") & (F.col("is_claim") == "oui") & box,
                           "bug_freebox").otherwise(incident)}).drop(*[f"_{n}" for n in names])


def guard_cloud(df: DataFrame, text="text") -> DataFrame:
    """As ``guard_local`` with other lists; the first group with a term decides the topic."""
    names = ("claim", "urgent", "fibre", "box", "bill", "mob", "svc", "net")
    claim, urgent, fibre, box, bill, mob, svc, net = (F.col(f"_{n}") for n in names)
    incident = F.col("incident")
    flagged = _term_flags(df, text, {
        "claim": L.GUARD_CLOUD_CLAIM, "urgent": L.GUARD_CLOUD_URGENT,
        "fibre": ["fibre", "fiber"], "box": L.BOX_TERMS, "bill": L.BILLING_TERMS,
        "mob": L.MOBILE_TERMS, "svc": L.SERVICE_TERMS, "net": ["connexion", "reseau", "wifi"]})
    raised = flagged.withColumns(_claim_and_urgency(claim, urgent))
    unset = incident.isin(*NO_INCIDENT) & ~fibre & ~box
    unexplained = (incident == "aucun") & (F.col("is_claim") == "oui")
    return raised.withColumns({
        "topics": F.when(fibre, "fibre").when(box, "freebox").when(bill, "facture")
                   .when(mob, "mobile").when(svc, "service_client").otherwise(F.col("topics")),
        "incident": F.when(unset & bill, "probleme_facturation")
                     .when(unset & mob, "probleme_mobile")
                     .when(unexplained & net, "panne_connexion")
                     .when(unexplained & box, "bug_freebox")
                     .otherwise(incident)}).drop(*[f"_{n}" for n in names])


def enforce_consistency(df: DataFrame, text="text_cleaned") -> DataFrame:
    """Make the indicators of the merged tiers agree with each other and with the text.

    A message with empty text only gets its claim value normalised and its confidence clipped.
    """
    names = ("claim", "urgent", "bill", "net", "box", "mob", "fibre", "svc")
    claim, urgent, bill, net, box, mob, fibre, svc = (F.col(f"_{n}") for n in names)
    full = F.coalesce(F.col(text), F.lit("")) != ""
    is_claim, urgency = F.col("is_claim") == "oui", F.col("urgence")
    incident, topic = F.col("incident"), F.col("topics")
    flagged = _term_flags(df, text, {
        "claim": L.CONSISTENCY_CLAIM, "urgent": L.CONSISTENCY_URGENT, "bill": L.BILLING_TERMS,
        "net": L.CONSISTENCY_NETWORK, "box": L.BOX_TERMS, "mob": L.MOBILE_TERMS,
        "fibre": ["fibre"], "svc": L.SERVICE_TERMS})
    checked = flagged.withColumn("is_claim", F.when(
        F.lower(F.col("is_claim")).isin(*L.TRUE_WORDS)
        | (full & ((F.col("sentiment") == "negatif") | claim)), "oui").otherwise("non"))
    unset = full & F.lower(incident).isin("aucun", "non_specifie", "non", "")
    other = full & (topic == "autre")
    return checked.withColumns({
        "urgence": F.when(full & urgent, "haute")
                    .when(full & is_claim & (urgency == "faible"), "moyenne").otherwise(urgency),
        "incident": F.when(~F.coalesce(unset, F.lit(False)), incident)
                     .when(bill, "probleme_facturation").when(net, "panne_connexion")
                     .when(box, "bug_freebox").when(mob, "probleme_mobile")
                     .when(is_claim, "non_specifie").otherwise("aucun"),
        "topics": F.when(other & fibre, "fibre").when(other & box, "freebox")
                   .when(other & mob, "mobile").when(other & bill, "facture")
                   .when(other & svc, "service_client").otherwise(topic),
        "confidence": clamp(F.col("confidence"), 0.4, 0.99)}).drop(*[f"_{n}" for n in names])


def calibrate_sentiment(df: DataFrame, text="text", sentiment="sentiment",
                        confidence="confidence") -> DataFrame:
    """Correct a model's sentiment by terms. Any negative term decides first, so the original's
    branch for a positive label with a negative term is never reached and is left out."""
    neg, pos = F.col("_neg"), F.col("_pos")
    s, c = F.col(sentiment), F.col(confidence)
    lift = (s == "neutre") & pos
    return (_term_flags(df, text, {"neg": L.CALIBRATION_NEGATIVE, "pos": L.CALIBRATION_POSITIVE})
            .withColumn(confidence, clamp(
                F.when(neg, F.greatest(c, F.lit(0.75))).when(lift, F.greatest(c, F.lit(0.70)))
                 .otherwise(c), 0.4, 0.99))
            .withColumn(sentiment, F.when(neg, "negatif").when(lift, "positif").otherwise(s))
            .drop("_neg", "_pos"))


def collapse_stars(scores: Column) -> Column:
    """Struct(label, sentiment, confidence) from five logits: softmax, then the largest class."""
    top = F.array_max(scores)
    best = F.array_position(scores, top).cast("int")
    weight = F.aggregate(F.transform(scores, lambda x: F.exp(x - top)), F.lit(0.0),
                         lambda a, x: a + x)
    return F.struct(
        F.element_at(F.array(*[F.lit(x) for x in L.STAR_LABELS]), best).alias("label"),
        F.element_at(F.array(*[F.lit(x) for x in L.STAR_SENTIMENTS]), best).alias("sentiment"),
        (F.lit(1.0) / weight).alias("confidence"))


def star_sentiment(label: Column) -> Column:
    """Sentiment of a star name such as '4 stars'; unknown names are neutral."""
    groups = {}
    for name, sentiment in L.STAR_NAMES.items():
        groups.setdefault(sentiment, []).append(name)
    return first_label([(s, label.isin(*names)) for s, names in groups.items()], "NEUTRE")
