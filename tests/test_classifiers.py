import pytest
from pyspark.sql import functions as F

from echolens.functions import lexicon as L
from echolens.operators import batches, fallback, guards, kpi, rules, scored
from echolens.plans import classify


def test_rule_samples(rows):
    df = rows(["Panne internet depuis ce matin, urgent!", "Super service Free Mobile",
               "Facture trop élevée ce mois", "Lenteur de connexion fibre",
               "Comment activer ma box?", None])
    got = [tuple(r)[2:] for r in rules.classify_rules(df).orderBy("msg_id")
           .select("msg_id", "text", "is_claim", "urgence", "topics", "incident").collect()]
    assert got == [("oui", "haute", "fibre", "connexion"), ("non", "basse", "mobile", "aucun"),
                   ("non", "basse", "facture", "facturation"),
                   ("non", "moyenne", "fibre", "débit"),
                   ("non", "basse", "fibre", "activation"), ("non", "basse", "autre", "aucun")]


def test_urgency_durations_and_case(rows):
    df = rows(["ÇA FAIT 12 SEMAINES", "depuis 3 heures", "depuis trois heures", "totalement HS",
               "parfois"])
    got = [r.urgence for r in rules.classify_rules(df).orderBy("msg_id").collect()]
    assert got == ["haute", "haute", "basse", "haute", "moyenne"]


def test_topic_ties(rows):
    # one fibre, one mobile, none invoice -> mobile; one fibre, one invoice -> invoice
    df = rows(["adsl sms", "adsl montant", "sms montant", "adsl"])
    got = [r.topics for r in rules.classify_rules(df).orderBy("msg_id").collect()]
    assert got == ["mobile", "facture", "facture", "fibre"]


def test_incident_needs_whole_words(rows):
    df = rows(["excellent", "c'est lent.", "bugs", "un bug!", "déblent"])
    got = [r.incident for r in rules.classify_rules(df).orderBy("msg_id").collect()]
    assert got == ["aucun", "débit", "aucun", "technique", "aucun"]


CASES = [
    ("Ma connexion internet ne fonctionne plus depuis 3 jours! C'est inadmissible!",
     {"NEGATIF"}, {"OUI"}, {"ELEVEE", "MOYENNE", "CRITIQUE"}),
    ("Merci @free pour votre excellent service, tout fonctionne parfaitement!",
     {"POSITIF"}, {"NON"}, {"FAIBLE"}),
    ("Bonjour, comment puis-je modifier mon forfait mobile?",
     {"NEUTRE", "POSITIF"}, {"NON"}, {"FAIBLE"}),
    ("URGENT: Panne totale de connexion, impossible de travailler!",
     {"NEGATIF"}, {"OUI"}, {"CRITIQUE", "ELEVEE"}),
    ("Le débit est un peu lent le soir mais ça fonctionne globalement",
     {"NEGATIF", "NEUTRE"}, {"OUI", "NON"}, {"MOYENNE", "FAIBLE"}),
]


def test_scored_cases(rows):
    got = scored.classify_scored(rows([c[0] for c in CASES])).orderBy("msg_id").collect()
    for r, (_, sentiment, claim, urgency) in zip(got, CASES):
        assert r.sentiment in sentiment and r.reclamation in claim and r.urgence in urgency


def test_scored_quirks(rows):
    df = rows(["panne, mais pas urgent", None, "", "@x"])
    got = scored.classify_scored(df).orderBy("msg_id").collect()
    assert got[0].urgence == "CRITIQUE"           # "pas urgent" holds "urgent"
    assert [(r.sentiment, r.confiance, r.error, r.sent_conf) for r in got[1:]] == [
        ("NEUTRE", 0.0, "empty_text", None), ("NEUTRE", 0.0, "empty_text", None),
        ("NEUTRE", 0.17, None, 0.0)]               # 0.35 * 0.5 is just below 0.175


def test_scored_record(rows):
    r = scored.classify_scored_record(rows(["panne"])).first().record
    assert r.metadata == {"sent_conf": 0.6, "reclam_conf": 0.6, "theme_conf": 0.5}


def test_fairness_pairs(spark):
    pairs = ["{} est très {} de la fibre.", "{} n'a plus internet depuis deux jours."]
    data = [(g, p.format(n, s)) for p in pairs for g, n, s in (
        ("f", "Mme Martin", "satisfaite"), ("m", "M. Martin", "satisfait"))]
    df = spark.createDataFrame(data, "g string, text string")
    rates = scored.classify_scored(df).groupBy("g").agg(
        F.avg((F.col("sentiment") == "POSITIF").cast("int")).alias("r")).collect()
    assert abs(rates[0].r - rates[1].r) <= 0.25


def test_cloud_fallback_weights_and_ties(rows):
    df = rows(["box aide service", "sms service", "service aide", "prix"])
    got = [r.categorie for r in fallback.fallback_cloud(df).orderBy("msg_id").collect()]
    assert got == ["produit", "produit", "service", "promotion"]


def test_cloud_confidence(rows):
    df = rows(["merci", "panne urgent", "xyz", "merci super bravo top ravi cool"])
    got = [r.score_confiance for r in fallback.fallback_cloud(df).orderBy("msg_id").collect()]
    assert got == [0.8, 0.85, 0.6, 0.95]


def plain_guard(text, r, local):
    """The guard as ordered steps on one record, to check the single-level CASE against."""
    has = lambda terms: any(t in text for t in terms)
    up = lambda: r.update(is_claim="oui", urgence="moyenne" if r["urgence"] == "faible"
                          else r["urgence"])
    if r["sentiment"] == "negatif":
        up()
    if has(L.GUARD_LOCAL_CLAIM if local else L.GUARD_CLOUD_CLAIM):
        up()
    if has(L.GUARD_LOCAL_URGENT if local else L.GUARD_CLOUD_URGENT):
        r.update(urgence="haute", is_claim="oui")
    unset = ("aucun", "non_specifie")
    if local:
        if has(L.BILLING_TERMS):
            r.update(topics="facture", incident="probleme_facturation")
        if has([*L.MOBILE_TERMS, "connexion", "wifi"]):
            r["topics"] = "reseau"
            if r["incident"] in unset:
                r["incident"] = "panne_connexion"
        if has(L.SERVICE_TERMS):
            r["topics"] = "service_client"
        if r["incident"] == "aucun" and r["is_claim"] == "oui" and "box" in text:
            r["incident"] = "bug_freebox"
    else:
        chain = [("fibre", ["fibre", "fiber"], None), ("freebox", ["box"], None),
                 ("facture", L.BILLING_TERMS, "probleme_facturation"),
                 ("mobile", L.MOBILE_TERMS, "probleme_mobile"),
                 ("service_client", L.SERVICE_TERMS, None)]
        for topic, terms, incident in chain:
            if has(terms):
                r["topics"] = topic
                if incident and r["incident"] in unset:
                    r["incident"] = incident
                break
        if r["incident"] == "aucun" and r["is_claim"] == "oui":
            if has(["connexion", "reseau", "wifi"]):
                r["incident"] = "panne_connexion"
            elif "box" in text:
                r["incident"] = "bug_freebox"
    r["score_confiance"] = max(0.4, min(0.99, r["score_confiance"]))
    return r


WORDS = ["facture", "wifi", "réseau", "box", "fibre", "sav", "urgent", "panne", "ok"]


@pytest.mark.parametrize("local", [True, False])
def test_guards_equal_ordered_steps(spark, local):
    texts = [f"{a} {b}" for a in WORDS for b in WORDS]
    labels = [("negatif", "non", "faible", "autre", "aucun", 1.0),
              ("neutre", "non", "faible", "autre", "aucun", 0.1),
              ("positif", "non", "moyenne", "fibre", "non_specifie", 0.6),
              ("neutre", "oui", "faible", "mobile", "aucun", 0.6),
              ("neutre", "non", "haute", "autre", "information", 0.6)]
    names = ["sentiment", "is_claim", "urgence", "topics", "incident", "score_confiance"]
    data = [(t, *ls) for t in texts for ls in labels]
    df = spark.createDataFrame(data, "text string, sentiment string, is_claim string, "
                               "urgence string, topics string, incident string, "
                               "score_confiance double")
    out = (guards.guard_local if local else guards.guard_cloud)(df)
    want = [(d[0], *plain_guard(d[0], dict(zip(names, d[1:])), local).values()) for d in data]
    assert sorted(tuple(r) for r in out.select("text", *names).collect()) == sorted(want)


def test_consistency_skips_blank_text(spark):
    df = spark.createDataFrame(
        [("", "TRUE", "negatif", "faible", "non", "autre", 1.5),
         ("", "x", "negatif", "faible", "non", "autre", 0.1),
         ("ma box", "non", "neutre", "faible", "non", "autre", 0.5),
         ("sav wifi", "non", "neutre", "faible", "", "autre", 0.5)],
        "t string, is_claim string, sentiment string, urgence string, incident string, "
        "topics string, confidence double")
    got = [tuple(r) for r in guards.enforce_consistency(df, "t").select(
        "is_claim", "urgence", "incident", "topics", "confidence").collect()]
    assert got == [("oui", "faible", "non", "autre", 0.99), ("non", "faible", "non", "autre", 0.4),
                   ("non", "faible", "bug_freebox", "freebox", 0.5),
                   ("oui", "moyenne", "panne_connexion", "service_client", 0.5)]


def test_calibration(spark):
    df = spark.createDataFrame(
        [("merci mais panne", "positif", 0.5), ("bravo", "neutre", 0.5), ("x", "positif", 1.0),
         (None, "neutre", 0.1)], "text string, sentiment string, confidence double")
    got = [tuple(r)[1:] for r in guards.calibrate_sentiment(df).collect()]
    assert got == [("negatif", 0.75), ("positif", 0.7), ("positif", 0.99), ("neutre", 0.4)]


def test_normalise_frames(spark):
    df = spark.createDataFrame([("a", "POSITIVE", "YES"), ("b", "NEGATIVE", "NO")],
                               "text string, sentiment string, is_claim string")
    got = kpi.normalize_kpis(df).collect()
    assert [(r.sentiment, r.is_claim, r.urgence, r.incident, r.confidence, r.theme) for r in got] \
        == [("positif", "oui", "faible", "aucun", 0.5, "AUTRE"),
            ("negatif", "non", "faible", "aucun", 0.5, "AUTRE")]
    alias = spark.createDataFrame([("t", "HIGH", "FIBRE")],
                                  "text string, priority string, category string")
    r = kpi.normalize_kpis(alias).first()
    assert (r.urgence, r.theme) == ("HIGH", "FIBRE")     # aliases are copied as they are


def test_severity(spark):
    from echolens.operators.charts import incident_severity
    names = ["aucun", "INFORMATION ", "panne_connexion", "incident_technique", "livraison", "zzz",
             "probleme_facturation"]
    df = spark.createDataFrame([(n,) for n in names], "i string")
    assert [r[0] for r in df.select(incident_severity(F.col("i"))).collect()] == [
        "none", "info", "real", "real", "real", "other", "real"]


def test_reply_parsing(spark):
    replies = [
        (0, 'Voici:\n{"results": [{"index": 0, "sentiment": "POSITIF"},\n {"index": 1}]}\nfin'),
        (1, '{"results": [{"index": 0'), (2, "no json"), (3, '{"results": []}'),
        (4, '{"results": [{"sentiment": "negatif", "score_confiance": "abc", "urgence": 5}]}'),
        (5, None)]
    df = spark.createDataFrame(replies, "batch_id bigint, reply string")
    got = {r.batch_id: r.results for r in batches.parse_responses(df).collect()}
    assert [x.sentiment for x in got[0]] == ["POSITIF", None]
    assert got[1] is None and got[2] is None and got[3] == [] and got[5] is None
    assert got[4][0].sentiment == "negatif" and got[4][0].score_confiance is None


def test_classification_ignores_order_and_partitions(spark, rows):
    df = rows([c[0] for c in CASES] * 20)
    key = lambda d: sorted(tuple(r) for r in d.collect())
    a = key(classify.classify(df.repartition(1), mode="balanced"))
    b = key(classify.classify(df.orderBy(F.desc("msg_id")).repartition(5), mode="balanced"))
    assert a == b
    with pytest.raises(ValueError):
        classify.classify(df, mode="other")


def test_modes_agree_where_no_tier_is_asked(spark, rows):
    df = rows(["bonjour", "merci beaucoup"])
    fast = classify.classify(df, mode="fast").select("msg_id", "sentiment").collect()
    precise = classify.classify(df, mode="precise").select("msg_id", "sentiment").collect()
    assert sorted(fast) == sorted(precise)
