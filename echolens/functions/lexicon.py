"""Word lists, label sets and synonym tables used by the classification rules.

Everything in this module is data. All lists hold lower-case terms and are matched as
substrings of lower-cased text; the matching itself lives in ``match.py``.
"""

# ---------------------------------------------------------------------------
# The rule tier.
# ---------------------------------------------------------------------------
CLAIM_TERMS = [
    "réclamation", "plainte", "réclame", "je réclame",
    "problème", "souci", "bug", "erreur", "dysfonctionnement", "défaillance", "panne", "coupure",
    "interruption", "déconnexion", "perte de connexion",
    "ne fonctionne pas", "ne marche pas", "ça ne marche pas", "ne fonctionne plus", "marche plus",
    "fonctionne plus", "impossible de", "n'arrive pas", "ne peut pas",
    "plus de connexion", "plus d'internet", "plus de réseau", "sans connexion", "sans internet",
    "sans réseau", "aucune connexion", "aucun internet", "aucun réseau",
    "déçu", "mécontent", "insatisfait", "catastrophe", "scandale", "honteux", "inadmissible",
    "inacceptable", "ras le bol", "en ai marre", "j'en ai marre",
    "remboursement", "dédommagement", "compensation", "résiliation", "résilier",
    "changer d'opérateur", "partir de", "quitter free",
    "nul", "pourri", "minable", "catastrophique", "lamentable", "pire",
    "depuis plusieurs jours", "depuis une semaine", "toujours pas", "encore rien",
]

URGENCY_HIGH_TERMS = [
    "urgent", "urgence", "immédiat", "tout de suite", "rapidement", "au plus vite",
    "critique", "grave", "sérieux", "important", "prioritaire",
    "panne totale", "coupure totale", "coupure complète", "coupure générale",
    "plus de connexion", "plus d'internet", "plus de réseau", "sans connexion", "sans internet",
    "sans réseau", "aucune connexion", "aucun réseau", "aucun internet", "plus rien",
    "complètement hs", "totalement hs",
    "depuis plusieurs jours", "depuis une semaine", "depuis des jours",
    "télétravail", "travail", "professionnel", "professionnelle", "entreprise", "société",
    "business", "bureau", "en télétravail", "pour le travail", "au travail",
    "réseau entreprise", "réseau professionnel", "connexion entreprise",
    "toujours", "encore", "systématiquement", "à chaque fois", "tous les jours", "chaque jour",
    "en permanence",
]

# a phrase, a number, a unit of time
URGENCY_HIGH_DURATIONS = [
    ("depuis", "jours"), ("depuis", "semaines"), ("depuis", "heures"),
    ("ça fait", "jours"), ("ça fait", "semaines"),
]

URGENCY_MEDIUM_TERMS = [
    "problème", "souci", "bug", "lenteur", "ralentissement", "parfois", "de temps en temps",
    "occasionnellement",
]

TOPIC_FIBRE_TERMS = [
    "fibre", "box", "freebox", "internet", "wifi", "connexion internet", "débit", "ligne", "adsl",
    "réseau fixe",
]
TOPIC_MOBILE_TERMS = [
    "mobile", "4g", "5g", "forfait mobile", "réseau mobile", "appel", "sms", "data", "roaming",
    "carte sim", "free mobile",
]
TOPIC_INVOICE_TERMS = [
    "facture", "facturation", "paiement", "prélèvement", "montant", "prix", "tarif", "abonnement",
    "coût", "euros", "€",
]

# whole words, first label wins
INCIDENT_WORDS = [
    ("connexion", ["panne", "coupure", "déconnexion", "pas de connexion", "plus de connexion"]),
    ("débit", ["lent", "lenteur", "ralentissement", "débit", "vitesse"]),
    ("activation", ["activation", "activer", "installer", "installation"]),
    ("facturation", ["facture", "surfacturation", "prélèvement", "montant erroné"]),
    ("technique", ["bug", "erreur", "dysfonctionnement", "ne fonctionne pas"]),
    ("service_client", ["service client", "sav", "support", "assistance", "hotline"]),
]

# ---------------------------------------------------------------------------
# The configurable pattern sets. A rule set is an ordered list of
# (label, terms); the order breaks ties.
# ---------------------------------------------------------------------------
RULE_SETS = {
    "reclamation": [
        ("OUI", ["problème", "panne", "coupé", "lent", "bug", "erreur", "dysfonctionnement",
                 "insatisfait", "mécontent", "déçu", "frustré", "énervé", "colère", "réclamation",
                 "plainte", "insatisfaction", "défaillance"]),
    ],
    "theme": [
        ("FIBRE", ["fibre", "internet", "débit", "connexion", "wifi", "box", "freebox", "ligne",
                   "adsl", "vdsl", "fibre optique"]),
        ("MOBILE", ["mobile", "téléphone", "portable", "smartphone", "forfait", "data", "sms",
                    "appel", "réseau mobile", "4g", "5g"]),
        ("TV", ["télévision", "tv", "chaîne", "canal", "programme", "replay", "streaming",
                "netflix", "prime", "disney"]),
        ("FACTURE", ["facture", "facturation", "prix", "coût", "tarif", "abonnement", "paiement",
                     "prélèvement", "montant"]),
        ("SAV", ["sav", "service client", "support", "assistance", "aide", "technicien",
                 "intervention", "rendez-vous"]),
        ("RESEAU", ["réseau", "infrastructure", "antenne", "couverture", "signal", "zone blanche",
                    "déploiement"]),
    ],
    "sentiment": [
        ("NEGATIF", ["nul", "horrible", "catastrophe", "dégoûté", "énervé", "frustré", "déçu",
                     "insatisfait", "mécontent", "colère", "rage"]),
        ("POSITIF", ["super", "excellent", "génial", "parfait", "content", "satisfait", "ravi",
                     "heureux", "merci", "bravo", "félicitations"]),
    ],
    "urgence": [
        ("CRITIQUE", ["urgence", "critique", "grave", "bloqué", "impossible", "catastrophe",
                      "plus rien ne fonctionne", "totalement coupé"]),
        ("ELEVEE", ["depuis longtemps", "plusieurs heures", "toute la journée",
                    "depuis ce matin", "depuis hier", "urgent"]),
    ],
    "type_incident": [
        ("PANNE", ["panne", "coupé", "ne fonctionne plus", "plus de service", "dysfonctionnement",
                   "arrêt"]),
        ("LENTEUR", ["lent", "lenteur", "débit faible", "ralentissement", "performance"]),
        ("FACTURATION", ["facture", "facturation", "prix", "coût", "tarif", "montant"]),
        ("PROCESSUS_SAV", ["sav", "service client", "support", "assistance", "technicien"]),
    ],
}
RULE_SET_DEFAULTS = {
    "reclamation": "NON", "theme": "AUTRE", "sentiment": "NEUTRE", "urgence": "FAIBLE",
    "type_incident": "AUTRE",
}

# ---------------------------------------------------------------------------
# The scored tier.
# ---------------------------------------------------------------------------
SCORED_POSITIVE = ["merci", "super", "bravo", "excellent", "génial", "top", "parfait"]
SCORED_NEGATIVE = ["panne", "nul", "mauvais", "honte", "catastrophe", "inadmissible"]
SCORED_CLAIM = [
    "problème", "panne", "bug", "erreur", "défaut", "réclamation", "plainte", "insatisfait",
    "mécontent", "résoudre", "réparer", "rembourser", "compensation", "service client", "sav",
    "assistance", "aide", "ne fonctionne pas", "ça marche pas", "bloqué", "impossible",
    "toujours pas", "depuis des jours", "aucune réponse", "toujours rien", "pas de nouvelles",
    "inadmissible", "honteux", "scandaleux", "catastrophe",
]
SCORED_QUESTION = ["pourquoi", "comment", "quand", "où", "combien", "qui", "que", "quoi"]
SCORED_ACTION = [
    "résoudre", "réparer", "rembourser", "annuler", "contacter", "régler", "traiter", "expliquer",
    "comprendre",
]
SCORED_URGENCY = [
    ("CRITIQUE", ["urgent", "critique", "grave", "catastrophique", "immédiatement",
                  "urgentissime", "très urgent", "extrêmement urgent"]),
    ("ELEVEE", ["important", "rapidement", "vite", "priorité", "pressé", "au plus vite",
                "dès que possible"]),
    ("MOYENNE", ["bientôt", "quand possible", "sous peu"]),
    ("FAIBLE", ["pas pressé", "pas urgent", "quand vous pouvez"]),
]
SCORED_THEME = [
    ("FIBRE", ["fibre", "ftth", "adsl", "internet fixe"]),
    ("MOBILE", ["mobile", "4g", "5g", "forfait mobile", "téléphone"]),
    ("TV", ["tv", "télévision", "freebox tv", "chaîne"]),
    ("FACTURE", ["facture", "facturation", "paiement", "prélèvement"]),
    ("SAV", ["sav", "service client", "assistance", "support"]),
    ("RESEAU", ["réseau", "couverture", "débit", "connexion"]),
]
SCORED_OUTAGE = ["panne", "coupure", "ne marche plus", "ne fonctionne plus"]
SCORED_SLOW = ["lent", "lenteur", "ralenti", "débit faible"]
SCORED_SUPPORT = ["sav", "service", "assistance", "support"]

# candidate sentences of the theme scorer and the theme each stands for
THEME_CANDIDATES = [
    ("problème de fibre internet", "FIBRE"),
    ("problème de téléphone mobile", "MOBILE"),
    ("problème de télévision", "TV"),
    ("question sur la facture", "FACTURE"),
    ("service après-vente", "SAV"),
    ("problème de réseau", "RESEAU"),
    ("autre sujet", "AUTRE"),
]

# ---------------------------------------------------------------------------
# Calibration of a model's sentiment.
# ---------------------------------------------------------------------------
CALIBRATION_NEGATIVE = [
    "panne", "bug", "incident", "bloque", "bloqué", "lent", "probleme", "problème", "facture",
    "debit", "débit", "impossible", "erreur", "coupure", "sav",
]
CALIBRATION_POSITIVE = [
    "merci", "bravo", "super", "génial", "rapide", "parfait", "satisfait", "content", "excellent",
    "top", "formidable",
]
STAR_LABELS = ["très négatif", "négatif", "neutre", "positif", "très positif"]
STAR_SENTIMENTS = ["negatif", "negatif", "neutre", "positif", "positif"]
STAR_NAMES = {
    "5 stars": "POSITIF", "4 stars": "POSITIF", "3 stars": "NEUTRE", "2 stars": "NEGATIF",
    "1 star": "NEGATIF", "POSITIVE": "POSITIF", "NEGATIVE": "NEGATIF", "NEUTRAL": "NEUTRE",
}

# ---------------------------------------------------------------------------
# Label sets of the language-model tier.
# ---------------------------------------------------------------------------
SENTIMENTS = ["positif", "negatif", "neutre"]
CATEGORIES = ["produit", "service", "support", "promotion", "autre"]
URGENCIES = ["haute", "moyenne", "faible"]
CLAIMS = ["oui", "non"]
INCIDENTS = [
    "panne_connexion", "bug_freebox", "probleme_facturation", "probleme_mobile",
    "retard_activation", "debit_insuffisant", "information", "aucun", "non_specifie",
]
TOPICS = [
    "fibre", "mobile", "reseau", "freebox", "wifi", "facture", "service_client",
    "support_technique", "promotion", "autre",
]

# synonyms a model may answer with: canonical value -> accepted spellings
SENTIMENT_SYNONYMS = {
    "positif": ["pos", "positive", "positif", "happy", "satisfait", "content"],
    "negatif": ["neg", "negative", "negatif", "angry", "frustre", "insatisfait"],
    "neutre": ["neu", "neutral", "neutre", "question", "info", "information"],
}
CATEGORY_SYNONYMS = {
    "produit": ["product", "produit", "produits"],
    "service": ["service", "services", "sav"],
    "support": ["support", "technique", "depannage"],
    "promotion": ["promo", "promotion", "offre"],
    "autre": ["other", "autre", "autres", "misc"],
}
CLAIM_SYNONYMS = {
    "oui": ["yes", "y", "oui", "true", "1"],
    "non": ["no", "n", "non", "false", "0"],
}
URGENCY_SYNONYMS = {
    "haute": ["high", "haute", "urgent", "critique"],
    "moyenne": ["medium", "moyenne", "moderee", "modéré"],
    "faible": ["low", "faible", "bas", "normale"],
}

# ---------------------------------------------------------------------------
# Quality guards and the consistency pass.
# ---------------------------------------------------------------------------
BILLING_TERMS = ["facture", "facturation", "paiement", "prelevement", "prélèvement",
                 "remboursement"]
MOBILE_TERMS = ["4g", "5g", "mobile", "smartphone", "reseau", "réseau"]
SERVICE_TERMS = ["sav", "service client", "support", "hotline", "assistance"]
BOX_TERMS = ["freebox", "box"]

GUARD_LOCAL_CLAIM = [
    "panne", "bug", "incident", "bloqué", "bloque", "erreur", "facture", "dysfonctionnement",
    "plainte", "réclamation", "reclamation", "sav", "support", "service client", "retard",
    "activation", "installation", "ticket", "remboursement",
]
GUARD_LOCAL_URGENT = [
    "urgent", "criti", "impossible", "panne totale", "depuis plusieurs jours", "bloqué", "bloque",
    "vite", "heures",
]
GUARD_CLOUD_CLAIM = [
    "panne", "bug", "incident", "coupure", "bloque", "bloqué", "impossible", "debit", "débit",
    "lenteur", "retard", "sav", "support", "service client", "plainte", "réclamation",
    "reclamation", "ticket", "remboursement",
]
GUARD_CLOUD_URGENT = [
    "urgent", "critique", "panne totale", "bloqué", "bloque", "impossible", "depuis", "heures",
    "jours",
]
CONSISTENCY_CLAIM = [
    "panne", "bug", "incident", "bloque", "bloqué", "impossible", "plainte", "réclamation",
    "reclamation", "sav", "support", "service client", "facture", "facturation", "remboursement",
    "debit", "débit", "coupure", "retard", "activation",
]
CONSISTENCY_URGENT = ["urgent", "bloque", "bloqué", "impossible", "panne totale", "depuis"]
CONSISTENCY_NETWORK = ["connexion", "reseau", "réseau", "wifi"]

# ---------------------------------------------------------------------------
# The three fallback classifiers.
# ---------------------------------------------------------------------------
LOCAL_POSITIVE = ["merci", "super", "génial", "excellent", "bravo"]
LOCAL_NEGATIVE = ["panne", "nul", "bug", "problème", "mauvais"]
LOCAL_CATEGORIES = [
    ("produit", ["fibre", "mobile", "box", "débit", "4g", "5g"]),
    ("service", ["sav", "service", "support", "assistance"]),
    ("support", ["aide", "dépannage", "installation", "technicien"]),
    ("promotion", ["offre", "promo", "prix", "réduction"]),
]
LOCAL_URGENT = ["urgent", "impossible", "bloque"]
LOCAL_INCIDENTS = [
    ("panne_connexion", ["connexion", "reseau"]),
    ("probleme_facturation", ["facture", "paiement"]),
    ("bug_freebox", ["freebox"]),
]

CLOUD_POSITIVE = [
    "merci", "super", "génial", "excellent", "bravo", "parfait", "top", "content", "satisfait",
    "ravi", "formidable", "extra", "magnifique", "superbe", "cool", "bien", "bon", "agréable",
    "efficace", "rapide", "qualité",
]
CLOUD_NEGATIVE = [
    "panne", "nul", "bug", "problème", "mauvais", "déçu", "incompétent", "bloqué", "coupure",
    "lent", "défaillant", "défectueux", "cassé", "ne marche pas", "ne fonctionne pas",
    "dysfonctionnement", "erreur", "incident", "inadmissible", "insatisfait", "frustré", "énervé",
    "colère", "plainte", "réclamation",
]
# "box" is listed twice on purpose: it weighs two
CLOUD_CATEGORIES = [
    ("produit", ["fibre", "mobile", "box", "débit", "4g", "5g", "freebox", "réseau", "connexion",
                 "internet", "wifi", "forfait", "data", "sms", "appel", "téléphone", "box"]),
    ("service", ["sav", "service", "support", "assistance", "conseiller", "client", "relation",
                 "réponse", "contact", "accueil", "standard"]),
    ("support", ["aide", "dépannage", "installation", "technicien", "intervention", "réparation",
                 "maintenance", "diagnostic", "résolution", "technique"]),
    ("promotion", ["offre", "promo", "prix", "réduction", "nouveauté", "publicité", "annonce",
                   "tarif", "forfait", "abonnement", "deal", "bon plan"]),
]
CLOUD_URGENT = [
    "urgent", "critique", "inadmissible", "impossible", "panne totale", "depuis", "bloqué",
    "impossible de", "ne peut pas", "ne peut plus", "arrêt", "coupure totale",
]
CLOUD_TOPICS = [
    ("fibre", ["fibre"]),
    ("mobile", ["mobile", "4g", "5g"]),
    ("freebox", ["freebox", "box"]),
    ("reseau", ["reseau", "connexion"]),
    ("facture", ["facture", "paiement"]),
]
CLOUD_CLAIM = ["panne", "bug", "problème", "réclamation", "plainte", "@free", "dysfonctionnement"]
CLOUD_INCIDENTS = [
    ("panne_connexion", ["panne", "coupure", "connexion"]),
    ("bug_freebox", ["bug", "freebox"]),
    ("probleme_facturation", ["facture", "paiement", "facturation"]),
    ("probleme_mobile", ["mobile", "4g", "5g"]),
]

BASIC_CLAIM = ["panne", "@free", "problème", "bug"]
BASIC_POSITIVE = ["merci", "super", "bravo", "excellent"]
BASIC_NEGATIVE = ["panne", "nul", "mauvais", "honte"]
BASIC_URGENT = ["panne", "urgent", "critique"]
BASIC_TOPICS = [("fibre", ["fibre"]), ("mobile", ["mobile"]), ("facture", ["facture"])]
BASIC_INCIDENTS = [("incident_reseau", ["panne"]), ("facturation", ["facture"])]

# ---------------------------------------------------------------------------
# Normalisation of the indicator columns.
# ---------------------------------------------------------------------------
NORMAL_SENTIMENT = {
    "positif": ["positive", "pos", "good", "happy"],
    "negatif": ["negative", "neg", "bad", "angry", "négatif"],
    "neutre": ["neutral", "neu", "ok"],
}
NORMAL_CLAIM = {
    "oui": ["yes", "true", "1", "oui"],
    "non": ["no", "false", "0", "non"],
}
NORMAL_URGENCY = {
    "haute": ["critical", "critique", "urgent", "très haute", "tres haute", "high", "elevee",
              "élevée", "haute"],
    "moyenne": ["medium", "moyenne", "moderee", "modéré"],
    "faible": ["low", "faible", "basse", "normale"],
}
NORMAL_INCIDENTS = [
    "panne_connexion", "bug_freebox", "probleme_facturation", "probleme_mobile",
    "retard_activation", "debit_insuffisant", "information", "aucun", "non_specifie", "autre",
    "incident_reseau", "facturation", "reseau", "mobile",
]
ALIASES = {
    "sentiment": ["sentiment_label", "sentiment_class", "Sentiment"],
    "is_claim": ["reclamation", "réclamation", "claim", "is_reclamation"],
    "urgence": ["priority", "urgency", "Priority", "Urgence"],
    "theme": ["Thème principal", "category", "Category", "topic"],
    "incident": ["Incident principal", "incident_type", "type_incident"],
    "confidence": ["score_confiance", "confiance", "confidence_score"],
    "date": ["created_at", "timestamp", "datetime", "Date"],
}
KPI_DEFAULTS = {
    "sentiment": "neutre", "is_claim": "non", "urgence": "faible", "theme": "AUTRE",
    "incident": "aucun",
}

# truth tests on free vocabularies
TRUE_WORDS = ["oui", "yes", "1", "true"]
NEGATIVE_WORDS = ["negatif", "négatif", "negative", "neg"]
NEUTRAL_WORDS = ["neutre", "neutral", "neu"]
POSITIVE_WORDS = ["positif", "positive", "pos"]
METRIC_NEGATIVE_WORDS = ["negatif", "negative", "neg"]
HIGH_URGENCY_WORDS = ["haute", "high", "elevee", "élevée", "critique", "critical"]
SATISFACTION_POSITIVE = ["positive", "positif", "pos", "1", "good", "happy"]
SATISFACTION_NEUTRAL = ["neutral", "neutre", "neu", "0", "ok"]
SATISFACTION_NEGATIVE = ["negative", "négatif", "negatif", "neg", "-1", "bad", "angry"]
CLAIM_CATEGORY_TERMS = ["réclamation", "claim", "complaint"]
CRITICAL_PRIORITY_TERMS = ["critique", "critical", "urgent", "très haute"]
HIGH_PRIORITY_TERMS = ["haute", "high", "élevée"]
CRITICAL_INCIDENTS = [
    "panne_connexion", "bug_freebox", "probleme_facturation", "probleme_mobile",
    "retard_activation", "debit_insuffisant", "incident_reseau", "facturation",
]
EMPTY_INCIDENTS = ["aucun", "non_specifie", "autre", "information", "non_specifié", "nan", "none",
                   ""]
NO_INCIDENT_WORDS = ["aucun", "non", "none", "n/a", "na", ""]
ENGLISH_SENTIMENT = {
    "positive": ["positif", "pos"], "neutral": ["neutre", "neu"], "negative": ["negatif", "neg"],
}
URGENCY_LEVELS = {
    "FAIBLE": ["faible", "low", "basse"],
    "HAUTE": ["haute", "high", "elevee", "élevée", "critique", "critical"],
    "MOYENNE": ["moyenne", "medium", "modérée", "moderee"],
}
INCIDENT_SEVERITY = [
    ("aucun", "none"), ("information", "info"), ("technique", "real"),
    ("incident_technique", "real"), ("incident_reseau", "real"), ("incident_réseau", "real"),
    ("processus_sav", "real"), ("facturation", "real"), ("incident_facturation", "real"),
    ("livraison", "real"), ("dysfonctionnement", "real"), ("connexion", "real"),
    ("probleme_connexion", "real"),
]

# ---------------------------------------------------------------------------
# Cleaning.
# ---------------------------------------------------------------------------
DOMAIN_TERMS = [
    "free", "freebox", "free mobile", "freebox delta", "freebox pop", "fibre", "fiber",
    "connexion", "connection", "reseau", "réseau", "4g", "5g", "data", "debit", "débit",
    "facture", "facturation", "reclamation", "réclamation", "incident", "panne", "bug", "sav",
    "support", "service client", "assistance", "wifi", "box", "modem",
]

# frequent function words per language, own choice
STOPWORD_PROFILES = {
    "fr": ["le", "la", "les", "un", "une", "des", "du", "de", "et", "est", "dans", "pour", "pas",
           "que", "qui", "sur", "avec", "ce", "je", "vous", "nous", "au", "aux", "par", "plus"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "with", "as", "was",
           "are", "this", "be", "at", "by", "not", "or", "from", "have", "you", "an", "we"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "mit", "von",
           "auf", "für", "im", "dem", "sich", "auch", "als", "wie", "ich", "sie", "es", "aus",
           "bei"],
    "es": ["el", "los", "las", "una", "y", "en", "que", "es", "por", "con", "para", "del", "se",
           "no", "lo", "su", "al", "como", "más", "pero", "sus", "este", "ya", "muy", "son"],
}
