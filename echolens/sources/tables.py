"""The given tables and the tables Spark derives from them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Message texts standing in for service vocabulary, chosen by event number.
FEEDBACK_TEMPLATES = [
    "Bonjour @Support_Été ma fibre est en panne depuis 3 jours, c'est URGENT !",
    "Merci pour le service rapide, tout est parfait 👍",
    "Facture trop élevée ce mois-ci, je demande un remboursement https://ex.org/f?id=7",
    "Comment activer ma box ?   Pas pressé",
    "#Réseau mobile lent le soir, débit faible en 4G",
    "PROBLÈME de connexion, impossible de travailler",
    "Le technicien est passé, super boulot #merci",
    "Aucune réponse du service client www.ex.org/sav toujours rien",
    "Quel est le prix du forfait 5G ?",
    "Œuvre à paraître chez l’éditeur, rien à signaler",
    "Network outage since this morning, please help @ops",
    "ok",
    "   ",
    "Ça fait 2 semaines que la télévision ne marche plus 😞😞",
    "Bug freebox : erreur au démarrage, wifi coupé",
    "Annonce : nouvelle offre fibre, promo tarif réduit",
]

# Message texts with emoji sequences and other scripts, chosen by event number.
WORLD_TEMPLATES = [
    "Vive la 🇫🇷 et 🇧🇪, pas 🇿🇼 ni 🇫",
    "Option 1️⃣ ou #⃣, puis 10 fois *️⃣",
    "Technicienne 👩🏽‍🔧 passée, 🤷🏿‍♂️ rien de neuf 👍🏽👍",
    "Famille 👨‍👩‍👧‍👦 sans wifi, ❤️‍🔥 puis 💔 🏴󠁧󠁢󠁳󠁣󠁴󠁿 🏳️‍🌈",
    "Inconnu 📱‍🐛, ton seul 🏽, ☎️!",
    "Не работает интернет, объясните, пожалуйста! Щука, Ёж, ЖУК",
    "Δεν λειτουργεί το δίκτυο, Ψυχή Θεός ᾄδω ΐ Ω",
    "Ціна їжі: ґанок, Љубљана, қала — 漢字 µ",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def feedback_from_events(events: DataFrame) -> DataFrame:
    """Messages ``(msg_id, author, ts, text, channel, latency_ms)``, one per event; map-only."""
    n = len(FEEDBACK_TEMPLATES)
    template = F.element_at(F.array(*[F.lit(t) for t in FEEDBACK_TEMPLATES]),
                            (F.col("event_id") % n + 1).cast("int"))
    user = F.col("user_id").cast("string")
    text = (F.when(F.col("event_id") % 97 == 0, None)
             .when(F.col("event_id") % 3 == 0, template)
             .otherwise(F.concat(template, F.lit(" ["), "event_type", F.lit(" "), user,
                                 F.lit("]"))))
    return events.select(F.col("event_id").alias("msg_id"),
                         F.concat(F.lit("user_"), user).alias("author"), "ts",
                         text.alias("text"), F.col("event_type").alias("channel"),
                         F.col("value").alias("latency_ms"))


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    return feedback_from_events(table(spark, folder, "events"))


def world_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages ``(msg_id, text)`` with emoji sequences and other scripts, one per event."""
    template = F.element_at(F.array(*[F.lit(t) for t in WORLD_TEMPLATES]),
                            (F.col("event_id") % len(WORLD_TEMPLATES) + 1).cast("int"))
    return table(spark, folder, "events").select(
        F.col("event_id").alias("msg_id"),
        F.when(F.col("event_id") % 97 != 0, F.concat(template, F.lit(" "), "event_type",
                                                     F.lit(" 👤"), F.col("user_id").cast("string")))
         .alias("text"))
