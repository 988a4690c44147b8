"""Stand-in for a language-model service, as a Spark job: replies with the usual defects.

Used where a query needs replies; real ones come in as a table ``(batch_id, reply)``.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.operators.batches import make_batches
from echolens.operators.fallback import fallback_local


def defective_replies(messages: DataFrame, id_col="msg_id", text="text", size=50) -> DataFrame:
    """One reply per batch, answered by rules, with text around the JSON.

    By batch number: every 7th (3) is cut off, every 5th lacks its last three answers (1) or has
    two too many (2). By position: every 4th (1) answers in English capitals, every 4th (2)
    leaves fields out, every 9th (5) uses an unknown urgency and a score above one.
    """
    rows = fallback_local(make_batches(messages, id_col, size), text)
    pos, batch = F.col("pos"), F.col("batch_id")
    variant = pos % 4
    english = {"positif": "Positive", "negatif": "NEGATIVE", "neutre": " Neutral "}
    sentiment = F.col("sentiment")
    loud = F.lit(None).cast("string")
    for fr, en in english.items():
        loud = F.when(sentiment == fr, en).otherwise(loud)
    odd = pos % 9 == 5
    item = F.struct(
        pos.alias("index"),
        F.when(variant == 1, loud).otherwise(sentiment).alias("sentiment"),
        F.when(variant != 2, F.col("categorie")).alias("categorie"),
        F.when(odd, 1.7).when(variant != 2, F.col("score_confiance")).alias("score_confiance"),
        F.when(variant == 1, F.when(F.col("is_claim") == "oui", "YES").otherwise("no"))
         .when(variant != 2, F.col("is_claim")).alias("is_claim"),
        F.when(odd, "maximal").when(variant != 2, F.col("urgence")).alias("urgence"),
        F.when(variant == 3, "inconnu").when(variant != 2, F.col("topics")).alias("topics"),
        F.when(variant != 2, F.col("incident")).alias("incident"))
    replies = rows.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct(pos.alias("pos"), item.alias("item"))),
                     lambda a, b: F.when(a["pos"] < b["pos"], -1).otherwise(1)).alias("items"))
    kept = (F.when(batch % 5 == 1, F.slice("items", 1, F.greatest(F.size("items") - 3,
                                                                   F.lit(0))))
             .when(batch % 5 == 2, F.concat(F.col("items"), F.slice("items", 1, 2)))
             .otherwise(F.col("items")))
    body = F.to_json(F.struct(F.transform(kept, lambda x: x["item"]).alias("results")))
    body = F.when(batch % 7 == 3, F.substr(body, F.lit(1), F.length(body) - 5)).otherwise(body)
    return replies.select("batch_id", F.concat(F.lit("Voici le résultat :\n"), body,
                                               F.lit("\nBonne journée")).alias("reply"))
