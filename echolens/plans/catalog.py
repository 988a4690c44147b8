"""One query per operator over the given tables: ``name -> f(spark, folder)``."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.functions import lexicon as L
from echolens.functions import text as T
from echolens.functions.match import Hits
from echolens.operators import (batches, charts, dedup, evaluate, fallback, guards, kpi, language,
                                merge, quality, sampling, scored, scoring)
from echolens.operators import rules as R
from echolens.plans import classify
from echolens.sources import files
from echolens.sources.replies import defective_replies
from echolens.sources.shared import shared_folder, write_and_read
from echolens.sources.tables import feedback, feedback_from_events, table, world_messages
from echolens.streaming import streams

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def all_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of the given tables: feedback (f), documents (d) and pages (p)."""
    parts = [feedback(spark, folder).select(F.lit("f").alias("kind"), F.col("msg_id").alias("id"),
                                            "text"),
             table(spark, folder, "documents").select(F.lit("d"), "doc_id", "text"),
             table(spark, folder, "pages").select(F.lit("p"), "page_id", "html")]
    return reduce(DataFrame.union, parts)


# --- files -------------------------------------------------------------------------------

@query
def read_messages_csv(spark, folder):
    docs = table(spark, folder, "documents")
    path = shared_folder(spark, "csv")
    files.write_messages_csv(docs, path)
    back = files.read_messages_csv(spark, path, docs.schema)
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"),
                       F.length("text").cast("bigint").alias("length"))


@query
def detect_encoding(spark, folder):
    """The documents of each language written in both encodings and recognised again."""
    docs = table(spark, folder, "documents").select("lang", "text")
    path, parts = shared_folder(spark, "encodings"), []
    for encoding in ("UTF-8", "ISO-8859-1"):
        (docs.write.partitionBy("lang").option("encoding", encoding)
             .option("escape", '"').csv(f"{path}/{encoding}"))
        found = files.detect_encoding(spark, f"{path}/{encoding}", by_folder=True)
        parts.append(found.select(
            F.lit(encoding).alias("written"),
            F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang"), "encoding"))
    both = parts[0].union(parts[1])
    return both.groupBy("written", "lang").agg(F.max("encoding").alias("encoding"))


@query
def file_manifest_check(spark, folder):
    return files.check_files(files.list_files(spark, folder)).drop("path")


@query
def import_manifest(spark, folder):
    manifest = shared_folder(spark, "manifest")
    listed = files.list_files(spark, folder)
    for day in ("2024-01-01T00:00:00", "2024-01-02T00:00:00"):
        files.append_manifest(listed, manifest, day, "test tables")
    return spark.read.schema("timestamp string, filename string, saved_path string, "
                             "size_bytes bigint, source_url string, mime_type string") \
        .json(manifest).drop("saved_path")


@query
def file_hash(spark, folder):
    return files.file_hashes(spark, folder).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "md5")


@query
def export_classified(spark, folder):
    labels = "msg_id bigint, author string, text string, is_claim string, urgence string, " \
             "incident string, topics string"
    names = [c.split()[0] for c in labels.split(", ")]
    out = R.classify_rules(feedback(spark, folder)).select(*names)
    path = shared_folder(spark, "export")
    files.export_classified(out, path)
    return files.read_messages_csv(spark, path, labels)


# --- validation and profiling ------------------------------------------------------------

@query
def column_profile(spark, folder):
    return quality.column_profile(table(spark, folder, "documents"))


@query
def validate_structure(spark, folder):
    return quality.validate_structure(feedback(spark, folder))


@query
def quality_score(spark, folder):
    return quality.quality_score(feedback(spark, folder))


@query
def validate_text(spark, folder):
    return all_texts(spark, folder).select("kind", "id", F.inline(F.array(
        quality.validate_text(F.col("text"))))).withColumnRenamed("text", "trimmed")


@query
def cleaning_stats(spark, folder):
    return quality.cleaning_stats(quality.clean_flagged(feedback(spark, folder)))


@query
def filter_corpus(spark, folder):
    return quality.filter_corpus(table(spark, folder, "documents")).select("doc_id", "lang",
                                                                           "text")


@query
def preview(spark, folder):
    return quality.preview(feedback(spark, folder), ["msg_id", "author", "text", "url"])


@query
def quality_distribution(spark, folder):
    return quality.quality_distribution(feedback(spark, folder))


# --- cleaning ----------------------------------------------------------------------------

def _over_texts(name, change):
    def run(spark, folder):
        return all_texts(spark, folder).select("kind", "id", change(F.col("text")).alias("out"))
    run.__name__ = name
    query(run)


_over_texts("clean_lower", F.lower)
_over_texts("strip_urls", T.strip_urls)
_over_texts("strip_mentions", T.strip_mentions)
_over_texts("strip_hashtags", T.strip_hashtags)
_over_texts("unwrap_hashtags", T.unwrap_hashtags)
_over_texts("emoji_to_text", T.emoji_to_text)
_over_texts("strip_emojis", T.strip_emojis)
_over_texts("to_ascii", T.to_ascii)
_over_texts("collapse_ws", T.collapse_spaces)
_over_texts("strip_special", T.strip_special)
_over_texts("strip_punct", T.strip_punctuation)
_over_texts("drop_stopwords", lambda c: T.drop_stopwords(F.lower(c), ["le", "la", "the", "ok"]))
_over_texts("preprocess_text", T.preprocess_text)
_over_texts("detect_language_words", T.detect_language)


@query
def emoji_sequences(spark, folder):
    return world_messages(spark, folder).select(
        "msg_id", T.emoji_to_text(F.col("text")).alias("out"))


@query
def transliterate(spark, folder):
    return world_messages(spark, folder).select(
        "msg_id", T.to_ascii(F.col("text")).alias("out"))


@query
def clean_world_messages(spark, folder):
    return T.clean_messages(world_messages(spark, folder)).select("msg_id", "text_cleaned")


@query
def strip_urls_dotted(spark, folder):
    return all_texts(spark, folder).select(
        "kind", "id", T.strip_urls_dotted(F.col("text")).alias("out"))


@query
def keep_domain_terms(spark, folder):
    rows = all_texts(spark, folder).select(
        "kind", "id", T.lower_text(F.col("text")).alias("raw"),
        T.to_ascii(T.lower_text(F.col("text"))).alias("cleaned"))
    return rows.select("kind", "id", T.keep_domain_terms(F.col("cleaned"), F.col("raw"))
                       .alias("out"))


@query
def clean_text(spark, folder):
    return T.clean_messages(all_texts(spark, folder)).select("kind", "id", "text_cleaned")


@query
def clean_dataset(spark, folder):
    return quality.clean_dataset(feedback(spark, folder)).select("msg_id", "text_cleaned")


@query
def language_accuracy_words(spark, folder):
    docs = table(spark, folder, "documents")
    return (docs.select("lang", T.detect_language(F.col("text")).alias("found"))
                .groupBy("lang", "found").agg(F.count("*").alias("n")))


@query
def detect_language(spark, folder):
    """Every given text by a model of the labelled documents."""
    model = write_and_read(language.fit_language_model(table(spark, folder, "documents")), "languages")
    return language.detect_language(all_texts(spark, folder), model, out="out").select("kind", "id", "out")


@query
def language_accuracy(spark, folder):
    """All documents by a model of one half of them; the other half is held out."""
    docs = table(spark, folder, "documents").withColumn("held_out", F.md5(
        F.concat(F.lit("fold|"), F.col("doc_id").cast("string"))) >= "8")
    model = write_and_read(language.fit_language_model(docs.where("not held_out")), "languages")
    return (language.detect_language(docs, model, out="found")
            .groupBy("held_out", "lang", "found").agg(F.count("*").alias("n")))


@query
def flatten_struct(spark, folder):
    nested = feedback(spark, folder).select("msg_id", F.struct(
        "author", F.struct("channel", "latency_ms").alias("via")).alias("src"))
    return T.flatten_struct(nested)


# --- deduplication -----------------------------------------------------------------------

@query
def dedup_exact(spark, folder):
    docs = table(spark, folder, "documents")
    return dedup.dedup_exact(docs, "text", "doc_id").select("doc_id", "lang")


@query
def duplicate_count(spark, folder):
    return dedup.duplicate_count(feedback(spark, folder))


@query
def duplicate_groups(spark, folder):
    return dedup.duplicate_groups(feedback(spark, folder))


# --- rule tier ---------------------------------------------------------------------------

def _rules_over_texts(name, *columns, extended=True):
    def run(spark, folder):
        return R.classify_rules(all_texts(spark, folder), extended=extended).select(
            "kind", "id", *columns)
    run.__name__ = name
    query(run)


_rules_over_texts("rule_claim", "is_claim", extended=False)
_rules_over_texts("rule_urgency", "urgence")
_rules_over_texts("rule_topic", "topics")
_rules_over_texts("rule_incident", "incident")
_rules_over_texts("rule_classify", "is_claim", "urgence", "topics", extended=False)
_rules_over_texts("rule_classify_extended", "is_claim", "urgence", "topics", "incident")


@query
def rule_statistics(spark, folder):
    return R.rule_statistics(R.classify_rules(feedback(spark, folder)))


@query
def theme_patterns(spark, folder):
    out = all_texts(spark, folder).withColumn("_hits", R.lexicon_hits(F.col("text")))
    for rule_set in L.RULE_SETS:
        out = R.classify_by_lexicon(out, rule_set, hits=Hits(F.col("_hits")))
    return out.drop("text", "_hits")


@query
def term_hits(spark, folder):
    return R.term_hits(feedback(spark, folder), "msg_id", "theme")


@query
def term_frequency(spark, folder):
    return R.term_frequency(R.term_hits(all_texts(spark, folder), "id", "theme"))


# --- scored tier -------------------------------------------------------------------------

def _scored_over_texts(name, *columns):
    def run(spark, folder):
        return scored.classify_scored(all_texts(spark, folder)).select("kind", "id", *columns)
    run.__name__ = name
    query(run)


_scored_over_texts("score_sentiment", "sentiment", "sent_conf")
_scored_over_texts("score_claim", "reclamation", "claim_conf")
_scored_over_texts("score_urgency", "urgence")
_scored_over_texts("score_theme", "theme", "theme_conf")
_scored_over_texts("infer_incident", "type_incident")
_scored_over_texts("infer_team", "responsable")
_scored_over_texts("global_confidence", "confiance")


@query
def polarity_sentiment(spark, folder):
    """The polarity stands in for a model's: a value in -1..1 from the text length."""
    polarity = (F.length("text") % 21 - 10) / 10.0
    return feedback(spark, folder).where("text is not null").select(
        "msg_id", F.inline(F.array(scored.polarity_sentiment(polarity))))


@query
def classify_scored(spark, folder):
    record = scored.classify_scored_record(feedback(spark, folder).select("msg_id", "text"))
    m = F.col("record.metadata")
    return record.select(
        "msg_id", *[F.col(f"record.{c}") for c in (
            "sentiment", "reclamation", "urgence", "theme", "type_incident", "responsable",
            "confiance", "error")],
        *[F.round(m[k], 4).alias(k) for k in ("sent_conf", "reclam_conf", "theme_conf")])


@query
def zero_shot_theme(spark, folder):
    return scoring.zero_shot_theme(feedback(spark, folder)).select(
        "msg_id", "theme", F.round("theme_score", 6).alias("theme_score"))


# --- model scoring -----------------------------------------------------------------------

@query
def score_batches(spark, folder):
    return scoring.score_batches(feedback(spark, folder)).select(
        "msg_id", "sentiment", "sentiment_detail",
        F.round("sentiment_confidence", 6).alias("sentiment_confidence"))


@query
def collapse_stars(spark, folder):
    """Five logits from the whole vector: the sums of every fifth entry."""
    entries = F.col("embedding").cast("array<double>")
    fifth = lambda k: lambda x, i: i % 5 == k
    scores = F.array(*[F.aggregate(F.filter(entries, fifth(k)), F.lit(0.0), lambda a, x: a + x)
                       for k in range(5)])
    return (table(spark, folder, "embeddings")
            .select("vec_id", F.inline(F.array(guards.collapse_stars(scores))))
            .withColumn("confidence", F.round("confidence", 6)))


@query
def star_sentiment(spark, folder):
    """Star names made from the user number; 6 stars is unknown."""
    n = F.col("user_id") % 6 + 1
    name = F.concat(n.cast("string"), F.when(n == 1, " star").otherwise(" stars"))
    return table(spark, folder, "events").select(
        "event_id", name.alias("stars"), guards.star_sentiment(name).alias("sentiment"))


@query
def calibrate_sentiment(spark, folder):
    rows = fallback.fallback_basic(feedback(spark, folder))
    return guards.calibrate_sentiment(rows).select("msg_id", "sentiment", "confidence")


# --- language-model batches --------------------------------------------------------------

@query
def make_batches(spark, folder):
    return batches.make_batches(feedback(spark, folder)).select("msg_id", "batch_id",
                                                                            "pos")


@query
def build_prompts(spark, folder):
    return batches.build_prompts(batches.make_batches(feedback(spark, folder)))


@query
def parse_responses(spark, folder):
    parsed = batches.parse_responses(defective_replies(feedback(spark, folder)))
    # size() of a null array is -1 or null by configuration; be explicit
    return parsed.select("batch_id", F.when(F.col("results").isNotNull(), F.size("results"))
                         .alias("answers"))


def _padded(spark, folder):
    messages = feedback(spark, folder)
    parsed = batches.parse_responses(defective_replies(messages))
    return batches.pad_responses(batches.make_batches(messages), parsed)


LABELS = ["sentiment", "categorie", "score_confiance", "is_claim", "urgence", "topics",
          "incident"]


@query
def pad_responses(spark, folder):
    return _padded(spark, folder).select("msg_id", "batch_id", "pos", "answered", *LABELS)


@query
def validate_result_strict(spark, folder):
    return guards.validate_strict(_padded(spark, folder)).select("msg_id", *LABELS)


@query
def validate_result_synonyms(spark, folder):
    return guards.validate_synonyms(_padded(spark, folder)).select("msg_id", *LABELS)


@query
def guard_local(spark, folder):
    return guards.guard_local(guards.validate_strict(_padded(spark, folder))).select("msg_id",
                                                                                     *LABELS)


@query
def guard_cloud(spark, folder):
    return guards.guard_cloud(guards.validate_synonyms(_padded(spark, folder))).select(
        "msg_id", *LABELS)


@query
def classify_replies_local(spark, folder):
    messages = feedback(spark, folder)
    return classify.classify_replies(messages, defective_replies(messages), provider="local") \
        .select("msg_id", *LABELS)


@query
def classify_replies_cloud(spark, folder):
    messages = feedback(spark, folder)
    return classify.classify_replies(messages, defective_replies(messages)).select("msg_id",
                                                                                   *LABELS)


@query
def fallback_local(spark, folder):
    return fallback.fallback_local(all_texts(spark, folder)).drop("text")


@query
def fallback_cloud(spark, folder):
    return fallback.fallback_cloud(all_texts(spark, folder)).drop("text")


@query
def fallback_basic(spark, folder):
    return fallback.fallback_basic(all_texts(spark, folder)).drop("text")


@query
def tag_provenance(spark, folder):
    rows = fallback.fallback_cloud(feedback(spark, folder))
    return batches.tag_provenance(rows, "cloud", "terms-1", "2024-01-31T00:00:00").select(
        "msg_id", "confidence", "classification_method", "model_name",
        "classification_timestamp")


@query
def classification_stats(spark, folder):
    return batches.classification_stats(fallback.fallback_cloud(feedback(spark, folder)))


# --- tiers together ----------------------------------------------------------------------

def classified(spark: SparkSession, folder: str) -> DataFrame:
    """Feedback with all indicator columns, by the count-based rules."""
    return fallback.fallback_cloud(feedback(spark, folder)).withColumn(
        "confidence", F.col("score_confiance"))


@query
def sample_priority(spark, folder):
    return sampling.sample_priority(R.classify_rules(feedback(spark, folder))).select("msg_id",
                                                                                      "stratum")


@query
def sample_diverse(spark, folder):
    return sampling.sample_diverse(classified(spark, folder)).select("msg_id", "stratum")


@query
def clean_on_demand(spark, folder):
    rows = merge.clean_on_demand(feedback(spark, folder), "text_cleaned")
    return merge.clean_on_demand(rows, "text_cleaned").select("msg_id", "text_cleaned")


def _preliminary(spark, folder):
    return R.classify_rules(feedback(spark, folder)).withColumnsRenamed(
        {"topics": "topics_preliminary", "incident": "incident_preliminary"})


def _sampled_answers(spark, folder):
    """Answers of the costly tier for the rows of the priority sample."""
    chosen = sampling.sample_priority(R.classify_rules(feedback(spark, folder)))
    return fallback.fallback_local(chosen.select("msg_id", "text"))


@query
def merge_tier_results(spark, folder):
    return merge.merge_tier_results(_preliminary(spark, folder),
                                    _sampled_answers(spark, folder)).select(
        "msg_id", "is_claim", "topics", "incident", "confidence")


@query
def backfill_prelim(spark, folder):
    merged = merge.merge_tier_results(_preliminary(spark, folder),
                                      _sampled_answers(spark, folder))
    return merge.backfill_prelim(merged).select("msg_id", "topics", "incident")


@query
def aggregate_confidence(spark, folder):
    base = classify.base_tiers(feedback(spark, folder))
    merged = merge.merge_tier_results(base, _sampled_answers(spark, folder)) \
        .withColumnRenamed("confidence", "mistral_confidence")
    return merge.aggregate_confidence(merged).select(
        "msg_id", F.round("confidence", 6).alias("confidence"))


@query
def enforce_consistency(spark, folder):
    rows = T.clean_messages(fallback.fallback_basic(feedback(spark, folder)))
    return guards.enforce_consistency(rows).select("msg_id", "is_claim", "urgence", "incident",
                                                   "topics", "confidence")


def _classify_mode(name, mode):
    def run(spark, folder):
        return classify.classify(feedback(spark, folder), mode=mode).select(
            "msg_id", "sentiment", "is_claim", "urgence", "topics", "incident",
            F.round("confidence", 6).alias("confidence"))
    run.__name__ = name
    query(run)


_classify_mode("classify_mode", "balanced")
_classify_mode("classify_mode_fast", "fast")
_classify_mode("classify_mode_precise", "precise")


@query
def complete_columns(spark, folder):
    rows = _preliminary(spark, folder).select("msg_id", "is_claim", "topics_preliminary")
    return merge.complete_columns(rows)


@query
def result_cache(spark, folder):
    """A first run filled the cache with the messages before 2024-01-16; the second run takes
    all messages, scores what is missing once per text, and appends it."""
    messages = feedback(spark, folder)
    cache = merge.open_cache(spark, shared_folder(spark, "cache"), "sentiment STRING, confidence DOUBLE")

    def score(texts):
        return classify.term_sentiment(texts, "text").select(
            "key", "sentiment", F.col("bert_confidence").alias("confidence"))
    merge.score_with_cache(messages.where("ts < '2024-01-16'"), cache, "bert", score, run=1)
    found = merge.score_with_cache(messages, cache, "bert", score, run=2)
    entries = merge.cache_entries(spark, cache).agg(F.count("*").alias("entries"))
    return merge.cache_statistics(found).withColumn("entries", entries.scalar())


@query
def cached_sentiment(spark, folder):
    """Sentiment of every message, most of it from the cache that a first run has filled."""
    messages = feedback(spark, folder)
    cache = merge.open_cache(spark, shared_folder(spark, "cache"), "sentiment STRING, confidence DOUBLE")

    def score(texts):
        return classify.term_sentiment(texts, "text").select(
            "key", "sentiment", F.col("bert_confidence").alias("confidence"))
    merge.score_with_cache(messages.where("ts < '2024-01-16'"), cache, "bert", score, run=1)
    found = merge.score_with_cache(messages, cache, "bert", score, run=2)
    return (messages.select("msg_id", merge.cache_key(F.col("text"), "bert").alias("key"))
            .join(found, "key").select("msg_id", "hit", "sentiment", F.round("confidence", 6).alias("confidence")))


@query
def classification_report(spark, folder):
    r = merge.classification_report(classified(spark, folder))
    maps = ["sentiment", "urgence", "topics", "incident"]
    return r.select(*[c for c in r.columns if not c.endswith("_distribution")],
                    *[F.to_json(f"{c}_distribution").alias(f"{c}_json") for c in maps])


@query
def run_metrics(spark, folder):
    return merge.run_metrics(feedback(spark, folder), [
        ("cleaning", T.clean_messages), ("rules", R.classify_rules),
        ("fallback", fallback.fallback_cloud)], "fast")


@query
def claims_by_language(spark, folder):
    """Documents cleaned, classified by rules and scores, and summed up per language."""
    docs = T.clean_messages(table(spark, folder, "documents").select("doc_id", "lang", "text"))
    rows = scored.score_sentiment(R.classify_rules(docs, "text_cleaned"), "text_cleaned")
    n = F.count("*")
    claims = F.count_if(F.col("is_claim") == "oui")
    high = F.count_if(F.col("urgence") == "haute")
    negative = F.count_if(F.col("sentiment") == "NEGATIF")
    return rows.groupBy("lang").agg(
        n.alias("total"), claims.alias("claims"), kpi.percent(claims, n).alias("claim_pct"),
        high.alias("high_urgency"), kpi.percent(high, n).alias("high_urgency_pct"),
        negative.alias("negative"), F.count_if(F.col("topics") == "fibre").alias("fibre"),
        F.count_if(F.col("topics") == "mobile").alias("mobile"),
        F.count_if(F.col("topics") == "facture").alias("facture"),
        F.count_if(F.col("topics") == "autre").alias("autre"))


# --- indicators --------------------------------------------------------------------------

# spellings met in files, picked by message number
RAW_LABELS = {
    "sentiment": ["positive", " POS ", "Négatif", "angry", "ok", "Neutral", "bof", "negatif",
                  "positif", None, "NEG", "good", "neutre"],
    "is_claim": ["YES", "no", "1", "0", "Oui", "non", " true", "False", "peut-être", None, "oui"],
    "urgence": ["HIGH", "Critique", "urgent", "Très haute", "élevée", "medium", "Modéré", "low",
                "basse", "normale", "faible", "moyenne", "haute", "bientôt", "", None, "maximal"],
    "incident": ["panne_connexion", "BUG_FREEBOX", "autre chose", "", "nan", None, " aucun "],
    "confidence": ["0.9", "1.7", "abc", None, "-0.2"],
}


def raw_labels(spark: SparkSession, folder: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]),
                                       (F.col("msg_id") % len(values) + 1).cast("int"))
    return feedback(spark, folder).select("msg_id", "text", *[pick(v).alias(c)
                                                              for c, v in RAW_LABELS.items()])


def enriched(spark: SparkSession, folder: str) -> DataFrame:
    """Feedback in the column names of the enriched export."""
    s = scored.classify_scored(feedback(spark, folder))
    return s.select("msg_id", "channel", "sentiment", "urgence",
                    F.col("confiance").alias("confidence"),
                    F.col("theme").alias("Thème principal"),
                    F.col("theme_conf").alias("theme_confidence"),
                    F.col("type_incident").alias("Incident principal"),
                    F.col("claim_conf").alias("incident_confidence"),
                    F.col("responsable").alias("incident_responsable"),
                    F.initcap("reclamation").alias("réclamations"),
                    F.col("claim_conf").alias("reclamation_confidence"))


@query
def resolve_aliases(spark, folder):
    raw = raw_labels(spark, folder).select(
        "msg_id", F.col("sentiment").alias("Sentiment"), F.col("urgence").alias("priority"),
        F.col("incident").alias("category"), F.col("confidence").alias("score_confiance"))
    return kpi.resolve_aliases(raw).select("msg_id", F.col("sentiment"), "is_claim", "urgence",
                                           "incident", "theme", "confidence")


@query
def normalize_sentiment(spark, folder):
    return raw_labels(spark, folder).select("msg_id", kpi.normalize_sentiment(
        F.col("sentiment")).alias("sentiment"))


@query
def normalize_claim(spark, folder):
    return raw_labels(spark, folder).select("msg_id", kpi.normalize_claim(
        F.col("is_claim")).alias("is_claim"))


@query
def normalize_urgency(spark, folder):
    return raw_labels(spark, folder).select("msg_id", kpi.normalize_urgency(
        F.col("urgence"), F.col("is_claim"), F.col("sentiment")).alias("urgence"))


@query
def normalize_incident(spark, folder):
    return raw_labels(spark, folder).select("msg_id", kpi.normalize_incident(
        F.col("incident"), F.col("is_claim")).alias("incident"))


@query
def normalize_confidence(spark, folder):
    return raw_labels(spark, folder).select("msg_id", kpi.normalize_confidence(
        F.col("confidence")).alias("confidence"))


@query
def normalize_kpis(spark, folder):
    return kpi.normalize_kpis(raw_labels(spark, folder)).drop("text")


@query
def kpi_metrics(spark, folder):
    return kpi.kpi_metrics(classified(spark, folder))


@query
def claim_rate(spark, folder):
    return kpi.claim_rate(classified(spark, folder))


@query
def thematic_distribution(spark, folder):
    return kpi.thematic_distribution(enriched(spark, folder))


@query
def satisfaction_index(spark, folder):
    return kpi.satisfaction_index(raw_labels(spark, folder))


@query
def urgency_rate(spark, folder):
    return kpi.urgency_rate(raw_labels(spark, folder))


@query
def confidence_summary(spark, folder):
    return kpi.confidence_summary(raw_labels(spark, folder))


@query
def incident_distribution(spark, folder):
    return kpi.incident_distribution(enriched(spark, folder))


@query
def claims_enriched(spark, folder):
    return kpi.claims_enriched(enriched(spark, folder))


@query
def business_kpis(spark, folder):
    out = kpi.business_kpis(enriched(spark, folder))
    return out.withColumn("value", F.round("value", 4))


@query
def quality_summary(spark, folder):
    return kpi.quality_summary(classified(spark, folder))


@query
def top_real_incident(spark, folder):
    return kpi.top_real_incident(classified(spark, folder))


@query
def alert_bands(spark, folder):
    """Bands per channel."""
    rows = enriched(spark, folder)
    per = rows.groupBy("channel").agg(
        F.round(F.avg((F.col("réclamations") == "Oui").cast("int")) * 100, 4).alias("claim"),
        kpi.satisfaction_measures(rows)["satisfaction_index"].alias("satisfaction"),
        kpi.urgency_measures(rows)["urgency_pct"].alias("urgency"),
        kpi.confidence_measures(rows)["average"].alias("confidence"))
    names = ("claim", "satisfaction", "urgency", "confidence")
    return per.withColumns(kpi.alert_bands(*[F.col(n) for n in names]))


@query
def map_vocabulary_en(spark, folder):
    return kpi.map_vocabulary_en(classified(spark, folder)).select("msg_id", "sentiment",
                                                                   "priority", "category")


@query
def group_kpi_stats(spark, folder):
    return kpi.group_kpi_stats(enriched(spark, folder), {
        "theme": ("Thème principal", "theme_confidence"),
        "incident": ("Incident principal", "incident_confidence"),
        "claim": ("réclamations", "reclamation_confidence"),
        "team": ("incident_responsable", "incident_confidence")})


@query
def flat_kpis(spark, folder):
    return kpi.flat_kpis(classified(spark, folder))


@query
def export_report_json(spark, folder):
    """The report written as JSON text and read back field by field."""
    report = kpi.claim_rate(classified(spark, folder))
    path = shared_folder(spark, "report")
    files.export_report_json(report, path)
    return spark.read.schema(report.schema).json(path)


# --- chart tables ------------------------------------------------------------------------

def dated(spark: SparkSession, folder: str) -> DataFrame:
    """Classified feedback with the time as text; some of it is no date."""
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return classified(spark, folder).withColumn(
        "created_at", F.when(F.col("msg_id") % 101 == 0, "n/a").otherwise(iso))


@query
def sentiment_share(spark, folder):
    return charts.sentiment_share(classified(spark, folder))


@query
def sentiment_buckets(spark, folder):
    return charts.sentiment_buckets(raw_labels(spark, folder))


@query
def daily_volume(spark, folder):
    return charts.daily_volume(dated(spark, folder))


@query
def activity_heatmap(spark, folder):
    return charts.activity_heatmap(dated(spark, folder))


@query
def top_themes(spark, folder):
    return charts.top_themes(enriched(spark, folder))


@query
def incident_share(spark, folder):
    return charts.incident_share(classified(spark, folder))


@query
def incident_severity(spark, folder):
    names = raw_labels(spark, folder).select("incident").unionByName(
        classified(spark, folder).select("incident")).unionByName(
        R.classify_rules(feedback(spark, folder)).select("incident"))
    return names.groupBy("incident", charts.incident_severity(F.col("incident"))
                         .alias("severity")).agg(F.count("*").alias("n"))


@query
def category_satisfaction(spark, folder):
    return charts.category_satisfaction(
        classified(spark, folder).withColumn("category", F.col("incident")))


@query
def urgency_levels(spark, folder):
    return charts.urgency_levels(raw_labels(spark, folder))


@query
def priority_counts(spark, folder):
    return charts.priority_counts(raw_labels(spark, folder).withColumn("priority",
                                                                       F.col("urgence")))


@query
def topic_tokens_top10(spark, folder):
    rows = classified(spark, folder)
    return charts.topic_tokens(rows.withColumn("topics", F.concat_ws(" , ", "topics", "categorie",
                                                                     "channel")))


@query
def confidence_histogram(spark, folder):
    return charts.confidence_histogram(classified(spark, folder))


@query
def time_ordered(spark, folder):
    return charts.time_ordered(dated(spark, folder)).select(
        "msg_id", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), "confidence")


@query
def claim_split(spark, folder):
    return charts.claim_split(raw_labels(spark, folder))


@query
def detail_table(spark, folder):
    return charts.detail_table(classified(spark, folder))


@query
def distinct_labels(spark, folder):
    return charts.distinct_labels(classified(spark, folder))


@query
def claims_by_topic(spark, folder):
    return charts.claims_by_topic(classified(spark, folder))


@query
def urgency_trend(spark, folder):
    return charts.urgency_trend(dated(spark, folder))


# --- learning and evaluation -------------------------------------------------------------

@query
def stratified_split(spark, folder):
    return sampling.stratified_split(classified(spark, folder), "msg_id", "sentiment").select(
        "msg_id", "sentiment", "split")


@query
def dataset_statistics(spark, folder):
    rows = classified(spark, folder).select("msg_id", "author", "text", "sentiment", "categorie",
                                            "urgence", "is_claim")
    split = sampling.stratified_split(rows, "msg_id", "sentiment")
    return kpi.dataset_statistics(split, ["sentiment", "categorie", "urgence"])


@query
def train_text_baseline(spark, folder):
    """Quality of documents learnt from the labels; training rows by exact split."""
    rows = (table(spark, folder, "documents").select("doc_id", "text")
            .join(table(spark, folder, "labels"), "doc_id"))
    rows = sampling.stratified_split(rows, "doc_id", "quality", 0.8, 0.0)
    scored_rows = scoring.train_text_baseline(rows.where("split = 'train'"),
                                              rows.where("split = 'test'"), "quality", "doc_id")
    return evaluate.precision_recall_f1(scored_rows)


def tier_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Claim by every tier per message; ``label`` is the scored tier's verdict."""
    out = feedback(spark, folder).select("msg_id", "channel", "text")
    s = scored.classify_scored(out).select(
        "msg_id", "channel", "text", F.coalesce("claim_conf", F.lit(0.0)).alias("score"),
        F.when(F.col("reclamation") == "OUI", "oui").otherwise("non").alias("label"))
    for name, tier in (("rules", R.classify_rules), ("local", fallback.fallback_local),
                       ("cloud", fallback.fallback_cloud), ("basic", fallback.fallback_basic)):
        kept = s.columns
        s = tier(s).select(*kept, F.col("is_claim").alias(name))
    return s


TIERS = ("rules", "local", "cloud", "basic")


@query
def accuracy_by_target(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text").join(
        table(spark, folder, "labels"), "doc_id")
    guess = docs.withColumns({"quality_guess": (F.length("text") >= 200).cast("int"),
                              "toxic_guess": F.contains("text", F.lit("!")).cast("int")})
    return evaluate.accuracy_by_target(guess, {"quality": ("quality", "quality_guess"),
                                               "toxic": ("toxic", "toxic_guess")})


@query
def confusion_matrix(spark, folder):
    return evaluate.confusion_matrix(tier_predictions(spark, folder), ["non", "oui"],
                                     prediction="cloud")


@query
def precision_recall_f1(spark, folder):
    return evaluate.precision_recall_f1(tier_predictions(spark, folder), prediction="rules")


@query
def classified_targets(spark, folder):
    return evaluate.classified_targets(tier_predictions(spark, folder), prediction="cloud")


@query
def pr_roc_points(spark, folder):
    rows = tier_predictions(spark, folder)
    return evaluate.pr_roc_points(rows.withColumns({
        "label": (F.col("rules") == "oui").cast("int"), "score": F.round("score", 6)}))


@query
def cohen_kappa(spark, folder):
    long = tier_predictions(spark, folder).unpivot("msg_id", list(TIERS), "annotator", "label")
    return evaluate.cohen_kappa(long, item="msg_id")


@query
def fairness_gap(spark, folder):
    return evaluate.fairness_gap(tier_predictions(spark, folder), group="channel",
                                 prediction="cloud")


@query
def latency_summary(spark, folder):
    return evaluate.latency_summary(feedback(spark, folder), "latency_ms")


@query
def compare_models(spark, folder):
    return evaluate.compare_models(tier_predictions(spark, folder), {t: t for t in TIERS})


# --- streams -----------------------------------------------------------------------------

def message_stream(spark: SparkSession, folder: str) -> DataFrame:
    return feedback_from_events(streams.read_stream(spark, folder, "events.parquet"))


def _wall(df, *columns):
    """Times as zone-free timestamps, as in the given tables."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query
def stream_classify(spark, folder):
    stream = streams.stream_classify(message_stream(spark, folder).select("msg_id", "text"),
                                     fallback.fallback_cloud)
    return streams.run_available(stream, "classified").drop("text")


@query
def stream_dedup(spark, folder):
    stream = streams.stream_dedup(message_stream(spark, folder), delay="60 days")
    return streams.run_available(stream.select("text_md5"), "dedup")


@query
def stream_kpi_windows(spark, folder):
    stream = fallback.fallback_cloud(message_stream(spark, folder))
    return _wall(streams.kpi_window_table(stream, "windows"), "window_start", "window_end")


@query
def stream_kpi_sliding(spark, folder):
    stream = fallback.fallback_cloud(message_stream(spark, folder))
    return _wall(streams.kpi_window_table(stream, "sliding", length="6 hours", slide="2 hours"),
                 "window_start", "window_end")


@query
def stream_sessions(spark, folder):
    return _wall(streams.author_session_table(message_stream(spark, folder), "sessions"),
                 "session_start", "session_end")


@query
def stream_alerts(spark, folder):
    stream = streams.alerts(fallback.fallback_cloud(message_stream(spark, folder)))
    return streams.run_available(stream.select("msg_id", "author", "incident"), "alerts")


@query
def stream_alert_windows(spark, folder):
    stream = fallback.fallback_cloud(message_stream(spark, folder))
    windows = streams.kpi_window_table(stream, "alert-windows", length="1 hour")
    return _wall(streams.alert_windows(windows, 3), "window_start", "window_end").select(
        "window_start", "n", "urgent")
