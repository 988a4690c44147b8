"""DuckDB SQL for the registered queries."""

from echolens.plans.catalog import RAW_LABELS
from echolens.functions import lexicon as L
from echolens.operators.batches import PROMPT
from oracle.base import (ALL_TEXTS, FEEDBACK, NS, S, W, WORLD, any_, arr, ascii_, calibrated, cascade,
                         cleaned, cnt, collapse, consistency, emoji, fallback_basic,
                         fallback_cloud, fallback_local, guard_steps, lst, preprocess, q, rules,
                         scored, strip_mentions, strip_special, strip_urls, strip_urls_dotted,
                         unwrap_hashtags, vocab, with_)

SQL = {}


def over_texts(name, expr):
    SQL[name] = with_(ALL_TEXTS, body=f"SELECT kind, id, {expr} AS out FROM texts")


# --- files -------------------------------------------------------------------------------
SQL["read_messages_csv"] = """
SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, length(text)::bigint AS length
FROM documents"""
SQL["detect_encoding"] = r"""
SELECT w AS written, lang, CASE WHEN w = 'UTF-8' OR NOT bool_or(regexp_matches(text, '[^\x00-\x7F]'))
  THEN 'UTF-8' ELSE 'ISO-8859-1' END AS encoding
FROM documents, (VALUES ('UTF-8'), ('ISO-8859-1')) v(w) GROUP BY w, lang"""
SQL["export_classified"] = with_(FEEDBACK, body=f"""
SELECT msg_id, author, text, is_claim, urgence, incident, topics FROM ({rules('feedback')})""")

# --- validation --------------------------------------------------------------------------
SQL["column_profile"] = """
WITH v AS (SELECT 'text' AS col, text AS v FROM documents UNION ALL
  SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents)
SELECT col AS "column", count(*) AS n_rows, 5::bigint AS n_columns, count(v) AS valid,
  round(avg(length(v)), 4) AS avg_length,
  count(*) - count(DISTINCT v) - max((v IS NULL)::int) AS duplicates FROM v GROUP BY col"""
MEASURES = """m AS (SELECT count(*) AS n, count(*) - count(text) AS nulls, min(length(text)) AS lo,
  max(length(text)) AS hi, avg(length(text)) AS mean,
  count(*) - count(DISTINCT text) - max((text IS NULL)::int) AS dups FROM feedback)"""
SCORE = """round(greatest(0.0::double, least(100.0::double, 100.0::double - nulls::double / n * 30
  - dups::double / n * 20 - CASE WHEN mean < 10 THEN 20 WHEN mean < 20 THEN 10 ELSE 0 END
  + 10)), 4) AS quality_score"""
SQL["quality_score"] = with_(FEEDBACK, MEASURES, body=f"SELECT {SCORE} FROM m")
SQL["validate_structure"] = with_(FEEDBACK, MEASURES, body=f"""
SELECT true AS valid, n AS n_rows, 6::bigint AS n_columns, concat_ws('; ',
  'missing recommended: date, retweet_count, favorite_count',
  CASE WHEN nulls > 0 THEN nulls || ' empty texts' END,
  CASE WHEN lo < 5 THEN 'texts shorter than 5' END,
  CASE WHEN hi > 1000 THEN 'texts longer than 1000' END,
  CASE WHEN mean < 10 THEN 'very low average length' END,
  CASE WHEN n > 10000 THEN 'large file: ' || n WHEN n < 10 THEN 'fewer than 10 rows' END,
  CASE WHEN dups > 0 THEN dups || ' duplicates' END) AS warnings, {SCORE} FROM m""")
SQL["validate_text"] = with_(ALL_TEXTS, body=f"""
SELECT kind, id, error IS NULL AS valid, error, CASE WHEN error IS NULL THEN s END AS trimmed
FROM (SELECT kind, id, s, CASE WHEN coalesce(text, '') = '' THEN 'invalid text'
    WHEN length(s) < 3 THEN 'too short' WHEN length(s) > 1000 THEN 'too long' END AS error
  FROM (SELECT *, regexp_replace(text, '^{S}+|{S}+$', '', 'g') AS s FROM texts))""")
SQL["cleaning_stats"] = with_(FEEDBACK, f"c AS ({cleaned('feedback')})", """f AS (
  SELECT *, text IS NULL AS nul, text IS NOT NULL AND
    row_number() OVER (PARTITION BY text ORDER BY msg_id) > 1 AS dup FROM c)""", body="""
SELECT count(*) AS total_original, count(*) FILTER (nul) AS empty_texts,
  count(*) FILTER (dup) AS duplicates_removed,
  count(*) FILTER (NOT nul AND NOT dup AND text_cleaned <> '') AS total_cleaned,
  count(*) - count(*) FILTER (NOT nul AND NOT dup AND text_cleaned <> '') AS removed,
  round((count(*) - count(*) FILTER (NOT nul AND NOT dup AND text_cleaned <> '')) * 100.0::double
    / count(*), 4) AS reduction_pct,
  round(avg(length(text)) FILTER (NOT nul AND NOT dup), 4) AS avg_length_before,
  round(avg(length(text_cleaned)) FILTER (NOT nul AND NOT dup), 4) AS avg_length_after FROM f""")
SQL["filter_corpus"] = """
SELECT doc_id, lang, text FROM documents WHERE lang = 'fr' AND length(text) BETWEEN 10 AND 500
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"""
SQL["preview"] = with_(FEEDBACK, body="""
SELECT msg_id, author, text FROM feedback ORDER BY msg_id LIMIT 10""")
SQL["quality_distribution"] = with_(FEEDBACK, """s AS (
  SELECT 100 - CASE WHEN text IS NULL THEN 30 ELSE 0 END
    - CASE WHEN row_number() OVER (PARTITION BY text ORDER BY msg_id) > 1 THEN 20 ELSE 0 END
    - CASE WHEN length(coalesce(text, '')) < 10 THEN 20 WHEN length(text) < 20 THEN 10 ELSE 0 END
    AS score FROM feedback)""", body="""
SELECT least(score // 10 + 1, 10)::int AS bin, count(*) AS n FROM s GROUP BY 1""")

# --- cleaning ----------------------------------------------------------------------------
over_texts("clean_lower", "lower(text)")
over_texts("strip_urls", strip_urls("text"))
over_texts("strip_urls_dotted", strip_urls_dotted("text"))
over_texts("strip_mentions", strip_mentions("text"))
over_texts("strip_hashtags", f"regexp_replace(text, '#{W}+', '', 'g')")
over_texts("unwrap_hashtags", unwrap_hashtags("text"))
over_texts("emoji_to_text", emoji("text"))
over_texts("strip_emojis", r"regexp_replace(text, '[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}"
           r"\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+', '', 'g')")
over_texts("to_ascii", ascii_("text"))
SQL["emoji_sequences"] = with_(WORLD, body=f"SELECT msg_id, {emoji('text')} AS out FROM world")
SQL["transliterate"] = with_(WORLD, body=f"SELECT msg_id, {ascii_('text')} AS out FROM world")
SQL["clean_world_messages"] = with_(
    WORLD, body=f"SELECT msg_id, text_cleaned FROM ({cleaned('world')})")
over_texts("collapse_ws", collapse("text"))
over_texts("strip_special", strip_special("text"))
over_texts("strip_punct", strip_special("text").replace(r"\-.,!?", ",.?!"))
over_texts("drop_stopwords", "array_to_string(list_filter(string_split(lower(text), ' '), "
           "lambda w: w NOT IN ('le', 'la', 'the', 'ok')), ' ')")
over_texts("preprocess_text", preprocess("text"))
HITS = ", ".join(
    f"len(list_filter(ws, lambda w: list_contains({arr(p)}, w))) AS n_{code}"
    for code, p in L.STOPWORD_PROFILES.items())
LANG = (f"(SELECT *, CASE WHEN greatest(n_fr, n_en, n_de, n_es) = 0 THEN 'unknown' "
        f"WHEN n_fr >= n_en AND n_fr >= n_de AND n_fr >= n_es THEN 'fr' "
        f"WHEN n_en >= n_de AND n_en >= n_es THEN 'en' WHEN n_de >= n_es THEN 'de' "
        f"ELSE 'es' END AS found FROM (SELECT *, {HITS} FROM (SELECT *, "
        r"regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') AS ws FROM SRC)))")
SQL["detect_language_words"] = with_(ALL_TEXTS, body="SELECT kind, id, found AS out FROM "
                               + LANG.replace("SRC", "texts"))
SQL["language_accuracy_words"] = ("SELECT lang, found, count(*) AS n FROM "
                            + LANG.replace("SRC", "documents") + " GROUP BY lang, found")


def trigrams(src, out):
    """CTEs ``<out>(r, bin)`` of the trigrams of ``<src>(r, text)``."""
    return rf"""{out}_c AS (SELECT r, list_transform(string_split(' ' || t || ' ', ''), lambda c: unicode(c)) AS c FROM (
    SELECT r, trim(regexp_replace(lower(text), '([^\p{{L}}]|[\x{{10000}}-\x{{10FFFF}}])+', ' ', 'g')) AS t FROM {src})
  WHERE t <> ''),
{out}_u AS (SELECT r, unnest(c) AS a, unnest(c[2:]) AS b, unnest(c[3:]) AS c FROM {out}_c),
{out} AS (SELECT r, (a * 961 + b * 31 + c) % 8192 AS bin FROM {out}_u WHERE c IS NOT NULL)"""


def by_language(fitted):
    """CTEs ``w(lang, bin, w)``: the model of ``docs(r, lang, text)`` where ``fitted`` holds; ``dt`` are all trigrams."""
    return (trigrams("docs", "dt") + f""",
cn AS (SELECT lang, bin, count(*) AS n FROM dt JOIN docs USING (r) WHERE {fitted} AND lang IS NOT NULL GROUP BY lang, bin),
tot AS (SELECT lang, sum(n) AS total FROM cn GROUP BY lang),
w AS (SELECT lang, bin, round(ln((coalesce(n, 0) + 0.5::double) / (total + 0.5::double * 8192)) * 1000)::int AS w
  FROM tot CROSS JOIN (SELECT unnest(range(0, 8192)) AS bin) LEFT JOIN cn USING (lang, bin))""")


def found_language(src):
    return (f"(SELECT r, arg_max(lang, (s, lang)) AS found FROM (SELECT r, lang, sum(w) AS s FROM {src} JOIN w "
            "USING (bin) GROUP BY r, lang) GROUP BY r)")


SQL["language_accuracy"] = with_(
    "docs AS (SELECT row_number() OVER () AS r, lang, text, md5('fold|' || doc_id) >= '8' AS held_out FROM documents)",
    by_language("NOT held_out"), body=f"""
SELECT held_out, lang, coalesce(found, 'unknown') AS found, count(*) AS n FROM docs LEFT JOIN {found_language('dt')} USING (r)
GROUP BY ALL""")
SQL["detect_language"] = with_(
    ALL_TEXTS, "docs AS (SELECT row_number() OVER () AS r, lang, text FROM documents)", by_language("true"),
    "every AS (SELECT row_number() OVER () AS r, * FROM texts)", trigrams("every", "et"), body=f"""
SELECT kind, id, coalesce(found, 'unknown') AS out FROM every LEFT JOIN {found_language('et')} USING (r)""")
LOST = ", ".join(f"CASE WHEN contains(raw, {q(t)}) AND NOT contains(c, {q(t)}) THEN "
                 f"{q(t.replace(' ', '_'))} END" for t in sorted(L.DOMAIN_TERMS))
SQL["keep_domain_terms"] = with_(ALL_TEXTS, body=f"""
SELECT kind, id, CASE WHEN c = '' THEN c ELSE concat_ws(' ', c, {LOST}) END AS out FROM (
  SELECT *, lower(coalesce(text, '')) AS raw, {ascii_("lower(coalesce(text, ''))")} AS c
  FROM texts)""")
SQL["clean_text"] = with_(ALL_TEXTS, body=f"SELECT kind, id, text_cleaned FROM "
                          f"({cleaned('texts')})")
SQL["clean_dataset"] = with_(FEEDBACK, """d AS (SELECT * FROM feedback WHERE text IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY msg_id) = 1)""", body=f"""
SELECT msg_id, text_cleaned FROM ({cleaned('d')}) WHERE text_cleaned <> ''""")
SQL["flatten_struct"] = with_(FEEDBACK, body="""
SELECT msg_id, author AS src_author, channel AS src_via_channel, latency_ms AS src_via_latency_ms
FROM feedback""")

# --- deduplication -----------------------------------------------------------------------
SQL["dedup_exact"] = """SELECT doc_id, lang FROM documents
QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1"""
SQL["duplicate_count"] = with_(FEEDBACK, body="""
SELECT count(*) AS n_rows, count(DISTINCT text) + max((text IS NULL)::int) AS n_distinct,
  count(*) - count(DISTINCT text) - max((text IS NULL)::int) AS n_duplicates FROM feedback""")
SQL["duplicate_groups"] = with_(FEEDBACK, body="""
SELECT coalesce(md5(text), '') AS key, count(*) AS n, min(msg_id) AS first_id
FROM feedback GROUP BY 1 HAVING count(*) > 1""")

# --- rule tier ---------------------------------------------------------------------------


def texts_rules(name, columns):
    SQL[name] = with_(ALL_TEXTS, body=f"SELECT kind, id, {columns} FROM ({rules('texts')})")


CLAIM_INT = "(is_claim = 'oui')::int AS is_claim"
texts_rules("rule_claim", CLAIM_INT)
texts_rules("rule_urgency", "urgence")
texts_rules("rule_topic", "topics")
texts_rules("rule_incident", "incident")
texts_rules("rule_classify", f"{CLAIM_INT}, urgence, topics")
texts_rules("rule_classify_extended", "is_claim, urgence, topics, incident")
SQL["rule_statistics"] = with_(FEEDBACK, f"r AS ({rules('feedback')})", body="""
SELECT 'total' AS measure, '' AS label, count(*)::double AS value FROM r
UNION ALL SELECT 'claims_count', '', count(*) FILTER (is_claim = 'oui')::double FROM r
UNION ALL SELECT 'claims_percentage', '',
  round(count(*) FILTER (is_claim = 'oui') * 100.0::double / count(*), 4) FROM r
UNION ALL SELECT 'urgence', urgence, count(*)::double FROM r GROUP BY urgence
UNION ALL SELECT 'topics', topics, count(*)::double FROM r GROUP BY topics""")


def lexicon_case(rule_set):
    sets = L.RULE_SETS[rule_set]
    best = "greatest(" + ", ".join(cnt("t", ts) for _, ts in sets) + ", 0)"
    return (f"CASE {best} WHEN 0 THEN {q(L.RULE_SET_DEFAULTS[rule_set])} "
            + " ".join(f"WHEN {cnt('t', ts)} THEN {q(k)}" for k, ts in sets)
            + f" END AS {rule_set}")


SQL["theme_patterns"] = with_(ALL_TEXTS, body="SELECT kind, id, " + ", ".join(
    lexicon_case(r) for r in L.RULE_SETS)
    + " FROM (SELECT *, lower(coalesce(text, '')) AS t FROM texts)")
THEME_TERMS = "lex(label, term) AS (VALUES " + ", ".join(
    f"({q(k)}, {q(t)})" for k, ts in L.RULE_SETS["theme"] for t in ts) + ")"
SQL["term_hits"] = with_(FEEDBACK, THEME_TERMS, body="""
SELECT msg_id, label, term FROM feedback, lex WHERE contains(lower(text), term)""")
SQL["term_frequency"] = with_(ALL_TEXTS, THEME_TERMS, body="""
SELECT label, term, count(*) AS n FROM texts, lex WHERE contains(lower(text), term)
GROUP BY label, term HAVING count(*) >= 5""")

# --- scored tier -------------------------------------------------------------------------


def texts_scored(name, columns):
    SQL[name] = with_(ALL_TEXTS, body=f"SELECT kind, id, {columns} FROM ({scored('texts')})")


def unless_blank(c):
    return f"CASE WHEN coalesce(text, '') <> '' THEN {c} END AS {c}"


texts_scored("score_sentiment", "sentiment, " + unless_blank("sent_conf"))
texts_scored("score_claim", "reclamation, " + unless_blank("claim_conf"))
texts_scored("score_urgency", "urgence")
texts_scored("score_theme", "theme, " + unless_blank("theme_conf"))
texts_scored("infer_incident", "type_incident")
texts_scored("infer_team", "responsable")
texts_scored("global_confidence", "confiance")
SQL["polarity_sentiment"] = with_(FEEDBACK, body="""
SELECT msg_id, CASE WHEN p > 0.1::double THEN 'POSITIF' WHEN p < -0.1::double THEN 'NEGATIF'
  ELSE 'NEUTRE' END AS label, CASE WHEN abs(p) > 0.1::double THEN abs(p) ELSE 0.5::double END
  AS score
FROM (SELECT msg_id, (length(text) % 21 - 10) / 10.0::double AS p FROM feedback
  WHERE text IS NOT NULL)""")
SQL["classify_scored"] = with_(FEEDBACK, body=f"""
SELECT msg_id, sentiment, reclamation, urgence, theme, type_incident, responsable, confiance,
  CASE WHEN coalesce(text, '') = '' THEN 'empty_text' END AS error,
  CASE WHEN coalesce(text, '') <> '' THEN round(sent_conf, 4) END AS sent_conf,
  CASE WHEN coalesce(text, '') <> '' THEN round(claim_conf, 4) END AS reclam_conf,
  CASE WHEN coalesce(text, '') <> '' THEN round(theme_conf, 4) END AS theme_conf
FROM ({scored('feedback')})""")
TH = dict(L.SCORED_THEME)
SQL["zero_shot_theme"] = with_(FEEDBACK, "h AS (SELECT msg_id, [" + ", ".join(
    cnt("lower(coalesce(text, ''))", TH[t]) if t in TH else "0" for _, t in L.THEME_CANDIDATES)
    + "] AS n FROM feedback)", body=f"""
SELECT msg_id, CASE WHEN list_sum(n) = 0 THEN 'AUTRE' ELSE
  {arr([t for _, t in L.THEME_CANDIDATES])}[list_position(n, list_max(n))] END AS theme,
  CASE WHEN list_sum(n) = 0 THEN 0.5::double
       ELSE round(list_max(n)::double / list_sum(n), 6) END AS theme_score FROM h""")

# --- model scoring -----------------------------------------------------------------------
LOW = "lower(coalesce(text, ''))"
SQL["score_batches"] = with_(FEEDBACK, f"""b AS (
  SELECT *, greatest(-2, least(2, {cnt(LOW, L.SCORED_POSITIVE)} - {cnt(LOW, L.SCORED_NEGATIVE)}))
    AS k FROM feedback)""", """s AS (SELECT *,
  {}[k + 3] AS sentiment_detail, {}[k + 3] AS sentiment,
  1 / (exp(-abs(k + 2)) + exp(-abs(k + 1)) + exp(-abs(k)) + exp(-abs(k - 1)) + exp(-abs(k - 2)))
    AS conf FROM b)""".format(arr(L.STAR_LABELS), arr(L.STAR_SENTIMENTS)), body=f"""
SELECT msg_id, sentiment, sentiment_detail, round(conf, 6) AS sentiment_confidence
FROM ({calibrated('s', 'text', 'sentiment', 'conf')})""")
SQL["collapse_stars"] = f"""
SELECT vec_id, {arr(L.STAR_LABELS)}[p] AS label, {arr(L.STAR_SENTIMENTS)}[p] AS sentiment,
  round(1 / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))), 6) AS confidence
FROM (SELECT vec_id, e, list_position(e, list_max(e)) AS p
  FROM (SELECT vec_id, list_transform(range(0, 5), lambda k:
    list_sum(list_transform(range(k + 1, len(embedding) + 1, 5), lambda i: embedding[i]::double))) AS e
    FROM embeddings))"""
SQL["star_sentiment"] = """
SELECT event_id, stars, CASE stars WHEN '5 stars' THEN 'POSITIF' WHEN '4 stars' THEN 'POSITIF'
  WHEN '2 stars' THEN 'NEGATIF' WHEN '1 star' THEN 'NEGATIF' ELSE 'NEUTRE' END AS sentiment
FROM (SELECT event_id, (user_id % 6 + 1) || CASE WHEN user_id % 6 = 0 THEN ' star'
  ELSE ' stars' END AS stars FROM events)"""
SQL["calibrate_sentiment"] = with_(FEEDBACK, f"b AS ({fallback_basic('feedback')})", body=f"""
SELECT msg_id, sentiment, confidence FROM ({calibrated('b', 'text')})""")

# --- language-model batches --------------------------------------------------------------
BATCHES = """batches AS (SELECT *, (row_number() OVER (ORDER BY msg_id) - 1) // 50 AS batch_id,
  ((row_number() OVER (ORDER BY msg_id) - 1) % 50)::int AS pos FROM feedback)"""
SQL["make_batches"] = with_(FEEDBACK, BATCHES, body="SELECT msg_id, batch_id, pos FROM batches")
HEAD, TAIL = PROMPT.replace("%2$s", "").split("%1$d")
SQL["build_prompts"] = with_(FEEDBACK, BATCHES, body=f"""
SELECT batch_id, count(*)::int AS n, {q(HEAD)} || count(*) || {q(TAIL)} ||
  string_agg(pos || ': ' || coalesce(text, '') || chr(10), '' ORDER BY pos) AS prompt
FROM batches GROUP BY batch_id""")
# what the stand-in service answers, row by row
REPLIES = f"""asked AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS n,
    batch_id % 7 <> 3 AS answered FROM ({fallback_local('batches')})),
replied AS (SELECT msg_id, batch_id, pos, text, answered,
  answered AND NOT (batch_id % 5 = 1 AND pos >= n - 3) AS there, pos % 4 AS v, pos % 9 = 5 AS odd,
  sentiment AS s0, categorie AS c0, score_confiance AS p0, is_claim AS k0, urgence AS u0,
  topics AS t0, incident AS i0 FROM asked),
padded AS (SELECT msg_id, batch_id, pos, text, answered,
  CASE WHEN NOT there THEN NULL WHEN v = 1 THEN CASE s0 WHEN 'positif' THEN 'Positive'
    WHEN 'negatif' THEN 'NEGATIVE' ELSE ' Neutral ' END ELSE s0 END AS sentiment,
  CASE WHEN there AND v <> 2 THEN c0 END AS categorie,
  CASE WHEN there AND odd THEN 1.7::double WHEN there AND v <> 2 THEN p0 END AS score_confiance,
  CASE WHEN NOT there OR v = 2 THEN NULL WHEN v = 1 THEN
    CASE k0 WHEN 'oui' THEN 'YES' ELSE 'no' END ELSE k0 END AS is_claim,
  CASE WHEN there AND odd THEN 'maximal' WHEN there AND v <> 2 THEN u0 END AS urgence,
  CASE WHEN there AND v = 3 THEN 'inconnu' WHEN there AND v <> 2 THEN t0 END AS topics,
  CASE WHEN there AND v <> 2 THEN i0 END AS incident FROM replied)"""
LABELS = "sentiment, categorie, score_confiance, is_claim, urgence, topics, incident"
SQL["parse_responses"] = with_(FEEDBACK, BATCHES, body="""
SELECT batch_id, (CASE WHEN batch_id % 7 = 3 THEN NULL WHEN batch_id % 5 = 1
    THEN greatest(count(*) - 3, 0) WHEN batch_id % 5 = 2 THEN count(*) + least(count(*), 2)
    ELSE count(*) END)::int AS answers FROM batches GROUP BY batch_id""")
SQL["pad_responses"] = with_(FEEDBACK, BATCHES, REPLIES, body=f"""
SELECT msg_id, batch_id, pos, answered, {LABELS} FROM padded""")


def validated(name, score, synonyms):
    """CTEs ``<name>1..3`` and ``<name>``: fields in order of dependence."""
    raw = lambda c: f"lower(trim({c}))"
    keep = lambda c, values: f"CASE WHEN {raw(c)} IN {lst(values)} THEN {raw(c)}"
    no_inc = "CASE WHEN is_claim = 'non' THEN 'aucun' ELSE 'non_specifie' END"
    from_sent = "CASE WHEN sentiment = 'negatif' THEN 'oui' ELSE 'non' END"
    if synonyms:
        sent = vocab(raw("sentiment"), L.SENTIMENT_SYNONYMS, "'neutre'")
        cat = vocab(raw("categorie"), L.CATEGORY_SYNONYMS, "'autre'")
        claim = vocab(raw("coalesce(is_claim, 'non')"), L.CLAIM_SYNONYMS, from_sent)
        urg = vocab(raw("coalesce(urgence, 'faible')"), L.URGENCY_SYNONYMS,
                    "CASE WHEN is_claim = 'oui' AND sentiment = 'negatif' THEN 'haute' "
                    "WHEN is_claim = 'oui' THEN 'moyenne' ELSE 'faible' END")
    else:
        sent = keep("sentiment", L.SENTIMENTS) + " ELSE 'neutre' END"
        cat = keep("categorie", L.CATEGORIES) + " ELSE 'autre' END"
        claim = keep("is_claim", L.CLAIMS) + f" ELSE {from_sent} END"
        urg = keep("coalesce(urgence, 'faible')", L.URGENCIES) \
            + " WHEN is_claim = 'oui' THEN 'moyenne' ELSE 'faible' END"
    return f"""{name}1 AS (SELECT * REPLACE ({sent} AS sentiment, {cat} AS categorie,
  CAST(printf('%.2f', {score}) AS DOUBLE) AS score_confiance) FROM padded),
{name}2 AS (SELECT * REPLACE ({claim} AS is_claim) FROM {name}1),
{name} AS (SELECT * REPLACE ({urg} AS urgence,
  {keep('topics', L.TOPICS)} WHEN categorie IN ('promotion', 'autre') THEN categorie
    ELSE 'autre' END AS topics,
  {keep('incident', L.INCIDENTS)} ELSE {no_inc} END AS incident) FROM {name}2)"""


STRICT = validated("st", "greatest(0.4::double, least(0.99::double, "
                   "coalesce(score_confiance, 0.6::double)))", False)
SYNONYMS = validated("sy", "greatest(0.0::double, least(1.0::double, "
                     "coalesce(score_confiance, 0.5::double)))", True)
CHAIN = (FEEDBACK, BATCHES, REPLIES)
SQL["validate_result_strict"] = with_(*CHAIN, STRICT, body=f"SELECT msg_id, {LABELS} FROM st")
SQL["validate_result_synonyms"] = with_(*CHAIN, SYNONYMS,
                                        body=f"SELECT msg_id, {LABELS} FROM sy")
SQL["guard_local"] = with_(*CHAIN, STRICT, guard_steps("st", "text", True),
                           body=f"SELECT msg_id, {LABELS} FROM g")
SQL["guard_cloud"] = with_(*CHAIN, SYNONYMS, guard_steps("sy", "text", False),
                           body=f"SELECT msg_id, {LABELS} FROM g")
SQL["classify_replies_local"] = with_(
    *CHAIN, STRICT, guard_steps("st", "text", True), body=f"""
SELECT msg_id, {LABELS} FROM g WHERE answered UNION ALL
SELECT msg_id, {LABELS} FROM ({fallback_local('(SELECT msg_id, text FROM padded WHERE NOT answered)')})""")
SQL["classify_replies_cloud"] = with_(
    *CHAIN, SYNONYMS, f"seen AS (SELECT *, {preprocess('text')} AS seen FROM sy)",
    guard_steps("seen", "seen", False, "a"), f"""
un AS (SELECT msg_id, text, {LABELS} FROM a WHERE answered UNION ALL SELECT msg_id, text, {LABELS}
  FROM ({fallback_cloud('(SELECT msg_id, text, seen FROM seen WHERE NOT answered)', 'seen')}))""",
    guard_steps("un", "text", False), body=f"SELECT msg_id, {LABELS} FROM g")
for _name, _f in (("fallback_local", fallback_local), ("fallback_cloud", fallback_cloud),
                  ("fallback_basic", fallback_basic)):
    SQL[_name] = with_(ALL_TEXTS, body=f"SELECT * EXCLUDE (text) FROM ({_f('texts')})")
SQL["tag_provenance"] = with_(FEEDBACK, body=f"""
SELECT msg_id, score_confiance AS confidence, 'cloud' AS classification_method,
  'terms-1' AS model_name, '2024-01-31T00:00:00' AS classification_timestamp
FROM ({fallback_cloud('feedback')})""")
CLS = (f"cls AS (SELECT *, score_confiance AS confidence FROM ({fallback_cloud('feedback')}))")
SQL["classification_stats"] = with_(FEEDBACK, CLS, body="""
SELECT 'total_classified' AS measure, '' AS label, count(*)::double AS value FROM cls
UNION ALL SELECT 'avg_confidence', '', round(avg(score_confiance), 4) FROM cls
UNION ALL SELECT 'min_confidence', '', min(score_confiance) FROM cls
UNION ALL SELECT 'max_confidence', '', max(score_confiance) FROM cls
UNION ALL SELECT 'sentiment', sentiment, count(*)::double FROM cls GROUP BY sentiment
UNION ALL SELECT 'categorie', categorie, count(*)::double FROM cls GROUP BY categorie""")

# --- tiers together ----------------------------------------------------------------------


def priority_sample(src, out):
    """CTEs of the priority sample: ``<out>(msg_id, stratum)``."""
    return f"""{out}_s AS (SELECT msg_id, CASE WHEN is_claim = 'oui' AND urgence = 'haute' THEN 'urgent'
    WHEN is_claim = 'oui' AND urgence = 'moyenne' THEN 'medium' WHEN is_claim = 'oui' THEN 'low'
    ELSE 'rest' END AS stratum FROM {src}),
{out}_r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || msg_id)) AS r
  FROM {out}_s),
{out}_n AS (SELECT count(*) AS n, count(*) FILTER (stratum = 'urgent') AS a,
  count(*) FILTER (stratum = 'medium') AS b, count(*) FILTER (stratum = 'rest') AS c FROM {out}_s),
{out} AS (SELECT msg_id, stratum FROM {out}_r, {out}_n WHERE
  CASE stratum WHEN 'urgent' THEN true WHEN 'medium' THEN r <= greatest(b // 2, 50)
    WHEN 'low' THEN a + b + c = 0 AND r <= 100
    ELSE r <= greatest(floor(n * 0.2::double) - a - least(b, greatest(b // 2, 50)), 50) END)"""


SQL["sample_priority"] = with_(FEEDBACK, f"r AS ({rules('feedback')})", priority_sample("r", "sm"),
                               body="SELECT msg_id, stratum FROM sm")
SQL["sample_diverse"] = with_(FEEDBACK, CLS, """s AS (SELECT msg_id, md5('42|' || msg_id) AS h,
    CASE WHEN is_claim = 'oui' THEN 'claim' ELSE 's:' || sentiment END AS stratum FROM cls)""", """
p AS (SELECT count(*) AS n, greatest(100, floor(count(*) * 0.2::double)) AS size,
  count(*) FILTER (is_claim = 'oui') AS claims, count(DISTINCT coalesce(sentiment, '')) AS kinds FROM cls)""", """
a AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h) AS r FROM s)""", """
b AS (SELECT *, CASE WHEN stratum = 'claim' THEN r <= size
  ELSE r <= floor(greatest(size - claims, 0) / kinds) END AS chosen FROM a, p)""", """
c AS (SELECT *, row_number() OVER (PARTITION BY chosen ORDER BY h) AS rest,
  size - count(*) FILTER (chosen) OVER () AS missing FROM b)""", body="""
SELECT msg_id, stratum FROM c WHERE chosen OR rest <= missing""")
SQL["clean_on_demand"] = with_(FEEDBACK, body=f"""
SELECT msg_id, text_cleaned FROM ({cleaned('feedback')})""")
ANSWERS = (f"r AS ({rules('feedback')})", priority_sample("r", "sm"),
           f"ans AS ({fallback_local('(SELECT f.* FROM feedback f JOIN sm USING (msg_id))')})")
SQL["merge_tier_results"] = with_(FEEDBACK, *ANSWERS, body="""
SELECT r.msg_id, coalesce(a.is_claim, r.is_claim) AS is_claim, a.categorie AS topics, a.incident,
  a.score_confiance AS confidence FROM r LEFT JOIN ans a USING (msg_id)""")
SQL["backfill_prelim"] = with_(FEEDBACK, *ANSWERS, body="""
SELECT r.msg_id, coalesce(a.categorie, r.topics) AS topics,
  coalesce(a.incident, r.incident) AS incident FROM r LEFT JOIN ans a USING (msg_id)""")
PRE = preprocess("text_cleaned")
TERMS = f"""cl AS ({cleaned('feedback')}),
m0 AS (SELECT *, CASE WHEN p > n THEN 'positif' WHEN n > p THEN 'negatif' ELSE 'neutre' END
    AS sentiment, CASE WHEN pc = '' THEN 0.0::double WHEN p <> n THEN 0.6::double
    ELSE 0.5::double END AS model_conf
  FROM (SELECT *, {cnt('pc', L.SCORED_POSITIVE)} AS p, {cnt('pc', L.SCORED_NEGATIVE)} AS n
    FROM (SELECT *, {PRE} AS pc FROM cl))),
tiers AS (SELECT * EXCLUDE (p, n, pc) FROM ({rules('(' + calibrated('m0', 'text_cleaned', 'sentiment', 'model_conf') + ')', 'text_cleaned')}))"""
SQL["aggregate_confidence"] = with_(FEEDBACK, TERMS, *ANSWERS, body="""
SELECT t.msg_id, round((model_conf + coalesce(a.score_confiance, 0)
  + CASE WHEN coalesce(a.is_claim, t.is_claim) = 'oui' THEN 0.85::double ELSE 0.70::double END)
  / CASE WHEN a.msg_id IS NULL THEN 2 ELSE 3 END, 6) AS confidence
FROM tiers t LEFT JOIN ans a USING (msg_id)""")
SQL["enforce_consistency"] = with_(FEEDBACK, f"cl AS ({cleaned('feedback')})",
                                   f"b AS ({fallback_basic('cl')})",
                                   consistency("b", "text_cleaned"), body="""
SELECT msg_id, is_claim, urgence, incident, topics, confidence FROM k""")


def mode(chosen):
    """The merged table: ``chosen`` is the condition for rows the costly tier answered."""
    llm = fallback_local("(SELECT msg_id, text_cleaned FROM tiers)", "text_cleaned")
    return f"""llm AS ({llm}), mg AS (
  SELECT t.msg_id, t.text_cleaned, t.sentiment, t.urgence,
    CASE WHEN {chosen} THEN l.is_claim ELSE t.is_claim END AS is_claim,
    CASE WHEN {chosen} THEN l.categorie ELSE t.topics END AS topics,
    CASE WHEN {chosen} THEN l.incident ELSE t.incident END AS incident,
    CASE WHEN {chosen} THEN (model_conf + l.score_confiance
        + CASE WHEN l.is_claim = 'oui' THEN 0.85::double ELSE 0.70::double END) / 3
      ELSE (model_conf + CASE WHEN t.is_claim = 'oui' THEN 0.85::double ELSE 0.70::double END) / 2
      END AS confidence FROM tiers t JOIN llm l USING (msg_id))"""


MODE_BODY = ("SELECT msg_id, sentiment, is_claim, urgence, topics, incident, "
             "round(confidence, 6) AS confidence FROM k")
SQL["classify_mode"] = with_(FEEDBACK, TERMS, priority_sample("tiers", "sm"),
                             mode("t.msg_id IN (SELECT msg_id FROM sm)"),
                             consistency("mg", "text_cleaned"), body=MODE_BODY)
SQL["classify_mode_fast"] = with_(FEEDBACK, TERMS, mode("false"),
                                  consistency("mg", "text_cleaned"), body=MODE_BODY)
SQL["classify_mode_precise"] = with_(FEEDBACK, TERMS, mode("true"),
                                     consistency("mg", "text_cleaned"), body=MODE_BODY)
SQL["complete_columns"] = with_(FEEDBACK, body=f"""
SELECT msg_id, is_claim, 'neutre' AS sentiment, 'faible' AS urgence, 'autre' AS topics,
  'autre' AS incident, 0.5::double AS confidence FROM ({rules('feedback')})""")
SQL["result_cache"] = with_(FEEDBACK, """k AS (
  SELECT md5('bert:v2:' || coalesce(text, '')) AS key, ts < '2024-01-16' AS early FROM feedback),
e AS (SELECT DISTINCT key FROM k WHERE early)""", body="""
SELECT count(DISTINCT key) AS entries, count(*) FILTER (key IN (SELECT key FROM e)) AS hits,
  count(*) FILTER (key NOT IN (SELECT key FROM e)) AS misses,
  round(count(*) FILTER (key IN (SELECT key FROM e)) * 100.0::double / count(*), 4) AS hit_rate
FROM k""")

SQL["cached_sentiment"] = with_(FEEDBACK, f"""m0 AS (SELECT *, CASE WHEN p > n THEN 'positif' WHEN n > p THEN 'negatif'
    ELSE 'neutre' END AS sentiment, CASE WHEN pc = '' THEN 0.0::double WHEN p <> n THEN 0.6::double
    ELSE 0.5::double END AS model_conf
  FROM (SELECT *, {cnt('pc', L.SCORED_POSITIVE)} AS p, {cnt('pc', L.SCORED_NEGATIVE)} AS n
    FROM (SELECT *, {preprocess("coalesce(text, '')")} AS pc FROM feedback)))""",
    f"c AS ({calibrated('m0', 'text', 'sentiment', 'model_conf')})", body="""
SELECT msg_id, coalesce(text, '') IN (SELECT coalesce(text, '') FROM feedback WHERE ts < '2024-01-16') AS hit,
  sentiment, round(model_conf, 6) AS confidence FROM c""")

def counts_json(c):
    return (f"(SELECT '{{' || string_agg('\"' || {c} || '\":' || n, ',' ORDER BY {c}) || '}}' "
            f"FROM (SELECT {c}, count(*) AS n FROM cls GROUP BY {c})) AS {c}_json")


SQL["classification_report"] = with_(FEEDBACK, CLS, body=f"""
SELECT count(*) AS total, count(*) FILTER (is_claim = 'oui') AS claims_count,
  round(count(*) FILTER (is_claim = 'oui') * 100.0::double / count(*), 4) AS claims_percentage,
  round(count(*) FILTER (sentiment = 'positif') * 100.0::double / count(*), 4)
    AS sentiment_positif_pct,
  round(count(*) FILTER (sentiment = 'negatif') * 100.0::double / count(*), 4)
    AS sentiment_negatif_pct,
  count(*) FILTER (urgence = 'haute') AS urgence_haute_count,
  count(DISTINCT topics) AS topics_count, count(DISTINCT incident) AS incident_count,
  round(avg(confidence), 4) AS confidence_avg, min(confidence) AS confidence_min,
  max(confidence) AS confidence_max, {counts_json('sentiment')}, {counts_json('urgence')},
  {counts_json('topics')}, {counts_json('incident')} FROM cls""")
SQL["claims_by_language"] = f"""
WITH d AS (SELECT doc_id, lang, text FROM documents), cl AS ({cleaned('d')}),
r AS (SELECT *, {cnt('text_cleaned', L.SCORED_POSITIVE)} AS p,
  {cnt('text_cleaned', L.SCORED_NEGATIVE)} AS n FROM ({rules('cl', 'text_cleaned')}))
SELECT lang, count(*) AS total, count(*) FILTER (is_claim = 'oui') AS claims,
  round(count(*) FILTER (is_claim = 'oui') * 100.0::double / count(*), 4) AS claim_pct,
  count(*) FILTER (urgence = 'haute') AS high_urgency,
  round(count(*) FILTER (urgence = 'haute') * 100.0::double / count(*), 4) AS high_urgency_pct,
  count(*) FILTER (n > p) AS negative, count(*) FILTER (topics = 'fibre') AS fibre,
  count(*) FILTER (topics = 'mobile') AS mobile, count(*) FILTER (topics = 'facture') AS facture,
  count(*) FILTER (topics = 'autre') AS autre FROM r GROUP BY lang"""

# --- indicators --------------------------------------------------------------------------


def value_list(values):
    return "[" + ", ".join("NULL" if v is None else q(v) for v in values) + "]"


RAW = "raw AS (SELECT msg_id, text, " + ", ".join(
    f"{value_list(v)}[msg_id % {len(v)} + 1] AS {c}" for c, v in RAW_LABELS.items()) \
    + " FROM feedback)"
LT = "lower(trim({}))".format
TRUE = f"coalesce({LT('is_claim')} IN {lst(L.TRUE_WORDS)}, false)"
N_SENT = vocab(LT("sentiment"), L.NORMAL_SENTIMENT, LT("sentiment"))
N_CLAIM = vocab(LT("is_claim"), L.NORMAL_CLAIM, LT("is_claim"))
N_URG = (f"CASE WHEN urgence IS NULL THEN 'faible' ELSE "
         + vocab(LT("urgence"), L.NORMAL_URGENCY,
                 f"CASE WHEN {TRUE} AND {LT('sentiment')} IN ('negatif', 'negative', 'neg') THEN "
                 f"'haute' WHEN {TRUE} THEN 'moyenne' ELSE 'faible' END") + " END")
N_INC = (f"CASE WHEN coalesce({LT('incident')}, '') IN ('', 'nan') THEN 'aucun' WHEN "
         f"{LT('incident')} IN {lst(L.NORMAL_INCIDENTS)} THEN {LT('incident')} WHEN {TRUE} THEN "
         f"'non_specifie' ELSE 'aucun' END")
N_CONF = ("greatest(0.0::double, least(1.0::double, coalesce(try_cast(confidence AS DOUBLE), "
          "0.5::double)))")
for _name, _col, _sql in (
        ("normalize_sentiment", "sentiment", N_SENT), ("normalize_claim", "is_claim", N_CLAIM),
        ("normalize_urgency", "urgence", N_URG), ("normalize_incident", "incident", N_INC),
        ("normalize_confidence", "confidence", N_CONF)):
    SQL[_name] = with_(FEEDBACK, RAW, body=f"SELECT msg_id, {_sql} AS {_col} FROM raw")
SQL["resolve_aliases"] = with_(FEEDBACK, RAW, body="""
SELECT msg_id, sentiment, 'non' AS is_claim, urgence, 'aucun' AS incident, incident AS theme,
  try_cast(confidence AS DOUBLE) AS confidence FROM raw""")
SQL["normalize_kpis"] = with_(FEEDBACK, RAW, f"""n1 AS (
  SELECT * REPLACE ({N_SENT} AS sentiment, {N_CLAIM} AS is_claim) FROM raw)""", body=f"""
SELECT msg_id, coalesce(sentiment, 'neutre') AS sentiment, coalesce(is_claim, 'non') AS is_claim,
  {N_URG} AS urgence, {N_INC} AS incident, {N_CONF} AS confidence, 'AUTRE' AS theme FROM n1""")
PCT = "round(count(*) FILTER ({}) * 100.0::double / count(*), 4)".format
SQL["kpi_metrics"] = with_(FEEDBACK, CLS, body=f"""
SELECT 'total' AS measure, '' AS label, count(*)::double AS value FROM cls
UNION ALL SELECT 'claims_count', '', count(*) FILTER (is_claim = 'oui')::double FROM cls
UNION ALL SELECT 'claims_pct', '', {PCT("is_claim = 'oui'")} FROM cls
UNION ALL SELECT 'negative_count', '', count(*) FILTER (sentiment = 'negatif')::double FROM cls
UNION ALL SELECT 'negative_pct', '', {PCT("sentiment = 'negatif'")} FROM cls
UNION ALL SELECT 'high_urgency_count', '', count(*) FILTER (urgence = 'haute')::double FROM cls
UNION ALL SELECT 'high_urgency_pct', '', {PCT("urgence = 'haute'")} FROM cls
UNION ALL SELECT 'confidence_avg', '', round(avg(confidence), 4) FROM cls
""" + "".join(f"UNION ALL SELECT '{c}', {c}, count(*)::double FROM cls GROUP BY {c}\n"
              for c in ("sentiment", "urgence", "topics", "incident")))
SQL["claim_rate"] = SQL["export_report_json"] = with_(FEEDBACK, CLS, body=f"""
SELECT count(*) FILTER (is_claim = 'oui') AS claim_count, {PCT("is_claim = 'oui'")} AS claim_rate,
  count(*) AS total FROM cls""")
ENR = f"""enr AS (SELECT msg_id, channel, sentiment, urgence, confiance AS confidence, theme,
  CASE WHEN coalesce(text, '') <> '' THEN theme_conf END AS theme_confidence,
  type_incident AS incident,
  CASE WHEN coalesce(text, '') <> '' THEN claim_conf END AS claim_confidence, responsable AS team,
  CASE reclamation WHEN 'OUI' THEN 'Oui' ELSE 'Non' END AS claim FROM ({scored('feedback')}))"""
SQL["thematic_distribution"] = with_(FEEDBACK, ENR, body="""
SELECT theme AS label, count(*) AS n,
  round(count(*) * 100.0::double / sum(count(*)) OVER (), 4) AS pct,
  count(*) OVER () AS kinds, first(theme) OVER (ORDER BY count(*) DESC, theme) AS top,
  (SELECT round(avg(theme_confidence), 4) FROM enr) AS avg_confidence FROM enr GROUP BY theme""")
SAT = {"pos": f"{LT('sentiment')} IN ('positive', 'positif', 'pos', '1', 'good', 'happy')",
       "neu": f"{LT('sentiment')} IN ('neutral', 'neutre', 'neu', '0', 'ok')",
       "neg": f"{LT('sentiment')} IN ('negative', 'négatif', 'negatif', 'neg', '-1', 'bad', "
              f"'angry')"}
INDEX = (f"round((count(*) FILTER ({SAT['pos']}) - count(*) FILTER ({SAT['neg']}))::double "
         f"/ count(*) * 50 + 50, 4)")
SAT_COLS = f"""{INDEX} AS satisfaction_index, count(*) FILTER ({SAT['pos']}) AS positive_count,
  count(*) FILTER ({SAT['neu']}) AS neutral_count, count(*) FILTER ({SAT['neg']})
  AS negative_count, {PCT(SAT['pos'])} AS positive_pct, {PCT(SAT['neu'])} AS neutral_pct,
  {PCT(SAT['neg'])} AS negative_pct"""
SQL["satisfaction_index"] = with_(FEEDBACK, RAW, body=f"SELECT {SAT_COLS} FROM raw")
CRIT = "coalesce(regexp_matches(lower(urgence), 'critique|critical|urgent|très haute'), false)"
HIGH = f"(coalesce(regexp_matches(lower(urgence), 'haute|high|élevée'), false) AND NOT {CRIT})"
URG_COLS = f"""count(*) FILTER ({CRIT}) AS critical_count, count(*) FILTER ({HIGH}) AS high_count,
  count(*) FILTER ({CRIT} OR {HIGH}) AS urgent_total, {PCT(CRIT + ' OR ' + HIGH)} AS urgency_pct"""
SQL["urgency_rate"] = with_(FEEDBACK, RAW, body=f"SELECT {URG_COLS} FROM raw")
CONF_COLS = """round(avg(x), 4) AS average, round(min(x), 4) AS minimum, round(max(x), 4) AS maximum,
  round(coalesce(stddev_samp(x), 0), 4) AS std"""
SQL["confidence_summary"] = with_(FEEDBACK, RAW, body=f"""
SELECT {CONF_COLS} FROM (SELECT try_cast(confidence AS DOUBLE) AS x FROM raw)""")
SQL["incident_distribution"] = with_(FEEDBACK, ENR, body="""
SELECT 'incident' AS kind, incident AS label, count(*) AS n,
  round(count(*) * 100.0::double / sum(count(*)) OVER (), 4) AS pct,
  row_number() OVER (ORDER BY count(*) DESC, incident) = 1 AS is_top,
  (SELECT round(avg(claim_confidence), 4) FROM enr) AS avg_confidence FROM enr GROUP BY incident
UNION ALL SELECT 'responsable', team, count(*),
  round(count(*) * 100.0::double / sum(count(*)) OVER (), 4),
  row_number() OVER (ORDER BY count(*) DESC, team) = 1, NULL FROM enr GROUP BY team""")
SQL["claims_enriched"] = with_(FEEDBACK, ENR, body=f"""
SELECT count(*) FILTER (claim = 'Oui') AS oui_count, count(*) FILTER (claim = 'Non') AS non_count,
  {PCT("claim = 'Oui'")} AS oui_pct, {PCT("claim = 'Non'")} AS non_pct,
  round(avg(claim_confidence), 4) AS avg_confidence FROM enr""")
CLAIM_ITEMS = ("claim_rate", ["claim_count", "claim_rate", "total"])
SQL["business_kpis"] = with_(FEEDBACK, ENR, f"""one AS (SELECT
  0::bigint AS claim_count, 0.0::double AS claim_rate, count(*) AS total, {SAT_COLS}, {URG_COLS},
  {CONF_COLS} FROM (SELECT *, confidence AS x FROM enr))""", body=" UNION ALL ".join(
    f"SELECT '{k}' AS kpi, '{c}' AS item, round({c}::double, 4) AS value FROM one"
    for k, cs in (CLAIM_ITEMS,
                  ("urgency_rate", ["critical_count", "high_count", "urgent_total",
                                    "urgency_pct"]),
                  ("confidence_score", ["average", "minimum", "maximum", "std"]),
                  ("satisfaction_index", ["satisfaction_index", "positive_count", "neutral_count",
                                          "negative_count", "positive_pct", "neutral_pct",
                                          "negative_pct"])) for c in cs) + "".join(
    f"\nUNION ALL SELECT '{k}', {c}, count(*)::double FROM enr GROUP BY {c}"
    for k, c in (("thematic_distribution", "theme"), ("incident_distribution", "incident"),
                 ("responsable_distribution", "team"), ("reclamations_enriched", "claim"))))
REAL = ("urgence IN ('haute', 'high', 'elevee', 'élevée', 'critique', 'critical') AND "
        f"incident NOT IN {lst(L.EMPTY_INCIDENTS)}")
CRITICAL = f"incident IN {lst(L.CRITICAL_INCIDENTS)}"
SQL["quality_summary"] = with_(FEEDBACK, CLS, body=f"""
SELECT count(*) FILTER (is_claim = 'oui') AS claims, {PCT("is_claim = 'oui'")} AS claim_coverage,
  count(sentiment) AS with_sentiment, {PCT('sentiment IS NOT NULL')} AS sentiment_coverage,
  CASE WHEN count(*) FILTER ({CRITICAL}) > 0 THEN count(*) FILTER ({CRITICAL})
       ELSE count(*) FILTER ({REAL}) END AS critical_incidents FROM cls""")
SQL["top_real_incident"] = with_(FEEDBACK, CLS, body="""
SELECT incident, count(*) AS n FROM cls WHERE incident NOT IN ('aucun', 'non', 'none', 'n/a', 'na',
  '') GROUP BY incident ORDER BY n DESC, incident LIMIT 1""")
SQL["alert_bands"] = with_(FEEDBACK, ENR, f"""b AS (SELECT channel, {PCT("claim = 'Oui'")} AS claim,
  {INDEX} AS satisfaction, {PCT(CRIT + ' OR ' + HIGH)} AS urgency,
  round(avg(confidence), 4) AS confidence FROM enr GROUP BY channel)""", body="""
SELECT *, CASE WHEN claim > 30 THEN 'alert' WHEN claim > 15 THEN 'watch' ELSE 'good' END
    AS claim_band,
  CASE WHEN satisfaction > 60 THEN 'positive' WHEN satisfaction > 40 THEN 'neutral'
    ELSE 'negative' END AS satisfaction_band,
  CASE WHEN urgency > 20 THEN 'high' WHEN urgency > 10 THEN 'moderate' ELSE 'low' END
    AS urgency_band,
  CASE WHEN confidence > 0.8 THEN 'high' WHEN confidence > 0.6 THEN 'medium' ELSE 'low' END
    AS confidence_band FROM b""")
SQL["map_vocabulary_en"] = with_(FEEDBACK, CLS, body="""
SELECT msg_id, CASE sentiment WHEN 'positif' THEN 'positive' WHEN 'negatif' THEN 'negative'
  ELSE 'neutral' END AS sentiment, urgence AS priority, incident AS category FROM cls""")
SQL["group_kpi_stats"] = with_(FEEDBACK, ENR, body=" UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {c} AS label, count(*) AS \"count\", round(count(*) * "
    f"100.0::double / sum(count(*)) OVER (), 2) AS percentage, round(avg({x}), 2) AS "
    f"avg_confidence FROM enr GROUP BY {c}"
    for d, c, x in (("theme", "theme", "theme_confidence"),
                    ("incident", "incident", "claim_confidence"),
                    ("claim", "claim", "claim_confidence"),
                    ("team", "team", "claim_confidence"))))
SQL["flat_kpis"] = with_(FEEDBACK, CLS, body="""
SELECT 'total' AS item, count(*)::double AS value FROM cls
""" + "".join(f"UNION ALL SELECT '{i}', {PCT(c)} FROM cls\n" for i, c in (
    ("pct_negatif", "sentiment = 'negatif'"), ("pct_neutre", "sentiment = 'neutre'"),
    ("pct_positif", "sentiment = 'positif'"), ("pct_urgent", "urgence = 'haute'"))) + """
UNION ALL SELECT * FROM (SELECT 'theme:' || topics, count(*)::double FROM cls GROUP BY topics
  ORDER BY count(*) DESC, topics LIMIT 5)""")

# --- chart tables ------------------------------------------------------------------------


def shares(src, col, extra=""):
    return (f"SELECT {col} AS label, count(*) AS n, round(count(*) * 100.0::double / "
            f"(SELECT count(*) FROM {src}), 2) AS pct FROM {src} WHERE {col} IS NOT NULL "
            f"GROUP BY {col} {extra}")


SQL["sentiment_share"] = with_(FEEDBACK, CLS, body=shares("cls", "sentiment"))
SQL["sentiment_buckets"] = with_(FEEDBACK, RAW, body=" UNION ALL ".join(
    f"SELECT '{k}' AS label, count(*) FILTER ({LT('sentiment')} IN {lst(ws)}) AS n, "
    f"round(count(*) FILTER ({LT('sentiment')} IN {lst(ws)}) * 100.0::double / count(*), 2) "
    f"AS pct FROM raw" for k, ws in (("negatif", L.NEGATIVE_WORDS), ("neutre", L.NEUTRAL_WORDS),
                                     ("positif", L.POSITIVE_WORDS))))
DATED = CLS + """,
dated AS (SELECT *, date_trunc('second', ts) AS t FROM cls WHERE msg_id % 101 <> 0)"""
SQL["daily_volume"] = with_(FEEDBACK, DATED, body="""
SELECT t::date AS day, 'all' AS sentiment, count(*) AS n FROM dated GROUP BY 1
UNION ALL SELECT t::date, sentiment, count(*) FROM dated GROUP BY 1, 2""")
SQL["activity_heatmap"] = with_(FEEDBACK, DATED, body="SELECT dayname(t) AS day, " + ", ".join(
    f"count(*) FILTER (hour(t) = {h}) AS h{h:02d}" for h in range(24))
    + " FROM dated GROUP BY 1")
SQL["top_themes"] = with_(FEEDBACK, ENR, body=shares(
    "enr", "theme", "ORDER BY n DESC, label LIMIT 10"))
SQL["incident_share"] = with_(FEEDBACK, CLS, body=shares("cls", "incident"))
SQL["incident_severity"] = with_(FEEDBACK, CLS, RAW, f"r AS ({rules('feedback')})", """
u AS (SELECT incident FROM raw UNION ALL SELECT incident FROM cls UNION ALL
  SELECT incident FROM r)""", "sev(k, name, severity) AS (VALUES " + ", ".join(
    f"({i}, {q(n)}, {q(s)})" for i, (n, s) in enumerate(L.INCIDENT_SEVERITY)) + ")", """
g AS (SELECT incident, count(*) AS n FROM u GROUP BY incident)""", body="""
SELECT incident, coalesce(
  (SELECT severity FROM sev WHERE name = lower(trim(incident))),
  (SELECT arg_min(severity, k) FROM sev WHERE contains(lower(trim(incident)), name)
     OR contains(name, lower(trim(incident)))), 'other') AS severity, n FROM g""")
SQL["category_satisfaction"] = with_(FEEDBACK, CLS, body="""
SELECT incident AS category, count(*) AS n, round((count(*) FILTER (sentiment = 'positif')
  - count(*) FILTER (sentiment = 'negatif'))::double / count(*) * 50 + 50, 4) AS satisfaction
FROM cls GROUP BY incident ORDER BY n DESC, incident LIMIT 6""")
SQL["urgency_levels"] = with_(FEEDBACK, RAW, body=f"""
SELECT level, count(u) AS n FROM (VALUES ('FAIBLE'), ('HAUTE'), ('MOYENNE')) v(level)
LEFT JOIN (SELECT {vocab(LT('urgence'), L.URGENCY_LEVELS, "'FAIBLE'")} AS u FROM raw)
  ON u = level GROUP BY level""")
SQL["priority_counts"] = with_(FEEDBACK, RAW, body=shares("raw", "urgence"))
SQL["topic_tokens_top10"] = with_(FEEDBACK, CLS, body="""
SELECT label, count(*) AS n FROM (SELECT unnest([topics, categorie, channel]) AS label FROM cls)
GROUP BY label ORDER BY n DESC, label LIMIT 10""")
SQL["confidence_histogram"] = with_(FEEDBACK, CLS, """lim AS (
  SELECT min(confidence) AS lo, max(confidence) AS hi FROM cls)""", body="""
SELECT least(20, floor((confidence - lo) / (hi - lo) * 20) + 1)::int AS bin, count(*) AS n
FROM cls, lim GROUP BY 1""")
SQL["time_ordered"] = with_(FEEDBACK, DATED, body="""
SELECT msg_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS time, confidence FROM dated""")
SQL["claim_split"] = with_(FEEDBACK, RAW, body=f"""
SELECT CASE WHEN c THEN 'claim' ELSE 'no claim' END AS label, count(*) AS n,
  round(count(*) * 100.0::double / (SELECT count(*) FROM raw), 2) AS pct
FROM (SELECT {TRUE} AS c FROM raw) GROUP BY c""")
SQL["detail_table"] = with_(FEEDBACK, CLS, body="""
SELECT text, sentiment, is_claim, urgence, topics, incident, confidence FROM cls""")
SQL["distinct_labels"] = with_(FEEDBACK, CLS, body="""
SELECT count(DISTINCT topics) AS topics_count, count(DISTINCT incident) AS incident_count
FROM cls""")
SQL["claims_by_topic"] = with_(FEEDBACK, CLS, body=f"""
SELECT topics AS topic, count(*) AS n, count(*) FILTER (is_claim = 'oui') AS claims,
  {PCT("is_claim = 'oui'")} AS claim_pct FROM cls GROUP BY topics
UNION ALL SELECT 'all', count(*), count(*) FILTER (is_claim = 'oui'), {PCT("is_claim = 'oui'")}
FROM cls""")
SQL["urgency_trend"] = with_(FEEDBACK, DATED, """d AS (SELECT t::date AS day, count(*) AS n,
  count(*) FILTER (urgence = 'haute') AS urgent FROM dated GROUP BY 1)""", body="""
SELECT day, n, urgent, round(urgent * 100.0::double / n, 4) AS urgent_pct,
  round(avg(urgent * 100.0::double / n) OVER (ORDER BY day ROWS 6 PRECEDING), 4) AS moving_pct
FROM d""")

# --- learning and evaluation -------------------------------------------------------------
SPLIT = """ranked AS (SELECT *, row_number() OVER (PARTITION BY sentiment
    ORDER BY md5('42|' || msg_id)) AS r, count(*) OVER (PARTITION BY sentiment) AS size FROM cls),
split AS (SELECT *, CASE WHEN r <= round(size * 0.7::double) THEN 'train'
  WHEN r <= round(size * (0.7::double + 0.15::double)) THEN 'validation' ELSE 'test' END AS split
  FROM ranked)"""
SQL["stratified_split"] = with_(FEEDBACK, CLS, SPLIT,
                                body="SELECT msg_id, sentiment, split FROM split")
SQL["dataset_statistics"] = with_(FEEDBACK, CLS, SPLIT, body=" UNION ALL ".join(
    [f"SELECT split, '{m}' AS measure, '' AS label, ({e})::double AS value FROM split "
     f"GROUP BY split" for m, e in (
         ("total_samples", "count(*)"), ("urgent", "count(*) FILTER (urgence = 'haute')"),
         ("needs_response", "count(*) FILTER (is_claim = 'oui')"),
         ("avg_text_length", "round(avg(length(text)), 4)"),
         ("unique_authors", "count(DISTINCT author)"))]
    + [f"SELECT split, '{c}_count', {c}, count(*)::double FROM split GROUP BY split, {c} "
       f"UNION ALL SELECT split, '{c}_pct', {c}, round(count(*) * 100.0::double / "
       f"sum(count(*)) OVER (PARTITION BY split), 4) FROM split GROUP BY split, {c}"
       for c in ("sentiment", "categorie", "urgence")]))
SQL["accuracy_by_target"] = """
WITH d AS (SELECT quality, toxic, (length(text) >= 200)::int AS qg,
  contains(text, '!')::int AS tg FROM documents JOIN labels USING (doc_id))
SELECT 'quality' AS target, count(*) AS n, round(avg((quality = qg)::int), 4) AS accuracy FROM d
UNION ALL SELECT 'toxic', count(*), round(avg((toxic = tg)::int), 4) FROM d"""
PRED = f"""sc AS (SELECT msg_id, channel, CASE reclamation WHEN 'OUI' THEN 'oui' ELSE 'non' END AS label,
  CASE WHEN coalesce(text, '') <> '' THEN claim_conf ELSE 0.0::double END AS score
  FROM ({scored('feedback')})),
pred AS (SELECT sc.*, a.is_claim AS rules, b.is_claim AS local, c.is_claim AS cloud,
  d.is_claim AS basic FROM sc JOIN ({rules('feedback')}) a USING (msg_id)
  JOIN ({fallback_local('feedback')}) b USING (msg_id)
  JOIN ({fallback_cloud('feedback')}) c USING (msg_id)
  JOIN ({fallback_basic('feedback')}) d USING (msg_id))"""
SQL["confusion_matrix"] = with_(FEEDBACK, PRED, body="""
SELECT label, count(*) FILTER (cloud = 'non') AS pred_non, count(*) FILTER (cloud = 'oui')
  AS pred_oui FROM pred GROUP BY label""")
SQL["precision_recall_f1"] = with_(FEEDBACK, PRED, """c AS (SELECT k AS class,
    count(*) FILTER (label = k AND rules = k) AS tp, count(*) FILTER (label = k) AS support,
    count(*) FILTER (rules = k) AS said FROM pred, (VALUES ('oui'), ('non')) v(k) GROUP BY k)""", """
m AS (SELECT class, tp::double / said AS p, tp::double / support AS r,
    2 * tp::double / (support + said) AS f, support FROM c)""", body="""
SELECT class, round(p, 4) AS "precision", round(r, 4) AS recall, round(f, 4) AS f1, support FROM m
UNION ALL SELECT 'macro', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4),
  sum(support)::bigint FROM m""")
SQL["classified_targets"] = with_(FEEDBACK, PRED, """t AS (
  SELECT count(*) FILTER (label = 'oui' AND cloud = 'oui')::double / count(*)
    FILTER (cloud = 'oui') AS p, count(cloud)::double / count(*) AS s FROM pred)""", body="""
SELECT round(p, 4) AS claim_precision, p > 0.85 AS precision_met, round(s, 4) AS classified_share,
  s > 0.9 AS share_met FROM t""")
SQL["pr_roc_points"] = with_(FEEDBACK, PRED, """s AS (SELECT DISTINCT round(score, 6) AS step
  FROM pred)""", """p AS (SELECT step,
  count(*) FILTER (round(score, 6) >= step AND rules = 'oui') AS tp,
  count(*) FILTER (round(score, 6) >= step AND rules = 'non') AS fp,
  count(*) FILTER (rules = 'oui') AS pos, count(*) FILTER (rules = 'non') AS neg
  FROM s, pred GROUP BY step)""", body="""
SELECT step AS threshold, tp, fp, round(tp::double / (tp + fp), 4) AS "precision",
  round(tp::double / pos, 4) AS recall, round(fp::double / neg, 4) AS fpr FROM p""")
SQL["cohen_kappa"] = with_(FEEDBACK, PRED, """l AS (UNPIVOT (SELECT msg_id, rules, local, cloud,
  basic FROM pred) ON rules, local, cloud, basic INTO NAME a VALUE v)""", """
k AS (SELECT x.a AS first, y.a AS second, count(*) AS items,
  avg((x.v = y.v)::int) AS po, avg((x.v = 'oui')::int) AS px, avg((y.v = 'oui')::int) AS py
  FROM l x JOIN l y ON x.msg_id = y.msg_id AND x.a < y.a GROUP BY 1, 2)""", """
e AS (SELECT *, px * py + (1 - px) * (1 - py) AS pe FROM k)""", body="""
SELECT first, second, items, round(po, 4) AS observed, round(pe, 4) AS expected,
  round((po - pe) / (1 - pe), 4) AS kappa, (po - pe) / (1 - pe) >= 0.7 AS accepted FROM e""")
SQL["fairness_gap"] = with_(FEEDBACK, PRED, """g AS (SELECT channel,
  avg((cloud = 'oui')::int) AS pr,
  avg((cloud = 'oui')::int) FILTER (label = 'oui') AS tpr,
  avg((cloud = 'oui')::int) FILTER (label = 'non') AS fpr FROM pred GROUP BY channel)""", body="""
SELECT count(*) AS groups, round(max(pr) - min(pr), 4) AS parity_gap,
  round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 4) AS odds_gap,
  round(var_pop(pr), 6) AS variance, max(pr) - min(pr) <= 0.25 AS gap_ok,
  var_pop(pr) <= 0.05 AS variance_ok FROM g""")
SQL["latency_summary"] = with_(FEEDBACK, """r AS (SELECT latency_ms AS v,
  row_number() OVER (ORDER BY latency_ms) - 1 AS i, count(*) OVER () AS n FROM feedback
  WHERE latency_ms IS NOT NULL)""", body="""
SELECT max(n) AS n, round(avg(v), 4) AS mean,
  round(max(v) FILTER (i = greatest(0, floor(n * 0.95::double) - 1)), 4) AS p95,
  avg(v) <= 850 AND max(v) FILTER (i = greatest(0, floor(n * 0.95::double) - 1)) <= 1500 AS within
FROM r""")
SQL["compare_models"] = with_(FEEDBACK, PRED, """l AS (UNPIVOT (SELECT label, rules, local, cloud,
  basic FROM pred) ON rules, local, cloud, basic INTO NAME model VALUE v)""", """
m AS (SELECT model, avg((label = v)::int) AS accuracy,
  count(*) FILTER (label = 'oui' AND v = 'oui')::double / count(*) FILTER (v = 'oui') AS prec,
  count(*) FILTER (label = 'oui' AND v = 'oui')::double / count(*) FILTER (label = 'oui')
    AS recall,
  2 * count(*) FILTER (label = 'oui' AND v = 'oui')::double / (count(*) FILTER (v = 'oui')
    + count(*) FILTER (label = 'oui')) AS f1 FROM l GROUP BY model)""", """
u AS (SELECT model, 'accuracy' AS metric, round(accuracy, 4) AS value FROM m UNION ALL
  SELECT model, 'precision', round(prec, 4) FROM m UNION ALL
  SELECT model, 'recall', round(recall, 4) FROM m UNION ALL
  SELECT model, 'f1', round(f1, 4) FROM m)""", body="""
SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, model) = 1 AS is_best
FROM u""")

# --- streams -----------------------------------------------------------------------------
SQL["stream_classify"] = with_(FEEDBACK, body=f"""
SELECT msg_id, {LABELS} FROM ({fallback_cloud('feedback')})""")
SQL["stream_dedup"] = with_(FEEDBACK, body="""
SELECT DISTINCT md5(text) AS text_md5 FROM feedback WHERE text IS NOT NULL""")
COUNTS = """count(*) AS n, count(*) FILTER (is_claim = 'oui') AS claims,
  count(*) FILTER (sentiment = 'negatif') AS negative,
  count(*) FILTER (is_claim = 'oui' AND urgence = 'haute') AS urgent"""
SQL["stream_kpi_windows"] = with_(FEEDBACK, CLS, body=f"""
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY
  AS window_end, {COUNTS} FROM cls GROUP BY 1, 2""")
SQL["stream_kpi_sliding"] = with_(FEEDBACK, CLS, """w AS (SELECT *,
  time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - back * INTERVAL 2 HOUR AS s
  FROM cls, (VALUES (0), (1), (2)) b(back))""", body=f"""
SELECT s AS window_start, s + INTERVAL 6 HOUR AS window_end, {COUNTS} FROM w GROUP BY 1, 2""")
SQL["stream_sessions"] = with_(FEEDBACK, """g AS (SELECT author, ts,
  CASE WHEN ts <= lag(ts) OVER (PARTITION BY author ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END
    AS first FROM feedback)""", """
n AS (SELECT *, sum(first) OVER (PARTITION BY author ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k
  FROM g)""", body=f"""
SELECT author, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS n
FROM n GROUP BY author, k""")
SQL["stream_alerts"] = with_(FEEDBACK, CLS, body="""
SELECT msg_id, author, incident FROM cls WHERE is_claim = 'oui' AND urgence = 'haute'""")
SQL["stream_alert_windows"] = with_(FEEDBACK, CLS, body=f"""
SELECT date_trunc('hour', ts) AS window_start, count(*) AS n,
  count(*) FILTER (is_claim = 'oui' AND urgence = 'haute') AS urgent FROM cls GROUP BY 1
HAVING urgent >= 3""")
