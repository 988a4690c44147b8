"""Building blocks of the checking SQL. Term lists come from the same data; the logic is written
by hand in SQL."""

from echolens.functions import lexicon as L
from echolens.sources.tables import FEEDBACK_TEMPLATES, WORLD_TEMPLATES

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
S = r"[\t-\r\x1C-\x20\x{85}\p{Z}]"
NS = r"[^\t-\r\x1C-\x20\x{85}\p{Z}]"


def q(s):
    return "'" + str(s).replace("'", "''") + "'"


def lst(values):
    return "(" + ", ".join(q(v) for v in values) + ")"


def arr(values):
    return "[" + ", ".join(q(v) for v in values) + "]"


def any_(col, terms):
    return "(" + " OR ".join(f"contains({col}, {q(t)})" for t in terms) + ")"


def cnt(col, terms):
    return "(" + " + ".join(f"contains({col}, {q(t)})::int" for t in terms) + ")"


def cascade(col, rules, default):
    """CASE over (label, terms); the default is SQL."""
    return ("CASE " + " ".join(f"WHEN {any_(col, ts)} THEN {q(label)}" for label, ts in rules)
            + f" ELSE {default} END")


def vocab(col, groups, default):
    return ("CASE " + " ".join(f"WHEN {col} IN {lst(ws)} THEN {q(to)}"
                               for to, ws in groups.items()) + f" ELSE {default} END")


FEEDBACK = ("templates(tid, tmpl) AS (VALUES " + ", ".join(
    f"({i}, {q(t)})" for i, t in enumerate(FEEDBACK_TEMPLATES)) + """),
feedback AS (
  SELECT event_id AS msg_id, 'user_' || user_id AS author, ts, event_type AS channel,
         value AS latency_ms,
         CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 3 = 0 THEN tmpl
              ELSE tmpl || ' [' || event_type || ' ' || user_id || ']' END AS text
  FROM events JOIN templates ON event_id % 16 = tid)""")

ALL_TEXTS = FEEDBACK + """,
texts AS (SELECT 'f' AS kind, msg_id AS id, text FROM feedback
  UNION ALL SELECT 'd', doc_id, text FROM documents
  UNION ALL SELECT 'p', page_id, html FROM pages)"""

WORLD = ("wt(tid, tmpl) AS (VALUES " + ", ".join(
    f"({i}, {q(t)})" for i, t in enumerate(WORLD_TEMPLATES)) + """),
world AS (SELECT event_id AS msg_id, CASE WHEN event_id % 97 <> 0
    THEN tmpl || ' ' || event_type || ' 👤' || user_id END AS text
  FROM events JOIN wt ON event_id % 8 = tid)""")


def with_(*ctes, body):
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --- cleaning ----------------------------------------------------------------------------

def strip_urls(c):
    return f"regexp_replace({c}, '(http|www){NS}+', '', 'g')"


def strip_urls_dotted(c):
    return f"regexp_replace({c}, '(?i)(http{NS}+|www\\.{NS}+)', '', 'g')"


def strip_mentions(c):
    return f"regexp_replace({c}, '@{W}+', '', 'g')"


def unwrap_hashtags(c):
    return f"regexp_replace({c}, '#({W}+)', '\\1', 'g')"


def collapse(c):
    return f"trim(regexp_replace({c}, '{S}+', ' ', 'g'))"


def strip_special(c):
    return rf"regexp_replace({c}, '[^\p{{L}}\p{{N}}_\t-\r\x1C-\x20\x{{85}}\p{{Z}}\-.,!?]', '', 'g')"


def emoji(c):
    """Keycaps by replacement, then sequences by a list of matches around the text between them."""
    from echolens.functions.emoji import REGIONAL, TONES, sequence_names
    from echolens.functions.text import NAMED_SYMBOLS, emoji_names
    single = emoji_names()
    names = {**single, **sequence_names()}
    symbols = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in NAMED_SYMBOLS)
    unit = rf"[{symbols}][\x{{FE0F}}\x{{1F3FB}}-\x{{1F3FF}}]*[\x{{E0020}}-\x{{E007F}}]*"
    pieces = (rf"[\x{{1F1E6}}-\x{{1F1FF}}][\x{{1F1E6}}-\x{{1F1FF}}]|{unit}(?:\x{{200D}}{unit})*"
              rf"|[^{symbols}\x{{1F1E6}}-\x{{1F1FF}}]+|[\x{{1F1E6}}-\x{{1F1FF}}]")
    look = lambda table, k: f"map({arr(table)}, {arr(table.values())})[{k}]"
    key = r"regexp_replace(p, '[\x{FE0F}\x{1F3FB}-\x{1F3FF}]', '', 'g')"
    tones = " || ".join(f"CASE WHEN contains(p, '{t}') THEN '_{n}' ELSE '' END"
                        for t, n in TONES.items())
    parts = (f"array_to_string(list_transform(string_split(p, ''), lambda ch: coalesce("
             f"' ' || {look(single, 'ch')} || ' ', ch)), '')")
    keycaps = rf"regexp_replace({c}, '([0-9#*])\x{{FE0F}}?\x{{20E3}}', ' keycap_\1 ', 'g')"
    return (f"array_to_string(list_transform(regexp_extract_all({keycaps}, '{pieces}'), "
            f"lambda p: CASE WHEN {look(names, key)} IS NOT NULL "
            f"THEN ' ' || {look(names, key)} || {tones} || ' ' "
            f"WHEN regexp_full_match(p, '[{REGIONAL}][{REGIONAL}]') "
            f"THEN ' flag_' || translate(p, '{REGIONAL}', 'abcdefghijklmnopqrstuvwxyz') || ' ' "
            f"ELSE {parts} END), '')")


def ascii_(c):
    """One replacement per letter of several characters, one translation for the others."""
    from echolens.functions.text import ASCII_SPECIALS, ascii_letters, script_spellings
    m = dict(ascii_letters())
    for a, b in script_spellings().items():
        if len(b) == 1:
            m[a] = b
        else:
            c = f"replace({c}, {q(a)}, {q(b)})"
    c = f"translate({c}, {q(''.join(m))}, {q(''.join(m.values()))})"
    for a, b in ASCII_SPECIALS.items():
        c = f"replace({c}, {q(a)}, {q(b)})"
    return rf"regexp_replace({c}, '[^\x00-\x7F]+', '', 'g')"


def preprocess(c):
    return collapse(strip_special(unwrap_hashtags(strip_mentions(strip_urls_dotted(
        f"lower(coalesce({c}, ''))")))))


def cleaned(src, text="text", out="text_cleaned"):
    """CTE bodies adding the cleaned text to ``src``."""
    core = collapse(ascii_(emoji(strip_mentions(strip_urls(f"lower(coalesce({text}, ''))")))))
    lost = ", ".join(
        f"CASE WHEN contains(lower({text}), {q(t)}) AND NOT contains(_c, {q(t)}) "
        f"THEN {q(t.replace(' ', '_'))} END" for t in sorted(L.DOMAIN_TERMS))
    return (f"SELECT * EXCLUDE (_c), CASE WHEN _c = '' THEN _c ELSE concat_ws(' ', _c, {lost}) "
            f"END AS {out} FROM (SELECT *, {core} AS _c FROM {src})")


# --- classifiers -------------------------------------------------------------------------

def word(col, words):
    return f"regexp_matches({col}, '(^|{NW})({'|'.join(words)})($|{NW})')".replace(
        "n'a", "n''a")


def rules(src, text="text"):
    dur = "|".join(f"{p} \\p{{Nd}}+ {u}" for p, u in L.URGENCY_HIGH_DURATIONS)
    inc = " ".join(f"WHEN {word('t', ws)} THEN {q(k)}" for k, ws in L.INCIDENT_WORDS)
    return f"""SELECT * EXCLUDE (t, f, m, b),
  CASE WHEN f > m AND f > b THEN 'fibre' WHEN m > b THEN 'mobile' WHEN b > 0 THEN 'facture'
       ELSE 'autre' END AS topics
FROM (SELECT *, CASE WHEN {any_('t', L.CLAIM_TERMS)} THEN 'oui' ELSE 'non' END AS is_claim,
  CASE WHEN {any_('t', L.URGENCY_HIGH_TERMS)} OR regexp_matches(t, '{dur}') THEN 'haute'
       WHEN {any_('t', L.URGENCY_MEDIUM_TERMS)} THEN 'moyenne' ELSE 'basse' END AS urgence,
  CASE {inc} ELSE 'aucun' END AS incident,
  {cnt('t', L.TOPIC_FIBRE_TERMS)} AS f, {cnt('t', L.TOPIC_MOBILE_TERMS)} AS m,
  {cnt('t', L.TOPIC_INVOICE_TERMS)} AS b
  FROM (SELECT *, lower(coalesce({text}, '')) AS t FROM {src}))"""


def scored(src, text="text"):
    return f"""SELECT * EXCLUDE (c, p, n, raw),
  CASE WHEN raw = '' THEN 0.0::double ELSE CAST(printf('%.2f',
    sent_conf * 0.25::double + claim_conf * 0.40::double + theme_conf * 0.35::double) AS DOUBLE)
    END AS confiance,
  CASE WHEN type_incident IN ('PANNE', 'LENTEUR') THEN 'TECHNIQUE'
       WHEN theme = 'FACTURE' OR type_incident = 'FACTURATION' THEN 'COMMERCIAL'
       WHEN theme = 'RESEAU' THEN 'RESEAU' ELSE 'AUTRE' END AS responsable
FROM (SELECT *, CASE WHEN theme = 'AUTRE' THEN 0.5::double ELSE 0.7::double END AS theme_conf,
  CASE WHEN {any_('c', L.SCORED_OUTAGE)} THEN 'PANNE' WHEN {any_('c', L.SCORED_SLOW)}
       THEN 'LENTEUR' WHEN theme = 'FACTURE' OR contains(c, 'factur') THEN 'FACTURATION'
       WHEN {any_('c', L.SCORED_SUPPORT)} THEN 'PROCESSUS_SAV'
       WHEN contains(raw, '?') THEN 'INFO' ELSE 'AUTRE' END AS type_incident
FROM (SELECT *, CASE WHEN claim_conf > 0.4::double THEN 'OUI' ELSE 'NON' END AS reclamation,
  CASE WHEN NOT claim_conf > 0.4::double THEN 'FAIBLE'
       ELSE {cascade('c', L.SCORED_URGENCY, "'MOYENNE'")} END AS urgence,
  {cascade('c', L.SCORED_THEME, "'AUTRE'")} AS theme
FROM (SELECT *, CASE WHEN c = '' THEN 0.0::double ELSE least(1.0::double,
    least({cnt('c', L.SCORED_CLAIM)} * 0.3::double, 0.6::double)
    + CASE WHEN sentiment = 'NEGATIF' THEN 0.3::double ELSE 0.0::double END
    + CASE WHEN contains(raw, '?') OR {any_('c', L.SCORED_QUESTION)} THEN 0.15::double
           ELSE 0.0::double END
    + CASE WHEN {any_('c', L.SCORED_ACTION)} THEN 0.2::double ELSE 0.0::double END) END
    AS claim_conf
FROM (SELECT *, CASE WHEN p > n THEN 'POSITIF' WHEN n > p THEN 'NEGATIF' ELSE 'NEUTRE' END
    AS sentiment, CASE WHEN c = '' THEN 0.0::double WHEN p <> n THEN 0.6::double
    ELSE 0.5::double END AS sent_conf
FROM (SELECT *, {cnt('c', L.SCORED_POSITIVE)} AS p, {cnt('c', L.SCORED_NEGATIVE)} AS n
FROM (SELECT *, coalesce({text}, '') AS raw, {preprocess(text)} AS c FROM {src}))))))"""


def fallback_local(src, text="text"):
    return f"""SELECT * EXCLUDE (t), categorie AS topics,
  CASE WHEN sentiment = 'neutre' AND categorie = 'autre' THEN 0.5::double ELSE 0.75::double END
    AS score_confiance,
  CASE WHEN {any_('t', L.LOCAL_URGENT)} THEN 'haute' WHEN is_claim = 'oui' THEN 'moyenne'
       ELSE 'faible' END AS urgence,
  {cascade('t', L.LOCAL_INCIDENTS, "CASE WHEN is_claim = 'non' THEN 'aucun' ELSE 'non_specifie' END")}
    AS incident
FROM (SELECT *, CASE WHEN sentiment = 'negatif' OR contains(t, 'panne') THEN 'oui' ELSE 'non' END
    AS is_claim
FROM (SELECT *, {cascade('t', [('positif', L.LOCAL_POSITIVE), ('negatif', L.LOCAL_NEGATIVE)],
                         "'neutre'")} AS sentiment,
  {cascade('t', L.LOCAL_CATEGORIES, "'autre'")} AS categorie
FROM (SELECT *, lower(coalesce({text}, '')) AS t FROM {src})))"""


def fallback_cloud(src, text="text"):
    c = L.CLOUD_CATEGORIES
    return f"""SELECT * EXCLUDE (t, p, n, a, b, d, e, urg, base),
  CASE WHEN is_claim = 'non' THEN 'faible' WHEN urg THEN 'haute' ELSE 'moyenne' END AS urgence,
  CASE WHEN is_claim = 'non' THEN 'aucun' ELSE {cascade('t', L.CLOUD_INCIDENTS,
                                                        "'non_specifie'")} END AS incident,
  {cascade('t', L.CLOUD_TOPICS, "CASE categorie WHEN 'service' THEN 'service_client' WHEN 'support' THEN 'support_technique' ELSE categorie END")}
    AS topics,
  CAST(printf('%.2f', greatest(0.5::double, least(0.95::double, base
    + CASE WHEN categorie <> 'autre' THEN 0.10::double ELSE 0.0::double END
    + CASE WHEN is_claim = 'oui' AND urg THEN 0.05::double ELSE 0.0::double END))) AS DOUBLE)
    AS score_confiance
FROM (SELECT *, CASE WHEN sentiment = 'negatif' OR {any_('t', L.CLOUD_CLAIM)} THEN 'oui'
    ELSE 'non' END AS is_claim
FROM (SELECT *, CASE WHEN p > n THEN 'positif' WHEN n > 0 THEN 'negatif' ELSE 'neutre' END
    AS sentiment,
  CASE WHEN p > n THEN least(0.75::double + p * 0.05::double, 0.95::double)
       WHEN n > 0 THEN least(0.75::double + n * 0.05::double, 0.95::double)
       ELSE 0.60::double END AS base,
  CASE WHEN greatest(a, b, d, e) = 0 THEN 'autre' WHEN a >= b AND a >= d AND a >= e THEN 'produit'
       WHEN b >= d AND b >= e THEN 'service' WHEN d >= e THEN 'support' ELSE 'promotion' END
    AS categorie
FROM (SELECT *, {cnt('t', L.CLOUD_POSITIVE)} AS p, {cnt('t', L.CLOUD_NEGATIVE)} AS n,
  {cnt('t', c[0][1])} AS a, {cnt('t', c[1][1])} AS b, {cnt('t', c[2][1])} AS d,
  {cnt('t', c[3][1])} AS e, {any_('t', L.CLOUD_URGENT)} AS urg
FROM (SELECT *, lower(coalesce({text}, '')) AS t FROM {src}))))"""


def fallback_basic(src, text="text"):
    return f"""SELECT * EXCLUDE (t), 0.75::double AS confidence,
  {cascade('t', [('positif', L.BASIC_POSITIVE), ('negatif', L.BASIC_NEGATIVE)], "'neutre'")}
    AS sentiment,
  CASE WHEN {any_('t', L.BASIC_URGENT)} THEN 'haute' WHEN is_claim = 'oui' THEN 'moyenne'
       ELSE 'faible' END AS urgence,
  {cascade('t', L.BASIC_TOPICS, "'autre'")} AS topics,
  {cascade('t', L.BASIC_INCIDENTS, "'autre'")} AS incident
FROM (SELECT *, CASE WHEN {any_('t', L.BASIC_CLAIM)} THEN 'oui' ELSE 'non' END AS is_claim
FROM (SELECT *, lower(coalesce({text}, '')) AS t FROM {src}))"""


def calibrated(src, text, sentiment="sentiment", confidence="confidence"):
    neg = any_(f"lower(coalesce({text}, ''))", L.CALIBRATION_NEGATIVE)
    pos = any_(f"lower(coalesce({text}, ''))", L.CALIBRATION_POSITIVE)
    return f"""SELECT * REPLACE (
  CASE WHEN {neg} THEN 'negatif' WHEN {sentiment} = 'neutre' AND {pos} THEN 'positif'
       ELSE {sentiment} END AS {sentiment},
  greatest(0.4::double, least(0.99::double, CASE WHEN {neg} THEN greatest({confidence}, 0.75::double)
       WHEN {sentiment} = 'neutre' AND {pos} THEN greatest({confidence}, 0.70::double)
       ELSE {confidence} END)) AS {confidence}) FROM {src}"""


def guard_steps(src, text, local, label="g"):
    """Chained CTEs g1..g5 for the quality guards; the last one is ``<label>``."""
    t = f"lower(coalesce({text}, ''))"
    claim = L.GUARD_LOCAL_CLAIM if local else L.GUARD_CLOUD_CLAIM
    urgent = L.GUARD_LOCAL_URGENT if local else L.GUARD_CLOUD_URGENT
    up = lambda c: (f"CASE WHEN {c} AND urgence = 'faible' THEN 'moyenne' ELSE urgence END "
                    f"AS urgence, CASE WHEN {c} THEN 'oui' ELSE is_claim END AS is_claim")
    open_ = "incident IN ('aucun', 'non_specifie')"
    n = label
    out = [f"{n}1 AS (SELECT * REPLACE ({up("sentiment = 'negatif'")}) "
           f"FROM {src})",
           f"{n}2 AS (SELECT * REPLACE ({up(any_(t, claim))}) FROM {n}1)",
           f"{n}3 AS (SELECT * REPLACE (CASE WHEN {any_(t, urgent)} THEN 'haute' ELSE urgence "
           f"END AS urgence, CASE WHEN {any_(t, urgent)} THEN 'oui' ELSE is_claim END "
           f"AS is_claim) FROM {n}2)"]
    clamp = ("greatest(0.4::double, least(0.99::double, score_confiance)) AS score_confiance")
    if local:
        net = any_(t, [*L.MOBILE_TERMS, "connexion", "wifi"])
        out += [
            f"{n}4 AS (SELECT * REPLACE (CASE WHEN {any_(t, L.BILLING_TERMS)} THEN 'facture' "
            f"ELSE topics END AS topics, CASE WHEN {any_(t, L.BILLING_TERMS)} THEN "
            f"'probleme_facturation' ELSE incident END AS incident) FROM {n}3)",
            f"{n}5 AS (SELECT * REPLACE (CASE WHEN {net} THEN 'reseau' ELSE topics END AS topics, "
            f"CASE WHEN {net} AND {open_} THEN 'panne_connexion' ELSE incident END AS incident) "
            f"FROM {n}4)",
            f"{n} AS (SELECT * REPLACE (CASE WHEN {any_(t, L.SERVICE_TERMS)} THEN "
            f"'service_client' ELSE topics END AS topics, CASE WHEN incident = 'aucun' AND "
            f"is_claim = 'oui' AND contains({t}, 'box') THEN 'bug_freebox' ELSE incident END "
            f"AS incident, {clamp}) FROM {n}5)"]
    else:
        fib, box = any_(t, ["fibre", "fiber"]), f"contains({t}, 'box')"
        bill, mob = any_(t, L.BILLING_TERMS), any_(t, L.MOBILE_TERMS)
        out += [
            f"{n}4 AS (SELECT * REPLACE (CASE WHEN {fib} THEN 'fibre' WHEN {box} THEN 'freebox' "
            f"WHEN {bill} THEN 'facture' WHEN {mob} THEN 'mobile' WHEN "
            f"{any_(t, L.SERVICE_TERMS)} THEN 'service_client' ELSE topics END AS topics, "
            f"CASE WHEN {fib} OR {box} THEN incident WHEN {bill} THEN CASE WHEN {open_} THEN "
            f"'probleme_facturation' ELSE incident END WHEN {mob} AND {open_} THEN "
            f"'probleme_mobile' ELSE incident END AS incident) FROM {n}3)",
            f"{n} AS (SELECT * REPLACE (CASE WHEN incident = 'aucun' AND is_claim = 'oui' THEN "
            f"CASE WHEN {any_(t, ['connexion', 'reseau', 'wifi'])} THEN 'panne_connexion' WHEN "
            f"{box} THEN 'bug_freebox' ELSE incident END ELSE incident END AS incident, {clamp}) "
            f"FROM {n}4)"]
    return ",\n".join(out)


def consistency(src, text, label="k"):
    t = f"lower(coalesce({text}, ''))"
    n = label
    full = f"coalesce({text}, '') <> ''"
    bill, mob, box = any_(t, L.BILLING_TERMS), any_(t, L.MOBILE_TERMS), f"contains({t}, 'box')"
    return f"""{n}1 AS (SELECT * REPLACE (CASE WHEN lower(is_claim) IN ('1', 'true', 'yes', 'oui')
  THEN 'oui' ELSE 'non' END AS is_claim) FROM {src}),
{n}2 AS (SELECT * REPLACE (CASE WHEN {full} AND (sentiment = 'negatif' OR
  {any_(t, L.CONSISTENCY_CLAIM)}) THEN 'oui' ELSE is_claim END AS is_claim) FROM {n}1),
{n}3 AS (SELECT * REPLACE (CASE WHEN {full} AND {any_(t, L.CONSISTENCY_URGENT)} THEN 'haute'
  WHEN {full} AND is_claim = 'oui' AND urgence = 'faible' THEN 'moyenne' ELSE urgence END
  AS urgence) FROM {n}2),
{n} AS (SELECT * REPLACE (
  CASE WHEN {full} AND lower(incident) IN ('aucun', 'non_specifie', 'non', '') THEN
    CASE WHEN {bill} THEN 'probleme_facturation'
         WHEN {any_(t, L.CONSISTENCY_NETWORK)} THEN 'panne_connexion'
         WHEN {box} THEN 'bug_freebox' WHEN {mob} THEN 'probleme_mobile'
         WHEN is_claim = 'oui' THEN 'non_specifie' ELSE 'aucun' END
    ELSE incident END AS incident,
  CASE WHEN {full} AND topics = 'autre' THEN
    CASE WHEN contains({t}, 'fibre') THEN 'fibre' WHEN {box} THEN 'freebox' WHEN {mob}
         THEN 'mobile' WHEN {bill} THEN 'facture' WHEN {any_(t, L.SERVICE_TERMS)}
         THEN 'service_client' ELSE topics END
    ELSE topics END AS topics,
  greatest(0.4::double, least(0.99::double, confidence)) AS confidence) FROM {n}3)"""
