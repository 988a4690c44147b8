import itertools

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echolens.functions import text as T
from echolens.functions.match import Hits, any_term, count_terms, largest, minimal_terms, \
    round_half_even, term_index
from echolens.operators.quality import clean_dataset, clean_flagged, cleaning_stats, \
    validate_text


def one(spark, column, value):
    df = spark.createDataFrame([(value,)], "text string")
    return df.select(column(F.col("text"))).first()[0]


def cleaned(spark, value, **options):
    df = spark.createDataFrame([(value,)], "text string")
    return T.clean_messages(df, options=T.CleanOptions(**options)).first()["text_cleaned"]


def test_clean_sample(spark):
    assert cleaned(spark, "@Free Bonjour! Ma #fibre ne marche pas http://example.com 😞") == \
        "bonjour! ma #fibre ne marche pas disappointed_face free"


def test_clean_options(spark):
    assert cleaned(spark, "Le Réseau #lent", remove_hashtags=True, lowercase=False,
                   normalize_unicode=False, preserve_domain_terms=False) == "Le Réseau"
    assert cleaned(spark, "le réseau est lent", extra_stopwords=("LE", "est")) == \
        "reseau lent réseau"
    assert cleaned(spark, None) == ""
    assert cleaned(spark, "@only_a_mention") == ""


def test_domain_terms_sorted_and_joined(spark):
    assert cleaned(spark, "@service client réclamation débit facture") == \
        "client reclamation debit facture débit réclamation service_client"


def test_urls_need_no_dot_in_first_cleaner(spark):
    assert one(spark, T.strip_urls, "wwwx a http://b c") == " a  c"
    assert one(spark, T.strip_urls_dotted, "wwwx WWW.a HTTP://b c") == "wwwx   c"


def test_unicode_words(spark):
    assert one(spark, T.strip_mentions, "@éric_2 ok") == " ok"
    assert one(spark, T.unwrap_hashtags, "#Été!") == "Été!"
    assert one(spark, T.collapse_spaces, " a \t b c ") == "a b c"
    assert one(spark, T.strip_special, "ça; <b>l'été</b> (1-2)!") == "ça blétéb 1-2!"


def test_ascii(spark):
    assert one(spark, T.to_ascii, "Œuvre à 3€ – l’été… ß ça «x» 漢") == \
        "OEuvre a 3EUR - l'ete... ss ca <<x>> "


def test_emoji(spark):
    assert one(spark, T.emoji_to_text, "ok👍👍!") == "ok thumbs_up  thumbs_up !"
    assert one(spark, T.strip_emojis, "a😀🚀b") == "ab"


def test_emoji_sequences(spark):
    names = {"🇫🇷": "France", "🇿🇼": "flag_zw", "1️⃣": "keycap_1", "#⃣": "keycap_#", "❤️": "red_heart",
             "👍🏽": "thumbs_up_medium_skin_tone", "👩‍💻": "woman_technologist",
             "🧑🏿‍🚀": "astronaut_dark_skin_tone", "🤷🏻‍♂️": "man_shrugging_light_skin_tone",
             "👨‍👩‍👧‍👦": "family_man_woman_girl_boy", "👩‍❤️‍💋‍👨": "kiss_woman_man",
             "🏳️‍🌈": "rainbow_flag", "🏴󠁧󠁢󠁳󠁣󠁴󠁿": "Scotland"}
    for sequence, name in names.items():
        assert one(spark, T.emoji_to_text, f"a{sequence}b") == f"a {name} b", sequence
    # a sequence no table knows is named part by part; what is no emoji stays
    assert one(spark, T.emoji_to_text, "📱‍🐛") == " mobile_phone ‍ bug "
    assert one(spark, T.emoji_to_text, "🏽 🇫 10 #1 *") == "🏽 🇫 10 #1 *"
    assert one(spark, T.emoji_to_text, "🇫🇷🇧🇪🇫") == " France  Belgium 🇫"
    assert one(spark, T.emoji_to_text, "") == "" and one(spark, T.emoji_to_text, None) is None
    # thousands of joined parts, and a long text between two emojis
    assert one(spark, T.emoji_to_text, "👤‍" * 20_000).count("bust_in_silhouette") == 20_000
    assert one(spark, T.emoji_to_text, "👍" + "é" * 200_000 + "👎") == \
        " thumbs_up " + "é" * 200_000 + " thumbs_down "


def test_other_scripts(spark):
    assert one(spark, T.to_ascii, "Щука, Ёж и объём") == "Shchuka, Iozh i ob'iom"
    assert one(spark, T.to_ascii, "Θεός ΨΥΧΗ ᾄδω ΐ") == "Theos PsUKhE ado i"
    letters = [c for c in map(chr, [*range(0x386, 0x3CF), *range(0x400, 0x460)]) if c.isalpha()]
    rows = spark.createDataFrame([(c,) for c in letters], "text string")
    assert all(r[0] for r in rows.select(T.to_ascii(F.col("text"))).collect())


def test_preprocess_keeps_accents_and_removes_markup(spark):
    assert one(spark, T.preprocess_text, "@Free Ma #fibre bug depuis hier! http://x.y") == \
        "ma fibre bug depuis hier!"
    for payload in ("<script>alert('x')</script>", "'; DROP TABLE t; --", "{{7*7}}", "a\"b;c"):
        assert not set(one(spark, T.preprocess_text, payload)) & set("<>;'\"")


def test_language(spark):
    assert one(spark, T.detect_language, "le chat est dans la maison") == "fr"
    assert one(spark, T.detect_language, "the cat is in the house") == "en"
    assert one(spark, T.detect_language, "xyz 123") == "unknown"


def test_term_helpers(spark):
    df = spark.createDataFrame([("freebox fibre",), (None,)], "t string")
    got = df.select(any_term(F.col("t"), ["box"]),
                    count_terms(F.col("t"), ["box", "freebox", "box"])).collect()
    assert [tuple(r) for r in got][0] == (True, 3)
    assert minimal_terms(["ça ne marche pas", "ne marche pas", "nul", "nul"]) == \
        ["ne marche pas", "nul"]
    counts = [("a", F.lit(1)), ("b", F.lit(2)), ("c", F.lit(2))]
    assert spark.range(1).select(largest(counts, "none")).first()[0] == "b"
    assert spark.range(1).select(largest([("a", F.lit(0))], "none")).first()[0] == "none"


def test_rounding_matches_binary_half_even(spark):
    claims = sorted({min(a + b + c + d, 1.0) for a, b, c, d in itertools.product(
        (0.0, 0.3, 0.6), (0.0, 0.3), (0.0, 0.15), (0.0, 0.2))})
    values = [s * 0.25 + k * 0.40 + t * 0.35
              for s in (0.0, 0.5, 0.6) for k in claims for t in (0.5, 0.7)]
    values += [0.125, 0.575, 2.675, 0.8500000000000001]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, r in df.select("v", round_half_even(F.col("v"), 2)).collect():
        assert r == round(v, 2), v


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=60), min_size=1, max_size=20))
def test_cleaning_is_stable(spark, texts):
    """Preprocessing twice changes nothing once markers are gone; cleaned text is ASCII except
    for domain terms, trimmed, with single spaces."""
    df = spark.createDataFrame([(t.replace("\x00", ""),) for t in texts], "text string")
    out = T.clean_messages(df, options=T.CleanOptions(preserve_domain_terms=False))
    for (c,) in out.select("text_cleaned").collect():
        assert c.isascii() and c == c.strip() and "  " not in c


def test_validate_text(spark):
    data = [None, "", "  ab ", " abc ", "x" * 1001]
    df = spark.createDataFrame([(t,) for t in data], "text string")
    got = df.select(F.inline(F.array(validate_text(F.col("text"))))).collect()
    assert [tuple(r) for r in got] == [
        (False, "invalid text", None), (False, "invalid text", None), (False, "too short", None),
        (True, None, "abc"), (False, "too long", None)]


def test_clean_dataset_and_stats(spark, rows):
    df = rows(["Bonjour à tous", None, "Bonjour à tous", "@x", "  ", None, "ok merci"])
    kept = clean_dataset(df).orderBy("msg_id").collect()
    assert [(r.msg_id, r.text_cleaned) for r in kept] == [(0, "bonjour a tous"), (6, "ok merci")]
    s = cleaning_stats(clean_flagged(df)).first()
    assert (s.total_original, s.empty_texts, s.duplicates_removed, s.total_cleaned, s.removed) == \
        (7, 2, 1, 2, 5)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(terms=st.lists(st.text("ab é.-", min_size=1, max_size=4), min_size=1, max_size=12),
       texts=st.lists(st.text("ab é.-c", max_size=30), min_size=1, max_size=8))
def test_term_index(spark, terms, texts):
    """Overlapping, repeated and nested terms: the index finds what single tests find."""
    t, hits = F.col("text"), Hits(F.col("hits"))
    rows = (spark.createDataFrame([(x,) for x in texts], "text string")
            .withColumn("hits", term_index(t, terms, ["zz"]))
            .select("text", "hits", any_term(hits, terms), any_term(t, terms),
                    count_terms(hits, terms), count_terms(t, terms)).collect())
    for text, found, *tests in rows:
        expected = {x for x in terms if x in text}
        assert sorted(found) == sorted(expected)
        assert tests == [bool(expected)] * 2 + [sum(x in text for x in terms)] * 2


def test_term_index_of_nothing(spark):
    index = lambda t: term_index(t, ["a", "ab"])
    assert one(spark, index, "") == [] and one(spark, index, None) is None
    assert sorted(one(spark, index, "ab" * 100_000)) == ["a", "ab"]
