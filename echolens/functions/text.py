"""Text cleaning as column expressions.

Every function takes and returns a ``Column`` and works on the whole text. Two cleaners are
composed from them: ``clean_messages`` (ASCII form for classification) and ``preprocess_text``
(keeps accents, used by the scored tier).
"""

import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache
from string import ascii_lowercase
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.functions import emoji as E
from echolens.functions import lexicon as L
from echolens.functions.match import NOT_SPACE, SPACE, WORD, largest, trie_pattern

URL = rf"(?:http|www){NOT_SPACE}+"
URL_DOTTED = rf"(?i:http{NOT_SPACE}+|www\.{NOT_SPACE}+)"

# The four emoji blocks removed by ``strip_emojis``.
EMOJI_BLOCKS = (r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
                r"\x{1F1E0}-\x{1F1FF}]+")

# Code points with a spoken name, as (first, last).
NAMED_SYMBOLS = [(0x2600, 0x27BF), (0x1F300, 0x1F5FF), (0x1F600, 0x1F64F), (0x1F680, 0x1F6FF),
                 (0x1F900, 0x1F9FF), (0x1FA70, 0x1FAFF)]
SYMBOL_CLASS = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in NAMED_SYMBOLS) + "]"
KEYCAP = r"[0-9#*]\x{FE0F}?\x{20E3}"
FLAG = r"[\x{1F1E6}-\x{1F1FF}]{2}"
TONE = r"[\x{1F3FB}-\x{1F3FF}]"
MODIFIERS = r"[\x{FE0F}\x{1F3FB}-\x{1F3FF}]"
# what every emoji holds a character of
EMOJI_SIGN = rf"[\x{{20E3}}\x{{1F1E6}}-\x{{1F1FF}}{SYMBOL_CLASS[1:-1]}]"
# a symbol with its modifiers and tags, and what is joined to it
UNIT = rf"{SYMBOL_CLASS}{MODIFIERS}*+[\x{{E0020}}-\x{{E007F}}]*+"
SEQUENCE = rf"{UNIT}(?:\x{{200D}}{UNIT})*+"
# characters no emoji begins with, passed over before anything is looked ahead for
PLAIN = r"[^0-9#*\x{1F1E6}-\x{1F1FF}\x{2600}-\x{27BF}\x{1F300}-\x{1FAFF}]"

# Symbols whose customary emoji name differs from the Unicode character name.
EMOJI_NAMES = {
    "👍": "thumbs_up", "👎": "thumbs_down", "❤": "red_heart", "👏": "clapping_hands",
    "🙏": "folded_hands", "😡": "enraged_face", "😠": "angry_face", "✅": "check_mark_button",
    "❌": "cross_mark", "⚠": "warning", "👌": "OK_hand", "✌": "victory_hand",
    "💪": "flexed_biceps", "🎉": "party_popper", "🔥": "fire", "📢": "loudspeaker",
    "📱": "mobile_phone", "📞": "telephone_receiver", "☎": "telephone", "💻": "laptop",
    "📺": "television", "⏰": "alarm_clock", "😀": "grinning_face",
    "😃": "grinning_face_with_big_eyes", "😄": "grinning_face_with_smiling_eyes",
    "😁": "beaming_face_with_smiling_eyes", "😆": "grinning_squinting_face",
    "😅": "grinning_face_with_sweat", "🙂": "slightly_smiling_face",
    "☺": "smiling_face", "😍": "smiling_face_with_heart-eyes", "😘": "face_blowing_a_kiss",
    "😎": "smiling_face_with_sunglasses", "😢": "crying_face", "😱": "face_screaming_in_fear",
    "😤": "face_with_steam_from_nose", "😩": "weary_face", "😫": "tired_face",
    "🤔": "thinking_face", "🙄": "face_with_rolling_eyes", "😂": "face_with_tears_of_joy",
    "🤣": "rolling_on_the_floor_laughing", "💔": "broken_heart", "👋": "waving_hand",
    "🤬": "face_with_symbols_on_mouth", "😞": "disappointed_face", "😭": "loudly_crying_face",
}

# ASCII spellings that no decomposition rule yields.
ASCII_SPECIALS = {
    "œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ß": "ss", "€": "EUR", "…": "...", "™": "(tm)",
    "©": "(c)", "®": "(r)", "«": "<<", "»": ">>", "½": "1/2", "¼": "1/4", "¾": "3/4", "þ": "th",
    "Þ": "Th", "£": "PS", "—": "--",
}
ASCII_LETTERS = {
    "’": "'", "‘": "'", "‚": ",", "“": '"', "”": '"', "„": '"', "–": "-", "‐": "-", "‑": "-",
    "•": "*", "·": "*", "‹": "<", "›": ">", "¿": "?", "¡": "!", "ø": "o", "Ø": "O",
    "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ı": "i", "ħ": "h", "Ħ": "H",
    "×": "x", "\u00a0": " ", "\u202f": " ", "\u2009": " ", "\u3000": " ",
}

# Greek and Cyrillic letters in Latin spelling, lower case; accented letters follow
# from decomposition, capitals from the lower case.
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i",
    "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "ς": "s",
    "σ": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i",
    "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s",
    "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch",
    "ъ": "'", "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia", "ё": "io", "ђ": "dj",
    "є": "ie", "ѕ": "dz", "і": "i", "ї": "yi", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "tsh",
    "ў": "u", "џ": "dzh", "ґ": "g", "ѣ": "e", "ѳ": "f", "ѵ": "i", "ғ": "gh", "қ": "k", "ң": "n",
    "ү": "u", "ұ": "u", "һ": "h", "ә": "a", "ө": "o",
}


@lru_cache(maxsize=None)
def script_spellings() -> dict:
    """Greek or Cyrillic letter -> Latin spelling, one to four letters."""
    base = {**GREEK, **CYRILLIC}
    table = {}
    for cp in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        letter = chr(cp)
        low = letter.lower()
        if low not in base:  # without its accents
            low = next((c for c in unicodedata.normalize("NFKD", low) if c in base), None)
        if low is not None and letter not in ASCII_SPECIALS and letter not in ASCII_LETTERS:
            spelling = base[low]
            table[letter] = spelling if letter.lower() == letter else spelling.capitalize()
    return table


@lru_cache(maxsize=None)
def emoji_names() -> dict:
    """Symbol -> name: the Unicode name in lower case with underscores, or the customary one."""
    names = {}
    for first, last in NAMED_SYMBOLS:
        for cp in range(first, last + 1):
            name = unicodedata.name(chr(cp), "")
            if name and not name.startswith("EMOJI MODIFIER"):
                names[chr(cp)] = name.lower().replace(" ", "_")
    names.update(EMOJI_NAMES)
    return names


@lru_cache(maxsize=None)
def ascii_letters() -> dict:
    """Accented Latin letter -> base letter by canonical decomposition, plus fixed values."""
    table = {}
    for cp in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if ord(c) < 128)
        if len(base) == 1 and base.isalnum() and chr(cp) not in ASCII_SPECIALS:
            table[chr(cp)] = base
    table.update(ASCII_LETTERS)
    return table


@dataclass(frozen=True)
class CleanOptions:
    """Steps of ``clean_messages``."""
    lowercase: bool = True
    remove_urls: bool = True
    remove_mentions: bool = True
    remove_hashtags: bool = False
    convert_emojis: bool = True
    normalize_unicode: bool = True
    strip_punctuation: bool = False
    preserve_domain_terms: bool = True
    extra_stopwords: tuple = ()
    domain_terms: tuple = field(default=tuple(L.DOMAIN_TERMS))


def lower_text(text: Column) -> Column:
    """Lower-cased text, empty for null: the form every rule matches on."""
    return F.lower(F.coalesce(text, F.lit("")))


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, "")


def strip_urls_dotted(text: Column) -> Column:
    """As ``strip_urls`` but ``www`` needs its dot and case does not matter."""
    return F.regexp_replace(text, URL_DOTTED, "")


def strip_mentions(text: Column) -> Column:
    return F.regexp_replace(text, f"@{WORD}+", "")


def strip_hashtags(text: Column) -> Column:
    return F.regexp_replace(text, f"#{WORD}+", "")


def unwrap_hashtags(text: Column) -> Column:
    return F.regexp_replace(text, f"#({WORD}+)", "$1")


SLOTS = 4096


def _table(entries: dict):
    """Look-up of a string column in constant entries, null where there is none.

    The engine searches a map from its beginning, for a thousand entries and every character of a
    run. Entries are therefore dealt to slots by their checksum, and only the key's own slot is
    searched. One string literal holds them, as a thousand literals would be re-analysed with every
    further step of the plan.
    """
    slots = [[] for _ in range(SLOTS)]
    for key, value in entries.items():
        slots[crc32(key.encode()) % SLOTS].append(f"{key}:{value}")
    slots = F.split(F.lit("\n".join(",".join(slot) for slot in slots)), "\n")

    def look_up(key: Column) -> Column:
        slot = F.get(slots, (F.crc32(key) % SLOTS).cast("int"))
        return F.when(slot != "", F.try_element_at(F.str_to_map(slot, F.lit(","), F.lit(":")), key))
    return look_up


def emoji_to_text(text: Column) -> Column:
    """Replace each emoji by its name between spaces; a text without any is passed through.

    The longest sequence is named as a whole: flags, keycaps, symbols with skin tone, and joined
    sequences of the table. Of another joined sequence every part is named, and joiners, variation
    selectors and skin tones are left to ``to_ascii``.
    """
    names = _table({**emoji_names(), **E.sequence_names()})
    tones = _table(E.TONES)
    start = f"{KEYCAP}|{FLAG}|{SYMBOL_CLASS}"
    pieces = F.regexp_extract_all(
        text, F.lit(rf"{KEYCAP}|{FLAG}|{SEQUENCE}|(?:{PLAIN}++|(?!{start})[\s\S])++"), F.lit(0))

    def spell(piece):
        name = names(F.regexp_replace(piece, MODIFIERS, ""))
        tone = F.transform(F.array_distinct(F.regexp_extract_all(piece, F.lit(TONE), F.lit(0))),
                           tones)
        whole = F.concat(F.lit(" "), F.array_join(F.concat(F.array(name), tone), "_"), F.lit(" "))
        parts = F.array_join(F.transform(F.split(piece, ""), lambda c: F.coalesce(
            F.concat(F.lit(" "), names(c), F.lit(" ")), c)), "")
        code = F.concat(F.lit(" flag_"), F.translate(piece, E.REGIONAL, ascii_lowercase),
                        F.lit(" "))
        return (F.when(piece.rlike(f"^{KEYCAP}"),
                       F.concat(F.lit(" keycap_"), F.substring(piece, 1, 1), F.lit(" ")))
                 .when(name.isNotNull(), whole)
                 .when(piece.rlike(f"^{FLAG}"), code).otherwise(parts))

    named = F.transform(pieces, lambda p: F.when(p.rlike(f"^(?:{start})"), spell(p)).otherwise(p))
    return F.when(text.rlike(EMOJI_SIGN), F.array_join(named, "")).otherwise(text)


def strip_emojis(text: Column) -> Column:
    return F.regexp_replace(text, EMOJI_BLOCKS, "")


@lru_cache(maxsize=None)
def ascii_spellings() -> list:
    """ASCII spelling of each code point, by its number; empty for what is dropped."""
    table = {**script_spellings(), **ascii_letters(), **ASCII_SPECIALS}
    return [table.get(chr(cp), "") for cp in range(max(map(ord, table)) + 1)]


def to_ascii(text: Column) -> Column:
    """Latin, Greek and Cyrillic letters and typographic signs in ASCII; the rest is dropped.

    Only the runs of non-ASCII characters are spelled, each character by one look at its place in
    a constant array.
    """
    spellings = F.split(F.lit("\n".join(ascii_spellings())), "\n")
    runs = F.regexp_extract_all(text, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(F.ascii(r) < 128, r).otherwise(
        F.array_join(F.transform(F.split(r, ""), lambda c: F.get(spellings, F.ascii(c))), ""))), "")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def strip_special(text: Column) -> Column:
    """Keep word characters, white space and ``- . , ! ?``."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_\t-\r\x1C-\x20\x85\p{Z}\-.,!?]", "")


def strip_punctuation(text: Column) -> Column:
    """Keep word characters, white space and ``, . ? !``."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_\t-\r\x1C-\x20\x85\p{Z},.?!]", "")


def drop_stopwords(text: Column, words) -> Column:
    """Remove whole space-separated tokens."""
    stop = F.array(*[F.lit(w.lower()) for w in words])
    return F.array_join(F.filter(F.split(text, " "), lambda w: ~F.array_contains(stop, w)), " ")


def keep_domain_terms(cleaned: Column, raw: Column, terms=tuple(L.DOMAIN_TERMS)) -> Column:
    """Append domain terms of the raw text that cleaning lost, in sorted order."""
    terms = F.split(F.lit("\n".join(sorted(terms))), "\n")
    # the pair is bound once: the lambda must not repeat the expressions behind it per term
    pair = F.array(F.struct(raw.alias("raw"), cleaned.alias("cleaned")))
    return F.get(F.transform(pair, lambda p: F.when(p["cleaned"] == "", "").otherwise(
        F.array_join(F.concat(F.array(p["cleaned"]), F.transform(
            F.filter(terms, lambda k: F.contains(p["raw"], k) & ~F.contains(p["cleaned"], k)),
            lambda k: F.replace(k, F.lit(" "), F.lit("_")))), " "))), F.lit(0))


def clean_messages(df: DataFrame, column="text", out=None, options=CleanOptions()) -> DataFrame:
    """Add the cleaned text as ``<column>_cleaned``; null becomes the empty string."""
    out = out or f"{column}_cleaned"
    text = F.coalesce(F.col(column), F.lit(""))
    if options.lowercase:
        text = F.lower(text)
    if options.remove_urls:
        text = strip_urls(text)
    if options.remove_mentions:
        text = strip_mentions(text)
    if options.remove_hashtags:
        text = strip_hashtags(text)
    df = df.withColumn(out, text)
    # Steps that read the text several times start a new projection: the optimizer keeps a
    # costly column that is read more than once where it is, so it is computed once.
    text = F.col(out)
    if options.convert_emojis:
        text = emoji_to_text(text)
    if options.normalize_unicode:
        text = to_ascii(text)
    if options.strip_punctuation:
        text = strip_punctuation(text)
    text = collapse_spaces(text)
    if options.extra_stopwords:
        text = drop_stopwords(text, options.extra_stopwords)
    df = df.withColumn(out, text)
    if not options.preserve_domain_terms:
        return df
    return df.withColumn(out, F.when(F.col(out) == "", "").otherwise(keep_domain_terms(
        F.col(out), lower_text(F.col(column)), options.domain_terms)))


def preprocess_text(text: Column, preserve_case=False, remove_emojis=False) -> Column:
    """Second cleaner: URLs and mentions out, hashtags unwrapped, special signs out."""
    text = F.coalesce(text, F.lit(""))
    if not preserve_case:
        text = F.lower(text)
    text = unwrap_hashtags(strip_mentions(strip_urls_dotted(text)))
    if remove_emojis:
        text = strip_emojis(text)
    return collapse_spaces(strip_special(text))


def detect_language(text: Column) -> Column:
    """Language whose function words occur most often; ``unknown`` without any.

    Ties go to the language listed first.
    """
    text = lower_text(text)

    def count(words):
        firsts = "".join(sorted({w[0] for w in words}))
        return F.regexp_count(text, F.lit(
            rf"(?=[{firsts}])(?<!\p{{L}})(?:{trie_pattern(words)})(?!\p{{L}})"))

    return largest([(code, count(words)) for code, words in L.STOPWORD_PROFILES.items()], "unknown")


def flatten_struct(df: DataFrame, sep="_") -> DataFrame:
    """Turn nested struct fields into top-level columns named ``outer<sep>inner``."""
    def leaves(schema, path):
        for f in schema.fields:
            here = path + [f.name]
            if f.dataType.typeName() == "struct":
                yield from leaves(f.dataType, here)
            else:
                yield here
    return df.select([F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path))
                      for path in leaves(df.schema, [])])

