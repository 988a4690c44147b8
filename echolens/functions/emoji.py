"""Names of emoji sequences: tables of fixed parts, and rules that combine them.

A sequence is looked up without its variation selectors and skin tones, which are named behind it:
``woman_technologist_medium_skin_tone``.
"""

from functools import lru_cache
from itertools import combinations_with_replacement, product

JOINER = "‍"
SELECTOR = "️"
REGIONAL = "".join(chr(0x1F1E6 + i) for i in range(26))

# Skin tones.
TONES = {"🏻": "light_skin_tone", "🏼": "medium-light_skin_tone", "🏽": "medium_skin_tone",
         "🏾": "medium-dark_skin_tone", "🏿": "dark_skin_tone"}

# Countries by two-letter code; a flag of another code is named by the code.
FLAG_NAMES = {
    "ar": "Argentina", "at": "Austria", "au": "Australia", "be": "Belgium", "bf": "Burkina_Faso",
    "br": "Brazil", "ca": "Canada", "cd": "Congo_-_Kinshasa", "ch": "Switzerland",
    "ci": "Côte_d’Ivoire", "cm": "Cameroon", "cn": "China", "de": "Germany", "dk": "Denmark",
    "dz": "Algeria", "eg": "Egypt", "es": "Spain", "eu": "European_Union", "fi": "Finland",
    "fr": "France", "gb": "United_Kingdom", "gp": "Guadeloupe", "gr": "Greece", "ie": "Ireland",
    "il": "Israel", "in": "India", "it": "Italy", "jp": "Japan", "kr": "South_Korea",
    "lb": "Lebanon", "lu": "Luxembourg", "ma": "Morocco", "mc": "Monaco", "mg": "Madagascar",
    "ml": "Mali", "mq": "Martinique", "mx": "Mexico", "nl": "Netherlands", "no": "Norway",
    "pl": "Poland", "pt": "Portugal", "re": "Réunion", "ro": "Romania", "ru": "Russia",
    "se": "Sweden", "sn": "Senegal", "tn": "Tunisia", "tr": "Türkiye", "ua": "Ukraine",
    "us": "United_States",
}
# Parts of flags written with tag characters.
REGION_FLAGS = {"gbeng": "England", "gbsct": "Scotland", "gbwls": "Wales"}

# Persons, and what follows the joiner or precedes the gender sign.
ADULTS = {"👨": "man", "👩": "woman"}
CHILDREN = {"👧": "girl", "👦": "boy"}
PERSONS = {**ADULTS, "🧑": None}
OCCUPATIONS = {
    "💻": "technologist", "⚕": "health_worker", "🎓": "student", "🏫": "teacher", "⚖": "judge",
    "🌾": "farmer", "🍳": "cook", "🔧": "mechanic", "🏭": "factory_worker",
    "💼": "office_worker", "🔬": "scientist", "🎤": "singer", "🎨": "artist", "✈": "pilot",
    "🚀": "astronaut", "🚒": "firefighter",
}
GENDERS = {"♂": "man", "♀": "woman"}
ACTIONS = {
    "🤷": "shrugging", "🤦": "facepalming", "🙋": "raising_hand", "🙅": "gesturing_NO",
    "🙆": "gesturing_OK", "💁": "tipping_hand", "🙇": "bowing", "🙍": "frowning",
    "🙎": "pouting", "🏃": "running", "🚶": "walking", "🚴": "biking", "🏊": "swimming",
    "👮": "police_officer", "🕵": "detective", "💂": "guard", "👷": "construction_worker",
}
OTHER_JOINED = {
    "🏳‍🌈": "rainbow_flag", "🏴‍☠": "pirate_flag", "❤‍🔥": "heart_on_fire",
    "❤‍🩹": "mending_heart", "👁‍🗨": "eye_in_speech_bubble",
    "🐕‍🦺": "service_dog", "😮‍💨": "face_exhaling",
    "😵‍💫": "face_with_spiral_eyes", "😶‍🌫": "face_in_clouds",
}


@lru_cache(maxsize=None)
def sequence_names() -> dict:
    """Sequence without selectors and tones -> name; families, couples, occupations, gendered
    actions and flags come from rules."""
    names = dict(OTHER_JOINED)
    for code, country in FLAG_NAMES.items():
        names["".join(REGIONAL[ord(c) - ord("a")] for c in code)] = country
    for code, region in REGION_FLAGS.items():
        names["🏴" + "".join(chr(0xE0000 + ord(c)) for c in code) + "\U000E007F"] = region
    for (person, who), (thing, what) in product(PERSONS.items(), OCCUPATIONS.items()):
        names[person + JOINER + thing] = f"{who}_{what}" if who else what
    for (action, what), (sign, who) in product(ACTIONS.items(), GENDERS.items()):
        names[action + JOINER + sign] = f"{who}_{what}"
    # children: one, or two with a girl first
    children = [c for n in (1, 2) for c in combinations_with_replacement(CHILDREN, n)]
    parents = [p for n in (1, 2) for p in product(ADULTS, repeat=n)]
    for up, down in product(parents, children):
        names[JOINER.join(up + down)] = "_".join(
            ["family", *(ADULTS[a] for a in up), *(CHILDREN[c] for c in down)])
    for a, b in product(ADULTS, repeat=2):
        who = f"{ADULTS[a]}_{ADULTS[b]}"
        names[JOINER.join((a, "❤", b))] = f"couple_with_heart_{who}"
        names[JOINER.join((a, "❤", "💋", b))] = f"kiss_{who}"
    return names
