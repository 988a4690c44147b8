"""The trigram model against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from echolens.operators import language


def bins(text):
    letters = "".join(c if c.isalpha() and ord(c) < 0x10000 else " " for c in (text or "").lower())
    words = re.sub(" +", " ", letters).strip()
    codes = [ord(c) for c in f" {words} "] if words else []
    return [(a * 961 + b * 31 + c) % 8192 for a, b, c in zip(codes, codes[1:], codes[2:])]


FRENCH = ["Le réseau est en panne depuis hier", "je veux un remboursement", "la fibre ne marche pas"]
GERMAN = ["Das Netz ist seit gestern ausgefallen", "ich möchte mein Geld zurück", "der Anschluss geht nicht"]
ODD = [None, "", "   ", "123 !?", "a", "é", "😀", "x😀y", "A-B c", "日本語", "don't", "\n\tab cd"]


def test_bins(spark):
    texts = ODD + FRENCH + GERMAN + ["word " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.b for r in df.select("id", language.trigram_bins(df.text).alias("b")).collect()}
    assert got == {i: ([] if t is None else bins(t)) for i, t in enumerate(texts)}


@pytest.fixture(scope="module")
def model(spark):
    rows = [("fr", t) for t in FRENCH] + [("de", t) for t in GERMAN] + [(None, "no label"), ("fr", None), ("en", "42")]
    return language.fit_language_model(spark.createDataFrame(rows, "lang string, text string"))


def test_weights(model):
    got = {r.lang: r.weights for r in model.collect()}
    assert set(got) == {"fr", "de"}
    for lang, texts in (("fr", FRENCH), ("de", GERMAN)):
        n = Counter(b for t in texts for b in bins(t))
        total = sum(n.values())
        assert got[lang] == [round(1000 * math.log((n[b] + 0.5) / (total + 0.5 * 8192))) for b in range(8192)]


def test_detection(spark, model):
    rng = random.Random(2)
    words = " ".join(FRENCH + GERMAN).split()
    texts = ODD + ["remboursement", "möchte zurück", "panne"] + [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "id int, text string, _bins string")
    weights = {r.lang: r.weights for r in model.collect()}
    found = language.detect_language(df, model)
    assert found.columns == ["id", "text", "_bins", "language"]
    for r in found.collect():
        scores = [(sum(w[b] for b in bins(r.text)), lang) for lang, w in weights.items()]
        assert r.language == (max(scores)[1] if bins(r.text) else "unknown"), r
    assert found.where("language = 'fr' and text = 'panne'").count() == 1
    assert language.detect_language(df, model.where("false")).where("language != 'unknown'").count() == 0


def test_long_text_under_a_filter(spark, model):
    """A filter on the result moves below it; the work stays linear in the text."""
    df = spark.createDataFrame([("remboursement réseau " * 20_000,)], "text string")
    assert language.detect_language(df, model).where("language = 'fr'").count() == 1
    long = spark.createDataFrame([("fr", "panne " * 60_000)], "lang string, text string")
    assert language.fit_language_model(long).count() == 1


def test_pieces_of_a_batch(monkeypatch):
    """Trigrams are counted over whole batches in pieces of bounded size, languages in bounded number."""
    monkeypatch.setattr(language, "PIECE", 12)
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    texts = [" a ", "", " bc de ", " f ", "", f" {'long ' * 9}", " g "]
    got = {}
    for some, found, starts in language._trigrams(pa.array(texts)):
        got |= dict(zip(some.tolist(), [p.tolist() for p in np.split(found, starts[1:])]))
    assert got == {i: bins(t) for i, t in enumerate(texts) if t}
    langs, total = ["x", "y", "x", "y", "z", "z", "x"], Counter()
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts)], names=["lang", "padded"])
    for out in language._counted([batch]):
        for r in out.to_pylist():
            total[r["lang"], r["bin"]] += r["n"]
    assert total == Counter((lang, b) for lang, t in zip(langs, texts) for b in bins(t))
