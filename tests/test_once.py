"""Costly expressions are computed once per row, and constants are looked up, not searched."""

import re

from pyspark.sql import functions as F

from echolens.functions import emoji as E
from echolens.functions import text as T
from echolens.functions.match import Hits
from echolens.functions import lexicon as L
from echolens.operators import evaluate, rules, scoring


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_curve_computes_scores_once(spark):
    rows = spark.createDataFrame([("a a b", 1), ("a b", 0), ("b", 1), (None, 1)], "text string, label int").repartition(2)
    rows = rows.withColumn("n", F.regexp_count("text", F.lit("a"))).withColumn("score", F.col("n") / 4)
    got = evaluate.pr_roc_points(rows)
    assert "regexp" not in plan(got)
    assert sorted((r.threshold, r.tp, r.fp) for r in got.collect()) == [(0.0, 2, 1), (0.25, 1, 1), (0.5, 1, 0)]


def test_spellings_are_looked_up_in_place(spark):
    names = {k: v for k, v in {**T.emoji_names(), **E.sequence_names()}.items() if k != "⏰"}  # in no block of signs
    spellings = {**T.script_spellings(), **T.ascii_letters(), **T.ASCII_SPECIALS}
    signs = spark.createDataFrame([(k, True, v) for k, v in names.items()]
                                  + [(k, False, v) for k, v in spellings.items()]
                                  + [("漢", False, ""), ("\U0001D400", False, "")], "t string, sign boolean, spelled string")
    out = signs.select("sign", "spelled", T.emoji_to_text(F.concat(F.lit("1#"), "t", F.lit("z"))).alias("named"),
                       T.to_ascii(F.concat(F.lit("x"), "t", F.lit("y"))).alias("ascii"))
    assert "keys: [" not in plan(out)
    for r in out.collect():
        if r.sign:
            assert r.named == f"1# {r.spelled} z"
        else:
            assert r.ascii == f"x{r.spelled}y"


def test_words_of_a_language_are_counted_once(spark):
    texts = ["le les lesa la", "the of le", "Der und, die!", "los el-que", "été 12", "", None, "lele le", "ça y est"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = df.select("i", "text", T.detect_language(F.col("text")).alias("found"))
    assert plan(out).count("regexp") <= len(L.STOPWORD_PROFILES)
    for r in out.collect():
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        counts = {k: sum(w in v for w in words) for k, v in L.STOPWORD_PROFILES.items()}
        best = max(counts.values())
        assert r.found == (next(k for k, n in counts.items() if n == best) if best else "unknown")


def test_rule_sets_share_one_walk(spark):
    texts = ["panne facture URGENT", "merci", "fibre lente, pas urgent mais bug", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    one = many = df
    one = one.withColumn("_hits", rules.lexicon_hits(F.col("text")))
    for rule_set in L.RULE_SETS:
        many = rules.classify_by_lexicon(many, rule_set)
        one = rules.classify_by_lexicon(one, rule_set, hits=Hits(F.col("_hits")))
    assert plan(one).count("regexp_extract_all") == 1 and "contains(" not in plan(one).lower()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, one.drop("_hits").collect())) == sorted(map(key, many.collect()))


def test_training_words_and_counts_are_written(spark, monkeypatch):
    seen, write = {}, scoring.write_and_read
    monkeypatch.setattr(scoring, "write_and_read", lambda df, name: seen.update({name: df.columns}) or write(df, name))
    rows = spark.createDataFrame([(i, "good words here" if i % 2 else "bad news there", i % 2) for i in range(40)]
                                 + [(40, None, 1), (41, "good", None)], "id int, text string, label int")
    got = scoring.train_text_baseline(rows, rows, "label", "id").collect()
    assert seen["train"][0] == "label" and len(seen["train"]) == 2 and seen["counts"] == ["_label", "_tf"]
    assert len(got) == 40 and all(r.label == r.prediction for r in got)
