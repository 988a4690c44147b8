"""Numbering, sampling, splits, deduplication and ranks against plain Python, with hot groups."""

import hashlib

import pytest
from pyspark.sql import functions as F

from echolens.operators import batches, dedup, evaluate, merge, sampling


def md5(i, seed=42):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


def test_positions_over_many_blocks(spark):
    ids = list(range(-500, 20000, 7)) + [10 ** 9 + i for i in range(50)]
    df = spark.createDataFrame([(i,) for i in ids], "msg_id bigint").repartition(7)
    got = batches.number_rows(df, block=16).collect()
    assert {r.msg_id: r.position for r in got} == {i: p for p, i in enumerate(sorted(ids))}


@pytest.mark.parametrize("least", [1, 40, 4096])
def test_cutoffs_take_exactly_the_lowest_hashes(spark, least):
    data = [(i, "hot" if i % 10 else "cold") for i in range(3000)]
    df = spark.createDataFrame(data, "id bigint, s string")
    quotas = spark.createDataFrame([("hot", "a", 777), ("hot", "b", 2700), ("cold", "a", 1),
                                    ("cold", "b", 0)], "s string, cut string, quota bigint")
    cutoffs = sampling.hash_cutoffs(sampling.hash_keys(df, "id", "s"), "s", quotas, least=least)
    for cut, want in (("a", {"hot": 777, "cold": 1}), ("b", {"hot": 2700, "cold": 0})):
        got = sampling.mark_cuts(df, "id", "s", cutoffs, {cut: "x"}).where("x").collect()
        for s, n in want.items():
            lowest = sorted((i for i, k in data if k == s), key=md5)[:n]
            assert sorted(r.id for r in got if r.s == s) == sorted(lowest)


def test_as_many_strata_as_rows(spark):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("s"))
    assert sampling.stratified_split(df, "id", "s").count() == 100


def test_split_of_null_labels_and_ids(spark):
    rows = [(i, None if i < 100 else "x") for i in range(120)]
    got = sampling.stratified_split(spark.createDataFrame(rows, "id bigint, s string"), "id", "s")
    n = {(r.s, r.split): r["count"] for r in got.groupBy("s", "split").count().collect()}
    assert n == {(None, "train"): 70, (None, "validation"): 15, (None, "test"): 15, ("x", "train"): 14,
                 ("x", "validation"): 3, ("x", "test"): 3}
    rows = [(None, "x")] * 9000 + [(7, "x")] * 6000 + [(i, "y") for i in range(9)]  # few hashes, many rows
    got = sampling.stratified_split(spark.createDataFrame(rows, "id bigint, s string"), "id", "s")
    assert got.count() == 15009 and got.select("s", "id", "split").distinct().count() == 11


def test_sampling_reads_the_table_twice(spark, tmp_path):
    labelled(spark, 500, lambda i: "non", lambda i: "basse").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for make in (sampling.mark_diverse, sampling.mark_priority,
                 lambda d: sampling.stratified_split(d, "msg_id", "sentiment")):
        out = make(df)  # the narrow table is one read, what is left in the plan the other
        plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
        assert plan.count(f"InMemoryFileIndex [file:{tmp_path}/t]") == 1


def test_diverse_sample_of_null_sentiments(spark):
    rows = [(i, "non", "basse", None if i % 2 else "positif") for i in range(1000)]
    df = spark.createDataFrame(rows, "msg_id bigint, is_claim string, urgence string, sentiment string")
    got = sampling.sample_diverse(df).groupBy("sentiment").count().collect()
    assert {r.sentiment: r["count"] for r in got} == {None: 100, "positif": 100}


def labelled(spark, n, claim, urgency):
    rows = [(i, claim(i), urgency(i), ("neutre", "positif", "negatif")[i % 3])
            for i in range(n)]
    return spark.createDataFrame(rows, "msg_id bigint, is_claim string, urgence string, "
                                       "sentiment string")


def test_priority_sample_quotas(spark):
    df = labelled(spark, 2000, lambda i: "oui" if i % 4 == 0 else "non",
                  lambda i: ("haute", "moyenne", "basse")[(i // 4) % 3])
    got = sampling.sample_priority(df)
    counts = {r.stratum: r["count"] for r in got.groupBy("stratum").count().collect()}
    assert counts == {"urgent": 167, "medium": 83, "rest": 150}


def test_priority_sample_of_low_claims_only(spark):
    df = labelled(spark, 300, lambda i: "oui", lambda i: "basse")
    assert sampling.sample_priority(df).count() == 100
    few = labelled(spark, 30, lambda i: "oui", lambda i: "basse")
    assert sampling.sample_priority(few).count() == 30


def test_diverse_sample(spark):
    many = labelled(spark, 1000, lambda i: "oui" if i % 2 else "non", lambda i: "basse")
    got = sampling.sample_diverse(many).collect()
    assert len(got) == 200 and {r.is_claim for r in got} == {"oui"}
    some = labelled(spark, 1000, lambda i: "oui" if i < 50 else "non", lambda i: "basse")
    got = sampling.sample_diverse(some).collect()
    assert len(got) == 200 and sum(r.is_claim == "oui" for r in got) == 50
    rest = [r.sentiment for r in got if r.is_claim == "non"]
    assert all(abs(rest.count(s) - 50) <= 1 for s in ("neutre", "positif", "negatif"))
    tiny = labelled(spark, 40, lambda i: "non", lambda i: "basse")
    assert sampling.sample_diverse(tiny).count() == 40


def test_split_shares(spark):
    df = labelled(spark, 2000, lambda i: "non", lambda i: "basse")
    got = sampling.stratified_split(df, "msg_id", "sentiment") \
        .groupBy("sentiment", "split").count().collect()
    for r in got:
        n = {"neutre": 667, "positif": 667, "negatif": 666}[r.sentiment]
        share = {"train": 0.7, "validation": 0.15, "test": 0.15}[r.split]
        assert abs(r["count"] - n * share) <= 1


def test_dedup_with_a_hot_text(spark):
    data = [(i, "copy" if i % 3 else f"t{i % 50}") for i in range(3000)] + [(9000, None),
                                                                         (9001, None)]
    df = spark.createDataFrame(data, "msg_id bigint, text string").repartition(8)
    first = {}
    for i, t in sorted(data):
        first.setdefault(t, i)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = dedup.dedup_exact(df).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.text: r.msg_id for r in got} == first and len(got) == len(first)
    n = dedup.duplicate_count(df).first()
    assert (n.n_rows, n.n_distinct, n.n_duplicates) == (3002, len(first), 3002 - len(first))
    assert dedup.dedup_exact(df, "missing").count() == 3002


def test_dedup_keeps_columns_of_any_name(spark):
    names = ["_key", "_first", "_tied", "_dup", "_id", "_n"]
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (3, "y")], "msg_id bigint, text string")
    got = dedup.dedup_exact(df.withColumns({c: F.lit(f"own {c}") for c in names}))
    assert got.columns == ["msg_id", "text", *names] and got.count() == 2
    assert got.select(names).distinct().collect() == [tuple(f"own {c}" for c in names)]


def test_positions_of_rows_without_id(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (3, "c"), (None, None), (1, "d")], "msg_id bigint, text string")
    got = batches.make_batches(df, size=2).collect()
    assert sorted((r.batch_id, r.pos) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    assert [r.text for r in sorted(got, key=lambda r: (r.batch_id, r.pos))][:2] == ["d", "c"]


def test_rank_among_outliers_and_many_values(spark):
    values = [(float(i % 5000) / 7, 1 + i % 3) for i in range(5000)] + [(1e12, 1), (-1e300, 2), (float("inf"), 1)]
    df = spark.createDataFrame(values, "v double, c bigint").groupBy("v").agg(F.sum("c").alias("c"))
    flat = sorted(v for v, c in values for _ in range(c))
    for rank in (0, 1, 2, 3, 777, len(flat) // 2, len(flat) - 3, len(flat) - 1):
        assert evaluate.value_at_rank(df, rank, least=50, ways=8) == flat[rank]
    assert evaluate.value_at_rank(df.where("false"), 0) is None


def test_many_labels(spark):
    from echolens.operators import kpi
    df = spark.range(100_000).select(F.concat(F.lit("t"), F.col("id") % 99_000).alias("theme"), F.lit(0.5).alias("theme_confidence"))
    out = kpi.thematic_distribution(df)
    assert [tuple(r) for r in out.agg(F.count("*"), F.max("kinds"), F.max("top"), F.sum("n")).collect()] == [(99_000, 99_000, "t0", 100_000)]
    stats = kpi.group_kpi_stats(df, {"theme": ("theme", "theme_confidence")})
    for frame in (out, stats):
        plan = frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
        assert "Window" not in plan


@pytest.mark.parametrize("values", [
    [float(i % 17) for i in range(1000)], [1.0] * 40 + [5000.0], [3.25], [0.1, 0.2, 0.3, 0.4, 0.5],
    [float(i) ** 3 for i in range(333)]])
def test_latency_rank(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "ms double").repartition(5)
    got = evaluate.latency_summary(df, "ms").first()
    want = sorted(values)[max(0, int(len(values) * 0.95) - 1)]
    assert got.p95 == round(want, 4) and got.n == len(values)


def test_kappa(spark):
    a = [1, 1, 1, 0, 0, 0, 1, 0, 1, 1]
    b = [1, 1, 0, 0, 0, 1, 1, 0, 1, 1]
    rows = [(i, n, str(x[i])) for n, x in (("a", a), ("b", b)) for i in range(10)]
    df = spark.createDataFrame(rows, "item int, annotator string, label string")
    r = evaluate.cohen_kappa(df).first()
    po, pe = 0.8, 0.6 * 0.6 + 0.4 * 0.4
    assert r.kappa == round((po - pe) / (1 - pe), 4) and not r.accepted


def test_kappa_of_many_annotators(spark):
    import random
    rng = random.Random(6)
    rows = [(i, f"a{k}", rng.choice(["x", "y", None])) for i in range(60) for k in range(5) if rng.random() < 0.8]
    got = evaluate.cohen_kappa(spark.createDataFrame(rows + [(None, "a0", "x"), (1, None, "x")],
                                                     "item int, annotator string, label string")).collect()
    assert len(got) == 10
    by = {(i, a): v for i, a, v in rows}
    for r in got:
        both = [(by[i, r.first], by[i, r.second]) for i in range(60) if (i, r.first) in by and (i, r.second) in by]
        same = sum(a is not None and a == b for a, b in both) / len(both)
        chance = sum((sum(a == v for a, _ in both) / len(both)) * (sum(b == v for _, b in both) / len(both)) for v in "xy")
        assert (r["items"], r.observed) == (len(both), round(same, 4)) and abs(r.kappa - (same - chance) / (1 - chance)) < 1e-4


def cache_of(spark, path):
    return merge.open_cache(spark, path, "sentiment STRING", buckets=8)


def score(rows):
    return rows.select("key", F.concat(F.lit("of "), F.coalesce("text", F.lit("null"))).alias("sentiment"))


def test_cache_counts_and_scores_each_text_once(spark, tmp_path):
    df = spark.createDataFrame([(i, "same" if i % 2 else f"x{i}") for i in range(100)] + [(100, None), (101, "")],
                               "msg_id bigint, text string")
    cache = cache_of(spark, f"{tmp_path}/c")
    first = merge.score_with_cache(df.where("msg_id < 2"), cache, "m", score, run=1)
    assert [tuple(r) for r in merge.cache_statistics(first).collect()] == [(0, 2, 0.0)]
    found = merge.score_with_cache(df, cache, "m", score, run=2)
    s = merge.cache_statistics(found).first()
    assert (s.hits, s.misses, s.hit_rate) == (51, 51, 50.0)
    assert {r.sentiment: (r.n, r.hit) for r in found.where("n > 1 or hit").collect()} == {
        "of same": (50, True), "of x0": (1, True), "of null": (2, False)} | {
        r.sentiment: (2, False) for r in found.where("sentiment = 'of '").collect()}
    assert spark.table(cache).where("run = 2").count() == 50 and merge.cache_entries(spark, cache).count() == 52
    again = merge.score_with_cache(df, cache, "m", score, run=3)
    assert merge.cache_statistics(again).first().misses == 0 and spark.table(cache).where("run = 3").isEmpty()
    assert merge.score_with_cache(df, cache, "other", score, run=4).where("hit").isEmpty()


def test_cache_outlives_a_session_and_keeps_the_later_entry(spark, tmp_path):
    rows = lambda v: spark.createDataFrame([(f"k{i}", v) for i in range(20)], "key string, sentiment string")
    cache = cache_of(spark, f"{tmp_path}/c")
    merge.append_cache(rows("old"), cache, run=1)
    merge.append_cache(rows("new").where("key > 'k15'"), cache, run=2)
    spark.sql(f"DROP TABLE {cache}")  # as a new session, which knows the path only
    assert cache_of(spark, f"{tmp_path}/c") == cache
    got = {r.key: r.sentiment for r in merge.cache_entries(spark, cache).collect()}
    assert len(got) == 20 and all(v == ("new" if k > "k15" else "old") for k, v in got.items())


@pytest.mark.parametrize("partitions", ["3", "8", "40"])
def test_cache_is_not_shuffled(spark, tmp_path, partitions):
    cache = cache_of(spark, f"{tmp_path}/c")
    df = spark.createDataFrame([(i, f"x{i % 70}") for i in range(200)], "msg_id bigint, text string")
    merge.score_with_cache(df, cache, "m", score, run=1)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = merge.look_up(df, cache, "m")
        assert found.where("hit").count() == 70
        found.collect()
        plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    tree = plan.split("== Initial Plan ==")[0].split("\n")
    at = next(k for k, line in enumerate(tree) if "FileScan parquet" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, least = [], depth(tree[at])
    for line in reversed(tree[:at]):
        if depth(line) < least:
            least = depth(line)
            above.append(line)
    assert any("SortMergeJoin" in line for line in above)
    assert not any("Exchange" in line for line in above), plan
    assert "Bucketed: true" in plan


def test_confidence_mean(spark):
    df = spark.createDataFrame([(0.6, "oui", None), (0.6, "non", 0.9), (None, "oui", None)],
                               "bert_confidence double, is_claim string, "
                               "mistral_confidence double")
    got = [r.confidence for r in merge.aggregate_confidence(df).collect()]
    assert got == pytest.approx([0.725, (0.6 + 0.7 + 0.9) / 3, 0.85])


def test_scorer_failure_is_neutral(spark):
    from echolens.operators.scoring import score_batches

    def broken():
        def score(texts):
            raise RuntimeError("out of memory")
        return score
    df = spark.createDataFrame([("panne",), ("merci",)], "text string")
    got = score_batches(df, loader=broken).select("sentiment", "sentiment_confidence").collect()
    assert [tuple(r) for r in got] == [("neutre", 0.5)] * 2
    assert score_batches(df, loader=broken).where("scorer_failed").count() == 2
    assert score_batches(df).where("scorer_failed").count() == 0


def test_plan_has_no_cartesian_and_prunes(spark):
    from __spark_entry__ import queries
    from tests.conftest import FOLDER
    for name in ("classify_mode_fast", "sample_priority", "dedup_exact", "business_kpis"):
        df = queries()[name](spark, FOLDER)
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "props" not in plan


def test_dedup_when_ids_repeat(spark):
    rows = ([(1, "x"), (1, "x"), (2, "y"), (3, "x"), (None, "z"), (None, "z"), (4, "z"), (5, None), (5, None)]
            + [(7, "hot")] * 300 + [(8, "hot")] * 300)
    got = dedup.dedup_exact(spark.createDataFrame(rows, "msg_id bigint, text string")).collect()
    assert sorted(map(str, ((r.msg_id, r.text) for r in got))) == sorted(map(str, [
        (1, "x"), (2, "y"), (None, "z"), (5, None), (7, "hot")]))


def test_curve_uses_each_distinct_score(spark):
    rows = [(0.29, 1), (0.57, 0), (0.575, 1), (None, 1), (0.29, 0)]
    got = evaluate.pr_roc_points(spark.createDataFrame(rows, "score double, label int")).orderBy("threshold").collect()
    assert [(r.threshold, r.tp, r.fp) for r in got] == [(0.29, 2, 2), (0.57, 1, 1), (0.575, 1, 0)]
    none = evaluate.pr_roc_points(spark.createDataFrame([(0.5, 0)], "score double, label int")).first()
    assert none.recall is None and none.fpr == 1.0


def test_empty_tables(spark):
    from echolens.operators import kpi, quality
    empty = spark.createDataFrame([], "msg_id bigint, text string, sentiment string, label string, prediction string")
    assert quality.quality_score(empty).first()[0] == 0.0
    assert "0" in str(quality.validate_structure(empty).first())
    assert kpi.satisfaction_index(empty).first().positive_count == 0
    assert evaluate.classified_targets(empty).first().claim_precision == 0.0
