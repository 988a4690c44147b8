"""Evaluation of predictions. Rows are reduced to counts first; curves, ranks and scores are
then computed on the counts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolens.sources.shared import write_and_read


def accuracy_by_target(df: DataFrame, pairs) -> DataFrame:
    """``(target, n, accuracy)`` for a dict target -> (label column, prediction column)."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(a).cast("string").alias("label"),
                 F.col(p).cast("string").alias("prediction")) for t, (a, p) in pairs.items()])))
    return (long.where(F.col("label").isNotNull()).groupBy("target")
                .agg(F.count("*").alias("n"), F.round(F.avg(
                    F.coalesce(F.col("label") == F.col("prediction"), F.lit(False))
                    .cast("double")), 4).alias("accuracy")))


def confusion_counts(df: DataFrame, label="label", prediction="prediction", by=()) -> DataFrame:
    return df.groupBy(*by, F.col(label).cast("string").alias("label"),
                      F.col(prediction).cast("string").alias("prediction")) \
             .agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, classes, label="label", prediction="prediction") -> DataFrame:
    """One row per label, one column ``pred_<class>`` per class, zero filled."""
    wide = confusion_counts(df, label, prediction).groupBy("label") \
        .pivot("prediction", list(classes)).agg(F.sum("n"))
    return wide.select("label", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"pred_{c}")
                                  for c in classes])


def precision_recall_f1(df: DataFrame, label="label", prediction="prediction",
                        by=()) -> DataFrame:
    """Precision, recall, F1 and support per class and their plain mean as class 'macro'."""
    by = list(by)
    sides = confusion_counts(df, label, prediction, by).select(*by, F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.lit(True).alias("is_label"),
                 (F.col("label") == F.col("prediction")).alias("hit"), F.col("n")),
        F.struct(F.col("prediction").alias("class"), F.lit(False).alias("is_label"),
                 F.lit(False).alias("hit"), F.col("n")))))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    c = sides.where(F.col("class").isNotNull()).groupBy(*by, "class").agg(
        total(F.col("hit")).alias("tp"), total(F.col("is_label")).alias("support"),
        total(~F.col("is_label")).alias("predicted"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    scored = c.withColumns({"precision": ratio(tp, predicted), "recall": ratio(tp, support),
                            "f1": ratio(2 * tp, support + predicted)})
    measures = ["precision", "recall", "f1"]
    macro = scored.groupBy(*by).agg(*[F.avg(m).alias(m) for m in measures],
                                    F.sum("support").alias("support")) \
                  .withColumn("class", F.lit("macro"))
    out = scored.select(*by, "class", *measures, "support").unionByName(macro)
    return out.withColumns({m: F.round(m, 4) for m in measures})


def classified_targets(df: DataFrame, label="label", prediction="prediction", positive="oui",
                       precision_goal=0.85, share_goal=0.90) -> DataFrame:
    """Claim precision and share of classified rows against their goals."""
    hit = F.count_if((F.col(label) == positive) & (F.col(prediction) == positive))
    said = F.count_if(F.col(prediction) == positive)
    share = F.try_divide(F.count(prediction), F.count("*"))
    precision = F.coalesce(F.try_divide(hit, said), F.lit(0.0))
    return df.agg(F.round(precision, 4).alias("claim_precision"),
                  (precision > precision_goal).alias("precision_met"),
                  F.round(share, 4).alias("classified_share"),
                  (share > share_goal).alias("share_met"))


def pr_roc_points(df: DataFrame, score="score", label="label", ranges=100) -> DataFrame:
    """Precision, recall and false-positive rate at each distinct score as threshold.

    Rows are counted per score first, and the counts are written: a condition on the score, asked of the rows,
    would bring all that the score is computed from into one filter, many times over, and each use of the counts
    would compute it again. Running sums are taken within ranges of scores in 0..1 and over the ranges, so no task
    sorts all scores. Rates without rows to divide by are null.
    """
    counts = write_and_read(df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")), "scores")
    counts = (counts.where(F.col("threshold").isNotNull())
              .withColumn("range", F.floor(F.col("threshold") * ranges)))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    sums = (counts.groupBy("range").agg(F.sum("p").alias("rp"), F.sum("q").alias("rq"))
            .select("range", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("bp"),
                    F.coalesce(F.sum("rq").over(above), F.lit(0)).alias("bq"),
                    F.sum("rp").over(everything).alias("pos"), F.sum("rq").over(everything).alias("neg")))
    down = (Window.partitionBy("range").orderBy(F.desc("threshold"))
            .rowsBetween(Window.unboundedPreceding, 0))
    tp, fp = F.sum("p").over(down) + F.col("bp"), F.sum("q").over(down) + F.col("bq")
    rate = lambda a, b: F.round(F.try_divide(a, b), 4)
    return (counts.join(sums, "range").select("threshold", tp.alias("tp"), fp.alias("fp"), "pos", "neg")
            .select("threshold", "tp", "fp", rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    rate(F.col("tp"), F.col("pos")).alias("recall"),
                    rate(F.col("fp"), F.col("neg")).alias("fpr")))


def cohen_kappa(annotations: DataFrame, item="item", annotator="annotator", label="label",
                threshold=0.7) -> DataFrame:
    """Agreement of each pair of annotators beyond chance, from long-form annotations.

    An item's annotations, one per annotator, meet once; their pairs are counted by labels on the map side, and
    from there on rows are numbers of label pairs.
    """
    given = annotations.where(F.col(item).isNotNull() & F.col(annotator).isNotNull()).select(
        F.col(item).alias("item"), F.struct(F.col(annotator).alias("by"), F.col(label).alias("label")).alias("x"))
    sets = given.groupBy("item").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    later = lambda x, i: F.transform(F.filter(F.slice("xs", i + 2, F.size("xs")), lambda y: y["by"] > x["by"]),
                                     lambda y: F.struct(x["by"].alias("first"), y["by"].alias("second"),
                                                        x["label"].alias("la"), y["label"].alias("lb")))
    pairs = write_and_read(sets.select(F.inline(F.flatten(F.transform("xs", later))))
                           .groupBy("first", "second", "la", "lb").agg(F.count("*").alias("n")), "pairs")
    per = ["first", "second"]
    side = lambda c: pairs.groupBy(*per, F.col(c).alias("l")).agg(F.sum("n").alias(f"n_{c}"))
    observed = pairs.groupBy(*per).agg(
        F.sum("n").alias("items"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("n"))
                                         .otherwise(0)).alias("same"))
    chance = (side("la").join(side("lb"), [*per, "l"]).groupBy(*per)
              .agg(F.sum(F.col("n_la").cast("double") * F.col("n_lb")).alias("both")))
    po = F.col("same") / F.col("items")
    pe = F.coalesce(F.col("both"), F.lit(0.0)) / (F.col("items").cast("double") * F.col("items"))
    kappa = F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0)
    return observed.join(chance, per, "left").select(
        *per, "items", F.round(po, 4).alias("observed"), F.round(pe, 4).alias("expected"),
        F.round(kappa, 4).alias("kappa"), (kappa >= threshold).alias("accepted"))


def fairness_rates(df: DataFrame, group="group", label="label", prediction="prediction",
                   positive="oui") -> DataFrame:
    """Per group: positive rate, true-positive rate and false-positive rate."""
    is_pos, said = F.col(label) == positive, F.col(prediction) == positive
    rate = lambda hit, base: F.when(F.count_if(base) > 0, F.count_if(hit & base)
                                    / F.count_if(base))
    return df.groupBy(F.col(group).alias("group")).agg(
        F.count("*").alias("n"), F.avg(said.cast("double")).alias("positive_rate"),
        rate(said, is_pos).alias("tpr"), rate(said, ~is_pos).alias("fpr"))


def fairness_gap(df: DataFrame, max_gap=0.25, max_variance=0.05, **columns) -> DataFrame:
    """Largest differences between groups, with the limits applied."""
    spread = lambda c: F.max(c) - F.min(c)
    return fairness_rates(df, **columns).agg(
        F.count("*").alias("groups"),
        F.round(spread("positive_rate"), 4).alias("parity_gap"),
        F.round(F.greatest(spread("tpr"), spread("fpr")), 4).alias("odds_gap"),
        F.round(F.var_pop("positive_rate"), 6).alias("variance"),
        (spread("positive_rate") <= max_gap).alias("gap_ok"),
        (F.var_pop("positive_rate") <= max_variance).alias("variance_ok"))


def value_at_rank(values: DataFrame, rank: int, least=4096, ways=64) -> float | None:
    """Value at a 0-based rank of rows given as distinct values and counts ``(v, c)``.

    Splitters are quantiles of the distinct values still in question, so each range between them holds about
    as many, wherever outliers lie. Counts per range tell which one holds the rank, and only that one is narrowed
    on, until it is small enough to be ordered.
    """
    low = high = None
    while True:
        inside = values
        if low is not None:
            inside = inside.where(F.col("v") > low)
        if high is not None:
            inside = inside.where(F.col("v") <= high)
        n, splitters = inside.agg(F.count("*"), F.percentile_approx(
            "v", [k / ways for k in range(1, ways)], 100 * ways)).first()
        if not n:
            return None
        if n <= least:
            upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # at most ``least`` rows
            return inside.withColumn("seen", F.sum("c").over(upto)).where(F.col("seen") > rank).agg(F.min("v")).first()[0]
        splitters = sorted(set(splitters))
        below = F.size(F.filter(F.array(*map(F.lit, splitters)), lambda s: s < F.col("v")))
        sizes = dict(inside.groupBy(below).agg(F.sum("c")).collect())  # a row per range
        at = 0
        while rank >= sizes.get(at, 0):
            rank -= sizes.get(at, 0)
            at += 1
        low, high = (splitters[at - 1] if at else low), (splitters[at] if at < len(splitters) else high)


def latency_summary(df: DataFrame, col: str, max_mean=850.0, max_p95=1500.0) -> DataFrame:
    """Mean and the value at 0-based rank ``int(0.95 n) - 1``, exactly, with the limits. Equal values are counted first."""
    values = write_and_read(df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v"))
                            .agg(F.count("*").alias("c")), "values")
    total = values.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
                       (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    n = total.first().n
    p95 = F.lit(value_at_rank(values, max(0, int(n * 0.95) - 1))).cast("double")
    return total.select("n", F.round("mean", 4).alias("mean"), F.round(p95, 4).alias("p95"),
                        ((F.col("mean") <= max_mean) & (p95 <= max_p95)).alias("within"))


def compare_models(df: DataFrame, predictions, label="label", positive="oui") -> DataFrame:
    """One row per model and metric with a flag for the best model of each metric.

    ``predictions`` maps a model name to its prediction column. One pass over the rows.
    """
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(label).alias("label"),
                 F.col(c).alias("prediction")) for m, c in predictions.items()])))
    is_pos, said = F.col("label") == positive, F.col("prediction") == positive
    tp, p, q = F.count_if(is_pos & said), F.count_if(is_pos), F.count_if(said)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    m = long.groupBy("model").agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
        ratio(tp, q).alias("precision"), ratio(tp, p).alias("recall"),
        ratio(2 * tp, p + q).alias("f1"))
    best = Window.partitionBy("metric").orderBy(F.desc("value"), "model")
    return (m.unpivot("model", ["accuracy", "precision", "recall", "f1"], "metric", "value")
             .withColumn("value", F.round("value", 4))
             .withColumn("is_best", F.row_number().over(best) == 1))
