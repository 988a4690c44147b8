"""Normalisation of the indicator columns and the indicators themselves.

Percentages use all rows as denominator. Indicators that share a table share one aggregation:
partial results are combined per task and a few rows reach the last step.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.functions import lexicon as L
from echolens.functions.match import any_term, clamp, first_label, translate_values
from echolens.sources.shared import write_and_read


def clean_value(col: Column) -> Column:
    return F.trim(F.lower(col.cast("string")))


def is_true(col: Column) -> Column:
    return F.coalesce(clean_value(col).isin(*L.TRUE_WORDS), F.lit(False))


def percent(part, whole, digits=4) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(0.0)


# --- normalisation -----------------------------------------------------------------------

def resolve_aliases(df: DataFrame) -> DataFrame:
    """Add missing indicator columns from their alternative names, else with their default.

    Decided on the schema. Alias values are copied as they are; only a column that already has
    the right name is normalised.
    """
    new = {}
    for name in ("sentiment", "is_claim", "urgence", "incident", "theme", "confidence"):
        if name in df.columns or (name == "theme" and "topics" in df.columns):
            continue
        alias = next((a for a in L.ALIASES[name] if a in df.columns), None)
        if name == "confidence":
            new[name] = F.col(f"`{alias}`").try_cast("double") if alias else F.lit(0.5)
        else:
            new[name] = F.col(f"`{alias}`") if alias else F.lit(L.KPI_DEFAULTS[name])
    return df.withColumns(new) if new else df


def normalize_sentiment(col: Column) -> Column:
    return translate_values(clean_value(col), L.NORMAL_SENTIMENT)


def normalize_claim(col: Column) -> Column:
    return translate_values(clean_value(col), L.NORMAL_CLAIM)


def normalize_urgency(col: Column, is_claim: Column, sentiment: Column) -> Column:
    """Known spellings are mapped; any other value follows from claim and sentiment."""
    value = clean_value(col)
    inferred = first_label([
        ("haute", is_true(is_claim) & clean_value(sentiment).isin(*L.METRIC_NEGATIVE_WORDS)),
        ("moyenne", is_true(is_claim))], "faible")
    return F.when(value.isNull(), "faible").otherwise(
        first_label([(to, value.isin(*words)) for to, words in L.NORMAL_URGENCY.items()],
                    inferred))


def normalize_incident(col: Column, is_claim: Column) -> Column:
    value = clean_value(col)
    return (F.when(value.isNull() | value.isin("", "nan"), "aucun")
             .when(value.isin(*L.NORMAL_INCIDENTS), value)
             .when(is_true(is_claim), "non_specifie").otherwise("aucun"))


def normalize_confidence(col: Column) -> Column:
    return clamp(F.coalesce(col.try_cast("double"), F.lit(0.5)), 0.0, 1.0)


def normalize_kpis(df: DataFrame) -> DataFrame:
    """Aliases, normal spellings and defaults. A null goes straight to the default; the original
    first turns it into the text 'nan'."""
    given = set(df.columns)
    out = resolve_aliases(df)
    has = lambda c: c in given
    if has("sentiment"):
        out = out.withColumn("sentiment", normalize_sentiment(F.col("sentiment")))
    if has("is_claim"):
        out = out.withColumn("is_claim", normalize_claim(F.col("is_claim")))
    later = {}
    if has("urgence"):
        later["urgence"] = normalize_urgency(F.col("urgence"), F.col("is_claim"),
                                             F.col("sentiment"))
    if has("incident"):
        later["incident"] = normalize_incident(F.col("incident"), F.col("is_claim"))
    if has("confidence"):
        later["confidence"] = normalize_confidence(F.col("confidence"))
    out = out.withColumns(later) if later else out
    defaults = {**L.KPI_DEFAULTS, "theme": "autre"}
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(v))
                            for c, v in defaults.items() if c in out.columns})


def map_vocabulary_en(df: DataFrame) -> DataFrame:
    """English sentiment; ``priority`` from urgency and ``category`` from incident if absent."""
    out = {}
    if "sentiment" in df.columns:
        value = F.lower(F.col("sentiment"))
        out["sentiment"] = first_label([(to, value.isin(*words)) for to, words
                                        in L.ENGLISH_SENTIMENT.items()], F.col("sentiment"))
    for new, old in (("priority", "urgence"), ("category", "incident")):
        if old in df.columns and new not in df.columns:
            out[new] = F.col(old)
    return df.withColumns(out) if out else df


# --- label counts ------------------------------------------------------------------------

def value_counts(df: DataFrame, col: str, out="label") -> DataFrame:
    """``(label, n, pct)``: rows per non-null value; the share counts null rows in the total.

    The total comes from the grouped rows as a scalar, so that a column with many values is
    never gathered in one task.
    """
    g = df.groupBy(F.col(col).alias(out)).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n")).scalar()
    return (g.withColumn("pct", percent(F.col("n"), total, 2))
             .where(F.col(out).isNotNull()))


def _first_present(df: DataFrame, names):
    return next((n for n in names if n in df.columns), None)


# --- single indicators -------------------------------------------------------------------

def _claim_condition(df: DataFrame) -> Column:
    if "is_claim" in df.columns:
        return F.coalesce(F.lower(F.col("is_claim").cast("string")).isin(*L.TRUE_WORDS),
                          F.lit(False))
    col = _first_present(df, ["category", "incident"])
    if col is None:
        return F.lit(False)
    return any_term(F.lower(F.coalesce(F.col(col), F.lit(""))), L.CLAIM_CATEGORY_TERMS)


def claim_measures(df: DataFrame) -> dict:
    claims, n = F.count_if(_claim_condition(df)), F.count("*")
    return {"claim_count": claims, "claim_rate": percent(claims, n), "total": n}


def claim_rate(df: DataFrame) -> DataFrame:
    """Claims and their share, from the claim column or from words in category or incident."""
    return df.agg(*[v.alias(k) for k, v in claim_measures(df).items()])


def satisfaction_measures(df: DataFrame) -> dict:
    s, n = clean_value(F.col("sentiment")), F.count("*")
    pos = F.count_if(s.isin(*L.SATISFACTION_POSITIVE))
    neu = F.count_if(s.isin(*L.SATISFACTION_NEUTRAL))
    neg = F.count_if(s.isin(*L.SATISFACTION_NEGATIVE))
    return {"satisfaction_index": F.round(F.try_divide(pos - neg, n) * 50 + 50, 4),
            "positive_count": pos, "neutral_count": neu, "negative_count": neg,
            "positive_pct": percent(pos, n), "neutral_pct": percent(neu, n),
            "negative_pct": percent(neg, n)}


def satisfaction_index(df: DataFrame) -> DataFrame:
    return df.agg(*[v.alias(k) for k, v in satisfaction_measures(df).items()])


def urgency_measures(df: DataFrame) -> dict:
    n = F.count("*")
    col = _first_present(df, ["priority", "urgence"])
    if col:
        value = F.lower(F.coalesce(F.col(col).cast("string"), F.lit("")))
        is_critical = any_term(value, L.CRITICAL_PRIORITY_TERMS)
        critical = F.count_if(is_critical)
        high = F.count_if(any_term(value, L.HIGH_PRIORITY_TERMS) & ~is_critical)
    elif "is_urgent" in df.columns:
        critical = F.count_if(F.lower(F.col("is_urgent").cast("string")).isin(*L.TRUE_WORDS))
        high = F.lit(0).cast("bigint")
    else:
        critical = high = F.lit(0).cast("bigint")
    return {"critical_count": critical, "high_count": high, "urgent_total": critical + high,
            "urgency_pct": percent(critical + high, n)}


def urgency_rate(df: DataFrame) -> DataFrame:
    """Critical and high rows by words in the priority, else the urgency, else a flag."""
    return df.agg(*[v.alias(k) for k, v in urgency_measures(df).items()])


def confidence_measures(df: DataFrame) -> dict:
    col = _first_present(df, ["confidence", "sentiment_score"])
    if col is None:
        return {}
    x = F.col(col).try_cast("double")
    mean = F.avg(x) if col == "confidence" else F.abs(F.avg(x))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return {"average": zero(mean), "minimum": zero(F.min(x)), "maximum": zero(F.max(x)),
            "std": zero(F.stddev_samp(x))}


def confidence_summary(df: DataFrame) -> DataFrame:
    """Mean, range and sample deviation; 0 where there are no or too few values."""
    return df.agg(*[v.alias(k) for k, v in confidence_measures(df).items()])


def theme_column(df: DataFrame):
    return _first_present(df, ["Thème principal", "category", "incident", "theme"])


def _top(label, n, among=None) -> Column:
    """Label of the largest count, the smallest one of several; combined on the map side, nothing is sorted."""
    counts = label.isNotNull() if among is None else label.isNotNull() & among
    return F.min_by(label, F.when(counts, F.struct(-n, label)))


def _distribution(df: DataFrame, col: str, confidence=None) -> DataFrame:
    g = df.groupBy(F.col(f"`{col}`").cast("string").alias("label")).agg(
        F.count("*").alias("n"),
        *([F.sum(confidence).alias("_s"), F.count(confidence).alias("_c")] if confidence else []))
    whole = g.agg(F.struct(
        F.sum("n").alias("total"), F.count("label").alias("kinds"), _top(F.col("label"), F.col("n")).alias("top"),
        *([(F.sum("_s") / F.sum("_c")).alias("confidence")] if confidence else []))).scalar()
    out = g.where(F.col("label").isNotNull()).withColumn("_whole", whole)
    return out.select("label", "n", percent(F.col("n"), F.col("_whole.total")).alias("pct"),
                      F.col("_whole.kinds").alias("kinds"), F.col("_whole.top").alias("top"),
                      *([F.round("_whole.confidence", 4).alias("avg_confidence")] if confidence else []))


def thematic_distribution(df: DataFrame) -> DataFrame:
    """Rows per theme with share, number of themes, the most frequent one and the mean theme
    confidence if present. The theme column is chosen by name."""
    return _distribution(df, theme_column(df), _first_present(df, ["theme_confidence"]))


def incident_distribution(df: DataFrame) -> DataFrame:
    """Rows per main incident, and per responsible team where known, in one scan."""
    parts = [("incident", "Incident principal")]
    if "incident_responsable" in df.columns:
        parts.append(("responsable", "incident_responsable"))
    names = [c for _, c in parts]
    confidence = "incident_confidence" if "incident_confidence" in df.columns else None
    sums = [F.count("*").alias("n")] + ([F.sum(confidence).alias("_s"),
                                         F.count(confidence).alias("_c")] if confidence else [])
    g = df.groupingSets([[], *[[f"`{c}`"] for c in names]], *[f"`{c}`" for c in names]).agg(
        F.grouping_id().alias("gid"), *sums)
    full = 2 ** len(names) - 1
    kind = first_label([(k, F.col("gid") == full - 2 ** (len(names) - 1 - i))
                        for i, (k, _) in enumerate(parts)], F.lit("total"))
    g = g.withColumns({"kind": kind, "label": F.coalesce(*[F.col(f"`{c}`") for c in names])})
    whole = F.col("gid") == full
    totals = g.agg(F.struct(
        F.max(F.when(whole, F.col("n"))).alias("total"),
        (F.max(F.when(whole, F.col("_s") / F.col("_c"))) if confidence else F.lit(None).cast("double")).alias("confidence"),
        *[_top(F.col("label"), F.col("n"), F.col("kind") == k).alias(k) for k, _ in parts])).scalar()
    top = first_label([(F.col(f"_all.{k}"), F.col("kind") == k) for k, _ in parts], F.lit(None))
    return (g.where((F.col("kind") != "total") & F.col("label").isNotNull()).withColumn("_all", totals)
             .select("kind", "label", "n", percent(F.col("n"), F.col("_all.total")).alias("pct"),
                     (F.col("label") == top).alias("is_top"),
                     F.when(F.col("kind") == "incident", F.round("_all.confidence", 4)).alias("avg_confidence")))


def claims_enriched(df: DataFrame, col="réclamations",
                    confidence="reclamation_confidence") -> DataFrame:
    """Yes and no counts with shares and the mean confidence of the claim column."""
    value, n = F.col(f"`{col}`").cast("string"), F.count("*")
    yes = F.when(F.count_if(value == "Oui") > 0, F.count_if(value == "Oui")) \
        .otherwise(F.count_if(value == "oui"))
    no = F.when(F.count_if(value == "Non") > 0, F.count_if(value == "Non")) \
        .otherwise(F.count_if(value == "non"))
    mean = [F.round(F.avg(confidence), 4).alias("avg_confidence")] \
        if confidence in df.columns else []
    return df.agg(yes.alias("oui_count"), no.alias("non_count"), percent(yes, n).alias("oui_pct"),
                  percent(no, n).alias("non_pct"), *mean)


def business_kpis(df: DataFrame) -> DataFrame:
    """All indicators in long form ``(kpi, item, value)`` from one pass over the rows.

    The grouping sets carry the scalar measures on the empty set and the label counts on one set
    per distribution; everything after the aggregation handles one row per label.
    """
    theme = theme_column(df)
    dims = [("thematic_distribution", theme)] if theme else []
    for kpi, col in (("incident_distribution", "Incident principal"),
                     ("responsable_distribution", "incident_responsable"),
                     ("reclamations_enriched", "réclamations")):
        if col in df.columns and col != theme:
            dims.append((kpi, col))
    scalars = {"claim_rate": claim_measures(df), "urgency_rate": urgency_measures(df),
               "confidence_score": confidence_measures(df)}
    if "sentiment" in df.columns:
        scalars["satisfaction_index"] = satisfaction_measures(df)
    flat = {(kpi, item): col for kpi, items in scalars.items() for item, col in items.items()}
    keys = [f"`{c}`" for _, c in dims]
    g = df.groupingSets([[], *[[k] for k in keys]], *keys).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n"),
        *[c.cast("double").alias(f"m{i}") for i, c in enumerate(flat.values())])
    full = 2 ** len(keys) - 1
    row = lambda kpi, item, v: F.struct(F.lit(kpi).alias("kpi"), item.alias("item"),
                                        v.cast("double").alias("value"))
    rows = F.when(F.col("gid") == full, F.array(*[
        row(kpi, F.lit(item), F.col(f"m{i}")) for i, (kpi, item) in enumerate(flat)]))
    for i, (kpi, col) in enumerate(dims):
        rows = rows.when((F.col("gid") == full - 2 ** (len(keys) - 1 - i))
                         & F.col(f"`{col}`").isNotNull(),
                         F.array(row(kpi, F.col(f"`{col}`").cast("string"), F.col("n"))))
    return g.select(F.inline(rows))


def kpi_metrics(df: DataFrame) -> DataFrame:
    """Totals, percentages, mean confidence and four label counts in long form, one pass."""
    labels = [c for c in ("sentiment", "urgence", "topics", "incident") if c in df.columns]
    n = F.count("*")
    flag = lambda c, words: F.count_if(clean_value(F.col(c)).isin(*words)) \
        if c in df.columns else F.lit(0).cast("bigint")
    claims = flag("is_claim", L.TRUE_WORDS)
    negative = flag("sentiment", L.METRIC_NEGATIVE_WORDS)
    high = flag("urgence", L.HIGH_URGENCY_WORDS)
    measures = {"total": n, "claims_count": claims, "claims_pct": percent(claims, n),
                "negative_count": negative, "negative_pct": percent(negative, n),
                "high_urgency_count": high, "high_urgency_pct": percent(high, n)}
    if "confidence" in df.columns:
        measures["confidence_avg"] = F.round(F.avg("confidence"), 4)
    g = df.groupingSets([[], *[[c] for c in labels]], *labels).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n"),
        *[v.cast("double").alias(f"_{k}") for k, v in measures.items()])
    full = 2 ** len(labels) - 1
    row = lambda m, label, v: F.struct(F.lit(m).alias("measure"), label.alias("label"),
                                       v.cast("double").alias("value"))
    rows = F.when(F.col("gid") == full, F.array(*[row(k, F.lit(""), F.col(f"_{k}"))
                                                  for k in measures]))
    for i, c in enumerate(labels):
        rows = rows.when((F.col("gid") == full - 2 ** (len(labels) - 1 - i))
                         & F.col(c).isNotNull(), F.array(row(c, F.col(c), F.col("n"))))
    return g.select(F.inline(rows))


def quality_summary(df: DataFrame) -> DataFrame:
    """Coverage of claims and sentiment, and critical incidents; when no named critical incident
    occurs, rows of high urgency with any real incident are counted instead."""
    n = F.count("*")
    incident, urgency = clean_value(F.col("incident")), clean_value(F.col("urgence"))
    claims = F.count_if(is_true(F.col("is_claim")))
    covered = F.count("sentiment")
    critical = F.count_if(incident.isin(*L.CRITICAL_INCIDENTS))
    real = F.count_if(urgency.isin(*L.HIGH_URGENCY_WORDS) & incident.isNotNull()
                      & ~incident.isin(*L.EMPTY_INCIDENTS))
    return df.agg(claims.alias("claims"), percent(claims, n).alias("claim_coverage"),
                  covered.alias("with_sentiment"), percent(covered, n).alias(
                      "sentiment_coverage"),
                  F.when(critical > 0, critical).otherwise(real).alias("critical_incidents"))


def top_real_incident(df: DataFrame) -> DataFrame:
    """The most frequent incident that is one, with its rows; otherwise ``aucun`` and the rows
    without an incident."""
    value = clean_value(F.coalesce(F.col("incident"), F.lit("nan")))
    g = (df.groupBy(F.when(~value.isin(*L.NO_INCIDENT_WORDS), value).alias("label"))
           .agg(F.count("*").alias("n")))
    return (g.orderBy(F.col("label").isNull(), F.desc("n"), "label").limit(1)
             .select(F.coalesce("label", F.lit("aucun")).alias("incident"), "n"))


def alert_bands(claim=None, satisfaction=None, urgency=None, confidence=None) -> dict:
    """Band columns for the given indicator columns."""
    band = lambda x, high, low, names: F.when(x > high, names[0]).when(x > low, names[1]) \
        .otherwise(names[2])
    out = {}
    if claim is not None:
        out["claim_band"] = band(claim, 30, 15, ("alert", "watch", "good"))
    if satisfaction is not None:
        out["satisfaction_band"] = band(satisfaction, 60, 40, ("positive", "neutral",
                                                               "negative"))
    if urgency is not None:
        out["urgency_band"] = band(urgency, 20, 10, ("high", "moderate", "low"))
    if confidence is not None:
        out["confidence_band"] = band(confidence, 0.8, 0.6, ("high", "medium", "low"))
    return out


def group_kpi_stats(df: DataFrame, dimensions) -> DataFrame:
    """Per label of each dimension: count, percent (2 digits) and mean confidence.

    ``dimensions`` maps a name to (label column, confidence column). One scan: every row is
    unrolled into one narrow row per dimension and combined before the shuffle.
    """
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("dimension"), F.col(f"`{label}`").cast("string")
                 .alias("label"), F.col(f"`{conf}`").cast("double").alias("confidence"))
        for name, (label, conf) in dimensions.items()])))
    g = long.groupBy("dimension", "label").agg(F.count("*").alias("count"), F.avg("confidence").alias("avg"))
    total = (g.agg(F.sum("count")).scalar() / len(dimensions))  # every row has a label, or none, in each
    return (g.select("dimension", "label", "count",
                     F.round(F.col("count") * 100.0 / total, 2).alias("percentage"),
                     F.round("avg", 2).alias("avg_confidence"))
             .where(F.col("label").isNotNull()))


def flat_kpis(df: DataFrame, theme="topics", top=5) -> DataFrame:
    """Total, percent per sentiment, percent urgent and the five most frequent themes, long."""
    g = write_and_read(
        df.groupingSets([[], [theme]], theme)
          .agg(F.grouping_id().alias("gid"), F.count("*").alias("n"),
               *[F.count_if(F.col("sentiment") == s).alias(s) for s in L.SENTIMENTS],
               F.count_if(F.col("urgence") == "haute").alias("urgent")), "themes")
    most = g.where((F.col("gid") == 0) & F.col(theme).isNotNull()).orderBy(F.desc("n"), theme).limit(top)
    pct = lambda c: F.round(F.col(c) * 100.0 / F.col("n"), 4)
    row = lambda item, v: F.struct(item.alias("item"), v.cast("double").alias("value"))
    return (g.where("gid = 1").unionByName(most)
            .select(F.inline(F.when(F.col("gid") == 1, F.array(
                row(F.lit("total"), F.col("n")), row(F.lit("pct_negatif"), pct("negatif")),
                row(F.lit("pct_neutre"), pct("neutre")),
                row(F.lit("pct_positif"), pct("positif")),
                row(F.lit("pct_urgent"), pct("urgent"))))
                .otherwise(F.array(row(F.concat(F.lit("theme:"), F.col(theme)),
                                       F.col("n")))))))


def dataset_statistics(df: DataFrame, labels, split="split", text="text",
                       author="author") -> DataFrame:
    """Per split in long form: size, label counts and percentages, urgent rows, rows needing a
    response, mean text length and distinct authors.

    Authors are grouped first, so a busy author is one row before distinct authors are counted.
    """
    n = F.count("*")
    base = (df.groupBy(split, author)
              .agg(n.alias("n"), F.count_if(F.col("urgence") == "haute").alias("urgent"),
                   F.count_if(F.col("is_claim") == "oui").alias("needs_response"),
                   F.sum(F.length(text)).alias("chars"), F.count(text).alias("texts"))
              .groupBy(split)
              .agg(F.sum("n").alias("total_samples"), F.sum("urgent").alias("urgent"),
                   F.sum("needs_response").alias("needs_response"),
                   F.round(F.sum("chars") / F.sum("texts"), 4).alias("avg_text_length"),
                   F.count(author).alias("unique_authors")))
    row = lambda m, label, v: F.struct(F.lit(m).alias("measure"), label.alias("label"),
                                       v.cast("double").alias("value"))
    scalars = base.select(split, F.inline(F.array(*[
        row(c, F.lit(""), F.col(c)) for c in ("total_samples", "urgent", "needs_response",
                                              "avg_text_length", "unique_authors")])))
    long = df.select(split, F.inline(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).alias("label")) for c in labels])))
    counts = write_and_read(long.groupBy(split, "measure", "label").agg(n.alias("n")), "labels")
    sizes = counts.groupBy(F.col(split).alias("_of"), F.col("measure").alias("_by")).agg(F.sum("n").alias("_total"))
    counts = (counts.join(sizes, F.col(split).eqNullSafe(F.col("_of")) & (F.col("measure") == F.col("_by")))
                    .withColumn("pct", F.round(F.col("n") * 100.0 / F.col("_total"), 4)))
    shares = counts.select(split, F.inline(F.array(
        F.struct(F.concat("measure", F.lit("_count")).alias("measure"), F.col("label"),
                 F.col("n").cast("double").alias("value")),
        F.struct(F.concat("measure", F.lit("_pct")).alias("measure"), F.col("label"),
                 F.col("pct").alias("value")))))
    return scalars.unionByName(shares)
