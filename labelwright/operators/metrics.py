"""Accuracy, latency, retrieval and groundedness metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions import patterns as P
from labelwright.functions.geometry_checks import finite
from labelwright.functions.ordering import weighted_pick
from labelwright.functions.text import strip

SWEEP = (0.55, 0.60, 0.65, 0.70, 0.75, 0.80)


def truth_join(truth: DataFrame, extracted: DataFrame) -> DataFrame:
    """Expected against extracted by image and field: containment, or equality of a status, or both null."""
    j = truth.join(extracted, ["image_id", "field"], "left")
    expected, actual = F.col("expected"), F.col("actual")
    inside = F.lower(F.coalesce(actual, F.lit(""))).contains(F.lower(strip(expected)))
    matched = (F.when(F.col("is_status"), F.coalesce(actual == expected, F.lit(False)))
               .when(expected.isNull(), actual.isNull()).otherwise(inside))
    return j.withColumn("matched", matched)


def extraction_metrics(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    n = F.count("*")
    return checks.groupBy(*(by or [])).agg(
        n.alias("checks"), F.count_if("matched").alias("matches"), F.try_divide(F.count_if("matched"), n).alias("accuracy"),
        F.try_divide(F.count_if(F.col("n_regions") > 0), n).alias("evidence_coverage"))


def nearest_rank_percentile(df: DataFrame, keys: list[str], value: str, percent: float) -> DataFrame:
    """Value at index round(p·(n−1)) of the ordered values, half to even, as an exact pick."""
    def rank(total: Column) -> Column:
        return F.bround(F.lit(percent / 100) * (total - 1), 0) + 1
    return weighted_pick(df, keys, value, F.lit(1), rank)


def median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean of the two middle values, each found by an exact pick."""
    low = weighted_pick(df, keys, value, F.lit(1), lambda n: F.floor((n + 1) / 2))
    high = weighted_pick(df, keys, value, F.lit(1), lambda n: F.floor(n / 2) + 1).withColumnRenamed("value", "_hi")
    joined = low.join(high, keys) if keys else low.crossJoin(high)  # one row each without keys
    return joined.select(*keys, ((F.col("value") + F.col("_hi")) / 2).alias("value"))


def weighted_median(df: DataFrame, key: str, value: str, weight: str, min_rows: int = 3, min_weight: float = 0.0) -> DataFrame:
    """First value whose cumulative weight reaches half the total; not assessed on too few rows or weight."""
    size = df.groupBy(key).agg(F.count("*").alias("_n"), F.sum(weight).alias("_w"))
    picked = weighted_pick(df, [key], value, F.col(weight), lambda total: total / 2)  # of every group: rows are summed before they are shuffled
    enough = (F.col("_n") >= min_rows) & (F.col("_w") >= min_weight)
    assessed = size.join(picked, key, "left").withColumn("value", F.when(enough, F.col("value")))
    return assessed.select(key, "value", F.when(F.col("value").isNull(), "not_assessed").otherwise("assessed").alias("status"))


def regressions(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Shared numeric metrics with their difference."""
    j = current.join(baseline.withColumnRenamed("value", "baseline"), "metric").where("value is not null and baseline is not null")
    return j.select("metric", F.col("value").alias("current"), "baseline", (F.col("value") - F.col("baseline")).alias("delta"))


def outcome_classes(df: DataFrame) -> DataFrame:
    """``(ground_truth, detected, status)`` to an outcome that never claims more than the ground truth says."""
    out = (F.when(F.col("ground_truth") == "legible", F.when(F.col("detected"), "CORRECT").otherwise("FALSE_NOT_DETECTED"))
           .when(F.col("ground_truth") == "blank", F.when(F.col("status") == "NEEDS_MANUAL_VERIFICATION", "LEGITIMATE_REVIEW")
                 .when(F.col("status") == "PASS", "FALSE_PASS").otherwise("GROUND_TRUTH_UNAVAILABLE"))
           .otherwise("GROUND_TRUTH_UNAVAILABLE"))
    return df.withColumn("outcome", out)


def failure_source(df: DataFrame) -> DataFrame:
    """``(field, text, detected, n_regions)`` to where a miss started: recognition, extraction, confidence, evidence."""
    lowered = F.lower("text")
    hinted = reduce(lambda a, kv: a.when(F.col("field") == kv[0], reduce(lambda x, y: x | y, [lowered.contains(h) for h in kv[1]])),
                    list(P.FAILURE_HINTS.items())[1:],
                    F.when(F.col("field") == list(P.FAILURE_HINTS)[0],
                           reduce(lambda x, y: x | y, [lowered.contains(h) for h in list(P.FAILURE_HINTS.values())[0]])))
    first = F.when(~F.coalesce(hinted, F.lit(False)), "OCR").when(~F.col("detected"), "Extraction").otherwise("Confidence")
    second = F.when(F.col("detected") & (F.col("n_regions") == 0), "Evidence")
    return df.withColumn("sources", F.array_compact(F.array(first, second)))


def latency_profile(runs: DataFrame, stages: list[str]) -> DataFrame:
    """Mean per stage over successful runs, one pass."""
    means = runs.where("success").agg(*[F.avg(s).alias(s) for s in stages])
    return means.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("mean_ms")) for s in stages])).alias("r")).select("r.*")


def distinct_shapes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct price-like and quantity-like tokens per document, and the scenario tags that follow."""
    count = lambda p: F.size(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(P.java(p)), F.lit(0))))
    staged = docs.select("doc_id", count(P.PRICE_LIKE).alias("prices"), count(P.QUANTITY_LIKE).alias("quantities"))
    tags = F.array_compact(F.array(F.when(F.col("prices") >= 2, "multiple_price_numbers"), F.when(F.col("quantities") >= 2, "multiple_weight_numbers")))
    return staged.withColumn("tags", F.array_join(tags, ","))


def confusion(pairs: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Per class: true and false positives, false negatives, precision, recall.

    Each pair adds to the counters of at most two classes, in one aggregate with map-side merge.
    """
    counts = pairs.groupBy(pred, truth).agg(F.count("*").alias("_n"))
    rows = F.array(F.struct(F.col(pred).alias("class_id"), F.when(F.col(pred).eqNullSafe(F.col(truth)), F.col("_n")).otherwise(0).alias("tp"),
                            F.when(~F.col(pred).eqNullSafe(F.col(truth)), F.col("_n")).otherwise(0).alias("fp"), F.lit(0).cast("bigint").alias("fn")),
                   F.struct(F.col(truth).alias("class_id"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"),
                            F.when(~F.col(pred).eqNullSafe(F.col(truth)), F.col("_n")).otherwise(0).alias("fn")))
    per_class = counts.select(F.inline(rows)).where("class_id is not null").groupBy("class_id").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")])
    return per_class.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn(
        "recall", F.try_divide("tp", F.col("tp") + F.col("fn"))).withColumn("has_instances", F.col("tp") + F.col("fn") > 0)


def confidence_gate(df: DataFrame, parts: list[str], threshold: float = P.GATE_CONFIDENCE) -> DataFrame:
    """Harmonic mean of the components, 0 when any is 0; an invalid component goes to review."""
    cols = [F.col(p).cast("double") for p in parts]
    valid = reduce(lambda a, b: a & b, [finite(c) & c.between(0, 1) for c in cols])
    any_zero = reduce(lambda a, b: a | b, [c == 0 for c in cols])
    mean = F.lit(float(len(cols))) / reduce(lambda a, b: a + b, [F.lit(1.0) / F.nullif(c, F.lit(0.0)) for c in cols])
    score = F.when(~valid | any_zero, 0.0).otherwise(F.round(mean, 12))
    staged = df.withColumn("score", score)
    return staged.withColumn("decision", F.when(valid & (F.col("score") >= threshold), "proceed").otherwise("officer_review"))


def corpus_status(sources: DataFrame, provisions: DataFrame) -> DataFrame:
    """Sources and provisions by verification state."""
    state = F.coalesce("verification_status", F.lit("unresolved"))
    s = sources.select("source_id", state.alias("state"))
    n = provisions.groupBy("source_id").agg(F.count("*").alias("_p"))
    return s.join(n, "source_id", "left").groupBy("state").agg(F.count("*").alias("sources"), F.sum(F.coalesce("_p", F.lit(0))).alias("provisions"))


def quality_verdict(df: DataFrame, min_width: int = 640, min_height: int = 480) -> DataFrame:
    """Reasons against a capture from its scores; acceptable when there is none."""
    overall = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("sharpness") * 0.9 + (1 - F.col("glare")) * 0.1))
    reasons = F.array_compact(F.array(
        F.when((F.col("width") < min_width) | (F.col("height") < min_height), "resolution"), F.when(F.col("blur") > 0.45, "blur"),
        F.when(F.col("glare") > 0.60, "glare"), F.when(F.abs("skew_degrees") > 8.0, "skew"), F.when(overall < 0.55, "overall")))
    return df.withColumn("overall", F.round(overall, 4)).withColumn("reasons", reasons).withColumn("acceptable", F.size("reasons") == 0)


# ---- retrieval ----------------------------------------------------------------------------------

def retrieval_flags(ranked: DataFrame, queries: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query what its top ranks say. ``ranked(query_id, rank, provision_id, rule_id, score)``,
    ``expected(query_id, provision_id, rule_id)``."""
    e = expected.select(F.col("query_id").alias("_q"), F.col("provision_id").alias("_p"))
    hits = ranked.join(e, (F.col("query_id") == F.col("_q")) & (F.col("provision_id") == F.col("_p")), "left")
    rules = expected.select(F.col("query_id").alias("_rq"), F.col("rule_id").alias("_r")).distinct()
    scored = hits.join(rules, (F.col("query_id") == F.col("_rq")) & (F.col("rule_id") == F.col("_r")), "left").groupBy("query_id").agg(
        F.bool_or((F.col("rank") == 1) & F.col("_p").isNotNull()).alias("top1"), F.bool_or((F.col("rank") <= 3) & F.col("_p").isNotNull()).alias("top3"),
        F.bool_or((F.col("rank") == 1) & F.col("_r").isNotNull()).alias("right_rule"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"))
    applicable = expected.select("query_id").distinct().withColumn("applicable", F.lit(True))
    no = F.lit(False)
    j = queries.join(applicable, "query_id", "left").join(scored, "query_id", "left")
    return j.select("query_id", "style", F.coalesce("applicable", no).alias("applicable"), F.coalesce("top1", no).alias("top1_correct"),
                    F.coalesce("top3", no).alias("top3_hit"), (~F.coalesce("right_rule", no)).alias("wrong_rule"),
                    (F.coalesce("right_rule", no) & ~F.coalesce("top1", no)).alias("wrong_field"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"))


def retrieval_metrics(flags: DataFrame) -> DataFrame:
    a = F.col("applicable")
    share = lambda c, of: F.round(F.try_divide(F.count_if(of & c), F.count_if(of)), 4)
    hard = a & F.col("style").startswith("adversarial")
    return flags.agg(F.count_if(a).alias("applicable_queries"), F.count_if(~a).alias("no_result_queries"),
                     share(F.col("top1_correct"), a).alias("top1_accuracy"), share(F.col("top3_hit"), a).alias("top3_recall"),
                     share(F.col("wrong_rule"), a).alias("wrong_rule_rate"), share(F.col("wrong_field"), a).alias("wrong_field_rate"),
                     share(~F.col("top1_correct"), hard).alias("adversarial_class_b_rate"))


def threshold_sweep(flags: DataFrame, thresholds: tuple[float, ...] = SWEEP) -> DataFrame:
    """Abstained, retained and withheld per threshold: six counters in one pass."""
    a, right, s = F.col("applicable"), F.col("top1_correct"), F.col("top_score")
    wide = flags.agg(F.count_if(~a).alias("_none"), *[x for i, th in enumerate(thresholds) for x in (
        F.count_if(~a & (s < th)).alias(f"_a{i}"), F.count_if(a & right & (s >= th)).alias(f"_k{i}"), F.count_if(a & right & (s < th)).alias(f"_w{i}"))])
    rows = F.array(*[F.struct(F.lit(th).alias("threshold"), F.col(f"_a{i}").alias("abstained"), F.col("_none").alias("no_result_total"),
                              F.col(f"_k{i}").alias("retained"), F.col(f"_w{i}").alias("withheld")) for i, th in enumerate(thresholds)])
    return wide.select(F.inline(rows))


def by_style(flags: DataFrame) -> DataFrame:
    return flags.where("applicable").groupBy("style").agg(F.count_if("top1_correct").alias("correct"), F.count("*").alias("total"))


NUMBER = r"\b\d[\d,]*(?:\.\d+)?\s*%?"
CLAUSE = r"Rule\s+\d+(?:\([^)]+\))*"


def numbers_in(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(n, r"[,%\s]", "")))


def clauses_in(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("(?i)" + CLAUSE), F.lit(0)), strip))


def groundedness(answers: DataFrame) -> DataFrame:
    """``(answer_id, answer, cited_text, cited_clauses array, n_citations)``: numbers and clauses of the answer that
    no citation backs, and answers without citations. A blank answer is grounded."""
    nums = F.array_except(numbers_in(F.col("answer")), numbers_in(F.coalesce("cited_text", F.lit(""))))
    clauses = F.array_except(clauses_in(F.col("answer")), F.col("cited_clauses"))
    blank = F.length(F.coalesce("answer", F.lit(""))) == 0
    staged = answers.withColumn("unsupported_numbers", F.when(blank, 0).otherwise(F.size(nums))).withColumn(
        "unsupported_clauses", F.when(blank, 0).otherwise(F.size(clauses))).withColumn("uncited", ~blank & (F.col("n_citations") == 0))
    return staged.withColumn("grounded", (F.col("unsupported_numbers") == 0) & (F.col("unsupported_clauses") == 0) & ~F.col("uncited"))


def groundedness_rate(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("answers"), F.round(F.try_divide(F.count_if("grounded"), F.count("*")), 4).alias("rate"),
                      F.count_if(~F.col("grounded")).alias("ungrounded"))
