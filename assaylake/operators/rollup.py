"""Metric aggregates: not applicable is not zero, and averages are taken level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the capability dimensions, and the tags that feed them.
DIMENSION_WEIGHTS = {
    "numerical_accuracy": 0.20, "financial_formula_reasoning": 0.15, "table_text_reasoning": 0.12, "document_grounding": 0.12, "retrieval_quality": 0.08,
    "analytical_insight": 0.10, "conversation_consistency": 0.07, "calibration_and_refusal": 0.10, "bilingual_en_ru": 0.03, "tool_use_reliability": 0.03,
}
TAG_DIMENSION = {
    "calculation": "numerical_accuracy", "formula": "financial_formula_reasoning", "ratio": "financial_formula_reasoning", "table_text": "table_text_reasoning",
    "evidence_grounding": "document_grounding", "retrieval": "retrieval_quality", "analysis": "analytical_insight", "insight": "analytical_insight",
    "conversation": "conversation_consistency", "calibration_refusal": "calibration_and_refusal", "bilingual": "bilingual_en_ru", "tool_use": "tool_use_reliability",
}
DIMENSION_METRIC = {"calibration_and_refusal": "smb_cfo_refusal_correctness", "document_grounding": "secque_filing_identification", "table_text_reasoning": "secque_numeric_agreement"}


def score(value: Column, passed: Column) -> Column:
    """The number that a result counts as: null if the metric did not apply; a result without a number counts by its pass."""
    return F.when(value.isNotNull(), value.cast("double")).otherwise(passed.cast("int").cast("double"))


def metric_aggregate(results: DataFrame, *by: str) -> DataFrame:
    """For each metric the applicable results, those that are not, and the mean of the former (null if there is none)."""
    s = score(F.col("value"), F.col("passed"))
    return results.groupBy(*by, "metric_name").agg(F.count(s).alias("n"), F.count_if(s.isNull()).alias("n_not_applicable"), F.avg(s).alias("mean"))


def dimensions(samples: DataFrame, tags: str = "capability_tags") -> DataFrame:
    """Each sample with each capability dimension that its tags feed; unknown tags feed none."""
    names = F.create_map(*(F.lit(x) for pair in TAG_DIMENSION.items() for x in pair))
    fed = F.array_distinct(F.filter(F.transform(F.col(tags), lambda t: F.try_element_at(names, t)), lambda d: d.isNotNull()))
    return samples.withColumn("dimension", F.explode(fed))


def dimension_results(samples: DataFrame, results: DataFrame, preferred: str | Column) -> DataFrame:
    """The result that counts for each sample and dimension: that of the dimension's own metric where there is one, also
    if it did not apply, else that of the preferred metric, which is a name or a column of the samples."""
    chosen = F.lit(preferred) if isinstance(preferred, str) else preferred
    own = F.create_map(*(F.lit(x) for pair in DIMENSION_METRIC.items() for x in pair))
    wanted = dimensions(samples).select("sample_id", "benchmark", "task_family", "dimension", F.try_element_at(own, F.col("dimension")).alias("own_metric"), chosen.alias("preferred_metric"))
    r = results.select("sample_id", "metric_name", score(F.col("value"), F.col("passed")).alias("score"))
    is_own = F.col("metric_name") == F.col("own_metric")
    joined = wanted.join(r, "sample_id").where(is_own | (F.col("metric_name") == F.col("preferred_metric")))
    best = F.max_by("score", F.coalesce(is_own, F.lit(False)).cast("int"))
    return joined.groupBy("sample_id", "benchmark", "task_family", "dimension").agg(best.alias("score"))


def macro_rollup(scored: DataFrame, *by: str) -> DataFrame:
    """Means of dimensions: samples to families, families to benchmarks, benchmarks to the dimension, each level with equal
    weights. Samples without a score do not count."""
    graded = scored.where("score is not null")
    family = graded.groupBy(*by, "dimension", "benchmark", "task_family").agg(F.avg("score").alias("score"), F.count("*").alias("n"))
    bench = family.groupBy(*by, "dimension", "benchmark").agg(F.avg("score").alias("score"), F.sum("n").alias("n"))
    return bench.groupBy(*by, "dimension").agg(F.avg("score").alias("mean"), F.sum("n").alias("n"))


def pass_rates(results: DataFrame, *by: str) -> DataFrame:
    """The share of passes among the results that were graded."""
    return results.where("passed is not null").groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("passed").cast("int")).alias("pass_rate"))
