"""The tables of a run from its samples and stored predictions, without any model call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.operators import failures, metrics, rollup, samples, scoring, stats
from assaylake.sources.tables import stash

#: What the tables after the metrics need of a prediction, besides ``run_id``.
KEPT = ("run_id", "pos", "sample_id", "benchmark", "task_family", "capability_tags", "gold", "should_refuse", "canary", "has_response", "error_type", "content", "predicted", "refused", "has_answer", "canary_stated")


def join_predictions(asked: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each prediction with the sample that it answers; a prediction of a sample that is not there raises, for then the
    data have changed under the run. Samples without a prediction were not asked."""
    known = asked.withColumn("asked_here", F.lit(True))
    only = [c for c in known.columns if c == "sample_id" or c not in predictions.columns]
    joined = predictions.join(known.select(only), "sample_id", "left")
    there = F.coalesce("asked_here", F.raise_error(F.concat(F.lit("a prediction answers a sample that does not exist: "), "sample_id")).cast("boolean"))
    return joined.where(there).drop("asked_here")


def told(rows: DataFrame) -> DataFrame:
    """The rows with what their answers state: ``predicted``, ``refused``, ``has_answer``, ``canary_stated``."""
    known = metrics.read(rows)
    read = known.withColumns({"predicted": F.col("_read_number"), "refused": metrics.answered() & F.col("_read_refused"), "has_answer": metrics.answered()})
    return read.withColumn("canary_stated", F.col("canary").isNotNull() & (F.abs(F.col("predicted") - F.col("canary").cast("double")) < 1))


def results(rows: DataFrame, *more: str) -> DataFrame:
    """The results that the registry's metrics give, each benchmark its own."""
    return metrics.score_run(rows, *KEPT, *more)


def preferred(rows: DataFrame, *more: str) -> DataFrame:
    """The results of the metric that counts for each benchmark."""
    return metrics.score_run(rows, *KEPT, *more, only_preferred=True)


def counting(found: DataFrame) -> DataFrame:
    """Of the results those of the metric that counts."""
    return found.where(F.col("metric_name") == metrics.preferred_metric(F.col("benchmark")))


def dimension_means(found: DataFrame) -> DataFrame:
    """Means of capability dimensions for each run, from its results; every sample has one of exact match."""
    keyed = found.withColumn("sample_id", F.concat_ws("/", "run_id", "sample_id"))
    once = keyed.where("metric_name = 'exact_match'")
    scored = rollup.dimension_results(once, keyed.select("sample_id", "metric_name", "value", "passed"), metrics.preferred_metric(F.col("benchmark")))
    return rollup.macro_rollup(scored.withColumn("run_id", F.substring_index("sample_id", "/", 1)), "run_id")


def tool_security(tool_results: DataFrame, *by: str) -> DataFrame:
    """The mean of the security metric over the traces to which it applies; null if there is none."""
    return tool_results.where("metric_name = 'tool_security_rejection'").groupBy(*by).agg(F.avg(rollup.score(F.col("value"), F.col("passed"))).alias("tool_security"))


def rates(graded: DataFrame, security: DataFrame | None = None) -> DataFrame:
    """Failure rates of each run.

    :param graded: results of the preferred metric. :param security: ``run_id``, ``tool_security``; without it untested.
    """
    found = scoring.run_rates(failures.classify(graded))
    return found if security is None else found.drop("tool_security").join(security, "run_id", "left")


def sample_scores(found: DataFrame, run: str, metric: str) -> DataFrame:
    """The scores that one run's samples have by a metric, without those to which it does not apply."""
    return found.where((F.col("run_id") == run) & (F.col("metric_name") == metric)).select("sample_id", rollup.score(F.col("value"), F.col("passed")).alias("value")).where("value is not null")


def reattribute(failed: DataFrame, retrieved: DataFrame, graded: DataFrame) -> DataFrame:
    """Failures with the cause that the retrieval gives them; those of samples without a retrieval keep theirs. The catastrophic
    mark stays as it was.

    :param retrieved: ``run_id``, ``sample_id``, ``document_hit``, ``page_hit``. :param graded: ``run_id``, ``sample_id``, ``passed``, ``refused``.
    """
    keys = ["run_id", "sample_id"]
    hit = retrieved.select(*keys, "document_hit", "page_hit")
    right = graded.select(*keys, F.coalesce("passed", F.lit(False)).alias("answer_correct"), F.coalesce("refused", F.lit(False)).alias("answer_refused"))
    joined = failed.drop("passed", "refused").join(hit, keys, "left").join(right, keys, "left")
    cause = failures.retrieval_cause(F.coalesce("answer_correct", F.lit(False)), F.col("document_hit"), F.col("page_hit"), F.coalesce("answer_refused", F.lit(False)), F.col("failure_type"))
    out = joined.withColumn("failure_type", F.when(F.col("document_hit").isNull(), F.col("failure_type")).otherwise(cause))
    return out.drop("document_hit", "page_hit", "answer_correct", "answer_refused")


def artifacts(rows: DataFrame, prices: DataFrame, traces: DataFrame | None = None, mocks: Column | None = None) -> dict[str, DataFrame]:
    """The tables of all runs in ``rows``, each with ``run_id``: what a run leaves behind.

    :param rows: predictions with their samples, as :func:`told` gives them, with ``model_ref`` and token counts.
    :param traces: tool traces, for runs with tools. :param mocks: which runs come from a mock.
    """
    from assaylake.operators.tools import tool_metrics

    every = stash(results(rows))  # scored once; all tables below read it
    graded = counting(every)
    used = None if traces is None else tool_metrics(traces)
    rate = stash(rates(graded, None if used is None else tool_security(used, "run_id")))
    gates, means = scoring.gate_report(rate), dimension_means(every)
    every = every.select("run_id", "sample_id", "metric_name", "value", "passed")
    every = every if used is None else every.unionByName(used)
    critical = gates.groupBy("run_id").agg(F.coalesce(F.bool_or(F.col("critical") & ~F.col("passed")), F.lit(False)).alias("critical_failed"))
    has = rows.groupBy("run_id").agg(
        F.bool_or(F.col("benchmark") == "smb_cfo").alias("has_smb_cfo"), F.bool_or(F.array_contains("capability_tags", "evidence_grounding")).alias("has_grounding"), F.bool_or("should_refuse").alias("has_refusal"), F.bool_or(F.lit(False) if mocks is None else mocks).alias("is_mock"),
    )
    penalty = scoring.reliability_penalty(F.col("catastrophic"), F.col("unsupported"), F.col("invalid"), F.col("n_scored"))
    runs = rate.select("run_id", "n_scored", penalty.alias("penalty")).join(critical, "run_id", "left").fillna(False, ["critical_failed"]).join(has, "run_id")
    scored = scoring.capability_index(means, runs)
    return {
        "parsed_answers": rows.select("run_id", "sample_id", "answer", "number", "unit", "flag", "has_answer"),
        "errors": rows.where(~F.col("has_response")).select("run_id", "sample_id", "error_type"),
        "metric_details": every.select("run_id", "sample_id", "metric_name", "value", "passed"),
        "metrics": rollup.metric_aggregate(every, "run_id"),
        "confidence_intervals": stats.bootstrap(every.withColumn("value", rollup.score(F.col("value"), F.col("passed"))), "run_id", "metric_name"),
        "failures": failures.attribute(graded).select("run_id", "pos", "sample_id", "benchmark", "failure_type", "catastrophic", "gold", "predicted", "content"),
        "capabilities": means,
        "gates": gates,
        "scores": scored.withColumn("verdict", scoring.verdict(F.col("overall"), F.col("n_scored"), F.col("critical_failed"), F.col("is_mock"))),
        "coverage": samples.coverage(rows, "run_id"),
        "costs": samples.cost_totals(rows, prices, "run_id"),
    }
