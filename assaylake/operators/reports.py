"""Tables and texts about many runs: the board, releases and their gates, and what a mission asks."""

from __future__ import annotations

import html
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.operators import samples

#: Least cells of an ablation in a release.
LEAST_CELLS = 18
# What a mission asks, and the metrics or figures that answer it.
QUESTIONS = (
    (1, "Can it calculate financial answers correctly?", ("finqa_answer_accuracy", "finqa_execution_accuracy", "tatqa_exact_match", "finance_reasoning_accuracy")),
    (2, "Can it reason over a conversation?", ("turn_accuracy", "full_conversation_accuracy", "context_loss", "propagation_effect", "recovery_rate")),
    (3, "Can it find the evidence?", ("document_hit", "page_hit", "recall", "mrr", "ndcg")),
    (4, "Can it do a small business's books?", ("smb_cfo_accuracy", "smb_cfo_refusal_correctness")),
    (5, "Is it safe?", ("smb_cfo_injection_resistance", "tool_security_rejection", "filings_qa_unsupported_numeric_claim", "secque_unsupported_numeric_claim")),
)
MARKS = {True: "pass", False: "FAIL", None: "skipped"}


def board_records(environments: DataFrame, scores: DataFrame, capabilities: DataFrame, metrics: DataFrame, gates: DataFrame, coverage: DataFrame) -> DataFrame:
    """A record of each run for the board, from its artefacts; a run stays without those that it lacks. A run of a mock provider is a
    mock test if it does not say what it is; a run without an index is provisional.

    :param environments: ``run_id``, ``model_ref``, ``provider``, ``run_type``, ``benchmark``.
    """
    fold = lambda df, key, value, name: df.where(F.col(value).isNotNull()).groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))  # noqa: E731  a few names of one run
    failed = gates.groupBy("run_id").agg(F.coalesce(F.bool_or(F.col("critical") & ~F.col("passed")), F.lit(False)).alias("critical_gate_failed"))
    kind = F.coalesce("run_type", F.when(F.col("provider") == "mock", "mock_test").otherwise("real"))
    out = environments.withColumn("run_type", kind).join(scores.select("run_id", "index", "verdict"), "run_id", "left").join(fold(capabilities, "dimension", "mean", "capability_scores"), "run_id", "left")
    out = out.join(fold(metrics, "metric_name", "mean", "native_scores"), "run_id", "left").join(failed, "run_id", "left").join(coverage.select("run_id", "n_samples"), "run_id", "left")
    return out.withColumns({"critical_gate_failed": F.coalesce("critical_gate_failed", F.lit(False)), "provisional": F.col("index").isNull(), "eligible": (F.col("run_type") == "real") & (F.col("benchmark") != "smoke")})


def release_manifest(runs: DataFrame, predictions: DataFrame) -> DataFrame:
    """The runs of a release with the number and the hash of the samples that they answered."""
    asked = samples.id_set_hash(predictions, "run_id").withColumnRenamed("n_ids", "n_samples").withColumnRenamed("id_hash", "sample_id_set_hash")
    return runs.join(asked, "run_id")


def release_gates(manifest: DataFrame, frozen: DataFrame, cells: DataFrame, current: str) -> DataFrame:
    """What data can tell of a release: one row for each gate, ``passed`` null where there is nothing to check.

    :param manifest: of :func:`release_manifest`, with ``run_type`` and ``fingerprint``. :param frozen: ``sample_id_set_hash`` of the
        frozen manifests. :param cells: cells of the retrieval ablation.
    """
    known = frozen.select(F.col("sample_id_set_hash").alias("frozen_hash")).distinct()
    facts = manifest.join(known, F.col("sample_id_set_hash") == F.col("frozen_hash"), "left").agg(
        F.count("*").alias("n"), F.count_if(F.col("fingerprint") != current).alias("other"), F.countDistinct("fingerprint").alias("prints"), F.count_if(F.col("run_type") != "real").alias("mocks"),
        F.count_if(F.col("n_samples") == 0).alias("empty"), F.count_if(F.col("frozen_hash").isNull()).alias("unfrozen"),
    )
    some = F.col("n") > 0
    checks = {
        "one_fingerprint": (some, F.col("prints") == 1, F.col("prints")), "current_fingerprint": (some, F.col("other") == 0, F.col("other")), "no_mock_runs": (some, F.col("mocks") == 0, F.col("mocks")),
        "frozen_samples": (some, F.col("unfrozen") == 0, F.col("unfrozen")), "runs_have_predictions": (some, F.col("empty") == 0, F.col("empty")), "ablation_cells": (F.col("cells") > 0, F.col("cells") >= LEAST_CELLS, F.col("cells")),
    }
    both = facts.crossJoin(cells.agg(F.count("*").alias("cells")))  # single rows
    return both.select(F.inline(F.array(*(F.struct(F.lit(name).alias("gate_name"), F.when(there, ok).alias("passed"), seen.cast("long").alias("observed")) for name, (there, ok, seen) in checks.items()))))


def mission_answers(figures: DataFrame) -> DataFrame:
    """The figures that answer each question of a mission, by run; a question without any is not measured.

    :param figures: ``run_id``, ``name``, ``value``: means of metrics, of conversations and of retrieval.
    """
    wanted = F.inline(F.array(*(F.struct(F.lit(n).alias("question"), F.lit(text).alias("asked"), F.lit(name).alias("name")) for n, text, names in QUESTIONS for name in names)))
    asked = figures.sparkSession.range(1).select(wanted)
    found = asked.join(figures.where("value is not null"), "name")
    open_ = asked.select("question", "asked").distinct().join(found.select("question").distinct(), "question", "left_anti")
    none = open_.select("question", "asked", F.lit(None).cast("string").alias("run_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("value"))
    return found.select("question", "asked", "run_id", "name", "value").unionByName(none).withColumn("measured", F.col("value").isNotNull())


def shown_failures(failed: DataFrame, most: int = 5) -> DataFrame:
    """Failures that stand for the rest of each run, in the order of the samples: the first catastrophic ones, or where there is
    none the first of any kind."""
    from pyspark.sql import Window

    marked = failed.withColumn("any_bad", F.max("catastrophic").over(Window.partitionBy("run_id"))).where(F.col("catastrophic") | ~F.col("any_bad"))
    return marked.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("pos"))).where(F.col("place") <= most).drop("any_bad")


def page(title: str, parts: Iterable[tuple[str, DataFrame]]) -> str:
    """An HTML page with a table for each small DataFrame; null is shown as not measured, booleans as pass, FAIL or skipped."""

    def cell(value: object, kind: str) -> str:
        if kind == "boolean":
            return MARKS[value]
        return "&mdash;" if value is None else html.escape(f"{value:.4f}" if isinstance(value, float) else str(value))

    out = [f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in parts:
        kinds = dict(df.dtypes)
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>")
        out += [f"<tr>{''.join(f'<td>{cell(r[c], kinds[c])}</td>' for c in df.columns)}</tr>" for r in df.collect()]  # reports are small tables
        out.append("</table>")
    return "\n".join([*out, "</body></html>"])


def backoff_delay(sample_id: Column, attempts: Column, base: float = 1.0, longest: float = 60.0, retry_after: Column | None = None) -> Column:
    """Seconds to wait after some attempts: full jitter below an exponential bound, from a digest of the sample and the attempt."""
    bound = F.least(F.lit(longest), F.lit(base) * F.pow(F.lit(2.0), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(30))))
    share = F.conv(F.substring(F.md5(F.concat_ws(":", sample_id, attempts.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return F.greatest(share * bound, F.coalesce(retry_after, F.lit(0.0)) if retry_after is not None else F.lit(0.0))
