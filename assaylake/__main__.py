"""``python -m assaylake``: the registered queries, and the work on stored runs.

    python -m assaylake list | explain QUERY --data DIR | run QUERY --data DIR [--out PATH] [--format parquet|json|csv]
    python -m assaylake list-benchmarks | validate --samples FILE.jsonl
    python -m assaylake rescore --runs DIR [--run ID]       from DIR/samples.parquet, predictions.parquet and prices.parquet
    python -m assaylake report --runs DIR --run ID          | compare --runs DIR --run A --with B --metric NAME
    python -m assaylake leaderboard --runs DIR --out DIR    | capability-report --runs DIR
    python -m assaylake freeze-manifest --samples FILE.jsonl --take N --out DIR
    python -m assaylake release-build --runs DIR --out DIR  | checksums --out DIR
    python -m assaylake retrieval-eval --data DIR           | calibrate-judge --cases DIR
    python -m assaylake cache-stats --cache DIR             | cache-clear --cache DIR
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.operators import evaluation, reports, samples, stats
from assaylake.plans import ORACLES, QUERIES
from assaylake.sources import benchmarks, sinks

Given = argparse.Namespace


def _read(spark: SparkSession, given: Given, name: str) -> DataFrame:
    return spark.read.parquet(f"{given.runs}/{name}.parquet")


def _show(df: DataFrame) -> None:
    df.show(200, truncate=80)


def _query(spark: SparkSession, given: Given) -> None:
    found = QUERIES[given.query](spark, given.data)
    if given.action == "explain":
        found.explain("formatted")
    elif given.out:
        found.write.mode("errorifexists").format(given.format).save(given.out)
    else:
        _show(found)


def rescore(spark: SparkSession, given: Given) -> None:
    """All tables of the stored runs anew from their predictions; no model is asked."""
    rows = evaluation.told(evaluation.join_predictions(_read(spark, given, "samples"), _read(spark, given, "predictions")))
    sinks.write_artifacts(evaluation.artifacts(rows, _read(spark, given, "prices")), given.runs, given.run)


def report(spark: SparkSession, given: Given) -> None:
    tables = {n: _read(spark, given, n) for n in ("metrics", "gates", "failures")}
    print(sinks.summary(*(df.where(F.col("run_id") == given.run) for df in tables.values())))


def compare(spark: SparkSession, given: Given) -> None:
    """The paired comparison of two runs by a metric, over the samples that both answered."""
    found = _read(spark, given, "metric_details")
    a, b = (evaluation.sample_scores(found, run, given.metric) for run in (given.run, given.other))
    pairs = stats.paired(a, b)
    _show(stats.discordance(pairs))
    _show(stats.bootstrap(pairs).withColumn("verdict", stats.verdict(given.run, given.other)))


def leaderboard(spark: SparkSession, given: Given) -> None:
    scores = _read(spark, given, "scores")
    records = reports.board_records(_read(spark, given, "environments"), scores, _read(spark, given, "capabilities"), _read(spark, given, "metrics"), _read(spark, given, "gates"), _read(spark, given, "coverage"))
    ranked = samples.leaderboard(records.withColumn("score", F.col("index"))).select("run_id", "benchmark", "score", "verdict", "excluded_because", "rank")
    sinks.write_board(ranked, given.out)


def release_build(spark: SparkSession, given: Given) -> None:
    """The manifest of the runs that belong to a release, and the checksums of what was written."""
    made = reports.release_manifest(_read(spark, given, "environments").where("run_type = 'real'"), _read(spark, given, "predictions"))
    sinks.write_json_lines(made, f"{given.out}/release_manifest.json")
    _show(sinks.checksums(spark, given.out))


def freeze_manifest(spark: SparkSession, given: Given) -> None:
    rows = benchmarks.jsonl_samples(spark, given.samples).withColumn("pos", F.col("sample_id"))
    sinks.write_json_lines(samples.round_robin(rows, given.take, "benchmark", "split").select("benchmark", "split", "place", "sample_id"), given.out)


def validate(spark: SparkSession, given: Given) -> None:
    """Read the samples in their schema and fail on any record that breaks a rule."""
    rows = benchmarks.jsonl_samples(spark, given.samples)
    broken, repeated = samples.violations(rows), samples.duplicate_ids(rows)
    _show(broken)
    if broken.count() or repeated.count():
        raise SystemExit(1)


ACTIONS: dict[str, tuple[Callable[[SparkSession, Given], None], tuple[str, ...]]] = {
    "run": (_query, ("query", "data")), "explain": (_query, ("query", "data")), "rescore": (rescore, ("runs",)), "report": (report, ("runs", "run")), "compare": (compare, ("runs", "run", "other", "metric")), "leaderboard": (leaderboard, ("runs", "out")),
    "release-build": (release_build, ("runs", "out")), "freeze-manifest": (freeze_manifest, ("samples", "take", "out")), "validate": (validate, ("samples",)),
    "list-benchmarks": (lambda spark, given: _show(benchmarks.manifests(spark)), ()), "capability-report": (lambda spark, given: _show(_read(spark, given, "capabilities").orderBy("run_id", "dimension")), ("runs",)),
    "checksums": (lambda spark, given: _show(sinks.checksums(spark, given.out)), ("out",)), "retrieval-eval": (lambda spark, given: _show(QUERIES["retrieval_ablation"](spark, given.data).orderBy("arm", "k")), ("data",)),
    "calibrate-judge": (lambda spark, given: _show(samples.calibration_report(spark.read.parquet(given.cases))), ("cases",)),
    "cache-stats": (lambda spark, given: _show(sinks.cache_stats(spark, given.cache)), ("cache",)), "cache-clear": (lambda spark, given: sinks.clear_cache(spark, given.cache), ("cache",)),
}


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="assaylake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("action", choices=("list", *ACTIONS))
    parser.add_argument("query", nargs="?")
    for name in ("data", "out", "runs", "run", "metric", "samples", "cases", "cache"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--with", dest="other")
    parser.add_argument("--take", type=int)
    parser.add_argument("--format", default="parquet", choices=("parquet", "json", "csv"))
    given = parser.parse_args(args)
    if given.action == "list":
        print("\n".join(f"{name}{'' if name in ORACLES else '  (no SQL oracle)'}" for name in sorted(QUERIES)))
        return 0
    act, needed = ACTIONS[given.action]
    missing = [n for n in needed if getattr(given, n) is None]
    if missing or "query" in needed and given.query not in QUERIES:
        parser.error(f"{given.action} needs {', '.join(missing) or 'a registered query'}")
    act(SparkSession.builder.appName(f"assaylake {given.action}").config("spark.sql.session.timeZone", "UTC").getOrCreate(), given)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
