"""What a run leaves behind: tables, exports and a cache of responses."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.operators import reports


def write_run(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of runs as Parquet, each split by run."""
    for name, df in tables.items():
        (df.write.partitionBy("run_id") if "run_id" in df.columns else df.write).mode("overwrite").parquet(f"{path}/{name}.parquet")


def load_runs(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of the runs that are complete: those with rows in every table named."""
    read = {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}
    whole = None
    for df in read.values():
        ids = df.select("run_id").distinct()
        whole = ids if whole is None else whole.join(ids, "run_id")
    return {n: df.join(whole, "run_id", "left_semi") for n, df in read.items()}


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a schema; a line that is no such record fails the read, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def cached(requests: DataFrame, cache: DataFrame, key: str = "request_hash") -> tuple[DataFrame, DataFrame]:
    """The requests with a stored response, and those without."""
    return requests.join(cache, key), requests.join(cache, key, "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def append_to_cache(responses: DataFrame, cache_path: str, key: str = "request_hash") -> None:
    """Add responses to the cache, parted by the first two digits of their key; what is there stays, and a key is stored once."""
    new = responses.dropDuplicates([key]).withColumn("shard", F.substring(key, 1, 2))
    if _exists(responses.sparkSession, cache_path):
        there = responses.sparkSession.read.parquet(cache_path).select("shard", key)
        new = new.join(there, ["shard", key], "left_anti")
    new.write.mode("append").partitionBy("shard").parquet(cache_path)


def cache_stats(spark: SparkSession, cache_path: str) -> DataFrame:
    """The number of stored responses, and of shards that have any; zero for a cache that is not there."""
    if not _exists(spark, cache_path):
        return spark.createDataFrame([(0, 0)], "n_responses long, n_shards long")
    return spark.read.parquet(cache_path).agg(F.count("*").alias("n_responses"), F.countDistinct("shard").alias("n_shards"))


def clear_cache(spark: SparkSession, cache_path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file, in whatever store the path names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def write_artifacts(tables: dict[str, DataFrame], path: str, run: str | None = None) -> None:
    """All tables of runs as Parquet, split by run, and for one run its metrics, gates, scores, costs and coverage as JSON lines, a summary
    in Markdown and a report in HTML."""
    write_run(tables, path)
    if run is None:
        return
    spark = next(iter(tables.values())).sparkSession
    read = {n: spark.read.parquet(f"{path}/{n}.parquet").where(F.col("run_id") == run) for n in tables}
    for name in ("metrics", "confidence_intervals", "capabilities", "gates", "scores", "costs", "coverage", "failures", "errors"):
        write_json_lines(read[name].coalesce(1), f"{path}/{run}/{name}.json")
    write_text(spark, summary(read["metrics"], read["gates"], read["failures"]), f"{path}/{run}/summary.md")
    parts = [("Scores", read["scores"].select("verdict", "index", "withheld_because", "n_scored")), ("Metrics", read["metrics"].drop("run_id").orderBy("metric_name")), ("Gates", read["gates"].drop("run_id").orderBy("gate_name")), ("Capabilities", read["capabilities"].drop("run_id").orderBy("dimension")), ("Failures", reports.shown_failures(read["failures"]).select("sample_id", "failure_type", "catastrophic"))]
    write_text(spark, reports.page(f"Run {run}", parts), f"{path}/{run}/report.html")


def write_board(records: DataFrame, path: str) -> None:
    """The ranked runs as CSV, Markdown and HTML, those left out as CSV beside them, and all as JSON lines."""
    spark = records.sparkSession
    ranked, out = records.where("excluded_because is null").orderBy("benchmark", "rank"), records.where("excluded_because is not null").orderBy("run_id")
    write_csv(ranked.coalesce(1), f"{path}/leaderboard.csv")
    write_csv(out.coalesce(1), f"{path}/excluded.csv")
    write_json_lines(records, f"{path}/leaderboard.json")
    lines = ["| " + " | ".join(ranked.columns) + " |", "|" + "-|" * len(ranked.columns), *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in ranked.collect())]
    write_text(spark, "\n".join(lines) + "\n", f"{path}/leaderboard.md")
    write_text(spark, reports.page("Leaderboard", [("Ranked", ranked), ("Left out", out)]), f"{path}/leaderboard.html")


#: Files up to this size are digested as one value; larger ones, up to any size, as a stream.
WHOLE_BYTES, PIECE_BYTES = 64 << 20, 8 << 20


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digests of files that are read piece by piece; no more than a piece is in memory."""
    from pyarrow.fs import FileSystem

    for frame in frames:
        for path, length in zip(frame["path"], frame["length"], strict=True):
            scheme, rest = path.split(":", 1)
            scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
            files, place = FileSystem.from_uri(f"{scheme}:{'' if rest.startswith('//') else '//'}{quote(rest, safe='/:@')}")
            digest = hashlib.sha256()
            with files.open_input_stream(place) as stream:
                while piece := stream.read(PIECE_BYTES):
                    digest.update(piece)
            yield pd.DataFrame({"path": [path], "length": [length], "sha256": [digest.hexdigest()]})


def checksums(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """SHA-256 of every file below a folder, by path, whatever its size: a value of a row ends at 2 GB, a file does not.

    Files beyond ``whole_bytes`` are read in pieces by the tasks, through the file system that their path names, each file
    by a task of its own; a digest is sequential, so a single file is not split. Spark lists no files without a byte, so they have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.where(F.col("length") <= whole_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole_bytes).select("path", "length").repartition("path")
    return small.unionByName(large.mapInPandas(_digests, "path string, length long, sha256 string")).orderBy("path")


def summary(metrics: DataFrame, gates: DataFrame, failures: DataFrame, most: int = 5) -> str:
    """A short report of one run in Markdown: metrics, gates, and the failures that stand for the rest, in the order of the samples."""
    mark = {True: "pass", False: "FAIL", None: "skipped"}
    lines = ["| metric | n | mean |", "|-|-|-|"]
    lines += [f"| {r.metric_name} | {r.n} | {'not applicable' if r.mean is None else f'{r.mean:.4f}'} |" for r in metrics.orderBy("metric_name").collect()]
    lines += ["", "| gate | observed | limit | |", "|-|-|-|-|"]
    lines += [f"| {r.gate_name} | {'-' if r.observed is None else r.observed} | {r.threshold} | {mark[r.passed]} |" for r in gates.orderBy("gate_name").collect()]
    shown = reports.shown_failures(failures.withColumn("run_id", F.lit("")) if "run_id" not in failures.columns else failures, most).orderBy("pos")
    lines += ["", *(f"- {r.sample_id}: {r.failure_type}" for r in shown.collect())]
    return "\n".join(lines) + "\n"
