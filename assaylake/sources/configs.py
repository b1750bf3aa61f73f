"""Configuration files as small tables: manifests, groups and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _load(text: str) -> dict:
    import yaml

    found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError("a mapping is expected")
    return found


def _read(spark: SparkSession, path: str) -> dict:
    return _load(spark.read.text(path, wholetext=True).first()[0])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A sample manifest as (benchmark, split, place, sample_id); empty lists and repeated ids raise."""
    found = _read(spark, path)
    parts = found.get("benchmarks") or []
    ids = [i for p in parts for i in p.get("sample_ids") or []]
    if not parts or any(not p.get("sample_ids") for p in parts):
        raise ValueError("a manifest lists at least one benchmark, and each some samples")
    if len(set(ids)) != len(ids):
        raise ValueError("a manifest lists an id once")
    rows = [(p["name"], p["split"], i) for p in parts for i in p["sample_ids"]]
    return spark.createDataFrame([(found["name"], b, s, n, i) for n, (b, s, i) in enumerate(rows)], "manifest string, benchmark string, split string, place int, sample_id string")


def prices(spark: SparkSession, path: str) -> DataFrame:
    """Prices of models in dollars for a million tokens."""
    found = _read(spark, path).get("models") or {}
    return spark.createDataFrame([(m, float(p["prompt"]), float(p["completion"])) for m, p in found.items()], "model_ref string, prompt_price double, completion_price double")


def group(spark: SparkSession, path: str) -> DataFrame:
    """The benchmarks of a group with their splits and limits."""
    found = _read(spark, path)
    return spark.createDataFrame([(found["name"], b["name"], b["split"], b.get("limit"), float(b.get("weight", 1.0))) for b in found["benchmarks"]], "benchmark_group string, benchmark string, split string, limit int, weight double")


def models(spark: SparkSession, path: str) -> DataFrame:
    """The models of a configuration: provider, name and how they are asked; a model without a provider or a name raises."""
    found = _read(spark, path).get("models") or []
    if any(not m.get("provider") or not m.get("name") for m in found):
        raise ValueError("a model has a provider and a name")
    rows = [(f"{m['provider']}/{m['name']}", m["provider"], m["name"], float(m.get("temperature", 0.0)), int(m.get("max_tokens", 0)) or None) for m in found]
    return spark.createDataFrame(rows, "model_ref string, provider string, name string, temperature double, max_tokens int")
