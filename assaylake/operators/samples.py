"""Samples, manifests, identity, coverage, costs and leaderboards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.finance import token_cost
from assaylake.operators.numbering import numbered
from assaylake.sources.tables import stash


def round_robin(samples: DataFrame, n: int | None, *by: str, stratum: str = "task_family", order: str = "pos") -> DataFrame:
    """The samples taken in turn from the sorted strata, each in its own order; of each ``by`` the first n."""
    if n is None:
        return numbered(samples, [*by, stratum], [order], "turn")
    place = Window.partitionBy(*by, stratum).orderBy(order)  # of each stratum n rows at most are kept while sorting
    first = samples.withColumn("turn", F.row_number().over(place)).where(F.col("turn") <= n)
    taken = Window.partitionBy(*by).orderBy("turn", stratum)
    return first.withColumn("place", F.row_number().over(taken)).where(F.col("place") <= n)


def interleave(samples: DataFrame, *by: str, stratum: str = "task_family", order: str = "pos") -> DataFrame:
    """The samples with their ``place`` when the sorted strata are taken in turn.

    A place follows from the sizes of the strata alone: all that earlier turns took, and the strata before this one that still
    have a sample. The samples of a stratum are numbered range by range, so a stratum of all samples is spread over all tasks.
    """
    turned = numbered(samples, [*by, stratum], [order], "turn")
    sizes = samples.groupBy(*by, stratum).agg(F.count("*").alias("n")).groupBy(*by).agg(F.collect_list(F.struct(F.col(stratum).alias("s"), "n")).alias("strata"))  # a few for each group
    joined = turned.join(sizes, list(by)) if by else turned.crossJoin(sizes)
    taken = F.aggregate("strata", F.lit(0).cast("long"), lambda total, x: total + F.least(x["n"], (F.col("turn") - 1).cast("long")) + F.when((x["s"] < F.col(stratum)) & (x["n"] >= F.col("turn")), 1).otherwise(0).cast("long"))
    return joined.withColumn("place", taken + 1).drop("strata")


def manifest_rows(samples: DataFrame, manifest: DataFrame) -> DataFrame:
    """The samples that a manifest lists, with their place in it; an id that no sample has raises.

    :param manifest: ``sample_id``, ``place``.
    """
    joined = manifest.join(samples, "sample_id", "left")
    missing = F.coalesce(F.col("benchmark"), F.raise_error(F.concat(F.lit("no such sample: "), F.col("sample_id"))).cast("string"))
    return joined.withColumn("benchmark", missing)


def concatenate(*parts: DataFrame) -> DataFrame:
    """The samples of several sources, with the place of their source as ``source_place``."""
    out = None
    for i, part in enumerate(parts):
        marked = part.withColumn("source_place", F.lit(i))
        out = marked if out is None else out.unionByName(marked)
    return out


def head(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n samples, by their source and their place in it, with ``place`` from 1."""
    by = list(order) or ["source_place", "pos"]
    first = rows.orderBy(*by).limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*by)))  # n rows


#: Characters of joined ids in a piece that is hashed at a time.
PIECE_CHARS = 1 << 20


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (group, range, id) as (group, range, piece, number of ids, ids joined by line ends)."""
    current, ids, size, piece = None, [], 0, 0
    names = ["group", "part", "piece", "n", "ids"]
    made = lambda: pa.RecordBatch.from_pylist([dict(zip(names, (*current, piece, len(ids), "\n".join(ids)), strict=True))], schema=pa.schema([("group", pa.string()), ("part", pa.int32()), ("piece", pa.int64()), ("n", pa.int64()), ("ids", pa.string())]))
    for batch in batches:
        for group, part, key in zip(*(batch.column(c).to_pylist() for c in ("group", "part", "id")), strict=True):
            if ids and ((group, part) != current or size >= PIECE_CHARS):
                yield made()
                ids, size, piece = [], 0, piece + 1
            current = group, part
            ids.append(key)
            size += len(key) + 1
    if ids:
        yield made()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of ids and the hash of each group from its pieces in order, one piece in memory at a time."""
    current, n, digest, found = None, 0, hashlib.sha256(), []
    for batch in batches:
        for group, more, ids in zip(*(batch.column(c).to_pylist() for c in ("group", "n", "ids")), strict=True):
            if group != current:
                if current is not None:
                    found.append((current, n, digest.hexdigest()[:16]))
                current, n, digest = group, 0, hashlib.sha256()
            if more:
                digest.update(("\n" if n else "").encode() + ids.encode())
                n += more
    if current is not None:
        found.append((current, n, digest.hexdigest()[:16]))
    for group, count, text in found:
        yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([count]), pa.array([text])], names=["group", "n_ids", "id_hash"])


def id_set_hash(samples: DataFrame, *by: str, key: str = "sample_id") -> DataFrame:
    """The first 16 hex digits of the hash of the sorted distinct ids; null ids do not count.

    The ids are made distinct and sorted over all tasks, joined to pieces of about a million characters there, and a group's hash, which
    is sequential by its definition, reads the pieces in order: no row and no memory holds a group.
    """
    # a group's name is one text, so that a table of any columns, nulls among them, sorts by it
    group = F.to_json(F.struct(*(F.col(b) for b in by)), {"ignoreNullFields": "false"}) if by else F.lit("")
    named = samples.select(*by, group.alias("group"), F.col(key).cast("string").alias("id"))
    groups = stash(named.groupBy("group").agg(*(F.first(b).alias(b) for b in by), F.count("id").alias("n_rows")) if by else named.agg(F.first(group).alias("_"), F.count("id").alias("n_rows")).select(F.lit("").alias("group"), "n_rows"))
    ids = named.where("id is not null").select("group", "id").distinct().repartitionByRange("group", "id").sortWithinPartitions("group", "id")
    schema = "group string, part int, piece long, n long, ids string"
    pieces = stash(ids.select("group", F.spark_partition_id().alias("part"), "id").mapInArrow(_pieces, schema))
    none = groups.select("group", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("n"), F.lit("").alias("ids"))
    ordered = pieces.unionByName(none).repartition("group").sortWithinPartitions("group", "part", "piece")
    return groups.join(ordered.mapInArrow(_hashes, "group string, n_ids long, id_hash string"), "group").select(*by, "n_ids", "id_hash")


def request_hash(*fields: str, version: int = 1) -> Column:
    """The identity of a request: a hash of its fields in the order of their names, and of the key version."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("key_version"), *(F.col(f) for f in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def short_hash(*parts: Column, size: int = 8) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, size)


def coverage(samples: DataFrame, *by: str) -> DataFrame:
    """Shares of samples that test text, Russian and tools, and whether refusals, injections, grounding and small businesses
    are tested at all; null without samples."""
    has = lambda t: F.array_contains("capability_tags", t)
    return samples.groupBy(*by).agg(
        F.count("*").alias("n_samples"), F.avg(has("table_text").cast("int")).alias("table_text_share"), F.avg(has("bilingual").cast("int")).alias("bilingual_share"),
        F.avg(has("multimodal").cast("int")).alias("multimodal_share"), F.avg(has("tool_use").cast("int")).alias("agentic_share"), F.bool_or("should_refuse").alias("has_refusal"), F.count_if(F.col("canary").isNotNull()).alias("n_injections"),
        F.bool_or(has("evidence_grounding")).alias("has_grounding"), F.count_if(has("retrieval")).alias("n_retrieval"),
    )


def cost_totals(predictions: DataFrame, prices: DataFrame, *by: str) -> DataFrame:
    """Tokens and dollars of each group; a call without a price or a count has no cost, and a group without any priced call
    has a null total, never 0.

    :param prices: ``model_ref``, ``prompt_price``, ``completion_price``: dollars for a million tokens.
    """
    joined = predictions.join(prices, "model_ref", "left")
    cost = token_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("prompt_price"), F.col("completion_price"))
    tokens = F.sum(F.coalesce(F.col("prompt_tokens"), F.lit(0)) + F.coalesce(F.col("completion_tokens"), F.lit(0)))
    return joined.withColumn("cost", cost).groupBy(*by).agg(
        F.count("*").alias("n_calls"), F.nullif(tokens, F.lit(0)).alias("tokens"), F.sum(F.col("cost").cast("decimal(24,8)")).alias("cost_usd"),
        F.count("cost").alias("n_priced"), F.avg(F.col("cache_hit").cast("int")).alias("cache_hit_rate"),
    )


def leaderboard(runs: DataFrame) -> DataFrame:
    """Ranked runs that count, and those that do not with the reason.

    Mock runs, runs over the smoke benchmark and runs without a score are left out of the ranks.

    :param runs: ``run_id``, ``provider``, ``run_type``, ``benchmark``, ``score``.
    """
    reason = F.when((F.col("provider") == "mock") | (F.col("run_type") != "real"), "not a real run").when(F.col("benchmark") == "smoke", "smoke benchmark").when(F.col("score").isNull(), "no score")
    marked = runs.withColumn("excluded_because", reason)
    order = Window.partitionBy("benchmark", F.col("excluded_because").isNull()).orderBy(F.desc("score"), "run_id")
    return marked.withColumn("rank", F.when(F.col("excluded_because").isNull(), F.row_number().over(order)))


def violations(samples: DataFrame, *keys: str) -> DataFrame:
    """Records that break a rule of the sample schema, one row for each rule broken."""
    c = F.col
    rules = {
        "empty_field": (c("sample_id") == "") | (c("benchmark") == "") | (c("task_family") == "") | (c("question") == ""),
        "id_prefix": ~F.startswith(c("sample_id"), F.concat(c("benchmark"), F.lit(":"), c("split"), F.lit(":"))),
        "translation_without_provenance": (c("language") != "en") & c("translation_provenance").isNull(),
    }
    named = F.filter(F.array(*(F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items())), lambda x: x.isNotNull())
    return samples.select(*keys, "sample_id", F.explode(named).alias("rule"))


def duplicate_ids(samples: DataFrame) -> DataFrame:
    return samples.groupBy("sample_id").count().where("count > 1")


def orphans(predictions: DataFrame, samples: DataFrame) -> DataFrame:
    """Predictions of samples that do not exist."""
    return predictions.join(samples, "sample_id", "left_anti")


def accuracy_by_corruption(cases: DataFrame, *by: str) -> DataFrame:
    """How often a judge is right about each kind of case; invalid verdicts do not count."""
    return cases.where("verdict is not null").groupBy(*by, "corruption").agg(F.count("*").alias("n"), F.avg((F.col("verdict") == F.col("should_be_correct")).cast("int")).alias("accuracy"))


def calibration_report(cases: DataFrame, *by: str) -> DataFrame:
    """How far a judge may be believed: accuracy, how often it passes wrong answers and fails right ones; verdicts that are
    null are invalid and count nowhere else.

    :param cases: ``should_be_correct``, ``verdict`` (boolean).
    """
    v, right = F.col("verdict"), F.col("should_be_correct")
    out = cases.groupBy(*by).agg(
        F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_invalid"), F.coalesce(F.avg((v == right).cast("int")), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.avg(F.when(~right, v.cast("int"))), F.lit(0.0)).alias("false_positive_rate"), F.coalesce(F.avg(F.when(right, (~v).cast("int"))), F.lit(0.0)).alias("false_negative_rate"),
    )
    return out.withColumn("passed", (F.col("n") > 0) & (F.col("accuracy") >= 0.75) & (F.col("false_positive_rate") <= 0.20))
