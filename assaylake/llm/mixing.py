"""Mixing of sources to target weights by exact cuts in a random order.

Every document gets a hash-random key. Within a source the documents are dealt into equal ranges of the key;
the sums of the ranges give each range the number of words that lie before it, and a running sum inside the
range does the rest. So the order of a whole source is cut at its exact budget while no task sees more than a
range. A budget beyond the size of its source runs through the source again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm._common import partitions, stash, unused

SEED = 17
#: A source may be repeated so many times.
MAX_EPOCHS = 3
#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: Ranges of the key for each shuffle partition.
RANGES_PER_PARTITION = 2
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _targets(sources: DataFrame) -> DataFrame:
    """Budgets of the sources by water filling: all sizes together are shared by weight, no source above its cap.

    With the sources in the order of cap per weight, the level at a source is what is left when those before it
    stand at their caps, for each unit of the remaining weight. The highest of these levels is the final one.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weights = F.array(*(F.lit(w) for w in WEIGHTS))
    rows = sources.withColumn("weight", F.element_at(weights, ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    steps = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest = steps.rowsBetween(Window.unboundedPreceding, -1), steps.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level)
    target = F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, prefix: str = "mix_") -> DataFrame:
    """What the mix takes of each document.

    :return: the columns of ``docs`` and ``mix_size``, ``mix_source_size``, ``mix_target``, ``mix_taken``: words
        of the document and its source, the budget of the source, words taken with repeats counted. Columns of
        ``docs`` that start with the prefix are left out.

    A null source is a source of its own, the last one. Null and empty texts have size 0 and are taken 0 times.
    Repeated rows are documents of their own and follow each other. The last document of a budget is taken in
    part, from its start. An empty table gives an empty result. The key depends on id and seed alone, so
    reruns agree.
    """
    n = lambda name: f"{prefix}{name}"
    rows = docs.drop(*(c for c in docs.columns if c.lower().startswith(prefix.lower())))
    ranges = RANGES_PER_PARTITION * partitions(docs.sparkSession)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    sized = rows.select("*", word_count(text_col).alias(n("size")), F.substring(digest, 1, 16).alias(n("key")), F.xxhash64(text_col).alias(n("tie")))
    sized = sized.withColumn(n("range"), F.floor(F.conv(F.substring(n("key"), 1, 8), 16, 10).cast("double") / float(1 << 32) * ranges).cast("int"))
    parts = stash(sized.groupBy(F.col(source_col).alias("source"), F.col(n("range")).alias("part")).agg(F.sum(n("size")).alias("part_size")))
    inside = Window.partitionBy("source").orderBy("part")
    offsets = parts.select("source", "part", F.coalesce(F.sum("part_size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_offset"))
    targets = _targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")))
    plan = offsets.join(targets.withColumnRenamed("source", "target_source"), F.col("source").eqNullSafe(F.col("target_source")))
    plan = plan.select(F.col("source").alias(n("source")), F.col("part").alias(n("part")), F.col("part_offset").alias(n("offset")), F.col("source_size").alias(n("source_size")), F.col("target").alias(n("target")))
    joined = sized.join(plan, sized[source_col].eqNullSafe(plan[n("source")]) & (sized[n("range")] == plan[n("part")]))
    order = Window.partitionBy(source_col, n("range")).orderBy(n("key"), id_col, n("size"), n("tie"))
    start = F.col(n("offset")) + F.coalesce(F.sum(n("size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    budget = F.floor(F.col(n("target")) + 0.5).cast("long")
    size = F.greatest(F.col(n("source_size")), F.lit(1))
    epochs = F.floor(budget / size).cast("long")
    taken = epochs * F.col(n("size")) + F.greatest(F.lit(0), F.least(F.col(n("size")), budget - epochs * size - F.col(n("start"))))
    out = joined.withColumn(n("start"), start).withColumn(n("taken"), taken.cast("long"))
    return out.select(*rows.columns, n("size"), n("source_size"), n("target"), n("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: a document once for each time that it is taken whole, and
    the first words of the one at which a budget ends, whose ``n_chars`` is counted anew."""
    prefix = unused(docs, "mix_")
    size, taken, left, copies, copy = (f"{prefix}{x}" for x in ("size", "taken", "left", "copies", "copy"))
    mixed = mix(docs, id_col, text_col, source_col, seed, prefix)
    words = F.greatest(F.col(size), F.lit(1))
    whole = F.when(F.col(size) > 0, F.floor(F.col(taken) / words)).otherwise(0).cast("int")
    rows = mixed.withColumn(left, F.when(F.col(size) > 0, F.col(taken) % words).otherwise(0).cast("int")).withColumn(copies, F.array_repeat(F.lit(0), whole))
    rows = rows.withColumn(copy, F.explode(F.when(F.col(left) > 0, F.array_append(copies, F.col(left))).otherwise(F.col(copies))))
    head = F.regexp_extract(text_col, r"^[\x20\x09-\x0D]*", 0)
    first = F.slice(F.regexp_extract_all(text_col, F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1)), F.lit(1), F.col(copy))
    text = F.when(F.col(copy) == 0, F.col(text_col)).otherwise(F.rtrim(F.concat(head, F.array_join(first, ""))))
    out = rows.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(copy) == 0, F.col("n_chars")).otherwise(F.length(text_col).cast("long")))
    return out.select(*docs.columns)


#: The mix in SQL, over the table ``documents``.
ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS k
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source),
steps AS (
  SELECT *, {MAX_EPOCHS} * source_size AS cap,
         (CAST(sum(source_size) OVER () AS DOUBLE)
          - CAST(coalesce(sum({MAX_EPOCHS} * source_size) OVER (ORDER BY {MAX_EPOCHS} * source_size / weight, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(weight) OVER (ORDER BY {MAX_EPOCHS} * source_size / weight, source NULLS LAST
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM src),
targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM steps),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((budget // greatest(source_size, 1)) * size
            + greatest(0, least(size, budget - (budget // greatest(source_size, 1)) * greatest(source_size, 1) - start)) AS BIGINT) AS taken
FROM placed
"""
