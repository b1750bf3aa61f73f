"""Confidence intervals and paired comparison of runs."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIDENCE, ITERATIONS, SEED, LEAST_SAMPLES = 0.95, 2000, 42, 30
#: Cumulative Poisson(1) probabilities, from which resampling weights are drawn.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def hex_bound(p: float) -> str:
    """The hex digits at which a draw reaches a probability."""
    return f"{int(p * (1 << 32)):08x}"


#: Up to so many equal values their weights are drawn one by one; beyond it their sum is drawn.
SINGLE_DRAWS = 16


def _poisson_sum(n: Column, *label: Column) -> Column:
    """A draw of the sum of n Poisson(1) weights from the digests of a label: one by one, or by its normal form with the correction
    for skewness, which is then exact to a unit or so."""

    def digest(*more: Column) -> Column:
        return F.md5(F.concat_ws(":", *label, *(m.cast("string") for m in more)).cast("binary"))

    def one(u: Column) -> Column:
        weight = F.lit(len(POISSON))
        for w, bound in reversed(list(enumerate(POISSON))):
            weight = F.when(u < hex_bound(bound), w).otherwise(weight)
        return weight

    single = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(SINGLE_DRAWS)).cast("int")), F.lit(0), lambda s, j: s + one(F.substring(digest(j), 1, 8)))
    part = lambda k: F.conv(F.substring(digest(), 8 * k + 1, 8), 16, 10).cast("double") / float(1 << 32)
    z = F.sqrt(-2 * F.ln(part(0) + 0.5 / (1 << 32))) * F.cos(2 * F.pi() * part(1))
    return F.when(n <= SINGLE_DRAWS, single.cast("double")).otherwise(F.greatest(F.lit(0.0), F.floor(n + F.sqrt(n.cast("double")) * z + (z * z - 1) / 6 + 0.5).cast("double")))


def bootstrap(rows: DataFrame, *by: str, value: str = "value", iterations: int = ITERATIONS, confidence: float = CONFIDENCE) -> DataFrame:
    """Percentile intervals of means by Poisson resampling: each row has an independent Poisson(1) weight in each iteration.

    Rows of a group with the same value only matter by the sum of their weights, so values are counted first, which combines
    before the shuffle, and an iteration draws once for each distinct value, from a digest that any engine can compute.
    A group of one row has its value for both ends.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    each = counts.select(*by, "v", "c", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("i"))
    weighed = each.withColumn("w", _poisson_sum(F.col("c"), *(F.col(b).cast("string") for b in by), F.col("v").cast("string"), F.col("i").cast("string")))
    means = weighed.groupBy(*by, "i").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.round("m", 9)))  # one number for each iteration
    tail = (1 - confidence) / 2
    cuts = means.groupBy(*by).agg(ordered.alias("ms")).select(*by, F.get("ms", F.floor(tail * F.size("ms")).cast("int")).alias("low"), F.get("ms", F.least(F.floor((1 - tail) * F.size("ms")), F.size("ms") - 1).cast("int")).alias("high"))
    plain = counts.groupBy(*by).agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    both = plain.join(cuts, list(by)) if by else plain.crossJoin(cuts)  # single rows
    one = F.col("n") == 1
    return both.select(*by, "n", "mean", F.when(one, F.col("mean")).otherwise(F.col("low")).alias("ci_low"), F.when(one, F.col("mean")).otherwise(F.col("high")).alias("ci_high"), (F.col("n") < LEAST_SAMPLES).alias("underpowered"))


#: Words that are drawn at a time where the sums of draws do not depend on their order.
DRAW_WORDS = 1 << 16


def _whole_sums(words: np.random.MT19937, data: np.ndarray, iterations: int) -> np.ndarray:
    """For each iteration the sum of as many draws as there are values, all whole numbers: drawn in short blocks, whatever n is, as no
    order of the sum changes it."""
    n, done, sums = len(data), 0, np.zeros(iterations)
    data = data.astype(np.int8 if np.abs(data).max() < 128 else np.int64)  # a small table of values is looked up faster
    shift = np.uint64(32 - n.bit_length())
    while done < iterations * n:
        drawn = words.random_raw(DRAW_WORDS) >> shift
        found = data[drawn[drawn < n][: iterations * n - done]]
        if len(found):
            starts = np.append(0, np.arange(n - done % n, len(found), n))
            sums[done // n : done // n + len(starts)] += np.add.reduceat(found, starts, dtype=np.int64)
            done += len(found)
    return sums


def exact_interval(values: list[float], confidence: float = CONFIDENCE, iterations: int = ITERATIONS, seed: int = SEED) -> tuple[float, float, float] | None:
    """Mean and interval by resampling with the standard generator, in the order of the values.

    The generator's draws below n are its 32-bit words cut to the bits of n, those that reach n left out; they are made in bulk.
    """
    if not len(values):
        return None
    data = np.asarray(values, dtype=float)
    n, mean = len(data), float(data.mean())
    if n == 1:
        return mean, mean, mean
    words = np.random.MT19937()
    _, state, _ = random.Random(seed).getstate()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], dtype=np.uint32), "pos": state[-1]}}
    is_whole = bool(np.all(data == np.floor(data))) and float(np.abs(data).max()) * n < 1 << 53
    shift, spare = np.uint64(32 - n.bit_length()), np.zeros(0, dtype=np.int64)
    means = [float(x) / n for x in _whole_sums(words, data, iterations)] if is_whole else []
    for _ in range(iterations - len(means)):
        while len(spare) < n:
            drawn = (words.random_raw(max(4096, 3 * n)) >> shift).astype(np.int64)
            spare = np.concatenate([spare, drawn[drawn < n]])
        means.append(float(data[spare[:n]].sum()) / n)
        spare = spare[n:]
    means.sort()
    tail = (1.0 - confidence) / 2.0
    return mean, means[int(tail * iterations)], means[min(int((1.0 - tail) * iterations), iterations - 1)]


def exact_bootstrap(rows: DataFrame, by: str, order: str, value: str = "value", iterations: int = ITERATIONS) -> DataFrame:
    """The interval of each group as a sequential generator gives it; for groups of run size, read in order in one task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = exact_interval(group.sort_values(order)[value].dropna().tolist(), iterations=iterations)
        n = int(group[value].notna().sum())
        return pd.DataFrame({by: [group[by].iloc[0]], "n": [n], "mean": [found and found[0]], "ci_low": [found and found[1]], "ci_high": [found and found[2]], "underpowered": [n < LEAST_SAMPLES]})

    return rows.select(by, order, value).groupBy(by).applyInPandas(run, f"{by} string, n long, mean double, ci_low double, ci_high double, underpowered boolean")


def paired(a: DataFrame, b: DataFrame, *by: str, key: str = "sample_id", value: str = "value") -> DataFrame:
    """The scores of two runs on the samples that both have."""
    left = a.where(F.col(value).isNotNull()).select(*by, key, F.col(value).alias("value_a"))
    right = b.where(F.col(value).isNotNull()).select(*by, key, F.col(value).alias("value_b"))
    return left.join(right, [*by, key]).withColumn("value", F.col("value_a") - F.col("value_b"))


def discordance(pairs: DataFrame, *by: str) -> DataFrame:
    """Counts of pairs in which one run is better, both score, or neither does."""
    a, b = F.col("value_a"), F.col("value_b")
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n_paired"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.count_if(a > b).alias("a_right_b_wrong"), F.count_if(b > a).alias("b_right_a_wrong"),
        F.count_if((a > 0) & (b > 0)).alias("both_right"), F.count_if((a == 0) & (b == 0)).alias("both_wrong"),
    )


def is_significant(ci_low: Column, ci_high: Column, n: Column) -> Column:
    """The interval excludes zero, and there are enough pairs to say so."""
    return ((ci_low > 0) | (ci_high < 0)) & (n >= LEAST_SAMPLES)


def verdict(name_a: str, name_b: str) -> Column:
    """A sentence about columns n, mean, ci_low and ci_high of a paired comparison."""
    few = F.concat(F.lit("Too few pairs ("), F.col("n").cast("string"), F.lit(f") to tell {name_a} from {name_b}."))
    better = F.when(F.col("mean") > 0, F.lit(f"{name_a} beats {name_b}")).otherwise(F.lit(f"{name_b} beats {name_a}"))
    told = F.format_string("%s by %.3f, interval [%+.3f, %+.3f].", better, F.abs("mean"), F.col("ci_low"), F.col("ci_high"))
    unsure = F.format_string(f"No significant difference between {name_a} and {name_b}: %+.3f, interval [%+.3f, %+.3f].", F.col("mean"), F.col("ci_low"), F.col("ci_high"))
    return F.when(F.col("n") < LEAST_SAMPLES, few).when(is_significant(F.col("ci_low"), F.col("ci_high"), F.col("n")), told).otherwise(unsure)
