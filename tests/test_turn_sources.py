"""Which earlier answers programs use, against all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import conversation

SCHEMA = "conv_id int, turn int, program string, answer string"


def _brute(rows):
    """All operands against all earlier answers, by arrays."""
    import re

    found = {(c, t): set() for c, t, _, _ in rows if c is not None and t is not None}
    for conv in {c for c, _ in found}:
        own = [r for r in rows if r[0] == conv and r[1] is not None]
        said = []
        for _, t, _, a in own:
            try:
                value = float(a)
            except (TypeError, ValueError):
                continue
            if math.isfinite(value):
                said.append((t, value))
        at, values = np.array([t for t, _ in said]), np.array([v for _, v in said])
        for _, t, program, _ in own:
            plain = re.sub(r"#\d+", "", re.sub(r"const_[\d_]+", "", program or ""))
            for x in re.findall(r"(?<![#\w.])(-?\d+(?:\.\d+)?)", plain):
                near = np.abs(float(x) - values) <= 1e-4 * np.maximum(np.abs(values), 1.0)
                found[conv, t] |= {int(s) for s in at[near & (at < t)]}
    return {k: sorted(v) for k, v in found.items()}


def _got(spark, rows):
    out = conversation.turn_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({(r.conv_id, r.turn) for r in out}) == len(out)
    return {(r.conv_id, r.turn): r.sources for r in out}


def test_ten_thousand_turns_equal_all_pairs(spark):
    draw = random.Random(9)
    number = lambda: f"{draw.choice([-1, 1]) * 10 ** draw.uniform(-3, 7):.4f}"
    rows, said = [], ["1.0"]
    for turn in range(10_000):
        reused = float(draw.choice(said)) * (1 + draw.choice([0, 9.9e-5, -9.9e-5, 1.01e-4]))
        rows.append((1, turn, f"add({reused:.6f}, {number()}), divide(#0, const_1000)", number() if turn % 7 else "yes"))
        said = [*said[-400:], rows[-1][3]] if turn % 7 else said
    got = _got(spark, rows)
    assert got == _brute(rows) and sum(map(len, got.values())) > 5_000


@pytest.mark.parametrize("a", [0.0, 1e-5, 0.99995, 1.0, 1.00005, -1.0, 2.5, -1e-4, 123456.0, -9.9e9])
def test_the_edge_of_the_tolerance(spark, a):
    rows = [(1, 0, None, repr(a))]
    for i, step in enumerate((-1.02, -0.98, 0, 0.98, 1.02)):
        rows.append((1, i + 1, f"add({a + step * 1e-4 * max(abs(a), 1):.9f}, const_1)", "no"))
    assert {t: s for (_, t), s in _got(spark, rows).items()} == {0: [], 1: [], 2: [0], 3: [0], 4: [0], 5: []}


def test_odd_rows(spark):
    rows = [
        (1, 0, "", "5"), (1, 0, None, "7"), (1, 1, "add(5, 7)", "inf"), (1, 1, "add(5, 7)", "inf"), (1, 2, "add(#5, const_7)", None), (1, 3, "add(12, 12)", "nan"),
        (None, 1, "add(5, 7)", "5"), (1, None, "add(5, 7)", "5"), (2, 5, "add(5, 7)", "5"), (2, 4, "add(5, 5)", "9"),
    ]
    got = _got(spark, rows)
    assert got == _brute(rows) == {(1, 0): [], (1, 1): [0], (1, 2): [], (1, 3): [], (2, 4): [], (2, 5): []}
    assert _got(spark, []) == {}


def test_the_join_is_on_cells_and_feeds_the_analysis(spark):
    rows = [(1, 0, "", "5"), (1, 1, "add(5, const_1)", "6"), (1, 2, "add(6, 5)", "11")]
    turns = spark.createDataFrame(rows, SCHEMA)
    found = conversation.turn_sources(turns)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "cell" in plan.split("Join Inner")[1].split("\n")[0]
    told = found.withColumn("passed", F.col("turn") != 1)
    got = conversation.analyse(told).first()
    assert (got.n_dependent_turns, got.n_poisoned_turns) == (2, 1)
