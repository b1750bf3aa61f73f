"""Keyed state of conversations over restarts, and digests of files of any size."""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assaylake.operators import conversation
from assaylake.sources import sinks
from assaylake.streaming import histories

TURNS = "conv_id long, turn long, question string, model_answer string, task_family string, ts timestamp"
AT = datetime(2024, 5, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _run(spark, tmp_path, idle_ms=3_600_000):
    stream = spark.readStream.schema(TURNS).parquet(str(tmp_path / "in"))
    out = histories.with_histories(stream, idle_ms).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
    query = out.trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(45)
    finally:
        query.stop()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def _add(spark, tmp_path, rows, minute=0):
    spark.createDataFrame([(*r, AT + timedelta(minutes=minute)) for r in rows], TURNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_histories_go_on_after_a_restart(spark, rocks, tmp_path):
    first = [(1, 0, "q0", "a0", "f"), (1, 1, "q1", None, "g"), (2, 0, "x", "y", "f"), (None, 0, "n", "n", "f"), (3, None, "n", "n", "f")]
    second = [(1, 3, "q3", "a3", "f"), (1, 2, "q2", "a2", "f"), (1, 1, "again", "again", "f")]
    _add(spark, tmp_path, first)
    assert len(_run(spark, tmp_path)) == 3
    _add(spark, tmp_path, second)
    got = {(r.conv_id, r.turn, r.status): r for r in _run(spark, tmp_path)}
    assert set(got) == {(1, 0, "turn"), (1, 1, "turn"), (2, 0, "turn"), (1, 2, "turn"), (1, 3, "turn"), (1, 1, "late")}
    assert got[1, 1, "late"].history is None
    kept = spark.createDataFrame([r for r in first + second if r[0] == 1 and r[2] != "again"], TURNS.rsplit(",", 1)[0])
    want = {r.turn: [(h.role, h.content) for h in r.history] for r in conversation.with_model_history(kept).collect()}
    assert {t: [(h.role, h.content) for h in r.history] for (c, t, s), r in got.items() if c == 1 and s == "turn"} == want
    assert [got[1, t, "turn"].place for t in range(4)] == [1, 2, 3, 4]


def test_silent_conversations_are_closed(spark, rocks, tmp_path):
    _add(spark, tmp_path, [(1, 0, "q", "a", "late_fees"), (1, 1, "q", "a", "cash"), (1, 2, "q", "a", "late_fees")])
    assert len(_run(spark, tmp_path, 60_000)) == 3
    _add(spark, tmp_path, [(2, 0, "q", "a", "cash")], minute=600)
    closed = [r for r in _run(spark, tmp_path, 60_000) if r.status == "closed" and r.conv_id == 1]
    assert [(r.turn, r.place, r.families) for r in closed] == [(2, 3, ["late_fees", "cash"])]


def test_digests_of_small_and_large_files_agree(spark, tmp_path):
    (tmp_path / "deep dir").mkdir()
    for name, size in (("a.bin", 1), ("b 1%.bin", 5_000), ("deep dir/c.bin", 9_000_001)):
        (tmp_path / name).write_bytes(bytes(i % 251 for i in range(min(size, 5_000))) * max(1, size // 5_000))
    want = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.rglob("*.bin")}
    for whole in (0, 5_000, 1 << 30):
        got = sinks.checksums(spark, str(tmp_path), whole).collect()
        assert {r.path.rsplit("/", 1)[1]: r.sha256 for r in got} == want


def test_a_file_beyond_what_a_value_holds(spark, tmp_path):
    with open(tmp_path / "sparse.bin", "wb") as f:
        f.truncate(3 << 30)
    digest = hashlib.sha256()
    for _ in range(3 << 10):
        digest.update(bytes(1 << 20))
    got = sinks.checksums(spark, str(tmp_path)).first()
    assert (got.length, got.sha256) == (3 << 30, digest.hexdigest())
    assert sinks.checksums(spark, str(tmp_path)).select(F.max("length")).first()[0] == 3 << 30
