"""Conversations of a stream of turns, kept as keyed state: each turn leaves with what was said before it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "conv_id long, turn long, place long, status string, families array<string>, history array<struct<role:string,content:string>>"


class Histories(StatefulProcessor):
    """State of a conversation: the turns said, in a list, and the place of the last turn that has left.

    Turns leave in the order of their numbers within what has come. A turn not above the last one that left is late: it leaves with
    status ``late`` and no history, and changes nothing; so does a number that comes again. When the watermark is ``idle_ms`` beyond the
    latest time of a conversation's turns it is closed: one row with status ``closed`` and its families in the order of their first
    appearance, and its state goes; what comes for it afterwards begins anew.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.said = handle.getListState("said", "question string, answer string, family string")
        self.last = handle.getValueState("last", "turn long, n long, latest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        come = sorted((row for frame in rows for row in zip(frame["turn"], frame["question"], frame["model_answer"], frame["task_family"], frame["ms"], strict=True)), key=lambda r: (int(r[0]), *map(str, r[1:])))
        last, n, latest = self.last.get() if self.last.exists() else (None, 0, 0)
        told, fresh = [(str(q), str(a)) for q, a, _ in self.said.get()], []
        out = []
        for turn, question, answer, family, ms in come:
            latest = max(latest, int(ms))
            if last is not None and turn <= last:
                out.append((key[0], int(turn), None, "late", None, None))
                continue
            history = [{"role": role, "content": text} for q, a in told for role, text in (("user", q), ("assistant", a))]
            last, n = int(turn), n + 1
            out.append((key[0], last, n, "turn", None, history))
            told.append((question or "", answer or ""))
            fresh.append((question or "", answer or "", family or ""))
        if fresh:
            self.said.appendList(fresh)
        self.last.update((last, n, latest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(latest + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "place", "status", "families", "history"]).astype({"turn": "Int64", "place": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        families = list(dict.fromkeys(family for _, _, family in self.said.get()))
        last, n, _ = self.last.get()
        self.said.clear()
        self.last.clear()
        yield pd.DataFrame([(key[0], last, n, "closed", families, None)], columns=["conv_id", "turn", "place", "status", "families", "history"]).astype({"turn": "Int64", "place": "Int64"})


def with_histories(turns: DataFrame, idle_ms: int = 3_600_000, late: str = "1 hour") -> DataFrame:
    """A stream of ``conv_id``, ``turn``, ``question``, ``model_answer``, ``task_family``, ``ts`` as ``OUTPUT`` rows.

    Nulls in texts count as empty; rows with a null conversation, turn or time take no part, nor do rows more than ``late`` behind the
    latest time seen. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), whose checkpoint lies in the
    query's checkpoint folder, so a restart goes on with every history.
    """
    known = turns.dropna(subset=["conv_id", "turn", "ts"]).select("conv_id", "turn", "question", "model_answer", "task_family", "ts").fillna("", ["question", "model_answer", "task_family"])
    timed = known.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("conv_id").transformWithStateInPandas(Histories(idle_ms), OUTPUT, "Append", "EventTime")
