"""Sliding-window admission per client: a hit is admitted while fewer than ``limit`` admitted hits lie in the window."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from claimweave.operators.windows import running_total

ORIGIN = 86_400  # seconds: event times start a day after the epoch, so that hits counted from zero are not late at once
RESULT = "client bigint, hit bigint, at double, admitted boolean, wait bigint"


def decide(recent: list[float], now: float, window: float, limit: int) -> tuple[list[float], bool, int]:
    """One step: drop expired hits, then admit or say how long to wait. Refused hits leave no trace."""
    live = [h for h in recent if now - h < window]
    if len(live) < limit:
        return live + [now], True, 0
    return live, False, max(1, int(window - (now - live[0])) + 1)


def decide_all(recent: list[float], at: list[float], window: float, limit: int) -> tuple[list[float], list[bool], list[int]]:
    """``decide`` over hits in time order; a stretch of refused hits is found by bisection and answered as a whole."""
    admitted, waits, i = [False] * len(at), [0] * len(at), 0
    while i < len(at):
        recent = [h for h in recent if at[i] - h < window]
        if len(recent) < limit:
            recent.append(at[i])
            admitted[i] = True
            i += 1
            continue
        oldest = recent[0] if recent else float("inf")
        end = bisect_left(at, window, lo=i, key=lambda t: t - oldest) if recent else len(at)
        waits[i:end] = [max(1, int(window - (t - oldest)) + 1) if recent else 1 for t in at[i:end]]
        i = end
    return recent, admitted, waits


class Admission(StatefulProcessor):
    """Keeps at most ``limit`` admitted times per client, and none once the watermark is a window past the last of them."""

    def __init__(self, window: float, limit: int) -> None:
        self.window, self.limit = window, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent = [r[0] for r in self.hits.get()] if self.hits.exists() else []
        # A micro-batch, bounded by the reader's trigger options, may bring a client's hits in any order; only their
        # times and numbers are held.
        parts = [(p["hit"].to_numpy(), p["at"].to_numpy()) for p in rows]
        hit, at = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.lexsort((hit, at))
        hit, at = hit[order], at[order]
        recent, admitted, waits = decide_all(recent, at.tolist(), self.window, self.limit)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if recent:
            self.hits.put([(h,) for h in recent])
            self.handle.registerTimer(int((recent[-1] + self.window + ORIGIN) * 1000) + 1)
        else:
            self.hits.clear()
        yield pd.DataFrame({"client": key[0], "hit": hit, "at": at, "admitted": admitted, "wait": waits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.hits.clear()
        return iter([])

    def close(self) -> None:
        pass


def admission_stream(hits: DataFrame, window: float, limit: int, late: str = "1 minute") -> DataFrame:
    """Streaming (client, hit, at) to decisions; batches arrive in time order, hits within a batch in any order.

    ``at`` is in seconds and is the event time; hits more than ``late`` behind the newest one of earlier batches are
    dropped, as Spark's watermark does. A timer ends a client's state one window after its last admitted hit.
    """
    timed = hits.select("client", "hit", "at", F.timestamp_micros(((F.col("at") + ORIGIN) * 1000000).cast("bigint")).alias("_time")).withWatermark("_time", late)
    return timed.groupBy("client").transformWithStateInPandas(
        statefulProcessor=Admission(window, limit), outputStructType=RESULT, outputMode="Append", timeMode="EventTime")


def sessions(hits: DataFrame, window: float) -> DataFrame:
    """``session`` numbers runs of hits without a pause of a whole window; earlier runs cannot influence later ones.

    Blocks of time keep a busy client from being sorted in one task: pauses inside a block are seen in the block, pauses
    across blocks from each block's first and last hit.
    """
    block = max(window * 64, 1.0)
    b = hits.withColumn("_b", F.floor(F.col("at") / block))
    ends = b.groupBy("client", "_b").agg(F.max("at").alias("_last"))
    prior = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy("client").orderBy("_b"))).drop("_last")
    inside = Window.partitionBy("client", "_b").orderBy("at", "hit")
    j = b.join(prior, ["client", "_b"]).withColumn("_prev", F.coalesce(F.lag("at").over(inside), F.col("_before")))
    starts = j.withColumn("_start", F.when(F.col("_prev").isNull() | (F.col("at") - F.col("_prev") >= window), 1).otherwise(0))
    micros = starts.withColumn("_t", F.round(F.col("at") * 1000000).cast("bigint"))
    # Hits at the same instant share a session, so only the first of them can start one.
    numbered = running_total(micros, ["client"], "_t", F.col("_start"), "_seen", block=int(block * 1000000), ties=("hit",))
    return numbered.withColumn("session", F.col("_seen") + F.col("_start")).select("client", "hit", "at", "session")


def admission_batch(hits: DataFrame, window: float, limit: int) -> DataFrame:
    """The same decisions over a finished table: sessions are sorted and read row by row, holding ``limit`` times at most."""
    ordered = sessions(hits, window).repartition("client", "session").sortWithinPartitions("client", "session", "at", "hit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, recent = None, []
        for batch in batches:
            out = []
            for client, hit, at, session in zip(batch["client"], batch["hit"], batch["at"], batch["session"]):
                if (client, session) != group:
                    group, recent = (client, session), []
                recent, ok, wait = decide(recent, at, window, limit)
                out.append((client, hit, at, ok, wait))
            yield pd.DataFrame(out, columns=["client", "hit", "at", "admitted", "wait"])

    return ordered.mapInPandas(run, RESULT)


def hits_in_window(hits: DataFrame, window: float) -> DataFrame:
    """How many hits of the client, refused ones included, lie in the window that ends at each hit."""
    range_ = Window.partitionBy("client", "session").orderBy("_t").rangeBetween(-int(window * 1000000) + 1, 0)
    rows = sessions(hits, window).withColumn("_t", F.round(F.col("at") * 1000000).cast("bigint"))
    return rows.withColumn("in_window", F.count("*").over(range_)).select("client", "hit", "in_window")
