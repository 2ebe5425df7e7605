"""Streams by key in the order of their events: progress of jobs with heartbeat and deadline, spaced-repetition state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from studymill.operators.scheduling import FIRST_EASE, FIRST_INTERVAL

from .states import after

#: Silence after which a heartbeat is due, the time after its first event at which a job has failed, and the phase that ends it (fixed values).
BEAT_S, DEADLINE_S, LAST_PHASE = 20, 285, 7


class InOrder(StatefulProcessor):
    """Rows of a key wait until the watermark has passed them, and are then taken in the order of (time, number), each number once.

    So late rows within the watermark's delay change nothing, and repeated ones are one. Subclasses say what a row does
    (take) and what time alone does (advance): what is due before a row's time is done before the row is taken, for timers
    that are set while others run out are called only with the next batch. They keep a row of ``memory``.
    """

    waiting = ""  #: columns of a row besides its time and number
    memory = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "at long, number long", self.waiting)
        self.known = handle.getValueState("known", "upto_at long, upto_number long, " + self.memory)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        upto = tuple(self.known.get()[:2]) if self.known.exists() else (-1, -1)
        for part in rows:
            for r in part.to_dict("records"):
                at, number = int(r["at"].timestamp() * 1000), int(r["number"])
                if (at, number) > upto and not self.rows.containsKey((at, number)):
                    self.rows.updateValue((at, number), tuple(r[c.split()[0]] for c in self.waiting.split(", ")))
                    self.handle.registerTimer(at)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())  # no row up to the watermark is to come
        known = tuple(self.known.get()) if self.known.exists() else None
        upto, memory = (known[:2], known[2:]) if known else ((-1, -1), None)
        out: list[tuple] = []
        for at, number in sorted(k for k in self.rows.keys() if k[0] <= now):
            row = self.rows.getValue((at, number))
            self.rows.removeKey((at, number))
            memory = self.take(self.advance(memory, upto[0], at, out) if memory else None, at, row, number, out)
            upto = (at, number)
        if memory:
            memory = self.advance(memory, upto[0], now + 1, out)
            if memory:
                self.known.update((*upto, *memory))
            else:
                self.known.clear()
        yield pd.DataFrame([(*key, *x) for x in out], columns=self.columns) if out else pd.DataFrame()

    def close(self) -> None:
        pass


class Progress(InOrder):
    """STM01, STM02: a job's events as they come, a heartbeat for each BEAT_S of silence, and none of it after the first terminal event or the deadline.

    The state of an ended job stays as one row, so that later rows of it stay unheard.
    """

    waiting = "phase int, pct int, message string"
    memory = "began long, beat long, ended boolean"
    columns = ["job_id", "at_ms", "kind", "seq", "phase", "pct"]

    def take(self, memory, at, row, number, out):
        began, _, ended = memory or (at, 0, False)
        if ended:
            return began, 0, True
        phase, pct, message = row
        out.append((at, "event", number, phase, pct))
        return self.listening(began, at + BEAT_S * 1000, phase == LAST_PHASE or (message or "").strip().lower() == "done")

    def listening(self, began, beat, ended):
        if not ended:
            self.handle.registerTimer(min(beat, began + DEADLINE_S * 1000))
        return began, beat, ended

    def advance(self, memory, last, before, out):
        began, beat, ended = memory
        limit = began + DEADLINE_S * 1000
        while not ended and min(beat, limit) < before:
            if beat < limit:
                out.append((beat, "heartbeat", None, None, None))
                _, beat, _ = self.listening(began, beat + BEAT_S * 1000, False)
            else:
                out.append((limit, "timeout", None, None, None))
                ended = True
        return began, beat, ended


PROGRESS = "job_id long, at_ms long, kind string, seq long, phase int, pct int"


def progress_stream(events: DataFrame, delay: str = "60 seconds") -> DataFrame:
    """events: job_id, seq, at (a timestamp), phase, pct, message, as a stream."""
    rows = events.withColumnRenamed("seq", "number").withWatermark("at", delay)
    return rows.groupBy("job_id").transformWithStateInPandas(Progress(), PROGRESS, "Append", "EventTime")


def progress(events: DataFrame) -> DataFrame:
    """The same of a table, up to the end of all times: so each job that has no terminal event ends by its deadline."""
    own = Window.partitionBy("job_id")
    order = own.orderBy("at_ms", "seq")
    e = events.select("job_id", "seq", F.unix_millis("at").alias("at_ms"), "phase", "pct", "message").dropDuplicates(["job_id", "seq"])
    last = F.coalesce((F.col("phase") == LAST_PHASE) | (F.lower(F.trim("message")) == "done"), F.lit(False))
    e = e.withColumn("last", last).withColumn("began", F.min("at_ms").over(own)).withColumn("ended", F.coalesce(F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    limit = F.col("began") + DEADLINE_S * 1000
    e = e.where(~F.col("ended") & (F.col("at_ms") <= limit)).withColumn("next", F.lead("at_ms").over(order))
    none = lambda t: F.lit(None).cast(t)
    quiet = e.where(~F.col("last")).withColumn("until", F.coalesce("next", limit))
    beats = F.floor((F.col("until") - F.col("at_ms") - 1) / (BEAT_S * 1000)).cast("int")
    heart = quiet.where(beats >= 1).select("job_id", "at_ms", F.explode(F.sequence(F.lit(1), beats)).alias("k"))
    heart = heart.select("job_id", (F.col("at_ms") + F.col("k") * BEAT_S * 1000).alias("at_ms"), F.lit("heartbeat").alias("kind"), none("long").alias("seq"), none("int").alias("phase"), none("int").alias("pct"))
    failed = quiet.where("next is null").select("job_id", limit.alias("at_ms"), F.lit("timeout").alias("kind"), none("long").alias("seq"), none("int").alias("phase"), none("int").alias("pct"))
    return e.select("job_id", "at_ms", F.lit("event").alias("kind"), "seq", "phase", "pct").unionByName(heart).unionByName(failed)


class Schedule(InOrder):
    """STM04: the scheduling state after each review; a key without reviews for idle_ms is forgotten, and begins anew."""

    waiting = "quality int"
    memory = "turns long, interval_days double, ease double, repetitions long"
    columns = ["user_id", "question_id", "turns", "interval_days", "ease", "repetitions"]

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def take(self, memory, at, row, number, out):
        memory = after(tuple(memory or (0, FIRST_INTERVAL, FIRST_EASE, 0)), int(row[0]))
        if self.idle_ms:
            self.handle.registerTimer(at + self.idle_ms)
        out.append(memory)
        return memory

    def advance(self, memory, last, before, out):
        return None if self.idle_ms and last + self.idle_ms < before else memory


def scheduled(reviews: DataFrame, delay: str = "1 day", idle_ms: int | None = None) -> DataFrame:
    """A stream of reviews(user_id, question_id, quality, at (a timestamp), id) to the state after each of them."""
    rows = reviews.select("user_id", "question_id", F.col("id").alias("number"), "at", "quality").withWatermark("at", delay)
    return rows.groupBy("user_id", "question_id").transformWithStateInPandas(Schedule(idle_ms), "user_id long, question_id long, turns long, interval_days double, ease double, repetitions long", "Append", "EventTime")
