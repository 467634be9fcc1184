"""Keyed state: message buffer, limiters and the gate before a log; one step for batch and streams."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from winnow.functions.rules import Lexicon, _plain

State = dict[str, list[tuple]]


@dataclass(frozen=True)
class Step:
    """What one event does to its key's state: run(state, seconds, *values) changes it and returns the result.

    The state is a list of typed rows under each name of `states`; a key that has none has empty
    lists.  `result` is the type of what run returns, `values` the types of the event's columns;
    `lasting` states outlive a key's idle time on streams.
    """

    run: Callable
    states: dict[str, str]
    result: str = "boolean"
    values: tuple[str, ...] = ("string",)
    lasting: tuple[str, ...] = ()

    def __call__(self, items: list, now: float, *values) -> tuple[list, object]:
        """One event of a step that keeps a single list: its new items and the result."""
        (name,) = self.states
        state = {name: items}
        result = self.run(state, now, *values)
        return state[name], result

    def fresh(self) -> State:
        return {name: [] for name in self.states}


def buffer_step(lexicon: Lexicon = Lexicon(), seconds: float = 20.0, most: int = 8) -> Step:
    """Single letters of one user that spell a term: hit, and the buffer is cleared."""
    words = {_plain(t) for t in lexicon.terms}
    letter = re.compile("[a-zçğıöşü]")

    def run(state: State, now: float, value: str | None) -> bool:
        part = (value or "").strip().lower()
        if not letter.fullmatch(part):
            state["letters"] = []
            return False
        held = [*(x for x in state["letters"] if now - x[1] < seconds), (part, now)][-most:]
        hit = len(held) >= 2 and _plain("".join(x[0] for x in held)) in words
        state["letters"] = [] if hit else held
        return hit

    return Step(run, {"letters": "letter string, at double"})


def limiter_step(limit: int, window: float) -> Step:
    """Whether an event is accepted; rejected ones leave no trace."""

    def run(state: State, now: float, value: str | None = None) -> bool:
        state["accepted"] = [x for x in state["accepted"] if x[0] >= now - window]
        if len(state["accepted"]) >= limit:
            return False
        state["accepted"].append((now,))
        return True

    return Step(run, {"accepted": "at double"})


def window_step(limit: int, seconds: int) -> Step:
    """Whether an event is among the first of its fixed window; rejected ones count too."""

    def run(state: State, now: float, value: str | None = None) -> bool:
        bucket = int(now // seconds)
        held = state["window"]
        n = held[0][1] + 1 if held and held[0][0] == bucket else 1
        state["window"] = [(bucket, n)]
        return n <= limit

    return Step(run, {"window": "bucket long, n long"})


def gate_step(limiter: Step, buffer: Step, threshold: int = 3) -> Step:
    """One message's way: limiter, ban, buffer and verdict, warning; the result names where it ended.

    Values are the text and the rules' verdict (toxic, review or clean; null: review, so that a
    message without a verdict is never shown).  limited: over the limit; forbidden: the user was
    banned before, so nothing after the limiter sees the message; banned, warned,
    queued_for_review, passed: the action on a message that was judged.  Banned users still use up
    their limit, and neither they nor limited messages reach the buffer.  A threshold of 0 never bans.
    """

    def run(state: State, now: float, text: str | None, verdict: str | None) -> str:
        if not limiter.run(state, now, text):
            return "limited"
        warnings = state["warnings"][0][0] if state["warnings"] else 0
        if 0 < threshold <= warnings:
            return "forbidden"
        hit = buffer.run(state, now, text)
        if hit or verdict == "toxic":
            state["warnings"] = [(warnings + 1,)]
            return "banned" if 0 < threshold <= warnings + 1 else "warned"
        return "passed" if verdict == "clean" else "queued_for_review"

    return Step(run, {**limiter.states, **buffer.states, "warnings": "n long"}, "string", ("string", "string"), ("warnings",))


def _names(value: str | tuple[str, ...]) -> tuple[str, ...]:
    return (value,) if isinstance(value, str) else tuple(value)


def _events(events: DataFrame, step: Step, key: str, time: str, value: str | tuple[str, ...], order: str, *more) -> DataFrame:
    """k, o, t (microseconds) and the values v0, v1 of events."""
    values = [F.col(c).cast(kind).alias(f"v{i}") for i, (c, kind) in enumerate(zip(_names(value), step.values, strict=True))]
    return events.select(F.col(key).alias("k"), F.col(order).alias("o"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), *values, *more)


def run_batch(events: DataFrame, step: Step, key: str = "user_id", time: str = "ts", value: str | tuple[str, ...] = "value", order: str = "event_id") -> DataFrame:
    """key, order and result of each event, in time order per key.

    Events stream through the step sorted by key and time, so a key's history of any length needs
    no more memory than one batch.
    """
    df = _events(events, step, key, time, value, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last, begun = step.fresh(), None, False
        for pdf in batches:
            out = []
            for k, t, *v in zip(pdf["k"], pdf["t"], *(pdf[f"v{i}"] for i in range(len(step.values))), strict=True):
                k = None if pd.isna(k) else k
                if not begun or k != last:
                    state, last, begun = step.fresh(), k, True
                out.append(step.run(state, t / 1e6, *v))
            yield pd.DataFrame({"k": pdf["k"], "o": pdf["o"], "result": out})

    kinds = dict(df.dtypes)
    dealt = df.repartition("k").sortWithinPartitions("k", "t", "o")
    return dealt.mapInPandas(run, f"k {kinds['k']}, o {kinds['o']}, result {step.result}").select(F.col("k").alias(key), F.col("o").alias(order), "result")


class _Keyed(StatefulProcessor):
    """A step over one key's events in event time.

    New events are appended to the waiting list unread; a timer at the earliest of them fires when
    the watermark has passed it, and only then are the lists read.  The last event's time is kept
    so that an idle key can be dropped.
    """

    def __init__(self, step: Step, order: str, idle_seconds: float) -> None:
        self.step, self.idle = step, int(idle_seconds * 1000)
        self.waits = ", ".join([f"t long, o {order}", *(f"v{i} {kind}" for i, kind in enumerate(step.values))])
        self.columns = ["t", "o", *(f"v{i}" for i in range(len(step.values)))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waits)
        self.last = handle.getValueState("last", "t long")
        self.kept = {name: handle.getListState(name, kind) for name, kind in self.step.states.items()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            items = list(zip(*(pdf[c].tolist() for c in self.columns), strict=True))
            self.waiting.appendList(items)
            least = min(x[0] for x in items)
            first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first, timerValues)
        return iter(())

    def _wake(self, micros: int, timerValues) -> None:
        """A timer at the first millisecond not before micros, and after the watermark."""
        self.handle.registerTimer(max(-(-micros // 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get(), key=lambda x: x[:2])
        cut = sum(x[0] <= mark * 1000 for x in waiting)
        due, later = waiting[:cut], waiting[cut:]
        if due:
            state = {name: list(held.get()) for name, held in self.kept.items()}
            out = [(key[0], o, self.step.run(state, t / 1e6, *v)) for t, o, *v in due]
            for name, held in self.kept.items():
                held.put(state[name]) if state[name] else held.clear()
            self.last.update((due[-1][0],))
            self.waiting.put(later) if later else self.waiting.clear()
            yield pd.DataFrame(out, columns=["k", "o", "result"])
        if later:
            self._wake(later[0][0], timerValues)
        elif self.last.exists():
            end = self.last.get()[0] // 1000 + self.idle
            if end <= mark:
                self.last.clear()
                for name in self.kept.keys() - set(self.step.lasting):
                    self.kept[name].clear()
            else:
                self.handle.registerTimer(end)

    def close(self) -> None:
        pass


def run_stream(
    events: DataFrame, step: Step, key: str = "user_id", time: str = "ts", value: str | tuple[str, ...] = "value", order: str = "event_id", delay: str = "1 hour", idle_seconds: float = 86_400.0
) -> DataFrame:
    """The same on a stream, in event time: an event counts when the watermark has passed it.

    Events wait in the state until the watermark (delay behind the latest event) reaches them, so
    they may arrive out of order within the delay; later ones are dropped.  A key without events
    for idle_seconds beyond the watermark loses its state, but for lasting ones.  State is typed and lies in RocksDB,
    which this sets for the session, as transformWithState asks for it.  Its time to live is a timer in event
    time: Spark's own is in the clock's time, by which a replay would give other results.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = dict(events.dtypes)
    source = _events(events.withWatermark(time, delay), step, key, time, value, order, F.col(time).alias("ts"))
    return source.groupBy("k").transformWithStateInPandas(
        _Keyed(step, kinds[order], idle_seconds), f"k {kinds[key]}, o {kinds[order]}, result {step.result}", "Append", "EventTime"
    )


def moderation_gate(events: DataFrame, step: Step, key: str = "user_id", time: str = "ts", value: tuple[str, str] = ("text", "verdict"), order: str = "event_id", **stream) -> DataFrame:
    """key, order and result of gate_step for a table or a stream of judged messages.

    Limiter, ban, buffer and warnings share a key, so they are one stateful operator over one
    exchange instead of a chain of them.  Closed on failure: messages without user or time cannot be
    limited and are `unavailable`; a failing state store stops the query, which lets nothing pass.
    `stream`: delay and idle_seconds of run_stream; warnings outlast them, so no ban is forgotten.
    """
    known = F.col(key).isNotNull() & F.col(time).isNotNull()
    refused = events.filter(~known).select(F.col(key), F.col(order), F.lit("unavailable").alias("result"))
    if not events.isStreaming:
        return run_batch(events.filter(known), step, key, time, value, order).union(refused)
    passed = run_stream(events.filter(known), step, key, time, value, order, **stream)
    return passed.select(F.col("k").alias(key), F.col("o").alias(order), "result").union(refused)


def fixed_window_limit(events: DataFrame, limit: int, seconds: int, key: str = "user_id", time: str = "ts", order: str = "event_id") -> DataFrame:
    """accepted: among the first limit events of the key's window; rejected ones count too."""
    bucket = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds)
    place = F.row_number().over(Window.partitionBy(key, bucket).orderBy(time, order))
    return events.withColumn("bucket", bucket).withColumn("accepted", place <= limit)


def unexpired(df: DataFrame, now: str, column: str = "expires_at") -> DataFrame:
    return df.filter(F.col(column).isNull() | (F.col(column) >= F.lit(now).cast("timestamp")))
