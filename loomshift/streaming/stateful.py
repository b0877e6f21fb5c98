"""Streaming state machines with event-time timers: state that ends, and one answer per request.

Rows of a key may arrive in any order within the watermark's delay. State keeps what can still change, a timer
tells when nothing earlier can arrive any more, then the result goes out once and its state is cleared.
"""

from __future__ import annotations

import pickle
import sys
from bisect import bisect_left
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomshift import fixed

# task functions travel with the job: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENS = ("input_tokens", "output_tokens", "cache_read", "cache_write")
RUNS = "session_id {id}, started long, closed long, events long, " + ", ".join(f"{t} long" for t in TOKENS) + ", steps long, capped boolean, cancelled boolean"
RUN = Row("session_id", "started", "closed", "events", *TOKENS, "steps", "capped", "cancelled")
ANSWER = Row("session_id", "id", "request_id", "asked_at", "said_at", "decision")


class Timed(StatefulProcessor):
    """One value of state per key and one timer, set to the next moment (microseconds) at which something is settled.

    Every call of the state goes over a socket, so a key costs few of them: its value is one pickled field beside the
    timer that is set, which is only touched when it moves."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "held binary, timer long")

    def load(self) -> tuple[object, int | None]:
        """What is held for the key, and its timer; nothing and no timer for a new key."""
        if not self.state.exists():
            return None, None
        held, timer = self.state.get()
        return pickle.loads(held), timer

    def keep(self, value: object, next_at: int | None, timer: int | None, fired: int | None = None) -> None:
        """Sets the value and moves the timer from where it is; one that has fired goes by itself."""
        # the first millisecond that is not before it
        wanted = None if next_at is None else -(-next_at // 1000)
        if timer is not None and timer not in (wanted, fired):
            self.handle.deleteTimer(timer)
        if wanted is None:
            if timer is not None:
                self.state.clear()
            return
        self.state.update((pickle.dumps(value, 5), wanted))
        if wanted != timer:
            self.handle.registerTimer(wanted)

    def close(self) -> None:
        pass


class Run:
    """A stretch of a session without a silence: where it lies, what it used, its first steps and its first cancellation."""

    def __init__(self, first, last, events, tokens, steps, cancel):
        self.first, self.last, self.events, self.tokens, self.steps, self.cancel = first, last, events, list(tokens), list(steps), cancel

    def join(self, other: Run, most: int) -> None:
        self.first, self.last = min(self.first, other.first), max(self.last, other.last)
        self.events += other.events
        self.tokens = [a + b for a, b in zip(self.tokens, other.tokens)]
        self.steps = sorted(self.steps + other.steps)[:most]
        self.cancel = min((c for c in (self.cancel, other.cancel) if c is not None), default=None)

    def packed(self) -> tuple:
        return self.first, self.last, self.events, self.tokens, self.steps, self.cancel


class SessionRuns(Timed):
    """Runs of a session, each given once when a silence of `gap_s` has passed it; then the session leaves the state.

    The first `max_steps` + 1 steps and the first cancellation decide how a run ended, so a run's state is
    bounded whatever the number of its events. Times are (microseconds, event id), which orders equal times."""

    def __init__(self, gap_s: int, max_steps: int):
        self.gap, self.most = gap_s * 1_000_000, max_steps

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, timer = self.load()
        runs = [Run(*r) for r in held or ()]
        ends = [r.last for r in runs]
        for row in rows:
            is_step, is_cancel, micros, event_id, *tokens = row.what.split(",")
            micros = int(micros)
            at = (micros, int(event_id) if event_id else None)
            new = Run(micros, micros, 1, map(int, tokens), [at] if is_step == "true" else [], at if is_cancel == "true" else None)
            # runs lie apart by at least the gap; the new event meets those it is nearer to
            low = bisect_left(ends, micros - self.gap + 1)
            high = low
            while high < len(runs) and runs[high].first < micros + self.gap:
                new.join(runs[high], self.most + 1)
                high += 1
            runs[low:high], ends[low:high] = [new], [new.last]
        self._keep(runs, timer)
        return iter(())

    def _keep(self, runs: list[Run], timer: int | None, fired: int | None = None) -> None:
        self.keep([r.packed() for r in runs], runs[0].last + self.gap if runs else None, timer, fired)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held, timer = self.load()
        runs = [Run(*r) for r in held or ()]
        for r in runs:
            if r.last + self.gap <= now:
                before = [s for s in r.steps if r.cancel is None or s < r.cancel]
                capped = len(before) > self.most
                yield RUN(key[0], r.first, r.last + self.gap, r.events, *r.tokens, min(len(before), self.most), capped, r.cancel is not None and not capped)
        self._keep([r for r in runs if r.last + self.gap > now], timer, expiredTimerInfo.getExpiryTimeInMs())


def session_runs(stream: DataFrame, gap_s: int, max_steps: int = fixed.MAX_STEPS, delay: str = "10 minutes", cancel=None) -> DataFrame:
    """A row per closed run of a session: its bounds (microseconds), token sums, steps up to the cap or to the cancellation,
    whichever came first. `cancel` tells the events that cancel; without it those of kind `cancel`."""
    cancel = F.col("kind") == "cancel" if cancel is None else cancel
    # what a row says is one text: each column more is paid for by row in Python
    what = F.concat_ws(",", *[F.coalesce(c, F.lit(False)) for c in (F.col("kind") == "tool_call", cancel)], F.unix_micros("ts"),
                       F.coalesce(F.col("event_id").cast("long").cast("string"), F.lit("")), *[F.coalesce(F.col(t).cast("long"), F.lit(0)) for t in TOKENS])
    rows = stream.withWatermark("ts", delay).select("session_id", "ts", what.alias("what"))
    schema = RUNS.format(id=stream.schema["session_id"].dataType.simpleString())
    return rows.where("ts IS NOT NULL").groupBy("session_id").transformWithState(SessionRuns(gap_s, max_steps), schema, "Append", "EventTime")


class OneAnswer(Timed):
    """Requests of some ids of a session, each answered once: by the first answer to its id within the timeout, when nothing
    before it can arrive any more, else by a refusal at the timeout. An answer may serve several requests.

    The state is a pair of lists per id: requests as (microseconds, event id), answers in order as (microseconds, decision)."""

    def __init__(self, timeout_s: int, refusal: str):
        self.timeout, self.refusal = timeout_s * 1_000_000, refusal

    def _settled(self, at: int, said: list) -> tuple[int, str, int | None]:
        """When a request is settled, by what, and when that was said."""
        k = bisect_left(said, (at, ""))
        if k < len(said) and said[k][0] <= at + self.timeout:
            return said[k][0], said[k][1], said[k][0]
        return at + self.timeout, self.refusal, None

    def _next(self, held: dict) -> int | None:
        return min((m for asked, said in held.values() for m in (*(self._settled(at, said)[0] for at, _ in asked), *(at for at, _ in said[:1]))), default=None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, timer = self.load()
        held, answered = held or {}, set()
        for row in rows:
            micros, event_id, is_request, decision = row.what.split(",", 3)
            asked, said = held.setdefault(row.id, ([], []))
            if is_request == "true":
                asked.append((int(micros), int(event_id) if event_id else None))
            else:
                said.append((int(micros), decision or self.refusal))
                answered.add(row.id)
        for id_ in answered:
            held[id_] = (held[id_][0], sorted(set(held[id_][1])))
        self.keep(held, self._next(held), timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held, timer = self.load()
        left = {}
        for id_, (asked, said) in (held or {}).items():
            open_ = []
            for at, request in asked:
                moment, decision, said_at = self._settled(at, said)
                if moment <= now:
                    yield ANSWER(key[0], id_, request, at, said_at, decision)
                else:
                    open_.append((at, request))
            later = [x for x in said if x[0] > now]
            if open_ or later:
                left[id_] = (open_, later)
        self.keep(left, self._next(left), timer, expiredTimerInfo.getExpiryTimeInMs())


# Parts that the ids of a session are dealt into. A key of the state costs a dozen calls whatever it holds, so ids share
# keys; a busy session still lies in several.
ID_PARTS = 4


def answers_once(stream: DataFrame, timeout_s: int = fixed.PERMISSION_TIMEOUT_S, delay: str = "10 minutes", refusal: str = "deny") -> DataFrame:
    """A row per request, given once: the first answer to its id within the timeout (the smallest text of several at one
    time), or the refusal. Times are microseconds. Rows without id or time are left out."""
    kinds = ("permission_request", "permission_resolved")
    # what a row says is one text: each column more is paid for by row in Python
    what = F.concat_ws(",", F.unix_micros("ts"), F.coalesce(F.col("event_id").cast("long").cast("string"), F.lit("")),
                       F.col("kind") == kinds[0], F.coalesce("decision", F.lit("")))
    rows = stream.where(F.col("kind").isin(*kinds) & F.col("id").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay).select(
        "session_id", F.pmod(F.xxhash64("id"), F.lit(ID_PARTS)).cast("int").alias("part"), "id", "ts", what.alias("what"))
    types = {c: stream.schema[c].dataType.simpleString() for c in ("session_id", "id")}
    schema = f"session_id {types['session_id']}, id {types['id']}, request_id long, asked_at long, said_at long, decision string"
    return rows.groupBy("session_id", "part").transformWithState(OneAnswer(timeout_s, refusal), schema, "Append", "EventTime")


class InOrder(StatefulProcessor):
    """Lines of a session in the order of its chunks, numbered without gaps. Chunks that come early wait for those before
    them, and chunks that come again are known; the last chunk of a session ends its state."""

    def __init__(self, first: int):
        self.first = first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next_chunk long, next_seq long")
        self.waiting = handle.getMapState("waiting", "chunk long", "lines array<string>, is_last boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        chunk, seq = tuple(self.place.get()) if self.place.exists() else (self.first, 1)
        held = dict.fromkeys(k[0] for k in self.waiting.keys()) if self.waiting.exists() else {}
        ended = False

        def given(lines: list) -> Iterator[Row]:
            nonlocal seq
            for line in lines or ():
                yield LINE(key[0], seq, line)
                seq += 1

        for row in rows:
            if row.chunk != chunk:
                if row.chunk > chunk and row.chunk not in held:
                    self.waiting.updateValue((row.chunk,), (list(row.lines or ()), row.is_last))
                    held[row.chunk] = None
                continue
            yield from given(row.lines)
            chunk, ended = chunk + 1, ended or row.is_last
            while chunk in held:
                lines, last = self.waiting.getValue((chunk,))
                yield from given(lines)
                self.waiting.removeKey((chunk,))
                del held[chunk]
                chunk, ended = chunk + 1, ended or last
        if ended and not held:
            self.place.clear()
        else:
            self.place.update((chunk, seq))

    def close(self) -> None:
        pass


LINE = Row("session_id", "seq", "line")


def in_order(chunks: DataFrame, first: int = 0) -> DataFrame:
    """session_id, seq (from 1), line of a stream of chunks (session_id, chunk, lines, is_last), whatever the order of arrival.

    Places are kept in the checkpoint, so a run that goes on after a stop neither loses nor repeats a line. A chunk that
    never comes holds its session back, the others go on."""
    return chunks.groupBy("session_id").transformWithState(InOrder(first), "session_id string, seq long, line string", "Append", "None")
