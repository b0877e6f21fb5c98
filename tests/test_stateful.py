"""State machines with timers: what they give, when they give it, and that their state ends."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomshift.session import scratch
from loomshift.sources.readers import event_stream
from loomshift.streaming import events as stream
from loomshift.streaming import stateful

SECOND = 1_000_000
# a stream without watermark yet takes the start of 1970 as late
BASE = 1_000_000
SCHEMA = "session_id string, event_id long, s double, kind string, id long, decision string, input_tokens long, output_tokens long, cache_read long, cache_write long"


class Feed:
    """A folder of event files, one more with each `add`, read one file per batch with one checkpoint."""

    def __init__(self, spark):
        self.spark, self.folder, self.work = spark, scratch(spark, "feed"), scratch(spark, "work")

    def add(self, rows):
        full = [(r["session_id"], r["event_id"], float(r["s"]), r["kind"], r.get("id"), r.get("decision"), r.get("input_tokens"), 1, 2, None) for r in rows]
        table = self.spark.createDataFrame(full, SCHEMA).withColumn("ts", F.timestamp_micros((F.col("s") * SECOND).cast("long"))).drop("s")
        self.schema = table.schema
        table.coalesce(1).write.mode("append").parquet(self.folder)

    def run(self, job):
        """What has been given so far; the job goes on where it stopped."""
        made = job(event_stream(self.spark, self.folder, self.schema, files_per_batch=1))
        return [tuple(r) for r in stream.run_append(made, self.work).collect()]

    def held(self):
        states = self.spark.read.format("statestore").option("path", f"{self.work}/state").option("stateVarName", "state").load()
        return {r.key[0] for r in states.select("key").collect()}


def event(session, n, s, kind="tool_call", **more):
    return {"session_id": session, "event_id": n, "s": BASE + s, "kind": kind, "input_tokens": n, **more}


def runs_by_hand(rows, gap, most):
    of = defaultdict(list)
    for r in rows:
        of[r["session_id"]].append(r)
    out = []
    for session, items in of.items():
        items.sort(key=lambda r: (r["s"], r["event_id"]))
        runs = []
        for r in items:
            if runs and r["s"] - runs[-1][-1]["s"] < gap:
                runs[-1].append(r)
            else:
                runs.append([r])
        for run in runs:
            stop = next((k for k, r in enumerate(run) if r["kind"] == "cancel"), len(run))
            n = sum(r["kind"] == "tool_call" for r in run[:stop])
            out.append((session, int(run[0]["s"] * SECOND), int((run[-1]["s"] + gap) * SECOND), len(run), sum(r["input_tokens"] or 0 for r in run), len(run), 2 * len(run), 0,
                        min(n, most), n > most, stop < len(run) and n <= most))
    return out


def test_runs_in_any_order_of_arrival(spark):
    rnd = random.Random(1)
    rows = [event(rnd.choice("abc"), k, rnd.choice([rnd.uniform(0, 3000), rnd.uniform(0, 300)]), rnd.choice(["tool_call"] * 6 + ["cancel", "error"])) for k in range(400)]
    rows += [event("hot", 1000 + k, k * 0.5) for k in range(600)]
    feed = Feed(spark)
    # one watermark delay covers all, so no event is late however the files are dealt
    rnd.shuffle(rows)
    for part in range(4):
        feed.add(rows[part::4])
    feed.add([event("end", 9999, 100_000)])
    got = feed.run(lambda s: stateful.session_runs(s, 30, 3, "2 hours"))
    assert sorted(got) == sorted(runs_by_hand(rows, 30, 3))
    assert any(r[-1] for r in got) and any(r[-2] for r in got)


def test_a_silent_session_leaves_the_state(spark):
    feed = Feed(spark)
    job = lambda s: stateful.session_runs(s, 60, 10, "10 seconds")
    feed.add([event("silent", 1, 0), event("busy", 2, 5), event("silent", 3, 20)])
    assert feed.run(job) == [] and feed.held() == {"silent", "busy"}
    # the second run finds the state of the first; the silence of one session has passed by the end of it
    feed.add([event("busy", 4, 50), event("busy", 5, 100)])
    got = feed.run(job)
    assert [(r[0], r[3]) for r in got] == [("silent", 2)] and feed.held() == {"busy"}
    # it comes back as a run of its own; the result of the first one stands
    feed.add([event("silent", 6, 120), event("other", 7, 500)])
    got = feed.run(job)
    assert sorted((r[0], r[1] // SECOND - BASE, r[3]) for r in got) == [("busy", 5, 3), ("silent", 0, 2), ("silent", 120, 1)] and feed.held() == {"other"}


def answers_by_hand(rows, timeout):
    out = []
    for q in rows:
        if q["kind"] == "permission_request":
            said = sorted((r["s"], r["decision"] or "deny") for r in rows if r["kind"] == "permission_resolved" and (r["session_id"], r["id"]) == (q["session_id"], q["id"])
                          and q["s"] <= r["s"] <= q["s"] + timeout)
            out.append((q["session_id"], q["id"], q["event_id"], int(q["s"] * SECOND), int(said[0][0] * SECOND) if said else None, said[0][1] if said else "deny"))
    return out


def test_one_answer_per_request(spark):
    rnd = random.Random(2)
    rows = []
    for k in range(300):
        kind = rnd.choice(["permission_request", "permission_resolved", "permission_resolved"])
        rows.append(event(rnd.choice("ab"), k, rnd.randrange(0, 400), kind, id=rnd.randrange(5), decision=rnd.choice(["once", "always", "deny"]) if kind == "permission_resolved" else None))
    rows += [event("c", 800, 10, "permission_request", id=1), event("c", 801, 12, "permission_resolved", id=1, decision="once"), event("c", 802, 11, "permission_resolved", id=1, decision="always")]
    rnd.shuffle(rows)
    feed = Feed(spark)
    for part in range(3):
        feed.add(rows[part::3])
    feed.add([event("end", 9999, 100_000, "permission_request", id=1)])
    got = feed.run(lambda s: stateful.answers_once(s, 20, "1 hour"))
    assert sorted(got, key=str) == sorted(answers_by_hand(rows, 20), key=str)
    assert ("c", 1, 800, (BASE + 10) * SECOND, (BASE + 11) * SECOND, "always") in got and len({r[2] for r in got}) == len(got)


def test_a_request_is_answered_when_nothing_earlier_can_arrive(spark):
    feed = Feed(spark)
    job = lambda s: stateful.answers_once(s, 60, "10 seconds")
    feed.add([event("a", 1, 0, "permission_request", id=1), event("a", 2, 30, "permission_resolved", id=1, decision="once"), event("b", 3, 1, "permission_request", id=1)])
    assert feed.run(job) == []
    # an earlier answer may still come, and does
    feed.add([event("a", 4, 25, "permission_resolved", id=1, decision="always")])
    assert feed.run(job) == []
    feed.add([event("x", 5, 45, "permission_request", id=9)])
    assert feed.run(job) == [("a", 1, 1, BASE * SECOND, (BASE + 25) * SECOND, "always")]
    # the other one is refused at its timeout, and nothing of either is kept
    feed.add([event("x", 6, 90, "permission_resolved", id=9, decision="once")])
    got = feed.run(job)
    assert sorted(got, key=str) == sorted([("a", 1, 1, BASE * SECOND, (BASE + 25) * SECOND, "always"), ("b", 1, 3, (BASE + 1) * SECOND, None, "deny")], key=str)
    assert feed.held() == {"x"}


def test_ids_of_a_session_share_a_few_keys(spark):
    """State costs by key: many ids of a session lie in few keys, the ids of a busy one in more than one."""
    feed = Feed(spark)
    feed.add([event("a", k, k % 7, "permission_request", id=k) for k in range(200)])
    assert feed.run(lambda s: stateful.answers_once(s, 60, "10 seconds")) == []
    keys = spark.read.format("statestore").option("path", f"{feed.work}/state").option("stateVarName", "state").load().select("key").collect()
    assert {r.key[0] for r in keys} == {"a"} and 1 < len(keys) <= stateful.ID_PARTS
    feed.add([event("x", 900, 90, "permission_request", id=1)])
    got = feed.run(lambda s: stateful.answers_once(s, 60, "10 seconds"))
    assert sorted(r[2] for r in got) == list(range(200)) and feed.held() == {"x"}


class Handle:
    """Stands in for the state of one key and counts what is asked of it."""

    def __init__(self):
        self.calls, self.value, self.timers = [], None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)

    def listTimers(self):
        self.calls.append("list")
        return iter(sorted(self.timers))

    def took(self):
        calls, self.calls = self.calls, []
        return calls


def test_calls_of_an_answer():
    """A timer is known from the state, and only touched when it moves."""
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

    handle, machine = Handle(), stateful.OneAnswer(60, "deny")
    machine.init(handle)
    rows = lambda *events: iter([Row(id=1, what=f"{s * SECOND},{n},{str(asks).lower()},{said}") for s, n, asks, said in events])
    list(machine.handleInputRows(("a", 0), rows((100, 1, True, ""), (130, 2, True, "")), None))
    assert handle.took() == ["exists", "update", "register"] and handle.timers == {160_000}
    list(machine.handleInputRows(("a", 0), rows((170, 3, False, "once")), None))
    assert handle.took() == ["exists", "get", "update"]
    list(machine.handleInputRows(("a", 0), rows((140, 4, False, "always")), None))
    assert handle.took() == ["exists", "get", "delete", "update", "register"] and handle.timers == {140_000}
    got = list(machine.handleExpiredTimer(("a", 0), TimerValues(0, 150_000), ExpiredTimerInfo(140_000)))
    handle.timers.remove(140_000)
    assert sorted(r.request_id for r in got) == [1, 2] and {r.decision for r in got} == {"always"}
    assert handle.took() == ["exists", "get", "update", "register"] and handle.timers == {170_000}
    assert list(machine.handleExpiredTimer(("a", 0), TimerValues(0, 170_000), ExpiredTimerInfo(170_000))) == []
    assert handle.took() == ["exists", "get", "clear"] and handle.value is None


def test_calls_of_a_run():
    """A session costs three calls in its first batch whatever its events, and its runs are one packed value."""
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

    handle, machine = Handle(), stateful.SessionRuns(30, 2)
    machine.init(handle)
    rows = lambda *times: iter([Row(what=f"true,{str(s == 205).lower()},{s * SECOND},{s},1,2,3,0") for s in times])
    list(machine.handleInputRows(("a",), rows(*range(240, 200, -5), *range(100, 130, 5)), None))
    assert handle.took() == ["exists", "update", "register"] and handle.timers == {155_000} and isinstance(handle.value[0], bytes)
    list(machine.handleInputRows(("a",), rows(300), None))
    assert handle.took() == ["exists", "get", "update"]
    got = list(machine.handleExpiredTimer(("a",), TimerValues(0, 280_000), ExpiredTimerInfo(155_000)))
    handle.timers.remove(155_000)
    assert handle.took() == ["exists", "get", "update", "register"] and handle.timers == {330_000}
    assert [tuple(r) for r in got] == [("a", 100 * SECOND, 155 * SECOND, 6, 6, 12, 18, 0, 2, True, False), ("a", 205 * SECOND, 270 * SECOND, 8, 8, 16, 24, 0, 0, False, True)]


@pytest.mark.parametrize("name", ["stream_usage_runs", "stream_step_runs", "stream_permission_once"])
def test_empty_stream(spark, tmp_path, name):
    from loomshift.plans import catalogue
    from loomshift.session import read_table

    spark.createDataFrame([], read_table(spark, "/root/testdata/sf0.001", "events").schema).write.parquet(str(tmp_path / "events.parquet"))
    assert catalogue.QUERIES[name](spark, str(tmp_path)).count() == 0


def write_chunk(folder, session, chunk, lines):
    place = folder / f"session={session}" / f"chunk={chunk}"
    place.mkdir(parents=True)
    (place / "part.txt").write_text("".join(f"{x}\n" for x in lines))


def test_pushed_lines_in_order_over_a_restart(spark, tmp_path):
    """Chunks land late, twice and out of order; stops in between lose and repeat nothing."""
    from loomshift.sources.readers import pushed_chunks

    chunks = {("a b+c", k): [f"data: {k}.{j}" for j in range(k % 3 + 1)] for k in range(6)}
    chunks[("a b+c", 6)] = ["data: end", "event: closed"]
    chunks |= {("z", 0): ["x", "", "y"], ("z", 1): ["w"]}
    folder, work = tmp_path / "in", scratch(spark, "order")
    folder.mkdir()
    arrivals = [[("a b+c", 2), ("z", 1)], [("a b+c", 0)], [("a b+c", 1), ("a b+c", 4), ("z", 0)], [("a b+c", 3), ("a b+c", 6)], [("a b+c", 5)]]
    whole = {s: [line for (t, _), lines in sorted(chunks.items()) if t == s for line in lines] for s in ("a b+c", "z")}
    for n, landed in enumerate(arrivals):
        for s, k in landed:
            write_chunk(folder, s.replace(" ", "%20"), k, chunks[(s, k)])
        job = stateful.in_order(pushed_chunks(spark, str(folder), files_per_batch=1))
        got = sorted((r.session_id, r.seq, r.line) for r in stream.run_append(job, work).collect())
        # chunks of a that have no gap in front
        present = {k for ls in arrivals[: n + 1] for s, k in ls if s == "a b+c"}
        first_gap = next(k for k in range(9) if k not in present)
        a = [line for k in range(first_gap) for line in chunks[("a b+c", k)]]
        z = whole["z"] if n >= 2 else []
        assert got == sorted([("a b+c", j, x) for j, x in enumerate(a, 1)] + [("z", j, x) for j, x in enumerate(z, 1)])
    states = spark.read.format("statestore").option("path", f"{work}/state").option("stateVarName", "place").load()
    # the closed session has left the state, the open one stays
    assert [r.key[0] for r in states.select("key").collect()] == ["z"]
