"""Cheapest repair of the role structure of conversations: parallel Viterbi by rank convergence.

A repaired conversation has role initials `(s?(ua)+)?`. Each row is kept (0), given the role user or assistant (2) or
deleted (3; blank rows and repeats always), an empty user or assistant turn can be inserted anywhere (2), and a truncated
row that stays costs 1. The audit is the cheapest series of edits, one of D, I, K, R each, the least in ASCII order of
those that cost the same.

The states of the walk are: nothing yet, behind the system turn, behind a user turn, behind an assistant turn. Rows are
ordered once over the whole table and cut into chunks of `chunk` rows, so a conversation of any length is spread over
tasks. Backward cost vectors (one cost per state) are computed per chunk:

* a chunk that ends inside a conversation starts from a speculative vector; fix-up passes then rerun the chunks whose
  next chunk gave another vector, and a rerun stops at the first row where its vector and the one before differ by a
  constant only, since all rows in front would differ by that constant as well;
* chunks that still change after `passes` passes (rows of one role that never fit, for instance, do not converge) give
  their min-plus matrix instead, and matrices are multiplied along the conversation in doubling rounds.

Forward, a chunk gives its exit state for every entry state; these maps are stitched in the same doubling rounds, and each chunk
traces its edits from the right state by the backward vectors. Rows that must be deleted leave vectors and states unchanged.

Defined cases: a null role or text counts as one space, so such texts are blank; null turns come first; null conversation
ids are a conversation of their own; rows of the same turn are in order of role, then MD5 of the text; equal rows are
repeats; texts of any length are passed through; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshift.llm.common import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

A_SIGN = r"[^\x20\x09-\x0D]"
KEEP, RENAME, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
# cost to the end of the conversation from each state when no row is left
END = (0, 2 * INSERT, INSERT, 0)
# state behind an inserted or renamed turn, and the role it gets
NEXT = (2, 2, 3, 2)
NAMES = {"u": "user", "a": "assistant"}
FAR = 1 << 40
DEAD = -1
IDLE, BLANK, REPEAT, SHORT = 0, 1, 2, 3


# --- rows ----------------------------------------------------------------------------------------


def _plain(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in role and text."""
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def _key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


ORDER = ("conv_id", "turn", "role", "digest")


def _chunked(rows: DataFrame, chunk: int, scratch: Scratch) -> DataFrame:
    """Narrow rows in whole order: chunk, pos, the order columns, fault, code, and whether the part of the conversation in this
    chunk began in the one before (`into`) or goes on in the next (`onto`).

    `code` is -1 for rows that must go, else twice the role (s, u, a, other) plus 1 if truncated."""
    spark = rows.sparkSession
    blank = ~F.col("text").rlike(A_SIGN)
    ends = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    narrow = rows.select(*ORDER, F.when(blank, BLANK).when(~ends.isin(".", "!", "?"), SHORT).otherwise(IDLE).alias("fault"),
                         F.monotonically_increasing_id().alias("row"))
    order = [F.col(c).asc_nulls_first() for c in (*ORDER, "row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the id counts the rows of each part in order, so it is the position in the whole order
    dealt = scratch.store(narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("row")
                          .withColumn("pos", F.monotonically_increasing_id()))
    at, part = F.col("pos").bitwiseAND((1 << 33) - 1), F.shiftright("pos", 33)
    # a row per part
    sizes = sorted(dealt.groupBy(part.alias("part")).count().collect())
    before, offsets = 0, []
    for number, n in sizes:
        offsets.append((number, before))
        before += -(-n // chunk)
    offsets = spark.createDataFrame(offsets, "part long, before long")
    firsts = (dealt.filter(F.col("fault") != BLANK).groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos"))
              .select("pos", F.lit(True).alias("first")))
    known = dealt.join(firsts, "pos", "left").join(F.broadcast(offsets), F.col("part") == part).drop("part")
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), REPEAT).otherwise(F.col("fault"))
    known = known.withColumn("fault", fault).withColumn("chunk", F.col("before") + F.floor(at / chunk)).drop("before", "first")
    known = scratch.store(known)
    edges = known.groupBy("chunk").agg(F.min_by(F.struct("conv_id"), "pos").alias("head"), F.max_by(F.struct("conv_id"), "pos").alias("tail"))
    edges = scratch.store(edges)
    back = edges.select((F.col("chunk") + 1).alias("chunk"), F.col("tail").alias("last"))
    ahead = edges.select((F.col("chunk") - 1).alias("chunk"), F.col("head").alias("next"))
    # a struct that is null as a whole stands for no chunk, one with a null id for the conversation without id
    open_ends = edges.join(back, "chunk", "left").join(ahead, "chunk", "left").select("chunk", "last", "next")

    def same(side: str) -> Column:
        return F.col(side).isNotNull() & F.col(f"{side}.conv_id").eqNullSafe(F.col("conv_id"))

    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = F.when(F.col("fault").isin(BLANK, REPEAT), DEAD).otherwise(2 * role + (F.col("fault") == SHORT).cast("int"))
    coded = known.join(open_ends, "chunk").select(
        "chunk", "pos", *ORDER, "fault", code.cast("int").alias("code"), same("last").alias("into"), same("next").alias("onto"))
    out = scratch.store(coded)
    scratch.drop(dealt, known, edges)
    return out


# --- cost vectors --------------------------------------------------------------------------------


def closed(w: np.ndarray) -> np.ndarray:
    """Lets turns be inserted in front."""
    w[:, 2] = np.minimum(w[:, 2], INSERT + w[:, 3])
    for s in (0, 1, 3):
        w[:, s] = np.minimum(w[:, s], INSERT + w[:, 2])
    return w


def options(after: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs from each state by keeping and by renaming rows, given the vectors behind them."""
    role, cut = code >> 1, (code & 1) * CUT
    keep = np.full(after.shape, FAR, np.int64)
    to_user = np.where(role == 1, KEEP + cut + after[:, 2], FAR)
    for s in (0, 1, 3):
        keep[:, s] = to_user
    keep[:, 0] = np.minimum(keep[:, 0], np.where(role == 0, KEEP + cut + after[:, 1], FAR))
    keep[:, 2] = np.where(role == 2, KEEP + cut + after[:, 3], FAR)
    rename = RENAME + cut[:, None] + after[:, list(NEXT)]
    return keep, rename


def step(after: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Vectors in front of rows, a row of the result for each."""
    keep, rename = options(after, code)
    w = closed(np.minimum(DELETE + after, np.minimum(keep, rename)))
    return np.where((code == DEAD)[:, None], DELETE + after, w)


def backward(codes: np.ndarray, bounds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Vectors behind every row; segments lie between `bounds`, `ends` has the vector behind each. All segments go in step."""
    behind = np.empty((len(codes), 4), np.int64)
    now = ends.astype(np.int64).copy()
    last, length = bounds[1:] - 1, np.diff(bounds)
    for t in range(int(length.max(initial=0))):
        some = np.flatnonzero(length > t)
        at = last[some] - t
        behind[at] = now[some]
        now[some] = step(now[some], codes[at])
    return behind


def normal(v: np.ndarray) -> np.ndarray:
    return v - v.min(axis=-1, keepdims=True)


def rerun(codes: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, int]:
    """Vector in front of a chunk for the vectors `old` and `new` behind it, and the rows looked at: once the two differ by a
    constant they do so to the front, where `new` then has the vector of `old`."""
    pair = np.stack([old, new]).astype(np.int64)
    for k, code in enumerate(codes[::-1]):
        pair = step(pair, np.full(2, code))
        if (normal(pair[0]) == normal(pair[1])).all():
            return None, k + 1
    return normal(pair[1]), len(codes)


def front(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    now = np.asarray(end, np.int64)[None, :]
    for code in codes[::-1]:
        now = step(now, np.array([code]))
    return normal(now[0])


def matrix(codes: np.ndarray) -> np.ndarray:
    """Cost from each state in front (row) to each state behind (column)."""
    now = np.where(np.eye(4, dtype=bool), 0, FAR)
    for code in codes[::-1]:
        now = np.minimum(step(now, np.full(4, code)), FAR)
    return now.T.ravel()


def _by_chunk(rows: DataFrame, work: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        return pa.table(work(table.sort_by("pos")))

    return rows.groupBy("chunk").applyInArrow(run, schema)


def _array(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).combine_chunks().to_numpy(zero_copy_only=False))


def _vector(table: pa.Table, name: str) -> np.ndarray:
    return np.array(table.column(name)[0].as_py(), np.int64)


def _front_vectors(coded: DataFrame, scratch: Scratch, passes: int) -> DataFrame:
    """chunk, front: the vector in front of each chunk that begins inside a conversation, up to a constant."""

    def first(table: pa.Table) -> dict:
        codes, onto = _array(table, "code"), bool(_array(table, "onto")[-1])
        return {"chunk": [table["chunk"][0].as_py()], "open": [onto], "behind": [list(END)], "front": [front(codes, END).tolist()]}

    def again(table: pa.Table) -> dict:
        new, old = _vector(table, "after"), _vector(table, "behind")
        found, _ = rerun(_array(table, "code"), old, new)
        return {"chunk": [table["chunk"][0].as_py()], "open": [True], "behind": [new.tolist()],
                "front": [(_vector(table, "front") if found is None else found).tolist()]}

    def whole(table: pa.Table) -> dict:
        return {"chunk": [table["chunk"][0].as_py()], "f": [matrix(_array(table, "code")).tolist()]}

    schema = "chunk long, open boolean, behind array<long>, front array<long>"
    inside = coded.filter("into").select("chunk", "pos", "code", "onto")
    state = scratch.store(_by_chunk(inside, first, schema))
    for turn in range(passes + 1):
        after = state.select((F.col("chunk") - 1).alias("chunk"), F.col("front").alias("after"))
        stale = scratch.store(state.filter("open").join(after, "chunk").filter("after != behind"))
        if stale.isEmpty():
            scratch.drop(stale)
            return state.select("chunk", "front")
        if turn == passes:
            break
        done = _by_chunk(inside.drop("onto").join(stale, "chunk"), again, schema)
        following = scratch.store(state.join(stale.select("chunk"), "chunk", "left_anti").unionByName(done))
        scratch.drop(state, stale)
        state = following

    # exact for what does not converge: matrices along each run of open chunks, ended by the vector of a chunk that is not open
    ended = state.filter(~F.col("open")).select("chunk", F.flatten(F.transform("front", lambda x: F.array_repeat(x, 4))).alias("f"))
    open_rows = inside.drop("onto").join(state.filter("open").select("chunk"), "chunk", "left_semi")
    maps = ended.unionByName(_by_chunk(open_rows, whole, "chunk long, f array<long>"))

    def product(m: Column, n: Column) -> Column:
        def cell(at: Column) -> Column:
            i, j = F.floor(at / 4).cast("int"), (at % 4).cast("int")
            return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.get(m, i * 4 + k) + F.get(n, k * 4 + j)))

        return F.transform(F.sequence(F.lit(0), F.lit(15)), cell)

    def rank_one(m: Column) -> Column:
        """All columns differ by constants, so the vector behind does not matter."""
        def shape(j: int) -> Column:
            return F.array(*[F.get(m, F.lit(4 * i + j)) - F.get(m, F.lit(j)) for i in range(4)])

        return (shape(0) == shape(1)) & (shape(0) == shape(2)) & (shape(0) == shape(3))

    def least(m: Column) -> Column:
        """Small again, however long the run is."""
        return F.transform(m, lambda x: F.least(x - F.array_min(m), F.lit(FAR)))

    solved = _stitched(maps, 1, lambda mine, other: least(product(mine, other)), rank_one, scratch)
    front_of = F.array(*[F.get("f", F.lit(4 * i)) for i in range(4)])
    return scratch.store(solved.select("chunk", front_of.alias("front"))).select(
        "chunk", F.transform("front", lambda x: x - F.array_min("front")).alias("front"))


def _stitched(maps: DataFrame, side: int, compose: Callable[[Column, Column], Column], known: Callable[[Column], Column], scratch: Scratch) -> DataFrame:
    """Composes each chunk's map `f` with those of its neighbours on one side until nothing further matters. Spans double in each round."""
    names = ("chunk", "at", "f", "known")
    state = scratch.store(maps.select("chunk", (F.col("chunk") + side).alias("at"), "f", known(F.col("f")).alias("known")))
    while not state.filter("NOT known").isEmpty():
        other = state.select(F.col("chunk").alias("at"), F.col("at").alias("further"), F.col("f").alias("g"))
        joined = state.filter("NOT known").join(other, "at").select("chunk", F.col("further").alias("at"), compose(F.col("f"), F.col("g")).alias("f"))
        following = scratch.store(state.filter("known").select(*names).unionByName(joined.withColumn("known", known(F.col("f")))))
        scratch.drop(state)
        state = following
    return state


# --- edits ---------------------------------------------------------------------------------------


def moves(behind: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The first letter, in ASCII order, of a cheapest edit for each row and state: D, I, K or R as 0 to 3."""
    keep, rename = options(behind, codes)
    best = step(behind, codes)
    insert = INSERT + best[:, list(NEXT)]
    out = np.where(rename == best, 3, 9)
    for letter, cost in ((2, keep), (1, insert), (0, DELETE + behind)):
        out = np.where(cost == best, letter, out)
    return np.where((codes == DEAD)[:, None], 0, out)


KEPT = (1, 2, 3)  # state behind a kept turn of role s, u, a


def trace(move: list, codes: list, state: int, note: Callable[[int, str, str, str], None] | None = None) -> int:
    """Follows the moves from a state through the rows of one segment; tells each row's inserted roles, edit and new role."""
    for k, options_ in enumerate(move):
        inserted = ""
        while options_[state] == 1:
            state = NEXT[state]
            inserted += " sua"[state]
        edit, role = options_[state], ""
        if edit == 2:
            state = KEPT[codes[k] >> 1]
        elif edit == 3:
            state = NEXT[state]
            role = " sua"[state]
        if note:
            note(k, inserted, "DIKR"[edit], role)
    return state


def _segments(table: pa.Table) -> np.ndarray:
    """Bounds of the conversations in a chunk."""
    ids = table.column("conv_id").combine_chunks()
    a, b = ids[1:], ids[:-1]
    differ = pc.or_(pc.xor(pc.is_null(a), pc.is_null(b)), pc.fill_null(pc.not_equal(a, b), False))
    return np.concatenate([[0], np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1, [len(ids)]])


def edits(rows: DataFrame, chunk: int = 4096, passes: int = 3) -> DataFrame:
    """The edit of each row: pos (whole order), the order columns, fault, inserted (roles put in front), edit, new_role (of a
    renamed row) and appended (roles put behind the last row). `rows` has conv_id, turn, role, text."""
    scratch = Scratch(rows.sparkSession, "structure")
    coded = _chunked(_key(_plain(rows)), chunk, scratch)
    fronts = _front_vectors(coded, scratch, passes)
    behind = scratch.store(fronts.select((F.col("chunk") - 1).alias("chunk"), F.col("front").alias("behind")))

    def exits(table: pa.Table) -> dict:
        codes = _array(table, "code")
        bounds = np.array([0, len(codes)])
        move = moves(backward(codes, bounds, _vector(table, "behind")[None, :]), codes).tolist()
        starts = range(4) if _array(table, "into")[0] else [0] * 4
        return {"chunk": [table["chunk"][0].as_py()], "f": [[trace(move, codes.tolist(), s) for s in starts]]}

    outgoing = coded.filter("onto").select("chunk", "pos", "code", "into").join(behind, "chunk")
    exit_maps = _by_chunk(outgoing, exits, "chunk long, f array<long>")
    exit_states = _stitched(exit_maps, -1, lambda mine, other: F.transform(other, lambda s: F.get(mine, s.cast("int"))),
                            lambda f: F.array_min(f) == F.array_max(f), scratch)
    entry = scratch.store(exit_states.select((F.col("chunk") + 1).alias("chunk"), F.get("f", F.lit(0)).alias("entry")))

    def traced(table: pa.Table) -> dict:
        codes, bounds = _array(table, "code"), _segments(table)
        ends = np.tile(np.array(END, np.int64), (len(bounds) - 1, 1))
        into, onto = bool(_array(table, "into")[0]), bool(_array(table, "onto")[-1])
        if onto:
            ends[-1] = _vector(table, "behind")
        move, code = moves(backward(codes, bounds, ends), codes).tolist(), codes.tolist()
        n = len(code)
        inserted, edit, role, appended = [""] * n, [""] * n, [""] * n, [""] * n

        for j in range(len(bounds) - 1):
            low, high = int(bounds[j]), int(bounds[j + 1])

            def note(k: int, i: str, e: str, r: str) -> None:
                inserted[low + k], edit[low + k], role[low + k] = i, e, r

            state = trace(move[low:high], code[low:high], table["entry"][0].as_py() if into and not j else 0, note)
            if not (onto and high == n):
                appended[high - 1] = ("", "ua", "a", "")[state]
        names = ("pos", *ORDER, "fault")
        return {**{c: table[c] for c in names}, "inserted": inserted, "edit": edit, "new_role": role, "appended": appended}

    kinds = {f.name: f.dataType.simpleString() for f in coded.schema}
    schema = ", ".join([f"{c} {kinds[c]}" for c in ("pos", *ORDER, "fault")] + [f"{c} string" for c in ("inserted", "edit", "new_role", "appended")])
    joined = coded.join(behind, "chunk", "left").join(entry, "chunk", "left")
    return scratch.store(_by_chunk(joined, traced, schema))


# --- results -------------------------------------------------------------------------------------


class _Digest:
    """Figures of one conversation, row by row; only the audit grows with it."""

    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    schema = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def __init__(self):
        self.faults, self.illegal, self.cost, self.audit = [0] * 4, 0, 0, []
        self.low = self.high = self.turn = self.before = None
        self.turns, self.sha, self.rows = 0, hashlib.sha256(), 0

    def put(self, edit: str, role: str, text: str) -> Iterator[tuple]:
        self.audit.append(edit)
        if edit != "D":
            self.sha.update((b"\n" if self.rows else b"") + f"{role}:{text}".encode())
            self.rows += 1
        return iter(())

    def seen(self, turn: int | None, role: str, fault: int, edit: str, inserts: int) -> None:
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.turn = self.high = turn
            self.turns += 1
        self.faults[fault] += 1
        if self.before is not None and self.before[:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role
        self.cost += {"K": KEEP, "R": RENAME, "D": DELETE}[edit] + (CUT if fault == SHORT and edit != "D" else 0) + INSERT * inserts

    def end(self) -> Iterator[tuple]:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        yield (gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


class _Rows:
    """The repaired conversation itself, and what was deleted."""

    names = ("at", "edit", "role", "text")
    schema = "at long, edit string, role string, text string"

    def __init__(self):
        self.at = 0

    def put(self, edit: str, role: str, text: str) -> Iterator[tuple]:
        self.at += 1
        yield (self.at, edit, role, text)

    def seen(self, *_) -> None:
        pass

    def end(self) -> Iterator[tuple]:
        return iter(())


def _walked(rows: DataFrame, done: DataFrame, lost: DataFrame | None, kind: type) -> DataFrame:
    """Texts and edits of each conversation, met in order in one task, which holds one row at a time."""
    none = {c: F.lit(None).cast("string") for c in ("inserted", "edit", "new_role", "appended")}
    texts = _key(_plain(rows)).withColumns({**none, "pos": F.lit(-1).cast("long"), "fault": F.lit(0)})
    marks = done.withColumn("text", F.lit(None).cast("string"))
    both = texts.unionByName(marks)
    if lost is not None:
        empty = {c.name: F.lit(None).cast(c.dataType) for c in both.schema if c.name not in ("conv_id", "pos")}
        both = both.unionByName(lost.select("conv_id").withColumns({**empty, "pos": F.lit(-2).cast("long")}))
    order = [F.col(c).asc_nulls_first() for c in (*ORDER, "pos")]
    both = both.repartition("conv_id").sortWithinPartitions(*order)
    conv_type = rows.schema["conv_id"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, own = [], 0, fields
        state, conv, text, started = None, None, None, False

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), own)], schema=pa.schema(own))

        names = ("conv_id", "turn", "role", "text", "pos", "fault", "inserted", "edit", "new_role", "appended")
        for batch in batches:
            own = [batch.schema.field("conv_id"), *fields]
            for c, turn, role, body, pos, fault, inserted, edit, new_role, appended in zip(*[batch.column(n).to_pylist() for n in names]):
                made = []
                if not started or c != conv:
                    if started:
                        made += [(conv, *x) for x in state.end()]
                    state, conv, started = kind(), c, True
                if pos == -1:
                    text = body
                elif pos >= 0:
                    for initial in inserted:
                        made += [(c, *x) for x in state.put("I", NAMES[initial], "")]
                    made += [(c, *x) for x in state.put(edit, NAMES[new_role] if edit == "R" else role, text)]
                    for initial in appended:
                        made += [(c, *x) for x in state.put("I", NAMES[initial], "")]
                    state.seen(turn, role, fault, edit, len(inserted) + len(appended))
                out += made
                size += sum(len(x) for row in made for x in row if isinstance(x, str))
                if len(out) >= 4096 or size > 1 << 22:
                    yield flush()
                    out, size = [], 0
        if started:
            out += [(conv, *x) for x in state.end()]
        if out:
            yield flush()

    fields = [pa.field(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in kind.schema.split(", "))]
    return both.mapInArrow(walk, f"conv_id {conv_type}, {kind.schema}")


def repaired(rows: DataFrame, chunk: int = 4096, passes: int = 3) -> DataFrame:
    """A row per edit: conv_id, at (from 1), edit, role, text. Rows of edit D are not part of the repaired conversation."""
    return _walked(rows, edits(rows, chunk, passes), None, _Rows)


def audits(rows: DataFrame, lost: DataFrame | None = None, chunk: int = 4096, passes: int = 3) -> DataFrame:
    """A row per conversation: faults counted, the cost and letters of its cheapest edits, SHA-256 of the repaired turns as
    `role:text` lines. `lost` names conversations that may have no row left. The digest of one conversation is one
    stream by its nature; the edits are worked out in chunks."""
    return _walked(rows, edits(rows, chunk, passes), lost, _Digest)


# --- damage for trials ---------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Faults by a hash of `conv_id:turn`: 0 drops the row, 1 empties its text, 2 removes sentence ends, 3 repeats it, 4 makes
    it the user's; others stay. Nulls count as one space in the hash, in role and in text."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = _plain(conversations).withColumn("fault", F.crc32(key.cast("binary")) % 20).filter("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
