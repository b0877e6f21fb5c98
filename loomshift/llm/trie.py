"""Prefix trie of conversations, its subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns; its id is its smallest member and its depth. Turns are hashed with their place, and
running sums of these hashes along a conversation name its prefixes, so long conversations are cut over tasks and
equal prefixes meet in one aggregation. Totals over subtrees are then found in rounds that need no depth-long chain of joins:

* rake: nodes without children end; their totals go to their parents, added up before the shuffle;
* compress: a node with a single child is cut out and its child linked to its parent, the child's edge carrying what the
  node adds. Round r takes nodes whose depth has bit r set while their parent's has not, so no two neighbours go at
  once, and a chain of n nodes halves with each round.

Only the root is left after about log(depth) rounds. Then the cut nodes are put back in the opposite order: the total of
a node is its own part plus the total of the child that it had when it was cut out.

Defined cases: null roles and texts count as empty; null turns come first; turns of the same number are in order of role,
then MD5 of the text; repeated rows are turns of their own; rows without conversation id belong to no conversation and are
left out; a table without conversations has no nodes, not even a root; texts of any length are read whole; other
columns are not read. Turns and prefixes are told apart by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshift.llm.common import Scratch
from loomshift.operators.ordered import OrderedGroups

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTS = 4
LOW = (1 << 32) - 1
# ids whose decimals are joined in one row before they reach the digest of their node
IDS_PER_ROW = 4096
NODE, PARENT = ("conv_id", "depth"), ("up_conv", "up_depth")
TOTALS = ("n_leaves", "saved_tokens")


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 1), turn_key (role and text) and n_chars of each turn in order."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.md5(text.cast("binary"))
    narrow = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("n_chars"),
        F.unhex(F.md5(F.concat_ws("/", F.md5(role.cast("binary")), digest).cast("binary"))).alias("turn_key"))
    placed = OrderedGroups(narrow, ["conv_id"], ["turn", "role", "digest"]).row_number("at").result()
    return placed.select("conv_id", "at", "turn_key", "n_chars")


def rebuilt(turns: DataFrame, scratch: Scratch, block: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first one of their block of ids: the first h turns of conversation `c - c % block`, then
    c's own behind its first h, h = crc32(c) % (most + 1). Gives turns and members (conv_id, n_turns)."""
    turns = scratch.store(turns)
    h, base = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1), F.col("conv_id") - F.col("conv_id") % block
    sizes = scratch.store(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", h.alias("h"), base.alias("base")))
    # at most `block` members (twice for 0) take at most `most` turns of a base
    heads = turns.filter((F.col("conv_id") % block == 0) & (F.col("at") <= most)).select(F.col("conv_id").alias("base"), "at", "turn_key", "n_chars")
    taken = heads.groupBy("base").agg(F.count(F.lit(1)).alias("offered"))
    members = sizes.join(taken, "base", "left").withColumn("taken", F.least("h", F.coalesce("offered", F.lit(0)))).select(
        "conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    members = scratch.store(members)
    first = members.join(heads, "base").filter(F.col("at") <= F.col("h"))
    own = turns.join(members.select("conv_id", "h", "taken"), "conv_id").filter(F.col("at") > F.col("h"))
    own = own.withColumn("at", F.col("at") - F.col("h") + F.col("taken"))
    names = ("conv_id", "at", "turn_key", "n_chars")
    return first.select(*names).unionByName(own.select(*names)), members.select("conv_id", "n_turns")


def _key(sums: list[Column], depth: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", *[s.cast("string") for s in sums], depth.cast("string")).cast("binary")))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, n_chars, key of the prefix that ends here and up_key of the one before."""
    a, b = F.xxhash64("at", "turn_key"), F.xxhash64("turn_key", "at")
    halves = [a.bitwiseAND(LOW), F.shiftrightunsigned(a, 32), b.bitwiseAND(LOW), F.shiftrightunsigned(b, 32)]
    hashed = turns.select("conv_id", "at", "n_chars", *[x.alias(f"p{k}") for k, x in enumerate(halves)])
    running = OrderedGroups(hashed, ["conv_id"], ["at"])
    for k in range(PARTS):
        running = running.running_sum(F.col(f"p{k}"), f"s{k}")
    sums = [F.col(f"s{k}") for k in range(PARTS)]
    return running.result().select(
        "conv_id", F.col("at").alias("depth"), "n_chars", _key(sums, F.col("at")).alias("key"),
        _key([s - F.col(f"p{k}") for k, s in enumerate(sums)], F.col("at") - 1).alias("up_key"))


def digests(ends: DataFrame) -> DataFrame:
    """key and ends_sha256 from rows (key, conv_id): ids are joined in ranges, then each key's ranges go through one digest in order."""
    ranges = ends.groupBy("key", F.floor(F.col("conv_id") / IDS_PER_ROW).alias("range")).agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))).alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k == key:
                    sha.update(b"," + ids.encode())
                    continue
                if sha:
                    out.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["key", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["key", "ends_sha256"])

    return ranges.repartition("key").sortWithinPartitions("key", "range").select("key", "ids").mapInArrow(digest, "key binary, ends_sha256 string")


def _bit(column: str, r: int) -> Column:
    return F.shiftright(column, r).bitwiseAND(1) == 1


def contracted(tree: DataFrame, scratch: Scratch) -> DataFrame:
    """Subtree totals of every node. `tree` has conv_id, depth, up_conv, up_depth (root: null), n_children and own values in the
    columns of TOTALS (a leaf counts itself); gives conv_id, depth and the totals."""
    edges = [f"e_{t}" for t in TOTALS]
    state = scratch.store(tree.select(*NODE, *PARENT, F.col("n_children").alias("kids"), *TOTALS, *[F.lit(0).cast("long").alias(e) for e in edges]))
    bits = max(1, int(state.agg(F.max("depth")).first()[0] or 0).bit_length())
    ended: list[DataFrame] = []
    cut: list[DataFrame] = []
    while True:
        # rake; the root alone has depth 0
        leaves = state.filter("kids = 0")
        ended.append(leaves.select(*NODE, *TOTALS))
        gifts = leaves.filter("depth > 0").groupBy(*[F.col(p).alias(n) for p, n in zip(PARENT, NODE)]).agg(
            F.count(F.lit(1)).alias("gone"), *[F.sum(F.col(t) + F.col(e)).alias(f"g_{t}") for t, e in zip(TOTALS, edges)])
        inner = state.filter("kids > 0").join(gifts, list(NODE), "left").select(
            *NODE, *PARENT, (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids"),
            *[(F.col(t) + F.coalesce(f"g_{t}", F.lit(0))).alias(t) for t in TOTALS], *edges)
        inner = scratch.store(inner)
        if inner.isEmpty():
            break
        # compress
        r = len(cut) % bits
        lone = (F.col("kids") == 1) & (F.col("depth") > 0) & _bit("depth", r) & ~_bit("up_depth", r)
        removed = inner.filter(lone).select(
            *[F.col(n).alias(p) for n, p in zip(NODE, PARENT)], *[F.col(p).alias(f"to_{p}") for p in PARENT],
            *[F.col(t).alias(f"v_{t}") for t in TOTALS], *[F.col(e).alias(f"v_{e}") for e in edges], F.lit(True).alias("hit"))
        linked = inner.filter(~lone | F.col("up_depth").isNull()).join(removed, list(PARENT), "left")
        hit = F.col("hit").isNotNull()
        linked = scratch.store(linked.select(
            *NODE, *[F.when(hit, F.col(f"to_{p}")).otherwise(F.col(p)).alias(p) for p in PARENT], "kids", *TOTALS,
            *[(F.col(e) + F.coalesce(F.col(f"v_{t}") + F.col(f"v_{e}"), F.lit(0))).alias(e) for t, e in zip(TOTALS, edges)],
            *[F.when(hit, F.col(p)).alias(f"over_{p}") for p in PARENT],
            *[F.when(hit, F.col(f"v_{t}") + F.col(e)).alias(f"own_{t}") for t, e in zip(TOTALS, edges)]))
        cut.append(linked.filter("over_up_conv IS NOT NULL").select(
            *[F.col(f"over_{p}").alias(p) for p in PARENT], *NODE, *[f"own_{t}" for t in TOTALS]))
        state = linked.select(*NODE, *PARENT, "kids", *TOTALS, *edges)
    # nodes of round r went after the rake and the cuts of the rounds before, so their children are known by then
    known = ended[-1]
    results = [*ended]
    for rake, records in zip(reversed(ended[:-1]), reversed(cut)):
        back = scratch.store(records.join(known, list(NODE)).select(
            *[F.col(p).alias(n) for p, n in zip(PARENT, NODE)], *[(F.col(f"own_{t}") + F.col(t)).alias(t) for t in TOTALS]))
        results.append(back)
        known = scratch.store(known.unionByName(back).unionByName(rake))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def trie(turns: DataFrame, members: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The nodes of the trie over conversations: `turns` has conv_id, at, turn_key, n_chars, `members` conv_id and n_turns."""
    scratch = scratch or Scratch(turns.sparkSession, "trie")
    members = scratch.store(members)
    root = members.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    if root[0] is None:
        return members.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
                                                        "saved_tokens long, ends_sha256 string")
    # a conversation as long as the depth ends here
    steps = scratch.store(prefixes(turns))
    nil = _key([F.lit(0).cast("long")] * PARTS, F.lit(0).cast("long"))
    nodes = steps.groupBy("key", "up_key", "depth", "n_chars").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    top = members.sparkSession.range(1).select(
        nil.alias("key"), F.lit(None).cast("binary").alias("up_key"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_chars"),
        F.lit(root[0]).cast("long").alias("conv_id"), F.lit(root[1]).cast("long").alias("n_convs"))
    nodes = scratch.store(nodes.unionByName(top))
    kids = nodes.filter("depth > 0").groupBy(F.col("up_key").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = scratch.store(nodes.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # the root is known, so its children need no join; only nodes that have children are looked up
    above = nodes.filter("n_children > 0 AND depth > 0").select(F.col("key").alias("up_key"), F.col("conv_id").alias("up"))
    deep = nodes.filter("depth > 1").join(above, "up_key").select(*nodes.columns, "up")
    shallow = nodes.filter("depth <= 1").withColumn("up", F.when(F.col("depth") == 1, F.lit(root[0]).cast("long")))
    nodes = scratch.store(deep.unionByName(shallow))
    tree = nodes.select(
        *NODE, F.col("up").alias("up_conv"), F.when(F.col("depth") > 0, F.col("depth") - 1).alias("up_depth"), "n_children",
        (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"))
    totals = scratch.store(contracted(tree, scratch))
    ends = steps.join(members.select("conv_id", F.col("n_turns").alias("depth")), list(NODE)).select("key", "conv_id")
    ends = ends.unionByName(members.filter("n_turns = 0").select(nil.alias("key"), "conv_id"))
    out = nodes.join(totals, list(NODE)).join(digests(ends), "key", "left")
    return out.select(*NODE, F.col("up").alias("parent_conv_id"), "n_convs", "n_children", *TOTALS,
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def of_conversations(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are: conv_id, turn, role, text."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = scratch.store(numbered(conversations))
    return trie(turns, turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns")), scratch)


def of_rebuilt(conversations: DataFrame, block: int = 100, most: int = 5) -> DataFrame:
    """The trie of conversations that begin like the first of their block of ids; see `rebuilt`."""
    scratch = Scratch(conversations.sparkSession, "trie")
    return trie(*rebuilt(numbered(conversations), scratch, block, most), scratch)
