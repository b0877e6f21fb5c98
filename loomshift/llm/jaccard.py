"""Exact Jaccard join of word-shingle sets and the classes its links form.

1. Documents become sets of hashed shingles; equal sets are one set from then on.
2. Index lists: every set posts its prefix, the shingles among which linked sets must share a twentieth. Shingles are
   ordered rare first (by their frequency in a sample of the documents; the order changes the work, never the result),
   so lists of common passages stay short. Pairs on a list whose sizes rule out a link are skipped, and so are pairs that share
   too few lists; the members of a list too long for pairs are drawn together. What remains forms clusters.
3. A cluster is joined exactly, in blocks: the first set counts its overlap with all others from the
   lists of its shingles; a set that is highly similar to one already answered takes over its counts and corrects them by the
   shingles in which the two differ. Lists are sorted by set size and only the stretch of possible sizes is read.
4. Links become components.

A link needs 100 * intersection >= percent * union. Nothing is capped: clusters larger than a block are
joined block against block, each pair of blocks a task of its own.

Defined cases: null and blank texts have no shingle and link with nothing; a text with fewer words than a shingle is
one shingle; equal sets link with each other; rows that repeat are rows of one set; a null id never
names a class, and the class of null ids only is null; an empty table gives an empty result.
Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomshift.llm import arrays
from loomshift.llm.common import Scratch, columns, ddl, fresh
from loomshift.llm.components import Forest, components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1000          # sets joined against each other or against another block by a task,
BLOCK_SHINGLES = 500_000  # or their shingles
LONG = 256            # sets in a list up to which its pairs are looked at
SAMPLED = 16          # one document of so many tells how common shingles are
COMMON = 4            # sampled documents that make a shingle common
MOST_COMMON = 500_000  # common shingles that are broadcast, the most frequent ones


class Sets:
    """Distinct shingles of some texts, sorted by text and hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int):
        rows = len(offsets) - 1
        words = arrays.Words(data, offsets, lower=True)
        hashes = words.hashes()
        at, shingle = words.windows(hashes, size)
        doc = words.doc[at] if len(at) else np.zeros(0, np.int64)
        counts = np.diff(words.first)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            whole = [arrays.window_hash(hashes, words.first[d : d + 1], int(counts[d]))[0] for d in short]
            shingle, doc = np.concatenate([shingle, np.array(whole, np.uint64)]), np.concatenate([doc, short])
        order = np.lexsort((shingle, doc))
        shingle, doc = shingle[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
        self.shingle, self.doc = shingle[new], doc[new]
        self.n = np.bincount(self.doc, minlength=rows)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        total = np.concatenate([[np.uint64(0)], np.cumsum(arrays.mix(self.shingle + arrays.far(3)))])
        self.id = arrays.mix(total[self.first[1:]] - total[self.first[:-1]] + self.n.astype(np.uint64)).view(np.int64)


def sets_of(size: int):
    """Size and hash of each row's set."""
    def run(batches):
        for batch in batches:
            ids, ns = [], []
            for _, _, data, offsets in arrays.pieces(batch.column(1)):
                sets = Sets(data, offsets, size)
                ids.append(sets.id)
                ns.append(sets.n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(ns) if ns else np.zeros(0, np.int64), pa.int64()),
                 pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64), pa.int64())], names=["doc_id", "n", "set"])

    return run


def shingles_of(size: int):
    """All shingles of the texts, each text's once."""
    def run(batches):
        for batch in batches:
            for _, _, data, offsets in arrays.pieces(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(Sets(data, offsets, size).shingle.view(np.int64))], names=["shingle"])

    return run


def shared(n):
    """Shingles that linked sets must share among their prefixes, for the smaller of the two numbers."""
    return 1 + n // 20


def postings(size: int, percent: int, common):
    """Prefixes of the sets: shingle, set, size * 2**32 + position. A task posts equal sets once."""
    def run(batches):
        hot, level = common.value
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in arrays.pieces(batch.column(0)):
                sets = Sets(data, offsets, size)
                new = np.zeros(len(sets.id), bool)
                for k, (own, n) in enumerate(zip(sets.id.tolist(), sets.n.tolist(), strict=True)):
                    if n and own not in seen:
                        seen.add(own)
                        new[k] = True
                rank = np.zeros(len(sets.shingle), np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, sets.shingle), len(hot) - 1)
                    rank = np.where(hot[at] == sets.shingle, level[at], 0)
                order = np.lexsort((sets.shingle, rank, sets.doc))
                shingle = sets.shingle[order]
                place = np.arange(len(order)) - sets.first[sets.doc]  # documents stay in place
                n = sets.n[sets.doc]
                prefix = n - (percent * n + 99) // 100 + shared(n)
                post = (place < prefix) & new[sets.doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingle[post].view(np.int64)), pa.array(sets.id[sets.doc[post]]), pa.array((n[post] << 32) + place[post])],
                    names=["shingle", "set", "at"])

    return run


def list_pairs(percent: int):
    """Sorted postings to pairs (u, v, needed, 1) of sets that share a list; those of one long list are drawn together by
    pairs that need nothing else."""
    def run(batches):
        left = np.zeros((0, 3), np.int64)

        def lists(rows):
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            new = np.ones(len(rows), bool)  # several tasks may have posted a set
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            rows = rows[new]
            starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            lengths = np.diff(np.append(starts, len(rows)))
            first, second, needed = [starts[lengths == 2]], [starts[lengths == 2] + 1], []
            n = rows[:, 2] >> 32
            for s, length in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
                if length <= LONG:
                    a, b = np.triu_indices(length, 1)
                    first.append(a + s)
                    second.append(b + s)
                else:
                    # wherever sizes follow without a gap: more than may link, never less
                    by_size = s + np.argsort(n[s : s + length], kind="stable")
                    first.append(by_size[:-1])
                    second.append(by_size[1:])
                    needed.append(sum(map(len, first[:-1])) + np.arange(length - 1))
            first, second = np.concatenate(first), np.concatenate(second)
            need = np.minimum(shared(n[first]), shared(n[second]))
            if needed:
                need[np.concatenate(needed)] = 1
            some = 100 * np.minimum(n[first], n[second]) >= percent * np.maximum(n[first], n[second])
            u, v, need = rows[first[some], 1], rows[second[some], 1], need[some]
            for at in range(0, len(u), 100_000):
                piece = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(u[piece]), pa.array(v[piece]), pa.array(need[piece])], names=["u", "v", "needed"])

        for batch in batches:
            rows = np.concatenate([left, np.column_stack([batch.column(k).to_numpy() for k in range(3)])])
            if not len(rows):
                continue
            # the last list may go on in the next batch
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0], "left"))
            if cut:
                yield from lists(rows[:cut])
            left = rows[cut:]
        if len(left):
            yield from lists(left)

    return run


def tokens_of(size: int):
    """Hash and shingles (as bytes) of each row's set."""
    def run(batches):
        for batch in batches:
            for row, to, data, offsets in arrays.pieces(batch.column(0)):
                sets = Sets(data, offsets, size)
                blobs = [sets.shingle[sets.first[k] : sets.first[k + 1]].tobytes() for k in range(to - row)]
                yield pa.RecordBatch.from_arrays([pa.array(sets.id), pa.array(blobs, pa.binary())], names=["set", "tokens"])

    return run


def overlaps(tokens: list[np.ndarray], sizes: np.ndarray, rows: np.ndarray, percent: int):
    """For every set of `rows`, its number of common shingles with the sets of possible size (sets are sorted by size), else 0.

    Counts of a set answered before are corrected by the shingles in which the two differ, if these are fewer.
    """
    names, number = np.unique(np.concatenate(tokens), return_inverse=True)
    owner = np.repeat(np.arange(len(tokens)), sizes)
    by_name = np.argsort(number, kind="stable")  # lists sorted by set size
    members = owner[by_name]
    total = len(tokens)
    places = number[by_name] * total + members  # ascending: the place of a member in a list is found by search
    first = np.concatenate([[0], np.cumsum(sizes)])
    own = [number[first[k] : first[k + 1]] for k in range(total)]

    def count(names_of, low, high):
        """Members low..high on the lists of the names; the stretches before and after are skipped."""
        if not len(names_of) or low >= high:
            return np.zeros(total, np.int64)
        begin = np.searchsorted(places, names_of * total + low)
        lengths = np.searchsorted(places, names_of * total + high) - begin
        skip = np.repeat(begin - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        return np.bincount(members[np.arange(int(lengths.sum())) + skip], minlength=total)

    # the set answered before with which a set shares most, by what answered sets have counted
    most, like = np.zeros(total, np.int64), np.full(total, -1)
    answers: dict[int, tuple[int, np.ndarray]] = {}
    for row in rows.tolist():
        z = int(like[row])
        low = int(np.searchsorted(sizes, -(-percent * int(sizes[row]) // 100)))
        high = int(np.searchsorted(sizes, 100 * int(sizes[row]) // percent, "right"))
        if z >= 0 and sizes[row] + sizes[z] - 2 * most[row] < sizes[row] // 2:
            # smaller sets are answered first, so z's stretch begins no later; it may end sooner
            end, counts = answers[z]
            more, less = np.setdiff1d(own[row], own[z], True), np.setdiff1d(own[z], own[row], True)
            counts = counts + count(more, low, min(end, high)) - count(less, low, min(end, high)) + count(own[row], end, high)
            counts[:low] = 0
        else:
            counts = count(own[row], low, high)
        answers[row] = (high, counts)
        better = counts > most
        most[better], like[better] = counts[better], row
        yield row, counts


def join_clusters(percent: int):
    """Rows (cluster, a, b, block, set, weight, tokens) sorted by the first three, to links: set, the root of its local
    component, and the number of documents it links with. Sets of block a meet those of block b; a = b is a block against itself."""
    def run(batches):
        held: list = []
        key = None

        def joined(rows):
            blobs = [np.frombuffer(r[3], np.uint64) for r in rows]
            sizes = np.array([len(b) for b in blobs])
            order = np.argsort(sizes, kind="stable")
            tokens, sizes = [blobs[k] for k in order], sizes[order]
            ids = [rows[k][1] for k in order]
            weight = np.array([rows[k][2] for k in order])
            block = np.array([rows[k][0] for k in order])
            two = block.min() != block.max()
            left = np.flatnonzero(block == block.min())
            forest = Forest()
            degree = np.zeros(len(ids), np.int64)
            for row, counts in overlaps(tokens, sizes, left, percent):
                linked = 100 * counts >= percent * (sizes + sizes[row] - counts)
                linked &= (block != block[row]) if two else (np.arange(len(ids)) != row)
                to = np.flatnonzero(linked)
                degree[row] += weight[to].sum()
                if two:
                    degree[to] += weight[row]
                for k in to.tolist():
                    forest.join(ids[row], ids[k])
            return [(ids[k], forest.root(ids[k]), int(degree[k])) for k in np.flatnonzero(degree).tolist()]

        def out(links):
            if links:
                u, v, d = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.int64())], names=["u", "v", "links"])

        def needed(key, rows):
            # a pair of blocks needs both of them
            return len(rows) > 1 and (key[1] == key[2] or len({r[0] for r in rows}) == 2)

        for batch in batches:
            links = []
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for cluster, a, b, *row in zip(*columns, strict=True):
                if (cluster, a, b) != key:
                    if held and needed(key, held):
                        links += joined(held)
                    held, key = [], (cluster, a, b)
                held.append(row)
            yield from out(links)
        if held and needed(key, held):
            yield from out(joined(held))

    return run


def classes(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links), n_links (other rows linked with it),
    set_id (hash of its set) and class_id (a set that stands for the class; null for texts without shingles)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sets = scratch.store(rows.mapInArrow(sets_of(size), f"doc_id {kind}, n long, `set` long"))
    same = scratch.store(sets.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("n").alias("n")))

    texts = rows.select("text").filter(F.length("text") > 0)
    sampled = texts.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    hot = (sampled.distinct().mapInArrow(shingles_of(size), "shingle long").groupBy("shingle").count()
           .filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).toArrow())
    names, level = hot["shingle"].to_numpy().view(np.uint64), hot["count"].to_numpy()
    by_name = np.argsort(names)
    common = spark.sparkContext.broadcast((names[by_name], level[by_name]))

    posted = texts.mapInArrow(postings(size, percent, common), "shingle long, `set` long, `at` long")
    lists = posted.repartition("shingle").sortWithinPartitions("shingle")
    pairs = lists.mapInArrow(list_pairs(percent), "u long, v long, needed long")
    near = scratch.store(pairs.groupBy("u", "v").agg(F.min("needed").alias("needed"), F.count("*").alias("n"))
                         .filter("n >= needed").select("u", "v"))
    clusters = scratch.store(components(near, scratch))

    # members of clusters, dealt into blocks; a set takes part in every pair of blocks that has its own
    nodes = clusters.join(same, F.col("node") == F.col("set")).drop("node")
    blocks = nodes.groupBy("root").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = scratch.store(nodes.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")))
    # texts by the id of a row that has the set; ids are not unique, so the set is told from the text again
    wanted = members.select(F.col("rep").alias("_rep")).distinct()
    near_texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi").select("text")
    tokens = scratch.store(near_texts.mapInArrow(tokens_of(size), "`set` long, tokens binary").dropDuplicates(["set"]))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                                  lambda b: F.struct(F.least("block", b).alias("a"), F.greatest("block", b).alias("b"))))
    dealt = (members.join(tokens, "set").withColumn("p", pairs)
             .select(F.col("root").alias("cluster"), F.col("p.a").alias("a"), F.col("p.b").alias("b"), "block", "set", "weight", "tokens"))
    dealt = dealt.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b")
    links = scratch.store(dealt.mapInArrow(join_clusters(percent), "u long, v long, links long"))
    scratch.drop(near, clusters, members, tokens)

    degree = links.groupBy(F.col("u").alias("set")).agg(F.sum("links").alias("links"))
    roots = components(links.select("u", "v"), scratch)
    named = roots.join(same, F.col("node") == F.col("set"))
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    found = named.select("root", "set").join(least, "root").select("set", "root", "component")
    found = scratch.store(same.join(found, "set", "left").join(degree, "set", "left").select(
        "set", F.coalesce("root", "set").alias("class_id"), F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    return sets.join(found, "set", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("set").alias("set_id"), "class_id")


def with_set(size: int, place: int, name: str):
    """Rows with the hash of their set."""
    def run(batches):
        for batch in batches:
            ids = [Sets(data, offsets, size).id for _, _, data, offsets in arrays.pieces(batch.column(place))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64), pa.int64())],
                names=[*batch.schema.names, name])

    return run


def unique(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, the one of the smallest id (ids before null); documents without a word all stay."""
    marked = classes(docs, size, percent, id_col, text_col).filter("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_id"))
    own, key = fresh(docs, "_set"), fresh(docs, "_key")
    kept = marked.groupBy("class_id").agg(first.alias("k")).select(F.xxhash64("k.none", "k.doc_id", "k.set_id").alias(key))
    some = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.filter(some)
    rows = rows.mapInArrow(with_set(size, docs.columns.index(text_col), own), ddl(rows, f"{own} long"))
    rows = rows.withColumn(key, F.xxhash64(F.col(id_col).isNull(), F.col(id_col), own))
    return rows.join(kept, key, "left_semi").dropDuplicates([key]).select(*columns(docs)).unionByName(docs.filter(~some))
