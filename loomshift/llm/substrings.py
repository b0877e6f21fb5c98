"""Removing repeated passages with an FM-index per shard.

A window of `size` words is removed where the same words also begin a window of a document with a smaller id.

1. Every window is routed by its anchor, the smallest hash among the `gram`-word passages in it, so equal windows
   meet. Anchors that only one document has cannot repeat and go no further.
2. Neighbouring windows of a document with one anchor are a segment. Equal segments of all documents are one
   entry with the smallest id. Anchors that many documents have are routed by whole windows instead, so no task gets
   all surroundings of a common phrase.
3. Shards of entries, of a bounded number of words, get a compressed FM-index: the Burrows-Wheeler transform in a wavelet matrix of
   packed bits. All entries are streamed against it by backward search, a word per step for all windows at
   once; a window that is left with its own interval alone drops out. The steps survived are the
   matching statistics, and intervals that reach the window size give the smallest id that has the window.
4. Windows with a smaller id become word intervals, and each document keeps the words outside of them.

Defined cases: null texts have no words; texts shorter than a window are kept; rows of one id never remove each other's words;
rows with a null id are kept whole and remove nothing; an empty table gives an empty result. Words are
told apart by 64-bit hashes.
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

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD_WORDS = 400_000  # words in an FM-index, and those of one anchor more
MOST_WORDS = 16        # depth to which the suffixes are sorted
BUSY = 2_000           # documents from which an anchor is routed by whole windows


class FMIndex:
    """Compressed index of a sequence of numbers; 0 separates its parts. Answers passages of up to 16 numbers:
    the suffixes are sorted that deep, which is all that backward search of such passages needs."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        rank = text.astype(np.int64)
        for step in (1, 2, 4, 8):
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            _, rank = np.unique(rank * (n + int(text.max()) + 2) + after, return_inverse=True)
        self.suffixes = np.argsort(rank, kind="stable")
        last = text[self.suffixes - 1]  # before the first number stands the last one, a separator
        self.levels = max(1, int(text.max()).bit_length())
        counts = np.bincount(text, minlength=int(text.max()) + 1)
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bits = (last >> level & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bits, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]]).astype(np.int32))
            self.zeros.append(n - int(bits.sum()))
            last = np.concatenate([last[~bits], last[bits]])
        # where the occurrences of each number begin below the last level
        order = np.zeros(len(counts), np.int64)
        order[last[::-1]] = np.arange(n - 1, -1, -1)
        self.shift = begin - order

    def step(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One step of backward search: borders of the suffixes that begin with the numbers and go on below `at`."""
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            below = self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.before[k][word] + np.bitwise_count(below)
            at = np.where(numbers >> level & 1, self.zeros[k] + ones, at - ones)
        return at + self.shift[numbers]

    def repeated(self, text: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the passages of `size` numbers at `starts`: which of them occur more than once, and their intervals of suffixes."""
        left = np.arange(len(starts))
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.suffixes), np.int64)
        for back in range(size - 1, -1, -1):
            numbers = text[starts[left] + back]
            low, high = self.step(numbers, low), self.step(numbers, high)
            more = high - low > 1
            left, low, high = left[more], low[more], high[more]
            if not len(left):
                break
        return left, low, high


def anchors(words: arrays.Words, hashes: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows and their anchors."""
    at = words.windows(hashes, size)[0]
    if not len(at):
        return at, np.zeros(0, np.int64)
    grams = arrays.window_hash(hashes, np.arange(len(hashes) - gram + 1), gram)
    least = grams[at].copy()
    for k in range(1, size - gram + 1):
        np.minimum(least, grams[at + k], out=least)
    return at, least.view(np.int64)


def anchors_of(size: int, gram: int):
    """The anchors of each document, each once."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, _, data, offsets in arrays.pieces(batch.column(1)):
                words = arrays.Words(data, offsets)
                at, anchor = anchors(words, words.hashes(), size, gram)
                doc = words.doc[at]
                order = np.lexsort((anchor, doc))
                anchor, doc = anchor[order], doc[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[new]), pa.array(ids[row + doc[new]])], names=["anchor", "doc_id"])

    return run


def segments_of(size: int, gram: int):
    """Segments of the windows whose anchors are in a document's lists: doc_id, sig, start, route, segment."""
    def run(batches):
        for batch in batches:
            ids, sigs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            wanted, busy = batch.column(3), batch.column(4)
            for row, to, data, offsets in arrays.pieces(batch.column(2)):
                words = arrays.Words(data, offsets)
                hashes = words.hashes()
                at, anchor = anchors(words, hashes, size, gram)
                first = np.searchsorted(at, words.first)
                out: tuple[list, ...] = ([], [], [], [], [])
                for k in range(to - row):
                    s, e = first[k], first[k + 1]
                    some = np.isin(anchor[s:e], np.array(wanted[row + k].as_py(), np.int64))
                    if not some.any():
                        continue
                    many = np.isin(anchor[s:e], np.array(busy[row + k].as_py(), np.int64)) & some
                    text = words.data[words.offsets[k] : words.offsets[k + 1]].tobytes().split()
                    base = int(words.first[k])
                    own = anchor[s:e]
                    # runs of wanted windows with one anchor; a busy anchor's windows stand alone
                    new = np.ones(e - s, bool)
                    new[1:] = (own[1:] != own[:-1]) | many[1:]
                    begins = np.flatnonzero(new)
                    ends = np.append(begins[1:], e - s)
                    route = own.copy()
                    if many.any():
                        route[many] = arrays.window_hash(hashes, at[s:e][many], size).view(np.int64)
                    for b, f in zip(begins[some[begins]].tolist(), ends[some[begins]].tolist(), strict=True):
                        start = int(at[s + b]) - base
                        for column, value in zip(out, (ids[row + k], sigs[row + k], start, route[b],
                                                       b" ".join(text[start : start + f - b + size - 1])), strict=True):
                            column.append(value)
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(np.array(c), pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary()).cast(pa.string())],
                        names=["doc_id", "sig", "start", "route", "segment"])

    return run


def least_ids(entries: pa.Table, size: int) -> list[np.ndarray]:
    """Per entry (first, segment), for each of its windows the smallest id of any entry that has it."""
    first = entries["first"].to_numpy()
    data, offsets = arrays.buffers(entries["segment"])
    words = arrays.Words(data, offsets)
    hashes = words.hashes()
    _, number = np.unique(hashes, return_inverse=True)
    # one separator behind each entry
    text = np.zeros(len(hashes) + len(first), np.int64)
    place = np.arange(len(hashes)) + words.doc
    text[place] = number + 1
    starts = words.windows(hashes, size)[0]
    owner = words.doc[starts]
    least = first[owner].copy()
    index = FMIndex(text)
    left, low, high = index.repeated(text, place[starts], size)
    if len(left):
        entry = np.zeros(len(text), np.int64)
        entry[place] = words.doc
        ids = np.append(first[entry[index.suffixes]], 0)
        borders, back = np.unique(low, return_inverse=True)
        ends = np.zeros(len(borders), np.int64)
        ends[back] = high
        found = np.minimum.reduceat(ids, np.column_stack([borders, ends]).ravel())[::2]
        least[left] = found[back]
    return np.split(least, np.searchsorted(owner, np.arange(1, len(first))))


def shards(size: int):
    """Entries (route, segment, first) sorted by route, to segment and the smallest ids of its windows."""
    def run(batches):
        held, n = [], 0

        def answer(rows):
            entries = pa.Table.from_batches(rows)
            found = least_ids(entries, size)
            yield pa.RecordBatch.from_arrays(
                [entries["segment"].combine_chunks(), pa.array(found, pa.list_(pa.int64()))], names=["segment", "least"])

        for batch in batches:
            routes = batch.column(0).to_numpy()
            lengths = np.diff(arrays.buffers(batch.column(1))[1]) // 6 + 1  # words, about
            border = np.flatnonzero(np.concatenate([[False], routes[1:] != routes[:-1]]))
            at = 0
            total = np.concatenate([[0], np.cumsum(lengths)])
            if held and held[-1].column(0)[-1].as_py() != routes[0]:
                border = np.concatenate([[0], border])
            for b in border.tolist():
                # a shard ends with an anchor once it is large enough
                if n + total[b] - total[at] >= SHARD_WORDS:
                    rows = [*held, batch.slice(at, b - at)] if b > at else held
                    yield from answer(rows)
                    held, n, at = [], 0, b
            if at < batch.num_rows:
                held.append(batch.slice(at))
                n += int(total[-1] - total[at])
        if held:
            yield from answer(held)

    return run


def intervals_of(size: int):
    """Segments with the smallest ids of their windows, to intervals of words that go: doc_id, sig, from, to."""
    def run(batches):
        for batch in batches:
            ids, sigs, starts = (batch.column(k).to_numpy() for k in range(3))
            least = batch.column(3)
            lengths = np.diff(least.offsets.to_numpy())
            row = np.repeat(np.arange(len(ids)), lengths)
            within = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
            gone = least.flatten().to_numpy() < ids[row]
            row, at = row[gone], (starts[row] + within)[gone]
            if not len(row):
                continue
            # windows of a segment that follow each other are one interval
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
            begin = np.flatnonzero(new)
            last = np.append(begin[1:], len(row)) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row[begin]]), pa.array(sigs[row[begin]]), pa.array(at[begin]), pa.array(at[last] + size)],
                names=["doc_id", "sig", "from", "to"])

    return run


def kept_of():
    """Rows (..., text, gone) to n_words, n_removed and the kept words."""
    def run(batches):
        for batch in batches:
            texts, gone = batch.columns[-2:]
            n_words, n_removed, kept = [], [], []
            for text, cut in zip(texts, gone, strict=True):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                intervals = cut.as_py()
                if intervals:
                    stay = np.ones(len(words), bool)
                    for x in intervals:
                        stay[x["from"] : x["to"]] = False
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*batch.schema.names[:-2], "n_words", "n_removed", "kept"])

    return run


def removed(docs: DataFrame, size: int = 13, gram: int = 5, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, sig, gone): the intervals of words that go, per id and hash of the text. `size` is at most 16."""
    if not gram <= size <= MOST_WORDS:
        raise ValueError(f"windows have {gram} to {MOST_WORDS} words, not {size}: the index is sorted that deep")
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    posted = rows.mapInArrow(anchors_of(size, gram), "anchor long, doc_id long")
    repeated = scratch.store(posted.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
                             .filter("low < high").select("anchor", (F.col("n") > BUSY).alias("busy")))
    lists = scratch.store(posted.join(repeated, "anchor").groupBy("doc_id").agg(
        F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("busy"), F.col("anchor"))).alias("busy")))
    marked = rows.join(lists, "doc_id").select("doc_id", F.xxhash64("text").alias("sig"), "text", "anchors", "busy")
    segments = scratch.store(marked.mapInArrow(segments_of(size, gram), "doc_id long, sig long, start long, route long, segment string"))
    scratch.drop(repeated, lists)
    entries = segments.groupBy("route", "segment").agg(F.min("doc_id").alias("first"))
    dealt = entries.repartition("route").sortWithinPartitions("route")
    least = scratch.store(dealt.mapInArrow(shards(size), "segment string, least array<long>")
                          .select(F.md5(F.col("segment").cast("binary")).alias("key"), "least"))
    # a segment has one route, so its text names its answer
    answered = (segments.select("doc_id", "sig", "start", F.md5(F.col("segment").cast("binary")).alias("key"))
                .join(least.dropDuplicates(["key"]), "key").select("doc_id", "sig", "start", "least"))
    gone = scratch.store(answered.mapInArrow(intervals_of(size), "doc_id long, sig long, `from` long, `to` long")
                         .groupBy("doc_id", "sig").agg(F.collect_set(F.struct("from", "to")).alias("gone")))
    scratch.drop(segments, least)
    return gone


def deduplicate(docs: DataFrame, keep: list[str], size: int = 13, gram: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns `keep` with n_words, n_removed and kept, the words that stay."""
    own = docs.select(*keep)
    own_columns = columns(own, ("n_words", "n_removed", "kept"))
    doc, text, same, sig, cut = (fresh(own, x) for x in ("_doc", "_text", "_same", "_sig", "_gone"))
    gone = removed(docs, size, gram, id_col, text_col).select(F.col("doc_id").alias(same), F.col("sig").alias(sig), F.col("gone").alias(cut))
    rows = docs.select(*keep, F.col(id_col).cast("long").alias(doc), F.col(text_col).alias(text))
    joined = rows.join(gone, (F.col(doc) == F.col(same)) & (F.xxhash64(text) == F.col(sig)), "left").select(*own_columns, text, cut)
    return joined.mapInArrow(kept_of(), ddl(joined.drop(text, cut), "n_words long", "n_removed long", "kept string"))
