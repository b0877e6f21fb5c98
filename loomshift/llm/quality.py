"""Quality classification by nearest-neighbour voting in a latent-semantic space.

A text becomes term frequencies: three-character shapes (letters, digits, signs by class) and
hashed words, and the parts of words and passages that repeat. A truncated singular value decomposition of the
labelled sample gives the latent space. The labelled vectors are broadcast, and every document is compared with all
of them by exact cosine products, block by block; the `neighbours` nearest vote with weight cosine ** `power`.

The sample is bounded by `sample` rows, chosen by the hash of their ids. All documents are scored over their whole text.

Defined cases: null and empty texts, and texts without any neighbour, score the mean label; without any labelled row
every score is 0.5 and every document is accepted; labels other than 0 and 1 and null are not learnt from; contradicting labels
of one id count as 0; of rows that share an id the one whose text has the smallest hash is learnt from; equal cosines count in the order of the sample.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshift.llm import arrays
from loomshift.llm.common import columns, ddl, fresh

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHAPES, WORDS, REPEATS = 4096, 2048, 3
TERMS = SHAPES + WORDS + REPEATS
ROWS = 256  # documents in a block


def _classes() -> np.ndarray:
    table = np.full(256, 15, np.int64)  # other signs
    for k, signs in enumerate([" ", "\t\r\n\x0b\x0c", "0123456789", ".", ",;:", "!", "?", "#$%&*@^~+=<>", "()[]{}", "|/\\", "-_", "'\"`"]):
        table[[ord(c) for c in signs]] = k
    table[65:91] = 12
    table[97:123] = 13
    table[128:] = 14
    return table


CLASS = _classes()


def repeated(words: arrays.Words, hashes: np.ndarray, rows: int) -> np.ndarray:
    """Parts of the words that equal the word before, or the one before that, and of five-word passages seen earlier in the text."""
    out = np.zeros((rows, REPEATS))
    total = np.maximum(1, np.diff(words.first))
    for back in (1, 2):
        at = np.arange(back, len(hashes))
        same = (hashes[at] == hashes[at - back]) & (words.doc[at] == words.doc[at - back])
        out[:, back - 1] = np.bincount(words.doc[at[same]], minlength=rows) / total
    at, passages = words.windows(hashes, 5)
    if len(at):
        doc = words.doc[at]
        key = arrays.mix(passages + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(at), bool)
        again[first] = False
        out[:, 2] = np.bincount(doc[again], minlength=rows) / total
    return out


def terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term weights of some texts: one row per text, blocks of unit length."""
    rows = len(offsets) - 1
    words = arrays.Words(data, offsets)
    classes = CLASS[words.data]
    doc = np.repeat(np.arange(rows), np.diff(words.offsets))
    if len(classes) > 2:
        inside = doc[2:] == doc[:-2]
        shape = (doc[2:] * SHAPES + classes[:-2] * 256 + classes[1:-1] * 16 + classes[2:])[inside]
    else:
        shape = np.zeros(0, np.int64)
    shapes = np.bincount(shape, minlength=rows * SHAPES).reshape(rows, SHAPES)
    hashes = words.hashes()
    named = words.doc * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64)
    named = np.bincount(named, minlength=rows * WORDS).reshape(rows, WORDS)
    blocks = []
    for counts in (shapes, named):
        weight = np.sqrt(counts.astype(np.float32))
        blocks.append(weight / np.maximum(np.linalg.norm(weight, axis=1, keepdims=True), 1e-9))
    blocks[1] *= 0.5
    return np.hstack([*blocks, np.sqrt(repeated(words, hashes, rows)).astype(np.float32)])


def sparse_terms(batches):
    """Labels with the indexes and weights of their terms."""
    for batch in batches:
        labels = batch.column(0)
        for row, to, data, offsets in arrays.pieces(batch.column(1), 1 << 18):
            for at in range(row, to, ROWS):
                end = min(to, at + ROWS)
                weights = terms(data, offsets[at - row : end - row + 1])
                index = [np.flatnonzero(w).astype(np.int32) for w in weights]
                yield pa.RecordBatch.from_arrays(
                    [labels.slice(at, end - at), pa.array(index, pa.list_(pa.int32())),
                     pa.array([w[i] for w, i in zip(weights, index, strict=True)], pa.list_(pa.float32()))],
                    names=["label", "index", "weight"])


class Model:
    """Latent space, and the labelled vectors in it."""

    def __init__(self, weights: np.ndarray, labels: np.ndarray, rank: int, neighbours: int, power: int):
        spread = np.random.default_rng(1).normal(size=(weights.shape[1], rank + 8)).astype(np.float32)
        idf = 1 + np.log(len(weights) / (1.0 + np.count_nonzero(weights, axis=0)))
        self.idf = np.maximum(idf, 0.2).astype(np.float32)
        weights *= self.idf  # in place: the sample is the largest thing the driver holds
        basis = spread
        for _ in range(4):  # power iterations towards the leading right singular vectors
            basis, _ = np.linalg.qr(weights.T @ (weights @ basis))
        _, _, turn = np.linalg.svd(weights @ basis, full_matrices=False)
        leading = (basis @ turn[:rank].T).astype(np.float32)
        self.vectors = unit(weights @ leading)
        self.space = np.ascontiguousarray(self.idf[:, None] * leading)
        self.labels, self.mean = labels.astype(np.float32), float(labels.mean())
        self.neighbours, self.power = min(neighbours, len(labels)), power

    def score(self, weights: np.ndarray) -> np.ndarray:
        cosine = unit(weights @ self.space) @ self.vectors.T
        order = np.argpartition(-cosine, self.neighbours - 1, axis=1)[:, : self.neighbours]
        votes = np.clip(np.take_along_axis(cosine, order, axis=1), 0, 1).astype(np.float64) ** self.power
        total = votes.sum(axis=1)
        return np.where(total > 1e-12, (votes * self.labels[order]).sum(axis=1) / np.maximum(total, 1e-12), self.mean)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = 5000, rank: int = 48, neighbours: int = 15, power: int = 8) -> Model | None:
    """Model of at most `sample` labelled rows that `training` (a condition on the id) allows, or None without any."""
    known = (labels.filter(F.col(label_col).isin(0, 1) & F.coalesce(training, F.lit(False)))
             .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("label"))
             .join(docs.filter(F.length(text_col) > 0).select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi"))
    chosen = known.orderBy(F.md5(F.col("_id").cast("string").cast("binary")), "_id").limit(sample)
    rows = (docs.filter(F.length(text_col) > 0).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
            .join(F.broadcast(chosen), "_id"))
    # at most `sample` ids, each with the text of the smallest hash, in one order: equal runs learn from equal rows
    rows = (rows.groupBy("_id", "label").agg(F.min_by("text", F.struct(F.md5(F.col("text").cast("binary")), "text")).alias("text"))
            .orderBy(F.md5(F.col("_id").cast("string").cast("binary")), "_id"))
    # sparse rows: each text has at most TERMS terms
    table = rows.select("label", "text").mapInArrow(sparse_terms, "label int, index array<int>, weight array<float>").toArrow()
    if not table.num_rows:
        return None
    weights, row = np.zeros((table.num_rows, TERMS), np.float32), 0
    labels = table["label"].to_numpy()
    for batch in table.to_batches():  # without a second copy of all rows
        for index, weight in zip(batch.column(1), batch.column(2), strict=True):
            weights[row, index.values.to_numpy()] = weight.values.to_numpy()
            row += 1
    del table
    return Model(weights, labels, rank, neighbours, power)


def scorer(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            scores = []
            for row, to, data, offsets in arrays.pieces(batch.column(batch.num_columns - 1), 1 << 18):  # the text is last
                for at in range(row, to, ROWS):
                    weights = terms(data, offsets[at - row : min(to, at + ROWS) - row + 1])
                    scores.append(model.score(weights))
            score = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], score], names=[*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of `docs` with the score, from 0 to 1: the share of label 1 among the neighbours."""
    own = docs.select(*keep)
    own_columns, text = columns(own, ("score",)), fresh(own, "_text")
    if model is None:
        return own.select(*own_columns, F.lit(0.5).alias("score"))
    rows = docs.select(*keep, F.col(text_col).alias(text)).select(*own_columns, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(scorer(shared), ddl(rows.drop(text), "score double"))


def accepted(docs: DataFrame, model: Model | None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents that score `threshold` or more, unchanged. Each row is judged by its text alone, so nothing is shuffled.
    Without a model nothing was learnt, so no document is rejected."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            scores = []
            for row, to, data, offsets in arrays.pieces(batch.column(place), 1 << 18):
                for at in range(row, to, ROWS):
                    scores.append(shared.value.score(terms(data, offsets[at - row : min(to, at + ROWS) - row + 1])))
            yield batch.filter(pa.array(np.concatenate(scores) >= threshold if scores else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
