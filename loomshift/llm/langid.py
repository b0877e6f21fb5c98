"""Language identification by interpolated Kneser-Ney character models.

Texts become letters, lower-cased, with the marks that stand on them (vowel signs, accents); everything else is a single blank between words. All n-grams of all training texts
are counted per language; the counts meet in Spark. Per language and order the model keeps n-gram keys (hashes) in
sorted arrays with their log probability, and contexts with their back-off weight. A text takes the
language of the lowest cross-entropy per letter. Its confidence is the share of that language when
entropies are weighed as exp(-bits * sharpness). Texts whose entropy is higher than all but a set part
of the language's texts are marked as rejected. That limit is taken from a sixteenth of the labelled texts, by the hash of the text,
which is left out of the counts; a language of fewer than `CALIBRATED` labelled texts keeps all of them and takes its limit from them.

No n-gram is left out. Up to `max_grams` n-grams are one dense model. More of them become weights that add up to the same
log probabilities, worked out in Spark and split by hash range into parts of about `max_grams` weights; a task
holds one part at a time and adds it to some megabytes of texts. `min(languages)` wins ties.

Defined cases: null texts and texts without a letter give `und`, score 0, not rejected; without any labelled
text every prediction is `und`; rows that repeat are judged alike; other columns are kept by `score`.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshift.llm import arrays
from loomshift.llm.common import Scratch, columns, ddl, fresh

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLANK = 0x20
DISCOUNT = 0.75
CALIBRATED = 320  # labelled texts from which on a language leaves some out of the counts
CELLS = 4_000_000  # n-grams times languages of a dense model, and windows times languages that a task adds up at a time
CHUNK = 8 << 20    # letters that a task adds up at a time
_letters: list[np.ndarray] = []


def letter_table() -> tuple[np.ndarray, np.ndarray]:
    """Code point to its lower-case letter, its mark, or a blank; and which code points are marks."""
    if not _letters:
        table, marks = np.full(0x110000, BLANK, np.int32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind in "LM":
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
            if kind == "M":
                marks[c] = True
        _letters.extend([table, marks])
    return _letters[0], _letters[1]


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of some texts, each text between blanks, and the text each letter belongs to."""
    texts = data[offsets[0] : offsets[-1]]
    begins = (texts & 0xC0) != 0x80  # first bytes of code points
    codes = np.frombuffer(texts.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum(begins)])
    borders = at[offsets - offsets[0]]
    table, marks = letter_table()
    mark = marks[codes]
    codes = table[codes]
    doc = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    if not len(codes):
        return codes, doc
    if mark.any():
        # marks (vowel signs, accents) belong to the letter before them; others are blanks
        to = np.maximum.accumulate(np.where(mark, 0, np.arange(len(codes))))
        codes[mark & (mark[to] | (codes[to] == BLANK) | (doc[to] != doc))] = BLANK
    new = np.ones(len(codes), bool)
    new[1:] = doc[1:] != doc[:-1]
    blank = codes == BLANK
    # a blank stays only between letters of a text
    keep = ~blank
    keep[1:] |= ~blank[:-1] & ~new[1:]
    codes, doc = codes[keep], doc[keep]
    # a text begins with a blank, so that first letters are seen as such
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, int)
    return np.insert(codes, first, BLANK), np.insert(doc, first, doc[first])


def keys(codes: np.ndarray, doc: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends and keys of all n-grams that lie within one text."""
    n = len(codes)
    if n < order:
        return np.zeros(0, int), np.zeros(0, np.int64)
    total = np.zeros(n - order + 1, np.uint64)
    for j in range(order):
        total = total * np.uint64(0x110000 + 39) + codes[j : n - order + 1 + j].astype(np.uint64)
    ends = np.arange(order - 1, n)
    same = doc[: n - order + 1] == doc[order - 1 :]
    return ends[same], arrays.mix(total[same] + arrays.far(order)).view(np.int64)


def counter(order: int):
    """Counts of the top-order n-grams of a task, by language: lang, the n-gram as text, count."""
    def count(batches):
        held: dict[str, list] = {}

        def merge(parts):
            grams = np.concatenate([g for g, _ in parts])
            counts = np.concatenate([c for _, c in parts])
            grams, back = np.unique(grams, return_inverse=True)
            return [(grams, np.bincount(back, weights=counts).astype(np.int64))]

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for row, to, data, offsets in arrays.pieces(batch.column(0)):
                codes, doc = letters(data, offsets)
                if len(codes) < order:
                    continue
                same = doc[: len(codes) - order + 1] == doc[order - 1 :]
                names, number = np.unique(np.array(langs[row:to]), return_inverse=True)
                own = number[doc[: len(codes) - order + 1][same]]
                # exact n-grams: dense alphabet of the piece, packed into one number
                alphabet, dense = np.unique(codes, return_inverse=True)
                if len(alphabet) ** order < 2**62:
                    view = np.lib.stride_tricks.sliding_window_view(dense, order)[same]
                    packed = np.zeros(len(view), np.int64)
                    for j in range(order):
                        packed = packed * len(alphabet) + view[:, j]
                    for k, lang in enumerate(names):
                        values, counts = np.unique(packed[own == k], return_counts=True)
                        grams = np.empty((len(values), order), np.int32)
                        for j in range(order - 1, -1, -1):
                            grams[:, j] = alphabet[values % len(alphabet)]
                            values = values // len(alphabet)
                        held.setdefault(str(lang), []).append((as_text(grams), counts))
                else:
                    windows = np.lib.stride_tricks.sliding_window_view(codes, order)[same]
                    for k, lang in enumerate(names):
                        grams, counts = np.unique(as_text(windows[own == k]), return_counts=True)
                        held.setdefault(str(lang), []).append((grams, counts))
            for lang, parts in held.items():
                if len(parts) > 24:
                    held[lang] = merge(parts)
        for lang, parts in held.items():
            grams, counts = merge(parts)[0]
            for at in range(0, len(grams), 50_000):
                piece = grams[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(piece)), pa.array(piece.tolist(), pa.string()), pa.array(counts[at : at + 50_000])],
                    names=["lang", "gram", "n"])

    return count


def as_text(grams: np.ndarray) -> np.ndarray:
    """Rows of code points as fixed-width numpy texts."""
    return np.ascontiguousarray(grams.astype(np.uint32)).view(f"<U{grams.shape[1]}").ravel() if len(grams) else np.zeros(0, f"<U{grams.shape[1]}")


class Model:
    """Per order: sorted keys over all languages with log2 probabilities (one row of languages per key; where a
    language lacks the n-gram, its backed-off value), and sorted contexts with log2 back-off weights."""

    def __init__(self, langs: list[str], grams: np.ndarray, lang_of: np.ndarray, counts: np.ndarray, order: int, discount: float = DISCOUNT):
        self.langs, self.order = langs, order
        n = len(langs)
        points = np.array([[ord(c) for c in g] for g in grams.tolist()], np.int32).reshape(len(grams), order)
        levels = []  # (points, lang, weight) of each order, top first: counts, then numbers of left neighbours
        weight = counts.astype(float)
        for size in range(order, 0, -1):
            levels.append((points, lang_of, weight))
            if size > 1:
                rows = np.column_stack([lang_of, points[:, 1:]])
                rows, back = np.unique(rows, axis=0, return_inverse=True)
                weight = np.bincount(back.ravel(), minlength=len(rows)).astype(float)
                lang_of, points = rows[:, 0], rows[:, 1:]
        levels.reverse()
        size_of_alphabet = max(1, len(np.unique(levels[0][0])))
        self.floor = np.full(n, 1.0 / (size_of_alphabet + 1))  # unseen letters
        self.keys, self.probs, self.contexts, self.backoff = [], [], [], []
        for size, (points, lang_of, weight) in enumerate(levels, 1):
            def key(rows, size):
                flat = rows.astype(np.int64).ravel()
                doc = np.repeat(np.arange(len(rows)), size)
                return keys(flat, doc, size)[1] if size else np.zeros(len(rows), np.int64)

            own = key(points, size)
            context = key(points[:, :-1], size - 1)
            contexts, at_context = np.unique(context, return_inverse=True)
            total = np.zeros((len(contexts), n))
            kinds = np.zeros((len(contexts), n))
            np.add.at(total, (at_context, lang_of), weight)
            np.add.at(kinds, (at_context, lang_of), 1.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                gamma = np.where(total > 0, discount * kinds / total, 1.0)
            names, first, at = np.unique(own, return_index=True, return_inverse=True)
            share = np.zeros((len(names), n))
            np.add.at(share, (at, lang_of), weight - discount)
            of = at_context[first]
            lower = self.raw(points[first, 1:], size - 1, key)
            with np.errstate(divide="ignore", invalid="ignore"):
                share = np.where(total[of] > 0, share / total[of], 0.0)
            probs = share + gamma[of] * lower
            self.keys.append(names)
            self.probs.append(np.log2(probs).astype(np.float32))
            self.contexts.append(contexts)
            self.backoff.append(np.log2(gamma).astype(np.float32))

    def raw(self, rows: np.ndarray, size: int, key) -> np.ndarray:
        """Probabilities of shorter n-grams, all of which the order below holds."""
        if not size:
            return np.broadcast_to(self.floor, (len(rows), len(self.floor)))
        return 2.0 ** self.probs[size - 1][np.searchsorted(self.keys[size - 1], key(rows, size))]

    def log_probs(self, codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends and log2 probabilities (by language) of the letters that follow another letter of the text."""
        first = np.ones(len(codes), bool)
        first[1:] = doc[1:] != doc[:-1]
        ends = np.flatnonzero(~first)
        out = np.empty((len(ends), len(self.langs)), np.float32)
        # letters whose longest n-gram is found take its value; the others back off an order
        left, weight = np.arange(len(ends)), np.zeros((len(ends), len(self.langs)), np.float32)
        since = np.arange(len(codes)) - np.maximum.accumulate(np.where(first, np.arange(len(codes)), 0))
        for size in range(self.order, 0, -1):
            at_end = ends[left]
            fits = since[at_end] + 1 >= size
            found = np.zeros(len(left), bool)
            own = self.key_at(codes, at_end[fits], size)
            at = np.minimum(np.searchsorted(self.keys[size - 1], own), len(self.keys[size - 1]) - 1)
            hit = self.keys[size - 1][at] == own
            found[np.flatnonzero(fits)[hit]] = True
            out[left[found]] = weight[left[found]] + self.probs[size - 1][at[hit]]
            if size > 1:
                missing = fits & ~found
                context = self.key_at(codes, at_end[missing] - 1, size - 1)
                at = np.minimum(np.searchsorted(self.contexts[size - 1], context), len(self.contexts[size - 1]) - 1)
                known = self.contexts[size - 1][at] == context
                weight[left[np.flatnonzero(missing)[known]]] += self.backoff[size - 1][at[known]]
            left = left[~found]
        if len(left):
            out[left] = weight[left] + self.backoff[0][0] + np.log2(self.floor).astype(np.float32)
        return ends, out

    @staticmethod
    def key_at(codes: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
        total = np.zeros(len(ends), np.uint64)
        for j in range(size):
            total = total * np.uint64(0x110000 + 39) + codes[ends - size + 1 + j].astype(np.uint64)
        return arrays.mix(total + arrays.far(size)).view(np.int64)


def polynomial(points: np.ndarray, kind: int) -> np.ndarray:
    """Keys of n-grams given as rows of code points; contexts have kinds of their own."""
    total = np.zeros(len(points), np.uint64)
    for j in range(points.shape[1]):
        total = total * np.uint64(0x110000 + 39) + points[:, j].astype(np.uint64)
    return arrays.mix(total + arrays.far(kind)).view(np.int64)


def context_kind(size: int) -> int:
    return 64 + size


class Part:
    """Weights of the n-grams and contexts of a hash range: sorted keys, and the languages and weights of each."""

    def __init__(self, own: np.ndarray, langs: np.ndarray, weights: np.ndarray):
        order = np.argsort(own, kind="stable")
        self.keys, first = np.unique(own[order], return_index=True)
        self.first = np.append(first, len(own))
        self.langs, self.weights = langs[order], weights[order]

    def add(self, points: np.ndarray, out: np.ndarray) -> None:
        """Adds to each window (letters from the last one back, 0 before the text) what the part says of it."""
        for size in range(1, points.shape[1] + 1):
            full = np.flatnonzero(points[:, size - 1])
            grams = points[full, :size][:, ::-1]
            self.look_up(polynomial(grams, size), full, out)
            if size > 1:
                self.look_up(polynomial(grams[:, :-1], context_kind(size - 1)), full, out)

    def look_up(self, wanted: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[at] == wanted
        at, rows = at[hit], rows[hit]
        n = self.first[at + 1] - self.first[at]
        source = np.arange(n.sum()) + np.repeat(self.first[at] - np.cumsum(n) + n, n)
        out[np.repeat(rows, n), self.langs[source]] += self.weights[source]


class Parts:
    """A model in parts, each a broadcast, and what every letter weighs by language before any n-gram is known."""

    def __init__(self, langs: list[str], order: int, base: np.ndarray, parts: list):
        self.langs, self.order, self.base, self.parts = langs, order, base, parts

    def windows(self, codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows that end at letters which follow another one of the text, which of them each letter has, and its text."""
        at = np.arange(len(codes))
        first = np.ones(len(codes), bool)
        first[1:] = doc[1:] != doc[:-1]
        since = at - np.maximum.accumulate(np.where(first, at, 0))
        ends = np.flatnonzero(~first)
        points = np.column_stack([np.where(since[ends] >= j, codes[ends - j], 0) for j in range(self.order)]).astype(np.int32)
        _, index, back = np.unique(polynomial(points, 0), return_index=True, return_inverse=True)
        return points[index], back.astype(np.int32), doc[ends].astype(np.int32)

    def totals(self, held: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """Letters and log2 probability by language of the texts of some pieces (windows, of each letter, texts, number of texts)."""
        sums = [np.tile(self.base, (len(points), 1)) for points, _, _, _ in held]
        for shared in self.parts:
            part = shared.value
            for (points, _, _, _), out in zip(held, sums, strict=True):
                part.add(points, out)
            if getattr(shared, "_path", None) is not None:  # read again from its local file for the next texts
                del shared._value
        return [(np.bincount(of, minlength=n), np.column_stack([np.bincount(of, weights=out[back, k], minlength=n) for k in range(len(self.langs))]))
                for (_, back, of, n), out in zip(held, sums, strict=True)]


def hashed(size: int, kind: int, langs: list[str]):
    number = {lang: k for k, lang in enumerate(langs)}

    def run(batches):
        for batch in batches:
            points = np.array(batch.column(1).to_pylist(), f"<U{size}").view(np.uint32).reshape(-1, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(polynomial(points, kind)), pa.array([number[x] for x in batch.column(0).to_pylist()], pa.int32()), batch.column(2)],
                names=["key", "lang", "weight"])

    return run


def split(counts: DataFrame, order: int, max_grams: int, scratch: Scratch) -> Parts:
    """The model of all counted n-grams. A letter's log probability is the sum of `base`, the back-off weights of its known
    contexts, and for each of its known n-grams what that one changes against backing off."""
    spark = counts.sparkSession
    levels = {order: counts.select("lang", "gram", F.col("n").cast("double").alias("w"))}  # top first: counts, then numbers of left neighbours
    for size in range(order - 1, 0, -1):
        levels[size] = scratch.store(levels[size + 1].groupBy("lang", F.substring("gram", 2, size).alias("gram"))
                                     .agg(F.count("*").cast("double").alias("w")))
    floor = 1.0 / (levels[1].select("gram").distinct().count() + 1)
    gamma = (F.lit(DISCOUNT) * F.count("*") / F.sum("w")).alias("gamma")
    # one row per language
    first = {r["lang"]: r["gamma"] for r in levels[1].groupBy("lang").agg(gamma, F.sum("w")).collect()}
    langs = sorted(first)
    base = np.log2(np.array([first[x] for x in langs])) + np.log2(floor)

    def weights(table: DataFrame, size: int, kind: int) -> DataFrame:
        return table.mapInArrow(hashed(size, kind, langs), "key long, lang int, weight double")

    entries, lower, stored = [], None, []
    for size in range(1, order + 1):
        contexts = levels[size].groupBy("lang", F.substring("gram", 1, size - 1).alias("context")).agg(gamma, F.sum("w").alias("total"))
        contexts = scratch.store(contexts)
        own = levels[size].withColumn("context", F.substring("gram", 1, size - 1))
        own = own.join(F.broadcast(contexts) if size == 1 else contexts, ["lang", "context"])
        if lower is None:
            own = own.withColumn("lower", F.lit(floor))
        else:
            own = (own.withColumn("shorter", F.substring("gram", 2, size - 1))
                   .join(lower.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("lower")), ["lang", "shorter"]))
            entries.append(weights(contexts.select("lang", "context", F.log2("gamma")), size - 1, context_kind(size - 1)))
        backed = F.col("gamma") * F.col("lower")
        own = own.withColumn("p", (F.col("w") - DISCOUNT) / F.col("total") + backed)
        lower = scratch.store(own.select("lang", "gram", "p", F.log2(F.col("p") / backed).alias("weight")))
        entries.append(weights(lower.select("lang", "gram", "weight"), size, size))
        stored += [contexts, lower]
    table = entries[0]
    for more in entries[1:]:
        table = table.union(more)
    table = scratch.store(table)
    scratch.drop(*stored, *[levels[size] for size in range(1, order)])
    n = max(1, -(-table.count() // max_grams))
    # hash ranges side by side in files, so that one is read alone
    ranged = scratch.store(table.repartitionByRange(min(n, 2000), "key").sortWithinPartitions("key"))
    parts = []
    for k in range(n):
        low, high = (-(2**63) + 2**64 * j // n for j in (k, k + 1))
        rows = ranged.filter((F.col("key") >= low) & (F.col("key") <= high - 1)).toArrow()
        parts.append(spark.sparkContext.broadcast(Part(
            rows["key"].to_numpy(), rows["lang"].to_numpy(), rows["weight"].to_numpy())))
    scratch.drop(table, ranged)
    return Parts(langs, order, base, parts)


def fit(labelled: DataFrame, text_col: str, lang_col: str, order: int, max_grams: int) -> Model | Parts | None:
    """Model of all labelled texts, or None without any letter."""
    scratch = Scratch(labelled.sparkSession, "langid")
    counts = (labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
              .select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
              .mapInArrow(counter(order), "lang string, gram string, n long"))
    counts = scratch.store(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    n, n_langs = counts.count(), counts.select("lang").distinct().count()
    if not n:
        scratch.drop(counts)
        return None
    if n > max_grams or n * n_langs > CELLS:
        model = split(counts, order, max_grams, scratch)
        scratch.drop(counts)
        return model
    table = counts.toArrow()
    scratch.drop(counts)
    langs, lang_of = np.unique(np.array(table["lang"].to_pylist(), dtype=object).astype(str), return_inverse=True)
    return Model(langs.tolist(), np.array(table["gram"].to_pylist(), dtype=object), lang_of, table["n"].to_numpy(), order)


def dense_totals(model: Model, text: pa.Array):
    for row, to, data, offsets in arrays.pieces(text, 1 << 19):
        codes, doc = letters(data, offsets)
        ends, logs = model.log_probs(codes, doc)
        of = doc[ends]
        yield (np.bincount(of, minlength=to - row),
               np.column_stack([np.bincount(of, weights=logs[:, k], minlength=to - row) for k in range(len(model.langs))]))


def batch_totals(model: Model | Parts, batches):
    """Each batch with the letters and the log2 probabilities by language of its texts (the last column)."""
    if not hasattr(model, "parts"):  # classes travel by value, so isinstance does not know them
        for batch in batches:
            yield batch, list(dense_totals(model, batch.column(batch.num_columns - 1)))
        return
    waiting, held, found = [], [], []  # batches with their number of pieces, pieces to add up, and totals of pieces
    weight = cells = 0
    for batch in batches:
        pieces = 0
        for row, to, data, offsets in arrays.pieces(batch.column(batch.num_columns - 1), 1 << 19):
            piece = (*model.windows(*letters(data, offsets)), to - row)
            held.append(piece)
            pieces, weight, cells = pieces + 1, weight + len(piece[1]), cells + len(piece[0]) * len(model.langs)
            if weight >= CHUNK or cells >= CELLS:
                found += model.totals(held)
                held, weight, cells = [], 0, 0
        waiting.append((batch, pieces))
        while waiting and len(found) >= waiting[0][1]:
            batch, pieces = waiting.pop(0)
            yield batch, found[:pieces]
            found = found[pieces:]
    found += model.totals(held)
    for batch, pieces in waiting:
        yield batch, found[:pieces]
        found = found[pieces:]


def predictor(shared, sharpness: float):
    def predict(batches):
        model = shared if hasattr(shared, "parts") else shared.value
        for batch, totals in batch_totals(model, batches):
            best, scores, bits = [], [], []
            for size, logs in totals:
                entropy = -logs / np.maximum(size, 1)[:, None]
                low = entropy.min(axis=1)
                share = np.exp(-sharpness * (entropy - low[:, None]))
                at = entropy.argmin(axis=1)
                some = size > 0
                best += [model.langs[k] if ok else "und" for k, ok in zip(at, some, strict=True)]
                scores += np.where(some, 1.0 / share.sum(axis=1), 0.0).tolist()
                bits += [b if ok else None for b, ok in zip(low.tolist(), some, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(best, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "bits"])

    return predict


def score(docs: DataFrame, training: Column, keep: list[str], text_col: str = "text", lang_col: str = "lang", order: int = 4,
          max_grams: int = 400_000, sharpness: float = 8.0, rejected_part: float = 0.001) -> DataFrame:
    """The columns `keep` of `docs` with lang_pred, score, bits (per letter) and rejected.
    The model learns from rows where `training` holds."""
    spark = docs.sparkSession
    own = docs.select(*keep)
    own_columns = columns(own, ("lang_pred", "score", "bits", "rejected"))
    train, text, lang, limit = (fresh(own, x) for x in ("_training", "_text", "_lang", "_limit"))
    usable = docs.filter(F.coalesce(training, F.lit(False)))
    # a row per language
    large = [r[0] for r in usable.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).groupBy(F.col(lang_col)).count()
             .filter(F.col("count") >= CALIBRATED).collect()]
    of_large = F.coalesce(F.col(lang_col).isin(large), F.lit(False))
    left_out = of_large & (F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(16)) == 0)
    model = fit(usable.filter(~left_out), text_col, lang_col, order, max_grams)
    if model is None:
        return own.select(*own_columns, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(None).cast("double").alias("bits"), F.lit(False).alias("rejected"))
    learnt = F.coalesce(training & F.col(lang_col).isNotNull() & (left_out | ~of_large), F.lit(False)).alias(train)
    rows = docs.select(*keep, learnt, F.col(text_col).alias(text)).select(*own_columns, train, text)
    scored = Scratch(spark, "langid").store(rows.mapInArrow(
        predictor(model if isinstance(model, Parts) else spark.sparkContext.broadcast(model), sharpness), ddl(rows.drop(text), "lang_pred string", "score double", "bits double")))
    # the highest entropy that texts of the language reach, but for a small part of them
    limits = (scored.filter(F.col(train) & F.col("bits").isNotNull()).groupBy(F.col("lang_pred").alias(lang))
              .agg(F.percentile_approx("bits", 1 - rejected_part, 10_000).alias(limit)))
    return (scored.join(F.broadcast(limits), F.col("lang_pred") == F.col(lang), "left")  # a row per language of the model
            .select(*own_columns, "lang_pred", "score", "bits", F.coalesce(F.col("bits") > F.col(limit), F.lit(False)).alias("rejected")))
