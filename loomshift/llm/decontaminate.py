"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and their blanks collapsed. An item of m characters may differ by
k = floor(rate * m) edits from a passage; cut into k + 1 pieces, one piece must occur unchanged. All pieces
form one automaton that runs over every whole document; each hit names a window of the document, which
Myers' bit-parallel distance then measures.

Items are broadcast in blocks of a bounded number of characters; every block meets all documents. Equal items are looked for once.

Items shorter than `exact_below` characters must occur unchanged and as whole words. A short item of a single word
occurs in clean texts too and proves no leak: `unproven` lists those items, which are not looked for. Ideographs, kana and
Hangul syllables are words of their own.

Defined cases: null or blank texts match nothing; of several passages the one of the fewest edits counts, the first of these; rows that repeat give
repeated matches; an empty benchmark gives an empty result; positions are in the normalised text.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_CHARS = 8_000_000  # characters of items in a broadcast block, and one item more
LEAST_WORDS = 2
# scripts written without blanks: kana, ideographs, Hangul syllables
UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def words(text: str) -> int:
    return len(UNSPACED.sub(" x ", text).split())


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether no word of the text reaches over the start or the end of a passage."""
    def inside(at: int) -> bool:
        pair = text[at - 1 : at + 1] if at > 0 else ""
        return len(pair) == 2 and pair[0].isalnum() and pair[1].isalnum() and not UNSPACED.search(pair)

    return not inside(start) and not inside(end)


def cut(m: int, pieces: int) -> list[tuple[int, int]]:
    """Borders of nearly equal pieces."""
    return [(m * i // pieces, m * (i + 1) // pieces) for i in range(pieces)]


class Pattern:
    """Bit masks of an item for Myers' distance."""

    def __init__(self, text: str, edits: int):
        self.text, self.m, self.edits = text, len(text), edits
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str, masks: dict[str, int] | None = None, anchored: bool = False) -> tuple[int, int]:
        """Fewest edits between the item and a passage of the text, and the end of the first such passage.
        Anchored passages begin with the text."""
        masks = self.masks if masks is None else masks
        full, high = (1 << self.m) - 1, 1 << self.m - 1
        plus, minus, score, best, end = full, 0, self.m, self.m, 0
        for at, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            vertical = eq | minus
            horizontal = ((((eq & plus) + plus) ^ plus) | eq) & full
            up, down = (minus | ~(horizontal | plus)) & full, plus & horizontal
            if up & high:
                score += 1
            elif down & high:
                score -= 1
            up = (up << 1 | anchored) & full
            down = down << 1 & full
            plus, minus = (down | ~(vertical | up)) & full, up & vertical
            if score < best:
                best, end = score, at
        return best, end

    def find(self, text: str) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best passage, or None."""
        at = text.find(self.text)
        if at >= 0:
            return 0, at, at + self.m
        edits, end = self.best(text)
        if edits > self.edits:
            return None
        back: dict[str, int] = {}
        for c, mask in self.masks.items():
            back[c] = int(format(mask, f"0{self.m}b")[::-1], 2)
        _, length = self.best(text[:end][::-1], back, True)
        return edits, end - length, end


class Matcher:
    """The automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[str, list]], rate: float, exact_below: int):
        import ahocorasick

        self.items, self.exact_below = [ids for _, ids in items], exact_below
        self.patterns = [Pattern(text, int(rate * len(text)) if len(text) >= exact_below else 0) for text, _ in items]
        wanted: dict[str, list[tuple[int, int]]] = {}
        for k, p in enumerate(self.patterns):
            for a, b in cut(p.m, p.edits + 1):
                wanted.setdefault(p.text[a:b], []).append((k, b))
        self.pieces = ahocorasick.Automaton()
        for piece, of in wanted.items():
            self.pieces.add_word(piece, of)
        self.pieces.make_automaton()

    def hits(self, text: str | None):
        """(item number, edits, start, end) for each item found."""
        text = normal(text)
        begins: dict[int, set[int]] = {}
        for end, of in self.pieces.iter(text):
            for k, b in of:
                begins.setdefault(k, set()).add(end + 1 - b)  # where the item would begin
        for k, places in begins.items():
            pattern = self.patterns[k]
            if pattern.m < self.exact_below:
                at = min((b for b in places if whole_words(text, b, b + pattern.m)), default=None)
                found = at is not None and (0, at, at + pattern.m)
            else:
                found = best_of(pattern, text, sorted(places))
            if found:
                yield (k, *found)


def finder(items: list[tuple[str, list]], rate: float, exact_below: int):
    def run(batches):
        matcher = Matcher(items, rate, exact_below)
        for batch in batches:
            rows = [(row, item, *found) for row, text in enumerate(batch.column(1)) for k, *found in matcher.hits(text.as_py())
                    for item in matcher.items[k]]
            if rows:
                at, item, edits, start, end = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(item, pa.int64()), pa.array(edits, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                    names=["doc_id", "item_id", "edits", "start", "end"])

    return run


def cleaner(items: list[tuple[str, list]], rate: float, exact_below: int, text_col: str):
    def run(batches):
        matcher = Matcher(items, rate, exact_below)
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col))
            yield batch.filter(pa.array([next(matcher.hits(text.as_py()), None) is None for text in texts], pa.bool_()))

    return run


def best_of(pattern: Pattern, text: str, begins: list[int]) -> tuple[int, int, int] | None:
    """The best passage near the places where the item may begin; near places are looked at together."""
    best = None
    low = high = None
    k = pattern.edits

    def look():
        nonlocal best
        a = max(0, low - k)
        found = pattern.find(text[a : high + pattern.m + k])
        if found and (best is None or found[0] < best[0]):
            best = (found[0], found[1] + a, found[2] + a)

    for begin in begins:
        if high is not None and begin - high > k + 1:
            look()
            low = None
        low = begin if low is None else low
        high = begin
    look()
    return best


def unproven(benchmark: DataFrame, exact_below: int = 20, item_text: str = "text") -> DataFrame:
    """Short items of fewer than LEAST_WORDS words, which are not looked for."""
    spaced = F.regexp_replace(F.coalesce(F.col(item_text), F.lit("")), UNSPACED.pattern, " x ")
    few = F.size(F.filter(F.split(spaced, r"(?U)\s+"), lambda w: w != "")) < LEAST_WORDS
    return benchmark.filter(few & (F.length(F.trim(F.coalesce(F.col(item_text), F.lit("")))) < exact_below))


def item_blocks(benchmark: DataFrame, exact_below: int, item_id: str, item_text: str):
    """Normalised items with their ids, one block of bounded size at a time."""
    items = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK_CHARS)
    for block in range(blocks):
        texts: dict[str, list] = {}
        for item, text in items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect():
            if len(key := normal(text)) >= exact_below or words(key) >= LEAST_WORDS:
                texts.setdefault(key, []).append(item)
        if texts:
            yield sorted(texts.items(), key=lambda x: x[0])


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, exact_below: int = 20, id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, edits, start, end for every document and test item it holds within the error budget."""
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id long, edits int, start long, end long"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in item_blocks(benchmark, exact_below, item_id, item_text):
        out = out.unionByName(rows.mapInArrow(finder(items, rate, exact_below), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, exact_below: int = 20, text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no test item, unchanged. Each row is judged by its text alone, so nothing is shuffled."""
    for items in item_blocks(benchmark, exact_below, item_id, item_text):
        docs = docs.mapInArrow(cleaner(items, rate, exact_below, text_col), docs.schema)
    return docs
