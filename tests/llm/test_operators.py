"""Operators against plain Python, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomshift.llm import decontaminate, jaccard, langid, licenses, mixing, pii, quality, substrings, topk, warc
from loomshift.llm.common import Scratch, fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, _key int, _text int, score string, spans int, kept int, _set int"


def table(spark, rows):
    """Documents (doc_id, text, lang, source) with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, lang, s, None, "x", 1, 2, "y", 3, 4, 5) for i, t, lang, s in rows], DOCS)


def sentence(rnd, n, names=400):
    return [f"w{rnd.randrange(names)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, blank and null texts, a long text, null and repeated ids."""
    rnd = random.Random(5)
    base = sentence(rnd, 120)
    passage = sentence(rnd, 30)
    texts = []
    for k in range(40):
        words = sentence(rnd, rnd.randrange(1, 150))
        if k % 3 == 0:
            at = rnd.randrange(len(words) + 1)
            words[at:at] = passage
        texts.append(words)
    for k in range(30):
        words = list(base)
        for _ in range(rnd.randrange(8)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(1000)}"
        texts.append(words)
    texts += [list(base)] * 5 + [sentence(rnd, 8000, 5000)] + [["a", "b"]] * 2 + [["A", "b", "c", "d", "e"], ["a", "B", "c", "d", "e"]]
    blanks = [" ", "  ", "\t", "\n", " \r\n"]
    out = [(k, "".join(w + rnd.choice(blanks) for w in words), ["en", "de", None][k % 3], ["s1", "s2", "s1", None][k % 4]) for k, words in enumerate(texts)]
    out += [(900, None, "en", "s1"), (901, "", "en", None), (902, " \n", None, "s2"), (None, " ".join(base), "en", "s1"), (None, None, None, None),
            (3, out[3][1], "en", "s1"), (4, out[7][1], "en", "s1"), (-5, " ".join(passage), "de", "s3")]
    rnd.shuffle(out)
    return out


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return WORD.findall(text or "")


# --- n-gram Jaccard join ---------------------------------------------------------


def classes_by_hand(rows, percent=80):
    sets = []
    for _, text, *_ in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words_of(text)]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = Counter()
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[root(k)].append(i)
    return [(i, len(sets[k]), (min(least[root(k)]) if least[root(k)] else None) if sets[k] else i, links[k]) for k, (i, *_) in enumerate(rows)], root, sets


def test_jaccard(spark, rows):
    want, _, _ = classes_by_hand(rows)
    got = [tuple(r) for r in jaccard.classes(table(spark, rows)).select("doc_id", "n_shingles", "component_id", "n_links").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert jaccard.classes(empty(spark)).count() == 0


def test_jaccard_blocks(spark, rows, monkeypatch):
    """Clusters larger than a block, and lists drawn together whole, change nothing."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "LONG", 2)
    monkeypatch.setattr(jaccard, "SAMPLED", 1)
    for percent in (80, 50):
        want, _, _ = classes_by_hand(rows, percent)
        got = [tuple(r) for r in jaccard.classes(table(spark, rows), percent=percent).select("doc_id", "n_shingles", "component_id", "n_links").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_unique(spark, rows):
    _, root, sets = classes_by_hand(rows)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k) if sets[k] else ("blank", k)].append(rows[k][0])
    got = jaccard.unique(table(spark, rows))
    assert got.columns == table(spark, rows).columns
    kept = [r.doc_id for r in got.collect()]
    assert len(kept) == len(groups)
    assert Counter(kept) == Counter(min((i for i in g if i is not None), default=None) for g in groups.values())
    assert jaccard.unique(empty(spark)).count() == 0


# --- substring dedup ---------------------------------------------------------------


def kept_by_hand(rows, size):
    first = {}
    for i, text, *_ in rows:
        w = words_of(text)
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k : k + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text, *_ in rows:
        w = words_of(text)
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("size,gram,busy", [(13, 5, 2000), (7, 3, 2000), (13, 5, 3), (16, 5, 1)])
def test_substrings(spark, rows, monkeypatch, size, gram, busy):
    monkeypatch.setattr(substrings, "BUSY", busy)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 300)
    got = [tuple(r) for r in substrings.deduplicate(table(spark, rows), ["doc_id"], size, gram).collect()]
    assert sorted(got, key=str) == sorted(kept_by_hand(rows, size), key=str)


def test_substrings_keep_columns(spark, rows):
    got = substrings.deduplicate(table(spark, rows), table(spark, rows).columns)
    assert set(got.columns) == set(table(spark, rows).columns) | {"n_words", "n_removed"}
    assert got.count() == len(rows)
    assert substrings.deduplicate(empty(spark), ["doc_id"]).count() == 0


def test_fm_index():
    import numpy as np

    rnd = np.random.default_rng(1)
    text = np.concatenate([np.append(rnd.integers(1, 6, n), 0) for n in (40, 3, 80, 1)])
    index = substrings.FMIndex(text)
    starts = np.array([k for k in range(len(text) - 4) if (text[k : k + 4] > 0).all()])
    left, low, high = index.repeated(text, starts, 4)
    for k, start in enumerate(starts.tolist()):
        same = {s for s in range(len(text) - 3) if (text[s : s + 4] == text[start : start + 4]).all()}
        at = np.flatnonzero(left == k)
        assert (len(at) == 1) == (len(same) > 1)
        if len(at):
            assert set(index.suffixes[low[at[0]] : high[at[0]]].tolist()) == same


# --- decontamination ---------------------------------------------------------------


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontaminate(spark, rows):
    rnd = random.Random(3)
    items = [(k, " ".join(sentence(rnd, 20))) for k in range(6)] + [(6, "too short"), (7, None), (8, ""), (None, "an item without any id at all")]
    items.append((9, items[0][1].upper()))
    docs = list(rows)
    for k, (_, text) in enumerate(items[:6]):
        signs = list(text)
        for _ in range(2 * k):
            signs[rnd.randrange(len(signs))] = rnd.choice("abc")
        docs.append((1000 + k, "before " + "".join(signs).replace(" ", " \n") + " after", None, None))
    docs.append((2000, "x An  ITEM without any id at all", "en", None))
    rate = 0.06
    normal = decontaminate.normal
    want = Counter((i, k) for i, text, *_ in docs if len(normal(text)) < 3000 for k, item in items
                   if len(normal(item)) >= 20 and edits(normal(item), normal(text)) <= int(rate * len(normal(item))))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(table(spark, docs), benchmark, rate)
    assert Counter((r.doc_id, r.item_id) for r in got.collect()) == want
    assert {(1000, 0), (1000, 9), (2000, None)} <= set(want)
    clean = decontaminate.clean(table(spark, docs), benchmark, rate)
    bad = {i for i, _ in want}
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, *_ in docs if i not in bad)
    assert decontaminate.clean(table(spark, docs), benchmark.limit(0)).count() == len(docs)
    assert decontaminate.leaks(empty(spark), benchmark).count() == decontaminate.leaks(table(spark, docs), benchmark.limit(0)).count() == 0


def test_short_items_are_found_as_whole_words(spark):
    items = [(1, "Two  words"), (2, "one"), (3, "a-b c"), (4, "北京大学"), (5, None), (6, " "), (7, "京"), (8, "x" * 30), (9, "it's 5%")]
    texts = ["here are two\nwords.", "tattwo words", "two wordsmith", "TWO WORDS", "one", "xa-b c", "(a-b c)", "在北京大学学习", "北京", "京", "y" + "x" * 30, "it's 5%", "it's 5%x", "two-words"]
    found = {1: {0, 3}, 3: {6}, 4: {7}, 8: {10}, 9: {11, 12}}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(docs, benchmark).collect()
    assert Counter((r.item_id, r.doc_id) for r in got) == Counter((k, d) for k, ds in found.items() for d in ds)
    assert all(r.edits == 0 and decontaminate.normal(texts[r.doc_id])[r.start : r.end] == decontaminate.normal(dict(items)[r.item_id]) for r in got)
    left = {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()}
    assert left == set(range(len(texts))) - set().union(*found.values())
    assert {r.item_id for r in decontaminate.unproven(benchmark).collect()} == {2, 5, 6, 7}


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    rnd = random.Random(8)
    items = [(k, " ".join(sentence(rnd, 12))) for k in range(10)]
    docs = spark.createDataFrame([(k, f"a {t} b") for k, t in items], "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got.collect()) == [(k, k, 0) for k in range(10)]


# --- personal data -------------------------------------------------------------------

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_by_hand(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(x) if k % 2 == 0 else int(x) * 2 - 9 * (int(x) > 4) for k, x in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                    "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(out))


TRICKY = ["a@b.c_x@d.e", "a@b@c.d", "a@b.c@d.e.f", ".a@-.-", "x@y", "1.2.3.4.5.6.7.8", "300.1.2.3.4", "0255.0.0.001", "256.1.1.1", "1.2.3",
          "4111 1111 1111 1111 2", "4111-1111-1111-1111", "41111111 11111111", "4111  1111111111111", "+1 (555) 123-4567", "+1+1 555 123 4567",
          "+12", "++441234567890 ", "+1 555 123 4567...9", "é😀 a@b.co 😀 +1 555 1234567", "1" * 5000, "a" * 30000 + "@b.c", "a.b@c..d", "%@%.%",
          "4111 1111 1111 1111\t4111 1111 1111 1111", "x" * 20000 + " " + "1 " * 20000, "12345.1.1.1", "+1.2.3.4.5.6.7.8.9"]


def test_personal_data(spark, rows):
    docs = list(rows) + [(2000 + k, t, None, None) for k, t in enumerate(TRICKY)] + [(None, "q@r.st", None, None)] * 2
    got = pii.detect(table(spark, docs), ["doc_id", "text", "_key", "spans"])
    found = [(r.doc_id, r.text, r.base) for r in got.select("doc_id", "text", pii.listed(F.col("base")).alias("base")).collect()]
    assert Counter(found) == Counter((i, t, base_by_hand(t)) for i, t, *_ in docs)
    assert pii.detect(empty(spark), ["doc_id"]).count() == 0


def test_disclosing_terms(spark):
    """A name that stands near an address, and nowhere else, is found; common words are not."""
    docs = [(k, "the letter of Zephyrine to the office, write to z@mail.example as the office said", None, None) for k in range(4)]
    docs += [(10 + k, "the office of the letter said the office", None, None) for k in range(40)]
    got = pii.detect(table(spark, docs), ["doc_id", "text"])
    terms = {r.text[s.start : s.end] for r in got.collect() for s in r.spans if s.kind == 4}
    assert "Zephyrine" in terms and not terms & {"the", "office", "letter", "said"}
    clean = pii.sanitise(table(spark, docs))
    assert clean.columns == table(spark, docs).columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert "[NAME]" in texts[0] and "[EMAIL]" in texts[0] and "Zephyrine" not in texts[0]
    assert texts[10] == docs[4][1] and len(texts) == len(docs)


def test_disclosing_terms_of_two_letters_and_long_lists(spark, monkeypatch):
    """Short names disclose too; a contact list gives the same terms however its entities are dealt out."""
    import math

    rnd = random.Random(6)
    texts = [f"{' '.join(sentence(rnd, 30))} Ng answers at ng@mail.example today" if k < 8 else f"{' '.join(sentence(rnd, 30))} 李明, u@x.example" if k < 14
             else " ".join(sentence(rnd, 40)) for k in range(60)]
    contacts = " ".join(f"p{k}x a{k}@list.example" for k in range(40))
    texts += [contacts, contacts + " again"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = [re.sub(PATTERNS[0][1], lambda m: " " * len(m.group()), t) for t in texts]
    terms = [{w.lower() for w in re.findall(r"[^\W\d_][^\W_]+", t)} for t in plain]
    mails = [set(m.group() for m in re.finditer(PATTERNS[0][1], t)) for t in texts]
    n = len(texts)
    want = set()
    for mail in set().union(*mails):
        of = [k for k in range(n) if mail in mails[k]]
        for term in set().union(*(terms[k] for k in of)) if len(of) >= 2 else ():
            both, held = sum(term in terms[k] for k in of), sum(term in t for t in terms)
            if both >= 2 and math.log2(n * both / (held * len(of))) / math.log2(n / len(of)) >= 0.8 - 1e-12:
                want |= {(k, term) for k in of if term in terms[k]}
    assert {"ng", "李明"} <= {t for _, t in want}
    for paired in (1000, 7):
        monkeypatch.setattr(pii, "PAIRED", paired)
        got = pii.detect(docs, ["doc_id", "text"]).collect()
        assert {(r.doc_id, r.text[s.start : s.end].lower()) for r in got for s in r.spans if s.kind == 4} == want


def test_disclosing_terms_of_whole_texts(spark):
    """A name far from the address is found, and goes at each place of the documents that hold the address, and only there."""
    far = "the office and the letter " * 40
    docs = [(k, f"Zephyrine asked, {far} write to z@mail.example {far} as Zephyrine, ZEPHYRINE said", None, None) for k in range(4)]
    docs += [(4, docs[0][1], None, None), (4, docs[0][1], None, None), (5, None, None, None), (6, "Zephyrine alone", None, None)]
    docs += [(10 + k, "the office and the letter, as said, write asked to", None, None) for k in range(40)]
    got = pii.detect(table(spark, docs), ["doc_id", "text"]).collect()
    assert len(got) == len(docs)
    for r in got:
        places = [(m.start(), m.end()) for m in re.finditer("(?i)zephyrine", r.text or "")] if r.doc_id < 5 else []
        assert [(s.start, s.end) for s in r.spans if s.kind == 4] == places
    texts = [(r.doc_id, r.text) for r in pii.sanitise(table(spark, docs)).collect()]
    assert all("zephyrine" not in t.lower() and t.count("[NAME]") == 3 for i, t in texts if i < 5)
    assert dict(texts)[6] == "Zephyrine alone"


# --- licenses ---------------------------------------------------------------------------


def test_licenses(spark, rows):
    rnd = random.Random(2)
    docs = list(rows)
    for k, text in enumerate(licenses.TEMPLATES.values()):
        words = text.split()
        docs.append((3000 + k, " ".join([*sentence(rnd, 40), *words, *sentence(rnd, 40)]), None, None))
        if len(words) > 20:
            words[len(words) // 2] = "changed"
            docs.append((3100 + k, " ".join(words).upper(), None, None))
    docs += [(3200, "the license was released under permission of the foundation", None, None), (3200, "Released under the MIT License.", None, None)]
    shingles = {name: set(licenses.shingles(licenses.tokens(t))) for name, t in licenses.TEMPLATES.items()}
    want = set()
    for i, text, *_ in docs:
        own = set(licenses.shingles(licenses.tokens(text or "")))
        want |= {(i, name) for name, s in shingles.items() if len(own & s) >= 0.8 * len(s)}
    got = [(r.doc_id, r.license_id) for r in licenses.scan(table(spark, docs)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 15
    assert licenses.scan(empty(spark)).count() == 0


def test_licenses_across_stretches(spark):
    """Templates over and beside the borders of stretches, whole and altered, in a text full of needed words."""
    rnd = random.Random(9)
    needed = licenses.needed_words(licenses.TEMPLATES, 0.8)
    shingles = {name: set(licenses.shingles(licenses.tokens(t))) for name, t in licenses.TEMPLATES.items()}
    docs, want = [], set()
    for k, (name, template) in enumerate(licenses.TEMPLATES.items()):
        words = [rnd.choice(needed) if rnd.random() < 0.1 else f"w{rnd.randrange(300)}" for _ in range(5 * licenses.STRETCH)]
        at = licenses.STRETCH * (1 + k % 4) - rnd.randrange(len(template.split()) + 1)
        notice = template.split()
        if len(notice) > 30:
            notice[rnd.randrange(len(notice))] = "changed"
        words[at:at] = notice
        docs.append((k, " ".join(words), None, None))
        own = set(licenses.shingles(licenses.tokens(docs[-1][1])))
        want |= {(k, n) for n, s in shingles.items() if len(own & s) >= 0.8 * len(s)}
    got = {(r.doc_id, r.license_id): r.word for r in licenses.scan(table(spark, docs)).collect()}
    assert set(got) == want and {k for k, _ in want} == set(range(len(docs)))
    for k, name in enumerate(licenses.TEMPLATES):
        # the first window that holds enough of it begins within a length of the place
        assert abs(got[k, name] - licenses.STRETCH * (1 + k % 4)) < 4 * len(licenses.TEMPLATES[name].split()) + 10


# --- mixing -----------------------------------------------------------------------------


def test_mix(spark, rows):
    got = mixing.mix(table(spark, rows))
    assert set(got.columns) == set(table(spark, rows).columns) | {"source_size", "target", "repeats", "taken"}
    got = got.collect()
    assert sorted((r.size for r in got)) == sorted(len(words_of(t)) for _, t, *_ in rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words_of(t))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in order:
        own = [r for r in got if r.source == s]
        target = 3 * sizes[s] if s in capped else level * weight[s]
        assert {r.target for r in own} == {target} and {r.source_size for r in own} == {sizes[s]}
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own) / 2
        assert all(r.taken == r.repeats * r.size and 0 <= r.repeats <= 3 for r in own)
    again = mixing.mix(table(spark, rows).repartition(3)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    assert mixing.mix(empty(spark)).count() == 0


def test_windows_deeper_than_the_index_are_refused(spark):
    with pytest.raises(ValueError, match="words, not 17"):
        substrings.deduplicate(empty(spark), ["doc_id"], size=17)


def test_mix_of_null_and_equal_rows(spark):
    """Null ids with different texts, a third of all rows equal, many rows without words: targets are met within half a row."""
    rows = [(None, f"a{k} " * 10, "en", "s1") for k in range(500)] + [(k, f"b{k} " * 10, "en", "s1") for k in range(500)]
    rows += [(7, "same words again " * 4, "en", "s2")] * 900 + [(7, "same words again " * 4, "en", "s2 ")] + [(None, None, "en", "s3")] * 20 + [(5, "", "en", "s2")] * 20
    rows += [(k, "z " * 13, "en", None) for k in range(200)]
    for parts in (1, 7):
        got = mixing.mix(table(spark, rows).repartition(parts)).collect()
        assert len(got) == len(rows) and all(0 <= r.repeats <= 3 for r in got)
        for s in {r.source for r in got}:
            own = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2
            equal = {}
            for r in own:
                equal.setdefault((r.doc_id, r.text), set()).add(r.repeats)
            assert all(max(v) - min(v) <= 1 for v in equal.values())
        figures = Counter((r.doc_id, r.text, r.source, r.repeats) for r in got)
        assert parts == 1 or figures == first
        first = figures


# --- search -------------------------------------------------------------------------------


def test_topk(spark):
    rnd = random.Random(4)
    rows = [(k, [rnd.gauss(0, 0.2) for _ in range(8)]) for k in range(400)]
    rows += [(1000 + k, rows[5][1]) for k in range(30)]
    rows += [(7, None), (8, [None] * 8), (9, [float("nan")] + [0.0] * 7), (10, [float("inf")] * 8), (None, rows[0][1]), (600, []), (601, [0.5, 0.5]), (20, rows[1][1])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    whole = [(i, [int(1024 * x // 1) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and abs(x) < 1e300 for x in v)]
    queries = {}
    for i, v in whole:
        if i % 20 == 0:
            queries[i] = min(queries.get(i, v), v)
    want = []
    for i, q in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in whole if j != i)[:10]
        want += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores, 1)]
    got = topk.top_k(frame, F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_topk_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    frame = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(40)], "vec_id long, embedding array<float>")
    got = topk.top_k(frame, F.col("vec_id") % 4 == 0, k=50)
    assert got.count() == 10 * 39


# --- WARC -----------------------------------------------------------------------------------


def test_warc(spark):
    big, other = "x" * 1000 + "é", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + "\r\n\r\n" * 400
    pages = [(1, "http://www.Example.org:80/a?b#c", big), (2, "http://example.org/a", big), (3, None, big), (4, "no url", other), (5, "x\r\ny", other),
             (6, "http://b.example.org/", "small"), (7, "http://b.example.org/", "small"), (8, "http://a.example.org/", None), (9, "", ""),
             (None, "http://example.org/n", big), (3, "http://example.org/again", big)]
    frame = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, payload string, refers_to int")
    folder = Scratch(spark, "test").root
    run = warc.write_archives(frame, folder)
    back = warc.read_archives(spark, folder, run)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in back.collect())
    keeper = {big: 3, other: 5}
    want = Counter()
    for i, _, html in pages:
        body = (html or "").encode()
        to = keeper.get(html)
        to = to if i is not None and to != i else None
        want[(i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if to else "response", to, None if to else html or "")] += 1
    assert got == want
    index = warc.capture_index(back)
    rows = index.orderBy("position").collect()
    keys = [(r.url_key or "", r.captured, (-1, 0) if r.page_id is None else (0, r.page_id)) for r in rows]
    assert keys == sorted(keys) and [r.position for r in rows] == list(range(len(pages)))
    assert {r.url_key for r in rows} >= {"org,example,www)/a?b", "org,example)/a", "no url", "x%0D%0Ay", None}
    assert {(r.url_key, r.captures) for r in warc.histories(index).collect()} >= {("org,example,b)/", 2)}
    # an empty table
    folder = Scratch(spark, "test").root
    assert warc.capture_index(warc.read_archives(spark, folder, warc.write_archives(frame.limit(0), folder))).count() == 0


def test_loser_tree():
    rnd = random.Random(6)
    for k in range(12):
        runs = [sorted((rnd.randrange(20), n, j) for j in range(rnd.randrange(6))) for n in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_damaged_archive(spark):
    frame = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    folder = Scratch(spark, "test").root
    run = warc.write_archives(frame, folder)
    text = spark.read.text(folder, wholetext=True).first()[0]
    other = Scratch(spark, "test").root
    spark.createDataFrame([(text.replace("abc", "abd"),)], "value string").write.option("lineSep", " ").text(other)
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, other, run).collect()


# --- classifiers ------------------------------------------------------------------------------


def prose(rnd, lang):
    parts = {"en": ["the", "ing", "er", "on", "an", "and"], "de": ["der", "ung", "sch", "ein", "keit", "zu"]}[lang]
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(5, 40)))


def test_language(spark):
    rnd = random.Random(9)
    docs = [(k, prose(rnd, ["en", "de"][k % 2]), ["en", "de"][k % 2], "s") for k in range(300)]
    docs += [(1000, None, "en", "s"), (1001, " 12 \n!", "de", "s"), (1002, "", None, "s"), (None, "ungkeit", "de", "s"), (1003, "東京", None, "s"), (5, docs[5][1], "de", "s"),
             (1004, "der" * 20000, None, "s")]
    got = langid.score(table(spark, docs), fold(F.col("doc_id")) != 2, ["doc_id", "text", "lang", "score", "_text"])
    rows = got.collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.lang and r.bits is not None]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert {r.lang_pred for r in rows if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert all(0 <= r.score <= 1 for r in rows) and {r.score for r in rows if r.lang_pred == "und"} == {0.0}
    assert next(r for r in rows if r.doc_id == 1003).lang_pred in ("de", "en")
    assert langid.score(empty(spark), fold(F.col("doc_id")) != 2, ["doc_id"]).count() == 0
    unlabelled = langid.score(table(spark, [(1, "abc", None, None)]), fold(F.col("doc_id")) != 2, ["doc_id"])
    assert [r.lang_pred for r in unlabelled.collect()] == ["und"]


def test_language_model_is_whole(spark, monkeypatch):
    """However few n-grams a part holds, small languages stay in the model and all results stay the same."""
    rnd = random.Random(10)
    docs = [(k, prose(rnd, "en"), "en", "s") for k in range(200)] + [(1000 + k, prose(rnd, "de"), "de", "s") for k in range(8)]
    docs += [(2000 + k, "東京都 大阪府 北海道 "[k:] + "京都", "ja", "s") for k in range(4)] + [(3000, None, "en", "s"), (3001, "東京 xyz", None, "s")]
    def judged(**more):
        got = langid.score(table(spark, docs).repartition(3), F.lit(True), ["doc_id", "lang"], **more).collect()
        return {r.doc_id: r for r in got}
    whole, split = judged(), judged(max_grams=100)
    assert {r.lang_pred for r in split.values()} == {"en", "de", "ja", "und"}
    monkeypatch.setattr(langid, "CELLS", 50)
    again = judged(max_grams=100)
    assert all(r.lang_pred == (r.lang if r.doc_id < 3000 else {3000: "und", 3001: "ja"}[r.doc_id]) for r in split.values())
    for other in (split, again):
        assert set(other) == set(whole)
        for k, r in other.items():
            assert (r.lang_pred, r.rejected) == (whole[k].lang_pred, whole[k].rejected)
            assert r.score == pytest.approx(whole[k].score, abs=1e-4) and r.bits == pytest.approx(whole[k].bits, abs=1e-4)


def test_marks_stay_on_their_letters():
    import pyarrow as pa

    from loomshift.llm import arrays

    def seen(*texts):
        codes, doc = langid.letters(*arrays.buffers(pa.array(texts)))
        return ["".join(chr(c) for c, d in zip(codes, doc, strict=True) if d == k) for k in range(len(texts))]

    assert seen("हिन्दी भाषा", "E\u0301 1\u0301 a", "\u0301\u0301", "x", "\u0301y", "a\u0301\u0308b") == [
        " हिन्दी भाषा", " e\u0301 a", "", " x", " y", " a\u0301\u0308b"]


def plain_kneser_ney(texts, order, discount):
    """Letters' probabilities by language, from counts in dictionaries."""
    top = defaultdict(Counter)
    for lang, text in texts:
        for k in range(len(text) - order + 1):
            top[lang][text[k : k + order]] += 1
    levels = {order: top}
    for size in range(order - 1, 0, -1):
        levels[size] = defaultdict(Counter)
        for lang, grams in levels[size + 1].items():
            for gram in grams:
                levels[size][lang][gram[1:]] += 1
    letters = {g for grams in levels[1].values() for g in grams}

    def probability(lang, context, letter):
        size = len(context) + 1
        lower = probability(lang, context[1:], letter) if context else 1 / (len(letters) + 1)
        after = {g: n for g, n in levels[size][lang].items() if g[:-1] == context}
        if not after:
            return lower
        total = sum(after.values())
        return max(after.get(context + letter, 0) - discount, 0) / total + discount * len(after) / total * lower

    return probability


def test_language_model_against_counts_in_dictionaries(spark):
    texts = [("de", "der hund und die katze"), ("de", "das haus"), ("en", "the dog and the cat"), ("en", "a house"), ("hi", "हिन्दी भाषा"), (None, "und the भाषा zz")]
    frame = table(spark, [(k, t, lang, None) for k, (lang, t) in enumerate(texts)])
    rows = {r.doc_id: r for r in langid.score(frame, F.lit(True), ["doc_id"], order=3).collect()}
    probability = plain_kneser_ney([(lang, " " + t) for lang, t in texts if lang], 3, langid.DISCOUNT)
    for k, (_, text) in enumerate(texts):
        text = " " + text
        bits = {lang: -sum(math.log2(probability(lang, text[max(0, j - 2) : j], text[j])) for j in range(1, len(text))) / (len(text) - 1)
                for lang in ("de", "en", "hi")}
        best = min(bits, key=lambda x: (bits[x], x))
        assert rows[k].lang_pred == best and rows[k].bits == pytest.approx(bits[best], abs=1e-4), (text, bits)


def test_limits_come_from_texts_left_out(spark, monkeypatch):
    """Texts of a large language that were not counted set its limit; small ones keep all their texts."""
    monkeypatch.setattr(langid, "CALIBRATED", 50)
    rnd = random.Random(12)
    docs = [(k, prose(rnd, "en"), "en", "s") for k in range(600)] + [(2000 + k, prose(rnd, "de"), "de", "s") for k in range(20)]
    docs += [(5000, "zqxj vvkq qqzx jjxq", None, "s")]
    frame = table(spark, docs).withColumn("left_out", (F.pmod(F.xxhash64("text"), F.lit(16)) == 0) & (F.col("lang") == "en"))
    rows = langid.score(frame, F.lit(True), ["doc_id", "lang", "left_out"], rejected_part=0.05).collect()
    spared = sorted(r.bits for r in rows if r.left_out)
    assert 15 < len(spared) < 70
    cut = spared[math.ceil(0.95 * len(spared)) - 1]
    assert all(r.rejected == (r.bits > cut) for r in rows if r.lang_pred == "en")
    assert all(r.lang_pred == r.lang for r in rows if r.lang) and sum(r.rejected for r in rows if r.lang == "de") <= 1


def test_language_model_is_a_distribution(spark):
    """Kneser-Ney probabilities of all letters after a context add up to one, but for the share of unseen letters."""
    import numpy as np

    grams = Counter()
    text = " the theme of the then there is that the "
    for k in range(len(text) - 2):
        grams[text[k : k + 3]] += 1
    names = np.array(list(grams), dtype=object)
    model = langid.Model(["x"], names, np.zeros(len(names), int), np.array(list(grams.values())), 3)
    alphabet = sorted({c for g in grams for c in g[-1:]})
    codes = np.array([ord(c) for a in alphabet for c in " th" + a], np.int32)
    doc = np.repeat(np.arange(len(alphabet)), 4)
    ends, logs = model.log_probs(codes, doc)
    last = np.arange(3, len(codes), 4)
    total = (2.0 ** logs[np.isin(ends, last), 0]).sum()
    assert 0.9 < total <= 1.0 + 1e-6


def test_quality(spark):
    rnd = random.Random(7)
    good = lambda: " ".join(w + "." * (k % 9 == 8) for k, w in enumerate(prose(rnd, "en").split()))
    bad = lambda: " ".join(w.upper() + "!!" for w in prose(rnd, "en").split())
    docs = [(k, good() if k % 2 else bad(), None, None) for k in range(400)] + [(1000, None, None, None), (1001, "", None, None), (None, good(), None, None), (3, good(), None, None)]
    labels = [(k, k % 2) for k in range(400)] + [(None, 1), (5, None), (7, 3), (1000, 1), (9999, 0)]
    frame, marked = table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(frame, marked, fold(F.col("doc_id")) != 2)
    rows = quality.score(frame, model, ["doc_id", "score"]).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.doc_id is not None and r.doc_id < 400]
    assert sum((r.score >= 0.7) == r.doc_id % 2 for r in judged) >= 0.98 * len(judged)
    kept = quality.accepted(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(r.score >= 0.7 for r in rows)
    assert quality.score(empty(spark), model, ["doc_id"]).count() == 0
    assert quality.fit(frame, marked.limit(0), F.lit(True)) is None
    assert {r.score for r in quality.score(frame, None, ["doc_id"]).collect()} == {0.5}


def test_quality_without_labels(spark):
    """Where nothing could be learnt, no document is rejected."""
    frame = table(spark, [(1, "clean text", None, None), (1, "clean text", None, None), (None, None, None, None)])
    labels = spark.createDataFrame([(None, None), (1, None)], "doc_id long, quality int")
    for none in (labels, labels.limit(0)):
        model = quality.fit(frame, none, F.lit(True))
        assert model is None and Counter(quality.accepted(frame, model).collect()) == Counter(frame.collect())


def test_nearest_neighbours_are_exact():
    import numpy as np

    rnd = np.random.default_rng(3)
    weights = rnd.random((60, quality.TERMS)).astype(np.float32)
    model = quality.Model(weights[:50].copy(), rnd.integers(0, 2, 50), 8, 5, 4)
    cosine = quality.unit(weights[50:] @ model.space) @ model.vectors.T
    for k, row in enumerate(cosine):
        near = np.argsort(-row)[:5]
        votes = np.clip(row[near], 0, 1).astype(float) ** 4
        assert abs(model.score(weights[50 + k : 51 + k])[0] - (votes * model.labels[near]).sum() / votes.sum()) < 1e-6
