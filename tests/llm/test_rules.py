"""The rule cascade against plain Python, whatever the order of its rules."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomshift.llm import rules
from tests.llm.test_operators import empty, rows, table, words_of  # noqa: F401

ALL = ("words", "symbols", "lines", "repeats", "letters", "exclaims")


def by_hand(text):
    text = text or ""
    w = words_of(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    again = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again), "n_letters": sum(c.isalpha() for c in text),
            "n_capitals": sum(c.isupper() for c in text), "n_exclaims": text.count("!")}


def failing(m):
    tests = {
        "few_words": m["n_words"] < 50, "repeated_words": 100 * m["n_repeat_words"] > 50 * m["n_words"], "symbols": 10 * m["n_symbols"] > m["n_words"],
        "duplicate_lines": m["n_lines"] >= 4 and 10 * m["n_dup_lines"] > 3 * m["n_lines"],
        "word_length": m["word_chars"] < 2 * m["n_words"] or m["word_chars"] > 15 * m["n_words"],
        "few_letters": 100 * m["n_letters"] < 70 * m["word_chars"], "capitals": 2 * m["n_capitals"] > m["n_letters"], "exclaims": 5 * m["n_exclaims"] > m["n_words"]}
    return {name for name, bad in tests.items() if bad}


@pytest.fixture(scope="module")
def texts(rows):  # noqa: F811
    plain = " ".join(f"alpha{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300))
    odd = [plain, plain.upper(), plain.replace(" ", " # "), plain.replace(" ", "! "), "\n".join([plain] * 3), "\n".join(["one line of a few words here"] * 30),
           "\n".join(f"only line {'abcdefghijklmnop'[k % 10]} {'abcd' * (k % 7 + 1)}" for k in range(60)), "7 " * 200, "x" * 5000, "a b c " * 4, "é😀 " * 60, "1234 5678 " * 40,
           " ".join("supercalifragilistic" + chr(97 + k % 26) * (k % 5) for k in range(80)), plain + "\r\n\x0b\x0c " + plain, "w1 w2 w3 w1 w2 w3", "a a a a", "a a a", "a a"]
    return [*rows, *[(2000 + k, t, "en", "s1") for k, t in enumerate(odd)]]


def test_measures_and_verdicts(spark, texts):
    got = rules.cascade(table(spark, texts), always=ALL)
    want = Counter()
    for i, text, *_ in texts:
        m = by_hand(text)
        want[(i, text, tuple(sorted(m.items())), not failing(m))] += 1
    names = sorted(by_hand(""))
    found = got.collect()
    assert Counter((r.doc_id, r.text, tuple((n, r[n]) for n in names), r.kept) for r in found) == want
    assert all((r.failed_rule is None) == r.kept and (r.kept or r.failed_rule in failing(by_hand(r.text))) for r in found)
    own = [c for c in table(spark, []).columns if c != "kept"]
    assert got.columns[: len(own)] == own
    assert len({n for r in found for n in failing(by_hand(r.text))}) == len(rules.RULES), "each rule rejects something"


def test_any_order_keeps_the_same_and_measures_no_more_than_needed(spark, texts, monkeypatch):
    docs = table(spark, texts)
    want = Counter((i, t) for i, t, *_ in texts if not failing(by_hand(t)))
    for order in (lambda *a: list(rules.RULES), lambda *a: list(reversed(rules.RULES))):
        monkeypatch.setattr(rules, "order_rules", order)
        judged = rules.cascade(docs)
        assert Counter((r.doc_id, r.text) for r in judged.filter("kept").collect()) == want
        assert Counter((r.doc_id, r.text) for r in rules.accepted(docs).collect()) == want
    # dear measures are taken only for rows that earlier rules let pass
    before = rules.measured(docs.select(F.coalesce("text", F.lit("")).alias(rules.TEXT)), ["words", "repeats"], F.length(rules.TEXT) < 0)
    assert before.agg(F.count("n_repeat_words"), F.count("n_words")).first() == (0, 0)


def test_order_is_rejection_per_cost():
    a, b, c = (rules.Rule(n, (m,), "true") for n, m in (("a", "words"), ("b", "letters"), ("c", "repeats")))
    costs = {"words": 1.0, "letters": 10.0, "repeats": 1.0}
    seen = [(frozenset("a"), 10), (frozenset("b"), 50), (frozenset("bc"), 40), (frozenset(), 900)]
    # c: 40 rows for repeats and the words it needs; a then has words for nothing; b has 50 left for ten seconds
    assert [r.name for r in rules.order_rules(seen, costs, (a, b, c), [])] == ["c", "a", "b"]
    # with all measures taken only the rows count
    assert [r.name for r in rules.order_rules(seen, costs, (a, b, c), list(costs))] == ["b", "a", "c"]


def test_odd_tables(spark):
    assert rules.cascade(empty(spark)).count() == 0 and rules.accepted(empty(spark)).columns == empty(spark).columns
    clash = spark.createDataFrame([(1, "x " * 60, 7, "k")], "doc_id int, text string, n_words int, Kept string")
    got = rules.cascade(clash, always=("words",)).first()
    assert (got.doc_id, got.n_words, got.kept) == (1, 60, False) and "kept" in rules.cascade(clash).columns
    whole = clash.withColumn("text", F.lit(" ".join(f"alpha{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))))
    assert [tuple(r) for r in rules.accepted(whole).collect()] == [tuple(r) for r in whole.collect()]


def test_very_long_text(spark):
    """200,000 words, half of them repeated passages; time grows with the text, not its square."""
    import time

    took = []
    for n in (25_000, 200_000):
        text = " ".join([f"w{k}" for k in range(n // 2)] + ["again and again"] * (n // 6))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        got = rules.cascade(docs, always=("words", "repeats")).first()
        took.append(time.time() - began)
        assert (got.n_words, got.n_repeat_words) == (len(text.split()), 3 * (n // 6))
    assert took[1] < 24 * took[0]
