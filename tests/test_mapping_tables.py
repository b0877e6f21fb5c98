"""Rewrites by tables of rules against the same rewrites by a dict."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomshift.operators import mapping, stages

KINDS = ["a.hql", "b.hdl", "c.sh", "d.ksh", "e.config", "f.py", "g.md", "h.xml"]


def rules_table(spark, rules, key, value):
    # repeated and unusable rules do not matter
    rows = [*rules.items(), *list(rules.items())[:2], (None, "x"), ("y", None), ("", "z")]
    return spark.createDataFrame(rows, f"{key} string, {value} string").repartition(3)


def corpus_of(rnd, names, paths, n):
    rows = []
    for k in range(n):
        parts = ["SparkSession"] if rnd.random() < 0.5 else []
        for _ in range(rnd.randrange(1, 14)):
            path = rnd.choice(paths) + rnd.choice(["", "x", "/y", "2", "/", " z", "'s"])
            name = rnd.choice(names) + rnd.choice(["", "", "2", "-x"])
            q = rnd.choice("'\"")
            parts.append(rnd.choice([f"{q}{path}{q}", path, f"k={name}", f"{q}{name}{q}", f"{q}{name}'", "${%s}.t_%d" % (name, k), "USE ${%s};" % name, "'/corp/", "don't",
                                     f"={path}", f"({path})", "\\d+ $1 [a]", "\n"]))
        rows.append((f"dir{k}/{rnd.choice(KINDS)}", rnd.choice([" ", "", "\n"]).join(parts)))
    return rows


@pytest.mark.parametrize("heads", [1000, 3, 0])
def test_tables_agree_with_dicts(spark, monkeypatch, heads):
    monkeypatch.setattr(mapping, "MAX_HEADS", heads)
    rnd = random.Random(heads)
    names = {f"{a}_db{b}": f"zone{k}" for k, (a, b) in enumerate((a, b) for a in ("ops", "lake", "o", "ops_db1") for b in ("", "1", "22"))}
    names |= {"a.b": "dots", "x-y": "dash", "l(": "odd$1"}
    paths = {p: f"gs://t{k}\\{k}$" for k, p in enumerate(["/corp/m", "/corp/m/raw", "/corp/m2", "/corp/", "/data/a+b", "/data/(x", "rel/path", "/corp/m/raw/x/y", "/", "C:\\w"])}
    files = spark.createDataFrame(corpus_of(rnd, list(names), list(paths), 120) + [("n/a.hql", None), ("o/e.config", ""), ("dup/a.hql", "'/corp/m'"), ("dup/a.hql", "'/data/(x/1'")],
                                  "rel_path string, content string")
    found = files.transform(stages.discover)
    want = found.transform(stages.convert, names, paths).collect()
    tables = rules_table(spark, names, "hive_name", "dataset"), rules_table(spark, paths, "prefix", "target")
    got = found.transform(stages.convert, *tables).collect()
    key = lambda r: (r.rel_path, r.converted or "")
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    before = dict(map(tuple, files.collect()))
    assert sum(r.converted != before[r.rel_path] for r in want) > 40
    mixed = found.transform(stages.convert, tables[0], paths).collect()
    assert sorted(map(key, mixed)) == sorted(map(key, want))


def test_many_rules_are_joined_not_compiled(spark):
    rules = spark.range(100_000).select(F.concat(F.lit("/corp/t"), "id").alias("prefix"), F.concat(F.lit("gs://b/"), "id").alias("target"))
    files = spark.createDataFrame([("a.sh", "cp /corp/t99999/x /corp/t100001y\n/corp/t5"), ("b.hql", "'/corp/t77' '/corp/u'")], "rel_path string, content string")
    got = {r.rel_path: r.converted for r in files.transform(stages.discover).transform(stages.convert, {}, rules).collect()}
    # the longest key of /corp/t100001y is /corp/t10000; a bare path needs something behind its prefix, so /corp/t5 stays
    assert got == {"a.sh": "cp gs://b/99999/x gs://b/100001y\n/corp/t5", "b.hql": f"'gs://b/77' '{mapping.BUCKET}/corp/u'"}


def test_trie_pattern():
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("ab/.") for _ in range(rnd.randrange(1, 7))) for _ in range(60)})
    pattern, plain = re.compile(mapping.trie_pattern(words)), re.compile("|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)))
    for _ in range(300):
        t = "".join(rnd.choice("ab/.c") for _ in range(20))
        assert pattern.findall(t) == plain.findall(t)
    assert re.compile(mapping.trie_pattern([])).search("x") is None


def test_rules_without_tables_of_use(spark):
    files = spark.createDataFrame([("a.sh", "cp /corp/x y")], "rel_path string, content string")
    empty = spark.createDataFrame([], "prefix string, target string")
    got = files.transform(stages.discover).transform(stages.convert, {}, empty).first()
    assert got.converted == "cp /corp/x y"


def test_key_shapes(monkeypatch, spark):
    """One pass tells lengths and heads, the longest heads that are few enough, over tasks that see different keys."""
    rnd = random.Random(5)
    keys = [rnd.choice(["/a/b", "/a/ç", "x"]) + str(rnd.randrange(10 ** rnd.randrange(1, 6))) for _ in range(3000)] + [None, "", "/a/b1"]
    rules = spark.createDataFrame([(k,) for k in keys], "key string").repartition(5)
    real = {k for k in keys if k is not None}
    for most in (4000, 200, 40, 3, 2, 1):
        monkeypatch.setattr(mapping, "MAX_HEADS", most)
        lengths, heads = mapping.shape_of(rules, "key")
        fits = [n for n in mapping.HEAD_LENGTHS if len({k[:n] for k in real}) <= most]
        assert lengths == sorted({len(k) for k in real})
        assert (heads is None) if not fits else sorted(heads) == sorted({k[: max(fits)] for k in real})


def test_rules_are_not_grouped_whole(spark, monkeypatch):
    """Only what a table has of the keys that occur is kept; the table itself is neither stored nor grouped."""
    kept = {}

    def watched(df, label):
        out = stored(df, label)
        kept[label] = max(kept.get(label, 0), out.count())
        return out

    stored = mapping.stored
    monkeypatch.setattr(mapping, "stored", watched)
    rules = spark.range(50_000).select(F.concat(F.lit("/corp/t"), "id").alias("prefix"), F.concat(F.lit("gs://b/"), "id").alias("target"))
    files = spark.createDataFrame([("a.sh", "cp /corp/t49999/x"), ("b.hql", "'/corp/t77'")], "rel_path string, content string")
    got = {r.rel_path: r.converted for r in files.transform(stages.discover).transform(stages.convert, {}, rules).collect()}
    assert got == {"a.sh": "cp gs://b/49999/x", "b.hql": "'gs://b/77'"}
    assert max(kept.values()) <= mapping.MAX_HEADS + 100
