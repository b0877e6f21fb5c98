"""The registered queries: their contracts, their SQL, and the pipeline against plain Python."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomshift.llm import decontaminate, pii, quality, queries
from loomshift.llm.registry import ORACLES, QUERIES
from tests.llm.test_operators import classes_by_hand
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    with connect(SF_DIR) as c:
        yield c


def test_every_operator_is_registered():
    assert queries and {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, con, name):
    problem, rows = compare(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR)
    assert problem is None and rows, problem


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_quality_and_language_contracts(spark, documents):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    scored = QUERIES["op1_quality"](spark, SF_DIR).collect()
    assert {r.doc_id for r in scored} == set(documents) and all(r.held_out == held_out(r.doc_id) for r in scored)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored)
    unseen = [r for r in scored if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in unseen) >= 0.85 * len(unseen)
    named = QUERIES["op2_langid"](spark, SF_DIR).collect()
    assert {r.doc_id for r in named} == set(documents) and all(r.held_out == held_out(r.doc_id) for r in named)
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in named) >= 0.95 * len(named)


def test_jaccard_contract(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.values()]
    want, _, _ = classes_by_hand(rows)
    got = QUERIES["op3_jaccard"](spark, SF_DIR).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_leaks_are_found(spark, documents):
    items = {r.item_id: decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    want = {(i, k) for i, r in documents.items() for k, t in items.items() if t in decontaminate.normal(r.text)}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_decontaminate"](spark, SF_DIR).collect()}
    assert want and want <= got


def test_pipeline_stages(spark, documents):
    """Each stage against what its operator, or plain Python, says about its own input."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    state = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, state, SF_DIR)
        before, kept = state.collect(), after.collect()
        if name == "quality classifier":
            model = quality.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
            scores = {r.doc_id: r.score for r in quality.score(state, model, ["doc_id"]).collect()}
            want = {i for i, s in scores.items() if s >= 0.7}
        elif name == "n-gram Jaccard join":
            rows = [(r.doc_id, r.text) for r in before]
            want = {component for _, n, component, _ in classes_by_hand(rows)[0] if n} | {i for i, n, _, _ in classes_by_hand(rows)[0] if not n}
        elif name == "benchmark decontamination":
            leaked = {r.doc_id for r in decontaminate.leaks(state, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).collect()}
            want = {r.doc_id for r in before} - leaked
        else:
            want = {r.doc_id for r in before}
        assert {r.doc_id for r in kept} == want and len(kept) == len(want), name
        if name == "mixing sources":
            assert all(r.taken == r.size * r.repeats for r in kept)
        else:
            assert after.columns == columns
        if name == "PII":
            texts = {r.doc_id: r.text for r in before}
            for r in pii.detect(state, ["doc_id"]).collect():
                text = next(k.text for k in kept if k.doc_id == r.doc_id)
                assert (text == texts[r.doc_id]) == (not r.spans)
                assert all(s.value not in text for s in r.base)
            assert all(r.n_chars == len(r.text) for r in kept)
        elif name != "mixing sources":
            assert Counter(map(tuple, kept)) == Counter(tuple(r) for r in before if r.doc_id in want)
        state = spark.createDataFrame(kept, after.schema)


def test_pipeline_gives_the_mix(spark, monkeypatch):
    """A document is in the result as often as the mix takes it, and not at all where it takes none."""
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-1:])
    mixed = corpus_pipeline.source_mix(spark, spark.read.parquet(f"{SF_DIR}/documents.parquet"), SF_DIR)
    repeats = {r.doc_id: r.repeats for r in mixed.select("doc_id", "repeats").collect()}
    assert {0, 1} < set(repeats.values())
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.columns == [*mixed.columns, "copy"]
    copies = got.select("doc_id", F.col("copy").alias("number")).collect()
    assert Counter((r.doc_id, r.number) for r in copies) == Counter((i, k) for i, n in repeats.items() for k in range(1, n + 1))


def test_pipeline_handles_odd_tables(spark, tmp_path):
    """Nulls everywhere, repeated rows, blank texts and an empty table pass all stages."""
    import shutil

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    rows = [(None, None, None, None, None, None), (1, "", "en", "a", 0, 0.5), (2, "one two three", None, None, 3, None), (2, "one two three", None, None, 3, None),
            (None, "write to a@b.example now please", "en", "a", 1, 1.0), (3, "x " * 5000, "en", "a", 1, 1.0)]
    for name, data in (("odd", rows), ("empty", [])):
        folder = tmp_path / name
        folder.mkdir()
        spark.createDataFrame(data, schema).write.parquet(str(folder / "documents.parquet"))
        for table in ("labels", "benchmark"):
            shutil.copy(f"{SF_DIR}/{table}.parquet", folder / f"{table}.parquet")
        got = corpus_pipeline.run(spark, str(folder))
        # a row per copy, at most three of each document
        before = Counter(r[0] for r in data)
        copies = Counter(r.doc_id for r in got.select("doc_id").collect())
        assert set(copies) <= set(before) and all(n <= 3 * before[k] for k, n in copies.items())


@pytest.mark.parametrize("task_edges", [200_000, 3])
def test_components_of_a_chain(spark, monkeypatch, task_edges):
    from loomshift.llm import components
    from loomshift.llm.common import Scratch

    monkeypatch.setattr(components, "TASK_EDGES", task_edges)
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (7, 7)]
    got = components.components(spark.createDataFrame(edges, "u long, v long").repartition(12), Scratch(spark, "test"))
    assert {(r.node, r.root) for r in got.collect()} == {(k, 0) for k in range(31)} | {(100, 100), (101, 100)}
    assert components.components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "test")).count() == 0
