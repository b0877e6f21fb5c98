"""Rules with NULLs, missing matches and other corners, on literal frames."""

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomshift import fixed
from loomshift.functions import hive, text
from loomshift.operators import agentlog, corpus, extract, mapping, runstate, tables, testlog
from loomshift.plans.hive import FILTER_FILE
from loomshift.plans.inputs import DATASET_MAP, PATH_MAP
from loomshift.session import scratch
from loomshift.sources import readers, sinks


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).first()["x"]


def files(spark, *pairs):
    return readers.literal_rows(spark, pairs, "rel_path string, content string")


# --- Hive functions -------------------------------------------------------------


def test_lenient_and_strict(spark):
    none = F.lit(None).cast("string")
    assert one(spark, hive.concat_ws("-", F.lit("a"), none, F.lit("b"))) == "a-b"
    assert one(spark, hive.concat_ws("-", F.lit("a"), none, F.lit("b"), strict=True)) is None
    assert one(spark, hive.concat_ws("-", F.lit("a"), F.lit("b"), strict=True)) == "a-b"
    assert one(spark, hive.regexp_extract(F.lit("abc"), r"(\d+)")) == ""
    assert one(spark, hive.regexp_extract(F.lit("abc"), r"(\d+)", strict=True)) is None
    assert one(spark, hive.split_at(F.lit("a,b"), ",", 5)) is None
    assert one(spark, hive.size(F.lit(None).cast("array<int>"))) is None
    assert one(spark, hive.size(F.lit(None).cast("array<int>"), strict=False)) == -1
    assert one(spark, hive.json_value(F.lit('{"a":{"b":1}}'), "$.a")) == '{"b":1}'
    assert one(spark, hive.json_value(F.lit('{"a":{"b":1}}'), "$.a", strict=True)) is None
    assert one(spark, hive.to_date(F.lit("no date"))) is None
    assert one(spark, hive.to_bigint(F.lit("12x"))) is None
    with pytest.raises(PySparkException):
        one(spark, hive.to_bigint(F.lit("12x"), strict=True))
    with pytest.raises(PySparkException):
        one(spark, hive.to_date(F.lit("no date"), strict=True))


def test_times(spark):
    late, early = F.lit(dt.datetime(2024, 1, 2, 0, 1)), F.lit(dt.datetime(2024, 1, 1, 23, 59))
    assert one(spark, hive.datediff(late, early)) == 1
    assert one(spark, hive.from_unixtime(F.lit(0), strict=False)) == "1970-01-01 00:00:00"
    assert one(spark, hive.default_run_date(F.lit(dt.date(2024, 3, 1)))) == "2024-02-29"
    assert one(spark, hive.nvl2(F.lit(None).cast("int"), F.lit("b"), F.lit("c"))) == "c"


def test_type_names():
    assert hive.target_type_name("decimal(29,2)") == "NUMERIC"
    assert hive.target_type_name("DECIMAL(30,2)") == "BIGNUMERIC"
    assert hive.target_type_name("array<int>") == "ARRAY<INT64>"
    assert hive.target_type_name("map<string,int>") == "JSON"
    assert hive.target_type_name("tinyint") == "INT64"
    assert hive.target_type_name("binary") == "BYTES"


def test_ingest_filter(spark):
    schema = "shipment_id string, record_type string, shipment_status_code string, declared_value decimal(18,2), carrier_id string"
    rows = [
        ("kept", "STANDARD", "BOOKED", Decimal("10.00"), "c"),
        ("null type kept", None, "DELIVERED", Decimal("50.00"), "c"),
        ("test", "TEST", "BOOKED", Decimal("50.00"), "c"),
        ("internal", "INTERNAL", "BOOKED", Decimal("50.00"), "c"),
        ("low", "STANDARD", "BOOKED", Decimal("9.99"), "c"),
        ("no value", "STANDARD", "BOOKED", None, "c"),
        ("lost", "STANDARD", "LOST", Decimal("50.00"), "c"),
        ("no status", "STANDARD", None, Decimal("50.00"), "c"),
        ("empty carrier", "STANDARD", "BOOKED", Decimal("50.00"), ""),
        ("no carrier", "STANDARD", "BOOKED", Decimal("50.00"), None),
    ]
    kept = tables.ingest_filter(readers.literal_rows(spark, rows, schema))
    assert sorted(r.shipment_id for r in kept.collect()) == ["kept", "null type kept"]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id AS o_totalprice", "'F' AS o_orderstatus").write.parquet(str(tmp_path / "t"))
    df = extract.inject_filters(spark.read.parquet(str(tmp_path / "t")), [("a", "o_orderstatus <> 'F'"), ("b", "o_totalprice > 3")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Not(EqualTo(o_orderstatus,F)), GreaterThan(o_" in plan
    found = extract.filter_rows(files(spark, ("f.config", FILTER_FILE))).orderBy("position").collect()
    assert [r.name for r in found] == ["filter_status", "filter_price", "filter_from"]
    assert found[1].predicate == "coalesce(o_totalprice, 0)\n  >= 100000"


def test_coercion(spark):
    df = spark.sql("SELECT 'x' AS a, 5 AS load_ts, 7 AS b")
    out = sinks.coerce_by_name(df, {"a": T.LongType()})
    assert out.first() == (None, "5", 7)
    assert out.schema["load_ts"].dataType == T.StringType()
    audit = sinks.cast_audit(df, {"a": T.LongType(), "b": T.StringType()}).collect()
    assert [(r.column_name, r.non_null, r.lost) for r in audit] == [("a", 1, 1), ("b", 1, 0)]


# --- texts --------------------------------------------------------------------------


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\r\x0b\x0c\x1c\x85 é", max_size=12), min_size=1, max_size=20))
def test_lines_match_splitlines(spark, texts):
    df = readers.literal_rows(spark, [(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: r.x for r in df.select("i", text.lines("t").alias("x")).collect()}
    assert got == {i: t.splitlines() for i, t in enumerate(texts)}


def test_cuts(spark):
    assert one(spark, text.truncate(F.lit("abcdef"), 4)) == "abcd\n... [truncated 2 chars]"
    assert one(spark, text.truncate(F.lit("abcd"), 4)) == "abcd"
    assert one(spark, text.label(F.lit("a\nb" * 30))) == ("a b" * 30)[:57] + "..."
    assert one(spark, text.first_line(F.lit("one\ntwo"), 2)) == "on"
    arguments = F.create_map(F.lit("path"), F.lit("a\nb"), F.lit("text"), F.lit("x" * 61))
    assert one(spark, text.call_label(F.lit("edit"), arguments)) == "edit(path=a b, text=" + "x" * 57 + "...)"
    assert one(spark, text.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2


@pytest.mark.parametrize(
    "given_text, want",
    [("```sql\nSELECT 1\n```", "SELECT 1"), ("  ```\na\nb\n``` \n", "a\nb"), ("x ```\na\n```", "x ```\na\n```"),
     ("```ruby\na\n```", "```ruby\na\n```"), ("plain", "plain")],
)
def test_fences(spark, given_text, want):
    assert one(spark, text.strip_fence(F.lit(given_text))) == want


def test_globs():
    import re

    def hit(pattern, path):
        return re.match(text.glob_pattern(pattern), path) is not None

    assert hit("**/*.sql", "a.sql") and hit("**/*.sql", "x/y/a.sql")
    assert hit("*.sql", "a.sql") and not hit("*.sql", "x/a.sql")
    assert hit("a?.b+c", "ax.b+c") and not hit("a?.b+c", "ax.bbc")
    assert hit("[ab]*.py", "b1.py") and not hit("[ab]*.py", "c1.py")
    assert hit("[!ab]?", "cd") and not hit("[!ab]?", "ad") and not hit("x[!a]y", "x/y")


@pytest.mark.parametrize("pattern", ["foo", "^foo", "foo$", r"\Afoo", r"foo(?!\s*bar)", r"a\s*+$", "[^x]oo", r"o\b", "o+$"])
def test_search_is_by_line(spark, pattern):
    import re

    content = "foo\nbar\x0cfoo x\n a \n\nxoo\nfood\rfoo"
    hits = corpus.search_lines(files(spark, ("a/b.txt", content)), pattern).collect()
    want = [(n, ln.strip()) for n, ln in enumerate(content.splitlines(), 1) if re.search(pattern, ln)]
    assert sorted((r.line_no, r.hit) for r in hits) == want


# --- corpus ----------------------------------------------------------------------------


def test_classification(spark):
    cases = {
        "a/x.HQL": "hql", "x.hdl": "hdl", "x.sh": "shell", "x.KSH": "shell", "x.xml": "skip", "Scheduler/x.xml": "dag_xml",
        "tests/a.py": "test", "x.md": "skip", "noext": "skip",
    }
    by_content = {
        "f.config": ("set hivevar:a=b;", "filters"), "p.config": ("a=b", "config"), "j.py": ("import PySpark", "pyspark"),
        "s.py": ("SparkSession", "pyspark"), "u.py": ("x = 1", "skip"),
    }
    rows = [(p, "") for p in cases] + [(p, c) for p, (c, _) in by_content.items()] + [(".git/x.hql", ""), ("a/.b/x.hql", "")]
    got = {r.rel_path: r.file_type for r in corpus.classify(files(spark, *rows)).collect()}
    assert got == cases | {p: t for p, (_, t) in by_content.items()}


def test_output_paths_and_back(spark):
    rows = files(spark, ("a/x.hql", ""), ("a/y.hdl", ""), ("b/z.ksh", ""), ("workflows/d.v2.xml", ""), ("dag.d/.x/a.hql", ""))
    planned = corpus.with_output_path(corpus.classify(rows))
    got = {r.rel_path: r.output_path for r in planned.collect()}
    assert got == {"a/x.hql": "a/x.sql", "a/y.hdl": "a/y.sql", "b/z.ksh": "b/z.sh", "workflows/d.v2.xml": "dags/d.py"}
    sources = {r.output_path: r.source for r in runstate.source_lookup(planned, rows).collect()}
    assert sources == {"a/x.sql": "a/x.hql", "a/y.sql": "a/y.hdl", "b/z.sh": "b/z.ksh", "dags/d.py": None}


def test_ddl(spark):
    def ddl(sql):
        return corpus.looks_like_ddl("c"), sql

    for sql, want in [
        ("  create table x", True), ("-- Converted from: a\n-- b\nDROP TABLE x", True), ("CREATE OR REPLACE SCHEMA s", True),
        ("SELECT 1 -- CREATE TABLE", False), ("CREATE VIEW v", False), ("", False),
    ]:
        assert one(spark, ddl(sql)[0], c=sql) is want, sql


def test_bulk_edits(spark):
    f = files(spark, ("a", "x y x"), ("b", "x y x"), ("c", "q"), ("d", "one"), ("untouched", "x"))
    edits = readers.literal_rows(
        spark, [("a", "x", "z", False), ("b", "x", "z", True), ("c", "x", "z", True), ("d", "one", "two", False)],
        "rel_path string, old string, new string, replace_all boolean",
    ).withColumn("edit_no", F.lit(1))
    got = {r.rel_path: (r.content, r.replaced, r.status) for r in corpus.bulk_replace(f, edits).collect()}
    assert got == {
        "a": ("x y x", 0, "not unique"), "b": ("z y z", 2, "edited"), "c": ("q", 0, "not found"), "d": ("two", 1, "edited"),
    }


# --- mappings ----------------------------------------------------------------------------


def test_paths(spark):
    def mapped(p, **kw):
        return one(spark, mapping.map_path("p", PATH_MAP, **kw), p=p)

    assert mapped("/corp/metrics/raw/x") == "gs://raw-bucket/raw/x"
    assert mapped("/corp/metrics2/x") == "gs://my-bucket/metrics2/x"
    assert mapped("/corp/metrics2/x", boundary=True) == "gs://my-bucket/corp/metrics2/x"
    assert mapped("/else") == "gs://my-bucket/else"
    quoted = mapping.rewrite_quoted_paths("p", PATH_MAP)
    assert one(spark, quoted, p="a '/corp/landing/x' \"/corp/landing/x\" '/corp/q' /corp/landing '/corp/' '/corp/landing'") == (
        "a 'gs://landing-bucket/x' \"/corp/landing/x\" 'gs://my-bucket/corp/q' /corp/landing '/corp/' 'gs://landing-bucket'"
    )


def test_references_and_names(spark):
    sql = "FROM ${ops_db}.a JOIN ${unknown}.b JOIN ${refs_db}.c"
    assert one(spark, mapping.qualify_refs("p", DATASET_MAP), p=sql) == (
        "FROM `my-project.raw_zone.a` JOIN ${unknown}.b JOIN `my-project.dims.c`"
    )
    assert one(spark, mapping.qualify_notes("p", DATASET_MAP), p=sql) == [
        "${ops_db}.a → `my-project.raw_zone.a`", "${refs_db}.c → `my-project.dims.c`",
    ]
    assert one(spark, mapping.rename_assigned("p", DATASET_MAP), p="a=ops_db\nb=ops_db_old") == "a=raw_zone\nb=ops_db_old"
    assert one(spark, mapping.rename_quoted("p", DATASET_MAP), p="'ops_db' \"refs_db\" 'ops_db\"") == "'raw_zone' \"dims\" 'ops_db\""
    assert one(spark, mapping.residual_variables("p"), p="${a} @b") == "@a @b"


def test_rewrites_by_table_agree_with_inline(spark):
    f = files(
        spark, ("a", "FROM ${ops_db}.a JOIN ${unknown}.b '/corp/landing/x' '/corp/q' '/corp/' '/other' \"/corp/q\" k=ops_db j=ops_db_old"),
        ("b", "nothing"), ("c", "${ops_db}.a ${ops_db}.a ${refs_db}.c '/corp/metrics/raw' '/corp/metrics2/y' n=refs_db"),
    )
    datasets = readers.literal_rows(spark, list(DATASET_MAP.items()), "hive_name string, dataset string")
    prefixes = readers.literal_rows(spark, list(PATH_MAP.items()), "prefix string, target string")
    for by_table, inline in [
        (mapping.qualify_refs_by_table(f, datasets), mapping.qualify_refs("content", DATASET_MAP)),
        (mapping.rewrite_quoted_paths_by_table(f, prefixes), mapping.rewrite_quoted_paths("content", PATH_MAP)),
        (mapping.rename_dbs_by_table(f, datasets, r"=\w+\b"), mapping.rename_assigned("content", DATASET_MAP)),
    ]:
        want = f.select("rel_path", inline.alias("content"))
        assert sorted(map(tuple, by_table.select("rel_path", "content").collect())) == sorted(map(tuple, want.collect()))


def test_many_rules(spark):
    rules = {f"/p{k:04d}": f"t{k}" for k in range(2000)}
    assert one(spark, mapping.map_path("p", rules), p="/p1234/x") == "t1234/x"
    names = {f"db{k}": f"ds{k}" for k in range(2000)}
    assert one(spark, mapping.qualify_refs("p", names), p="${db1999}.t ${none}.t") == "`my-project.ds1999.t` ${none}.t"
    assert one(spark, mapping.rename_quoted("p", names), p="'db7' 'db70'") == "'ds7' 'ds70'"
    assert one(spark, mapping.rewrite_bare_paths("p", rules), p="cp /p0007/a b") == "cp t7/a b"


def test_a_path_may_occur_twice(spark):
    f = spark.createDataFrame([("a", "${x}.t ${x}.u"), ("a", "${x}.t")], "rel_path string, content string")
    datasets = spark.createDataFrame([("x", "y")], "hive_name string, dataset string")
    got = sorted(r.content for r in mapping.qualify_refs_by_table(f, datasets, "p").collect())
    assert got == ["`p.y.t`", "`p.y.t` `p.y.u`"]


def test_prefix_join_agrees_with_inline(spark):
    rows = [(i, p) for i, p in enumerate(["/corp/metrics/raw/x", "/corp/metrics", "/corp/land", "", "/c", "/corp/landing9"])]
    df = readers.literal_rows(spark, rows, "id long, p string")
    prefixes = readers.literal_rows(spark, list(PATH_MAP.items()), "prefix string, target string")
    joined = mapping.longest_prefix_join(df, "id", "p", prefixes).select("id", "mapped")
    inline = df.select("id", mapping.map_path("p", PATH_MAP).alias("mapped"))
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, inline.collect()))


# --- extraction ------------------------------------------------------------------------------


def test_parameters_and_hints(spark):
    f = files(spark, ("q.sql", "@b @a @@sys x@c @a"))
    got = [(r.name, r.type) for r in extract.parameters(f, {"a": "DATE"}).collect()]
    assert got == [("a", "DATE"), ("b", "STRING"), ("c", "STRING")]
    shape = "Query parameter '@a' has type DATE which cannot be coerced to expected type {} at [1:2]"
    for expected, want in [("STRING", [("a", "STRING")]), ("DATE", []), ("MONEY", [])]:
        errors = readers.literal_rows(spark, [("q.sql", shape.format(expected))], "rel_path string, error string")
        hints = extract.type_hints(errors, extract.parameters(f, {"a": "DATE"}))
        assert [(r.name, r.expected) for r in hints.collect()] == want


def test_events(spark):
    good = "<Event><EventId>A_B</EventId><Dependency>X</Dependency><Dependency>Y</Dependency></Event>"
    nested = "<Event><Dependencies><Dependency>X</Dependency></Dependencies><RetryCount>3</RetryCount></Event>"
    f = files(spark, ("d/a.xml", good), ("d/b.xml", nested), ("d/c.xml", "<Event><EventId>Z</EventId"))
    got = {r.rel_path: r for r in extract.events(f).collect()}
    assert got["d/a.xml"].dag_id == "a_b" and got["d/a.xml"].dependencies == ["X", "Y"]
    assert got["d/b.xml"].event_id == "b" and got["d/b.xml"].retry_count == 3
    assert got["d/c.xml"].note == "XML parse warning" and got["d/c.xml"].event_id == "c"


def test_errors(spark):
    clean = extract.clean_error("e")
    assert one(spark, clean, e="400 POST https://x: Bad: rest: more") == "rest: more"
    assert one(spark, clean, e="500 POST: Bad: rest") == "500 POST: Bad: rest"
    assert one(spark, clean, e="400 short: text") == "400 short: text"


def test_python_syntax(spark):
    f = files(spark, ("a.py", "x = 1"), ("b.py", "def f(:\n"), ("c.py", "x = '\0'"), ("d.sql", "("))
    got = {r.rel_path: r.error for r in extract.python_syntax(f).collect()}
    assert got["a.py"] is None and "line 1" in got["b.py"] and got["c.py"] and "d.sql" not in got


# --- logs, run state ----------------------------------------------------------------------------


def log(spark, *texts):
    rows = [(f"r{i}", n, line) for i, t in enumerate(texts) for n, line in enumerate(t.splitlines())]
    return readers.literal_rows(spark, rows, "run_id string, line_no long, line string")


def test_log_shapes(spark):
    shapes = log(
        spark,
        "FAILED tests/foo.py::TestBar::test_baz - AssertionError: a - b\nFAILED tests/foo.py::other - second\n1 failed, 4 passed in 0.12s",
        "___ ERROR collecting tests/foo.py ___\ntests/foo.py:5: in <module>\nE   ModuleNotFoundError: x\nE   more\n=== info ===\nE   outside\nERROR tests/foo.py",
        "___ ERROR collecting tests/lone.py ___\nfirst\n\nsecond\n",
        "ERROR tests/bare.py",
        "0 failed, 3 passed",
        "all good\n5 passed",
        "___ ERROR collecting tests/a.py ___\n=== x",
    )
    got = {(r.run_id, r.file): r.excerpt for r in testlog.failures(shapes).collect()}
    assert got == {
        ("r0", "tests/foo.py"): "AssertionError: a - b",
        ("r1", "tests/foo.py"): "E   ModuleNotFoundError: x\nE   more",
        ("r2", "tests/lone.py"): "first\nsecond",
        ("r3", "tests/bare.py"): fixed.NO_MESSAGE,
        ("r4", "(unknown)"): "0 failed, 3 passed",
        ("r6", "tests/a.py"): fixed.NO_BODY,
    }
    shown = {(r.run_id, r.file, r.first_line) for r in testlog.report(shapes).collect()}
    assert ("r5", None, None) in shown and ("r1", "tests/foo.py", "E   ModuleNotFoundError: x") in shown and len(shown) == 7
    counts = {r.run_id: (r.passed, r.failed, r.errors) for r in testlog.counts(shapes).collect()}
    assert counts["r0"] == (4, 1, 0) and counts["r4"] == (3, 0, 0) and counts["r3"] == (0, 0, 0)


def test_fix_rounds(spark):
    rows = [("a", r, n) for r, n in enumerate([9, 5, 5, 2])] + [("b", r, n) for r, n in enumerate([9, 5, 3, 2, 1])] + [("c", 0, 0), ("c", 1, 0)]
    df = readers.literal_rows(spark, rows, "error_type string, round long, failures long")
    got = {}
    for r in runstate.fix_rounds(df, ["error_type"]).where("ran").collect():
        got.setdefault(r.error_type, []).append(r["round"])
    assert {k: sorted(v) for k, v in got.items()} == {"a": [0, 1, 2], "b": [0, 1, 2, 3], "c": [0]}


def test_policy(spark):
    schema = "session_id long, call_no long, tool string, decision string"
    calls = readers.literal_rows(
        spark, [(1, 1, "ask", "deny"), (1, 2, "ask", "always"), (1, 3, "ask", "deny"), (2, 4, "ask", None), (1, 5, "no", "once"), (1, 6, "yes", None)], schema
    )
    out = agentlog.policy_audit(calls, {"ask": "ask", "no": "allow", "yes": "allow"}, {"no": "deny"})
    assert [(r.call_no, r.allowed) for r in out.orderBy("call_no").collect()] == [
        (1, False), (2, True), (3, True), (4, False), (5, False), (6, True)
    ]


def test_validation_outcome(spark):
    schema = "rel_path string, output_path string, validation_passed boolean, validation_error string"
    state = readers.literal_rows(spark, [("a", "a.sql", None, None), ("b", "b.sql", True, None), ("c", "c.sh", None, None)], schema)
    checks = readers.literal_rows(spark, [("a.sql", True, None), ("b.sql", False, "bad")], "output_path string, success boolean, error string")
    got = {r.rel_path: (r.validation_passed, r.validation_error) for r in runstate.attach_validation(state, checks).collect()}
    assert got == {"a": (True, None), "b": (False, "bad"), "c": (None, None)}


def test_requested_sql(spark):
    converted = readers.literal_rows(spark, [("a/x.sql",), ("b/y.sql",)], "output_path string")
    requested = readers.literal_rows(spark, [("a/x.hql",), ("a/x.sql",), ("b/y",), ("c.sql",)], "output_path string")
    got = {r.output_path: r.status for r in corpus.requested_sql(converted, requested).collect()}
    assert got == {"a/x.sql": "ok", "b/y.sql": "ok", "c.sql": "not found"}


def test_corrupt_state_gives_no_rows(spark, tmp_path):
    assert readers.read_state(spark, str(tmp_path / "absent")).count() == 0
    (tmp_path / "s.json").write_text('{"repo_path": "/r", "files": [{"rel_path": "a"}')
    assert readers.read_state(spark, str(tmp_path), multi_line=True).count() == 0
    (tmp_path / "s.json").write_text('{"repo_path": "/r", "files": [{"rel_path": "a",\n "validation_passed": null}]}')
    assert [r.rel_path for r in readers.read_state(spark, str(tmp_path), multi_line=True).collect()] == ["a"]


def test_scan_replaces_bad_bytes(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.hql").write_bytes(b"ok \xff end")
    got = readers.scan_files(spark, str(tmp_path)).collect()
    assert [(r.rel_path, r.content, r.size) for r in got] == [("d/x.hql", "ok � end", 8)]


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_scan_reads_underscored_names(spark, tmp_path, scheme):
    for name in ("a.py", "__init__.py", "tests/__init__.py", "_lib/x.py", "_lib/.git/y.py", ".h/__init__.py", "_k=1.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(name)
    got = readers.scan_files(spark, scheme + str(tmp_path))
    assert sorted((r.rel_path, r.content) for r in got.collect()) == [
        (n, n) for n in ("__init__.py", "_k=1.py", "_lib/x.py", "a.py", "tests/__init__.py")
    ]
    types = {r.rel_path: r.file_type for r in corpus.classify(got).collect()}
    assert types["tests/__init__.py"] == "test"


def test_provisioned_table(spark):
    name = "provisioned_for_test"
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("p", T.StringType())])
    sinks.provision(spark, name, schema, scratch(spark, name), ["p"], comment='it\'s "quoted"')
    assert spark.table(name).schema["a"].dataType == T.LongType()
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    assert described["Comment"] == 'it\'s "quoted"'
    sinks.append_rows(spark.sql("SELECT 1L AS a, 'x' AS p UNION ALL SELECT 2L, 'y'"), name)
    sinks.overwrite_partitions(spark.sql("SELECT 'x' AS p, 3L AS a"), name)
    assert sorted(map(tuple, spark.table(name).collect())) == [(2, "y"), (3, "x")]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    spark.sql(f"DROP TABLE {name}")


def test_run_is_independent_of_order_and_partitions(spark):
    from loomshift.operators import stages
    from loomshift.plans import inputs

    source = inputs.files(spark, "/root/testdata/sf0.001")

    def run(frame):
        return frame.transform(stages.discover).transform(stages.convert, DATASET_MAP, PATH_MAP)

    spread = source.repartition(13, F.rand(5)).sortWithinPartitions(F.rand(6))
    assert run(spread).exceptAll(run(source)).isEmpty()
    state = run(source)
    checks = state.where("file_type = 'hql'").select(
        "output_path", (F.length("rel_path") % 2 == 0).alias("success"), F.lit("bad").alias("error")
    )
    done = stages.report(stages.validate(state, checks)).first()
    assert done.files_converted == state.count() and done.dry_run_passed + done.dry_run_failed > 0


def test_maps_are_loaded_as_json(spark):
    name = "maps_for_test"
    df = spark.sql("SELECT 1 AS a, map('k', 2) AS m, array(map('x', 1), NULL) AS ms, named_struct('f', 1.5F, 'm', map('y', 2)) AS s")
    sinks.provision(spark, name, df.schema, scratch(spark, name))
    assert spark.table(name).dtypes == [("a", "bigint"), ("m", "string"), ("ms", "array<string>"), ("s", "struct<f:double,m:string>")]
    sinks.append_rows(sinks.coerce(df, spark.table(name).schema), name)
    assert spark.table(name).first() == (1, '{"k":2}', ['{"x":1}', None], (1.5, '{"y":2}'))
    spark.sql(f"DROP TABLE {name}")


def test_state_document(spark, tmp_path):
    (tmp_path / "s.json").write_text(
        """{"repo_path": "/r", "output_dir": "/o",
        "files": [{"rel_path": "a.hql", "file_type": "hql", "output_path": "/o/a.sql", "status": "converted", "notes": ["n"],
                   "validation_passed": false, "validation_error": "bad"}],
        "bq": {"passed": 3, "failures": [["a.sql", "bad"]]},
        "tests": {"ran": true, "passed": 1, "failed": 2, "errors": 0, "failures": [["tests/t.py", "E   x"]]}}"""
    )
    docs = readers.state_documents(spark, str(tmp_path), multi_line=True)
    assert readers.state_files(docs).select("rel_path", "notes", "validation_passed").first() == ("a.hql", ["n"], False)
    assert [tuple(r) for r in readers.state_failures(docs, "bq").collect()] == [("/o", "a.sql", "bad")]
    assert [tuple(r) for r in readers.state_failures(docs, "tests").collect()] == [("/o", "tests/t.py", "E   x")]
    assert readers.state_test_counts(docs).first() == ("/o", 1, 2, 0)


def test_partitioned_writes_are_balanced(spark, tmp_path):
    # a hundred tasks, three folders: a file per folder, not three hundred
    df = spark.range(0, 3000, 1, 100).select("id", (F.col("id") % 3).alias("p"))
    sinks.write_partitioned(df, str(tmp_path / "t"), ["p"])
    files_written = list((tmp_path / "t").glob("p=*/*.parquet"))
    assert len(files_written) == 3
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3000


def test_edits_in_order(spark):
    f = spark.createDataFrame([("a", "x y x"), ("b", "z")], "rel_path string, content string")
    edits = spark.createDataFrame(
        [("a", 2, "q", "r", False), ("a", 1, "x", "q", True), ("a", 3, "r", "", True), ("b", 1, "", "k", True), ("c", 1, "a", "b", False)],
        "rel_path string, edit_no int, old string, new string, replace_all boolean")
    got = {r.rel_path: (r.content, r.replaced, list(r.statuses), r.status) for r in corpus.bulk_replace(f, edits).collect()}
    assert got == {
        "a": ("q y q", 2, ["edited", "not unique", "not found"], "not unique"),
        "b": ("z", 0, ["empty search text"], "empty search text"),
        "c": (None, 0, ["file not found"], "file not found"),
    }


def test_requested_paths_are_resolved(spark):
    files = spark.createDataFrame([("x.hql", "hql"), ("app/y.md", "skip")], "rel_path string, file_type string")
    asked = ["app/../x.hql", "./x.hql", "../x.hql", "/x.hql", "app/y.md", "app/../../x.hql", "gone"]
    got = {r.rel_path: r.status for r in corpus.work_list(files, spark.createDataFrame([(a,) for a in asked], "rel_path string")).collect()}
    assert got == {"app/../x.hql": "ok", "./x.hql": "ok", "../x.hql": "outside the repository", "/x.hql": "outside the repository",
                   "app/y.md": "not a target", "app/../../x.hql": "outside the repository", "gone": "not found"}


def test_strict_json_tells_texts_from_lists(spark):
    text = '{"k": "[note] hi", "l": [1], "o": {"a": 1}, "n": 5, "b": "{x"}'
    got = {p: one(spark, hive.json_value("p", f"$.{p}", strict=True), p=text) for p in "klonb"}
    assert got == {"k": "[note] hi", "l": None, "o": None, "n": "5", "b": "{x"}


def test_nested_events(spark):
    xml = "<Events><Event><EventId>E1</EventId><Dependency>D</Dependency><Dependency>F</Dependency><Description>d</Description></Event></Events>"
    deep = "<a><b><EventId>E2</EventId></b></a>"
    f = spark.createDataFrame([("x/a.xml", xml), ("x/b.xml", deep), ("x/c.xml", "<Event><EventId></EventId></Event>")], "rel_path string, content string")
    got = {r.rel_path: (r.event_id, list(r.dependencies), r.description, r.note) for r in extract.events(f).collect()}
    assert got == {"x/a.xml": ("E1", ["D", "F"], "d", "Event: E1"), "x/b.xml": ("E2", [], None, "Event: E2"), "x/c.xml": ("c", [], None, "Event: c")}
    assert {r[0] for r in f.select(extract.event_note()).collect()} == {"Event: E1", "Event: E2", "Event: c"}


def test_answers_by_id(spark):
    rows = [(0, "permission_request", "a", None), (1, "permission_request", "b", None), (5, "permission_resolved", "b", "once")]
    log = spark.createDataFrame([("s", n, kind, i, d) for n, kind, i, d in rows], "session_id string, event_id long, kind string, id string, decision string")
    log = log.withColumn("ts", F.timestamp_seconds("event_id"))
    by_id = agentlog.permission_outcomes(log, keys=["session_id", "id"]).collect()
    assert {r.event_id: r.decision for r in by_id} == {0: "deny", 1: "once"}
    assert {r.decision for r in agentlog.permission_outcomes(log).collect()} == {"once"}


def test_caps_above_the_group_limit(spark):
    steps = spark.range(2500).select(F.lit("s").alias("session_id"), "id", F.col("id").alias("step_ts"), F.col("id").alias("event_id"))
    got = agentlog.capped_steps(steps, max_steps=2000)
    assert got.count() == 2000 and got.agg(F.max("step")).first()[0] == 2000 and got.first()["capped"]


def test_blank_lines_are_told_by_the_whole_line(spark):
    lines = ["__ ERROR collecting tests/a.py __", " " * 600 + "ImportError", "  "]
    log = spark.createDataFrame([("r", k, x) for k, x in enumerate(lines)], "run_id string, line_no long, line string")
    assert testlog.blocks(log).first()["excerpt"] == " " * 500


def test_markers_of_cut_answers(spark):
    f = spark.createDataFrame([("a", "x\nx\nx")], "rel_path string, content string")
    assert [r.hit for r in corpus.grep(f, "x", limit=2).collect()] == ["x", "x", "... [result limit reached — narrow the search]"]
    assert corpus.grep(f, "x", limit=4).count() == 3
    state = spark.createDataFrame([(f"f{k}", "error", ["n"]) for k in range(4)], "rel_path string, status string, notes array<string>")
    assert [(r.status, r.note) for r in runstate.first_flagged(state, 3).collect()][-1] == ("more", "... [1 more flagged files]")


def test_search_ends_early(spark, tmp_path):
    """Later files are not read once the limit is met; ranges of any size give the hits of a whole search."""
    rows = [(f"d/f{k:04d}.py", "x\n" * (k % 4) + "y") for k in range(300)] + [("d/f0007.py", "x again")]
    f = files(spark, *rows)
    whole = [tuple(r) for r in corpus.search_lines(f, "x").orderBy("rel_path", "line_no").collect()]
    for first, limit in ((1, 40), (3, 100), (50, 7), (1000, 20), (2, 10_000), (10, 0), (270, 60)):
        got = [tuple(r) for r in corpus.grep(f, "x", limit=limit, first=first).collect()]
        cut = [(None, None, fixed.HITS_CUT)] if len(whole) >= limit else []
        assert got[-1:] == cut[-1:] or not cut
        assert [(a, n) for a, n, _ in got if a] == [(a, n) for a, n, _ in whole[:limit]], (first, limit)
    # a stored table in path order: the range reaches the scan
    folder = scratch(spark, "in_order")
    f.sort("rel_path").write.parquet(folder)
    kept = spark.read.parquet(folder)
    plan = kept.where("rel_path > 'd/f0010.py' AND rel_path <= 'd/f0020.py'")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThan(rel_path" in plan
    guarded = kept.select("rel_path", F.when(F.col("rel_path") > "d/f0100.py", F.raise_error(F.lit("was read"))).otherwise(F.col("content")).alias("content"))
    assert corpus.grep(guarded, "x", limit=100, first=80).count() == 101
    with pytest.raises(PySparkException):
        corpus.grep(guarded, "x", limit=200, first=80).count()


def test_search_of_a_tree_opens_the_first_files_only(spark, tmp_path):
    for k in range(60):
        path = tmp_path / f"d{k % 2}" / f"f {k:02d}[1].py"
        path.parent.mkdir(exist_ok=True)
        path.write_text(f"needle {k}\nother")
    (tmp_path / "d0" / "__init__.py").write_text("needle underscored")
    listed = {r.rel_path: r.size for r in readers.list_files(spark, str(tmp_path)).collect()}
    assert len(listed) == 61 and listed["d0/__init__.py"] == 18 and listed["d1/f 01[1].py"] == len("needle 1\nother")
    everything = corpus.grep_tree(spark, str(tmp_path), "needle").collect()
    assert len(everything) == 61 and everything[0].rel_path == "d0/__init__.py"
    assert [r.rel_path for r in everything] == sorted(listed)
    opened = readers.open_files(spark, str(tmp_path), readers.list_files(spark, str(tmp_path)))
    assert sorted((r.rel_path, r.content, r.size) for r in opened.collect()) == sorted((r.rel_path, r.content, r.size) for r in readers.scan_files(spark, str(tmp_path)).collect())
    few = corpus.grep_tree(spark, str(tmp_path), "needle", limit=5, first=4).collect()
    assert [r.rel_path for r in few[:5]] == sorted(listed)[:5] and few[5].hit == fixed.HITS_CUT
    assert corpus.grep_tree(spark, str(tmp_path), "needle", glob="d1/*", limit=3, first=2).first()["rel_path"].startswith("d1/")


def test_errors_are_stored_clean(spark):
    state = spark.createDataFrame([("o", None, None)], "output_path string, validation_passed boolean, validation_error string")
    outcome = spark.createDataFrame([("o", False, "400 POST https://h: Error: bad: name")], "output_path string, success boolean, error string")
    assert runstate.attach_validation(state, outcome).first()["validation_error"] == "bad: name"
    assert "bad: name" in runstate.error_log(outcome).first()["value"] and "POST" not in runstate.error_log(outcome).first()["value"]


def test_first_targets_tell_how_many_more(spark):
    found = spark.createDataFrame([(f"f{k:02d}.hql", "hql" if k % 4 else "skip") for k in range(20)], "rel_path string, file_type string")
    rows = [tuple(r) for r in runstate.first_targets(found, 3).collect()]
    assert rows == [("hql", "f01.hql", None), ("hql", "f02.hql", None), ("hql", "f03.hql", None), (None, None, 12)]
    assert all(r.more is None for r in runstate.first_targets(found, 15).collect())
