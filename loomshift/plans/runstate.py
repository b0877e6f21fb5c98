"""Queries over the run state of a migration: merge, validation, report, repair."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomshift.operators import corpus, extract, runstate, stages
from loomshift.plans import inputs
from loomshift.plans.corpus import REVIEWED, REWRITTEN, CLASSIFIED, PLANNED
from loomshift.plans.inputs import DATASET_MAP, PATH_MAP, with_ctes
from loomshift.plans.registry import query
from loomshift.session import read_table, scratch, stored
from loomshift.sources import readers, sinks, versions

_STATE = with_ctes(state=inputs.STATE, validations=inputs.VALIDATIONS)
_VALIDATED = _STATE.rstrip() + """, validated AS (
  SELECT s.*, v.success AS passed, v.error AS verror FROM state s LEFT JOIN
    (SELECT output_path, bool_and(success) AS success, min(substr(error, length('400 POST https://host/x: Error: ') + 1)) AS error FROM validations GROUP BY output_path) v USING (output_path))
"""


def validated(spark, sf_dir):
    return runstate.attach_validation(inputs.state(spark, sf_dir), inputs.validations(spark, sf_dir))


@query(
    "run_state_read",
    _STATE + """
    SELECT rel_path, file_type, output_path, status, coalesce(note, '') AS notes FROM state WHERE doc_id % 13 <> 5
    """,
)
def run_state_read(spark, sf_dir):
    """S3: state documents written as JSON and read back; corrupt ones give no rows."""
    s = inputs.derived(spark, sf_dir, inputs.STATE)
    entry = F.struct(
        "rel_path", "file_type", "output_path", "status",
        F.array_compact(F.array("note")).alias("notes"),
        F.lit(None).cast("boolean").alias("validation_passed"), F.lit(None).cast("string").alias("validation_error"),
    )
    document = F.to_json(F.struct(F.lit("/repo").alias("repo_path"), F.lit("/out").alias("output_dir"), F.array(entry).alias("files")))
    cut = F.substr(document, F.lit(1), F.length(document) - 20)
    folder = scratch(spark, "state")
    s.select(F.when(F.col("doc_id") % 13 == 5, cut).otherwise(document).alias("value")).write.text(folder)
    back = readers.read_state(spark, folder)
    return back.select("rel_path", "file_type", "output_path", "status", F.array_join("notes", " | ").alias("notes"))


@query(
    "state_merge",
    _STATE + """
    SELECT rel_path, CASE WHEN file_type = 'hql' THEN 'converted' ELSE status END AS status,
      CASE WHEN file_type = 'hql' THEN 'second run' ELSE coalesce(note, '') END AS notes FROM state
    UNION ALL SELECT 'new/' || rel_path, 'converted', 'second run' FROM state WHERE status = 'error' AND file_type = 'hdl'
    """,
)
def state_merge(spark, sf_dir):
    """A partial second run replaces its files and adds new ones; the state is written and read back."""
    old = inputs.state(spark, sf_dir).drop("doc_id")
    again = old.where("file_type = 'hql'")
    added = old.where("status = 'error' AND file_type = 'hdl'").withColumn("rel_path", F.concat(F.lit("new/"), "rel_path"))
    new = again.unionByName(added).withColumn("status", F.lit("converted")).withColumn("notes", F.array(F.lit("second run")))
    folder = scratch(spark, "merged")
    sinks.write_state(runstate.merge_state(old, new), folder)
    back = spark.read.schema(old.schema).parquet(folder)
    return back.select("rel_path", "status", F.array_join("notes", " | ").alias("notes"))


@query(
    "state_versions",
    _STATE + """
    SELECT rel_path, CASE WHEN status = 'error' THEN 'converted' ELSE status END AS status,
      CASE WHEN status = 'error' THEN 'version 2' WHEN file_type = 'hql' THEN 'version 3' ELSE coalesce(note, '') END AS notes FROM state
    """,
)
def state_versions(spark, sf_dir):
    """Two runs merged in place, each worked out from the state that it replaces."""
    folder = scratch(spark, "state")
    begin = inputs.state(spark, sf_dir).drop("doc_id")
    versions.create(begin, folder, "rel_path", buckets=16)
    current = versions.read(spark, folder, begin.schema)
    failed = current.where("status = 'error'")
    versions.merge(failed.withColumns({"status": F.lit("converted"), "notes": F.array(F.lit("version 2"))}), folder, "rel_path")
    current = versions.read(spark, folder, begin.schema)
    rest = current.where("file_type = 'hql' AND NOT array_contains(notes, 'version 2')")
    versions.merge(rest.withColumn("notes", F.array(F.lit("version 3"))), folder, "rel_path")
    versions.prune(spark, folder, keep=1)
    return versions.read(spark, folder, begin.schema).select("rel_path", "status", F.array_join("notes", " | ").alias("notes"))


@query(
    "validation_status",
    _VALIDATED + """
    SELECT rel_path, CAST(passed AS VARCHAR) AS validation_passed, verror AS validation_error FROM validated
    """,
)
def validation_status(spark, sf_dir):
    """Files that were not validated keep NULL."""
    rows = validated(spark, sf_dir)
    return rows.select("rel_path", F.col("validation_passed").cast("string").alias("validation_passed"), "validation_error")


@query(
    "validation_tally",
    _STATE + "SELECT count(*) FILTER (success) AS passed, count(*) FILTER (NOT success) AS failed, CAST(sum(bytes_processed) FILTER (success) AS BIGINT) AS bytes_passed FROM validations",
)
def validation_tally(spark, sf_dir):
    """A4."""
    return runstate.validation_tally(inputs.validations(spark, sf_dir))


@query(
    "clean_errors",
    _STATE + "SELECT output_path, substr(error, length('400 POST https://host/x: Error: ') + 1) AS cleaned FROM validations WHERE NOT success",
)
def clean_errors(spark, sf_dir):
    """P13."""
    failed = inputs.validations(spark, sf_dir).where("NOT success")
    return failed.select("output_path", extract.clean_error().alias("cleaned"))


@query(
    "validation_error_log",
    _STATE + """
    SELECT 'FILE: ' || output_path || chr(10) || repeat('-', 64) || chr(10) || substr(error, length('400 POST https://host/x: Error: ') + 1) || chr(10) AS block FROM validations WHERE NOT success
    """,
)
def validation_error_log(spark, sf_dir):
    """A block per failure, written as JSON lines and read back."""
    folder = scratch(spark, "errors")
    runstate.error_log(inputs.validations(spark, sf_dir)).write.json(folder)
    return spark.read.schema("output_path string, value string").json(folder).select(F.col("value").alias("block"))


@query(
    "migration_summary",
    _VALIDATED + """
    SELECT count(*) FILTER (status IN ('converted', 'review')) AS files_converted, count(*) FILTER (status = 'converted' AND passed) AS dry_run_passed,
      count(*) FILTER (status = 'converted' AND NOT passed) AS dry_run_failed, count(*) FILTER (status = 'review') AS needs_review,
      count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'skipped') AS skipped FROM validated
    """,
)
def migration_summary(spark, sf_dir):
    """A2, A3."""
    return runstate.summary(validated(spark, sf_dir))


@query(
    "review_validated",
    _VALIDATED + "SELECT status, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (passed IS NULL) AS not_run FROM validated GROUP BY status",
)
def review_validated(spark, sf_dir):
    """Validation by status; the summary counts `converted` only."""
    passed = F.col("validation_passed")
    return validated(spark, sf_dir).groupBy("status").agg(
        F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"), F.count_if(passed.isNull()).alias("not_run")
    )


@query(
    "report_listing",
    _VALIDATED + """
    SELECT rel_path, file_type, CASE status WHEN 'converted' THEN 'converted' WHEN 'review' THEN 'needs review' ELSE 'conversion errors' END AS section,
      CASE WHEN passed THEN 'validated' WHEN NOT passed THEN 'failed' ELSE 'skipped' END AS label,
      CASE WHEN status = 'converted' AND NOT passed THEN verror END AS error, coalesce(note, '') AS notes
    FROM validated WHERE status <> 'skipped'
    """,
)
def report_listing(spark, sf_dir):
    """P19."""
    return runstate.listing(validated(spark, sf_dir)).withColumn("notes", F.array_join("notes", " | "))


@query(
    "flagged_files",
    _STATE + """
    (SELECT status, rel_path, note FROM state WHERE status IN ('error', 'review') ORDER BY rel_path LIMIT 60)
    UNION ALL SELECT 'more', NULL, '... [' || CAST(count(*) - 60 AS VARCHAR) || ' more flagged files]' FROM state WHERE status IN ('error', 'review') HAVING count(*) > 60
    """,
)
def flagged_files(spark, sf_dir):
    """O2: the first 60 flagged files, and how many more there are."""
    return runstate.first_flagged(inputs.state(spark, sf_dir))


@query(
    "source_lookup",
    with_ctes(files=inputs.FILES, classified=CLASSIFIED, planned=PLANNED).rstrip() + r""",
    outs AS (SELECT DISTINCT output_path FROM planned UNION SELECT 'gone/' || output_path FROM planned WHERE file_type = 'config'),
    parts AS (SELECT output_path, regexp_replace(output_path, '\.[^./]+$', '') AS base, regexp_extract(output_path, '\.[^./]+$') AS ext, regexp_extract(output_path, '([^/]+)\.[^./]+$', 1) AS stem FROM outs),
    seen AS (SELECT rel_path FROM files WHERE NOT regexp_matches(rel_path, '(^|/)\.'))
    SELECT output_path, coalesce(
      (SELECT min(rel_path) FROM seen WHERE rel_path = CASE WHEN ext = '.sql' THEN base || '.hql' ELSE output_path END),
      (SELECT min(rel_path) FROM seen WHERE (ext = '.sql' AND rel_path = base || '.hdl') OR (ext = '.sh' AND rel_path = base || '.ksh')
          OR (starts_with(output_path, 'dags/') AND ends_with(rel_path, '/' || stem || '.xml')))) AS source
    FROM parts
    """,
)
def source_lookup(spark, sf_dir):
    """J5."""
    files = corpus.visible(inputs.files(spark, sf_dir)).select("rel_path")
    planned = corpus.with_output_path(corpus.classify(inputs.files(spark, sf_dir))).select("output_path", "file_type")
    gone = planned.where("file_type = 'config'").select(F.concat(F.lit("gone/"), "output_path").alias("output_path"))
    return runstate.source_lookup(planned.select("output_path").unionByName(gone), files)


_TRIAGE = """
SELECT doc_id, source, n_chars, CASE doc_id % 4 WHEN 0 THEN 'SYNTAX' WHEN 1 THEN 'BQ_DRY_RUN' WHEN 2 THEN 'PYTEST' ELSE 'TODO_REVIEW' END AS error_type,
  concat(CASE doc_id % 9 WHEN 0 THEN 'Type mismatch in column x: ' WHEN 1 THEN 'Unrecognized name: ' WHEN 2 THEN 'Unexpected "@" near ' WHEN 3 THEN 'PARTITION BY expression must be a date ' WHEN 4 THEN 'ModuleNotFoundError: '
   WHEN 5 THEN 'AssertionError: ' WHEN 6 THEN 'SyntaxError: ' WHEN 7 THEN 'value cannot be inserted into column y which has type INT64 ' ELSE 'timeout ' END, text) AS error
FROM documents
"""
_CLASS_SQL = """
CASE WHEN error_type = 'SYNTAX' THEN 'syntax' WHEN error_type = 'TODO_REVIEW' THEN 'todo'
  WHEN error_type = 'BQ_DRY_RUN' THEN CASE doc_id % 9 WHEN 0 THEN 'type mismatch' WHEN 7 THEN 'type mismatch' WHEN 1 THEN 'unknown name' WHEN 2 THEN 'stray parameter' WHEN 3 THEN 'partition expression' ELSE 'other' END
  ELSE CASE doc_id % 9 WHEN 4 THEN 'import' WHEN 5 THEN 'assertion' WHEN 6 THEN 'syntax' ELSE 'other' END END
"""


@query(
    "error_triage",
    with_ctes(errors=_TRIAGE) + f"SELECT error_type, {_CLASS_SQL} AS error_class, count(*) AS n FROM errors GROUP BY ALL",
)
def error_triage(spark, sf_dir):
    """F37."""
    errors = inputs.derived(spark, sf_dir, _TRIAGE)
    return errors.groupBy("error_type", extract.error_class().alias("error_class")).agg(F.count("*").alias("n"))


@query(
    "fix_rounds",
    with_ctes(errors=_TRIAGE).rstrip() + """,
    counted AS (SELECT source, error_type, r AS round, count(*) FILTER (n_chars % 6 > r) AS failures FROM errors, (SELECT unnest(range(0, 6)) AS r) GROUP BY ALL),
    marked AS (SELECT *, lag(failures) OVER w AS previous, coalesce(failures = 0 OR failures >= lag(failures) OVER w, FALSE) AS stuck FROM counted WINDOW w AS (PARTITION BY source, error_type ORDER BY round))
    SELECT source, error_type, round, failures, previous, CAST(failures < previous AS VARCHAR) AS progress,
      round <= 3 AND NOT coalesce(bool_or(stuck) OVER (PARTITION BY source, error_type ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS ran
    FROM marked
    """,
)
def fix_rounds(spark, sf_dir):
    """Failures left after each repair round, and which rounds run."""
    errors = inputs.derived(spark, sf_dir, _TRIAGE)
    # one pass: a count per round, then a row per round
    per_round = errors.groupBy("source", "error_type").agg(*[F.count_if(F.col("n_chars") % 6 > r).alias(f"r{r}") for r in range(6)])
    rounds = per_round.select(
        "source", "error_type",
        F.inline(F.array(*[F.struct(F.lit(r).cast("bigint").alias("round"), F.col(f"r{r}").alias("failures")) for r in range(6)])),
    )
    result = runstate.fix_rounds(rounds, ["source", "error_type"])
    return result.withColumn("progress", F.col("progress").cast("string"))


# --- the whole run ---------------------------------------------------------------------------

_RUN = with_ctes(files=inputs.FILES, classified=CLASSIFIED, planned=PLANNED, rewritten=REWRITTEN, reviewed=REVIEWED)


def run_state(spark, sf_dir):
    """Scan, classify, plan, rewrite and flag: one state row per target."""
    return inputs.files(spark, sf_dir).transform(stages.discover).transform(stages.convert, DATASET_MAP, PATH_MAP)


@query(
    "migration_end_to_end",
    _RUN.rstrip() + r""",
    new AS (SELECT rel_path, file_type, output_path, CASE WHEN needs_review THEN 'review' ELSE 'converted' END AS status, length(converted) AS chars, contains(converted, '${') AS open FROM reviewed),
    old AS (SELECT rel_path, file_type, output_path, 'error' AS status, chars, open FROM new WHERE file_type = 'hdl'
      UNION ALL SELECT 'gone/' || rel_path, file_type, 'gone/' || output_path, 'error', 0, FALSE FROM new WHERE file_type = 'config'),
    state AS (SELECT * FROM old WHERE rel_path NOT IN (SELECT rel_path FROM new) UNION ALL SELECT * FROM new),
    outcome AS (SELECT output_path, bool_and(NOT open) AS passed FROM state WHERE ends_with(output_path, '.sql') AND NOT regexp_matches(output_path, '(^|/)dags(/|$)') GROUP BY output_path)
    SELECT file_type, count(*) AS files, count(*) FILTER (status IN ('converted', 'review')) AS files_converted,
      count(*) FILTER (status = 'converted' AND passed) AS dry_run_passed, count(*) FILTER (status = 'converted' AND NOT passed) AS dry_run_failed,
      count(*) FILTER (status = 'review') AS needs_review, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'skipped') AS skipped,
      CAST(sum(chars) AS BIGINT) AS chars FROM state LEFT JOIN outcome USING (output_path) GROUP BY file_type
    """,
)
def migration_end_to_end(spark, sf_dir):
    """Scan, convert, merge with the state of an earlier run, select the SQL, validate, report by file type.

    The validator here passes an SQL file without a ${variable}; its outcomes come back by output path.
    """
    converted = run_state(spark, sf_dir).withColumns({"chars": F.length("converted"), "open": F.col("converted").contains("${")})
    # texts are rewritten once; every later stage reads the narrow state
    new = stored(converted.drop("converted", "notes"), "run-state")
    failed = new.where("file_type = 'hdl'").withColumn("status", F.lit("error"))
    gone = new.where("file_type = 'config'").withColumns({
        "rel_path": F.concat(F.lit("gone/"), "rel_path"), "output_path": F.concat(F.lit("gone/"), "output_path"),
        "status": F.lit("error"), "chars": F.lit(0), "open": F.lit(False)})
    state = runstate.merge_state(failed.unionByName(gone), new)
    validations = corpus.sql_outputs(state).select(
        "output_path", (~F.col("open")).alias("success"),
        F.when(F.col("open"), "400 POST https://host/x: Error: unresolved variable").alias("error"))
    return stages.report(stages.validate(state, validations), ["file_type"], [F.count("*").alias("files"), F.sum("chars").cast("bigint").alias("chars")])


@query(
    "migration_by_table",
    with_ctes(files=inputs.files_moved_by_rules(), classified=CLASSIFIED, planned=PLANNED, rewritten=REWRITTEN, reviewed=REVIEWED)
    + "SELECT rel_path, file_type, output_path, CASE WHEN needs_review THEN 'review' ELSE 'converted' END AS status, md5(converted) AS digest FROM reviewed",
)
def migration_by_table(spark, sf_dir):
    """The conversion of every file type with rules read from tables that grow with the data."""
    prefixes = inputs.derived(spark, sf_dir, inputs.PATH_RULES)
    datasets = inputs.derived(spark, sf_dir, inputs.NAME_RULES)
    state = inputs.files(spark, sf_dir).transform(stages.discover).transform(stages.convert, datasets, prefixes)
    return state.select("rel_path", "file_type", "output_path", "status", F.md5(F.encode("converted", "UTF-8")).alias("digest"))


@query(
    "converted_sink",
    _RUN + "SELECT file_type, output_path, rel_path, md5(converted) AS digest FROM reviewed",
)
def converted_sink(spark, sf_dir):
    """The converted corpus, written by file type and read back."""
    folder = scratch(spark, "converted")
    rows = run_state(spark, sf_dir).select("file_type", "output_path", "rel_path", "converted")
    sinks.write_converted(rows, folder)
    back = readers.read_partitioned(spark, folder, rows.schema, ["file_type"])
    return back.select("file_type", "output_path", "rel_path", F.md5(F.encode("converted", "UTF-8")).alias("digest"))


# --- tables and formats ---------------------------------------------------------------------------


def _table_name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex[:12]}"


@query(
    "insert_overwrite_partition",
    """
    SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS first_key,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'new' ELSE 'old' END AS version
    FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR o_orderstatus = 'F' GROUP BY ALL
    """,
)
def insert_overwrite_partition(spark, sf_dir):
    """Only the partitions of the new rows are replaced."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit("old").alias("version"), "o_orderpriority")
    name = _table_name("orders_by_priority")
    sinks.provision(spark, name, o.schema, scratch(spark, name), ["o_orderpriority"])
    sinks.append_rows(o, name)
    fresh = o.where("o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'").withColumn("version", F.lit("new"))
    sinks.overwrite_partitions(fresh, name)
    return sinks.detached(spark, name).groupBy("o_orderpriority", "version").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("first_key")
    )


@query(
    "audit_append",
    """
    SELECT 'orders' AS job_name, o_orderstatus AS step, count(*) AS row_count FROM orders GROUP BY ALL
    UNION ALL SELECT 'lineitem', l_returnflag, count(*) FROM lineitem GROUP BY ALL
    """,
)
def audit_append(spark, sf_dir):
    """Two appends to one audit table."""
    name = _table_name("audit")

    def counted(table, step, job):
        rows = read_table(spark, sf_dir, table).groupBy(F.col(step).alias("step")).agg(F.count("*").alias("row_count"))
        return rows.withColumn("job_name", F.lit(job)).select("job_name", "step", "row_count")

    first = counted("orders", "o_orderstatus", "orders")
    sinks.provision(spark, name, first.schema, scratch(spark, name))
    sinks.append_rows(first, name)
    sinks.append_rows(counted("lineitem", "l_returnflag", "lineitem"), name)
    return sinks.detached(spark, name)


@query(
    "provision_and_load",
    "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_name, c_mktsegment FROM customer",
)
def provision_and_load(spark, sf_dir):
    """Drop, create with mapped types and a description, load."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_name", "c_mktsegment")
    name = _table_name("customer")
    sinks.provision(spark, name, c.schema, scratch(spark, name), ["c_mktsegment"], comment="customers, with mapped types")
    sinks.append_rows(sinks.coerce(c, spark.table(name).schema), name)
    return sinks.detached(spark, name)


@query(
    "format_roundtrip",
    """
    SELECT s AS storage, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
      max(o_orderkey) AS last_key, count(DISTINCT o_orderpriority) AS priorities
    FROM orders, (VALUES ('textfile'), ('parquet'), ('orc')) f(s) GROUP BY s
    """,
)
def format_roundtrip(spark, sf_dir):
    """Delimited text, Parquet and ORC, each written and read back."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    out = None
    for storage in ("textfile", "parquet", "orc"):
        folder = scratch(spark, storage)
        sinks.write_formatted(o, folder, storage)
        back = readers.read_formatted(spark, folder, o.schema, storage).groupBy(F.lit(storage).alias("storage")).agg(
            F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
            F.max("o_orderkey").alias("last_key"), F.count_distinct("o_orderpriority").alias("priorities"),
        )
        out = back if out is None else out.unionByName(back)
    return out


@query(
    "partitioned_read",
    "SELECT strftime(o_orderdate, '%Y-01-01') AS year_start, 'string' AS kept_type, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1",
)
def partitioned_read(spark, sf_dir):
    """A STRING partition column stays text, and filters on it prune folders."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-01-01")).alias("year_start")
    )
    folder = scratch(spark, "by_year")
    sinks.write_partitioned(o, folder, ["year_start"])
    back = readers.read_partitioned(spark, folder, o.schema, ["year_start"]).where("year_start >= '1997-01-01'")
    kept = F.typeof("year_start")
    return back.groupBy("year_start", kept.alias("kept_type")).agg(F.count("*").alias("n"))


@query(
    "csv_export",
    "SELECT conv_id, turn, role, text FROM conversations",
)
def csv_export(spark, sf_dir):
    """Exported with a header; texts with line breaks and quotes come back whole."""
    c = read_table(spark, sf_dir, "conversations")
    folder = scratch(spark, "export")
    sinks.export_csv(c, folder)
    return spark.read.schema(c.schema).options(header="true", multiLine="true", escape='"', emptyValue="").csv(folder)


@query(
    "corpus_scan",
    """
    SELECT 'lang=' || lang || '/source=' || source AS folder, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes,
      CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY ALL
    """,
)
def corpus_scan(spark, sf_dir):
    """A tree of text files, listed, read and decoded."""
    folder = scratch(spark, "tree")
    texts = read_table(spark, sf_dir, "documents").select("lang", "source", "text")
    sinks.balanced(texts, ["lang", "source"]).write.partitionBy("lang", "source").text(folder)
    # the writer's own marker files start with an underscore and are no part of the tree
    found = readers.scan_files(spark, folder, underscored=False)
    return found.groupBy(
        F.regexp_replace("rel_path", "/[^/]+$", "").alias("folder")
    ).agg(F.sum("size").alias("bytes"), F.sum(F.length("content")).alias("chars"))


