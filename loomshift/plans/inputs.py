"""Inputs that the queries derive from the given tables.

Each input is one SELECT over the tables, in the common subset of both SQL
dialects, so the check and the query start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomshift.session import read_table

DATASET_MAP = {"ops_db": "raw_zone", "lakedb": "raw_zone", "refs_db": "dims"}
PATH_MAP = {
    "/corp/metrics": "gs://my-bucket/metrics",
    "/corp/metrics/raw": "gs://raw-bucket/raw",
    "/corp/landing": "gs://landing-bucket",
}


def text_sql(template: str) -> str:
    """SQL text expression for a template.

    Quotes, line breaks and $ are spelled by code, which reads alike in both dialects.
    """
    parts = [
        f"chr({ord(piece)})" if piece in ("'", "\n", "$") else f"'{piece}'"
        for piece in re.split(r"('|\n|\$)", template)
        if piece
    ]
    return f"concat({', '.join(parts)})" if parts else "''"


# --- a corpus of source files from documents ------------------------------------

_G = "CAST(floor(doc_id / 16) AS BIGINT)"

_PATHS = [
    "app<a>/hql/job_<g>.hql",
    "app<a>/ddl/table_<g>.hdl",
    "app<a>/bin/run_<g>.sh",
    "app<a>/bin/run_<g>.ksh",
    "app<a>/conf/filters_<g>.config",
    "app<a>/conf/paths_<g>.config",
    "app<a>/Event_Engine/evt_<g>.xml",
    "app<a>/xml/other_<g>.xml",
    "app<a>/Tests/test_<g>.py",
    "app<a>/src/job_<g>.py",
    "app<a>/src/etl_<g>.py",
    "app<a>/src/util_<g>.py",
    "app<a>/hql/LOAD_<g>.HQL",
    "app<a>/.git/obj_<g>.hql",
    "app<a>/docs/readme_<g>.md",
    "app<a>/hql/job_<g>.hdl",
]

_HQL = """SET hive.exec.parallel=true;
set mapreduce.job.queuename=etl;
USE ${ops_db};
INSERT OVERWRITE TABLE ${ops_db}.t_<g> PARTITION (trans_dt)
SELECT nvl(a, 0), size(split(b, ' ')), from_unixtime(unix_timestamp()), CAST(c AS BIGINT)
FROM ${other_db}.src_<g> s JOIN ${refs_db}.d_<a> d ON s.id = d.id
WHERE loc = '/corp/metrics/raw/<g>' OR loc = '/corp/metrics2/<g>' OR loc = '/corp/other/<g>'
AND trans_dt = '${trans_dt}' AND run = @run_dt AND v > @min_value AND z = @@system_var AND r2 = @run_dt"""

_HEADS = [
    _HQL + "\nAND ${hivevar:filter_<a>}",
    "-- Table <g>\nUSE ${ops_db};\nDROP TABLE IF EXISTS t_<g>;\nCREATE EXTERNAL TABLE IF NOT EXISTS t_<g> (id BIGINT)\nLOCATION '/corp/landing/t_<g>';",
    "#!/bin/ksh\nhive -f job_<g>.hql -d trans_dt=${trans_dt}\nhdfs dfs -put /corp/metrics/out_<g> /corp/landing/in_<g>\n# TODO: check count_check\n",
    "#!/bin/ksh\nsrc_cnt=$(run_hive_count ${ops_db})\nhdfs dfs -ls /corp/metrics/raw/x_<g>\n",
    "# filters\nset hivevar:filter_no_tests=s.record_type <> 'TEST';\nset hivevar:filter_min_value = coalesce(s.value, 0)\n  >= <g>;\nset hivevar:filter_<g>= s.carrier_id is not null ;",
    "# paths\nHIVE_RUNNER=hive-runner\nmapred_qname=etl\nHiveDBPath=/corp/metrics/db_<g>\nops_db=lakedb\nHqlDir=/opt/hql\nHdlDir=/opt/hdl\nold=lakedb_old\nHomeDir=/home/app<a>",
    "<xml>",
    "<config><a><g></a></config>",
    "import pytest\nfrom pyspark.sql import SparkSession\ndef test_<g>():\n    assert 1 == 1",
    "from pyspark.sql import SparkSession\npath = \"/corp/metrics/export_<g>\"\nold = '/corp/landing/<g>'\ndb = 'ops_db'\nname = \"lakedb\"",
    "# uses PySpark\nvalues = (1,",
    "def f_<g>():\n    return <g>",
    "INSERT INTO t_<g> SELECT concat_ws('-', a, b), get_json_object(c, '$.k') FROM ${lakedb}.x_<g>",
    "SELECT 1",
    "```sql\nSELECT <g>",
    "CREATE TABLE t_<g> (m MAP<STRING,STRING>)\nSTORED AS PARQUET",
]

_EVENT = (
    "<Event><EventId>EVT_<g></EventId>"
    "<Schedule><Expression>0 5 * * *</Expression><TimeZone>America/New_York</TimeZone></Schedule>"
    "<Action><Command>/corp/scripts/run_<g>.sh</Command><TimeoutMinutes>90</TimeoutMinutes><RunAsUser>svc_<a></RunAsUser></Action>"
    "<Dependency>EVT_<up></Dependency><Dependency>EVT_<far></Dependency>"
    "<OnFailure><RetryCount>2</RetryCount><RetryDelayMinutes>15</RetryDelayMinutes><Email>team<a>@example.com</Email></OnFailure>"
    "<OnSuccess><PublishEvent>EVT_<down></PublishEvent></OnSuccess><Description>"
)
_TAGS = ("g", "a", "up", "far", "down")


# how the document text follows the opening, and what closes the file
_VARIANTS = (
    [(i, p, h, "comment" if i in (8, 9, 10, 11) else "plain", "\n```" if i == 14 else "") for i, (p, h) in enumerate(zip(_PATHS, _HEADS))]
    + [
        # an event cut short, one without its id, a script left in a code fence
        (16, _PATHS[6], _EVENT, "escape", ""),
        (17, _PATHS[6], _EVENT.replace("<EventId>EVT_<g></EventId>", ""), "escape", "</Description></Event>"),
        (18, _PATHS[11], "```python", "comment", "\n```"),
    ]
)
_VARIANTS[6] = (6, _PATHS[6], _EVENT, "escape", "</Description></Event>")


def _values() -> str:
    rows = []
    for number, path, head, mode, tail in _VARIANTS:
        opening = head if mode == "escape" else head + "\n"
        marked = [re.sub(r"<(g|a|up|far|down)>", r"[[\1]]", t) for t in (path, opening)]
        rows.append(f"({number}, {text_sql(marked[0])}, {text_sql(marked[1])}, '{mode}', {text_sql(tail)})")
    return ", ".join(rows)


def _filled(col: str) -> str:
    for mark in ("g", "a", "up", "far", "down"):
        col = f"replace({col}, '[[{mark}]]', CAST({mark} AS STRING))"
    return col


FILES = f"""
SELECT doc_id, kind, g, {_filled('path')} AS rel_path, concat({_filled('head')},
    CASE mode WHEN 'plain' THEN text WHEN 'comment' THEN concat('# ', replace(text, chr(10), concat(chr(10), '# ')))
      ELSE replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END, tail) AS content
FROM (SELECT doc_id, text, doc_id % 16 AS kind, {_G} AS g, {_G} % 7 AS a,
        CASE WHEN {_G} % 6 = 5 THEN {_G} + 100000000 ELSE {_G} - 1 END AS up,
        CAST(floor({_G} / 2) AS BIGINT) AS far, {_G} + 1 AS down,
        CASE WHEN doc_id % 16 = 6 AND {_G} % 5 = 4 THEN 16 WHEN doc_id % 16 = 6 AND {_G} % 7 = 3 THEN 17
             WHEN doc_id % 16 = 11 AND {_G} % 4 = 1 THEN 18 ELSE doc_id % 16 END AS variant
      FROM documents) d
JOIN (VALUES {_values()}) t(number, path, head, mode, tail) ON variant = number
"""

# --- run state from documents and labels ------------------------------------------

STATE = """
SELECT d.doc_id,
  concat(d.source, '/', CAST(d.doc_id AS STRING), CASE WHEN d.doc_id % 3 = 0 THEN '.hql' WHEN d.doc_id % 3 = 1 THEN '.hdl' ELSE '.sh' END) AS rel_path,
  CASE WHEN d.doc_id % 3 = 0 THEN 'hql' WHEN d.doc_id % 3 = 1 THEN 'hdl' ELSE 'shell' END AS file_type,
  concat(d.source, '/', CAST(d.doc_id AS STRING), CASE WHEN d.doc_id % 3 < 2 THEN '.sql' ELSE '.sh' END) AS output_path,
  CASE WHEN d.lang = 'en' THEN 'converted' WHEN d.lang = 'fr' THEN 'review' WHEN d.lang = 'de' THEN 'error' ELSE 'skipped' END AS status,
  CASE WHEN d.lang = 'en' THEN concat('note ', d.source) END AS note
FROM documents d
"""
VALIDATIONS = """
SELECT l.doc_id,
  concat(d.source, '/', CAST(l.doc_id AS STRING), CASE WHEN l.doc_id % 3 < 2 THEN '.sql' ELSE '.sh' END) AS output_path,
  l.toxic = 0 AS success,
  CASE WHEN l.toxic <> 0 THEN concat('400 POST https://host/x: Error: ', 'Query parameter ', chr(39), '@run_dt', chr(39),
       ' has type DATE which cannot be coerced to expected type STRING at [', CAST(l.quality AS STRING), ':15] near ', d.text) END AS error,
  d.n_chars AS bytes_processed
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""

# --- event log from events ---------------------------------------------------------

LOG = """
SELECT event_id, user_id AS session_id, ts,
  CASE event_type WHEN 'view' THEN 'tool_call' WHEN 'click' THEN 'tool_result' WHEN 'error' THEN 'error'
       WHEN 'signup' THEN 'permission_request' ELSE 'permission_resolved' END AS kind,
  CASE event_type WHEN 'view' THEN 'read_file' WHEN 'click' THEN 'edit_file' WHEN 'error' THEN 'run_bash'
       WHEN 'signup' THEN 'write_file' ELSE 'list_files' END AS tool,
  k, CASE WHEN k % 3 = 0 THEN 'once' WHEN k % 3 = 1 THEN 'deny' WHEN k % 7 = 0 THEN 'always' ELSE 'once' END AS decision,
  k * 10 AS input_tokens, k % 17 AS output_tokens, k * 3 AS cache_read, k % 5 AS cache_write
FROM (SELECT *, CAST(replace(replace(props, '{"k": ', ''), '}', '') AS BIGINT) AS k FROM events) e
"""

MESSAGES = "SELECT conv_id, turn, role, text FROM conversations"


def with_ctes(**ctes: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in ctes.items()) + "\n"


# --- mapping tables of many rules, which grow with the data ----------------------------

_RULE_HEADS = {"orders": ("/corp/other/", "gs://other/k", "o_orderkey"), "supplier": ("/corp/landing/in_", "gs://in-", "s_suppkey"),
               "customer": ("/corp/metrics/db_", "gs://db/", "c_custkey"), "part": ("/corp/metrics/export_", "gs://exp/", "p_partkey")}
_LINE_RULES = "SELECT concat('{head}', l_orderkey, '.', l_linenumber) AS prefix, concat('{to}', l_orderkey) AS target FROM lineitem"
PATH_RULES = " UNION ALL ".join(
    [f"SELECT concat('{head}', {key}) AS prefix, concat('{to}', {key}) AS target FROM {table}" for table, (head, to, key) in _RULE_HEADS.items()]
    + [_LINE_RULES.format(head="/corp/metrics/raw/", to="gs://lines/"), _LINE_RULES.format(head="/corp/landing/out_", to="gs://out/")]
    + [f"SELECT '{k}', '{v}'" for k, v in PATH_MAP.items()])
NAME_RULES = "SELECT concat('db_', c_custkey) AS hive_name, concat('zone_', c_nationkey) AS dataset FROM customer" + "".join(
    f" UNION ALL SELECT '{k}', '{v}'" for k, v in DATASET_MAP.items())


def files_moved_by_rules() -> str:
    """SQL for FILES after the rules of PATH_RULES that are not in PATH_MAP: each file names its own number behind a head,
    where the longest key that begins the number decides."""
    keys = " UNION ALL ".join(f"SELECT '{head}' AS head, '{to}' AS dest, CAST({key} AS VARCHAR) AS k FROM {table}" for table, (head, to, key) in _RULE_HEADS.items())
    moved = "content"
    for n, (head, to, _) in enumerate(_RULE_HEADS.values()):
        moved = f"CASE WHEN k{n} IS NULL THEN {moved} ELSE replace({moved}, concat('{head}', g), concat('{to}', k{n}, substr(CAST(g AS VARCHAR), length(k{n}) + 1))) END"
    best = "".join(
        f" LEFT JOIN (SELECT g, max_by(k, length(k)) AS k{n} FROM (SELECT DISTINCT CAST(floor(doc_id / 16) AS BIGINT) AS g FROM documents)"
        f" JOIN ({keys}) ON head = '{head}' AND starts_with(CAST(g AS VARCHAR), k) GROUP BY g) USING (g)" for n, (head, _, _) in enumerate(_RULE_HEADS.values()))
    return f"SELECT doc_id, kind, g, rel_path, {moved} AS content FROM ({FILES}){best}"


TABLES = ["documents", "labels", "events", "conversations", "orders", "lineitem", "customer", "part", "supplier"]


def derived(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    """Runs an input SELECT over the tables it names."""
    names = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", select)]
    # braces of the texts themselves are doubled for the formatter
    statement = select.replace("{", "{{").replace("}", "}}")
    for t in names:
        statement = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", statement)
    return spark.sql(statement, **{t: read_table(spark, sf_dir, t) for t in names})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, FILES).select("rel_path", "content")


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run state rows before validation."""
    rows = derived(spark, sf_dir, STATE)
    notes = F.when(F.col("note").isNull(), F.array().cast("array<string>")).otherwise(F.array("note"))
    return rows.select(
        "doc_id", "rel_path", "file_type", "output_path", "status", notes.alias("notes"),
        F.lit(None).cast("boolean").alias("validation_passed"), F.lit(None).cast("string").alias("validation_error"),
    )


def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, VALIDATIONS).drop("doc_id")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, LOG)
