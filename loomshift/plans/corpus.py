"""Queries over a corpus of source files derived from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomshift import fixed
from loomshift.functions import text
from loomshift.operators import corpus, extract, mapping, runstate
from loomshift.plans import inputs
from loomshift.plans.inputs import DATASET_MAP, PATH_MAP, with_ctes
from loomshift.plans.registry import query
from loomshift.session import read_table, stored
from loomshift.sources import readers

# --- SQL shared by the checks -----------------------------------------------------

_SUFFIX = r"lower(regexp_extract(regexp_extract(rel_path, '[^/]+$'), '^.+(\.[^.]+)$', 1))"
CLASSIFIED = rf"""
SELECT *, CASE
   WHEN sfx = '.hql' THEN 'hql' WHEN sfx = '.hdl' THEN 'hdl' WHEN sfx IN ('.sh', '.ksh') THEN 'shell'
   WHEN sfx = '.config' AND contains(content, 'hivevar:') THEN 'filters' WHEN sfx = '.config' THEN 'config'
   WHEN sfx = '.xml' AND regexp_matches(lower(rel_path), '(^|/)(event_engine|scheduler|schedulers|workflows|dag)(/|$)') THEN 'dag_xml'
   WHEN sfx = '.py' AND regexp_matches(lower(rel_path), '(^|/)(tests|test)(/|$)') THEN 'test'
   WHEN sfx = '.py' AND (contains(content, 'SparkSession') OR contains(lower(content), 'pyspark')) THEN 'pyspark'
   ELSE 'skip' END AS file_type
FROM (SELECT *, {_SUFFIX} AS sfx FROM files WHERE NOT regexp_matches(rel_path, '(^|/)\.'))
"""
PLANNED = r"""
SELECT *, CASE WHEN file_type = 'dag_xml' THEN 'dags/' || regexp_replace(regexp_extract(rel_path, '[^/]+$'), '\.[^.]+$', '') || '.py'
  ELSE regexp_replace(rel_path, '\.[^./]+$', '') || CASE WHEN file_type IN ('hql', 'hdl') THEN '.sql' WHEN file_type = 'shell' THEN '.sh'
       WHEN file_type IN ('config', 'filters') THEN '.config' ELSE '.py' END END AS output_path
FROM classified WHERE file_type <> 'skip'
"""

_QUOTED_SQL = (
    r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '''/corp/metrics/raw([^'']*)''', '''gs://raw-bucket/raw\1''', 'g'),"""
    r""" '''/corp/metrics([^'']*)''', '''gs://my-bucket/metrics\1''', 'g'), '''/corp/landing([^'']*)''', '''gs://landing-bucket\1''', 'g'),"""
    r""" '''(/corp/[^'']+)''', '''gs://my-bucket\1''', 'g')"""
)
_BARE_SQL = (
    r"""regexp_replace(regexp_replace(regexp_replace({x}, '/corp/metrics/raw(\S+)', 'gs://raw-bucket/raw\1', 'g'),"""
    r""" '/corp/metrics(\S+)', 'gs://my-bucket/metrics\1', 'g'), '/corp/landing(\S+)', 'gs://landing-bucket\1', 'g')"""
)
_REFS_SQL = (
    r"""regexp_replace(regexp_replace(regexp_replace({x}, '\$\{{ops_db\}}\.(\w+)', '`my-project.raw_zone.\1`', 'g'),"""
    r""" '\$\{{lakedb\}}\.(\w+)', '`my-project.raw_zone.\1`', 'g'), '\$\{{refs_db\}}\.(\w+)', '`my-project.dims.\1`', 'g')"""
)
_SCRIPT_SQL = (
    r"""regexp_replace(regexp_replace(regexp_replace({x}, '(["''])/corp/metrics/raw([^"'']*)(["''])', '\1gs://raw-bucket/raw\2\3', 'g'),"""
    r""" '(["''])/corp/metrics([^"'']*)(["''])', '\1gs://my-bucket/metrics\2\3', 'g'), '(["''])/corp/landing([^"'']*)(["''])', '\1gs://landing-bucket\2\3', 'g')"""
)
_NAMES_SQL = (
    r"""regexp_replace(regexp_replace({x}, '"(ops_db|lakedb)"', '"raw_zone"', 'g'), '''(ops_db|lakedb)''', '''raw_zone''', 'g')"""
)
_NOTES_SQL = r"""nullif(array_to_string(list_transform(regexp_extract_all(content, '\$\{(?:ops_db|lakedb|refs_db)\}\.\w+'), lambda h:
  h || ' → `my-project.' || CASE WHEN starts_with(h, '${refs_db}') THEN 'dims' ELSE 'raw_zone' END || '.' || regexp_extract(h, '\.(\w+)', 1) || '`'), ' | '), '')"""
_NO_USE = r"""regexp_replace({x}, 'USE\s+\$\{{\w+\}};?\s*\n?', '', 'g')"""


def _sql(template: str, x: str) -> str:
    return template.format(x=x)


REWRITTEN = f"""
SELECT *, CASE file_type
  WHEN 'hql' THEN {_sql(_QUOTED_SQL, _sql(_REFS_SQL, 'content'))}
  WHEN 'hdl' THEN {_sql(_QUOTED_SQL, _sql(_REFS_SQL, _sql(_NO_USE, 'content')))}
  WHEN 'shell' THEN {_sql(_BARE_SQL, 'content')}
  WHEN 'config' THEN regexp_replace(regexp_replace({_sql(_BARE_SQL, 'content')}, '=(ops_db|lakedb)\\b', '=raw_zone', 'g'), '=refs_db\\b', '=dims', 'g')
  WHEN 'pyspark' THEN {_sql(_NAMES_SQL, _sql(_SCRIPT_SQL, 'content'))}
  ELSE content END AS converted
FROM planned
"""
_FILES = with_ctes(files=inputs.FILES)
_CLASSIFIED = with_ctes(files=inputs.FILES, classified=CLASSIFIED)
_PLANNED = with_ctes(files=inputs.FILES, classified=CLASSIFIED, planned=PLANNED)
_REWRITTEN = with_ctes(files=inputs.FILES, classified=CLASSIFIED, planned=PLANNED, rewritten=REWRITTEN)
REVIEWED = """
SELECT *, CASE WHEN file_type = 'dag_xml' THEN TRUE WHEN file_type = 'filters' THEN FALSE
   WHEN file_type = 'hql' THEN contains(converted, 'TODO:') OR contains(converted, '${hivevar:')
   WHEN file_type IN ('pyspark', 'test') THEN contains(converted, 'TODO:') OR contains(lower(converted), 'pyspark')
   ELSE contains(converted, 'TODO:') END AS needs_review
FROM rewritten
"""


# --- classify and plan ---------------------------------------------------------------


@query("classify_files", _CLASSIFIED + "SELECT rel_path, file_type FROM classified")
def classify_files(spark, sf_dir):
    """P1, P2."""
    return corpus.classify(inputs.files(spark, sf_dir)).select("rel_path", "file_type")


@query(
    "work_list",
    _CLASSIFIED + """, requested AS (SELECT CASE doc_id % 10 WHEN 0 THEN concat('gone/', CAST(doc_id AS VARCHAR)) WHEN 1 THEN concat('../', rel_path) ELSE rel_path END AS rel_path FROM files)
    SELECT r.rel_path, c.file_type, CASE WHEN starts_with(r.rel_path, '../') THEN 'outside the repository' WHEN c.file_type IS NULL THEN 'not found'
      WHEN c.file_type = 'skip' THEN 'not a target' ELSE 'ok' END AS status
    FROM (SELECT DISTINCT rel_path FROM requested) r LEFT JOIN classified c ON r.rel_path = c.rel_path
    """,
)
def work_list(spark, sf_dir):
    """Requested files with the reason why some cannot be converted."""
    all_files = inputs.derived(spark, sf_dir, inputs.FILES)
    pick = F.col("doc_id") % 10
    requested = all_files.select(
        F.when(pick == 0, F.concat(F.lit("gone/"), F.col("doc_id").cast("string")))
        .when(pick == 1, F.concat(F.lit("../"), "rel_path"))
        .otherwise(F.col("rel_path")).alias("rel_path")
    )
    return corpus.work_list(corpus.classify(all_files.select("rel_path", "content")), requested)


@query("output_paths", _PLANNED + "SELECT rel_path, file_type, output_path FROM planned")
def output_paths(spark, sf_dir):
    """P8."""
    planned = corpus.with_output_path(corpus.classify(inputs.files(spark, sf_dir)))
    return planned.select("rel_path", "file_type", "output_path")


@query(
    "output_collisions",
    _PLANNED + "SELECT output_path, count(*) AS sources, min(rel_path) AS first_source, max(rel_path) AS last_source FROM planned GROUP BY 1 HAVING count(*) > 1",
)
def output_collisions(spark, sf_dir):
    """A14."""
    return corpus.output_collisions(corpus.with_output_path(corpus.classify(inputs.files(spark, sf_dir))))


@query(
    "discovery_report",
    _CLASSIFIED + """
    SELECT 'type:' || file_type AS entry, count(*) AS n FROM classified WHERE file_type <> 'skip' GROUP BY 1
    UNION ALL SELECT CASE WHEN file_type = 'skip' THEN 'skipped' ELSE 'targets' END, count(*) FROM classified GROUP BY 1
    UNION ALL (SELECT 'target:' || file_type || ':' || rel_path, NULL FROM classified WHERE file_type <> 'skip' ORDER BY rel_path LIMIT 200)
    UNION ALL SELECT 'more', count(*) - 200 FROM classified WHERE file_type <> 'skip' HAVING count(*) > 200
    """,
)
def discovery_report(spark, sf_dir):
    """A1, O2: counts per type, the first targets in order and how many more there are."""
    # contents are read once; the counts and the listing read the stored inventory
    inventory = corpus.classify(inputs.files(spark, sf_dir)).select("rel_path", "file_type")
    classified = stored(inventory, "inventory")
    counted = runstate.discovery_counts(classified)
    shown = F.concat_ws(":", F.lit("target"), "file_type", "rel_path")
    first = runstate.first_targets(classified).select(
        F.when(F.col("more").isNull(), shown).otherwise("more").alias("entry"), F.col("more").alias("n"))
    return counted.unionByName(first)


@query(
    "review_flags",
    _REWRITTEN.rstrip() + f", reviewed AS ({REVIEWED})" + """
    SELECT rel_path, needs_review, concat_ws(' | ',
      CASE WHEN file_type = 'hql' THEN {notes} END,
      CASE WHEN file_type = 'dag_xml' AND NOT ends_with(content, '</Description></Event>') THEN 'XML parse warning' WHEN file_type = 'dag_xml' THEN
         'Event: ' || coalesce(nullif(regexp_extract(content, '<EventId>([^<]*)</EventId>', 1), ''), regexp_replace(regexp_extract(rel_path, '[^/]+$'), '\\.[^.]+$', '')) END,
      CASE WHEN file_type = 'filters' THEN 'Defines 3 injectable filters: filter_no_tests, filter_min_value, filter_' || CAST(g AS VARCHAR) END,
      CASE WHEN file_type = 'hdl' AND NOT regexp_matches(content, 'USE\\s+\\$\\{\\w+\\};?') THEN 'No USE statement found — dataset must be set manually' END,
      CASE WHEN file_type IN ('hql', 'hdl', 'shell', 'config') AND contains(converted, 'TODO:') THEN 'Contains TODO items requiring manual review' END,
      CASE WHEN file_type = 'hql' AND contains(converted, '${hivevar:') THEN 'Unresolved hivevar filter references remain' END,
      CASE WHEN file_type = 'pyspark' AND needs_review THEN 'Contains TODO items or residual PySpark references — review required' END,
      CASE WHEN file_type = 'test' THEN 'Tests converted from PySpark to pure Python — validate filter logic matches original HQL' END,
      CASE WHEN file_type = 'test' AND needs_review THEN 'Contains TODO items requiring manual review' END,
      CASE WHEN file_type = 'dag_xml' THEN 'Update bash_command paths to point to GCP-compatible scripts' END,
      CASE WHEN file_type = 'filters' THEN 'Filters baked into converted SQL WHERE clause — see this file for reference' END) AS notes
    FROM reviewed
    """.replace("\\\\", "\\").replace("{notes}", _NOTES_SQL),
)
def review_flags(spark, sf_dir):
    """P4."""
    rewritten = rewritten_files(spark, sf_dir)
    flagged = corpus.review_flags(rewritten, converted="converted", source_notes=F.col("source_notes"))
    return flagged.select("rel_path", "needs_review", F.array_join("notes", " | ").alias("notes"))


# --- search, lines, edits ---------------------------------------------------------------


@query(
    "glob_list",
    _FILES + """
    (SELECT 'file' AS kind, rel_path AS entry FROM files WHERE regexp_matches(rel_path, '^([^/]+/)*hql/[^/]*$') ORDER BY rel_path LIMIT 400)
    UNION ALL SELECT 'more', '... [' || CAST(count(*) - 400 AS VARCHAR) || ' more — narrow the pattern]' FROM files
      WHERE regexp_matches(rel_path, '^([^/]+/)*hql/[^/]*$') HAVING count(*) > 400
    """,
)
def glob_list(spark, sf_dir):
    """S2, O1, O2."""
    return corpus.glob_list(inputs.files(spark, sf_dir), "**/hql/*")


_LINES_SQL = """
lined AS (SELECT rel_path, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no, len(ls) AS n FROM (
  SELECT rel_path, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS ls FROM (
    SELECT rel_path, string_split_regex(content, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]') AS parts FROM files)))
""".replace("\\\\", "\\")


@query(
    "grep_lines",
    _FILES.rstrip() + "," + _LINES_SQL + r"""
    , hits AS (SELECT rel_path, line_no, substr(regexp_replace(line, '^\s+|\s+$', '', 'g'), 1, 200) AS hit FROM lined
    WHERE regexp_matches(line, 'License|TODO:') AND regexp_matches(rel_path, '^([^/]+/)*[^/]*$') ORDER BY rel_path, line_no LIMIT 200)
    SELECT * FROM hits UNION ALL SELECT NULL, NULL, '... [result limit reached — narrow the search]' FROM hits HAVING count(*) >= 200
    """,
)
def grep_lines(spark, sf_dir):
    """The first hits in path order, and a row that says when they are cut."""
    return corpus.grep(inputs.files(spark, sf_dir), "License|TODO:")


@query(
    "search_lines",
    _FILES.rstrip() + "," + _LINES_SQL + r"""
    SELECT rel_path, line_no, substr(regexp_replace(line, '^\s+|\s+$', '', 'g'), 1, 200) AS hit FROM lined
    WHERE regexp_matches(line, 'License|TODO:|hivevar') AND regexp_matches(rel_path, '^([^/]+/)*conf/[^/]*$|\.(hql|sh|py)$')
      AND regexp_matches(rel_path, '^([^/]+/)*[^/]*$')
    """,
)
def search_lines(spark, sf_dir):
    """Every hit, uncut."""
    files = inputs.files(spark, sf_dir).where(F.col("rel_path").rlike(r"^([^/]+/)*conf/[^/]*$|\.(hql|sh|py)$"))
    return corpus.search_lines(files, "License|TODO:|hivevar")


@query(
    "line_window",
    _FILES.rstrip() + "," + _LINES_SQL + "SELECT rel_path, line_no, line, greatest(n - 13, 0) AS more FROM lined WHERE line_no BETWEEN 4 AND 13",
)
def line_window(spark, sf_dir):
    """P10: ten lines from offset 3 of every file."""
    return corpus.line_window(inputs.files(spark, sf_dir), offset=3, limit=10)


@query(
    "bulk_replace",
    _FILES + """
    , counted AS (SELECT *, len(string_split(content, old)) - 1 AS n
        FROM (SELECT doc_id, rel_path, content, CASE doc_id % 4 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'no such text' ELSE ' the ' END AS old, doc_id % 4 = 2 AS every FROM files)),
    judged AS (SELECT *, CASE WHEN n = 0 THEN 'not found' WHEN n > 1 AND NOT every THEN 'not unique' ELSE 'edited' END AS st FROM counted),
    once AS (SELECT *, CASE WHEN st = 'edited' THEN replace(content, old, 'NEW') ELSE content END AS c, CASE WHEN st = 'edited' THEN n ELSE 0 END AS r FROM judged),
    twice AS (SELECT *, CASE WHEN every THEN len(string_split(c, 'NEW')) - 1 END AS n2 FROM once)
    SELECT rel_path, md5(CASE WHEN n2 > 0 THEN replace(c, 'NEW', 'OLD') ELSE c END) AS digest, r + coalesce(n2, 0) AS replaced,
      CASE WHEN st <> 'edited' THEN st WHEN n2 = 0 THEN 'not found' ELSE 'edited' END AS status FROM twice
    UNION ALL SELECT 'gone/' || CAST(doc_id AS VARCHAR), NULL, 0, 'file not found' FROM files WHERE doc_id % 10 = 7
    """,
)
def bulk_replace(spark, sf_dir):
    """Exact edits in bulk, some files twice, some unknown, with the uniqueness rule."""
    all_files = inputs.derived(spark, sf_dir, inputs.FILES)
    pick = F.col("doc_id") % 4
    first = all_files.select(
        "rel_path", F.lit(1).alias("edit_no"), F.when(pick == 0, "SELECT").when(pick == 1, "no such text").otherwise(" the ").alias("old"),
        F.lit("NEW").alias("new"), (pick == 2).alias("replace_all"),
    )
    second = all_files.where(pick == 2).select(
        "rel_path", F.lit(2).alias("edit_no"), F.lit("NEW").alias("old"), F.lit("OLD").alias("new"), F.lit(True).alias("replace_all"))
    unknown = all_files.where("doc_id % 10 = 7").select(
        F.concat(F.lit("gone/"), F.col("doc_id").cast("string")).alias("rel_path"), F.lit(1).alias("edit_no"), F.lit("a").alias("old"),
        F.lit("b").alias("new"), F.lit(False).alias("replace_all"))
    edits = first.unionByName(second).unionByName(unknown)
    done = corpus.bulk_replace(all_files.select("rel_path", "content"), edits)
    return done.select("rel_path", F.md5(F.encode("content", "UTF-8")).alias("digest"), "replaced", "status")


@query(
    "text_truncate",
    _FILES + """
    SELECT rel_path, md5(CASE WHEN length(content) > 1500 THEN substr(content, 1, 1500) || chr(10) || '... [truncated ' || CAST(length(content) - 1500 AS VARCHAR) || ' chars]' ELSE content END) AS preview,
      CASE WHEN length(content) > 60 THEN substr(replace(content, chr(10), ' '), 1, 57) || '...' ELSE replace(content, chr(10), ' ') END AS label
    FROM files
    """,
)
def text_truncate(spark, sf_dir):
    """P9."""
    f = inputs.files(spark, sf_dir)
    preview = text.truncate("content", fixed.PREVIEW_CHARS)
    return f.select("rel_path", F.md5(F.encode(preview, "UTF-8")).alias("preview"), text.label("content").alias("label"))


@query(
    "strip_settings",
    _FILES + r"""
    SELECT rel_path, md5(regexp_replace(regexp_replace(content, '(?im)^[ \t]*SET[ \t]+(mapreduce|hive|mapred)\.[^\n]*(\n|\z)', '', 'g'), 'USE\s+\$\{\w+\};?\s*\n?', '', 'g')) AS digest FROM files
    """,
)
def strip_settings(spark, sf_dir):
    """P16."""
    f = inputs.files(spark, sf_dir)
    return f.select("rel_path", F.md5(F.encode(corpus.strip_settings(), "UTF-8")).alias("digest"))


@query(
    "strip_fences",
    _FILES + r"""
    SELECT rel_path, md5(CASE WHEN regexp_matches(content, '\A\s*```(python|sql|bash|sh|yaml|xml|json|hql)?\s*\n((?s:.*?))\n```\s*\z')
      THEN regexp_extract(content, '\A\s*```(python|sql|bash|sh|yaml|xml|json|hql)?\s*\n((?s:.*?))\n```\s*\z', 2) ELSE content END) AS digest FROM files
    """,
)
def strip_fences(spark, sf_dir):
    """P17."""
    f = inputs.files(spark, sf_dir)
    return f.select("rel_path", F.md5(F.encode(text.strip_fence("content"), "UTF-8")).alias("digest"))


@query(
    "header_stamp",
    _CLASSIFIED + """
    SELECT rel_path, file_type, md5(CASE WHEN file_type IN ('hql', 'hdl') THEN '--' ELSE '#' END || ' Converted from: ' || regexp_extract(rel_path, '[^/]+$') || chr(10) || content) AS digest
    FROM classified WHERE file_type <> 'skip'
    """,
)
def header_stamp(spark, sf_dir):
    """F36."""
    classified = corpus.targets(corpus.classify(inputs.files(spark, sf_dir)))
    return classified.select("rel_path", "file_type", F.md5(F.encode(corpus.header_stamp(), "UTF-8")).alias("digest"))


@query(
    "ddl_detect",
    _CLASSIFIED + r"""
    SELECT rel_path, regexp_matches(content, '(?i)\A(\s*--[^\n]*(\n|\z))*\s*(CREATE TABLE|CREATE OR REPLACE TABLE|CREATE SCHEMA|CREATE OR REPLACE SCHEMA|DROP TABLE)') AS ddl
    FROM (SELECT rel_path, CASE WHEN file_type = 'hdl' THEN regexp_replace(content, 'USE\s+\$\{\w+\};?\s*\n?', '') ELSE content END AS content FROM classified)
    """,
)
def ddl_detect(spark, sf_dir):
    """Comment lines in front of the statement are skipped."""
    classified = corpus.classify(inputs.files(spark, sf_dir))
    no_use = F.regexp_replace("content", r"USE\s+\$\{\w+\};?\s*\n?", "")
    ready = classified.withColumn("content", F.when(F.col("file_type") == "hdl", no_use).otherwise(F.col("content")))
    return ready.select("rel_path", corpus.looks_like_ddl().alias("ddl"))


@query(
    "sql_selection",
    _PLANNED + r"""
    SELECT 'sql' AS selected, rel_path FROM planned WHERE regexp_matches(output_path, '\.sql$') AND NOT regexp_matches(output_path, '(^|/)dags(/|$)')
    UNION ALL SELECT 'ddl', rel_path FROM planned WHERE file_type = 'hdl'
    UNION ALL SELECT 'ddl by text', rel_path FROM planned WHERE file_type = 'hql' AND
      regexp_matches(content, '(?i)\A(\s*--[^\n]*(\n|\z))*\s*(CREATE TABLE|CREATE OR REPLACE TABLE|CREATE SCHEMA|CREATE OR REPLACE SCHEMA|DROP TABLE)')
    """,
)
def sql_selection(spark, sf_dir):
    """SQL files, DDL by recorded type, and by text when the state names none."""
    converted = corpus.with_output_path(corpus.classify(inputs.files(spark, sf_dir)))
    planned = stored(converted.select("rel_path", "file_type", "output_path", corpus.looks_like_ddl().alias("is_ddl")), "planned")

    def rows(df, name):
        return df.select(F.lit(name).alias("selected"), "rel_path")

    unnamed = planned.where("file_type <> 'hdl'")
    return (
        rows(corpus.sql_outputs(planned), "sql")
        .unionByName(rows(corpus.ddl_files(planned, F.col("is_ddl")), "ddl"))
        .unionByName(rows(corpus.ddl_files(unnamed, F.col("is_ddl")), "ddl by text"))
    )


@query(
    "requested_sql",
    _PLANNED + r"""
    , asked AS (SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN output_path WHEN 1 THEN regexp_replace(output_path, '\.sql$', '') ELSE concat('gone/', output_path) END AS name FROM planned WHERE ends_with(output_path, '.sql')),
    named AS (SELECT DISTINCT CASE WHEN ends_with(name, '.sql') THEN name ELSE name || '.sql' END AS output_path FROM asked)
    SELECT output_path, CASE WHEN output_path IN (SELECT output_path FROM planned) THEN 'ok' ELSE 'not found' END AS status FROM named
    """,
)
def requested_sql(spark, sf_dir):
    """Requested outputs, with or without their suffix; unknown ones stay as rows."""
    all_files = inputs.derived(spark, sf_dir, inputs.FILES)
    planned = corpus.with_output_path(corpus.classify(all_files)).select("doc_id", "output_path")
    pick = F.col("doc_id") % 3
    asked = planned.where(F.col("output_path").endswith(".sql")).select(
        F.when(pick == 0, F.col("output_path")).when(pick == 1, F.regexp_replace("output_path", r"\.sql$", ""))
        .otherwise(F.concat(F.lit("gone/"), "output_path")).alias("output_path"))
    return corpus.requested_sql(planned.select("output_path"), asked)


# --- mappings -------------------------------------------------------------------------------


@query(
    "dataset_lookup",
    """
    SELECT doc_id, source, coalesce('ds_' || lower(s_name), source) AS dataset
    FROM documents LEFT JOIN supplier ON source = 'src' || CAST(s_suppkey AS VARCHAR) AND s_acctbal > 5000
    """,
)
def dataset_lookup(spark, sf_dir):
    """Mapped name, or the name itself."""
    s = read_table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    datasets = s.select(
        F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("hive_name"),
        F.concat(F.lit("ds_"), F.lower("s_name")).alias("dataset"),
    )
    return mapping.dataset_lookup(read_table(spark, sf_dir, "documents").select("doc_id", "source"), "source", datasets)


_PREFIXES = r"""
prefixes AS (
  SELECT DISTINCT regexp_extract(url, '^https?://[^/]+', 0) AS prefix, 'gs://site/' || regexp_extract(url, '^https?://([^/]+)', 1) AS target FROM pages
  UNION SELECT DISTINCT regexp_extract(url, '^https?://[^/]+/en', 0), 'gs://english/' || regexp_extract(url, '^https?://([^/]+)/en', 1) FROM pages WHERE regexp_matches(url, '^https://[^/]+/en')
  UNION SELECT 'http://m', 'gs://mobile')
"""


@query(
    "longest_prefix_map",
    "WITH" + _PREFIXES + """, keyed AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN '/local' || url ELSE url END AS url FROM pages),
    best AS (SELECT page_id, arg_max(prefix, length(prefix)) AS prefix, arg_max(target, length(prefix)) AS target
      FROM keyed JOIN (SELECT prefix, max(target) AS target FROM prefixes GROUP BY prefix) x ON starts_with(url, prefix) GROUP BY page_id)
    SELECT page_id, url, prefix, coalesce(target || substr(url, length(prefix) + 1), 'gs://my-bucket' || url) AS mapped
    FROM keyed LEFT JOIN best USING (page_id)
    """,
)
def longest_prefix_map(spark, sf_dir):
    """Longest prefix from a table of prefixes, by equality at each prefix length."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    host = r"^https?://[^/]+"
    by_host = pages.select(
        F.regexp_extract("url", host, 0).alias("prefix"),
        F.concat(F.lit("gs://site/"), F.regexp_extract("url", r"^https?://([^/]+)", 1)).alias("target"),
    )
    english = pages.where(F.col("url").rlike(r"^https://[^/]+/en")).select(
        F.regexp_extract("url", host + "/en", 0).alias("prefix"),
        F.concat(F.lit("gs://english/"), F.regexp_extract("url", r"^https?://([^/]+)/en", 1)).alias("target"),
    )
    mobile = readers.literal_rows(spark, [("http://m", "gs://mobile")], "prefix string, target string")
    prefixes = by_host.unionByName(english).unionByName(mobile).distinct()
    keyed = pages.withColumn("url", F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("/local"), "url")).otherwise(F.col("url")))
    return mapping.longest_prefix_join(keyed, "page_id", "url", prefixes)


@query(
    "path_map_inline",
    """
    SELECT page_id, CASE WHEN starts_with(url, 'https://www.') THEN 'gs://www/' || substr(url, 13) WHEN starts_with(url, 'https://') THEN 'gs://https/' || substr(url, 9)
      ELSE 'gs://my-bucket' || url END AS mapped FROM pages
    """,
)
def path_map_inline(spark, sf_dir):
    """J2 with a small map: a chain of tests, no join."""
    rules = {"https://": "gs://https/", "https://www.": "gs://www/"}
    return read_table(spark, sf_dir, "pages").select("page_id", mapping.map_path("url", rules).alias("mapped"))


@query(
    "path_map_many",
    r"""
    SELECT page_id, CASE url WHEN '/xen' THEN 'gs://english' WHEN '/xfr' THEN 'gs://french' ELSE 'gs://my-bucket' || url END AS mapped
    FROM (SELECT page_id, regexp_replace(url, '^https?://[^/]*/([a-z]+)/.*$', '/x\1') AS url FROM pages)
    """,
)
def path_map_many(spark, sf_dir):
    """J2 with 1,200 rules given in the program."""
    rules = {f"/y{k:04d}": f"gs://other/{k}" for k in range(1200)} | {"/xen": "gs://english", "/xfr": "gs://french"}
    url = F.regexp_replace("url", "^https?://[^/]*/([a-z]+)/.*$", "/x$1")
    return read_table(spark, sf_dir, "pages").select("page_id", mapping.map_path(url, rules).alias("mapped"))


@query(
    "qualify_refs",
    _FILES + f"SELECT rel_path, md5({_sql(_REFS_SQL, 'content')}) AS digest, coalesce({_NOTES_SQL}, '') AS notes FROM files",
)
def qualify_refs(spark, sf_dir):
    """rewritten text and one note per rewritten reference."""
    f = inputs.files(spark, sf_dir)
    return f.select(
        "rel_path",
        F.md5(F.encode(mapping.qualify_refs("content", DATASET_MAP), "UTF-8")).alias("digest"),
        F.array_join(mapping.qualify_notes("content", DATASET_MAP), " | ").alias("notes"),
    )


@query(
    "rewrite_paths",
    _FILES + f"SELECT rel_path, md5({_sql(_QUOTED_SQL, 'content')}) AS quoted, md5({_sql(_BARE_SQL, 'content')}) AS bare FROM files",
)
def rewrite_paths(spark, sf_dir):
    """storage paths in quotes and as bare words."""
    f = inputs.files(spark, sf_dir)
    return f.select(
        "rel_path",
        F.md5(F.encode(mapping.rewrite_quoted_paths("content", PATH_MAP), "UTF-8")).alias("quoted"),
        F.md5(F.encode(mapping.rewrite_bare_paths("content", PATH_MAP), "UTF-8")).alias("bare"),
    )


@query(
    "rewrite_by_table",
    _FILES + f"SELECT rel_path, md5({_sql(_QUOTED_SQL, _sql(_REFS_SQL, 'content'))}) AS digest FROM files",
)
def rewrite_by_table(spark, sf_dir):
    """F23, F24 with mappings as tables, whatever their size."""
    datasets = readers.literal_rows(spark, list(DATASET_MAP.items()), "hive_name string, dataset string")
    prefixes = readers.literal_rows(spark, list(PATH_MAP.items()), "prefix string, target string")
    qualified = mapping.qualify_refs_by_table(inputs.files(spark, sf_dir), datasets)
    moved = mapping.rewrite_quoted_paths_by_table(qualified, prefixes)
    return moved.select("rel_path", F.md5(F.encode("content", "UTF-8")).alias("digest"))


@query(
    "rename_dbs",
    _FILES + rf"""
    SELECT rel_path, md5(regexp_replace(regexp_replace(content, '=(ops_db|lakedb)\b', '=raw_zone', 'g'), '=refs_db\b', '=dims', 'g')) AS assigned,
      md5({_sql(_NAMES_SQL, 'content')}) AS quoted FROM files
    """,
)
def rename_dbs(spark, sf_dir):
    """database names after = and in quotes."""
    f = inputs.files(spark, sf_dir)
    return f.select(
        "rel_path",
        F.md5(F.encode(mapping.rename_assigned("content", DATASET_MAP), "UTF-8")).alias("assigned"),
        F.md5(F.encode(mapping.rename_quoted("content", DATASET_MAP), "UTF-8")).alias("quoted"),
    )


@query(
    "ddl_targets",
    _CLASSIFIED + r"""
    SELECT rel_path, nullif(db, '') AS db, tbl AS table_name, '`my-project.' || CASE db WHEN '' THEN 'UNKNOWN_DATASET' WHEN 'ops_db' THEN 'raw_zone' ELSE db END || '.' || tbl || '`' AS ref
    FROM (SELECT rel_path, regexp_extract(content, 'USE\s+\$\{(\w+)\};?', 1) AS db,
      coalesce(nullif(regexp_extract(content, '(?i)CREATE\s+(?:EXTERNAL\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)', 1), ''), regexp_replace(regexp_extract(rel_path, '[^/]+$'), '\.[^.]+$', '')) AS tbl
      FROM classified WHERE file_type IN ('hdl', 'hql'))
    """,
)
def ddl_targets(spark, sf_dir):
    """F26."""
    sql = corpus.classify(inputs.files(spark, sf_dir)).where("file_type IN ('hdl', 'hql')")
    t = sql.select("rel_path", mapping.ddl_target("content", "rel_path", DATASET_MAP).alias("t"))
    return t.select("rel_path", "t.db", F.col("t.table").alias("table_name"), "t.ref")


@query(
    "residual_vars",
    _FILES + r"SELECT rel_path, md5(regexp_replace(content, '\$\{(\w+)\}', '@\1', 'g')) AS digest FROM files",
)
def residual_vars(spark, sf_dir):
    """F30."""
    f = inputs.files(spark, sf_dir)
    return f.select("rel_path", F.md5(F.encode(mapping.residual_variables("content"), "UTF-8")).alias("digest"))


@query(
    "env_names",
    """
    SELECT upper(hive_name) || '_DATASET' AS env_name, min(hive_name) AS hive_name, arg_min(dataset, hive_name) AS dataset FROM (
      SELECT source || '_' || lang AS hive_name, min('ds_' || lang) AS dataset FROM documents GROUP BY 1
      UNION ALL SELECT upper(source) || '_' || lang, min('up_' || lang) FROM documents GROUP BY 1) GROUP BY 1
    """,
)
def env_names(spark, sf_dir):
    """one environment variable per database name, spellings merged."""
    d = read_table(spark, sf_dir, "documents")

    def named(name, mark):
        return d.groupBy(F.concat(name, F.lit("_"), "lang").alias("hive_name")).agg(F.min(F.concat(F.lit(mark), "lang")).alias("dataset"))

    return mapping.env_names(named(F.col("source"), "ds_").unionByName(named(F.upper("source"), "up_")))


# --- extraction ---------------------------------------------------------------------------------

_FILTERS_SQL = r"""
found AS (SELECT rel_path, regexp_extract_all(content, '(?s)set\s+hivevar:(\w+)\s*=\s*(.+?);', 1) AS names,
  regexp_extract_all(content, '(?s)set\s+hivevar:(\w+)\s*=\s*(.+?);', 2) AS bodies FROM classified WHERE file_type = 'filters')
"""


@query(
    "filter_extract",
    _CLASSIFIED.rstrip() + "," + _FILTERS_SQL + r"""
    SELECT rel_path, unnest(range(1, len(names) + 1)) AS position, unnest(names) AS name,
      unnest(list_transform(bodies, lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g'))) AS predicate FROM found
    """,
)
def filter_extract(spark, sf_dir):
    """F27."""
    return extract.filter_rows(corpus.classify(inputs.files(spark, sf_dir)).where("file_type = 'filters'"))


@query(
    "filter_notes",
    _CLASSIFIED.rstrip() + "," + _FILTERS_SQL + """
    SELECT rel_path, 'Defines ' || CAST(len(names) AS VARCHAR) || ' injectable filters: ' || array_to_string(names, ', ') AS note FROM found
    """,
)
def filter_notes(spark, sf_dir):
    """A13."""
    found = corpus.classify(inputs.files(spark, sf_dir)).where("file_type = 'filters'")
    return found.select("rel_path", extract.filter_note().alias("note"))


@query(
    "sql_params",
    _FILES + r"""
    SELECT rel_path, name, CASE name WHEN 'min_value' THEN 'NUMERIC' WHEN 'run_dt' THEN 'DATE' ELSE 'STRING' END AS type
    FROM (SELECT DISTINCT rel_path, unnest(regexp_extract_all(content, '(?:^|[^@])@(\w+)', 1)) AS name FROM files)
    """,
)
def sql_params(spark, sf_dir):
    """F28, U4."""
    return extract.parameters(inputs.files(spark, sf_dir), {"min_value": "NUMERIC", "run_dt": "DATE"})


_ERRORS = """
SELECT doc_id, rel_path, content, concat('Query parameter ', chr(39), '@', CASE doc_id % 3 WHEN 0 THEN 'run_dt' WHEN 1 THEN 'min_value' ELSE 'other' END, chr(39),
  ' has type DATE which cannot be coerced to expected type ', CASE doc_id % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'DATE' WHEN 2 THEN 'NUMERIC' WHEN 3 THEN 'MONEY' ELSE 'TIMESTAMP' END,
  ' at [10:15]') AS error FROM ({files}) x
"""


@query(
    "param_type_hints",
    _FILES + """, errors AS (""" + _ERRORS.replace("({files}) x", "files") + r"""),
    hints AS (SELECT rel_path, regexp_extract(error, '@(\w+)', 1) AS name, upper(regexp_extract(error, 'expected type (\w+)', 1)) AS expected FROM errors),
    params AS (SELECT rel_path, name, CASE name WHEN 'min_value' THEN 'NUMERIC' WHEN 'run_dt' THEN 'DATE' ELSE 'STRING' END AS type
      FROM (SELECT DISTINCT rel_path, unnest(regexp_extract_all(content, '(?:^|[^@])@(\w+)', 1)) AS name FROM files))
    SELECT rel_path, name, expected, type FROM hints JOIN params USING (rel_path, name) WHERE expected IN ('STRING', 'DATE', 'NUMERIC', 'TIMESTAMP') AND expected <> type
    """,
)
def param_type_hints(spark, sf_dir):
    """types that error texts ask for."""
    errors = inputs.derived(spark, sf_dir, _ERRORS.replace("{files}", inputs.FILES))
    current = extract.parameters(errors.select("rel_path", "content"), {"min_value": "NUMERIC", "run_dt": "DATE"})
    return extract.type_hints(errors.select("rel_path", "error"), current)


_EVENTS_SQL = r"""
ev AS (SELECT rel_path, ends_with(content, '</Description></Event>') AS good, content,
  regexp_replace(regexp_extract(rel_path, '[^/]+$'), '\.[^.]+$', '') AS stem FROM classified WHERE file_type = 'dag_xml'),
found AS (SELECT rel_path, good, content, CASE WHEN good THEN coalesce(nullif(regexp_extract(content, '<EventId>([^<]*)</EventId>', 1), ''), stem) ELSE stem END AS event_id,
  CASE WHEN good THEN regexp_extract_all(content, '<Dependency>([^<]*)</Dependency>', 1) ELSE [] END AS deps,
  CASE WHEN good THEN regexp_extract(content, '<PublishEvent>([^<]*)<', 1) END AS publish FROM ev),
waited AS (SELECT DISTINCT unnest(deps) AS upstream, event_id AS downstream FROM found),
published AS (SELECT DISTINCT event_id AS upstream, publish AS downstream FROM found WHERE publish IS NOT NULL)
"""


def scheduler_events(spark, sf_dir):
    return extract.events(corpus.classify(inputs.files(spark, sf_dir)).where("file_type = 'dag_xml'"))


def scheduler_graph(spark, sf_dir):
    """Ids and edges only, stored: every side of the graph joins reads them."""
    return stored(scheduler_events(spark, sf_dir).select("event_id", "dependencies", "publish_event"), "events")


@query(
    "dag_extract",
    _CLASSIFIED.rstrip() + "," + _EVENTS_SQL + r"""
    SELECT rel_path, event_id, lower(event_id) AS dag_id, CASE WHEN good THEN '0 5 * * *' END AS schedule, CASE WHEN good THEN 'America/New_York' END AS time_zone,
      CASE WHEN good THEN regexp_extract(content, '<Command>([^<]*)<', 1) END AS command, CASE WHEN good THEN 90::BIGINT END AS timeout_minutes,
      CASE WHEN good THEN regexp_extract(content, '<RunAsUser>([^<]*)<', 1) END AS run_as_user, array_to_string(deps, ',') AS dependencies,
      CASE WHEN good THEN 2::BIGINT END AS retry_count, CASE WHEN good THEN 15::BIGINT END AS retry_delay_minutes, CASE WHEN good THEN regexp_extract(content, '<Email>([^<]*)<', 1) END AS email,
      publish AS publish_event, CASE WHEN good THEN 'Event: ' || event_id ELSE 'XML parse warning' END AS note,
      CASE WHEN good THEN md5(regexp_replace(replace(replace(replace(regexp_extract(content, '<Description>((?s:.*))</Description>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s', '', 'g')) END AS description
    FROM found
    """,
)
def dag_extract(spark, sf_dir):
    """Fields of scheduler files, malformed ones kept with a note; descriptions compared without blanks."""
    squeezed = F.md5(F.encode(F.regexp_replace("description", r"\s", ""), "UTF-8"))
    return scheduler_events(spark, sf_dir).withColumn("description", squeezed).withColumn("dependencies", F.array_join("dependencies", ","))


@query(
    "dag_missing_upstream",
    _CLASSIFIED.rstrip() + "," + _EVENTS_SQL + """
    SELECT downstream, upstream, 'missing' AS status FROM waited WHERE upstream NOT IN (SELECT event_id FROM found)
    UNION ALL SELECT downstream, upstream, 'known' FROM waited WHERE upstream IN (SELECT event_id FROM found)
    """,
)
def dag_missing_upstream(spark, sf_dir):
    """Dependencies with and without an existing event."""
    found = scheduler_graph(spark, sf_dir)
    missing = extract.missing_upstream(found).withColumn("status", F.lit("missing"))
    return missing.unionByName(extract.known_upstream(found).withColumn("status", F.lit("known")))


@query(
    "dag_edge_reconcile",
    _CLASSIFIED.rstrip() + "," + _EVENTS_SQL + """
    SELECT coalesce(p.upstream, w.upstream) AS upstream, coalesce(p.downstream, w.downstream) AS downstream,
      CASE WHEN p.upstream IS NOT NULL AND w.upstream IS NOT NULL THEN 'both' WHEN p.upstream IS NOT NULL THEN 'publish_only' ELSE 'depend_only' END AS status
    FROM published p FULL JOIN waited w ON p.upstream = w.upstream AND p.downstream = w.downstream
    """,
)
def dag_edge_reconcile(spark, sf_dir):
    """J7."""
    return extract.reconcile_edges(scheduler_graph(spark, sf_dir))


@query(
    "function_usage",
    _FILES + r"""
    SELECT rel_path, fn AS function, count(*) AS uses FROM (SELECT rel_path, unnest(list_transform(regexp_extract_all(content, '(\w+)\s*\(', 1), lambda c: lower(c))) AS fn FROM files)
    WHERE fn IN ('from_unixtime','unix_timestamp','date_format','date_add','datediff','nvl','nvl2','concat_ws','regexp_extract','split','size','collect_set','collect_list','get_json_object','to_date','year','month','day','cast')
    GROUP BY ALL
    """,
)
def function_usage(spark, sf_dir):
    """J10."""
    return extract.function_usage(inputs.files(spark, sf_dir))


@query(
    "config_rename",
    _CLASSIFIED.rstrip() + "," + _LINES_SQL.replace("FROM files)", "FROM classified WHERE file_type = 'config')") + r"""
    SELECT rel_path, line_no, k AS old_key, CASE WHEN k = 'mapred_qname' THEN 'removed' WHEN k IN ('HIVE_RUNNER', 'HiveDBPath', 'HqlDir', 'HdlDir', 'ops_db', 'lakedb', 'refs_db') THEN 'renamed' ELSE 'kept' END AS action,
      CASE k WHEN 'mapred_qname' THEN '# REMOVED: mapred_qname (YARN queue — not needed in BQ)' WHEN 'HIVE_RUNNER' THEN 'BQ_RUNNER=bq' WHEN 'HiveDBPath' THEN 'BQ_DATASET_PATH=' || v
        WHEN 'HqlDir' THEN 'SqlDir=' || v WHEN 'HdlDir' THEN 'SchemaDir=' || v WHEN 'ops_db' THEN 'OPS_DB_DATASET=raw_zone' ELSE k || '=' || v END AS new_line
    FROM (SELECT rel_path, line_no, regexp_extract(line, '^(\w+)=(.*)$', 1) AS k, regexp_extract(line, '^(\w+)=(.*)$', 2) AS v FROM lined WHERE regexp_matches(line, '^(\w+)=(.*)$'))
    """,
)
def config_rename(spark, sf_dir):
    """F33."""
    configs = corpus.classify(inputs.files(spark, sf_dir)).where("file_type = 'config'")
    return extract.config_entries(configs, DATASET_MAP)


def rewritten_files(spark, sf_dir):
    planned = corpus.with_output_path(corpus.classify(inputs.files(spark, sf_dir)))
    return mapping.rewrite(planned, DATASET_MAP, PATH_MAP)


# --- Python syntax ------------------------------------------------------------------------------


@query(
    "py_syntax_check",
    _FILES + """
    SELECT rel_path, 'python' AS language, CASE WHEN kind = 10 OR (kind = 11 AND g % 4 = 1) THEN 'broken' ELSE 'parses' END AS verdict
    FROM files WHERE kind IN (8, 9, 10, 11)
    """,
)
def py_syntax_check(spark, sf_dir):
    """Parse-only check of every Python file."""
    checked = extract.python_syntax(corpus.visible(inputs.files(spark, sf_dir)))
    return checked.select("rel_path", "language", F.when(F.col("error").isNull(), "parses").otherwise("broken").alias("verdict"))


@query(
    "syntax_tally",
    _FILES + """
    SELECT 'python' AS language, count(*) AS checked, count(*) FILTER (kind = 10 OR (kind = 11 AND g % 4 = 1)) AS failed FROM files WHERE kind IN (8, 9, 10, 11)
    """,
)
def syntax_tally(spark, sf_dir):
    """A5."""
    return extract.syntax_tally(extract.python_syntax(corpus.visible(inputs.files(spark, sf_dir))))
