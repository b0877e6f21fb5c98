"""Queries over test logs derived from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomshift.functions import text
from loomshift.operators import testlog
from loomshift.plans import inputs
from loomshift.plans.inputs import with_ctes
from loomshift.plans.registry import query

# One run per source; each document adds an opening line and its own lines,
# a fifth of them marked as errors where the opening is a block header.
OPENINGS = """
SELECT doc_id, source AS run_id, shape, CASE shape
    WHEN 0 THEN concat('____ ERROR collecting tests/test_', CAST(g AS STRING), '.py ____')
    WHEN 1 THEN concat('FAILED tests/test_', CAST(doc_id AS STRING), '.py::TestX::test_y - AssertionError: ', lang, ' ', CAST(n_chars AS STRING))
    WHEN 2 THEN concat('ERROR tests/test_', CAST(g - 2 AS STRING), '.py')
    WHEN 3 THEN concat('=== ', CAST(n_chars % 50 AS STRING), ' failed, ', CAST(n_chars AS STRING), ' passed, 2 errors in 0.12s')
    WHEN 4 THEN concat('ERROR tests/lone_', CAST(doc_id AS STRING), '.py')
    ELSE '' END AS opening, text
FROM (SELECT *, CAST(floor(doc_id / 20) AS BIGINT) AS g,
       CASE WHEN source IN ('src3', 'src7') THEN 9 ELSE CAST(floor(doc_id / 20) AS BIGINT) % 7 END AS shape FROM documents) d
"""
# more lines than a text can have
SPAN = 2**31


def test_log(spark, sf_dir):
    """test_log(run_id, line_no, line)."""
    opened = inputs.derived(spark, sf_dir, OPENINGS)
    whole = F.concat(F.array("opening"), text.lines("text"))
    lines = opened.select("doc_id", "run_id", "shape", F.posexplode(whole).alias("pos", "line"))
    is_marked = (F.col("shape") == 0) & (F.col("pos") > 0) & ((F.col("pos") - 1) % 5 == 2)
    return lines.select(
        "run_id", (F.col("doc_id") * SPAN + F.col("pos")).alias("line_no"),
        F.when(is_marked, F.concat(F.lit("E   "), "line")).otherwise(F.col("line")).alias("line"),
    )


_LOG = with_ctes(opened=OPENINGS).rstrip() + r""",
bodies AS (SELECT doc_id, run_id, shape, opening, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS ls
  FROM (SELECT *, string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]') AS parts FROM opened)),
log AS MATERIALIZED (SELECT run_id, doc_id * 2147483648 + pos AS line_no, CASE WHEN shape = 0 AND pos > 0 AND (pos - 1) % 5 = 2 THEN 'E   ' || line ELSE line END AS line
  FROM (SELECT run_id, doc_id, shape, unnest([opening] || ls) AS line, unnest(range(0, len(ls) + 1)) AS pos FROM bodies)),
marks AS (SELECT run_id, line_no AS block, regexp_extract(line, '_+\s*ERROR collecting (\S+\.py)\s*_+', 1) AS file FROM log
  WHERE starts_with(line, '===') OR regexp_matches(line, '_+\s*ERROR collecting (\S+\.py)\s*_+')),
inside AS (SELECT l.run_id, l.line_no, l.line, m.block, m.file FROM log l ASOF JOIN marks m ON l.run_id = m.run_id AND l.line_no >= m.block WHERE m.file <> ''),
body AS (SELECT *, row_number() OVER (PARTITION BY run_id, block ORDER BY line_no) AS rn FROM inside WHERE line_no > block),
blocks AS MATERIALIZED (SELECT h.run_id, h.block, h.file, coalesce(
    (SELECT substr(string_agg(line, chr(10) ORDER BY line_no), 1, 500) FROM body b WHERE b.run_id = h.run_id AND b.block = h.block AND starts_with(line, 'E   ')),
    (SELECT substr(string_agg(line, chr(10) ORDER BY line_no), 1, 500) FROM body b WHERE b.run_id = h.run_id AND b.block = h.block AND rn <= 5 AND regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''),
    '(collection error)') AS excerpt FROM inside h WHERE h.line_no = h.block),
named AS (SELECT run_id, regexp_extract(line, '^(?:FAILED|ERROR)\s+(\S+\.py)(?:::\S+)?(?:\s*-\s*(.+))?$', 1) AS file,
   arg_min(regexp_replace(regexp_extract(line, '^(?:FAILED|ERROR)\s+(\S+\.py)(?:::\S+)?(?:\s*-\s*(.+))?$', 2), '^\s+|\s+$', '', 'g'), line_no) AS message
   FROM log WHERE regexp_matches(line, '^(?:FAILED|ERROR)\s+(\S+\.py)(?:::\S+)?(?:\s*-\s*(.+))?$') GROUP BY ALL),
filed AS (SELECT run_id, file, arg_max(excerpt, block) AS excerpt FROM blocks GROUP BY ALL),
known AS (SELECT coalesce(n.run_id, f.run_id) AS run_id, coalesce(n.file, f.file) AS file,
   CASE WHEN n.run_id IS NULL THEN f.excerpt ELSE coalesce(nullif(substr(n.message, 1, 500), ''), f.excerpt, '(no error message captured)') END AS excerpt
   FROM named n FULL JOIN filed f ON n.run_id = f.run_id AND n.file = f.file),
failures AS MATERIALIZED (SELECT * FROM known UNION ALL
  SELECT run_id, '(unknown)', string_agg(line, chr(10) ORDER BY line_no) FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) AS back FROM log
    WHERE run_id IN (SELECT run_id FROM log WHERE contains(lower(line), 'failed') OR contains(lower(line), 'error')) AND run_id NOT IN (SELECT run_id FROM known)) WHERE back <= 40 GROUP BY run_id),
matched AS (SELECT run_id, line_no, unnest(regexp_extract_all(line, '(\d+)\s+(passed|failed|errors?)', 1)) AS n, unnest(regexp_extract_all(line, '(\d+)\s+(passed|failed|errors?)', 2)) AS kind,
   unnest(range(0, len(regexp_extract_all(line, '(\d+)\s+(passed|failed|errors?)', 1)))) AS pos FROM log),
totals AS (SELECT r.run_id, coalesce(CAST(arg_max(n, line_no * 100 + pos) FILTER (kind = 'passed') AS BIGINT), 0) AS passed, coalesce(CAST(arg_max(n, line_no * 100 + pos) FILTER (kind = 'failed') AS BIGINT), 0) AS failed,
   coalesce(CAST(arg_max(n, line_no * 100 + pos) FILTER (starts_with(kind, 'error')) AS BIGINT), 0) AS errors FROM (SELECT DISTINCT run_id FROM log) r LEFT JOIN matched m ON r.run_id = m.run_id GROUP BY r.run_id)
"""


@query("testlog_summary", _LOG + "SELECT * FROM totals")
def testlog_summary(spark, sf_dir):
    """A15."""
    return testlog.counts(test_log(spark, sf_dir))


@query("testlog_blocks", _LOG + "SELECT * FROM blocks")
def testlog_blocks(spark, sf_dir):
    """W6."""
    return testlog.blocks(test_log(spark, sf_dir))


@query("testlog_failures", _LOG + "SELECT * FROM failures")
def testlog_failures(spark, sf_dir):
    """W7."""
    return testlog.failures(test_log(spark, sf_dir))


@query(
    "test_report",
    _LOG + r"""
    SELECT t.run_id, passed, failed, errors, file, CASE WHEN file IS NOT NULL THEN substr(regexp_extract(excerpt, '^[^\n]*'), 1, 200) END AS first_line
    FROM totals t LEFT JOIN failures f ON t.run_id = f.run_id
    """,
)
def test_report(spark, sf_dir):
    """A16."""
    return testlog.report(test_log(spark, sf_dir))
