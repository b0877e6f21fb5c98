"""Names, limits, patterns and texts that results must agree on."""

# File types, and per convertible type the output suffix and
# whether the output goes below dags/.
FILE_TYPES = ["hql", "hdl", "shell", "pyspark", "config", "filters", "dag_xml", "test", "skip"]
OUTPUTS = {
    "hql": (".sql", False),
    "hdl": (".sql", False),
    "shell": (".sh", False),
    "pyspark": (".py", False),
    "config": (".config", False),
    "filters": (".config", False),
    "dag_xml": (".py", True),
    "test": (".py", False),
}

# Folder names that decide a type.
SCHEDULER_DIRS = ["event_engine", "scheduler", "schedulers", "workflows", "dag"]
TEST_DIRS = ["tests", "test"]

# Target names where none are configured.
DEFAULT_PROJECT = "my-project"
DEFAULT_BUCKET = "gs://my-bucket"

# Limits.
LIST_LIMIT = 400
HIT_LIMIT = 200
HIT_CHARS = 200
LINE_LIMIT = 1500
TARGET_LIMIT = 200
FLAGGED_LIMIT = 60
RESULT_CHARS = 50_000
PREVIEW_CHARS = 1_500
SHELL_CHARS = 20_000
LABEL_CHARS = 60
EXCERPT_CHARS = 500
REPORT_CHARS = 200
TAIL_LINES = 40
MAX_STEPS = 60
MAX_FIX_ROUNDS = 3
PERMISSION_TIMEOUT_S = 600
IDLE_GAP_S = 12

# US dollars per million tokens.
PRICE_INPUT = "3.00"
PRICE_OUTPUT = "15.00"
PRICE_CACHE_READ = "0.30"
PRICE_CACHE_WRITE = "3.75"

# Statement openings that mark a text as DDL.
DDL_PREFIXES = [
    "CREATE TABLE",
    "CREATE OR REPLACE TABLE",
    "CREATE SCHEMA",
    "CREATE OR REPLACE SCHEMA",
    "DROP TABLE",
]

# Types a run parameter may take.
PARAMETER_TYPES = [
    "STRING", "BYTES", "INT64", "INTEGER", "FLOAT64", "FLOAT", "NUMERIC", "BIGNUMERIC",
    "BOOL", "BOOLEAN", "TIMESTAMP", "DATE", "TIME", "DATETIME", "GEOGRAPHY", "JSON",
]

# Catalogued Hive functions (the usage audit counts these).
CATALOGUE = [
    "from_unixtime", "unix_timestamp", "date_format", "date_add", "datediff", "nvl", "nvl2",
    "concat_ws", "regexp_extract", "split", "size", "collect_set", "collect_list",
    "get_json_object", "to_date", "year", "month", "day", "cast",
]

# Hive type -> target type.
TYPE_NAMES = {
    "STRING": "STRING",
    "BIGINT": "INT64",
    "INT": "INT64",
    "SMALLINT": "INT64",
    "TINYINT": "INT64",
    "FLOAT": "FLOAT64",
    "DOUBLE": "FLOAT64",
    "BOOLEAN": "BOOL",
    "TIMESTAMP": "TIMESTAMP",
    "DATE": "DATE",
    "BINARY": "BYTES",
}
NUMERIC_MAX_PRECISION = 29

# Configuration keys renamed or removed.
CONFIG_RENAMES = {
    "HIVE_RUNNER": "BQ_RUNNER",
    "HiveDBPath": "BQ_DATASET_PATH",
    "HqlDir": "SqlDir",
    "HdlDir": "SchemaDir",
}
CONFIG_VALUES = {"HIVE_RUNNER": "bq"}
CONFIG_REMOVED = ["mapred_qname"]
REMOVED_NOTE = "# REMOVED: mapred_qname (YARN queue — not needed in BQ)"

# Column-name endings stored as STRING when the type is unknown.
STRING_ENDINGS = ["_timestamp", "_ts", "_dt", "_date"]

# The ingest filter.
EXCLUDED_RECORDS = ["TEST", "INTERNAL"]
STATUS_CODES = ["BOOKED", "IN_TRANSIT", "DELIVERED"]
MIN_DECLARED_VALUE = "10.00"

# Patterns.
LINE_BREAK = "\r\n|[\n\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"
OTHER_BREAKS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
DB_TABLE_REF = r"\$\{(\w+)\}\.(\w+)"
USE_STATEMENT = r"USE\s+\$\{(\w+)\};?"
CREATE_TABLE = r"(?i)CREATE\s+(?:EXTERNAL\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)"
HIVEVAR_FILTER = r"(?s)set\s+hivevar:(\w+)\s*=\s*(.+?);"
PARAMETER = r"(?<!@)@(\w+)"
PARAMETER_TYPE_ERROR = (
    r"[Qq]uery parameter ['\"]?@?(\w+)['\"]? "
    r"has type \w+ which cannot be coerced to expected type (\w+)"
)
CODE_FENCE = r"\A\s*```(?:python|sql|bash|sh|yaml|xml|json|hql)?\s*\n((?s:.*?))\n```\s*\z"
LOG_COUNT = r"(\d+)\s+(passed|failed|errors?)"
LOG_BLOCK = r"_+\s*ERROR collecting (\S+\.py)\s*_+"
LOG_SUMMARY = r"^(?:FAILED|ERROR)\s+(\S+\.py)(?:::\S+)?(?:\s*-\s*(.+))?$"

# Note and message texts.
NOTE_TODO = "Contains TODO items requiring manual review"
NOTE_HIVEVAR = "Unresolved hivevar filter references remain"
NOTE_PYSPARK = "Contains TODO items or residual PySpark references — review required"
NOTE_TESTS = "Tests converted from PySpark to pure Python — validate filter logic matches original HQL"
NOTE_DAG = "Update bash_command paths to point to GCP-compatible scripts"
NOTE_SENSOR = "Review ExternalTaskSensor external_dag_id values match actual DAG IDs"
NOTE_XML = "XML parse warning"
NOTE_NO_USE = "No USE statement found — dataset must be set manually"
NOTE_FILTERS = "Filters baked into converted SQL WHERE clause — see this file for reference"
UNKNOWN_DATASET = "UNKNOWN_DATASET"
NO_BODY = "(collection error)"
NO_MESSAGE = "(no error message captured)"
UNKNOWN_FILE = "(unknown)"
DENIED_BY_USER = "User denied this tool call."
DENIED_BY_RULE = "' is denied by configuration."
NO_PROMPTER = "' needs approval but no prompter is available."
HITS_CUT = "... [result limit reached — narrow the search]"
MORE_FLAGGED = " more flagged files]"
SYNTAX_ERROR = "SyntaxError: "
COMPILE_ERROR = "compile() failed: "

# Phrases of error texts and the repair they ask for.
DRY_RUN_ERRORS = [
    ("Type mismatch|cannot be inserted into column", "type mismatch"),
    ("Unrecognized name", "unknown name"),
    ('Unexpected "@"', "stray parameter"),
    ("PARTITION BY expression must be", "partition expression"),
]
TEST_ERRORS = [
    ("ImportError|ModuleNotFoundError", "import"),
    ("AssertionError", "assertion"),
    ("SyntaxError", "syntax"),
]
