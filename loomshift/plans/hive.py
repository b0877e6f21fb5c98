"""Hive query semantics over the sales and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomshift.functions import hive
from loomshift.operators import extract, tables
from loomshift.operators.ordered import OrderedGroups, first_rows, listed, listed_rows, listed_set, ranked
from loomshift.plans.registry import query
from loomshift.session import read_table
from loomshift.sources import sinks


# --- scalar functions -------------------------------------------------------------


@query("fn_current", "SELECT o_orderkey, TRUE AS has_now, TRUE AS recent FROM orders")
def fn_current(spark, sf_dir):
    """current time, checked for type and presence."""
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey")
    now, epoch = hive.now_timestamp(), hive.now_epoch()
    return rows.select("o_orderkey", now.isNotNull().alias("has_now"), (epoch > 1_700_000_000).alias("recent"))


@query(
    "fn_epoch",
    """
    SELECT event_id, strftime(make_timestamp(secs * 1000000), '%Y-%m-%d %H:%M:%S') AS lenient,
           epoch(make_timestamp(secs * 1000000))::BIGINT AS strict_seconds
    FROM (SELECT event_id, epoch_us(ts) // 1000000 AS secs FROM events)
    """,
)
def fn_epoch(spark, sf_dir):
    """epoch seconds to a timestamp (strict) or text (lenient)."""
    ev = read_table(spark, sf_dir, "events")
    secs = F.unix_seconds(F.col("ts").cast("timestamp"))
    return ev.select(
        "event_id",
        hive.from_unixtime(secs, strict=False).alias("lenient"),
        F.unix_seconds(hive.from_unixtime(secs)).alias("strict_seconds"),
    )


@query(
    "fn_dates",
    """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day_text,
           strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') AS plus30,
           date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS days_left,
           CAST(TRY_CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS VARCHAR) AS parsed,
           year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d
    FROM orders
    """,
)
def fn_dates(spark, sf_dir):
    """F4-F6, F14-F17."""
    o = read_table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderpriority") == "1-URGENT", "not a date").otherwise(hive.date_text("o_orderdate"))
    return o.select(
        "o_orderkey",
        hive.date_text("o_orderdate").alias("day_text"),
        hive.date_text(hive.date_add("o_orderdate", 30)).alias("plus30"),
        hive.datediff(F.lit("2002-01-01").cast("date"), "o_orderdate").alias("days_left"),
        hive.to_date(text).cast("string").alias("parsed"),
        hive.year("o_orderdate").alias("y"),
        hive.month("o_orderdate").alias("m"),
        hive.day("o_orderdate").alias("d"),
    )


@query(
    "run_date",
    "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - 1, '%Y-%m-%d') AS run_date FROM orders",
)
def run_date(spark, sf_dir):
    """the day before."""
    return read_table(spark, sf_dir, "orders").select("o_orderkey", hive.default_run_date("o_orderdate").alias("run_date"))


@query(
    "fn_nulls",
    """
    SELECT doc_id, coalesce(quality, -1)::BIGINT AS nvl_quality,
           CASE WHEN toxic IS NOT NULL THEN 'labelled' ELSE 'unlabelled' END AS nvl2_label
    FROM documents LEFT JOIN labels USING (doc_id)
    """,
)
def fn_nulls(spark, sf_dir):
    """F7, F8."""
    d = read_table(spark, sf_dir, "documents").select("doc_id").join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select(
        "doc_id",
        hive.nvl("quality", F.lit(-1)).cast("bigint").alias("nvl_quality"),
        hive.nvl2("toxic", F.lit("labelled"), F.lit("unlabelled")).alias("nvl2_label"),
    )


@query(
    "fn_strings",
    r"""
    SELECT doc_id, concat_ws('-', lang, CAST(quality AS VARCHAR), source) AS lenient_concat,
           lang || '-' || CAST(quality AS VARCHAR) || '-' || source AS strict_concat,
           regexp_extract(text, '(\d+)%', 1) AS lenient_extract,
           CASE WHEN regexp_matches(text, '(\d+)%') THEN regexp_extract(text, '(\d+)%', 1) END AS strict_extract
    FROM documents LEFT JOIN labels USING (doc_id)
    """,
)
def fn_strings(spark, sf_dir):
    """F9, F10 in both forms."""
    d = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    q = F.col("quality").cast("string")
    return d.select(
        "doc_id",
        hive.concat_ws("-", "lang", q, "source").alias("lenient_concat"),
        hive.concat_ws("-", "lang", q, "source", strict=True).alias("strict_concat"),
        hive.regexp_extract("text", r"(\d+)%").alias("lenient_extract"),
        hive.regexp_extract("text", r"(\d+)%", strict=True).alias("strict_extract"),
    )


@query(
    "fn_arrays",
    """
    SELECT page_id, str_split(url, '/')[4] AS fourth, str_split(url, '/')[9] AS past_end,
           len(str_split(url, '/')) AS parts,
           CASE WHEN contains(url, '?') THEN len(str_split(url, '/')) END AS strict_size,
           CASE WHEN contains(url, '?') THEN len(str_split(url, '/')) ELSE -1 END AS hive_size
    FROM pages
    """,
)
def fn_arrays(spark, sf_dir):
    """F11, F12."""
    p = read_table(spark, sf_dir, "pages")
    parts = F.split("url", "/")
    some = F.when(F.col("url").contains("?"), parts)
    return p.select(
        "page_id",
        hive.split_at("url", "/", 3).alias("fourth"),
        hive.split_at("url", "/", 8).alias("past_end"),
        hive.size(parts).alias("parts"),
        hive.size(some).alias("strict_size"),
        hive.size(some, strict=False).alias("hive_size"),
    )


@query(
    "fn_json",
    """
    SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing,
           '{"k":' || json_extract_string(props, '$.k') || '}' AS lenient_object, NULL::VARCHAR AS strict_object,
           '[' || json_extract_string(props, '$.k') || '] noted' AS strict_text
    FROM events
    """,
)
def fn_json(spark, sf_dir):
    """a path to an object gives its text (lenient) or NULL (strict); a text that begins like a list stays."""
    e = read_table(spark, sf_dir, "events")
    noted = F.concat(F.lit('{"t": "['), F.get_json_object("props", "$.k"), F.lit('] noted"}'))
    nested = F.concat(F.lit('{"o":'), F.replace("props", F.lit(" "), F.lit("")), F.lit("}"))
    return e.select(
        "event_id",
        hive.json_value("props", "$.k").alias("k"),
        hive.json_value("props", "$.missing").alias("missing"),
        hive.json_value(nested, "$.o").alias("lenient_object"),
        hive.json_value(nested, "$.o", strict=True).alias("strict_object"),
        hive.json_value(noted, "$.t", strict=True).alias("strict_text"),
    )


@query(
    "fn_casts",
    """
    SELECT event_id, TRY_CAST(event_type AS BIGINT) AS word_as_bigint,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS strict_bigint,
           TRY_CAST(CASE WHEN event_type = 'view' THEN 'x' ELSE json_extract_string(props, '$.k') END AS BIGINT) AS lenient_bigint,
           CAST(CAST(value AS VARCHAR) AS DOUBLE) AS as_double, CAST(CAST(value AS FLOAT) AS DOUBLE) AS widened
    FROM events
    """,
)
def fn_casts(spark, sf_dir):
    """Lenient casts give NULL; FLOAT and DOUBLE both become double."""
    e = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        "event_id",
        hive.to_bigint("event_type").alias("word_as_bigint"),
        hive.to_bigint(k, strict=True).alias("strict_bigint"),
        hive.to_bigint(F.when(F.col("event_type") == "view", "x").otherwise(k)).alias("lenient_bigint"),
        hive.to_double(F.col("value").cast("string"), strict=True).alias("as_double"),
        hive.to_double(F.col("value").cast("float"), strict=True).alias("widened"),
    )


# --- inserts, types -------------------------------------------------------------------


@query(
    "insert_coercion",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price,
           CAST(o_orderdate AS VARCHAR) AS load_ts, TRY_CAST(o_orderpriority AS BIGINT) AS priority_no,
           CAST(o_custkey AS VARCHAR) AS first_dt
    FROM orders
    """,
)
def insert_coercion(spark, sf_dir):
    """columns cast for a strict target; unknown time-like columns become text."""
    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("load_ts"), F.col("o_orderpriority").alias("priority_no"),
        F.col("o_custkey").alias("first_dt"),
    )
    known = {"order_id": T.StringType(), "price": T.DecimalType(18, 2), "priority_no": T.LongType()}
    return sinks.coerce_by_name(o, known).withColumn("price", F.col("price").cast("double"))


@query(
    "cast_audit",
    """
    SELECT 'day_text' AS column_name, 'date' AS target_type, count(*) AS non_null,
           count(*) FILTER (o_orderpriority = '1-URGENT') AS lost FROM orders
    UNION ALL SELECT 'o_orderpriority', 'bigint', count(*), count(*) FROM orders
    UNION ALL SELECT 'digit', 'bigint', count(*), 0 FROM orders
    UNION ALL SELECT 'o_totalprice', 'decimal(7,2)', count(*), count(*) FILTER (o_totalprice >= 99999.995) FROM orders
    """,
)
def cast_audit(spark, sf_dir):
    """values that a cast would lose, per column, in one pass."""
    o = read_table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderpriority") == "1-URGENT", "n/a").otherwise(hive.date_text("o_orderdate")).alias("day_text"),
        "o_orderpriority",
        F.substring("o_orderpriority", 1, 1).alias("digit"),
        "o_totalprice",
    )
    return sinks.cast_audit(
        o, {"day_text": T.DateType(), "o_orderpriority": T.LongType(), "digit": T.LongType(), "o_totalprice": T.DecimalType(7, 2)}
    )


@query(
    "type_map",
    """
    SELECT event_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
           '{"k":' || json_extract_string(props, '$.k') || '}' AS props
    FROM events
    """,
)
def type_map(spark, sf_dir):
    """narrow integers and floats widen, a map becomes JSON text."""
    e = read_table(spark, sf_dir, "events").select(
        "event_id", F.col("value").cast("float").alias("value"),
        F.get_json_object("props", "$.k").cast("smallint").alias("k"),
        F.from_json("props", "map<string,int>").alias("props"),
    )
    return e.select([hive.to_target(f.name, f.dataType) for f in e.schema])


@query(
    "type_map_arrays",
    """
    SELECT vec_id, CAST(label AS BIGINT) AS label, len(embedding) AS dims,
           CAST(embedding[1] AS DOUBLE) AS first_value, CAST(embedding[-1] AS DOUBLE) AS last_value
    FROM embeddings
    """,
)
def type_map_arrays(spark, sf_dir):
    """F22 on arrays: element types widen."""
    v = read_table(spark, sf_dir, "embeddings")
    wide = v.select([hive.to_target(f.name, f.dataType) for f in v.schema])
    return wide.select(
        "vec_id", "label", hive.size("embedding").alias("dims"),
        F.get("embedding", F.lit(0)).alias("first_value"), F.element_at("embedding", -1).alias("last_value"),
    )


_TYPES = """
CASE o_orderkey % 8 WHEN 0 THEN concat('decimal(', CAST(o_custkey % 38 + 1 AS {text}), ',2)') WHEN 1 THEN 'Decimal' WHEN 2 THEN 'array<array<int>>'
  WHEN 3 THEN 'MAP<STRING,ARRAY<INT>>' WHEN 4 THEN 'ARRAY<map<string,int>>' WHEN 5 THEN 'STRUCT<a:INT,b:ARRAY<INT>>' WHEN 6 THEN 'varchar(20)' ELSE ' smallint ' END
"""


@query(
    "type_names",
    """
    SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN CASE WHEN o_custkey % 38 + 1 <= 29 THEN 'NUMERIC' ELSE 'BIGNUMERIC' END WHEN 1 THEN 'NUMERIC'
      WHEN 2 THEN 'ARRAY<ARRAY<INT64>>' WHEN 3 THEN 'JSON' WHEN 4 THEN 'ARRAY<JSON>' WHEN 5 THEN 'STRUCT<a:INT,b:ARRAY<INT>>' WHEN 6 THEN 'STRING' ELSE 'INT64' END AS target
    FROM orders
    """,
)
def type_names(spark, sf_dir):
    """target type names for Hive type texts."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_TYPES.replace("{text}", "STRING")).alias("hive_type"))
    return o.select("o_orderkey", hive.target_type("hive_type").alias("target"))


# --- filters and parameters --------------------------------------------------------------

FILTER_FILE = """
set hivevar:filter_status=o_orderstatus <> 'F';
set hivevar:filter_price=coalesce(o_totalprice, 0)
  >= 100000;
set hivevar:filter_from=o_orderdate >= timestamp '1996-01-01';
"""


@query(
    "injected_filters",
    """
    SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
    WHERE o_orderstatus <> 'F' AND coalesce(o_totalprice, 0) >= 100000 AND o_orderdate >= TIMESTAMP '1996-01-01'
    """,
)
def injected_filters(spark, sf_dir):
    """P5: the predicates of a filter file, ANDed."""
    found = [p.split("=", 1) for p in FILTER_FILE.replace("set hivevar:", "").split(";") if p.strip()]
    filters = [(name.strip(), body.strip()) for name, body in found]
    o = extract.inject_filters(read_table(spark, sf_dir, "orders"), filters)
    return o.select("o_orderkey", "o_orderstatus", "o_totalprice")


SHIPMENTS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
  CASE WHEN l_returnflag = 'R' THEN 'TEST' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL ELSE 'STANDARD' END AS record_type,
  CASE l_suppkey % 4 WHEN 0 THEN 'BOOKED' WHEN 1 THEN 'IN_TRANSIT' WHEN 2 THEN 'DELIVERED' ELSE 'LOST' END AS shipment_status_code,
  CASE WHEN l_discount > 0.08 THEN NULL ELSE CAST(l_quantity AS DECIMAL(18,2)) END AS declared_value,
  CASE WHEN l_tax = 0 THEN '' ELSE CAST(l_suppkey AS {text}) END AS carrier_id
FROM {lineitem}
"""


def shipments(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return spark.sql(SHIPMENTS.replace("{text}", "STRING"), lineitem=li)


_SHIP_SQL = "WITH shipments AS (" + SHIPMENTS.replace("{text}", "VARCHAR").replace("{lineitem}", "lineitem") + ")\n"
_INGEST_SQL = """(record_type IS NULL OR record_type NOT IN ('TEST', 'INTERNAL'))
    AND shipment_status_code IN ('BOOKED', 'IN_TRANSIT', 'DELIVERED')
    AND coalesce(declared_value, 0) >= 10.00 AND carrier_id IS NOT NULL AND carrier_id <> ''"""


@query(
    "ingest_filter",
    _SHIP_SQL + f"""
    SELECT l_orderkey, l_linenumber, l_partkey, record_type, shipment_status_code, CAST(declared_value AS DOUBLE) AS declared_value, carrier_id
    FROM shipments WHERE {_INGEST_SQL}
    """,
)
def ingest_filter(spark, sf_dir):
    """P6; a NULL record type is kept."""
    kept = tables.ingest_filter(shipments(spark, sf_dir))
    return kept.select(
        "l_orderkey", "l_linenumber", "l_partkey", "record_type", "shipment_status_code",
        F.col("declared_value").cast("double").alias("declared_value"), "carrier_id",
    )


@query(
    "param_predicate",
    "SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-10-03'",
)
def param_predicate(spark, sf_dir):
    """A run parameter, bound, never pasted into the text."""
    o = read_table(spark, sf_dir, "orders")
    return spark.sql(
        "SELECT o_orderkey, o_custkey FROM {orders} "
        "WHERE o_orderdate >= CAST(:trans_dt AS TIMESTAMP_NTZ) "
        "AND o_orderdate < CAST(date_add(CAST(:trans_dt AS DATE), 1) AS TIMESTAMP_NTZ)",
        args={"trans_dt": "1998-10-03"}, orders=o,
    )


# Items of a list in one row of a result; `listed_rows` has a row per item instead.
LIST_ITEMS = 10_000


@query(
    "list_positions",
    """
    SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position, o_orderkey AS value FROM orders
    """,
)
def list_positions(spark, sf_dir):
    """A6 in the long form: a row per item, whatever the length of the lists."""
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return listed_rows(o, ["o_custkey"], "o_orderkey", ["o_orderdate", "o_orderkey"])


# --- aggregates ----------------------------------------------------------------------------


@query(
    "collect_arrays",
    """
    SELECT o_custkey, part, 'orders' AS kind, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS items
    FROM (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 10000 AS part FROM orders) GROUP BY o_custkey, part
    UNION ALL
    SELECT o_custkey, part, 'priorities', count(*), string_agg(p, ',' ORDER BY p)
    FROM (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY p) - 1) // 10000 AS part
      FROM (SELECT DISTINCT o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS p FROM orders) WHERE p IS NOT NULL) GROUP BY o_custkey, part
    """,
)
def collect_arrays(spark, sf_dir):
    """Lists and sets without NULLs, at most 10,000 items to a row."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("p"),
    )
    lists = listed(o.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderkey", ["o_orderdate", "o_orderkey"], LIST_ITEMS)
    sets = listed_set(o, ["o_custkey"], "p", LIST_ITEMS)

    def shown(df, kind, items):
        return df.select("o_custkey", "part", F.lit(kind).alias("kind"), "n", F.array_join(items, ",").alias("items"))

    return shown(lists, "orders", F.col("items").cast("array<string>")).unionByName(shown(sets, "priorities", F.col("items")))


@query(
    "string_agg",
    """
    SELECT l_suppkey, part, string_agg(m, '|' ORDER BY m) AS months
    FROM (SELECT *, (row_number() OVER (PARTITION BY l_suppkey ORDER BY m) - 1) // 10000 AS part
      FROM (SELECT DISTINCT l_suppkey, strftime(l_shipdate, '%Y-%m') AS m FROM lineitem)) GROUP BY l_suppkey, part
    """,
)
def string_agg(spark, sf_dir):
    """Concatenated distinct values in order, at most 10,000 to a row."""
    li = read_table(spark, sf_dir, "lineitem").select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("m"))
    return listed_set(li, ["l_suppkey"], "m", LIST_ITEMS).select("l_suppkey", "part", F.array_join("items", "|").alias("months"))


@query(
    "group_count",
    "SELECT l_returnflag, l_linestatus, count(*) AS cnt FROM lineitem GROUP BY ALL",
)
def group_count(spark, sf_dir):
    """A9."""
    return read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("cnt"))


@query(
    "distinct_keys",
    """
    SELECT 'custkey' AS kind, CAST(o_custkey AS VARCHAR) AS k, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey
    UNION ALL SELECT 'priority', o_orderpriority, min(o_orderkey) FROM orders GROUP BY o_orderpriority
    """,
)
def distinct_keys(spark, sf_dir):
    """Distinct values, each with its first occurrence."""
    o = read_table(spark, sf_dir, "orders")

    def keys(kind, col):
        return o.groupBy(F.col(col).cast("string").alias("k")).agg(F.min("o_orderkey").alias("first_order")).select(
            F.lit(kind).alias("kind"), "k", "first_order"
        )

    return keys("custkey", "o_custkey").unionByName(keys("priority", "o_orderpriority"))


@query(
    "count_reconcile",
    """
    SELECT coalesce(s.d, t.d) AS trans_dt, coalesce(s.n, 0) AS source_count, coalesce(t.n, 0) AS target_count,
           coalesce(s.n, 0) - coalesce(t.n, 0) AS diff
    FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, count(*) AS n FROM orders GROUP BY 1) s
    FULL JOIN (SELECT strftime(l_shipdate, '%Y-%m-%d') AS d, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) t ON s.d = t.d
    """,
)
def count_reconcile(spark, sf_dir):
    """Rows per date on both sides and their difference."""
    return tables.reconcile_counts(
        read_table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("trans_dt")),
        read_table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("trans_dt")),
        "trans_dt",
    )


# --- windows --------------------------------------------------------------------------------


@query(
    "win_row_number",
    "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders",
)
def win_row_number(spark, sf_dir):
    """W1."""
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return OrderedGroups(o, ["o_custkey"], ["-o_totalprice", "o_orderkey"]).row_number("rn").result().drop("o_totalprice")


@query(
    "win_rank",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() OVER w AS rnk, dense_rank() OVER w AS drnk
    FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity)
    """,
)
def win_rank(spark, sf_dir):
    """W2, W3."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return ranked(li, ["l_suppkey"], "l_quantity", "rnk", "drnk").drop("l_quantity")


@query(
    "win_lag_lead",
    """
    SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS previous_order, lead(o_orderkey) OVER w AS next_order
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
    """,
)
def win_lag_lead(spark, sf_dir):
    """W4, W5."""
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    groups = OrderedGroups(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return groups.lag(F.col("o_orderkey"), "previous_order").lead(F.col("o_orderkey"), "next_order").result().drop("o_orderdate")


@query(
    "drop_duplicates",
    """
    SELECT l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS ship_day, l_orderkey, l_linenumber, l_partkey FROM (
      SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn FROM lineitem)
    WHERE rn = 1
    """,
)
def drop_duplicates(spark, sf_dir):
    """The first row in a stated order wins."""
    li = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]
    first = first_rows(li, ["l_suppkey", "l_shipdate"], order, 1)
    return first.select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_day"), "l_orderkey", "l_linenumber", "l_partkey")


@query(
    "union_by_name",
    """
    SELECT c_name AS name, CAST(c_nationkey AS BIGINT) AS nationkey, c_acctbal AS acctbal, 'customer' AS kind FROM customer
    UNION ALL SELECT s_name, s_nationkey, s_acctbal, 'supplier' FROM supplier
    """,
)
def union_by_name(spark, sf_dir):
    """Columns in another order meet by name."""
    c = read_table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").cast("bigint").alias("nationkey"),
        F.col("c_acctbal").alias("acctbal"), F.lit("customer").alias("kind"),
    )
    s = read_table(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("acctbal"),
        F.col("s_nationkey").cast("bigint").alias("nationkey"), F.col("s_name").alias("name"),
    )
    return c.unionByName(s)


@query(
    "daily_ingest",
    _SHIP_SQL + f"""
    , kept AS (SELECT o_custkey, strftime(o_orderdate, '%Y') AS yr, coalesce(record_type, 'UNKNOWN') AS record_type, declared_value
               FROM shipments JOIN orders ON l_orderkey = o_orderkey WHERE {_INGEST_SQL} AND o_orderdate >= TIMESTAMP '1996-01-01'),
    g AS (SELECT o_custkey, yr, record_type, count(*) AS cnt, CAST(sum(declared_value) AS DOUBLE) AS declared FROM kept GROUP BY ALL)
    SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY declared DESC, yr, record_type) AS rn FROM g) WHERE rn = 1
    """,
)
def daily_ingest(spark, sf_dir):
    """Ingest filter, run parameter, nvl, count, and the largest group of each customer."""
    kept = tables.ingest_filter(shipments(spark, sf_dir))
    orders = spark.sql(
        "SELECT o_orderkey, o_custkey, o_orderdate FROM {orders} WHERE o_orderdate >= CAST(:from_dt AS TIMESTAMP_NTZ)",
        args={"from_dt": "1996-01-01"}, orders=read_table(spark, sf_dir, "orders"),
    )
    joined = kept.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    grouped = joined.groupBy(
        "o_custkey", F.date_format("o_orderdate", "yyyy").alias("yr"), hive.nvl("record_type", F.lit("UNKNOWN")).alias("record_type")
    ).agg(F.count("*").alias("cnt"), F.sum("declared_value").cast("double").alias("declared"))
    top = first_rows(grouped, ["o_custkey"], [F.col("declared").desc(), F.col("yr"), F.col("record_type")], 1)
    return top.drop("row_number")
