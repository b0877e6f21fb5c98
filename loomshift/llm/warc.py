"""WARC archives of pages and the merged index of their captures.

`write_archives` writes one record per page with Spark's text writer: a record is a row, the two line breaks that
end a WARC record are the row separator. Every record begins with the version line and the id of the
run, which no payload can know; `read_archives` splits at exactly that, so archives of
any size are read by many tasks, and each record's Content-Length is checked.

`capture_index` sorts the captures of each task into runs and merges the runs by URL key, time and id with a
loser tree, one range of the order per task: the captures of one busy URL are spread over ranges too.

Defined cases: null html is an empty payload; a null id is written as `none` and read as null, never
refers and is referred to by none; null or malformed URLs are keyed by their text; rows that repeat the largest id of
a payload are all responses; line breaks in a URL are percent-encoded; an empty table gives an empty index.
"""

from __future__ import annotations

import sys
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomshift.llm.common import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END = "\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
URN = "urn:loomshift:page:"
RUN_ROWS = 50_000      # captures sorted together
RANGE_ROWS = 200_000   # captures merged by one task, about


def first_line(run: str) -> str:
    return f"WARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:{run}>\r\n"


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """`pages` (page_id, url, html, captured) with payload_bytes, payload_digest and refers_to, the largest id of the
    same payload. Only digests that repeat are joined, and payloads move only if these are too many to broadcast."""
    pages = pages.withColumn("html", F.coalesce("html", F.lit("")))
    payload = F.col("html").cast("binary")
    pages = pages.withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn("payload_digest", F.sha1(payload))
    scratch = Scratch(pages.sparkSession, "revisits")
    repeated = scratch.store(
        pages.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    out = pages.join(repeated, ["payload_digest", "payload_bytes"], "left")
    return out.withColumn("refers_to", F.when(F.col("page_id") != F.col("refers_to"), F.col("refers_to")))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", time_col: str | None = None) -> str:
    """Writes the archives and returns the id of the run. Without a time column the time of capture
    is the id in seconds, a stand-in that keeps captures ordered."""
    run = str(uuid.uuid4())
    stand_in = F.timestamp_seconds(F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(4_102_444_800)))
    captured = F.coalesce(F.col(time_col), F.lit(0).cast("timestamp")) if time_col else stand_in
    rows = revisits(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                                 captured.alias("captured")), least_bytes)
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.when(F.col("refers_to").isNull(), F.concat(F.lit(HTTP_HEAD), "html")).otherwise("")
    head = F.concat(
        F.lit(first_line(run) + "WARC-Type: "), kind,
        F.lit(f"\r\nWARC-Record-ID: <{URN}"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"),
        F.lit("\r\nWARC-Date: "), F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.coalesce(F.concat(F.lit(f"\r\nWARC-Refers-To: <{URN}"), F.col("refers_to").cast("string"),
                            F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), "payload_digest", F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(END))
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(folder)
    return run


def read_archives(spark: SparkSession, folder: str, run: str) -> DataFrame:
    """Records of the archives: page_id, url, captured, record_type, refers_to, payload (of responses), payload_bytes, payload_digest.
    Bytes and digest of a response are measured on its payload and must agree with its header."""
    raw = spark.read.option("lineSep", first_line(run)).text(folder).filter("value != ''")
    parts = raw.withColumn("head", F.substring_index("value", END, 1))
    block = F.expr("substring(value, length(head) + 5, length(value) - length(head) - 8)")

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))

    def page(name: str) -> Column:
        return F.nullif(F.regexp_extract("head", rf"(?m)^{name}: <{URN}([^>]*)>", 1), F.lit("")).try_cast("long")

    parts = parts.select(
        block.alias("block"), field("Content-Length").cast("long").alias("length"), page("WARC-Record-ID").alias("page_id"),
        F.regexp_extract("head", r"(?m)^WARC-Target-URI: ([^\r\n]*)", 1).alias("url"), F.col("head").contains("\nWARC-Target-URI: ").alias("has_url"),
        F.to_timestamp(field("WARC-Date"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"), field("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"), field("X-Payload-Length").cast("long").alias("said_bytes"),
        F.substring(field("WARC-Payload-Digest"), 6, 40).alias("said_digest"))
    payload = F.when(F.col("record_type") == "response", F.expr(f"substring(block, {len(HTTP_HEAD) + 1})"))
    whole = payload.cast("binary")
    out = parts.withColumn("payload", payload).withColumn(
        "payload_bytes", F.coalesce(F.octet_length(whole).cast("long"), F.col("said_bytes"))).withColumn(
        "payload_digest", F.coalesce(F.sha1(whole), F.col("said_digest")))
    right = ((F.octet_length("block") == F.col("length")) & (F.col("payload_bytes") == F.col("said_bytes"))
             & (F.col("payload_digest") == F.col("said_digest")))
    checked = F.when(F.coalesce(right, F.lit(False)), F.col("record_type")).otherwise(F.raise_error(F.lit("a WARC record is damaged")))
    return out.select("page_id", F.when(F.col("has_url"), F.col("url")).alias("url"), "captured", checked.alias("record_type"),
                      "refers_to", "payload", "payload_bytes", "payload_digest")


def url_key(url: Column) -> Column:
    """Host reversed, then path and query: `org,example,www)/a?b`; other texts as they are."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^#]*)"
    host = F.lower(F.regexp_extract(url, pattern, 1))
    return F.when(host == "", url).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(url, pattern, 2)))


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of the match played there."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self.play(leaf)

    def beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # still being built: wait for the other side
                self.losers[node] = winner
                return
            if self.beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.heads[best := self.losers[0]] is not None:
            yield self.heads[best]
            self.heads[best] = next(self.runs[best], None)
            self.play(best)


def order_of(table: pa.Table) -> list[tuple]:
    """Sort keys of the rows: URL key, time, id (nulls first), place in the table."""
    keys = [["" if v is None else v for v in table["url_key"].to_pylist()], table["micros"].to_pylist(),
            [(-1, 0) if v is None else (0, v) for v in table["page_id"].to_pylist()], range(table.num_rows)]
    return list(zip(*keys, strict=True))


def sorted_runs(batches):
    """Each stretch of rows in the order of the index, marked as a run."""
    def run(rows):
        table = pa.Table.from_batches(rows)
        table = table.take(pa.array([key[-1] for key in sorted(order_of(table))]))
        return table.append_column("run", pa.array([uuid.uuid4().int >> 65] * table.num_rows, pa.int64())).combine_chunks().to_batches()

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= RUN_ROWS:
            yield from run(held)
            held, n = [], 0
    if n:
        yield from run(held)


def merged(batches):
    """The rows of one range: their runs merged."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    runs: dict[int, list[tuple]] = {}
    for run, key in zip(table["run"].to_pylist(), order_of(table), strict=True):
        runs.setdefault(run, []).append(key)
    for keys in runs.values():
        keys.sort()  # pieces of a run arrive in order; this costs one look at each
    order = [key[-1] for key in LoserTree(list(runs.values()))]
    table = table.take(pa.array(order)).drop_columns(["run"])
    yield from table.append_column("at", pa.array(range(len(order)), pa.int64())).combine_chunks().to_batches()


def capture_index(captures: DataFrame) -> DataFrame:
    """Captures (page_id, url, captured and others but the payload) in the order of URL key, time and id, with their `position`."""
    spark = captures.sparkSession
    scratch = Scratch(spark, "captures")
    entries = captures.drop("payload").withColumn("url_key", url_key(F.col("url"))).withColumn("micros", F.unix_micros("captured"))

    def ddl(df: DataFrame, *more: str) -> str:
        return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "run"] + list(more))

    runs = scratch.store(entries.mapInArrow(sorted_runs, ddl(entries, "run long")))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(ranges, F.coalesce("url_key", F.lit("")), "micros", "page_id")
    index = dealt.mapInArrow(merged, ddl(runs, "at long")).withColumn("part", F.spark_partition_id())
    index = scratch.store(index)
    counts = dict(index.groupBy("part").count().collect())  # one small row per range
    shift, total = [], 0
    for part in sorted(counts):
        shift += [F.lit(part), F.lit(total)]
        total += counts[part]
    before = F.create_map(*shift)[F.col("part")] if shift else F.lit(0)
    scratch.drop(runs)
    return index.withColumn("position", (F.col("at") + before).cast("long")).drop("at", "part", "micros")


def histories(index: DataFrame) -> DataFrame:
    """One row per URL key: number of captures, of distinct payloads, and the span they take in time and in the index."""
    return index.groupBy("url_key").agg(
        F.count("*").alias("captures"), F.min("captured").alias("first_captured"), F.max("captured").alias("last_captured"),
        F.min("position").alias("first_position"), F.max("position").alias("last_position"))
