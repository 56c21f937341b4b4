"""Queries that parse the corpus, redact it, and run streams over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, redaction, text
from ..operators import store
from ..sources import parsing, scan
from ..streaming import reads
from ..tables import read


def parse_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents as typed node rows."""
    return parsing.parse_files(read(spark, d, "documents").select("source_file", "text"))


def parse_errors(spark: SparkSession, d: str) -> DataFrame:
    """The documents that do not parse in their format, with the reason."""
    return parse_documents(spark, d).where(F.col("error").isNotNull()).select("source_file", "error")


def html_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Node rows of the HTML documents by type and format."""
    docs = read(spark, d, "documents").where(F.lower(F.col("source_file")).rlike(r"\.html?$"))
    return parsing.parse_files(docs.select("source_file", "text")).groupBy("node_type", "format").agg(F.count("*").alias("n"), F.sum(F.col("token_count").cast("long")).alias("tokens"))


def parse_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Node rows of the Markdown documents."""
    docs = read(spark, d, "documents").where(F.lower(F.col("source_file")).rlike(r"\.(md|markdown)$"))
    return parsing.parse_files(docs.select("source_file", "text"))


def redacted_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Contents in which a known token format was blanked out, with the kinds."""
    rows = read(spark, d, "nodes").select("id", "content").distinct().select("id", redaction.redact(F.col("content")).alias("r"))
    return rows.where(F.size("r.kinds") > 0).select("id", "r.text", "r.kinds")


def node_labels(spark: SparkSession, d: str) -> DataFrame:
    """The label that each node's type and content give."""
    nodes = store.nodes_now(read(spark, d, "nodes"))
    return nodes.select("id", text.node_label(F.col("node_type"), F.col("content"), F.col("format")).alias("label"))


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """xxh64 of each document's text."""
    return read(spark, d, "documents").select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"))


def scan_paths(spark: SparkSession, d: str) -> DataFrame:
    """Files of the corpus whose path would be read by a scan."""
    return read(spark, d, "documents").where(scan.wanted_path(F.col("source_file"))).select("source_file").distinct()


def stream_heat(spark: SparkSession, d: str) -> DataFrame:
    """Heat per user after the event log ran through the stream."""
    heat = reads.heat_drained(reads.event_stream(spark, f"{d}/events.parquet"))
    return heat.select("node_id", "reads", F.round("temperature", 6).alias("temperature"))


def stream_activity(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type after the event log ran through the stream."""
    rows = reads.activity_drained(reads.event_stream(spark, f"{d}/events.parquet"))
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (parse_documents, parse_errors, html_nodes, parse_markdown, redacted_nodes, node_labels, content_hashes, scan_paths, stream_heat, stream_activity)}

_EXT = "('.md', '.markdown', '.html', '.htm', '.yaml', '.yml', '.json', '.jsonl', '.ndjson', '.toon')"

SQL = {
    "scan_paths": rf"""select distinct source_file from documents where lower(regexp_extract(source_file, '\.[^./]+$', 0)) in {_EXT}
and not regexp_matches(source_file, '(^|/)(\.[^/]*|Pods|__pycache__|bower_components|dist|node_modules|target|vendor|venv)/')""",
    "stream_heat": """with recursive e as (select user_id, epoch(ts) as x, row_number() over (partition by user_id order by ts) as rn, count(*) over (partition by user_id) as n from events),
fold as (
  select user_id, rn, n, x, least(1e0, 0.5e0 + 0.15e0) as t from e where rn = 1
  union all
  select e.user_id, e.rn, e.n, e.x, least(1e0, f.t * exp(-0.05e0 * (e.x - f.x) / 3600e0) + 0.15e0) from fold f join e on e.user_id = f.user_id and e.rn = f.rn + 1)
select user_id as node_id, n as reads, round(t, 6) as temperature from fold where rn = n""",
    "stream_activity": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
}
