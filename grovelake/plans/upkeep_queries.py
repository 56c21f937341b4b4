"""Queries that keep the store in step with its files and links, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, heat, retrieval, stats, store
from ..sources import scan
from ..streaming import reads
from . import store_queries as sq
from .store_queries import Tables

QUERIES: dict = {}
SQL: dict[str, str] = {}

ROOT = "/srv/vaults"
#: An ignore file: a kind of file, but not all of it; folders; a class; anchored patterns.
IGNORE = ["# logs", "*.jsonl", "!session_*.jsonl", "prompts/", "/cobalt-[0-9]/**", "*/reference/r?call_*"]
#: Temperatures by file or folder.
SEEDS = {"/srv/vaults/*": 0.4, "/srv/vaults/lighthouse/*": 0.9, "/srv/vaults/lighthouse/agents/*": 0.1}


def query(sql: str | None = None):
    def add(f):
        def run(spark, d):
            return f(Tables(spark, d))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    rf"""with f as (select distinct source_file, substr(source_file, {len(ROOT) + 2}) as rel from documents where starts_with(source_file, '{ROOT}/')),
m as (select *, string_split(rel, '/') as parts from f)
select source_file from m where case
  when regexp_matches(rel, '^[^/]+/reference/r[^/]call_') then true
  when regexp_matches(rel, '^cobalt-[0-9]/.') then true
  when list_contains(parts[1:-2], 'prompts') then true
  when len(list_filter(parts, lambda p: starts_with(p, 'session_') and ends_with(p, '.jsonl'))) > 0 then false
  else ends_with(rel, '.jsonl') end"""
)
def ignored_files(t: Tables) -> DataFrame:
    """Files of the corpus that an ignore file leaves out."""
    files = t.raw("documents").where(F.startswith("source_file", F.lit(f"{ROOT}/"))).select("source_file").distinct()
    return files.where(scan.ignored(text.strip_root(F.col("source_file"), F.lit(ROOT)), IGNORE))


def _known_files(t: Tables) -> DataFrame:
    """Files of the store with the time of their last export, without a zone."""
    at = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, updated_at)")
    return t.raw("nodes").select("source_file", at.alias("modified_at"))


def _seen_files(t: Tables) -> DataFrame:
    return t.raw("documents").groupBy("source_file").agg(F.max("collected_at").alias("modified_at"))


@query(
    """with known as (select source_file, max(timestamp '1970-01-01 00:00:00' + to_seconds(updated_at)) as old from nodes group by all),
seen as (select source_file, max(collected_at) as modified_at from documents group by all), m as (select max(modified_at) as now from seen)
select source_file from seen left join known using (source_file), m where (old is null or modified_at > old) and modified_at <= now - interval 1 day"""
)
def changed_files(t: Tables) -> DataFrame:
    """Files of the corpus that are new or newer than the store, and untouched for a day before the last one."""
    seen = _seen_files(t)
    now = seen.agg(F.max("modified_at")).first()[0]
    return scan.changed_paths(_known_files(t), seen, 86_400, now).select("source_file")


@query("select distinct source_file from nodes where source_file not in (select source_file from documents where source_file is not null)")
def gone_files(t: Tables) -> DataFrame:
    """Files of the store that the corpus has no more."""
    return scan.deleted_paths(t.raw("nodes"), t.raw("documents"))


@query(
    f"""with f as (select distinct source_file from documents), r(rule, t) as (values {", ".join(f"('{k}', {v}::double)" for k, v in SEEDS.items())})
select source_file, (select arg_max(t, length(rule)) from r where source_file = rule or starts_with(source_file, rtrim(rule, '*'))) as temperature from f"""
)
def seeded_temperatures(t: Tables) -> DataFrame:
    """The temperature that the rule nearest to each file gives."""
    return scan.seed_temperatures(t.raw("documents").select("source_file").distinct(), SEEDS).select("source_file", "temperature")


_GONE = sq._FULL + """, seeds as (select id from cur where contains(source_file, '/sessions/')),
gone as (from seeds union select c.id from cur c join gone g on c.pid = g.id where c.id not in (select id from cyc))"""


def _without_sessions(t: Tables) -> tuple[DataFrame, DataFrame]:
    nodes = t.pick("parent_id", "source_file")
    files = nodes.where(F.contains("source_file", F.lit("/sessions/"))).select("source_file").distinct()
    return nodes, store.delete_by_files(nodes, files)


@query(_GONE + " select id from cur where id not in (select id from gone)")
def forget_files(t: Tables) -> DataFrame:
    """The nodes that stay when some files go, with what is below them elsewhere."""
    return _without_sessions(t)[1].select("id")


@query(_GONE + " select source_file, count(*) as purged from cur where id in (select id from gone) group by all")
def purged_by_file(t: Tables) -> DataFrame:
    """How many nodes of each file go with them."""
    return store.purge_counts(*_without_sessions(t))


@query("select arg_max(compile_root, id) as compile_root from snapshots where compile_root <> ''")
def latest_root(t: Tables) -> DataFrame:
    """The root of the last snapshot that names one."""
    return store.latest_root(t.snapshots)


@query(f"with {sq._NOW_NODES}, s as (select source_file, list_sort(list(temperature)) as ts from cur where temperature is not null group by all) select source_file, ts[len(ts) // 2 + 1] as median from s")
def median_by_file(t: Tables) -> DataFrame:
    """The upper median of each file's temperatures."""
    return stats.upper_medians(t.pick("source_file", "temperature"), ["source_file"], "temperature")


@query(
    """with e as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from events where user_id is not null and ts is not null),
b as (select user_id, ts, count(*) filter (before is null or ts >= before + interval 12 hour) over (partition by user_id order by ts range between unbounded preceding and current row) as burst from e)
select user_id as node_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as start, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as last, count(*) as n from b group by user_id, burst"""
)
def stream_bursts(t: Tables) -> DataFrame:
    """Bursts of reads that end with half a quiet day, after the event log ran through the stream."""
    rows = reads.bursts_drained(reads.event_stream(t.spark, f"{t.d}/events.parquet"), "user_id", hours=12)
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return rows.select("node_id", shown("start"), shown("last"), "n")


_RESOLVED = f"resolved as ({sq.SQL['resolve_refs']})"
_PENDING = "p as (select distinct on (id) id, source_node_id, weight, origin from pending_relations order by id)"


@query(f"with {_RESOLVED}, {_PENDING} select p.id, source_node_id, target_id as target_node_id, case when weight = 0 then 1.0 else weight end as weight, origin from p join resolved using (id) where target_id is not null")
def edges_from_pending(t: Tables) -> DataFrame:
    """The edges that pending references become once their targets are there."""
    return graph.settle(t.pending, t.pick("node_type", "label", "source_file", "depth"))[0]


@query(f"with {_RESOLVED}, {_PENDING} select id from p where id not in (select id from resolved where target_id is not null)")
def pending_left(t: Tables) -> DataFrame:
    """The references that stay pending."""
    return graph.settle(t.pending, t.pick("node_type", "label", "source_file", "depth"))[1].select("id")


_LINKS = f"select distinct node_id || chr(1) || label || chr(1) || coalesce(source, '') || chr(1) || coalesce(id_hint, '') as id, id_hint as target_id_hint, source as target_source, label as target_label from ({sq.SQL['wikilink_extract']})"


@query(f"with l as (select distinct node_id, label, source, id_hint from ({sq.SQL['wikilink_extract']})), r as ({sq.SQL['resolve_refs'].replace('from pending_relations)', f'from ({_LINKS}))', 1)}) select node_id, label, source, target_id from l join r on r.id = node_id || chr(1) || label || chr(1) || coalesce(source, '') || chr(1) || coalesce(id_hint, '')")
def link_targets(t: Tables) -> DataFrame:
    """The links in the nodes' contents with the nodes they mean; null where they would be pending."""
    inner = t.pick("content").select(F.col("id").alias("node_id"), F.explode(text.wiki_links(F.col("content"))).alias("inner"))
    links = inner.select("node_id", text.link_parts(F.col("inner")).alias("p")).select("node_id", "p.label", "p.source", "p.id_hint").distinct()
    blank = lambda c: F.coalesce(c, F.lit(""))
    links = links.withColumn("id", F.concat_ws("\u0001", "node_id", "label", blank("source"), blank("id_hint")))
    asked = links.select("id", F.col("id_hint").alias("target_id_hint"), F.col("source").alias("target_source"), F.col("label").alias("target_label"))
    return links.join(graph.resolve_refs(asked, t.pick("node_type", "label", "source_file", "depth")), "id").select("node_id", "label", "source", "target_id")


_REACHED = f"""with {sq._NOW_NODES}, {sq._EDGES}, {sq._related_sql('out')}, {sq._related_sql('in')},
reached as (select anchor_id, node_id, min(hop) as hop, max(weight) as weight from (from out_walk union all from in_walk) where anchor_id <> node_id group by all),
near as (select *, row_number() over (partition by anchor_id order by hop, weight desc, node_id) as rank from reached where node_id in (select id from cur) qualify rank <= {graph.MOST_RELATED})"""


def _near(t: Tables) -> DataFrame:
    nodes = t.pick("token_count", "pinned")
    return graph.nearest(graph.related(t.relations, nodes.where("pinned").select("id"), 2, 0.5, "both"), nodes.select("id", "token_count"))


@query(_REACHED + f", fit as (select anchor_id, node_id, cast(rank as int) as rank, sum(coalesce(token_count, 0)) over (partition by anchor_id order by rank) as upto from near join cur on cur.id = node_id) select anchor_id, node_id, rank from fit where upto <= {sq.BUDGET}")
def related_budgeted(t: Tables) -> DataFrame:
    """Of each pinned node's nearest hundred as many as a budget holds, in their order."""
    return retrieval.prefix_budget(_near(t), sq.BUDGET, ["rank"], group=["anchor_id"]).select("anchor_id", "node_id", "rank")


@query(_REACHED + ", hit as (select distinct node_id as id from near) select c.id, round(case when hit.id is not null then least(1, temperature + 0.15e0) else temperature end, 6) as temperature, access_count + (hit.id is not null)::int as access_count from cur c left join hit using (id)")
def related_boosted(t: Tables) -> DataFrame:
    """The nodes after that answer: all of the nearest hundred are warmed, also those that the budget left out."""
    boosted = heat.boost(t.pick("temperature", "access_count", "last_accessed_at"), _near(t).select(F.col("node_id").alias("id")), sq.NOW)
    return boosted.select("id", F.round("temperature", 6).alias("temperature"), "access_count")


@query(
    """with f as (select distinct source_file, string_split(source_file, '/')[:-2] as ps from documents where source_file is not null),
n as (select list(ps) as all_, min(len(ps)) as m from f),
c as (select coalesce(max(k), 0) as k from (select unnest(range(1, m + 1)) as k, all_ from n) where len(list_distinct(list_transform(all_, lambda p: array_to_string(p[1:k], '/')))) = 1)
select source_file, case when array_to_string(ps[1:k], '/') = '' then source_file else substr(source_file, length(array_to_string(ps[1:k], '/')) + 2) end as below from f, c"""
)
def below_common_folder(t: Tables) -> DataFrame:
    """The corpus' files without the longest folder that they share."""
    files = t.raw("documents").where(F.col("source_file").isNotNull()).select("source_file").distinct()
    root = text.common_folder(files, "source_file")
    return files.select("source_file", text.strip_root(F.col("source_file"), F.lit(root)).alias("below"))


@query(
    f"""with {sq._NOW_NODES}, s as (select source_file, sum(strlen(content))::bigint as n from cur group by all)
select source_file, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KB', floor(n / 1024e0 * 10 + 0.5e0) / 10) else printf('%.1f MB', floor(n / 1048576e0 * 10 + 0.5e0) / 10) end as size from s"""
)
def file_sizes(t: Tables) -> DataFrame:
    """The size of each file's contents, as text."""
    per = t.pick("source_file", "content").groupBy("source_file").agg(F.sum(F.octet_length("content").cast("long")).alias("n"))
    return per.select("source_file", text.human_bytes(F.col("n")).alias("size"))


@query(f"with {sq._NOW_NODES} select id as node_id, left(content_hash, 8) || ' ' || rpad(coalesce(label, ''), greatest(24, length(coalesce(label, '')))::int, ' ') as line from cur")
def hash_lines(t: Tables) -> DataFrame:
    """Short hash and padded label of each node."""
    return t.pick("content_hash", "label").select(F.col("id").alias("node_id"), F.concat(text.short_hash(F.col("content_hash")), F.lit(" "), text.pad(F.col("label"), 24)).alias("line"))
