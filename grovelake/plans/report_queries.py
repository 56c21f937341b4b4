"""Reports over the store: texts and JSON bodies, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import heat, render, stats, store, versions
from ..sources import logs
from . import store_queries as sq
from .problems import _FOREST
from .store_queries import Tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


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


@query(f"with {sq._NOW_NODES} select id as node_id, repeat('  ', greatest(depth - 1, 0)) || '[' || id || '] ' || node_type || ': ' || coalesce(label, '') || ' (' || coalesce(token_count, 0) || ' tok)' as line from cur")
def compact_lines(t: Tables) -> DataFrame:
    """One line per node."""
    return render.compact_lines(t.pick("node_type", "depth", "label", "token_count").withColumnRenamed("id", "node_id")).select("node_id", "line")


@query(
    _FOREST
    + """, rows as (select c.id, d.root, d.steps, d.id_path, c.pid from down d join cur c using (id) where d.steps < 5),
full_now as (select * from (select *, row_number() over (partition by id order by updated_at desc) as rn from nodes) where rn = 1)
select root as root_id, r.id as node_id, id_path, repeat('  ', steps) || '[' || r.id || '] ' || n.node_type || ': ' || coalesce(n.label, '') || ' (' || coalesce(n.token_count, 0) || ' tok)' ||
  case when u.source_file is not distinct from n.source_file then '' else '  ' || coalesce(n.source_file, '') end as line
from rows r join full_now n on n.id = r.id left join full_now u on u.id = r.pid"""
)
def tree_lines(t: Tables) -> DataFrame:
    """The trees down to five levels, as text."""
    return render.tree_lines(t.pick("parent_id", "node_type", "label", "source_file", "token_count")).select("root_id", "node_id", F.array_join("path", "/").alias("id_path"), "line")


@query(f"with {sq._SNAPS} select id, message, created_at, id = (select max(id) from snaps) as is_head from snaps order by id desc limit 20")
def snapshots_limited(t: Tables) -> DataFrame:
    """The newest twenty snapshots."""
    return render.snapshot_list(t.snapshots, t.last_snapshot(), 20).select("id", "message", "created_at", "is_head")


@query(f"with {sq._SNAPS} select id, id = (select max(id) from snaps) as is_head from snaps")
def snapshots_all(t: Tables) -> DataFrame:
    """All snapshots."""
    return render.snapshot_list(t.snapshots, t.last_snapshot()).select("id", "is_head")


@query(f"with {sq._CHANGES} select snapshot_id, count(*) filter (op = 'add') as added, count(*) filter (op = 'mod') as modified, count(*) filter (op = 'rem') as removed from ch group by all")
def snapshot_diffs(t: Tables) -> DataFrame:
    """Changes per snapshot."""
    n = lambda op: F.count_if(F.col("op") == op)
    return t.changes().groupBy("snapshot_id").agg(n("add").alias("added"), n("mod").alias("modified"), n("rem").alias("removed"))


@query(
    f"""with {sq._NOW_NODES}, {sq._CHANGES}, {sq._SNAPS},
touched as (select source_file, max(snapshot_id) as sid from cur join ch on ch.node_id = cur.id group by all),
f as (select c.source_file, count(*) as nodes, sum(cast(token_count as bigint))::bigint as tokens, coalesce(any_value(compile_root), '') as compile_root
  from cur c left join touched using (source_file) left join snaps on snaps.id = sid group by c.source_file)
select compile_root, count(*) as files, sum(nodes)::bigint as nodes, sum(tokens)::bigint as tokens from f group by all"""
)
def files_by_root(t: Tables) -> DataFrame:
    """Files, nodes and tokens per compile root."""
    return render.files_by_root(store.file_summaries(t.pick("source_file", "token_count"), t.changes(), t.snapshots))


@query(f"with {sq._NOW_NODES} select source_file, cast(sum(cast(temperature as decimal(18, 4))) as double) / count(*) as avg_temperature, count(*) filter (temperature >= 0.5) as hot, count(*) filter (temperature < 0.1) as cold, count(*) filter (pinned) as pinned from cur group by all")
def temperature_by_file(t: Tables) -> DataFrame:
    """Heat per file."""
    x = F.col("temperature")
    return t.pick("source_file", "temperature", "pinned").groupBy("source_file").agg((F.sum(x.cast("decimal(18,4)")).cast("double") / F.count("*")).alias("avg_temperature"), F.count_if(x >= stats.HOT).alias("hot"), F.count_if(x < heat.COLD).alias("cold"), F.count_if(F.col("pinned")).alias("pinned"))


@query()
def diff_texts(t: Tables) -> DataFrame:
    """The changes of the middle half of the snapshots as text."""
    last = t.last_snapshot()
    return render.diff_texts(versions.net_diff(t.changes("old_content", "new_content"), last // 4, last * 3 // 4))


@query()
def graph_json(t: Tables) -> DataFrame:
    """Links and pending references as JSON rows."""
    return render.json_rows(t.relations, "relation").unionByName(render.json_rows(t.pending, "pending"))


@query()
def stats_text(t: Tables) -> DataFrame:
    """The store's figures as text."""
    created = t.raw("snapshots").agg(F.max("created_at")).first()[0]
    return render.stats_text(stats.global_stats(t.pick("temperature", "pinned", "token_count"), t.snapshots, t.pending), sq.NOW, created)


@query(
    f"""with {sq._NOW_NODES}, top as (select source_file from cur group by all order by sum(token_count) desc, source_file limit 1),
r as (select source_file, id as node_id, token_count, percent_rank() over (order by token_count, id) as r from cur where source_file = (from top)) select source_file, node_id, token_count from r where r between 0.25 and 0.5"""
)
def mid_size_nodes(t: Tables) -> DataFrame:
    """Middling nodes of the largest file."""
    return render.mid_size_nodes(t.pick("source_file", "token_count"))


@query("select event_id, event_type from events order by event_id desc limit 1000")
def log_tail(t: Tables) -> DataFrame:
    """The newest thousand events."""
    return logs.last_rows(t.raw("events"), "event_id")[0].select("event_id", "event_type")


@query("select greatest(count(*) - 1000, 0) as dropped from events")
def log_dropped(t: Tables) -> DataFrame:
    """How many events that tail leaves out."""
    return logs.last_rows(t.raw("events"), "event_id")[1]


@query(
    f"""with {sq._NOW_NODES} select id as node_id, case when starts_with(source_file, '/srv/vaults/') then substr(source_file, 13) else source_file end as below,
case when strlen(label) < 1024 then strlen(label) || ' B' end as size from cur"""
)
def relative_paths(t: Tables) -> DataFrame:
    """Paths below one root, and the labels' sizes as text."""
    from ..functions import text

    return t.pick("source_file", "label").select(F.col("id").alias("node_id"), text.strip_root(F.col("source_file"), F.lit("/srv/vaults")).alias("below"), text.human_bytes(F.octet_length("label")).alias("size"))
