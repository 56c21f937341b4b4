"""Queries of the numbered core problems (1, 4, 5) with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import Scratch
from ..operators import changefeed, hierarchy, orphans
from ..tables import current_rows, read


def _hierarchy(spark: SparkSession, d: str, paths: bool = True) -> DataFrame:
    return hierarchy.resolve_hierarchy(current_rows(read(spark, d, "nodes"), "parent_id", "depth"), extra=("depth",), paths=paths)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose stored depth is wrong, and nodes whose chain of parents never ends."""
    return hierarchy.wrong_depths_and_loops(_hierarchy(spark, d, paths=False))


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each current node with its state, root, depth and path of ids."""
    h = _hierarchy(spark, d)
    return h.select("node_id", "status", "anchor_id", F.col("steps").alias("real_depth"), F.array_join("path", "/").alias("id_path"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Each node under each of its ancestors, with the distance."""
    return hierarchy.descendants(_hierarchy(spark, d))


def _existing(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that exist, from the version that the feed published."""
    state = changefeed.latest_state(read(spark, d, "diffs"), read(spark, d, "snapshots"))
    version = changefeed.publish(state, Scratch(spark, "mirror").base)
    return changefeed.existing_nodes(spark.read.schema(changefeed.STATE_SCHEMA).parquet(version))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that exist after all changes, from the version that the feed published."""
    return _existing(spark, d)


def p4_content(spark: SparkSession, d: str) -> DataFrame:
    """The same nodes with their content."""
    return changefeed.with_content(_existing(spark, d), read(spark, d, "diffs"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_records(read(spark, d, "nodes"), read(spark, d, "relations"), read(spark, d, "pending_relations"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each record whose reference finds no node."""
    return _orphans(spark, d)


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan records per table and month."""
    return orphans.orphan_counts(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p4_found, p4_content, p5_found, p5_counts)}

_CURRENT = """cur as (
  select id, nullif(parent_id, '') as pid, depth, node_type, label, source_file, created_at from (
    select *, row_number() over (partition by id order by updated_at desc) as rn from nodes) where rn = 1)"""

_FOREST = f"""with recursive {_CURRENT},
down as (
  select id, id as root, 0 as steps, id as id_path from cur where pid is null
  union all
  select c.id, d.root, d.steps + 1, d.id_path || '/' || c.id from cur c join down d on c.pid = d.id),
broken as (
  select id, id as root, 0 as steps, id as id_path from cur where pid is not null and pid not in (select id from cur)
  union all
  select c.id, d.root, d.steps + 1, d.id_path || '/' || c.id from cur c join broken d on c.pid = d.id),
cyc as (select id, pid from cur where id not in (select id from down) and id not in (select id from broken)),
walk as (
  select id as start, id as here from cyc
  union
  select w.start, c.pid from walk w join cyc c on c.id = w.here),
on_loop as (select c.id from cyc c join walk w on w.start = c.pid and w.here = c.id),
anchors as (select start as id, min(here) as anchor_id from walk where here in (select id from on_loop) group by start)
"""

_LAST = """with changes as (
  select snapshot_id, node_id, lower(trim(op)) as op, min(id) as diff_id from diffs
  where snapshot_id in (select id from snapshots) and lower(trim(op)) in ('add', 'mod', 'rem')
  group by snapshot_id, node_id, lower(trim(op)), old_hash, new_hash),
last as (
  select node_id, op, diff_id from (
    select *, row_number() over (partition by node_id order by snapshot_id desc, diff_id desc) as rn from changes) where rn = 1)
"""

_ORPHANS = f"""with {_CURRENT},
heads as (select lower(trim(label)) as label, source_file from cur where node_type = 'heading'),
lost as (
  select 'nodes' as table_name, id as record_id, created_at from cur where pid is not null and pid not in (select id from cur)
  union all
  select 'relations', cast(id as varchar), created_at from relations where target_node_id is null or target_node_id not in (select id from cur)
  union all
  select 'pending_relations', cast(id as varchar), created_at from pending_relations p
  where case
    when nullif(target_id_hint, '') is not null then target_id_hint not in (select id from cur)
    when nullif(target_source, '') is not null then not exists (
      select 1 from heads h where h.label = lower(trim(p.target_label))
      and (h.source_file = p.target_source or ends_with(h.source_file, '/' || p.target_source)))
    else not exists (select 1 from heads h where h.label = lower(trim(p.target_label))) end),
found as (select distinct table_name, strftime(to_timestamp(created_at) at time zone 'UTC', '%Y-%m') as created_month, record_id from lost)
"""

SQL = {
    "p1_found": _FOREST
    + """select c.id as node_id, d.root as anchor_id from cur c join down d using (id) where c.depth is distinct from d.steps
union all select id, anchor_id from anchors""",
    "p1_paths": _FOREST
    + """select id as node_id, 'rooted' as status, root as anchor_id, cast(steps as bigint) as real_depth, id_path from down
union all select id, 'broken', root, steps, id_path from broken
union all select id, 'cyclic', anchor_id, null, null from anchors""",
    "p1_descendants": _FOREST
    + """, parts as (select id, steps, string_split(id_path, '/') as ids from (from down union all from broken))
select ids[i] as ancestor_id, id as node_id, cast(steps + 1 - i as bigint) as distance
from (select *, unnest(range(1, steps + 1)) as i from parts)""",
    "p4_found": _LAST + "select node_id, diff_id from last where op <> 'rem'",
    "p4_content": _LAST
    + """select l.node_id, l.diff_id, d.content from last l
join (select id, max(new_content) as content from diffs group by id) d on d.id = l.diff_id where l.op <> 'rem'""",
    "p5_found": _ORPHANS + "from found",
    "p5_counts": _ORPHANS + "select table_name, created_month, count(*) as orphans from found group by all",
}
