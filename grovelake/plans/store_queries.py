"""Queries over the store's tables with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import Scratch, hadoop_fs
from ..functions import redaction, text
from ..operators import graph, heat, retrieval, search, stats, store, versions
from ..tables import read
from .problems import _CURRENT, _FOREST

#: The time at which scores are taken, seconds since 1970.
NOW = 1_780_000_000
#: Tokens of an answer.
BUDGET = 1_000
QUERY = "retry budget snapshot"
SCORED = ["temperature", "last_accessed_at", "token_count"]
FETCHED = ["parent_id", "temperature", "last_accessed_at", "token_count"]


class Tables:
    """The tables of one folder in the forms the operators take."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    def raw(self, name: str) -> DataFrame:
        return read(self.spark, self.d, name)

    @property
    def nodes(self) -> DataFrame:
        return store.nodes_now(self.raw("nodes"))

    def pick(self, *columns: str) -> DataFrame:
        """Current nodes with id and these columns; nothing else is read or shuffled."""
        return store.nodes_now(self.raw("nodes").select("id", "updated_at", *columns)).drop(*({"updated_at"} - set(columns)))

    def changes(self, *columns: str) -> DataFrame:
        """Distinct changes with their key and these columns; nothing else is read or shuffled."""
        return store.changes_once(self.raw("diffs").select("id", "snapshot_id", "node_id", "op", "old_hash", "new_hash", *columns))

    @property
    def snapshots(self) -> DataFrame:
        return store.snapshots_once(self.raw("snapshots"))

    @property
    def relations(self) -> DataFrame:
        return store.upsert_relations(self.raw("relations"))

    @property
    def pending(self) -> DataFrame:
        return self.raw("pending_relations").dropDuplicates(["id"])

    def of(self, ids: DataFrame, *columns: str) -> DataFrame:
        """``pick`` of a small set of ids: all other rows are left out before versions are compared."""
        rows = self.raw("nodes").select("id", "updated_at", *columns).join(F.broadcast(ids), "id", "left_semi")
        return store.nodes_now(rows).drop(*({"updated_at"} - set(columns)))

    def index(self, stemmed: bool = False) -> search.Index:
        """The search index of the nodes, written by the application's first search and kept while the table stays as it is."""
        fs, path = hadoop_fs(self.spark, f"{self.d}/nodes.parquet")
        key = (self.spark.sparkContext.applicationId, self.d, fs.getFileStatus(path).getModificationTime(), fs.getContentSummary(path).getLength(), stemmed)
        if key not in _indexes:
            _indexes[key] = Scratch(self.spark, "index").base
            search.write_index(self.pick(*search.SEARCHED), _indexes[key], stemmed)
        return search.Index(self.spark, _indexes[key], stemmed)

    def last_snapshot(self) -> int:
        return self.raw("snapshots").agg(F.max("id")).first()[0] or 0


_indexes: dict[tuple, str] = {}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(Tables(spark, d))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_NOW_NODES = """cur as (
  select * exclude (rn, parent_id), nullif(parent_id, '') as pid from (
    select *, row_number() over (partition by id order by updated_at desc) as rn from nodes) where rn = 1)"""
_CHANGES = """ch as (
  select * exclude (rn) from (
    select * exclude (op), lower(trim(op)) as op, row_number() over (partition by snapshot_id, node_id, lower(trim(op)), old_hash, new_hash order by id) as rn from diffs)
  where rn = 1 and op in ('add', 'mod', 'rem'))"""
_SNAPS = "snaps as (select distinct on (id) * from snapshots)"
_EDGES = "edges as (select source_node_id, target_node_id, origin, min(id) as id, arg_max(weight, id) as weight, arg_min(created_at, id) as created_at from relations group by all)"
_SCORE = f"(0.3e0 + 0.7e0 * greatest(0e0, least(1e0, temperature))) * case when last_accessed_at is null then 1e0 else 1e0 / (1e0 + greatest(({NOW} - last_accessed_at) / 3600e0, 0e0) / 24e0) end"
_TOKENS = r"list_filter(regexp_split_to_array(lower(concat_ws(chr(10), label, content, node_type)), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
_LAST_ID = "(select max(id) from snapshots)"


@query("select node_type, format, count(*) as nodes, sum(cast(ceil(coalesce(strlen(content), 0) * 0.25) as bigint)) as tokens from nodes group by all")
def token_estimate_by_type(t: Tables) -> DataFrame:
    """Estimated tokens of all stored rows by type and format."""
    return t.raw("nodes").groupBy("node_type", "format").agg(F.count("*").alias("nodes"), F.sum(text.token_estimate(F.col("content")).cast("long")).alias("tokens"))


@query("select lang, count(*) as docs, sum(cast(ceil(coalesce(strlen(text), 0) * 0.25) as bigint)) as tokens from documents group by all")
def token_estimate_by_lang(t: Tables) -> DataFrame:
    """Estimated tokens of the corpus by language as given."""
    return t.raw("documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(text.token_estimate(F.col("text")).cast("long")).alias("tokens"))


@query(
    r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|\z)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\A\n+|\n+\z', '', 'g')) as normal_md5 from documents"""
)
def normalize_text(t: Tables) -> DataFrame:
    """Digest of each document's normal form."""
    return t.raw("documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("normal_md5"))


@query(f"with {_NOW_NODES} select id as node_id, round({_SCORE}, 6) as score from cur")
def heat_score(t: Tables) -> DataFrame:
    """Score of each node without a query."""
    s = retrieval.score(F.lit(1.0), F.col("temperature"), F.col("last_accessed_at"), NOW)
    return t.pick("temperature", "last_accessed_at").select(F.col("id").alias("node_id"), F.round(s, 6).alias("score"))


@query(
    f"""with {_NOW_NODES} select count(*) as nodes, round(cast(sum(cast(temperature as decimal(18, 4))) as double) / count(*), 4) as avg_temperature,
(select temperature from cur order by temperature limit 1 offset (select count(*) // 2 from cur)) as median_temperature,
count(*) filter (temperature >= 0.5) as hot, count(*) filter (temperature < 0.1) as cold, count(*) filter (pinned) as pinned, sum(cast(token_count as bigint))::bigint as tokens,
(select count(distinct id) from snapshots) as snapshots, (select count(distinct id) from pending_relations) as pending from cur"""
)
def global_stats(t: Tables) -> DataFrame:
    """Counts and temperatures of the whole store."""
    return stats.global_stats(t.pick("temperature", "pinned", "token_count"), t.snapshots, t.pending).withColumn("avg_temperature", F.round("avg_temperature", 4))


@query(f"with {_NOW_NODES} select node_type, count(*) as n from cur group by all")
def counts_by_type(t: Tables) -> DataFrame:
    """Nodes by type."""
    return stats.counts(t.pick("node_type"), "node_type")


@query(f"with {_EDGES} select origin, count(*) as n from edges group by all")
def counts_by_origin(t: Tables) -> DataFrame:
    """Edges by origin."""
    return stats.counts(t.relations, "origin")


@query("select distinct compile_root from snapshots where compile_root <> ''")
def compile_roots(t: Tables) -> DataFrame:
    """The roots that were ever compiled."""
    return t.raw("snapshots").where(F.col("compile_root") != "").select("compile_root").distinct()


@query(
    f"""with {_NOW_NODES}, {_CHANGES}, {_SNAPS},
touched as (select source_file, max(snapshot_id) as sid from cur join ch on ch.node_id = cur.id group by all)
select c.source_file, count(*) as nodes, sum(cast(token_count as bigint))::bigint as tokens, coalesce(any_value(compile_root), '') as compile_root
from cur c left join touched using (source_file) left join snaps on snaps.id = sid group by c.source_file"""
)
def file_summaries(t: Tables) -> DataFrame:
    """Nodes, tokens and compile root of each file."""
    return store.file_summaries(t.pick("source_file", "token_count"), t.changes(), t.snapshots)


@query(f"with {_NOW_NODES}, {_CHANGES}, {_SNAPS}, last as (select node_id, max(snapshot_id) as sid from ch group by all) select cur.id as node_id, compile_root from cur join last on node_id = cur.id join snaps on snaps.id = sid")
def latest_state_by_root(t: Tables) -> DataFrame:
    """Each node under the root of the last snapshot that touched it."""
    return store.nodes_by_compile_root(t.pick(), t.changes(), t.snapshots)


@query(f"with {_NOW_NODES}, per as (select pid, count(*) - 1 as n from cur where pid is not null group by all) select id as node_id, coalesce(n, 0) as siblings from cur left join per using (pid)")
def siblings(t: Tables) -> DataFrame:
    """How many siblings each node has."""
    return store.sibling_counts(t.pick("parent_id"))


@query(
    f"""with recursive {_NOW_NODES}, d as (
select r.id as anchor_id, c.id as node_id, 1 as level from cur r join cur c on c.pid = r.id where r.pid is null
union all select d.anchor_id, c.id, d.level + 1 from d join cur c on c.pid = d.node_id where d.level < 3) from d"""
)
def descendants_bounded(t: Tables) -> DataFrame:
    """Nodes at most three levels below each root."""
    nodes = t.pick("parent_id")
    return store.descendants_bounded(nodes, nodes.where(F.col("parent_id").isNull()).select("id"), 3)


@query(_FOREST + ", pos as (select root as root_id, id as node_id, cast(steps as bigint) as depth, row_number() over (partition by root order by string_split(id_path, '/')) - 1 as position from down) from pos")
def tree_preorder(t: Tables) -> DataFrame:
    """Each tree in pre-order."""
    return store.tree_preorder(t.pick("parent_id"))


def _busiest(t: Tables) -> str:
    kids = t.pick("parent_id").where(F.col("parent_id").isNotNull()).groupBy("parent_id").count().join(t.pick("parent_id").select(F.col("id").alias("parent_id")), "parent_id")
    top = kids.orderBy(F.col("count").desc(), "parent_id").first()
    return top[0] if top else t.pick("parent_id").agg(F.min("id")).first()[0]


_CONTEXT = (
    _FOREST.replace("with recursive", f"with recursive full_ as (select * exclude (rn, parent_id), nullif(parent_id, '') as pid from (select *, row_number() over (partition by id order by updated_at desc) as rn from nodes) where rn = 1),", 1)
    + """, anchor as (select pid as id from cur where pid in (select id from cur) group by pid order by count(*) desc, pid limit 1),
paths as (select id, string_split(id_path, '/') as p from (from down union all from broken)),
ctx as (
  select unnest(p) as id, 0 as r from paths where id = (select id from anchor)
  union all select id, 1 from paths where list_position(p, (select id from anchor)) > 0 and len(p) - list_position(p, (select id from anchor)) <= 32
  union all select id, 2 from cur where pid = (select pid from cur where id = (select id from anchor))),
context as (select id, min(r) as r from ctx where id <> (select id from anchor) group by id)
"""
)


@query(_CONTEXT + "select id as node_id, ['ancestor', 'descendant', 'sibling'][r + 1] as relation from context")
def fetch_context(t: Tables) -> DataFrame:
    """Ancestors, descendants and siblings of the node with the most children."""
    return retrieval.context(t.pick("parent_id"), _busiest(t))


@query(
    _CONTEXT
    + f""", cand as (select f.id, r, token_count as n, {_SCORE} as s from context join full_ f using (id)),
room as (select {BUDGET} - token_count as room from full_ where id = (select id from anchor)),
ranked as (select *, row_number() over (order by s desc, id) as rn from cand),
fill as (
  select 0::bigint as rn, (select room from room)::bigint as room, null::varchar as id
  union all
  select f.rn + 1, case when r.n <= f.room then f.room - r.n else f.room end, case when r.n <= f.room then r.id end from fill f join ranked r on r.rn = f.rn + 1),
kept as (select ['ancestor', 'descendant', 'sibling'][r + 1] as relation, id as node_id, s, n as token_count from cand where id in (select id from fill)
  union all select 'anchor', id, null, token_count from full_ where id = (select id from anchor))
select node_id, relation, round(s, 6) as score, token_count, row_number() over (order by s nulls last, node_id desc) - 1 as position from kept"""
)
def fetch(t: Tables) -> DataFrame:
    """The same node with as much of its context as the budget holds."""
    return retrieval.fetch(t.pick(*FETCHED), _busiest(t), BUDGET, NOW).withColumn("score", F.round("score", 6))


@query(
    f"""with recursive {_NOW_NODES}, firsts as (select target_node_id as id, min(id) as first from relations group by all order by first limit {retrieval.MOST_IDS}),
asked as (select id, row_number() over (order by first) - 1 as position from firsts),
rows as (select a.position, a.id, c.id is not null as here, c.token_count as n from asked a left join cur c using (id)),
fill as (
  select -1::bigint as position, 0::bigint as used, null::varchar as node_id, null::varchar as status, null::bigint as n
  union all
  select r.position, f.used + case when r.here and f.used + r.n <= {BUDGET * 4} then r.n else 0 end, r.id,
    case when not r.here then 'missing' when f.used + r.n <= {BUDGET * 4} then 'kept' else 'over_budget' end, r.n
  from fill f join rows r on r.position = f.position + 1)
select cast(position as int) as position, node_id, status, n as token_count from fill where position >= 0"""
)
def fetch_batch(t: Tables) -> DataFrame:
    """The first link targets as one batch, in the links' order."""
    firsts = t.raw("relations").groupBy("target_node_id").agg(F.min("id").alias("at")).orderBy("at").limit(retrieval.MOST_IDS)
    return retrieval.fetch_batch(t.pick("token_count"), [r[0] for r in firsts.collect()], BUDGET * 4)


def _search_sql(words: list[str], every: bool) -> str:
    tf = [f"len(list_filter(tokens, lambda t: t = '{w}'))" for w in words]
    idf = [f"(select greatest(ln((count(*) - count(*) filter (list_contains(tokens, '{w}')) + 0.5e0) / (count(*) filter (list_contains(tokens, '{w}')) + 0.5e0)), 1e-6) from toks)" for w in words]
    norm = "(1.2e0 * (0.25e0 + 0.75e0 * len(tokens) / (select avg(len(tokens)) from toks)))"
    total = " + ".join(f"{i} * {f} * 2.2e0 / ({f} + {norm})" for i, f in zip(idf, tf))
    match = (" and " if every else " or ").join(f"list_contains(tokens, '{w}')" for w in words)
    return f"toks as (select *, {_TOKENS} as tokens from cur), hits as (select *, {total} as relevance from toks where {match})"


_WORDS = search.query_terms(QUERY)


@query(f"with {_NOW_NODES}, {_search_sql(_WORDS, False)} select id as node_id, round(relevance, 6) as relevance from hits")
def search_terms_or(t: Tables) -> DataFrame:
    """Relevance of all nodes with any of the words."""
    return t.index().relevance(_WORDS).withColumn("relevance", F.round("relevance", 6))


@query(f"with {_NOW_NODES}, {_search_sql(_WORDS[:2], True)} select id as node_id, round(relevance, 6) as relevance from hits")
def search_terms_and(t: Tables) -> DataFrame:
    """Relevance of all nodes with both words."""
    return t.index().relevance(_WORDS[:2], require_all=True).withColumn("relevance", F.round("relevance", 6))


@query(
    f"""with recursive {_NOW_NODES}, {_search_sql(_WORDS, False)},
top as (from hits order by relevance desc, id limit 50),
ranked as (select id, relevance, token_count as n, relevance * {_SCORE} as s, row_number() over (order by relevance * {_SCORE} desc, id) as rn from top),
fill as (
  select 0::bigint as rn, {BUDGET}::bigint as room, null::varchar as id
  union all
  select f.rn + 1, case when r.n <= f.room then f.room - r.n else f.room end, case when r.n <= f.room then r.id end from fill f join ranked r on r.rn = f.rn + 1)
select r.id as node_id, round(relevance, 6) as relevance, round(s, 6) as score, n as token_count from ranked r where r.id in (select id from fill)"""
)
def search_budgeted(t: Tables) -> DataFrame:
    """The most relevant nodes, rescored, as many as the budget holds."""
    found = search.search(t.index(), lambda ids: t.of(ids, *SCORED), QUERY, BUDGET, NOW)
    return found.withColumn("relevance", F.round("relevance", 6)).withColumn("score", F.round("score", 6))


@query(f"with {_NOW_NODES}, toks as (select id, {_TOKENS} as tokens from cur) select id as node_id from toks where contains(' ' || array_to_string(tokens, ' ') || ' ', ' retry budget ')")
def search_phrase(t: Tables) -> DataFrame:
    """Nodes with two words next to each other."""
    return t.index().phrase("retry", "budget")


@query(f"with {_NOW_NODES}, toks as (select id, {_TOKENS} as tokens from cur) select id as node_id from toks where len(list_filter(tokens, lambda t: starts_with(t, 'snap'))) > 0")
def search_prefix(t: Tables) -> DataFrame:
    """Nodes with a word that begins so."""
    return t.index().prefix("snap")


@query(
    f"""with {_NOW_NODES}, toks as (select id, {_TOKENS} as tokens from cur) select id as node_id from toks
where len(list_filter(range(1, len(tokens) + 1), lambda i: tokens[i] = 'retry' and list_contains(tokens[greatest(1, i - 11):i + 11], 'snapshot'))) > 0"""
)
def search_near(t: Tables) -> DataFrame:
    """Nodes with two words close to each other."""
    return t.index().near("retry", "snapshot", 10)


@query(f"with {_NOW_NODES}, toks as (select id, {_TOKENS} as tokens from cur) select id as node_id from toks where (list_contains(tokens, 'retry') or list_contains(tokens, 'rollback')) and list_contains(tokens, 'budget') and not list_contains(tokens, 'snapshot')")
def search_boolean(t: Tables) -> DataFrame:
    """Nodes with (one word or another) and a third, but not a fourth."""
    i = t.index()
    return search.without(search.both(search.either(i.word("retry"), i.word("rollback")), i.word("budget")), i.word("snapshot"))


@query(
    rf"""with {_NOW_NODES}, toks as (select id, {_TOKENS.replace("concat_ws(chr(10), label, content, node_type)", "coalesce(label, '')")} as l, {_TOKENS.replace("concat_ws(chr(10), label, content, node_type)", "coalesce(content, '')")} as c from cur)
select id as node_id from toks where list_contains(l, 'budget') and not list_contains(c, 'retry')"""
)
def search_columns(t: Tables) -> DataFrame:
    """Nodes with a word in the label that lack another in the content."""
    return search.without(t.index().word("budget", "label"), t.index().word("retry", "content"))


@query()
def porter_search(t: Tables) -> DataFrame:
    """The budgeted search over word stems."""
    return search.search(t.index(stemmed=True), lambda ids: t.of(ids, *SCORED), "rewritten entries depending", BUDGET, NOW)


@query(f"with {_NOW_NODES}, toks as (select id, {_TOKENS} as tokens from cur), words as (select id, len(tokens) as doc_len, unnest(tokens) as term from toks) select term, count(distinct id) as docs, count(*) as n from words group by all")
def postings_terms(t: Tables) -> DataFrame:
    """Documents and occurrences of each term of the inverted index."""
    return t.index().postings.where(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("docs"), F.sum(F.size("at")).alias("n"))


@query(
    f"""with recursive {_NOW_NODES}, ranked as (select id, token_count as n, row_number() over (order by {_SCORE} desc, id) as rn from cur where token_count > 0),
fill as (
  select 0::bigint as rn, {BUDGET * 4}::bigint as room, null::varchar as id
  union all
  select r.rn, f.room - r.n, r.id from fill f, lateral (select * from ranked r where r.rn > f.rn and r.n <= f.room order by rn limit 1) r)
select id as node_id, token_count from cur where id in (select id from fill) or coalesce(token_count, 0) = 0"""
)
def budget_greedy(t: Tables) -> DataFrame:
    """The hottest nodes of the whole store that fit a budget, skipping those that do not."""
    s = retrieval.score(F.lit(1.0), F.col("temperature"), F.col("last_accessed_at"), NOW)
    rows = t.pick("temperature", "last_accessed_at", "token_count").select(F.col("id").alias("node_id"), s.alias("score"), "token_count")
    return retrieval.greedy_budget(rows, BUDGET * 4).select("node_id", "token_count")


@query(f"with {_NOW_NODES}, s as (select source_file, id as node_id, sum(token_count) over (partition by source_file order by depth, id) as upto from cur) select source_file, node_id from s where upto <= 200")
def budget_prefix(t: Tables) -> DataFrame:
    """The first nodes of each file, until the budget is full."""
    rows = t.pick("source_file", "depth", "token_count").select("source_file", F.col("id").alias("node_id"), "depth", "token_count")
    return retrieval.prefix_budget(rows, 200, ["depth", "node_id"], group=["source_file"]).select("source_file", "node_id")


_STATES = f"""{_CHANGES},
half as (select node_id, arg_max(op, (snapshot_id, id)) as op, arg_max(coalesce(new_hash, ''), (snapshot_id, id)) as hash from ch where snapshot_id <= {_LAST_ID} // 2 group by all),
last as (select node_id, arg_max(op, (snapshot_id, id)) as op, arg_max(coalesce(new_hash, ''), (snapshot_id, id)) as hash from ch group by all),
deltas as (select coalesce(a.node_id, b.node_id) as node_id, case when a.node_id is null then 'add' when b.node_id is null then 'rem' when a.hash <> b.hash then 'mod' end as op
  from (from half where op <> 'rem') a full join (from last where op <> 'rem') b on a.node_id = b.node_id)"""


def _deltas(t: Tables) -> DataFrame:
    last, diffs = t.last_snapshot(), t.changes("new_content")
    return versions.diff_states(versions.state_at(diffs, last // 2), versions.state_at(diffs, 1 << 62))


@query(f"with {_STATES} from deltas where op is not null")
def diff_full_outer(t: Tables) -> DataFrame:
    """What differs between the state at half of the snapshots and the present one."""
    return _deltas(t)


@query(f"with {_STATES} select count(*) filter (op = 'add') as added, count(*) filter (op = 'mod') as modified, count(*) filter (op = 'rem') as removed, count(op) as total from deltas")
def change_counts(t: Tables) -> DataFrame:
    """The same, counted."""
    return versions.change_counts(_deltas(t))


@query(f"with {_CHANGES} select id, snapshot_id, node_id, op from ch where snapshot_id > {_LAST_ID} * 3 // 4")
def delta_since(t: Tables) -> DataFrame:
    """All changes of the last quarter of the snapshots."""
    return versions.delta_since(t.changes(), t.last_snapshot() * 3 // 4).select("id", "snapshot_id", "node_id", "op")


@query(
    f"""with {_CHANGES}, r as (from ch where snapshot_id > {_LAST_ID} // 4 and snapshot_id <= {_LAST_ID} * 3 // 4),
f as (select * from (select *, row_number() over (partition by node_id order by snapshot_id, id) as rn from r) where rn = 1),
l as (select * from (select *, row_number() over (partition by node_id order by snapshot_id desc, id desc) as rn from r) where rn = 1),
b as (select f.node_id, l.snapshot_id, case when f.op = 'add' and l.op <> 'rem' then 'add' when f.op <> 'add' and l.op = 'rem' then 'rem'
    when f.op <> 'add' and l.op <> 'rem' and coalesce(f.old_content, '') <> coalesce(l.new_content, '') then 'mod' end as op,
  f.old_hash, l.new_hash, f.old_content, l.new_content from f join l using (node_id))
select node_id, snapshot_id, op, case when op <> 'add' then old_hash end as old_hash, case when op <> 'rem' then new_hash end as new_hash,
  case when op <> 'add' then old_content end as old_content, case when op <> 'rem' then new_content end as new_content from b where op is not null"""
)
def net_diff(t: Tables) -> DataFrame:
    """One record per node that the middle half of the snapshots changed on the whole."""
    last = t.last_snapshot()
    return versions.net_diff(t.changes("old_content", "new_content"), last // 4, last * 3 // 4)


@query()
def net_diff_text(t: Tables) -> DataFrame:
    """The same as unified differences."""
    last = t.last_snapshot()
    d = versions.net_diff(t.changes("old_content", "new_content"), last // 4, last * 3 // 4)
    return d.select("node_id", "op", versions.unified_diff(F.col("old_content"), F.col("new_content")).alias("hunks"))


@query(f"with {_CHANGES} select node_id, rank, id, snapshot_id, op from (select *, cast(row_number() over (partition by node_id order by snapshot_id, id) as int) as rank from ch) where rank <= 10")
def node_history(t: Tables) -> DataFrame:
    """The first ten changes of each node."""
    return versions.history(t.changes()).select("node_id", "rank", "id", "snapshot_id", "op")


def _head(t: Tables, changes: DataFrame) -> DataFrame:
    """The mirror's present nodes: hash and content by the feed, place, type, label and size from the store's current rows."""
    present = versions.state_at(changes, 1 << 62).select("node_id", "hash", "content")
    return present.join(t.pick(*versions.META).withColumnRenamed("id", "node_id"), "node_id", "left").select("node_id", "hash", "content", *versions.META)


def _old_sides(t: Tables) -> DataFrame:
    return t.changes("old_content", "new_content", *[f"old_{c}" for c in versions.META])


_META_NOW = ", ".join(f"{'pid as parent_id' if c == 'parent_id' else c}" for c in versions.META)
_RESTORE = f"""{_NOW_NODES}, {_CHANGES}, meta as (select id as node_id, {_META_NOW} from cur),
lasts as (select * from (select *, row_number() over (partition by node_id order by snapshot_id desc, id desc) as rn from ch) where rn = 1),
head as (select l.node_id, l.new_hash as hash, l.new_content as content, m.* exclude (node_id) from lasts l left join meta m using (node_id) where l.op <> 'rem'),
firsts as (select * from (select *, row_number() over (partition by node_id order by snapshot_id, id) as rn from ch where snapshot_id > {_LAST_ID} // 2) where rn = 1),
unchanged as (select *, true as restored from head where node_id not in (select node_id from firsts)),
undone as (select f.node_id, f.old_hash as hash, f.old_content as content, {", ".join(f"f.old_{c} as {c}" for c in versions.META)}, true as restored from firsts f where f.op <> 'add' and f.old_source_file is not null),
placed as (select f.node_id, f.old_hash as hash, f.old_content as content, {", ".join(f"h.{c}" for c in versions.META)}, h.source_file is not null as restored from firsts f left join head h using (node_id) where f.op <> 'add' and f.old_source_file is null),
past as (from unchanged union all by name from undone union all by name from placed)"""


@query(f"with {_RESTORE} select node_id, hash, content, source_file, label, depth, restored from past")
def restore_at(t: Tables) -> DataFrame:
    """The mirror as it was after half of the snapshots, from the present and the old sides of later changes."""
    changes = _old_sides(t)
    past = versions.restore_at(_head(t, changes), changes, t.last_snapshot() // 2)
    return past.select("node_id", "hash", "content", "source_file", "label", "depth", "restored")


@query(
    f"""with {_RESTORE}, sides as (select 'now' as side, node_id, hash, {", ".join(versions.META)} from head union all by name select 'then' as side, node_id, hash, {", ".join(versions.META)} from past where restored),
kinds as (select node_id, count(*) as sides, min(side) as one_side, count(distinct coalesce(hash, '~') || '|' || concat_ws('|', {", ".join(f"coalesce({c}::varchar, '~')" for c in versions.META)})) as forms from sides group by node_id)
select node_id, case when sides = 2 then 'mod' when one_side = 'then' then 'add' else 'rem' end as op from kinds where sides = 1 or forms = 2"""
)
def rollback_deltas(t: Tables) -> DataFrame:
    """The changes that would lead back there: content and seven columns of metadata count."""
    changes = _old_sides(t)
    return versions.rollback_deltas(_head(t, changes), changes, versions.rollback_target(t.last_snapshot() // 2, t.last_snapshot()))


@query(
    f"""with {_RESTORE}, b as (select h.node_id from head h join past p using (node_id) where restored and p.hash is not distinct from h.hash)
select {", ".join(f"count(*) filter (p.{c} is distinct from h.{c}) as {c}" for c in versions.META)} from b join head h using (node_id) join past p using (node_id)"""
)
def rollback_moves(t: Tables) -> DataFrame:
    """Of the nodes whose content that rollback leaves alone, how many differ in each column of metadata."""
    changes = _old_sides(t)
    head = _head(t, changes)
    past = versions.restore_at(head, changes, t.last_snapshot() // 2).where("restored")
    same = head.alias("h").join(past.alias("p"), "node_id").where(F.col("h.hash").eqNullSafe(F.col("p.hash")))
    return same.agg(*[F.count_if(~F.col(f"h.{c}").eqNullSafe(F.col(f"p.{c}"))).alias(c) for c in versions.META])


@query()
def delta_hashes(t: Tables) -> DataFrame:
    """Hash of each snapshot's changes."""
    return versions.delta_hashes(t.changes())


@query(f"select distinct id from snapshots where id <= {_LAST_ID} // 2 or id = {_LAST_ID}")
def prune_snapshots(t: Tables) -> DataFrame:
    """The snapshots that stay when all after the middle go, but the last."""
    last = t.last_snapshot()
    return store.prune_after(t.snapshots, t.changes(), last // 2, last)[0].select("id")


@query(
    f"""with v as (select *, row_number() over (partition by id order by updated_at desc) as rn, row_number() over (partition by id order by updated_at) as first from (select distinct * from nodes)),
a as (from v where first = 1), b as (select v.* from v join a using (id) where v.rn = 1 and v.updated_at > a.updated_at)
select a.id, case when b.id is null then a.depth else b.depth end as depth, coalesce(b.temperature, a.temperature) as temperature, a.access_count, a.created_at, case when b.id is null then a.updated_at else {NOW} end as updated_at from a left join b using (id)"""
)
def upsert_nodes(t: Tables) -> DataFrame:
    """The oldest export with the latest rows merged into it."""
    raw = t.raw("nodes")
    cols = [c for c in raw.columns if c != "id"]
    oldest = raw.groupBy("id").agg(F.min(F.struct("updated_at", *[c for c in cols if c != "updated_at"])).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in cols])
    newer = store.nodes_now(raw).alias("n").join(oldest.select("id", F.col("updated_at").alias("_old")), "id").where(F.col("n.updated_at") > F.col("_old")).select("n.*")
    return store.upsert_nodes(oldest, newer.select(*raw.columns), NOW).select("id", "depth", "temperature", "access_count", "created_at", "updated_at")


@query(f"with {_EDGES} select id, source_node_id, target_node_id, origin, weight, created_at from edges")
def upsert_relations(t: Tables) -> DataFrame:
    """The edges after all inserts."""
    return t.relations.select("id", "source_node_id", "target_node_id", "origin", "weight", "created_at")


_COLD_IDS = "select id from full_ where temperature < 0.05 and not pinned"
_FULL = _CONTEXT.split(", anchor as (")[0]


def _cold_ids(t: Tables) -> DataFrame:
    return t.pick("temperature", "pinned").where((F.col("temperature") < 0.05) & ~F.col("pinned")).select("id")


@query(_FULL + f", gone as ({_COLD_IDS} union select c.id from cur c join gone g on c.pid = g.id where c.id not in (select id from cyc)) select id from cur where id not in (select id from gone)")
def forget_cascade(t: Tables) -> DataFrame:
    """The nodes that stay when cold ones go with everything below."""
    return store.delete_cascade(t.pick("parent_id"), _cold_ids(t)).select("id")


@query(
    _FULL
    + f""", gone as ({_COLD_IDS}),
climb as (select c.id, c.pid as here from cur c where c.id not in (select id from gone) and c.pid in (select id from gone)
  union select k.id, c.pid from climb k join cur c on c.id = k.here where k.here in (select id from gone)),
ends as (select id, max(here) filter (here not in (select id from gone) and here in (select id from cur)) as up from climb group by id)
select c.id, case when e.id is null then c.pid when c.id in (select id from cyc) then null else e.up end as parent_id from cur c left join ends e using (id) where c.id not in (select id from gone)"""
)
def forget_reparent(t: Tables) -> DataFrame:
    """The nodes that stay, with their parents, when cold ones go and their children move up."""
    return store.delete_reparent(t.pick("parent_id"), _cold_ids(t)).select("id", "parent_id")


@query(f"with {_NOW_NODES} select id from cur where not (temperature < 0.05 and not pinned) or id in (select pid from cur where pid is not null)")
def forget_strict(t: Tables) -> DataFrame:
    """The nodes that stay when only cold ones without children may go."""
    return store.delete_strict(t.pick("parent_id"), _cold_ids(t)).select("id")


@query(f"with {_NOW_NODES}, {_EDGES} select source_node_id, label as target_label, source_file as target_source, weight, origin from edges join cur on cur.id = target_node_id where temperature < 0.05 and not pinned")
def repend_edges(t: Tables) -> DataFrame:
    """The pending references that the deletion of cold nodes leaves."""
    return store.repend(t.relations, t.pick("label", "source_file"), _cold_ids(t)).drop("target_id_hint")


@query(
    f"""with {_NOW_NODES}, p as (select distinct on (id) id, nullif(target_id_hint, '') as hint, nullif(target_source, '') as file, lower(trim(coalesce(target_label, ''))) as label from pending_relations),
heads as (select id, lower(trim(label)) as label, source_file, depth from cur where node_type = 'heading' and label is not null),
by_label as (select label, arg_min(id, (source_file, depth, id)) as target from heads group by all),
by_file as (select p.id, arg_min(h.id, (h.depth, h.id)) as target from p join heads h on h.label = p.label and p.file is not null and (h.source_file = p.file or ends_with(h.source_file, '/' || p.file)) group by all)
select p.id, case when hint is not null then (select max(c.id) from cur c where c.id = p.hint) when file is not null then f.target when p.label <> '' then l.target end as target_id
from p left join by_file f using (id) left join by_label l using (label)"""
)
def resolve_refs(t: Tables) -> DataFrame:
    """The node that each pending reference means."""
    return graph.resolve_refs(t.raw("pending_relations"), t.pick("node_type", "label", "source_file", "depth"))


def _related_sql(direction: str) -> str:
    a, b = ("source_node_id", "target_node_id") if direction == "out" else ("target_node_id", "source_node_id")
    return f"""{direction}_one as (select r.{a} as anchor_id, r.{b} as node_id, 1 as hop, r.weight as weight from edges r where r.{a} in (select id from cur where pinned) and r.weight >= 0.5),
{direction}_two as (select w.anchor_id, r.{b}, 2, w.weight + r.weight from {direction}_one w join edges r on r.{a} = w.node_id where r.weight >= 0.5),
{direction}_walk as (from {direction}_one union all from {direction}_two)"""


def _related(t: Tables, direction: str) -> DataFrame:
    pinned = t.pick("pinned").where("pinned").select("id")
    return graph.related(t.relations, pinned, 2, 0.5, direction).withColumn("weight", F.round("weight", 6))


@query(f"with {_NOW_NODES}, {_EDGES}, {_related_sql('out')} select anchor_id, node_id, min(hop) as hop, round(max(weight), 6) as weight from out_walk where anchor_id <> node_id group by all")
def related_out(t: Tables) -> DataFrame:
    """Nodes within two links of each pinned node, along the links."""
    return _related(t, "out")


@query(f"with {_NOW_NODES}, {_EDGES}, {_related_sql('in')} select anchor_id, node_id, min(hop) as hop, round(max(weight), 6) as weight from in_walk where anchor_id <> node_id group by all")
def related_in(t: Tables) -> DataFrame:
    """The same against the links."""
    return _related(t, "in")


@query(f"with {_NOW_NODES}, {_EDGES}, {_related_sql('out')}, {_related_sql('in')} select anchor_id, node_id, min(hop) as hop, round(max(weight), 6) as weight from (from out_walk union all from in_walk) where anchor_id <> node_id group by all")
def related_both(t: Tables) -> DataFrame:
    """The same either way."""
    return _related(t, "both")


@query(f"with {_NOW_NODES} select id from cur where id in (select source_node_id from relations union all select target_node_id from relations union all select source_node_id from pending_relations)")
def graph_nodes(t: Tables) -> DataFrame:
    """Nodes that have links or pending references."""
    return graph.graph_nodes(t.pick(), t.relations, t.pending).select("id")


@query(f"with {_EDGES}, e as (select source_node_id as node_id, 1 as o, 0 as i from edges union all select target_node_id, 0, 1 from edges) select node_id, sum(o)::bigint as outgoing, sum(i)::bigint as incoming from e group by all")
def link_degrees(t: Tables) -> DataFrame:
    """Links per node."""
    return graph.degrees(t.relations)


@query(
    rf"""with {_NOW_NODES}, l as (select id, unnest(regexp_extract_all(content, '\[\[([^\[\]]+)\]\]', 1)) as inner_ from cur),
p as (select id, inner_, regexp_matches(inner_, ';\s*\w+\s*=') as has from l),
q as (select id, has, inner_, trim(case when has then regexp_extract(inner_, '^([^;]*)', 1) else inner_ end) as label from p)
select id as node_id, label, coalesce(try_cast(case when has then nullif(trim(regexp_extract(inner_, ';\s*w\s*=\s*([^;]*)', 1)), '') end as double), 1.0) as weight,
  case when has then nullif(trim(regexp_extract(inner_, ';\s*source\s*=\s*([^;]*)', 1)), '') end as source,
  coalesce(case when has then nullif(trim(regexp_extract(inner_, ';\s*id\s*=\s*([^;]*)', 1)), '') end, case when regexp_matches(label, '^[0-9A-Za-z]{{11}}$') then label end) as id_hint from q"""
)
def wikilink_extract(t: Tables) -> DataFrame:
    """The links in the nodes' contents with their parameters."""
    inner = t.pick("content").select(F.col("id").alias("node_id"), F.explode(text.wiki_links(F.col("content"))).alias("inner"))
    return inner.select("node_id", text.link_parts(F.col("inner")).alias("p")).select("node_id", "p.*")


@query(f"with {_NOW_NODES} select id, round(case when temperature > 0 and not pinned then greatest(0, least(1, temperature * exp(-0.05e0 * 5 / 60))) else temperature end, 6) as temperature from cur")
def decay_tick(t: Tables) -> DataFrame:
    """Temperatures after one tick."""
    return heat.decay_tick(t.pick("temperature", "pinned")).select("id", F.round("temperature", 6).alias("temperature"))


@query(f"with {_NOW_NODES}, hit as (select distinct target_node_id as id from relations where origin = 'manual') select c.id, round(case when hit.id is not null then least(1, temperature + 0.15e0) else temperature end, 6) as temperature, access_count + (hit.id is not null)::int as access_count from cur c left join hit using (id)")
def boost_clamped(t: Tables) -> DataFrame:
    """Temperatures after a read of everything linked by hand."""
    hit = t.raw("relations").where(F.col("origin") == "manual").select(F.col("target_node_id").alias("id"))
    return heat.boost(t.pick("temperature", "access_count", "last_accessed_at"), hit, NOW).select("id", F.round("temperature", 6).alias("temperature"), "access_count")


@query(
    """with recursive e as (select user_id, epoch(ts) as x, row_number() over (partition by user_id order by ts) as rn, count(*) over (partition by user_id) as n from events),
fold as (
  select user_id, rn, n, x, least(1e0, 0.5e0 + 0.15e0) as t from e where rn = 1
  union all
  select e.user_id, e.rn, e.n, e.x, least(1e0, f.t * exp(-0.05e0 * (e.x - f.x) / 3600e0) + 0.15e0) from fold f join e on e.user_id = f.user_id and e.rn = f.rn + 1)
select user_id as node_id, n as reads, round(t, 6) as temperature from fold where rn = n"""
)
def heat_fold(t: Tables) -> DataFrame:
    """Heat of each user of the event log, by its order."""
    return heat.heat_fold(t.raw("events"), "user_id", "ts").withColumn("temperature", F.round("temperature", 6))


@query(f"with {_NOW_NODES} select id, temperature from cur where temperature < 0.1 and not pinned order by temperature, id limit 50")
def cold_nodes(t: Tables) -> DataFrame:
    """The coldest nodes."""
    return heat.cold_nodes(t.pick("temperature", "pinned")).select("id", "temperature")


@query(f"with {_NOW_NODES}, m as (select max(last_accessed_at) as now from cur) select id, temperature from cur, m where temperature < 0.05 and not pinned and coalesce(last_accessed_at <= now - 86400, true)")
def cold_to_notify(t: Tables) -> DataFrame:
    """Cold nodes that nobody was told of within a day of the last read."""
    nodes = t.pick("temperature", "pinned", "last_accessed_at")
    now = nodes.agg(F.max("last_accessed_at")).first()[0] or 0
    return heat.to_notify(nodes, nodes.select("id", F.col("last_accessed_at").alias("notified_at")), now, ttl=86400)


@query(
    f"""with {_NOW_NODES}, {_CHANGES}, {_SNAPS}, c as (
select 'orphan_parent_id' as "check", count(*) as n from cur where pid is not null and pid not in (select id from cur)
union all select 'dangling_diffs', count(*) from ch where snapshot_id not in (select id from snaps)
union all select 'head_cursor', (count(*) = 0)::bigint from snaps)
select "check", case when n > 0 then 'fail' else 'pass' end as status, n from c union all select 'overall', case when sum(n) > 0 then 'fail' else 'pass' end, sum(n)::bigint from c"""
)
def doctor(t: Tables) -> DataFrame:
    """Integrity of the store."""
    return stats.doctor(t.pick("parent_id"), t.changes(), t.snapshots, t.last_snapshot())


@query(f"with {_CHANGES} select id from ch where snapshot_id not in (select id from snapshots)")
def dangling(t: Tables) -> DataFrame:
    """Changes whose snapshot is not there."""
    return t.changes().join(t.snapshots.select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_anti").select("id")


@query(f"with {_NOW_NODES} select id, case when pid in (select id from cur) then pid end as parent_id from cur")
def promote_orphans(t: Tables) -> DataFrame:
    """The nodes with orphans made roots."""
    return stats.promote_orphans(t.pick("parent_id")).select("id", "parent_id")


@query(
    """with s as (select session_id, max(client) as client, cast(floor(epoch(min(ts))) as bigint) as a, cast(floor(epoch(max(ts))) as bigint) as b, count(*) filter (lower(trim(role)) in ('tool', 'function')) as k from messages group by session_id)
select client, count(*) as sessions, sum(greatest(b - a, 0))::bigint as seconds, sum(k)::bigint as tool_calls, max(b) as last_seen from s group by all"""
)
def client_rollup(t: Tables) -> DataFrame:
    """Sessions, time and tool calls per client."""
    seconds = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 1_000_000)
    ledger = t.raw("messages").groupBy("session_id").agg(
        F.max("client").alias("client"), seconds(F.min("ts")).alias("connected_at"), seconds(F.max("ts")).alias("ended_at"), F.count_if(F.lower(F.trim("role")).isin("tool", "function")).alias("tool_calls")
    )
    return stats.client_rollup(ledger)


@query("union all ".join(f"select '{k}' as kind, coalesce(sum(len(regexp_extract_all(content, '{p}'))), 0)::bigint as n from nodes " for k, p in redaction.PATTERNS.items()))
def redaction_counts(t: Tables) -> DataFrame:
    """How often each token format occurs in the stored rows."""
    cols = redaction.kind_counts(F.col("content"))
    sums = t.raw("nodes").agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in cols.items()])
    return sums.select(F.expr(f"stack({len(cols)}, " + ", ".join(f"'{k}', {k}" for k in cols) + ") as (kind, n)"))


@query("select md5(text) as text_md5, count(*) as copies, min(doc_id) as first_id from documents where text is not null group by all having count(*) > 1")
def dup_content(t: Tables) -> DataFrame:
    """Texts that occur more than once."""
    return t.raw("documents").where(F.col("text").isNotNull()).groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where(F.col("copies") > 1)


@query("with l as (select doc_id, string_split(text, chr(10)) as ls from documents), u as (select doc_id, unnest(ls) as x, generate_subscripts(ls, 1) as line from l) select doc_id, cast(line as int) as line, md5(x) as line_md5 from u where contains(lower(x), 'budget') or contains(lower(x), 'kernel')")
def grep_baseline(t: Tables) -> DataFrame:
    """Lines of the corpus with one of two words."""
    return stats.grep_lines(t.raw("documents"), ["budget", "kernel"]).select("doc_id", "line", F.md5("text").alias("line_md5"))


@query(
    f"""with {_NOW_NODES}, f as (select source_file, sum(cast(ceil(strlen(label) * 0.25) as bigint)) as ours, sum(cast(ceil(strlen(content) * 0.25) as bigint)) as naive from cur group by all)
select source_file, round(case when naive > 0 then 100e0 * (1e0 - ours / naive) end, 6) as saved from f"""
)
def saving_pct(t: Tables) -> DataFrame:
    """Tokens that a file's labels save against its contents, in per cent."""
    per = t.pick("source_file", "label", "content").groupBy("source_file").agg(F.sum(text.token_estimate(F.col("label")).cast("long")).alias("ours"), F.sum(text.token_estimate(F.col("content")).cast("long")).alias("naive"))
    return per.select("source_file", F.round(stats.saving_percent(F.col("ours"), F.col("naive")), 6).alias("saved"))
