"""Queries of the numbered problems on texts (2, 3, 6, 7, 8) with the SQL they are checked against where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import read
from . import conversations, credentials, encoding, mixing, subjects


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Sessions to drop."""
    return conversations.dropped_sessions(read(spark, d, "messages")).select("session_id")


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Sessions to drop, with the first reason."""
    return conversations.dropped_sessions(read(spark, d, "messages"))


def p2_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The ordered messages of the sessions that stay."""
    return conversations.conversations(read(spark, d, "messages"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    nodes = read(spark, d, "nodes").select(F.lit("nodes").alias("table_name"), F.col("id").alias("record_id"), "content")
    settings = read(spark, d, "agent_settings").select(F.lit("agent_settings").alias("table_name"), F.col("settings_id").cast("string").alias("record_id"), F.col("settings").alias("content"))
    return nodes.unionByName(settings)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each literal credential of nodes and agent_settings."""
    return credentials.find_credentials(_texts(spark, d)).select("table_name", "record_id", "start_at").distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts that hold credentials, with only those blanked out."""
    texts = _texts(spark, d).distinct()
    return credentials.redact(texts, credentials.find_credentials(texts)).where(F.col("n_redacted") > 0)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of each document."""
    return encoding.encode_corpus(read(spark, d, "documents"))


def p6_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Number of tokens of each document."""
    return encoding.token_counts(read(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix with their repeat counts."""
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The actual share of each source in each mix."""
    return mixing.mix_shares(p7_mix(spark, d), read(spark, d, "mix_targets"))


def p7_filled(spark: SparkSession, d: str) -> DataFrame:
    """Mixes of as many tokens as their sources have together: small sources run short, and where their shares go."""
    targets = read(spark, d, "mix_targets")
    sizes = mixing.sized(read(spark, d, "documents"), targets)
    leaves = mixing.plan(sizes, targets, "all")
    return mixing.shortages(mixing.select(sizes, leaves), leaves, targets)


def p7_budgets(spark: SparkSession, d: str) -> DataFrame:
    """The budgets of all leaves by the same rules, with characters in place of tokens."""
    targets = read(spark, d, "mix_targets")
    sizes = mixing.keyed(read(spark, d, "documents"), targets).select("key.*", F.length("text").cast("long").alias("n_tokens")).where(F.col("n_tokens") > 0)
    leaves = mixing.plan(sizes, targets, "all")
    return leaves.select(*mixing.LEAF, F.col("epoch_tokens").alias("n_chars"), F.round("budget", 2).alias("budget"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The subject areas of each document."""
    return subjects.document_subjects(read(spark, d, "documents"), read(spark, d, "subject_areas"), read(spark, d, "subject_labels"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document each subject takes up."""
    return subjects.corpus_shares(read(spark, d, "documents"), read(spark, d, "subject_areas"), read(spark, d, "subject_labels"))


QUERIES = {f.__name__: f for f in (p2_found, p2_reasons, p2_conversations, p3_found, p3_redacted, p6_ids, p6_sizes, p7_mix, p7_shares, p7_filled, p7_budgets, p8_found, p8_shares)}

_SPACE = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"
_TURNS = rf"""with rows as (
  select session_id, turn, ts, message_id,
    case when r in ('user', 'human') then 'user' when r in ('assistant', 'model', 'ai') then 'assistant'
      when r in ('tool', 'function') then 'tool' when r in ('system', 'developer') then 'system' end as kind,
    content
  from (select *, regexp_replace(lower(role), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') as r from messages)),
said as (
  select session_id, turn, kind,
    coalesce(kind = 'user' and len(list_filter(content, lambda p: p.type in ('text', 'input_text') and regexp_matches(p.text, '[^{_SPACE}]'))) > 0, false) as is_user,
    coalesce(kind = 'assistant' and len(list_filter(content, lambda p: p.type in ('text', 'output_text') and regexp_matches(p.text, '[^{_SPACE}]'))) > 0, false) as is_reply
  from rows),
turns as (
  select session_id, turn, bool_or(is_user) as has_user, bool_or(is_reply) as has_reply, bool_or(coalesce(kind <> 'system', false)) as speaks
  from said where turn is not null group by all),
answers as (
  select *, count(*) filter (has_user) over (partition by session_id order by turn) as exchange from turns),
unanswered as (
  select session_id from answers where exchange > 0 group by session_id, exchange having not bool_or(has_reply)),
whole as (
  select session_id, bool_or(turn is null or kind is null) as broken, bool_or(is_user) as has_user, bool_or(is_reply) as has_reply,
    min(turn) as low, max(turn) - min(turn) + 1 as span, count(distinct turn) as n from said group by session_id),
opening as (select session_id, arg_min(has_user, turn) as ok from turns where speaks group by session_id),
reasons as (
  select session_id, case
    when not has_user or not has_reply then 'empty' when broken then 'broken'
    when low not in (0, 1) or span > n then 'gaps' when not coalesce(ok, false) then 'no_opening'
    when session_id in (select session_id from unanswered) then 'unanswered' end as reason
  from whole left join opening using (session_id))
"""



def _filled(table: str, group: str, name: str) -> str:
    """SQL of shares by weight under capacities: ``table`` has group, name, weight, capacity, budget; in order of capacity by weight the first ones are full."""
    return f"""(with r as (select *, sum(capacity) over w - capacity as c_before, sum(weight) over w - weight as w_before, sum(weight) over (partition by {group}) as w_all
    from {table} where weight > 0 and capacity > 0 window w as (partition by {group} order by capacity / weight, {name} rows unbounded preceding)),
  f as (select *, (budget - c_before) / (w_all - w_before) >= capacity / weight as is_full from r),
  l as (select {group}, (max(budget) - coalesce(sum(capacity) filter (is_full), 0)) / nullif(max(w_all) - coalesce(sum(weight) filter (is_full), 0), 0) as per from f group by {group})
  select f.* exclude (budget), case when is_full then capacity else weight * per end as budget from f join l using ({group}))"""


SQL = {
    "p7_budgets": r"""with s as (select distinct mix_name, regexp_replace(lower(trim(source)), '[\s_-]+', '_', 'g') as source, target_share, max_repeats from mix_targets),
d as (select regexp_replace(lower(regexp_replace(source, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '[\s\p{Z}_-]+', '_', 'g') as source, length(text)::double as n,
  coalesce(nullif(regexp_extract(lower(trim(lang)), '^([a-z]{2,3})(?:[-_].*)?$', 1), ''), 'und') as lang,
  case when lower(trim(doc_format)) in ('md', 'yaml', 'json', 'jsonl', 'html', 'toon', 'txt') then lower(trim(doc_format)) else 'other' end as format from documents where length(text) > 0),
leaf as (select mix_name, source, lang, format, max_repeats, target_share, sum(n) as n from d join s using (source) group by all),
langs as (select mix_name, source, lang, max_repeats, target_share, sum(n) as n from leaf group by all),
sources as (select mix_name, source, target_share as weight, sum(n) * max_repeats as capacity, sum(n) as n from langs group by mix_name, source, target_share, max_repeats),
asked as (select *, least(sum(n) over (partition by mix_name), sum(capacity) over (partition by mix_name)) as budget from sources),
by_source as """
    + _filled("asked", "mix_name", "source")
    + """, lang_asked as (select l.mix_name || '/' || l.source as branch, l.lang, sqrt(l.n) as weight, l.n * l.max_repeats as capacity, b.budget, l.n from langs l join by_source b using (mix_name, source)),
by_lang as """
    + _filled("lang_asked", "branch", "lang")
    + """ select mix_name, source, leaf.lang, format, leaf.n::bigint as n_chars, round(by_lang.budget * leaf.n / by_lang.n, 2) as budget
from leaf join by_lang on branch = mix_name || '/' || source and leaf.lang = by_lang.lang""",
    "p2_found": _TURNS + "select session_id from reasons where reason is not null",
    "p2_reasons": _TURNS + "select session_id, reason from reasons where reason is not null",
    "p2_conversations": _TURNS
    + """, firsts as (select session_id, turn, kind, min(ts) as first_ts from rows group by all),
once as (select session_id, turn, kind, ts, content, min(message_id) as message_id from rows group by all)
select session_id, row_number() over (partition by session_id order by turn, (kind in ('assistant', 'tool'))::int, first_ts nulls last, list_position(['system', 'user', 'assistant', 'tool'], kind), ts nulls last, message_id) - 1 as position,
  message_id, kind, cast(turn as bigint) as turn, array_to_string(list_filter(list_transform(content, lambda p: p.text), lambda t: t is not null), chr(10)) as text
from once join firsts using (session_id, turn, kind) where session_id not in (select session_id from reasons where reason is not null)""",
}
