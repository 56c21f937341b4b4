"""References to records that do not exist: tagged parent and child keys in long form, grouped by table and key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import Scratch
from ..tables import blank_to_null, current_rows, exact

SEPARATOR = "\u0001"
#: Columns that are read of pending references.
PENDING = ["id", "target_label", "target_source", "target_id_hint", "created_at"]
#: A key referred to by more rows than this, and than one in ``MOST_HOT_KEYS`` of the lost references, is handed to several tasks when its records are listed.
HOT_KEY_ROWS, MOST_HOT_KEYS = 200_000, 1_000
#: Tasks among which the records of one hot key are spread.
HOT_KEY_SPLITS = 32


def label_key(column) -> F.Column:
    """Labels compare without case and outer spaces (of any kind)."""
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def child_keys(nodes: DataFrame, relations: DataFrame, pending: DataFrame) -> DataFrame:
    """(table_name, record_id, created_at, kind, key): each reference with the kind of key it looks for.

    kind ``id`` is a node id, ``label`` a heading's label, ``label_file`` label and file (or tail of its path). A record
    of pending_relations with no hint and no label refers to nothing that could exist: its label key is the empty text.
    Rows without a reference (roots) are no children. A null target_node_id of a relation refers to no node: kind
    ``none``, which has no parents.
    """
    tree = current_rows(nodes, "parent_id", "created_at")
    tree = tree.where(blank_to_null(F.col("parent_id")).isNotNull()).select(
        F.lit("nodes").alias("table_name"), F.col("id").alias("record_id"), "created_at", F.lit("id").alias("kind"), F.col("parent_id").alias("key")
    )
    relations = exact(relations, "id", "target_node_id", "created_at")
    pending = exact(pending, *PENDING)
    links = relations.select(
        F.lit("relations").alias("table_name"),
        F.col("id").cast("string").alias("record_id"),
        "created_at",
        F.when(F.col("target_node_id").isNull(), "none").otherwise("id").alias("kind"),
        F.coalesce("target_node_id", F.lit("")).alias("key"),
    )
    hint, source = blank_to_null(F.col("target_id_hint")), blank_to_null(F.col("target_source"))
    label = label_key(F.coalesce("target_label", F.lit("")))
    waiting = pending.select(
        F.lit("pending_relations").alias("table_name"),
        F.col("id").cast("string").alias("record_id"),
        "created_at",
        F.when(hint.isNotNull(), "id").when(source.isNotNull(), "label_file").otherwise("label").alias("kind"),
        F.coalesce(hint, F.when(source.isNotNull(), F.concat(label, F.lit(SEPARATOR), source)).otherwise(label)).alias("key"),
    )
    return tree.unionByName(links).unionByName(waiting)


def parent_keys(nodes: DataFrame, pending: DataFrame) -> DataFrame:
    """(kind, key) of what exists: node ids; labels of headings; labels of headings with their file and every tail of its path.

    Tails are made only of headings whose label some pending record with a file asks for.
    """
    current = current_rows(nodes, "node_type", "label", "source_file")
    ids = current.select(F.lit("id").alias("kind"), F.col("id").alias("key"))
    headings = current.where((F.col("node_type") == "heading") & F.col("label").isNotNull()).select(label_key(F.col("label")).alias("key"), "source_file")
    labels = headings.select(F.lit("label").alias("kind"), "key")
    pending = exact(pending, *PENDING)
    asked = pending.where(blank_to_null(F.col("target_id_hint")).isNull() & blank_to_null(F.col("target_source")).isNotNull())
    asked = asked.select(label_key(F.coalesce("target_label", F.lit(""))).alias("key")).distinct()
    steps = F.split("source_file", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, i, F.size(steps)), "/"))
    in_file = headings.where(F.col("source_file").isNotNull()).join(asked, "key", "left_semi").select("key", F.explode(F.array_distinct(tails)).alias("tail"))
    in_file = in_file.select(F.lit("label_file").alias("kind"), F.concat("key", F.lit(SEPARATOR), "tail").alias("key"))
    return ids.unionByName(labels).unionByName(in_file)


def orphan_keys(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(kind, key, n): keys that some child has and no parent; n counts the children. Combines on the map side, so one hot key is no burden."""
    tagged = children.select("kind", "key", F.lit(0).alias("is_parent"), F.lit(1).alias("is_child"))
    tagged = tagged.unionByName(parents.select("kind", "key", F.lit(1).alias("is_parent"), F.lit(0).alias("is_child")))
    grouped = tagged.groupBy("kind", "key").agg(F.max("is_parent").alias("has_parent"), F.sum("is_child").alias("n"))
    return grouped.where((F.col("has_parent") == 0) & (F.col("n") > 0)).select("kind", "key", "n")


def orphan_records(nodes: DataFrame, relations: DataFrame, pending: DataFrame) -> DataFrame:
    """(table_name, created_month, record_id): each record whose reference finds no node; created_month is ``yyyy-MM`` in UTC, null without created_at.

    The records of a hot key are spread over ``HOT_KEY_SPLITS`` tasks: the orphan key is repeated so often and the child
    takes the split of its record id. A hot key has more than ``HOT_KEY_ROWS`` children and more than one in
    ``MOST_HOT_KEYS`` of all that are lost, so there are at most so many, at any size, and their list is broadcast. The
    orphan keys themselves are a written table, which the planner broadcasts only if its file size allows.
    """
    children = child_keys(nodes, relations, pending)
    _, lost = Scratch(nodes.sparkSession, "orphans").write(orphan_keys(children, parent_keys(nodes, pending)))
    least = max(HOT_KEY_ROWS, (lost.agg(F.sum("n")).first()[0] or 0) // MOST_HOT_KEYS)
    hot = lost.where(F.col("n") > least).select("kind", "key", F.lit(True).alias("is_hot"))
    splits = F.when(F.col("n") > least, F.sequence(F.lit(0), F.lit(HOT_KEY_SPLITS - 1))).otherwise(F.array(F.lit(0)))
    wanted = lost.select("kind", "key", F.explode(splits).alias("split"))
    spread = F.when(F.col("is_hot"), F.pmod(F.xxhash64("record_id"), F.lit(HOT_KEY_SPLITS)).cast("int")).otherwise(F.lit(0))
    marked = children.join(F.broadcast(hot), ["kind", "key"], "left").withColumn("split", spread)
    found = marked.join(wanted, ["kind", "key", "split"], "left_semi")
    return found.select("table_name", month_utc(F.col("created_at")).alias("created_month"), "record_id").distinct()


def month_utc(epoch) -> F.Column:
    """``yyyy-MM`` of epoch seconds in UTC, whatever the session's time zone: days since 1970 are whole there."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / F.lit(86400)).cast("int")), "yyyy-MM")


def orphan_counts(records: DataFrame) -> DataFrame:
    """(table_name, created_month, orphans): how many orphan records each table has per month."""
    return records.groupBy("table_name", "created_month").agg(F.count("*").alias("orphans"))
