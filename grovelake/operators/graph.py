"""Links between nodes: resolving references, weighted walks, the nodes of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import Scratch
from ..tables import blank_to_null
from .orphans import SEPARATOR, label_key

#: Nodes that an answer about one anchor names at most.
MOST_RELATED = 100


def resolve_refs(pending: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, target_id): the node that each pending reference means, null where none does.

    An id hint counts alone: if it misses, there is no fallback. Else a heading in the given file (whole path or its
    tail), the first by depth and id; without a file any heading of that label, the first by file, depth and id. Labels
    compare without case and outer spaces. The candidates are reduced to the first per key before the join, so a label
    that very many headings share is no hot key.
    """
    p = pending.dropDuplicates(["id"]).select(
        "id", blank_to_null(F.col("target_id_hint")).alias("hint"), blank_to_null(F.col("target_source")).alias("file"), label_key(F.coalesce("target_label", F.lit(""))).alias("label")
    )
    heads = nodes.where((F.col("node_type") == "heading") & F.col("label").isNotNull()).select(label_key(F.col("label")).alias("label"), "source_file", "depth", F.col("id").alias("node_id"))
    anywhere = heads.groupBy("label").agg(F.min(F.struct("source_file", "depth", "node_id")).alias("m")).select("label", F.col("m.node_id").alias("by_label"))
    asked = p.where(F.col("hint").isNull() & F.col("file").isNotNull()).select("label").distinct()
    steps = F.split("source_file", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, i, F.size(steps)), "/"))
    tailed = heads.where(F.col("source_file").isNotNull()).join(asked, "label", "left_semi").select("label", "depth", "node_id", F.explode(F.array_distinct(tails)).alias("tail"))
    in_file = tailed.groupBy(F.concat("label", F.lit(SEPARATOR), "tail").alias("key")).agg(F.min(F.struct("depth", "node_id")).alias("m")).select("key", F.col("m.node_id").alias("by_file"))
    ids = nodes.select(F.col("id").alias("by_hint"))
    p = p.withColumn("key", F.when(F.col("file").isNotNull(), F.concat("label", F.lit(SEPARATOR), "file")))
    found = p.join(ids, F.col("hint") == F.col("by_hint"), "left").join(in_file, "key", "left").join(anywhere, "label", "left")
    target = F.when(F.col("hint").isNotNull(), F.col("by_hint")).when(F.col("file").isNotNull(), F.col("by_file")).when(F.col("label") != "", F.col("by_label"))
    return found.select("id", target.alias("target_id"))


def settle(pending: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, pending rows that are left): what resolves becomes an edge (id, source_node_id, target_node_id, weight, origin) and is pending no more. A weight of 0 means 1."""
    found = resolve_refs(pending, nodes).where(F.col("target_id").isNotNull())
    weight = F.when(F.col("weight") == 0, F.lit(1.0)).otherwise(F.col("weight"))
    edges = pending.join(found, "id").select("id", "source_node_id", F.col("target_id").alias("target_node_id"), weight.alias("weight"), "origin")
    return edges, pending.join(found, "id", "left_anti")


def nearest(reached: DataFrame, nodes: DataFrame, limit: int = MOST_RELATED) -> DataFrame:
    """``related`` with (token_count, rank): each anchor's ``limit`` nodes that exist with the fewest links, then the greatest weight, then by id.

    Spark keeps at most ``limit`` rows per anchor and task before the shuffle, so an anchor that reaches most nodes is no hot task.
    """
    rows = reached.join(nodes.select(F.col("id").alias("node_id"), "token_count"), "node_id")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy("hop", F.col("weight").desc(), "node_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def related(relations: DataFrame, anchors: DataFrame, hops: int = 1, least_weight: float = 0.0, direction: str = "both") -> DataFrame:
    """(anchor_id, node_id, hop, weight): nodes reached from each anchor (``id``) in at most ``hops`` links.

    hop is the least number of links, weight the greatest sum of weights of a walk of at most that many links. Links
    lighter than ``least_weight`` are not taken; the anchor itself is left out. ``both`` joins the walks along and
    against the links. Per hop only the heaviest walk to a node is kept: sums of what follows depend on nothing else,
    so walks are not enumerated and cycles end with the hops.
    """
    edges = relations.where(F.col("weight") >= least_weight).groupBy("source_node_id", "target_node_id").agg(F.max("weight").alias("w"))
    if direction == "both":
        both = related(relations, anchors, hops, least_weight, "out").unionByName(related(relations, anchors, hops, least_weight, "in"))
        return both.groupBy("anchor_id", "node_id").agg(F.min("hop").alias("hop"), F.max("weight").alias("weight"))
    a, b = ("source_node_id", "target_node_id") if direction == "out" else ("target_node_id", "source_node_id")
    edges = edges.select(F.col(a).alias("_from"), F.col(b).alias("_to"), "w")
    scratch = Scratch(relations.sparkSession, "related")
    front = anchors.select(F.col("id").alias("anchor_id"), F.col("id").alias("node_id"), F.lit(0.0).alias("weight")).distinct()
    seen = None
    for hop in range(1, hops + 1):
        step = front.join(edges, F.col("node_id") == F.col("_from")).groupBy("anchor_id", F.col("_to").alias("node_id")).agg(F.max(F.col("weight") + F.col("w")).alias("weight"))
        _, front = scratch.write(step)
        rows = front.withColumn("hop", F.lit(hop))
        seen = rows if seen is None else seen.unionByName(rows)
    return seen.where(F.col("node_id") != F.col("anchor_id")).groupBy("anchor_id", "node_id").agg(F.min("hop").alias("hop"), F.max("weight").alias("weight"))


def graph_nodes(nodes: DataFrame, relations: DataFrame, pending: DataFrame) -> DataFrame:
    """Nodes at either end of a link, or with a pending reference."""
    ends = relations.select(F.col("source_node_id").alias("id")).unionByName(relations.select(F.col("target_node_id").alias("id"))).unionByName(pending.select(F.col("source_node_id").alias("id")))
    return nodes.join(ends.distinct(), "id", "left_semi")


def degrees(relations: DataFrame) -> DataFrame:
    """(node_id, outgoing, incoming): links per node."""
    out = relations.select(F.col("source_node_id").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = relations.select(F.col("target_node_id").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.unionByName(into).groupBy("node_id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))
