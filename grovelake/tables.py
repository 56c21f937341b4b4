"""Reading the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with only the columns of exactly these names, also where others differ from them in case alone or are there twice (then the first)."""
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*names)
    numbered = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"_c{df.columns.index(n)}").alias(n) for n in names])


def current_rows(nodes: DataFrame, *columns: str) -> DataFrame:
    """One row per node id: the one with the highest updated_at (rows equal in both are equal throughout).

    ``columns`` are the ones to keep besides id. Aggregated as one struct, so versions combine on the map side.
    Rows without an id are not nodes. A null updated_at counts as the oldest; ties go to the greatest row.
    """
    nodes = exact(nodes, *dict.fromkeys(["id", "updated_at", *columns]))
    kept = F.struct(F.col("updated_at").alias("_at"), *[F.col(c) for c in columns])
    best = nodes.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(kept).alias("_row"))
    return best.select("id", *[F.col(f"_row.{c}").alias(c) for c in columns])


def blank_to_null(column) -> F.Column:
    """Null and the empty string mean the same in the store's reference columns."""
    return F.when(column != "", column)
