"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import cut as checkpoint
from ..operators.state import remove, shared_path
from ..streaming.merge import filesystem

__all__ = ["SPACE", "WORD", "checkpoint", "connected_components", "filesystem", "joined_stars", "remove", "shared_path", "table"]

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b) of longs.

    Returns (a, root) for every node that has an edge to another one, root being the
    smallest node reachable; the roots themselves are left out. Alternates large-star and
    small-star steps, each a pre-aggregated minimum and a join, until the edges are stars;
    the edges are checkpointed after each round. Edges that are stars already take no round.
    Self loops, repeated edges and nulls are dropped.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = checkpoint(edges.distinct())
    while not are_stars(edges):
        low = flat(edges, ("a", "b"), ("b", "a")).groupBy("a").agg(F.min("b").alias("m"))
        # A node's larger neighbours go to its smallest one, whether that is smaller than itself or not.
        large = edges.join(low.withColumnRenamed("a", "b"), "b").select("a", F.least("b", "m").alias("b")).distinct()
        # A node and its smaller neighbours go to the smallest of these.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = checkpoint(flat(large.join(low, "a"), ("a", "m"), ("b", "m")).where("a <> b").distinct())
    return edges.select("a", F.col("b").alias("root"))


def flat(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(a, b): for each row of df one row for each of these pairs of its columns."""
    each = F.explode(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs)))
    return df.select(each.alias("each")).select("each.*")


def are_stars(edges: DataFrame) -> bool:
    """Whether every a of these different edges (a, b) has one b, and no b is an a."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"))))
    nodes = edges.select(ends.alias("end")).groupBy("end.node").agg(F.sum("end.up").alias("ups"), F.min("end.up").alias("least"))
    return nodes.where("ups > 1 or ups = 1 and least = 0").isEmpty()


def joined_stars(stars: DataFrame, links: DataFrame) -> DataFrame:
    """What connected_components() returns, of the components stars(a, root) and further links (a, b), whose ends are roots of these
    or no node of them. Only the links go through rounds."""
    more = connected_components(links)
    to = more.select(F.col("a").alias("old"), F.col("root").alias("new"))
    known = stars.join(to, stars["root"] == to["old"], "left").select("a", F.coalesce("new", "root").alias("root"))
    return checkpoint(known.union(more))
