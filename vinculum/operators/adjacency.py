"""The stored adjacency: every edge from both ends, bucketed by the end it starts from.

It is built once per graph and shared by path search and neighbourhood lookup. Rows that
look nodes up are shuffled to its buckets; the edges themselves never move again. A node
with more than ``hub_edges`` edges is cut into parts by hash, so a hub is many buckets'
work; the few hubs are a table of their own, by which lookups learn a node's parts.
A search that looks up few nodes scans the edges instead and stores no adjacency.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.session import write_bucketed, write_through

# Edges of one node that stay together.
HUB_EDGES = 100_000


@dataclass(frozen=True)
class Adjacency:
    """``rows``: (from_id, part, to_id, to_type, rel, edge); ``hubs``: (from_id, parts) of nodes in parts, or None.

    ``bucketed`` is false for the edges as they are (``scanned``).
    """

    rows: DataFrame
    hubs: DataFrame | None
    bucketed: bool = True

    def follow(self, rows: DataFrame, node: str = "node") -> DataFrame:
        """``rows`` with one row per edge of their ``node``, which becomes ``from_id``."""
        asked = rows.withColumnRenamed(node, "from_id")
        if not self.bucketed:
            asked = write_through(asked, "asked")
        if self.hubs is None:
            return asked.join(self.rows.drop("part"), "from_id")
        parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
        asked = asked.join(self.hubs, "from_id", "left").withColumn("part", F.explode(parts)).drop("parts")
        return asked.join(self.rows, ["from_id", "part"]).drop("part")


def both_ways(edges: DataFrame) -> DataFrame:
    """(from_id, to_id, to_type, rel, edge): each edge from both ends, a loop once, from one scan.

    ``edge`` is a 64-bit hash of (source, type, target); it only tells edges of one trail apart.
    """
    out = F.struct(F.col("source").alias("from_id"), F.col("target").alias("to_id"), F.col("target_type").alias("to_type"))
    back = F.struct(F.col("target").alias("from_id"), F.col("source").alias("to_id"), F.col("source_type").alias("to_type"))
    ways = F.when(F.col("source") == F.col("target"), F.array(out)).otherwise(F.array(out, back))
    rows = edges.select(F.inline(ways), F.col("type").alias("rel"), F.xxhash64("source", "type", "target").alias("edge"))
    return rows.where(F.col("from_id").isNotNull())


def store_adjacency(edges: DataFrame, hub_edges: int = HUB_EDGES, table: str | None = None) -> Adjacency:
    """Store ``edges`` (source, target, type, source_type, target_type) for lookups from either end.

    The table has as many buckets as the session has shuffle partitions, so that lookups match
    it without a second exchange. It lies in the shared scratch folder under the name ``table``.
    """
    spark = edges.sparkSession
    rows = both_ways(edges)
    parts = F.ceil(F.col("count") / hub_edges).cast("int").alias("parts")
    hubs = write_through(rows.groupBy("from_id").count().where(F.col("count") > hub_edges).select("from_id", parts), "hubs")
    hubs = None if hubs.isEmpty() else hubs
    if hubs is None:
        keys, rows = ["from_id"], rows.withColumn("part", F.lit(0))
    else:
        part = F.pmod(F.xxhash64("to_id", "edge"), F.coalesce("parts", F.lit(1))).cast("int")
        keys, rows = ["from_id", "part"], rows.join(hubs, "from_id", "left").withColumn("part", part).drop("parts")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("from_id", "part", "to_id", "to_type", "rel", "edge").repartition(buckets, *keys)
    return Adjacency(write_bucketed(rows, "adjacency", keys, table), hubs)


def scanned(edges: DataFrame) -> Adjacency:
    """The stored table ``edges`` itself, for lookups of few nodes: nothing is built for them.

    What is looked up is stored, so that Spark knows its size: a small table is broadcast to a scan
    of the edges, a large one shuffled with them. A filter on ``to_type`` reaches the scan.
    """
    fields = lambda a, b: [
        F.col(a).alias("from_id"), F.col(f"{a}_type").alias("from_type"), F.col(b).alias("to_id"), F.col(f"{b}_type").alias("to_type"),
        F.col("type").alias("rel"), F.xxhash64("source", "type", "target").alias("edge"),
    ]
    out = edges.where(F.col("source").isNotNull()).select(*fields("source", "target"))
    back = edges.where(F.col("target").isNotNull() & ~F.col("source").eqNullSafe(F.col("target")))
    return Adjacency(out.unionByName(back.select(*fields("target", "source"))), None, bucketed=False)


def held(adj: Adjacency, nodes: DataFrame) -> tuple[Adjacency, Adjacency]:
    """The scanned edges at some nodes, stored for further lookups: from these nodes, and from the other ends to them."""
    own = write_through(adj.follow(nodes.select("node").distinct()), "held")
    to = {"from_id": "to_id", "from_type": "to_type", "to_id": "from_id", "to_type": "from_type"}
    return Adjacency(own, None), Adjacency(own.select(*[F.col(to.get(c, c)).alias(c) for c in own.columns]), None)


def stored(edges: DataFrame | Adjacency) -> Adjacency:
    return edges if isinstance(edges, Adjacency) else store_adjacency(edges)
