"""Code graphs: nodes (qualified_name, name, kind, file_path, ...) and edges (kind, source_qualified, target_qualified)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

CALLS, FOUND, RELATED, HUBS, HOPS, BLAST = "CALLS", 50, 200, 20, 2, 50


def held(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose name or qualified name is LIKE the query within; place is 0 for exact names, 1 for ends after a dot, else 2."""
    q = query.lower()
    like = "%" + q.replace("\\", "\\\\") + "%"
    place = F.when(F.lower("name") == q, 0).when(F.endswith(F.lower("qualified_name"), F.lit("." + q)), 1).otherwise(2)
    return nodes.where(F.lower("name").like(like) | F.lower("qualified_name").like(like)).withColumn("place", place)


def find(nodes: DataFrame, query: str, limit: int = FOUND) -> DataFrame:
    """The first of held() by place, short ones before long ones."""
    return held(nodes, query).orderBy("place", F.length("qualified_name"), "qualified_name").limit(limit)


def node(nodes: DataFrame, qualified: str) -> DataFrame:
    return nodes.where(F.col("qualified_name") == qualified).limit(1)


def callers(nodes: DataFrame, edges: DataFrame, seed: str, kind: str = CALLS) -> DataFrame:
    own = edges.where((F.col("target_qualified") == seed) & (F.col("kind") == kind)).select(F.col("source_qualified").alias("qualified_name"))
    return nodes.join(own, "qualified_name").orderBy("qualified_name").limit(RELATED)


def callees(nodes: DataFrame, edges: DataFrame, seed: str, kind: str = CALLS) -> DataFrame:
    own = edges.where((F.col("source_qualified") == seed) & (F.col("kind") == kind)).select(F.col("target_qualified").alias("qualified_name"))
    return nodes.join(own, "qualified_name").orderBy("qualified_name").limit(RELATED)


def out_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counted = edges.groupBy(F.col("source_qualified").alias("qualified_name")).agg(F.count("*").alias("n"))
    return nodes.join(counted, "qualified_name", "left").withColumn("degree", F.coalesce("n", F.lit(0))).drop("n")


def hubs(nodes: DataFrame, edges: DataFrame, limit: int = HUBS) -> DataFrame:
    return out_degrees(nodes, edges).orderBy(F.desc("degree"), "qualified_name").limit(limit)


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(qualified_name, hop): what lies within so many steps of seeds (qualified_name), either way, each at its least distance."""
    links = edges.select(F.col("source_qualified").alias("from"), F.col("target_qualified").alias("to"))
    both = cut(links.union(links.select("to", "from")).distinct())
    seen = seeds.select("qualified_name", F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, hops + 1):
        onward = both.join(front.select(F.col("qualified_name").alias("from")), "from").select(F.col("to").alias("qualified_name")).distinct()
        front = cut(onward.join(seen, "qualified_name", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.union(front)
    return seen


def blast_radius(nodes: DataFrame, edges: DataFrame, seed: str, hops: int = HOPS, cap: int = BLAST) -> tuple[DataFrame, bool]:
    """(blast(), whether there was more than the cap holds). A hop goes on from cap names at most, and none is made once there are more."""
    links = edges.select(F.col("source_qualified").alias("from"), F.col("target_qualified").alias("to"))
    both = links.union(links.select("to", "from").toDF("from", "to"))
    front = edges.sparkSession.createDataFrame([(seed, 0)], "qualified_name string, hop int")
    seen, n = front, 0
    for hop in range(1, hops + 1):
        onward = both.join(F.broadcast(front.select(F.col("qualified_name").alias("from"))), "from").select(F.col("to").alias("qualified_name")).distinct()
        # What is kept is by hop and name, so of this hop's names the first that there is room for are enough; one more tells of more.
        front = cut(onward.join(F.broadcast(seen.select("qualified_name")), "qualified_name", "left_anti").orderBy("qualified_name").limit(cap + 1 - n).withColumn("hop", F.lit(hop)))
        seen, more = seen.union(front), front.count()
        n += more
        if not more or n > cap:
            break
    nearest = seen.where("hop > 0").orderBy("hop", "qualified_name").limit(cap)
    return nearest.join(nodes, "qualified_name").orderBy("hop", "qualified_name"), n > cap


def blast(nodes: DataFrame, edges: DataFrame, seed: str, hops: int = HOPS, cap: int = BLAST) -> DataFrame:
    """The nodes within so many hops of the seed, without it, the nearest first, cap at most; names without a node count towards the cap."""
    return blast_radius(nodes, edges, seed, hops, cap)[0]
